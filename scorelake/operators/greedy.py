"""Order-dependent choices: suppression of overlapping boxes and one-to-one matching.

Both rules walk through rows by priority and let an earlier choice forbid later ones. Suppression folds groups of
ordinary size in one expression, matching walks through them in one sorted pass. Groups beyond `max_group` rows take rounds instead:
every row that is the best of its whole neighbourhood is decided at once, its rivals leave, and
the next round works on the rest. The result of the rounds equals the sequential walk, since a row
without a better undecided rival is chosen there too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.boxes import Box, box, intersection_area, iou
from scorelake.operators.greedy_size import split_by_size
from scorelake.operators.spatial import explode_cells
from scorelake.session import cut_lineage, ship_package

MAX_GROUP = 2048
Conflict = Callable[[Box, Box], Column]


def iou_conflict(threshold: float) -> Conflict:
    if threshold <= 0:
        raise ValueError("the IoU threshold must be positive")
    return lambda kept, other: iou(kept, other) >= threshold


def covered_conflict(ratio: float) -> Conflict:
    """The later box is covered by the kept one beyond `ratio` of its own area."""
    return lambda kept, other: (other.area > 0) & (intersection_area(kept, other) > other.area * ratio)


def _suppress_fold(df: DataFrame, keys: Sequence[str], conflict: Conflict) -> DataFrame:
    payload = [c for c in df.columns if c not in keys]
    ordered = F.array_sort(F.collect_list(F.struct("prio", *[c for c in payload if c != "prio"])))
    grouped = df.groupBy(*keys).agg(ordered.alias("rows"))

    # the accumulator holds every row with its keeper; a kept row is its own keeper
    # and cheap overlap tests come before the ratio
    def rivals(d: Column, row: Column) -> Column:
        a, b = box(of=d["row"]), box(of=row)
        apart = (a.x1 <= b.x0) | (b.x1 <= a.x0) | (a.y1 <= b.y0) | (b.y1 <= a.y0)
        return ~apart & (d["keeper"] == d["row"]["prio"]) & conflict(a, b)

    def step(done: Column, row: Column) -> Column:
        rival = F.filter(done, lambda d: rivals(d, row))
        return F.array_append(done, F.struct(
            row.alias("row"), F.coalesce(F.get(rival, F.lit(0))["keeper"], row["prio"]).alias("keeper")))

    empty = F.transform(F.filter("rows", lambda _: F.lit(False)), lambda r: F.struct(r.alias("row"), r["prio"].alias("keeper")))
    return grouped.select(*keys, F.explode(F.aggregate("rows", empty, step)).alias("o")).select(
        *keys, *(F.col(f"o.row.{c}").alias(c) for c in payload), F.col("o.keeper").alias("keeper"))


def _suppress_rounds(df: DataFrame, keys: Sequence[str], conflict: Conflict, cell: float) -> DataFrame:
    """Rounds on grid cells: the work of a round is linear in the undecided rows, also for copies."""
    cells = [*keys, "cell_x", "cell_y"]
    b = box()
    n_cells = (F.floor(b.x1 / cell) - F.floor(b.x0 / cell) + 1) * (F.floor(b.y1 / cell) - F.floor(b.y0 / cell) + 1)
    undecided = cut_lineage(df.select(*keys, "prio", *b, n_cells.alias("n_cells")))
    kept_parts: list[DataFrame] = []
    other = Box(*(F.col("k_" + n) for n in Box._fields))
    while not undecided.isEmpty():
        spread = explode_cells(undecided, b, cell, cell)
        # the best row of every cell; a row that leads all its cells has no better rival left
        lead = spread.groupBy(*cells).agg(F.min(F.struct("prio", *b, "n_cells")).alias("best"))
        winners = cut_lineage(
            lead.groupBy(*keys, "best").agg(F.count("*").alias("leads"))
            .filter(F.col("leads") == F.col("best.n_cells")).select(*keys, "best.*").drop("n_cells"))
        kept_parts.append(winners)
        winner_cells = explode_cells(winners, b, cell, cell).select(
            *cells, F.col("prio").alias("k_prio"), *b.columns("k_"))
        decided = (spread.join(winner_cells, cells)
                   .filter((F.col("k_prio") == F.col("prio")) | conflict(other, b))
                   .select(*keys, "prio").distinct())
        undecided = cut_lineage(undecided.join(decided, [*keys, "prio"], "left_anti"))
    kept = kept_parts[0]
    for part in kept_parts[1:]:
        kept = kept.unionByName(part)
    kept_cells = explode_cells(kept, b, cell, cell).select(*cells, F.col("prio").alias("k_prio"), *b.columns("k_"))
    keeper = (explode_cells(df.select(*keys, "prio", *b), b, cell, cell).join(kept_cells, cells)
              .filter((F.col("k_prio") == F.col("prio")) | ((F.col("k_prio") < F.col("prio")) & conflict(other, b)))
              .groupBy(*keys, "prio").agg(F.min("k_prio").alias("keeper")))
    return df.join(keeper, [*keys, "prio"])


def suppress(df: DataFrame, *, keys: Sequence[str], priority: Sequence[Column], conflict: Conflict,
             max_group: int = MAX_GROUP, cell: float = 64) -> DataFrame:
    """Assign every box to the kept box that absorbs it.

    `priority` is ascending and must end in a unique column. Adds `keeper` (the priority of the
    kept box, equal to `prio` for kept boxes) and `prio`; kept boxes absorb themselves.
    """
    work = df.withColumn("prio", F.struct(*(p.alias(f"p{i}") for i, p in enumerate(priority))))
    small, large = split_by_size(work, keys, max_group)
    out = _suppress_fold(small, keys, conflict)
    if large is not None:
        out = out.unionByName(_suppress_rounds(large, keys, conflict, cell))
    return out


def _walked(n_keys: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chosen pairs of groups that arrive one behind the other, best pair first; a side that is NULL is never taken. Holds the ids of one group."""
    group, lefts, rights = None, set(), set()
    for batch in batches:
        keys, chosen = zip(*(batch.column(i).to_pylist() for i in range(n_keys))), []
        sides = (batch.column(i).to_pylist() for i in (n_keys, n_keys + 1))
        for i, (key, left, right) in enumerate(zip(keys, *sides)):
            if key != group:
                group, lefts, rights = key, set(), set()
            if left in lefts or right in rights:
                continue
            chosen.append(i)
            if left is not None:
                lefts.add(left)
            if right is not None:
                rights.add(right)
        yield batch.take(pa.array(chosen, pa.int64()))


def _match_walk(pairs: DataFrame, keys: Sequence[str], left: str, right: str, payload: Sequence[str]) -> DataFrame:
    """Spark brings the pairs of a group together and in order; one pass then keeps the ids that are used up."""
    ship_package(pairs.sparkSession)
    columns = [*keys, left, right, *payload]
    rows = pairs.repartition(*keys).sortWithinPartitions(*keys, "prio").select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(partial(_walked, len(keys)), schema)


def _match_rounds(pairs: DataFrame, keys: Sequence[str], left: str, right: str, payload: Sequence[str]) -> DataFrame:
    open_pairs = cut_lineage(pairs)
    parts: list[DataFrame] = []
    while not open_pairs.isEmpty():
        best = F.min(F.struct("prio", left, right, *payload)).alias("best")
        by_left = open_pairs.groupBy(*keys, left).agg(best).select(*keys, "best")
        by_right = open_pairs.groupBy(*keys, right).agg(best).select(*keys, "best")
        mutual = cut_lineage(by_left.join(by_right, [*keys, "best"]).select(*keys, "best.*"))
        parts.append(mutual.select(*keys, left, right, *payload))
        open_pairs = cut_lineage(
            open_pairs.join(mutual.select(*keys, left), [*keys, left], "left_anti")
            .join(mutual.select(*keys, right), [*keys, right], "left_anti"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def match(pairs: DataFrame, *, keys: Sequence[str], left: str, right: str, priority: Sequence[Column],
          payload: Sequence[str] = (), max_group: int = MAX_GROUP) -> DataFrame:
    """Greedy one-to-one matching: walk pairs by ascending `priority`, use each side once."""
    work = pairs.select(*keys, left, right, *payload,
                        F.struct(*(p.alias(f"p{i}") for i, p in enumerate(priority))).alias("prio"))
    work = cut_lineage(work)  # the join that made the pairs runs once for the size check and the choice
    small, large = split_by_size(work, keys, max_group)
    out = _match_walk(small, keys, left, right, payload)
    if large is not None:
        out = out.unionByName(_match_rounds(large, keys, left, right, payload))
    return out
