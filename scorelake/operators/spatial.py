"""Joins of boxes on a grid.

Two boxes are compared only when they share a grid cell, so the join is an equi-join on
(keys, cell) and even a page that holds most rows is spread over its cells. A pair that shares
several cells is reported in one of them: the cell of the top-left corner of the overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.boxes import Box
from scorelake.operators.greedy_size import split_by_size
from scorelake.session import cut_lineage, ship_package

CELL = 256
MAX_PARTNERS = 512


def cell_range(low: Column, high: Column, size: float) -> Column:
    first = F.floor(low / size)
    return F.sequence(first, F.greatest(first, F.floor(high / size)))


def explode_cells(df: DataFrame, region: Box, cell_w: float = CELL, cell_h: float = CELL) -> DataFrame:
    """One row per grid cell touched by `region`, in columns `cell_x`, `cell_y`."""
    return (df.withColumn("cell_x", F.explode(cell_range(region.x0, region.x1, cell_w)))
              .withColumn("cell_y", F.explode(cell_range(region.y0, region.y1, cell_h))))


def touches(a: Box, b: Box) -> Column:
    """Closed boxes with at least one common point."""
    return (a.x0 <= b.x1) & (b.x0 <= a.x1) & (a.y0 <= b.y1) & (b.y0 <= a.y1)


def grid_join(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str],
    left_region: Box,
    right_region: Box,
    condition: Column | None = None,
    how: str = "inner",
    cell_w: float = CELL,
    cell_h: float = CELL,
) -> DataFrame:
    """Join rows whose regions touch. `right` columns other than `keys` must not clash with `left`.

    With `how="left"` a left row appears once per cell without partner in that cell: aggregate the
    result by the left identity (orderings that are NULL for missing partners are skipped by min_by).
    """
    names = ("gx0", "gy0", "gx1", "gy1")
    lhs = left.select("*", *(c.alias("l" + n) for c, n in zip(left_region, names)))
    rhs = right.select("*", *(c.alias("r" + n) for c, n in zip(right_region, names)))
    lbox, rbox = Box(*(F.col("l" + n) for n in names)), Box(*(F.col("r" + n) for n in names))
    lhs = explode_cells(lhs, lbox, cell_w, cell_h)
    rhs = explode_cells(rhs, rbox, cell_w, cell_h)
    for key in [*keys, "cell_x", "cell_y"]:
        rhs = rhs.withColumnRenamed(key, "r_" + key)
    on = F.lit(True)
    for key in [*keys, "cell_x", "cell_y"]:
        on = on & (F.col(key) == F.col("r_" + key))
    on = on & touches(lbox, rbox)
    on = on & (F.floor(F.greatest(lbox.x0, rbox.x0) / cell_w) == F.col("cell_x"))
    on = on & (F.floor(F.greatest(lbox.y0, rbox.y0) / cell_h) == F.col("cell_y"))
    if condition is not None:
        on = on & condition
    drop = ["cell_x", "cell_y", *("r_" + k for k in [*keys, "cell_x", "cell_y"]),
            *("l" + n for n in names), *("r" + n for n in names)]
    return lhs.join(rhs, on, how).drop(*drop)


def collapse_copies(df: DataFrame, keys: Sequence[str], id_col: str, extra: Sequence[str] = ()) -> DataFrame:
    """One row per distinct box, holding the smallest id.

    Copies of a box are equal for every geometric rule, and ties go to the first row, so a nearest
    join needs only this row. It bounds the partners in a cell by geometry, not by the data.
    """
    return df.groupBy(*keys, "x0", "y0", "x1", "y1", *extra).agg(F.min(id_col).alias(id_col))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column through a one-element generator.

    The optimizer copies a projected expression into every later use and into null checks of joins;
    it does not do so across a generator, so the value is computed once per row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


#: Cost of pairs of a point and a target of its cell, from their columns as arrays; NaN where a gate fails.
PairCost = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]
#: Pairs priced at once in a task.
PAIRS_AT_ONCE = 1 << 18


def _cheapest(cost: PairCost, ends: dict[str, Sequence[str]], sizes: Sequence[str], fields: Sequence[str], n_out: int,
              batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first `n_out` columns of rows with the cheapest target of each end, whose measures are columns `__m_<end>_<measure>`; the
    targets are the last column. Ties go by the fields in turn."""
    for batch in _pieces(batches):
        lists = batch.column(batch.num_columns - 1)
        at = np.repeat(np.arange(batch.num_rows), _lengths(lists))
        targets = lists.flatten()
        ties = [pc.rank(targets.field(f), null_placement="at_start", tiebreaker="dense").to_numpy() for f in fields
                if pa.types.is_primitive(targets.field(f).type) or pa.types.is_string(targets.field(f).type)] if len(targets) else []
        columns = list(batch.columns[:n_out])
        for end, measures in ends.items():
            best, price = np.full(batch.num_rows, -1), np.full(batch.num_rows, np.nan)
            if len(targets):
                found = cost({m: _numbers(batch.column(f"__m_{end}_{m}"))[at] for m in measures}, {s: _numbers(targets.field(s)) for s in sizes})
                some = np.flatnonzero(~np.isnan(found))
                order = some[np.lexsort((*(t[some] for t in reversed(ties)), found[some], at[some]))]
                first = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
                best[at[first]], price[at[first]] = first, found[first]
            index = pa.array(best, mask=best < 0)
            columns.append(pa.StructArray.from_arrays([pa.array(price), *(targets.field(f).take(index) for f in fields)], names=["cost", *fields],
                                                      mask=pa.array(best < 0)))
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:n_out], *ends])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where their lists pass `PAIRS_AT_ONCE` elements."""
    for batch in batches:
        block = np.cumsum(_lengths(batch.column(batch.num_columns - 1))) // PAIRS_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            if stop > start:
                yield batch.slice(start, stop - start)


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _numbers(values: pa.Array) -> np.ndarray:
    """As doubles; NULL is NaN, so that a gate on it fails."""
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _walked_targets(joined: DataFrame, kept: Sequence[str], ends: dict[str, Sequence[str]], fields: Sequence[str], sizes: Sequence[str],
                    cost: PairCost) -> DataFrame:
    """Columns `kept` of `joined`, which begin it, and the cheapest of its `__targets` for each end."""
    item = joined.schema["__targets"].dataType.elementType
    schema = [f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in kept]
    found = ", ".join(f"`{f}`: {item[f].dataType.simpleString()}" for f in fields)
    walk = partial(_cheapest, cost, ends, list(sizes), list(fields), len(kept))
    return joined.mapInArrow(walk, ", ".join([*schema, *(f"`{end}` struct<`cost`: double, {found}>" for end in ends)]))


def cheapest_of_few(points: DataFrame, targets: DataFrame, *, keys: Sequence[str], fields: Sequence[str], ends: dict[str, dict[str, Column]],
                    sizes: Sequence[str], cost: PairCost) -> DataFrame:
    """Add a struct column as `cheapest_in_reach` does for each of `ends`, a name with its measures: of all targets of the keys, few enough for one array.

    `cost` alone says what is out of reach. All ends of a point are priced in one pass behind one join.
    """
    ship_package(points.sparkSession)
    arrays = targets.groupBy(*keys).agg(F.collect_list(F.struct(*dict.fromkeys([*fields, *sizes]))).alias("__targets"))
    measured = points.select("*", *(m.cast("double").alias(f"__m_{end}_{n}") for end, measures in ends.items() for n, m in measures.items()))
    joined = measured.join(arrays, list(keys), "left").select(*measured.columns, "__targets")
    return _walked_targets(joined, points.columns, {end: list(m) for end, m in ends.items()}, fields, sizes, cost)


def cheapest_in_reach(
    points: DataFrame,
    targets: DataFrame,
    *,
    keys: Sequence[str],
    x: Column,
    reach: tuple[Column, Column],
    fields: Sequence[str],
    measures: dict[str, Column],
    sizes: Sequence[str],
    cost: PairCost,
    name: str,
    cell: float = CELL,
    max_partners: int = MAX_PARTNERS,
) -> DataFrame:
    """Add struct column `name` (`cost, *fields`): the cheapest target among those whose x-range holds the point, NULL if there is none.

    `cost` sees the point's `measures` and the target's `sizes` (numbers all); targets of equal cost go by `fields`.
    Targets travel as one short array per (keys, x-cell), so a point meets one row and nothing is aggregated afterwards; the pairs
    of many points are priced at once. The targets of a cell that has more than `max_partners` make several arrays of about that length,
    and a combinable minimum picks the best of them.
    """
    ship_package(points.sparkSession)
    on, carried = [*keys, "__cell"], list(dict.fromkeys([*fields, *sizes]))
    spread = targets.withColumn("__cell", F.explode(cell_range(reach[0], reach[1], cell))).select(*on, *carried)
    spread = cut_lineage(spread)  # made once for the size check and the join
    small, large = split_by_size(spread, on, max_partners)
    located = points.select("*", F.floor(x / cell).alias("__cell"), *(m.cast("double").alias(f"__m_{name}_{n}") for n, m in measures.items()))

    def priced(rows: DataFrame, parts: DataFrame, by: list[str], how: str) -> DataFrame:
        arrays = parts.groupBy(*by).agg(F.collect_list(F.struct(*carried)).alias("__targets"))
        kept = [c for c in rows.columns if c not in by and not c.startswith("__m_")]
        joined = rows.join(arrays, by, how).select(*by, *kept, *(f"__m_{name}_{n}" for n in measures), "__targets")
        return _walked_targets(joined, [*by, *kept], {name: list(measures)}, fields, sizes, cost)

    if large is None:
        return priced(located, small, on, "left").select(*points.columns, name)
    hot_cells = large.groupBy(*on).agg(F.ceil(F.count("*") / max_partners).alias("__parts"))
    parts = large.join(hot_cells, on).withColumn("__part", F.pmod(F.xxhash64(*carried), "__parts"))
    hot = cut_lineage(located.join(hot_cells, on, "left_semi").withColumn("__id", F.monotonically_increasing_id()))
    meets = hot_cells.select(*on, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)).alias("__part"))
    pairs = hot.select("__id", *on, *(f"__m_{name}_{n}" for n in measures)).join(meets, on)
    found = priced(pairs, parts, [*on, "__part"], "inner").groupBy("__id").agg(F.min(name).alias(name))
    cold = priced(located.join(hot_cells, on, "left_anti"), small, on, "left")
    return cold.select(*points.columns, name).unionByName(hot.join(found, "__id", "left").select(*points.columns, name))
