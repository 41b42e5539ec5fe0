"""Groups of boxes: beams and chunks, size classes, nearby boxes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.boxes import Box, box
from scorelake.operators.attach import prefixed
from scorelake.operators.components import MAX_LINKS, page_components
from scorelake.operators.greedy_size import split_by_size
from scorelake.operators.spatial import collapse_copies, grid_join, once
from scorelake.session import ship_package

# Limits between no beam, one, two, three and more beams, in units.
THICKNESS_UNITS = (0.6, 1.8, 2.7, 3.2)


def note_chunks(groups: DataFrame, beams: DataFrame, *, max_links: int = MAX_LINKS) -> DataFrame:
    """Chunk of every note group that touches a beam: the smallest group id it is connected to.

    A beam is a link between the groups it touches, so a beam over many groups adds one row each, not all pairs.
    """
    # copies of a box touch the same things: one of them stands for all
    reps = collapse_copies(groups, ["page_id"], "ng")
    right, bb = prefixed(collapse_copies(beams, ["page_id"], "beam_id"), "b_")
    touch = grid_join(reps, right, keys=["page_id"], left_region=box(), right_region=bb)
    found = page_components(touch.select("page_id", F.col("ng").alias("member"), F.col("beam_id").alias("link")), max_links=max_links)
    found = found.select("page_id", F.col("member").alias("rep"), F.col("label").alias("chunk"))
    named = reps.withColumnRenamed("ng", "rep").join(found, ["page_id", "rep"])
    return groups.select("page_id", "ng", *box()).join(named, ["page_id", *Box._fields]).select("page_id", "ng", "chunk")


def two_means(sizes: DataFrame, *, key: str = "page_id", value: str = "size") -> DataFrame:
    """Two cluster centers per page, started at the smallest and the largest value, moved until neither moves.

    Values are counted per page first; the counts of a page (bounded by its distinct pixel sizes) are one array and the
    rounds are a fold over it. On a line the border between the two clusters never returns to a place, so that as many rounds as there are
    values are enough; once settled, the rest of the fold passes the centers on.
    """
    counts = sizes.groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    arrays = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("h"))
    start = F.struct(F.col("h")[0]["v"].alias("lo"), F.element_at("h", -1)["v"].alias("hi"), F.lit(False).alias("settled"))

    def mean(rows, fallback):
        total = F.aggregate(rows, F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n")), lambda a, r: F.struct(
            (a["s"] + r["v"] * r["n"]).alias("s"), (a["n"] + r["n"]).alias("n")), lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))
        return F.coalesce(total, fallback)

    def step(c, _):
        low = F.filter("h", lambda r: F.abs(r["v"] - c["lo"]) <= F.abs(r["v"] - c["hi"]))
        high = F.filter("h", lambda r: F.abs(r["v"] - c["lo"]) > F.abs(r["v"] - c["hi"]))
        lo, hi = mean(low, c["lo"]), mean(high, c["hi"])
        return F.when(c["settled"], c).otherwise(F.struct(lo.alias("lo"), hi.alias("hi"), ((lo == c["lo"]) & (hi == c["hi"])).alias("settled")))

    centers = F.aggregate(F.sequence(F.lit(1), F.size("h") + 1), start, step)
    return arrays.select(key, F.explode(F.array(centers)).alias("c")).select(key, F.col("c.lo").alias("low_center"), F.col("c.hi").alias("high_center"))


def mark_ornaments(heads: DataFrame) -> DataFrame:
    """Heads smaller than half the large size of a page whose two sizes differ by more than a factor of two."""
    sized = heads.withColumn("size", box().area)
    centers = two_means(sized)
    small = (F.col("high_center") / F.col("low_center") > 2) & (F.col("size") < F.floor(F.col("high_center") / 2))
    return sized.join(centers, "page_id").withColumn("is_ornament", small).drop("size", "low_center", "high_center")


def ward_labels(points: np.ndarray, limit: float, copies: np.ndarray | None = None) -> np.ndarray:
    """Ward clusters of a few points: merge the closest pair until the distance reaches the limit.

    A point that stands for `copies` of itself is the cluster they make, which merge first at distance 0.
    """
    n = len(points)
    label, size = np.arange(n), np.ones(n) if copies is None else copies.astype(float)
    x, y = points[:, 0], points[:, 1]
    d2 = ((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2) * (2 * size[:, None] * size / (size[:, None] + size))
    np.fill_diagonal(d2, np.inf)
    for _ in range(n - 1):
        i, j = divmod(int(d2.argmin()), n)
        if d2[i, j] >= limit ** 2:
            break
        i, j = min(i, j), max(i, j)
        a, b, c = size[i], size[j], size
        row = ((a + c) * d2[i] + (b + c) * d2[j] - c * d2[i, j]) / (a + b + c)
        row[~np.isfinite(d2[i]) & ~np.isfinite(d2[j])] = np.inf
        row[[i, j]] = np.inf
        row[~np.isfinite(d2[i]) | ~np.isfinite(d2[j])] = np.inf
        d2[i], d2[:, i] = row, row
        d2[j], d2[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == label[j]] = label[i]
    return label


def _clustered(n_keys: int, distance: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union boxes of the clusters of each group. Groups arrive one behind the other, in the order of their centers; one is held until it ends."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        starts = _group_starts(rows, n_keys)
        yield from _unions(rows.slice(0, starts[-1]), starts[:-1], distance)
        held = rows.slice(starts[-1])
    if held is not None:
        yield from _unions(held, np.zeros(1, dtype=np.int64), distance)


def _group_starts(rows: pa.Table, n_keys: int) -> np.ndarray:
    """Where the first `n_keys` columns change; NULL is a key like any other."""
    new = np.zeros(len(rows), dtype=bool)
    new[0] = True
    for i in range(n_keys):
        codes = rows.column(i).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _unions(rows: pa.Table, starts: np.ndarray, distance: float) -> Iterator[pa.RecordBatch]:
    if not len(starts):
        return
    points = np.column_stack([rows["cx"].to_numpy(), rows["cy"].to_numpy()]).astype(float)
    copies, label = rows["n"].to_numpy(), np.zeros(len(rows), dtype=np.int64)
    for a, b in zip(starts, [*starts[1:], len(rows)]):
        label[a:b] = a + ward_labels(points[a:b], distance, copies[a:b])
    order = np.argsort(label, kind="stable")
    cuts = np.flatnonzero(np.diff(label[order], prepend=-1))
    out = {"page_id": rows["page_id"].combine_chunks().take(pa.array(order[cuts]))}
    for name, join in (("x0", np.minimum), ("y0", np.minimum), ("x1", np.maximum), ("y1", np.maximum), ("n", np.add)):
        out[name] = pa.array(join.reduceat(rows[name].to_numpy()[order], cuts), rows[name].type, from_pandas=True)
    yield pa.record_batch(out)


def merge_nearby(boxes: DataFrame, distance: float, *, x_factor: float = 1.0, y_factor: float = 1.0, max_group: int = 1024) -> DataFrame:
    """Union box of every cluster of nearby box centers of a page.

    Copies of a center are one point of their weight; equal distances merge in the order of the centers. Pages with more than `max_group` centers are first cut at
    empty strips wider than the distance, first across and then down, which clusters of near
    centers do not cross.
    """
    ship_package(boxes.sparkSession)
    b = box()
    points = boxes.groupBy("page_id", (b.cx * x_factor).alias("cx"), (b.cy * y_factor).alias("cy")).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("page_id", "x0", "y0", "x1", "y1", "n"))
    def solved(rows: DataFrame, by: list[str]) -> DataFrame:
        rows = rows.repartition(*by).sortWithinPartitions(*by, F.asc_nulls_last("cx"), F.asc_nulls_last("cy"))
        rows = rows.select(*by, "cx", "cy", "x0", "y0", "x1", "y1", "n")
        return rows.mapInArrow(partial(_clustered, len(by), distance), schema)

    small, large = split_by_size(points, ["page_id"], max_group)
    out = solved(small, ["page_id"])
    if large is None:
        return out
    from scorelake.operators.prefix import islands, running

    keys = ["page_id"]
    for axis, name in (("cx", "px"), ("cy", "py")):
        order = [axis, "cx" if axis == "cy" else "cy"]
        large = large.withColumn("seg", F.floor(F.col(axis) / 256))
        large = running(large, keys=keys, segment="seg", order=order, how="max", value=axis, name="before", inclusive=False)
        large = islands(large, keys=keys, segment="seg", order=order,
                        starts=F.col("before").isNull() | (F.col(axis) - F.col("before") > distance), name=name).drop("before")
        keys = [*keys, name]
    return out.unionByName(solved(large, keys))


def chord_flags(heads: DataFrame) -> DataFrame:
    """Per note group: all heads of one type, stem direction by the heads' extremes, any stem."""
    return heads.groupBy("page_id", "ng").agg(
        (F.count_distinct("rhythm") == 1).alias("same_type"), F.bool_or("has_stem").alias("has_stem"),
        (F.sum(F.when(F.col("stem_up"), 1).otherwise(-1)) > 0).alias("stem_up"), F.count("*").alias("n_heads"))


def thickness_classes(beams: DataFrame, *, key: str = "page_id") -> DataFrame:
    """Class of every beam thickness of a page, from 0 (thinnest) up: the split of all thicknesses into k runs with the least squared error.

    `beams(page_id, beam_id, thickness, unit)` with whole numbers; `unit` is one per page. k comes from the counts between fixed multiples of the
    unit: a topmost part with less than one in a hundred beams (five at least) is given up and its thicknesses become its lower limit.
    Thicknesses are counted first, so a page is a short array of distinct pixels with their counts. The best split
    is found for 1, 2, … k runs in turn over prefix sums (dynamic programming); of equal splits the one with the lowest limits is taken.
    """
    counts = beams.groupBy(key, F.col("thickness").cast("long").alias("v")).agg(F.count("*").alias("n"), F.min("unit").alias("unit"))
    pages = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("h"), F.min("unit").alias("unit"), F.sum("n").alias("total"), F.max("v").alias("top"))
    pages = pages.withColumn("limits", F.array(F.lit(1).cast("long"), *(F.floor(F.col("unit") * x) for x in THICKNESS_UNITS)))
    pages = pages.withColumn("used", F.expr("least(size(limits), size(filter(limits, x -> x <= top)) + 1)"))
    filled = """coalesce(array_max(filter(sequence(1, used), j -> greatest(total div 100, 5) <= aggregate(
        filter(h, e -> e.v >= limits[j - 1] AND (j = used OR e.v < limits[j])), 0L, (a, e) -> a + e.n))), 0)"""
    pages = once(pages, "kept", F.expr(filled)).withColumn("clip", F.expr("CASE WHEN kept < used THEN limits[kept] END"))
    rows = pages.select(key, "kept", "clip", F.explode("h").alias("e")).groupBy(key, "kept", "clip", F.least("e.v", "clip").alias("v")).agg(F.sum("e.n").alias("n"))
    rows = rows.groupBy(key, "kept", "clip").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("h"))
    sums = "aggregate(h, array(0L), (a, e) -> array_append(a, element_at(a, -1) + {}))"
    rows = rows.withColumns({"m": F.size("h"), "k": F.least(F.col("kept") + 1, F.size("h"))})
    rows = once(rows, "s", F.struct(*(F.expr(sums.format(of)).alias(name) for name, of in (("ns", "e.n"), ("ss", "e.n * e.v"), ("qs", "e.n * e.v * e.v")))))
    part = "double(s.ss[{b}] - s.ss[{a}])"
    cost = f"(double(s.qs[{{b}}] - s.qs[{{a}}]) - {part} * {part} / double(s.ns[{{b}}] - s.ns[{{a}}]))"  # of the values a + 1 to b
    first = f"array(transform(sequence(1, m), i -> struct({cost.format(a='0', b='i')} AS c, 0 AS t)))"
    best = f"array_min(transform(sequence(j - 1, i - 1), t -> struct(element_at(a, -1)[t - 1].c + {cost.format(a='t', b='i')} AS c, t AS t)))"
    layer = f"transform(sequence(1, m), i -> CASE WHEN i < j THEN struct(double('Infinity') AS c, 0 AS t) ELSE {best} END)"
    rows = once(rows, "layers", F.expr(f"CASE WHEN k = 1 THEN {first} ELSE aggregate(sequence(2, k), {first}, (a, j) -> array_append(a, {layer})) END"))
    rows = once(rows, "borders", F.expr("CASE WHEN k = 1 THEN array(m) ELSE aggregate(sequence(k, 2, -1), array(m), (a, j) -> array_prepend(a, layers[j - 1][a[0] - 1].t)) END"))
    named = rows.select(key, "clip", "borders", F.posexplode("h").alias("at", "e")).select(
        key, F.col("clip").alias("limit"), F.col("e.v").alias("clipped"), F.expr("size(filter(borders, b -> b <= at))").alias("thickness_class"))
    tops = named.select(key, "limit").distinct()
    return (beams.join(tops, key).withColumn("clipped", F.least(F.col("thickness").cast("long"), "limit"))
            .join(named.drop("limit"), [key, "clipped"]).drop("clipped", "limit"))
