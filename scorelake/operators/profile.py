"""Row profiles, staff lines, window scores, occupancy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.session import ship_package


def zscores(profile: DataFrame) -> DataFrame:
    """z-score of the row counts of each zone (page_id, zone, y, n), with an empty row added at both ends.

    A zone is bounded by the height of its page, so its sums are a window. A join of the sums would let the planner, which does not see how many rows
    an `explode` makes, send the whole profile through the driver as a broadcast.
    """
    n, zone = F.col("n").cast("long"), W.partitionBy("page_id", "zone")
    sums = profile.filter("page_id IS NOT NULL AND zone IS NOT NULL").withColumns({
        "rows": F.count("*").over(zone) + 2, "s": F.sum(n).over(zone), "ss": F.sum(n * n).over(zone)})
    mean = F.col("s") / F.col("rows")
    std = F.sqrt(F.col("rows") * F.col("ss") - F.col("s") * F.col("s")) / F.col("rows")
    return sums.withColumn("z", F.when(std > 0, (F.col("n") - mean) / std).otherwise(0.0)).drop("rows", "s", "ss")


def find_line_peaks(z: np.ndarray, height: float, distance: int, prominence: float) -> list[int]:
    """Local maxima (middle of a plateau) of enough height, spacing (higher first) and prominence."""
    z = np.concatenate([[z.min() - 1.0], z, [z.min() - 1.0]])
    change = np.flatnonzero(np.diff(z)) + 1
    starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(z)]]) - 1
    level = z[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    peaks = (starts[top] + ends[top]) // 2
    peaks = peaks[z[peaks] >= height]
    kept: list[int] = []
    for p in sorted(peaks, key=lambda p: (-z[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        higher = np.flatnonzero(z > z[p])
        left, right = higher[higher < p], higher[higher > p]
        low = z[(left[-1] if len(left) else 1):p + 1].min()
        high = z[p:(right[0] + 1 if len(right) else len(z) - 1)].min()
        if z[p] - max(low, high) >= prominence:
            out.append(int(p) - 1)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _peaks(z: pd.Series, height: pd.Series, distance: pd.Series) -> pd.Series:
    return pd.Series([find_line_peaks(np.asarray(a, dtype=float), h, int(d), 1.0) for a, h, d in zip(z, height, distance)], dtype=object)


def staff_line_peaks(profile: DataFrame, *, threshold: float = 0.8, min_distance: int = 8, max_gap_ratio: float = 1.5) -> DataFrame:
    """Staff lines of each zone: peaks of the z-score, grouped in staffs, labelled 1 to 5.

    A zone has one row per pixel row, so its profile is a bounded array. Peaks over 15 are dropped
    from the lines but keep their place in the group; groups end where the gap is wider than 1.5
    usual gaps. Groups below five lines are dropped, of longer groups the stronger five at the head
    or the tail stay.
    """
    ship_package(profile.sparkSession)
    z = zscores(profile).groupBy("page_id", "zone").agg(F.array_sort(F.collect_list(F.struct("y", "z"))).alias("p"))
    found = z.withColumn("at", _peaks(F.transform("p", lambda r: r["z"]), F.lit(threshold), F.lit(min_distance)))
    peaks = found.select("page_id", "zone", F.posexplode(F.transform("at", lambda i: F.get(F.col("p"), i))).alias("i", "r")).select(
        "page_id", "zone", "i", "r.y", "r.z")
    zone = W.partitionBy("page_id", "zone").orderBy("y")
    peaks = peaks.withColumn("gap", F.col("y") - F.lag("y").over(zone))
    whole = W.partitionBy("page_id", "zone")
    gaps = peaks.withColumns({"gaps": F.array_sort(F.collect_list("gap").over(whole)), "n_peaks": F.count("*").over(whole)})
    n = F.greatest(F.lit(5), F.rint(F.col("n_peaks") * 0.2).cast("int"))
    usual = F.slice("gaps", F.lit(1), n)
    gaps = gaps.withColumn("unit", F.aggregate(usual, F.lit(0.0), lambda a, g: a + g) / F.nullif(F.size(usual), F.lit(0))).drop("gaps", "n_peaks")
    grouped = gaps.withColumn(
        "grp", F.sum(F.when(F.col("gap") > F.col("unit") * max_gap_ratio, 1).otherwise(0)).over(zone))
    staff = W.partitionBy("page_id", "zone", "grp")
    ranked = grouped.withColumn("k", F.row_number().over(staff.orderBy("y"))).withColumn("size", F.count("*").over(staff))
    head = F.sum(F.when(F.col("k") <= 5, F.col("z"))).over(staff)
    tail = F.sum(F.when(F.col("k") > F.col("size") - 5, F.col("z"))).over(staff)
    ranked = ranked.withColumn("first", F.when(head > tail, 1).otherwise(F.col("size") - 4)).filter("size >= 5")
    lines = ranked.filter(F.col("k").between(F.col("first"), F.col("first") + 4) & (F.col("z") <= 15))
    return lines.select("page_id", "zone", "grp", (F.col("k") - F.col("first") + 1).alias("line_no"), "y", "z", "unit")


def fill_zones(parts: DataFrame, originals: DataFrame, *, max_dist_units: float = 3) -> DataFrame:
    """Complete the grid of zone parts of each staff.

    `parts(page_id, staff_row, zone, x_center, y_center, unit)` holds the zones that found all staves,
    `originals(page_id, zone, x_center, y_center, unit)` what the other zones found. A missing cell takes
    the original within three units of the nearest known zone, otherwise a point on the line
    through the two nearest zones (or the nearest one).
    """
    known = parts.groupBy("page_id", "staff_row").agg(F.collect_list(F.struct("zone", "x_center", "y_center", "unit")).alias("known"))
    point = F.when(F.col("zone").isNotNull(), F.struct("y_center", "x_center", "unit"))
    points = originals.select("page_id", "zone", point.alias("o"))
    zones = points.unionByName(parts.select("page_id", "zone"), allowMissingColumns=True).groupBy("page_id", "zone").agg(F.array_sort(F.collect_list("o")).alias("found"))
    # the planner does not see how many rows an `explode` made and would send the grid through the driver
    grid = zones.hint("merge").join(known, "page_id").filter(~F.coalesce(F.exists("known", lambda k: k["zone"] == F.col("zone")), F.lit(False)))
    near = F.array_sort(F.transform("known", lambda k: F.struct(F.abs(k["zone"] - F.col("zone")).alias("d"), k["zone"].alias("zone"), k.alias("k"))))
    grid = grid.select("*", F.explode(F.array(near)).alias("near"))
    a, b = F.col("near")[0]["k"], F.get("near", F.lit(1))["k"]
    original = F.get(F.filter("found", lambda f: F.abs(f["y_center"] - a["y_center"]) < a["unit"] * max_dist_units), F.lit(0))
    share = (F.col("zone") - a["zone"]) / (b["zone"] - a["zone"])
    along = lambda field: F.coalesce(a[field] + (b[field] - a[field]) * share, a[field])
    filled = grid.select("page_id", "staff_row", "zone", F.coalesce(original["x_center"], along("x_center")).cast("double").alias("x_center"),
                         F.coalesce(original["y_center"], along("y_center")).cast("double").alias("y_center"),
                         F.coalesce(original["unit"], a["unit"]).cast("double").alias("unit"), original.isNull().alias("is_interpolated"))
    same = parts.select("page_id", "staff_row", "zone", *(F.col(c).cast("double").alias(c) for c in ("x_center", "y_center", "unit")),
                        F.lit(False).alias("is_interpolated"))
    return same.unionByName(filled)


def average_windows(scores: DataFrame) -> DataFrame:
    """Mean score per cell and channel over overlapping windows, and the best channel (lowest on ties)."""
    means = scores.groupBy("page_id", "y", "x", "channel").agg(F.avg("score").alias("score"))
    return means.groupBy("page_id", "y", "x").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("channel").alias("c"))).alias("b")).select(
        "page_id", "y", "x", F.col("b.c").alias("channel"), (-F.col("b.s")).alias("score"))


def threshold_windows(scores: DataFrame, thresholds: dict[int, float]) -> DataFrame:
    """Cells whose mean score passes the limit of their channel."""
    limit = F.lit(None).cast("double")
    for channel, value in thresholds.items():
        limit = F.when(F.col("channel") == channel, value).otherwise(limit)
    return scores.groupBy("page_id", "y", "x", "channel").agg(F.avg("score").alias("score")).filter(F.col("score") >= limit)


def occupied_windows(columns: DataFrame, *, keys: list[str], width: Column | int, threshold: float = 0.5) -> DataFrame:
    """Boxes of columns where the mean occupancy of the next `width` columns passes the threshold.

    `columns(keys, x, occupancy)`, one row per pixel column, so windows are bounded by the page.
    """
    ahead = W.partitionBy(*keys).orderBy("x").rangeBetween(0, width - 1)
    hits = columns.withColumn("mean", F.sum("occupancy").over(ahead) / width).filter(F.col("mean") > threshold)
    by_x = W.partitionBy(*keys).orderBy("x")
    runs = hits.withColumn("s", F.when(F.col("x") == F.lag("x").over(by_x) + 1, 0).otherwise(1)).withColumn("run", F.sum("s").over(by_x))
    return runs.groupBy(*keys, "run").agg(F.min("x").alias("x0"), (F.max("x") + width).alias("x1")).drop("run")


def best_range(columns: DataFrame, *, keys: list[str], length: int) -> DataFrame:
    """Start of the window of `length` columns with the largest sum, the first on ties."""
    ahead = W.partitionBy(*keys).orderBy("x").rowsBetween(0, length - 1)
    sums = columns.withColumn("total", F.sum("value").over(ahead)).withColumn("n", F.count("*").over(ahead)).filter(F.col("n") == length)
    return sums.groupBy(*keys).agg(F.min(F.struct((-F.col("total")).alias("t"), F.col("x").alias("x"))).alias("b")).select(
        *keys, F.col("b.x").alias("x"), (-F.col("b.t")).alias("total"))
