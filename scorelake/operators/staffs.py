"""Staff lookups: nearest staff, the two closest staffs, unit size."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators.greedy_size import split_by_size
from scorelake.operators.spatial import once

MAX_STAVES = 1024


def staff_geometry(staff: DataFrame, *, min_unit: float = 1.0) -> DataFrame:
    """`left_x, right_x, center_y, unit` of each staff from its five line positions `ys`."""
    gaps = (F.element_at("ys", -1) - F.element_at("ys", 1)) / (F.size("ys") - 1)
    center = F.aggregate("ys", F.lit(0.0), lambda a, y: a + y) / F.size("ys")
    return staff.withColumn("center_y", center).withColumn("unit", F.greatest(F.lit(min_unit), gaps))


def _distinct_staves(staff: DataFrame) -> DataFrame:
    return staff.groupBy("page_id", "left_x", "right_x", "center_y", "unit").agg(
        F.min("staff_index").alias("staff_index"))


class StaffLookup(NamedTuple):
    """Staves prepared for lookups: one array per ordinary page, rows of oversized pages (or None)."""

    arrays: DataFrame
    large: DataFrame | None


def staff_lookup(staff: DataFrame | StaffLookup | None, max_staves: int = MAX_STAVES) -> StaffLookup | None:
    if staff is None or isinstance(staff, StaffLookup):
        return staff
    small, large = split_by_size(_distinct_staves(staff), ["page_id"], max_staves)
    arrays = small.groupBy("page_id").agg(F.collect_list(F.struct(
        "left_x", "right_x", "center_y", "unit", "staff_index")).alias("__staves"))
    return StaffLookup(arrays, large)


def locate_on_staff(df: DataFrame, staff: DataFrame | StaffLookup | None, *, x: Column, y: Column,
                    fallback_unit: float = 12.0, max_staves: int = MAX_STAVES) -> DataFrame:
    """Add `staff_index` and `unit` of the nearest staff.

    Staves whose x-range holds the point come first, then the smaller distance to the center, then
    the lower index. The staves of a page travel as one short array, so a point meets one row per
    page; a page with more than `max_staves` distinct staves is joined row by row instead.
    """
    lookup = staff_lookup(staff, max_staves)
    if lookup is None:
        return df.withColumn("staff_index", F.lit(None).cast("long")).withColumn("unit", F.lit(float(fallback_unit)))
    arrays, large = lookup
    points = df.withColumn("__x", x).withColumn("__y", y)

    def rank(field) -> Column:
        outside = ~F.col("__x").between(field("left_x"), field("right_x"))
        return F.struct(outside.alias("outside"), F.abs(F.col("__y") - field("center_y")).alias("d"),
                        field("staff_index").alias("staff_index"), field("unit").alias("unit"))

    out = once(points.join(arrays, "page_id", "left"), "__best",
               F.array_min(F.transform("__staves", lambda st: rank(lambda n: st[n]))))
    out = (out.withColumn("staff_index", F.col("__best.staff_index"))
           .withColumn("unit", F.coalesce(F.col("__best.unit").cast("double"), F.lit(float(fallback_unit))))
           .drop("__staves", "__best", "__x", "__y"))
    if large is None:
        return out
    hot_pages = large.select("page_id").distinct()
    hot = points.join(hot_pages, "page_id", "left_semi").withColumn("__row", F.struct(*df.columns))
    paired = hot.join(large, "page_id").groupBy("page_id", "__row").agg(F.min(rank(F.col)).alias("__best"))
    paired = paired.select("__row.*", F.col("__best.staff_index").alias("staff_index"),
                           F.col("__best.unit").cast("double").alias("unit"))
    return out.join(hot_pages, "page_id", "left_anti").select(paired.columns).unionByName(paired)


def closest_staffs(points: DataFrame, staff: DataFrame, *, point_id: str) -> DataFrame:
    """The closest staff and the neighbour on the side of the point (`first`, `second` structs).

    Distances are Euclidean to staff centers; only the three closest staves are considered, and
    the second is the closest of them on the point's side of the first (the first itself if none).
    `staff` holds `y_upper`, `y_lower`, `x_center`, `center_y`, `unit`.
    """
    cols = ["center_y", "x_center", "y_upper", "y_lower", "unit", "staff_index"]
    distinct = staff.groupBy("page_id", *cols[:-1]).agg(F.min("staff_index").alias("staff_index"))
    arrays = distinct.groupBy("page_id").agg(F.collect_list(F.struct(*cols)).alias("staves"))
    ranked = once(points.join(arrays, "page_id"), "near", F.slice(F.array_sort(F.transform("staves", lambda s: F.struct(
        ((s["x_center"] - F.col("x")) * (s["x_center"] - F.col("x"))
         + (s["center_y"] - F.col("y")) * (s["center_y"] - F.col("y"))).alias("d2"),
        s["staff_index"].alias("staff_index"), s.alias("s")))), 1, 3))
    first = F.col("near")[0]["s"]
    lower_side = F.abs(first["y_lower"] - F.col("y")) <= F.abs(first["y_upper"] - F.col("y"))
    others = F.slice("near", 2, 2)
    on_side = F.filter(others, lambda n: F.when(lower_side, n["s"]["center_y"] > first["center_y"])
                       .otherwise(n["s"]["center_y"] < first["center_y"]))
    second = (F.when(F.size("near") == 2, F.col("near")[1]["s"])
              .otherwise(F.coalesce(F.get(on_side, F.lit(0))["s"], first)))
    return ranked.select("page_id", point_id, "x", "y", first.alias("first"), second.alias("second"))


def unit_size(closest: DataFrame) -> Column:
    """Unit of the staff, or interpolated between two staves for a point outside the first."""
    a, b, y = F.col("first"), F.col("second"), F.col("y")
    d1, d2 = F.abs(y - a["center_y"]), F.abs(y - b["center_y"])
    blended = d1 / (d1 + d2) * a["unit"] + d2 / (d1 + d2) * b["unit"]
    inside = (a["center_y"] == b["center_y"]) | y.between(a["y_upper"], a["y_lower"])
    return F.when(inside, a["unit"].cast("double")).otherwise(blended)


def page_units(staff: DataFrame) -> DataFrame:
    """Mean unit and bar height (its floor) per page."""
    return staff.groupBy("page_id").agg(
        F.avg("unit").alias("global_unit"), F.floor(F.avg("unit")).alias("bar_height"),
        F.count_distinct("track").alias("n_tracks"), F.count("*").alias("n_staves"))


def summarize_zones(parts: DataFrame) -> DataFrame:
    """Staffs from their zone parts: hull in x, median lines, spread of the unit."""
    return parts.groupBy("page_id", "staff_index").agg(
        F.min("x0").alias("left_x"), F.max("x1").alias("right_x"), F.median("y_top").alias("y_top"),
        F.median("y_bottom").alias("y_bottom"), F.median("unit").alias("unit"),
        (F.max("unit") - F.min("unit")).alias("unit_spread")).withColumn(
        "ys", F.transform(F.sequence(F.lit(0), F.lit(4)),
                          lambda i: F.col("y_top") + i * (F.col("y_bottom") - F.col("y_top")) / 4))


def is_aligned(min_diff: Column, bar_height: Column) -> Column:
    return min_diff < bar_height / 3


def infer_tracks(heights: DataFrame, staves: DataFrame, *, factor: int = 10, limit: int = 9) -> DataFrame:
    """Tracks per system from barline heights in units: i + 1 tracks need enough lines above 10 i units.

    `heights(page_id, h_ratio)` are barline heights over the unit (only ratios above 1 count),
    `staves(page_id, n_staves)` the staves per page.
    """
    steps = range(1, limit + 1)
    counts = heights.filter("h_ratio > 1").groupBy("page_id").agg(*(
        F.count(F.when(F.col("h_ratio") > factor * i, 1)).alias(f"c{i}") for i in steps))
    ok = F.array(*(F.coalesce(F.col(f"c{i}"), F.lit(0)) * (i + 1) > F.col("n_staves") for i in steps))
    first_fail = F.array_position(ok, F.lit(False)).cast("int")
    tracks = F.when(first_fail == 0, F.lit(limit + 1)).otherwise(first_fail)
    return staves.join(counts, "page_id", "left").select("page_id", tracks.alias("n_tracks"))
