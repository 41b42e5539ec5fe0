"""Barlines, bars, elements in bars, numbering, time signatures, bar totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.functions.boxes import box
from scorelake.functions.vocabulary import WHOLE_TICKS
from scorelake.operators.prefix import carry_last, running


def barline_columns(profile: DataFrame, threshold: float) -> DataFrame:
    """Pixel columns whose share of ink in the staff height exceeds the threshold."""
    return profile.filter(F.col("ink") / F.col("staff_height") > threshold)


def bar_ranges(columns: DataFrame, *, unit: str = "unit") -> DataFrame:
    """Bars of each system from barline columns (page_id, system_no, track, x relative to the staff).

    A column counts when more than one track has it. Runs of neighbouring columns collapse to their
    first; two points wider apart than a unit enclose a bar. Columns are counted per x first, so the
    window of a system is bounded by the page width.
    """
    system = ["page_id", "system_no"]
    shared = columns.groupBy(*system, "x", unit).agg(F.count_distinct("track").alias("n")).filter("n > 1")
    by_x = W.partitionBy(*system).orderBy("x")
    points = shared.withColumn("prev", F.lag("x").over(by_x)).filter("prev IS NULL OR x <> prev + 1")
    ranges = points.withColumn("start", F.coalesce(F.lag("x").over(by_x), F.lit(0).cast("long")))
    ranges = ranges.filter(F.col("x") > F.col("start") + F.col(unit))
    return ranges.select(*system, F.col("start"), F.col("x").alias("stop"),
                         (F.row_number().over(by_x) - 1).cast("long").alias("bar_in_line"))


def elements_in_bars(elements: DataFrame, bars: DataFrame) -> DataFrame:
    """Elements with the bar whose range holds their left edge; bars of a system do not overlap."""
    b = bars.select("page_id", "system_no", "start", "stop", "bar_in_line")
    on = ((elements.page_id == b.page_id) & (elements.system_no == b.system_no)
          & (elements.x0 >= b.start) & (elements.x0 < b.stop))
    return elements.join(b, on).select(*(elements[c] for c in elements.columns), b.bar_in_line, b.start, b.stop)


def sweep(elements: DataFrame, *, keys: list[str]) -> DataFrame:
    """Left-to-right sweep of each bar: take an element, skip all that start before its right edge.

    At equal x the priority is note, rest, clef, accidental (`priority` ascending). Only the first
    element of every x can be taken, so one per x is kept before the fold and a bar holds at most as
    many rows as pixels.
    """
    row = F.struct("x0", "priority", "elem_seq", "x1")
    firsts = elements.groupBy(*keys, "x0").agg(F.min(row).alias("e"))
    bars = firsts.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("rows"))

    def step(done: Column, e: Column) -> Column:
        return F.when((F.size(done) == 0) | (e["x0"] > F.element_at(done, -1)["x1"]), F.array_append(done, e)).otherwise(done)

    taken = F.aggregate("rows", F.filter("rows", lambda _: F.lit(False)), step)
    return bars.select(*keys, F.posexplode(taken).alias("position", "e")).select(
        *keys, F.col("position").cast("long").alias("position"), "e.elem_seq", "e.x0", "e.x1", "e.priority")


def number_bars(lines: DataFrame) -> DataFrame:
    """First bar number of every line of a piece from `n_bars` per (piece, page_id, system_no)."""
    lines = lines.withColumn("line", F.struct("page_id", "system_no"))
    out = running(lines, keys=["piece"], segment="page_id", order=["line"], how="sum", value="n_bars", name="upto")
    return out.withColumn("first_bar", F.col("upto") - F.col("n_bars")).drop("line", "upto")


def time_signatures(bars: DataFrame, changes: DataFrame) -> DataFrame:
    """As-of join: the last change at or before (page, bar) of each piece.

    `bars(piece, page_id, bar_no)`, `changes(piece, page_id, bar_no, ts_num, ts_den)`.
    """
    ts = F.struct("ts_num", "ts_den")
    events = changes.select("piece", "page_id", "bar_no", F.lit(0).alias("kind"), ts.alias("ts")).unionByName(
        bars.select("piece", "page_id", "bar_no", F.lit(1).alias("kind"), F.lit(None).cast("struct<ts_num:bigint,ts_den:bigint>").alias("ts")))
    filled = carry_last(events, keys=["piece"], segment="page_id", order=["page_id", "bar_no", "kind"], columns=["ts"])
    return filled.filter("kind = 1").select("piece", "page_id", "bar_no", "ts_filled.ts_num", "ts_filled.ts_den")


def repeated_changes(changes: DataFrame) -> DataFrame:
    """Two changes at the same bar, which a piece config must not have."""
    return changes.groupBy("piece", "page_id", "bar_no").count().filter("count > 1")


def bar_totals(elements: DataFrame, *, keys: list[str]) -> DataFrame:
    """Total ticks, target and difference of each bar (`ticks`, `ts_num`, `ts_den`)."""
    target = F.floor(F.lit(WHOLE_TICKS) * F.col("ts_num") / F.col("ts_den"))
    return elements.groupBy(*keys, "ts_num", "ts_den").agg(
        F.sum("ticks").alias("total_ticks"), F.count("*").alias("n_elements")).withColumn("target_ticks", target)


def bar_audit(elements: DataFrame, *, keys: list[str]) -> DataFrame:
    """Bars whose total differs from the target, with their lengths in order."""
    listed = elements.groupBy(*keys, "ts_num", "ts_den").agg(
        F.sum("ticks").alias("total_ticks"), F.array_sort(F.collect_list(F.struct("elem_seq", "ticks"))).alias("elements"))
    target = F.floor(F.lit(WHOLE_TICKS) * F.col("ts_num") / F.col("ts_den"))
    return listed.withColumn("target_ticks", target).filter("total_ticks <> target_ticks")


def drop_empty_bars(bars: DataFrame, elements: DataFrame) -> DataFrame:
    """Drop bars that no track fills and renumber the rest of each piece."""
    used = elements.select("piece", "bar_no").distinct()
    per_piece = bars.select("piece", "bar_no").distinct().join(used, ["piece", "bar_no"], "left_semi")
    numbered = running(per_piece.withColumn("seg", F.floor(F.col("bar_no") / 1024)), keys=["piece"], segment="seg",
                       order=["bar_no"], how="sum", value=F.lit(1).cast("long"), name="upto")
    return bars.join(numbered.select("piece", "bar_no", (F.col("upto") - 1).alias("new_bar_no")), ["piece", "bar_no"])


def note_group_lengths(heads: DataFrame) -> DataFrame:
    """Chord length = shortest head, hull box, and whether only ornaments are left."""
    return heads.groupBy("page_id", "ng").agg(
        F.least(F.min("ticks"), F.lit(WHOLE_TICKS)).alias("ticks"), F.min("x0").alias("x0"), F.min("y0").alias("y0"),
        F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count_distinct("rhythm").alias("n_rhythms"),
        F.min("is_ornament").alias("only_ornaments"), F.count("*").alias("n_heads"))


def change_only(df: DataFrame, *, keys: list[str], segment: str, order: list[str], columns: list[str]) -> DataFrame:
    """Flag rows where a value differs from the row before (the first row always counts)."""
    out = carry_last(df, keys=keys, segment=segment, order=order, columns=columns, suffix="_before", inclusive=False)
    for c in columns:
        out = out.withColumn(f"emit_{c}", F.col(f"{c}_before").isNull() | (F.col(f"{c}_before") != F.col(c)))
    return out.drop(*(f"{c}_before" for c in columns))


def neighbour_clamped_boxes(staff: DataFrame) -> DataFrame:
    """Crop of each staff, from the middle to the staff above to the middle to the staff below."""
    near = W.partitionBy("page_id", "system_no").orderBy("staff_index")
    above, below = F.lag("y_bottom").over(near), F.lead("y_top").over(near)
    return staff.withColumn("crop_top", F.coalesce(F.floor((above + F.col("y_top")) / 2), F.greatest(F.lit(0), F.col("y_top") - 4 * F.col("unit")))).withColumn(
        "crop_bottom", F.coalesce(F.floor((F.col("y_bottom") + below) / 2), F.col("y_bottom") + 4 * F.col("unit")))


def remove_boxes_at(boxes: DataFrame, columns: DataFrame) -> DataFrame:
    """Boxes that hold no barline center, by blocks of 256 pixels."""
    lines = columns.select("page_id", F.col("x").alias("line_x"), F.floor(F.col("x") / 256).alias("block")).distinct()
    b = box()
    spread = boxes.withColumn("block", F.explode(F.sequence(F.floor(b.x0 / 256), F.floor(b.x1 / 256))))
    hit = spread.join(lines, ["page_id", "block"]).filter(F.col("line_x").between(F.col("x0"), F.col("x1") - 1))
    return boxes.join(hit.select(*boxes.columns).distinct(), boxes.columns, "left_anti")
