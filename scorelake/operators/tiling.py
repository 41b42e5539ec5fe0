"""Overlapping tiles, assignment of boxes to tiles, negative sampling, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.boxes import Box, box, intersection
from scorelake.operators.ranking import hash_rank_key, lowest_n

TILE = 1024
OVERLAP = 256
KEEP_RATIO = 0.6
NEGATIVE_RATIO = 0.25


def starts(length: Column, stride: int) -> Column:
    """0, stride, 2·stride, … below the length; the last tile is padded."""
    return F.sequence(F.lit(0).cast("long"), F.greatest(length.cast("long") - 1, F.lit(0).cast("long")), F.lit(stride).cast("long"))


def shifted_starts(length: Column, size: int, stride: int) -> Column:
    """Like `starts`, but windows beyond the end move back so that all lie inside."""
    last = F.greatest(length.cast("long") - size, F.lit(0).cast("long"))
    return F.array_distinct(F.transform(starts(length, stride), lambda s: F.least(s, last)))


def tile_windows(images: DataFrame, *, tile_size: int = TILE, overlap: int = OVERLAP, shifted: bool = False) -> DataFrame:
    """All tiles of every image (`width`, `height`), with valid region and padding."""
    stride = tile_size - overlap
    make = (lambda c: shifted_starts(c, tile_size, stride)) if shifted else (lambda c: starts(c, stride))
    out = (images.withColumn("tile_y", F.explode(make(F.col("height"))))
           .withColumn("tile_x", F.explode(make(F.col("width")))))
    return out.withColumns(tile_region(tile_size))


def tile_region(tile_size: int) -> dict[str, Column]:
    zero = F.lit(0)
    return {
        "tile_size": F.lit(tile_size),
        "valid_w": F.greatest(zero, F.least(F.lit(tile_size), F.col("width") - F.col("tile_x"))),
        "valid_h": F.greatest(zero, F.least(F.lit(tile_size), F.col("height") - F.col("tile_y"))),
        "pad_right": F.greatest(zero, F.col("tile_x") + tile_size - F.col("width")),
        "pad_bottom": F.greatest(zero, F.col("tile_y") + tile_size - F.col("height")),
    }


def tile_name(filename: Column, image_id: Column, tile_x: Column, tile_y: Column) -> Column:
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    safe = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.format_string("%s__id%s__x%04d_y%04d", safe, image_id.cast("string"), tile_x, tile_y)


def assign_to_tiles(boxes: DataFrame, *, tile_size: int = TILE, overlap: int = OVERLAP,
                    keep_ratio: float = KEEP_RATIO) -> DataFrame:
    """One row per (box, tile) assignment.

    The tiles that can meet a box follow from its coordinates, so the range join is a projection:
    no tile table and no shuffle. `boxes` has the image's `width` and `height`.
    """
    stride = tile_size - overlap
    b = box()

    def candidates(low: Column, high: Column, length: Column) -> Column:
        first = F.greatest(F.lit(0), F.floor((low - tile_size) / stride) + 1)
        last = F.least(F.floor((length - 1) / stride), F.ceil(high / stride) - 1)
        return F.when(last >= first, F.transform(F.sequence(first, last), lambda i: i * stride)).otherwise(
            F.array().cast("array<bigint>"))

    tiles = (boxes.filter(b.is_positive)
             .withColumn("tile_x", F.explode(candidates(b.x0, b.x1, F.col("width"))))
             .withColumn("tile_y", F.explode(candidates(b.y0, b.y1, F.col("height")))))
    tx, ty = F.col("tile_x"), F.col("tile_y")
    window = Box(tx, ty, tx + tile_size, ty + tile_size)
    kept = intersection(b, window)
    center = (b.cx >= window.x0) & (b.cx < window.x1) & (b.cy >= window.y0) & (b.cy < window.y1)
    share = kept.area / b.area
    clipped = F.lit(False)
    for before, after in zip(b, kept):
        clipped = clipped | (F.abs(before - after) > 1e-9)
    reason = (F.when(center & (share >= 1.0 - 1e-12), "center_inside_full_bbox")
              .when(center, "center_inside_clipped_bbox").otherwise("intersection_ratio"))
    return tiles.filter(kept.is_positive & (center | (share >= keep_ratio))).select(
        *boxes.columns, "tile_x", "tile_y", share.alias("intersection_ratio"), center.alias("center_inside"),
        clipped.alias("clipped"), reason.alias("reason"), *kept.columns("clip_"),
        (kept.x0 - tx).alias("tile_x0"), (kept.y0 - ty).alias("tile_y0"),
        (kept.x1 - tx).alias("tile_x1"), (kept.y1 - ty).alias("tile_y1"))


def negative_tiles(tiles: DataFrame, assigned: DataFrame, *, seed: int, ratio: float = NEGATIVE_RATIO,
                   split: str = "split", image: str = "image_id") -> DataFrame:
    """⌊positive tiles · ratio⌋ tiles without boxes per split, chosen by hash rank."""
    key = [split, image, "tile_x", "tile_y"]
    positive = assigned.select(*key).distinct()
    quota = positive.groupBy(split).agg(F.floor(F.count("*") * ratio).alias("quota"))
    empty = tiles.join(positive, key, "left_anti").withColumn("hash", hash_rank_key(*key[1:], seed=seed))
    return lowest_n(empty, keys=[split], hash_col="hash", quota=quota, quota_col="quota")


def assignment_counts(boxes: DataFrame, assigned: DataFrame, *, key: list[str]) -> DataFrame:
    """Boxes with no, one and several assignments, and the number of extra assignments."""
    n = assigned.groupBy(*key).agg(F.count("*").alias("n"))
    return boxes.select(*key).join(n, key, "left").agg(
        F.count(F.when(F.col("n").isNull(), 1)).alias("unassigned"), F.count(F.when(F.col("n") == 1, 1)).alias("once"),
        F.count(F.when(F.col("n") > 1, 1)).alias("duplicated"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("extra_assignments"))


def tile_statistics(tiles: DataFrame, assigned: DataFrame, *, key: list[str]) -> DataFrame:
    """Positive and negative tiles per split, with their ratio."""
    positive = assigned.select(*key).distinct().withColumn("has_box", F.lit(1))
    return tiles.join(positive, key, "left").groupBy("split").agg(
        F.count("*").alias("n_tiles"), F.count("has_box").alias("positive_tiles"),
        (F.count("*") - F.count("has_box")).alias("negative_tiles"))


def tile_members(assigned: DataFrame, *, key: list[str], id_col: str) -> DataFrame:
    """Ordered id lists per tile: all, clipped, unclipped. A tile holds a bounded number of boxes."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"), "clipped")))
    ids = assigned.groupBy(*key).agg(rows.alias("rows"))
    pick = lambda cond: F.transform(F.filter("rows", cond), lambda r: r["id"])
    return ids.select(*key, F.transform("rows", lambda r: r["id"]).alias("annotation_ids"),
                      pick(lambda r: r["clipped"]).alias("clipped_ids"), pick(lambda r: ~r["clipped"]).alias("unclipped_ids"))


def split_sheets(boxes: DataFrame, *, pages_per_sheet: int) -> DataFrame:
    """Boxes of a scanned sheet to the pages printed side by side on it (`sheet_no`, `width`)."""
    step = F.floor(F.col("width") / pages_per_sheet)
    part = F.least(F.floor(box().cx / step), F.lit(pages_per_sheet - 1))
    out = boxes.withColumn("part", part).withColumn("page_no", F.col("sheet_no") * pages_per_sheet + F.col("part"))
    return out.withColumns({"x0": F.col("x0") - F.col("part") * step, "x1": F.col("x1") - F.col("part") * step})


def rotate_270(b: Box, width: Column) -> Box:
    """Box after turning the page by 270° counter-clockwise (90° clockwise)."""
    return Box(b.y0, width - b.x1, b.y1, width - b.x0)
