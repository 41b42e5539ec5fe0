"""From tile detections to page candidates: merging, class mapping, thresholds, dynamic letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.boxes import Box, box
from scorelake.functions.vocabulary import CLASS_CONFIDENCE, DYNAMIC_LETTER_PREFIX
from scorelake.operators.greedy import MAX_GROUP, covered_conflict, iou_conflict, suppress
from scorelake.operators.preconditions import require_columns, require_known, require_unique

CLASS_MAP_LIMIT = 10_000


def in_valid_region(df: DataFrame, tile_w: Column, tile_h: Column) -> DataFrame:
    """Detections whose center lies in the unpadded part of their tile."""
    b = box()
    return df.filter((b.cx < tile_w) & (b.cy < tile_h))


def assign_keepers(det: DataFrame, *, iou_threshold: float = 0.5, max_group: int = MAX_GROUP) -> DataFrame:
    """Class-aware suppression: every detection with the `det_seq` of the kept box that absorbs it."""
    out = suppress(det, keys=["page_id", "class_id"], priority=[-F.col("confidence"), F.col("det_seq")],
                   conflict=iou_conflict(iou_threshold), max_group=max_group)
    return out.withColumn("keeper_seq", F.col("keeper.p1")).drop("prio", "keeper")


def nms(det: DataFrame, *, iou_threshold: float = 0.5, max_group: int = MAX_GROUP) -> DataFrame:
    """The kept detections (page_id, det_seq, class_id, box, confidence and further columns)."""
    return assign_keepers(det, iou_threshold=iou_threshold, max_group=max_group).filter(
        F.col("keeper_seq") == F.col("det_seq")).drop("keeper_seq")


def nms_with_sources(det: DataFrame, *, iou_threshold: float = 0.5, max_group: int = MAX_GROUP) -> DataFrame:
    """Kept detections with the number and best-first rank of the sources each one absorbed."""
    assigned = assign_keepers(det, iou_threshold=iou_threshold, max_group=max_group)
    return assigned.groupBy("page_id", "class_id", F.col("keeper_seq").alias("det_seq")).agg(
        F.count("*").alias("n_sources"), F.max("confidence").alias("confidence"),
        F.min("confidence").alias("lowest_confidence"), F.sum("det_seq").alias("source_checksum"))


def merge_counts(det: DataFrame, *, iou_threshold: float = 0.5) -> DataFrame:
    """Raw, kept and suppressed detections per page."""
    assigned = assign_keepers(det, iou_threshold=iou_threshold)
    kept = F.count(F.when(F.col("keeper_seq") == F.col("det_seq"), 1))
    return assigned.groupBy("page_id").agg(
        F.count("*").alias("raw_prediction_count"), kept.alias("prediction_count"),
        (F.count("*") - kept).alias("suppressed_prediction_count"))


def drop_covered(boxes: DataFrame, *, id_col: str, ratio: float = 0.5, merge: bool = False,
                 max_group: int = MAX_GROUP) -> DataFrame:
    """Biggest box first; drop a box covered beyond `ratio` by a kept one, or merge it into that one."""
    out = suppress(boxes, keys=["page_id"], priority=[-box().area, F.col(id_col)], conflict=covered_conflict(ratio),
                   max_group=max_group)
    out = out.withColumn("keeper_id", F.col("keeper.p1"))
    if not merge:
        return out.filter(F.col("keeper_id") == F.col(id_col)).drop("prio", "keeper", "keeper_id")
    return out.groupBy("page_id", F.col("keeper_id").alias(id_col)).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.count("*").alias("n_merged"))


def small_dimension(df: DataFrame, limit: int = CLASS_MAP_LIMIT) -> DataFrame:
    """Broadcast a dimension only after counting it; a larger one is joined by shuffle."""
    return F.broadcast(df) if len(df.limit(limit + 1).select(F.lit(1)).take(limit + 1)) <= limit else df


def map_classes(det: DataFrame, class_map: DataFrame) -> DataFrame:
    """Attach semantic class and side. Detections with an unknown class get a NULL `class_name`."""
    dim = small_dimension(class_map.select("class_id", "class_name", "side"))
    return det.join(dim, "class_id", "left")


def export_candidates(det: DataFrame, class_map: DataFrame) -> DataFrame:
    """Candidates of merged detections: class, side and box with an open association. An unknown class stops the job and is named.

    `class_map(class_id, class_name, side)` must have each class once.
    """
    names = small_dimension(require_unique(class_map.select("class_id", "class_name", "side"), "class_id"))
    named = require_known(require_columns(det, "page_id", "class_id", *Box._fields), names, "class_id", "class")
    return named.withColumns({"matched_ng": F.lit(None).cast("long"), "association_score": F.lit(None).cast("double"), "association_status": F.lit("unmatched")})


def unknown_classes(det: DataFrame, class_map: DataFrame) -> DataFrame:
    """Class ids that the map lacks, with their number of detections; empty for valid input."""
    return det.groupBy("class_id").count().join(class_map, "class_id", "left_anti")


def threshold_expression(overrides: dict[str, float] | None = None, default: float = 0.25) -> Column:
    """Confidence limit of `class_name`: the user's value, the class default, or the general one."""
    limits = {**CLASS_CONFIDENCE, **(overrides or {})}
    expr = F.lit(default)
    table = F.create_map(*(F.lit(v) for pair in limits.items() for v in pair))
    return F.coalesce(F.try_element_at(table, F.col("class_name")), expr)


def apply_thresholds(candidates: DataFrame, overrides: dict[str, float] | None = None,
                     default: float = 0.25) -> DataFrame:
    return candidates.filter(F.col("confidence") >= threshold_expression(overrides, default))


def is_dynamic_letter() -> Column:
    return F.col("class_name").startswith(DYNAMIC_LETTER_PREFIX)
