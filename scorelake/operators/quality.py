"""Data-quality rules. Every rule yields rows (code, split, context, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.functions.boxes import Box, clip, expand_min_height, from_array, intersection, is_finite, values_close
from scorelake.operators.tiling import tile_region

TOLERANCE = 1e-7
ISSUE = "code string, split string, context string, detail string"


def issue(df: DataFrame, code: str | Column, context: Column, detail: Column | None = None, split: str = "split") -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    return df.select(code.alias("code"), F.col(split).cast("string").alias("split"), context.cast("string").alias("context"),
                     (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def flagged(df: DataFrame, rules: dict[str, Column], context: Column, detail: Column | None = None) -> DataFrame:
    """All rules of one table in one pass: an array of the codes that apply, exploded."""
    codes = F.array_compact(F.array(*(F.when(cond, F.lit(code)) for code, cond in rules.items())))
    return issue(df.withColumn("__code", F.explode(codes)), F.col("__code"), context, detail)


def parse_labels(lines: DataFrame) -> DataFrame:
    """Fields of label lines (split, file, line_no, text)."""
    fields = F.split(F.trim("text"), r"\s+")
    number = F.transform(F.slice("fields", F.lit(2), F.lit(4)), lambda v: v.try_cast("double"))
    return (lines.withColumn("fields", F.when(F.trim("text") != "", fields))
            .withColumn("class_id", F.get("fields", F.lit(0)).try_cast("int"))
            .withColumn("values", F.when(F.size("fields") == 5, number)))


def label_issues(lines: DataFrame, *, class_count: int) -> DataFrame:
    """Rules on label text. A blank, short or unreadable line stops there; other rules add up."""
    p = parse_labels(lines)
    blank, count = F.col("fields").isNull(), F.size("fields") != 5
    parse = F.col("class_id").isNull() | F.exists("values", lambda v: v.isNull())
    readable = ~blank & ~count & ~parse
    finite = readable & F.forall("values", is_finite)
    v = [F.get("values", F.lit(i)) for i in range(4)]
    low, high = -TOLERANCE, 1.0 + TOLERANCE
    outside = F.lit(False)
    for centre, size in ((v[0], v[2]), (v[1], v[3])):
        outside = outside | (centre - size / 2 < low) | (centre + size / 2 > high)
    rules = {
        "blank_label_line": blank,
        "label_field_count": ~blank & count,
        "label_parse_error": ~blank & ~count & parse,
        "class_id_out_of_range": readable & ~F.col("class_id").between(0, class_count - 1),
        "non_finite_label_value": readable & ~F.forall("values", is_finite),
        "normalized_value_out_of_range": finite & F.exists("values", lambda x: (x < 0) | (x > 1)),
        "non_positive_label_size": finite & ((v[2] <= 0) | (v[3] <= 0)),
        "label_bbox_outside_tile": finite & outside,
    }
    return flagged(p, rules, F.concat_ws(":", "file", "line_no"), F.col("text"))


def descriptor_issues(names: DataFrame, class_map: DataFrame) -> DataFrame:
    """Class names of the descriptor (`class_id, name`) against the class map."""
    joined = names.join(class_map.select("class_id", F.col("class_name").alias("wanted")), "class_id", "full_outer")
    return issue(joined.filter(~F.col("name").eqNullSafe(F.col("wanted"))).withColumn("split", F.lit("")), "dataset_yaml_names_mismatch",
                 F.col("class_id"))


def source_issues(images: DataFrame, annotations: DataFrame, targets: DataFrame, *, known: DataFrame | None = None) -> DataFrame:
    """Images (split, image_id, filename, ann_ids), annotations (split, ann_id, image_id, cat_ids), target categories (category_id).

    Annotations of images outside of `known` (split, image_id; by default all images) have an unknown image.
    """
    known = images if known is None else known
    names = images.groupBy("split", "filename").count().filter("count > 1")
    duplicate = issue(names, "duplicate_source_filename", F.col("filename"))
    listed = images.select("split", "image_id", F.explode("ann_ids").alias("ann_id")).distinct()
    target = annotations.select("*", F.explode_outer("cat_ids").alias("category_id")).join(targets, "category_id", "left_semi")
    per_annotation = target.groupBy("split", "ann_id", "image_id").agg(F.count_distinct("category_id").alias("n_classes"))
    several = issue(per_annotation.filter("n_classes > 1"), "source_multiple_target_classes", F.col("ann_id"), F.col("n_classes"))
    unknown = issue(per_annotation.join(known.select("split", "image_id"), ["split", "image_id"], "left_anti"),
                    "source_annotation_unknown_image", F.col("ann_id"), F.col("image_id"))
    unlisted = issue(per_annotation.join(listed, ["split", "image_id", "ann_id"], "left_anti"),
                     "source_annotation_missing_from_image", F.col("ann_id"), F.col("image_id"))
    return duplicate.unionByName(several).unionByName(unknown).unionByName(unlisted)


def reference_issues(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Listed annotation ids that do not exist, or that belong to another image."""
    listed = images.select("split", "image_id", F.explode("ann_ids").alias("ann_id"))
    joined = listed.join(annotations.select("split", "ann_id", F.col("image_id").alias("own_image")), ["split", "ann_id"], "left")
    return flagged(joined, {"missing_annotation_reference": F.col("own_image").isNull(),
                            "annotation_image_id_mismatch": F.col("own_image") != F.col("image_id")}, F.col("ann_id"), F.col("image_id"))


def box_issues(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Source boxes (`a_bbox` array) that are unusable or outside of their image."""
    joined = annotations.join(images.select("split", "image_id", "width", "height"), ["split", "image_id"])
    b = from_array(F.col("a_bbox"))
    valid = (F.size("a_bbox") == 4) & F.forall("a_bbox", is_finite)
    inside = intersection(b, Box(F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height")))
    return flagged(joined, {
        "dropped_invalid_bbox": F.col("a_bbox").isNull() | ~valid, "dropped_non_positive_bbox": valid & ~b.is_positive,
        "dropped_outside_image_bbox": valid & b.is_positive & ~inside.is_positive,
        "source_bbox_clipped_to_image": valid & b.is_positive & inside.is_positive & clip(b, F.col("width"), F.col("height"))[1],
    }, F.col("ann_id"))


def manifest_issues(tiles: DataFrame, images: DataFrame, labels: DataFrame, *, tile_size: int, stride: int) -> DataFrame:
    """Tile records against their image and their labels.

    `tiles`: split, declared_split, tile_name, image_id, filename, tile_x, tile_y, tile_size, width, height,
    valid_w, valid_h, pad_right, pad_bottom, is_negative, annotation_ids, clipped_ids, unclipped_ids, record_ids.
    `images`: split, image_id, filename, width, height. `labels`: split, tile_name, n_labels.
    """
    context = F.col("tile_name")
    copies = tiles.groupBy("split", "tile_name").count().filter("count > 1")
    duplicate = issue(copies, "duplicate_manifest_tile", context)
    known = images.select("split", "image_id", F.col("filename").alias("s_name"), F.col("width").alias("s_w"), F.col("height").alias("s_h"))
    work = tiles.join(known, ["split", "image_id"], "left").join(labels, ["split", "tile_name"], "left")
    want = {k: v for k, v in tile_region(tile_size).items()}
    n = F.coalesce("n_labels", F.lit(0))
    rules = {
        "manifest_split_mismatch": F.col("declared_split") != F.col("split"),
        "tile_offset_out_of_range": (F.col("tile_x") < 0) | (F.col("tile_y") < 0) | (F.col("tile_x") >= F.col("width")) | (F.col("tile_y") >= F.col("height")),
        "tile_offset_not_on_stride": (F.col("tile_x") % stride != 0) | (F.col("tile_y") % stride != 0),
        "tile_size_mismatch": F.col("tile_size") != tile_size,
        "valid_source_region_mismatch": (F.col("valid_w") != want["valid_w"]) | (F.col("valid_h") != want["valid_h"]),
        "padding_metadata_mismatch": (F.col("pad_right") != want["pad_right"]) | (F.col("pad_bottom") != want["pad_bottom"]),
        "manifest_unknown_source_image_id": F.col("s_name").isNull(),
        "manifest_source_image_metadata_mismatch": (F.col("s_name") != F.col("filename")) | (F.col("s_w") != F.col("width")) | (F.col("s_h") != F.col("height")),
        "manifest_annotation_id_order_mismatch": F.col("annotation_ids") != F.col("record_ids"),
        "manifest_clipped_partition_mismatch": F.array_sort(F.concat("clipped_ids", "unclipped_ids")) != F.array_sort("annotation_ids"),
        "empty_label_negative_mismatch": F.col("is_negative") != (n == 0),
        "manifest_label_count_mismatch": n != F.size("record_ids"),
    }
    return duplicate.unionByName(flagged(work, rules, context))


def trace_issues(records: DataFrame, annotations: DataFrame, class_map: DataFrame) -> DataFrame:
    """Manifest annotations against source and label: `records` has split, tile_name, image_id, ann_id,
    category_id, original_box, yolo_values, label_class, label_values."""
    source = annotations.select("split", "ann_id", F.col("image_id").alias("own_image"), "cat_ids", "a_bbox")
    mapped = class_map.select("category_id", F.col("class_id").alias("mapped_class"))
    work = records.join(source, ["split", "ann_id"], "left").join(mapped, "category_id", "left")
    known = F.col("own_image").isNotNull()
    close = lambda a, b, tol: F.coalesce(values_close(F.col(a), F.col(b), tol), F.lit(False))
    return flagged(work, {
        "untraceable_annotation_id": ~known,
        "annotation_source_image_mismatch": known & (F.col("own_image") != F.col("image_id")),
        "source_bbox_trace_mismatch": known & ~close("a_bbox", "original_box", TOLERANCE),
        "source_class_trace_mismatch": known & ~F.array_contains("cat_ids", F.col("category_id")),
        "class_mapping_mismatch": known & ~F.col("mapped_class").eqNullSafe(F.col("label_class")),
        "manifest_label_value_mismatch": known & ~close("yolo_values", "label_values", 1e-7),
    }, F.concat_ws(":", "tile_name", "ann_id"))


def geometry_issues(records: DataFrame, *, tile_size: int, keep_ratio: float, min_height: float = 0.0) -> DataFrame:
    """Recompute the boxes of an assignment and compare with the stored ones.

    `records`: split, tile_name, ann_id, original_box, source_box, training_box, retained_box, tile_box (arrays of 4),
    is_thin_class, adjusted, ratio, center_inside, clipped, tile_x, tile_y, width, height.
    """
    sizes = F.lit(True)
    for c in ("source_box", "training_box", "retained_box", "tile_box"):
        sizes = sizes & (F.size(c) == 4)
    arr = lambda b: F.array(*(c.cast("double") for c in b))
    source, _ = clip(from_array(F.col("original_box")), F.col("width"), F.col("height"))
    own = from_array(F.col("source_box"))
    grown, needed = expand_min_height(own, min_height, F.col("height"))
    wanted = Box(*(F.when(F.col("is_thin_class"), g).otherwise(o) for g, o in zip(grown, own)))
    training, x, y = from_array(F.col("training_box")), F.col("tile_x"), F.col("tile_y")
    kept = intersection(training, Box(x, y, x + tile_size, y + tile_size))
    tile = from_array(F.col("tile_box"))
    share = kept.area / F.nullif(training.area, F.lit(0.0))
    inside = (training.cx >= x) & (training.cx < x + tile_size) & (training.cy >= y) & (training.cy < y + tile_size)
    moved = F.lit(False)
    for a, b in zip(training, kept):
        moved = moved | (F.abs(a - b) > 1e-9)
    differs = lambda name, b: ~values_close(F.col(name), arr(b), TOLERANCE)
    rules = {
        "source_bbox_image_clip_mismatch": differs("source_box", source),
        "training_bbox_policy_mismatch": differs("training_box", wanted),
        "training_bbox_adjusted_flag_mismatch": F.col("adjusted") != (needed & F.col("is_thin_class")),
        "retained_bbox_mismatch": differs("retained_box", kept),
        "tile_bbox_mismatch": differs("tile_box", Box(kept.x0 - x, kept.y0 - y, kept.x1 - x, kept.y1 - y)),
        "manifest_non_positive_bbox": ~tile.is_positive,
        "manifest_bbox_outside_tile": (tile.x0 < -TOLERANCE) | (tile.y0 < -TOLERANCE) | (tile.x1 > tile_size + TOLERANCE) | (tile.y1 > tile_size + TOLERANCE),
        "intersection_ratio_mismatch": F.coalesce(F.abs(F.col("ratio") - share) > TOLERANCE, F.lit(True)),
        "center_inside_mismatch": F.col("center_inside") != inside,
        "assignment_rule_violation": ~inside & (F.coalesce(share, F.lit(0.0)) < keep_ratio),
        "clipped_flag_mismatch": F.col("clipped") != moved,
    }
    rules = {"manifest_bbox_field_count": ~sizes, **{code: sizes & cond for code, cond in rules.items()}}
    return flagged(records, rules, F.concat_ws(":", "tile_name", "ann_id"))


def orphan_issues(images: DataFrame, labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """Image, label and manifest stems (split, stem) that miss each other: one full join of the three."""
    flag = lambda df, name: df.select("split", "stem").distinct().withColumn(name, F.lit(True))
    key = ["split", "stem"]
    all_three = flag(images, "i").join(flag(labels, "l"), key, "full_outer").join(flag(manifest, "m"), key, "full_outer")
    i, label, m = (F.coalesce(c, F.lit(False)) for c in ("i", "l", "m"))
    return flagged(all_three, {
        "image_without_label": i & ~label, "label_without_image": label & ~i, "image_missing_from_manifest": i & ~m,
        "label_missing_from_manifest": label & ~m, "manifest_missing_image": m & ~i, "manifest_missing_label": m & ~label}, F.col("stem"))


def image_size_issues(images: DataFrame, tile_size: int) -> DataFrame:
    """Generated images (split, stem, width, height of the file) that are not square tiles of `tile_size`; a file without a size counts as one."""
    right = (F.col("width") == tile_size) & (F.col("height") == tile_size)
    return flagged(images, {"generated_image_size_mismatch": ~F.coalesce(right, F.lit(False))}, F.col("stem"))


def reconcile(stored: DataFrame, recomputed: DataFrame, *, keys: list[str], codes: dict[str, str]) -> DataFrame:
    """Stored statistics that differ from recomputed ones; `codes` maps a column to its issue code."""
    names = list(codes)
    other = recomputed.select(*keys, *(F.col(c).alias("r_" + c) for c in names))
    joined = stored.join(other, keys, "full_outer")
    if "split" not in joined.columns:
        joined = joined.withColumn("split", F.lit(""))
    return flagged(joined, {code: ~F.col(c).eqNullSafe(F.col("r_" + c)) for c, code in codes.items()}, F.concat_ws(":", *keys))


def leakage(rows: DataFrame, *, value: str, code: str) -> DataFrame:
    """Values that occur in the training and in the validation split."""
    both = rows.filter(F.col("split").isin("train", "val")).groupBy(value).agg(
        F.max(F.when(F.col("split") == "train", 1).otherwise(0)).alias("t"), F.max(F.when(F.col("split") == "val", 1).otherwise(0)).alias("v"))
    return issue(both.filter("t = 1 AND v = 1").withColumn("split", F.lit("train+val")), code, F.col(value))


def issue_summary(issues: DataFrame, *, examples: int = 20) -> DataFrame:
    """Count per code with its first examples; the examples are a bounded top-n, limited before the shuffle."""
    counts = issues.groupBy("code").agg(F.count("*").alias("n"))
    first = issues.withColumn("__r", F.row_number().over(W.partitionBy("code").orderBy("context", "detail"))).filter(F.col("__r") <= examples)
    listed = first.groupBy("code").agg(F.array_sort(F.collect_list("context")).alias("examples"))
    return counts.join(listed, "code")


def passes(issues: DataFrame) -> bool:
    """Preflight: whether there is no issue at all."""
    return issues.isEmpty()


