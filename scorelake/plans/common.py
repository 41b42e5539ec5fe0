"""Pieces shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.plans.derived import load

# The 40 symbol classes in id order, with their side.
SIDED = ("accent", "staccato", "tenuto", "staccatissimo", "marcato", "fermata")
UNSIDED = ("caesura", "trill", "turn", "inverted_turn", "mordent", "down_bow", "up_bow", "arpeggio", "pedal_start",
           "pedal_stop", "fingering_0", "fingering_1", "fingering_2", "fingering_3", "fingering_4", "fingering_5",
           "tremolo_1", "tremolo_2", "tremolo_3", "tremolo_4", "dynamic_letter_p", "dynamic_letter_m",
           "dynamic_letter_f", "dynamic_letter_s", "dynamic_letter_z", "dynamic_letter_r", "crescendo", "diminuendo")
CLASSES = [(i * 2 + j, name, side) for i, name in enumerate(SIDED) for j, side in enumerate(("above", "below"))] + [
    (12 + i, name, None) for i, name in enumerate(UNSIDED)]

CLASS_MAP_SQL = "cm(class_id, class_name, side) AS (VALUES " + ", ".join(
    f"({i}, '{n}', {'NULL' if s is None else repr(s)})" for i, n, s in CLASSES) + ")"


def class_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASSES, "class_id bigint, class_name string, side string")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "det").withColumn("confidence", F.col("conf_pct").cast("double") / 100)


def staves(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "staff")
    return s.withColumn("center_y", (F.col("y_top") + 2 * F.col("unit")).cast("double"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image record per page; every tenth page is validation data."""
    return load(spark, sf_dir, "page").select(
        F.when(F.col("page_id") % 10 == 0, "val").otherwise("train").alias("split"),
        F.col("page_id").alias("image_id"), F.lit(1960).alias("width"), F.lit(2800).alias("height"))


IMAGE_SQL = """img AS (SELECT CASE WHEN page_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, page_id AS image_id,
  1960 AS width, 2800 AS height FROM page)"""


def sql_iou(a: str, b: str) -> str:
    inter = (f"(greatest(0, least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) * "
             f"greatest(0, least({a}y1, {b}y1) - greatest({a}y0, {b}y0)))")
    area = "(({p}x1 - {p}x0) * ({p}y1 - {p}y0))"
    return f"({inter} / nullif({area.format(p=a)} + {area.format(p=b)} - {inter}, 0))"


def per_mille(column: str) -> str:
    return f"CAST(floor({column} * 1000000) AS BIGINT)"
