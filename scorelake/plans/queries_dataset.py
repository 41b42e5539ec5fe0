"""Tiling, sampling and dataset statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions.boxes import box
from scorelake.operators import stats, tiling
from scorelake.operators.ranking import summarize
from scorelake.plans.common import IMAGE_SQL, images
from scorelake.plans.derived import load, with_views
from scorelake.plans.registry import query

TILES = IMAGE_SQL + """,
tiles AS (SELECT img.*, ty AS tile_y, tx AS tile_x FROM (SELECT img.*, unnest(range(0, height, 768)) AS ty FROM img) img, unnest(range(0, width, 768)) AS t(tx))"""

ASSIGN = """,
b AS (SELECT CASE WHEN page_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, page_id AS image_id, gt_seq, class_id, x0, y0, x1, y1 FROM gt),
tx AS (SELECT unnest(range(0, 1960, 768)) AS tile_x), tyy AS (SELECT unnest(range(0, 2800, 768)) AS tile_y),
asg0 AS (SELECT b.*, tile_x, tile_y, greatest(x0, tile_x) AS k0, greatest(y0, tile_y) AS l0, least(x1, tile_x + 1024) AS k1, least(y1, tile_y + 1024) AS l1,
  (x0 + x1) / 2 >= tile_x AND (x0 + x1) / 2 < tile_x + 1024 AND (y0 + y1) / 2 >= tile_y AND (y0 + y1) / 2 < tile_y + 1024 AS inside FROM b, tx, tyy),
asg AS (SELECT *, ((k1 - k0) * (l1 - l0)) / ((x1 - x0) * (y1 - y0)) AS share, NOT (k0 = x0 AND l0 = y0 AND k1 = x1 AND l1 = y1) AS clipped FROM asg0
  WHERE k1 > k0 AND l1 > l0 AND (inside OR ((k1 - k0) * (l1 - l0)) / ((x1 - x0) * (y1 - y0)) >= 0.6::DOUBLE))"""


def boxes(spark, sf):
    return load(spark, sf, "gt").select(
        F.when(F.col("page_id") % 10 == 0, "val").otherwise("train").alias("split"), F.col("page_id").alias("image_id"),
        "gt_seq", "class_id", *box(), F.lit(1960).alias("width"), F.lit(2800).alias("height"))


def assigned(spark, sf):
    return tiling.assign_to_tiles(boxes(spark, sf))


@query("tile_windows", with_views("page", then=TILES) + """
SELECT split, image_id, tile_x, tile_y, greatest(0, least(1024, width - tile_x)) AS valid_w, greatest(0, least(1024, height - tile_y)) AS valid_h,
  greatest(0, tile_x + 1024 - width) AS pad_right, greatest(0, tile_y + 1024 - height) AS pad_bottom,
  'page_' || image_id || '__id' || image_id || '__x' || lpad(tile_x::VARCHAR, 4, '0') || '_y' || lpad(tile_y::VARCHAR, 4, '0') AS name FROM tiles""")
def tile_windows(spark, sf):
    name = tiling.tile_name(F.format_string("page %d.png", "image_id"), F.col("image_id"), F.col("tile_x"), F.col("tile_y"))
    return tiling.tile_windows(images(spark, sf)).select(
        "split", "image_id", "tile_x", "tile_y", "valid_w", "valid_h", "pad_right", "pad_bottom", name.alias("name"))


@query("shifted_windows", with_views("page", then=IMAGE_SQL) + """
SELECT DISTINCT image_id, least(tx, width - 1024) AS tile_x, least(ty, height - 1024) AS tile_y
FROM (SELECT img.*, unnest(range(0, height, 768)) AS ty FROM img) img, unnest(range(0, width, 768)) AS t(tx)""")
def shifted_windows(spark, sf):
    return tiling.tile_windows(images(spark, sf), shifted=True).select("image_id", "tile_x", "tile_y")


@query("tile_assignment", with_views("gt", then="one AS (SELECT 1)" + ASSIGN) + """
SELECT split, image_id, gt_seq, tile_x, tile_y, CAST(floor(share * 1000000) AS BIGINT) AS share_millionths, inside AS center_inside, clipped,
  CASE WHEN inside AND share >= 1 - 1e-12 THEN 'center_inside_full_bbox' WHEN inside THEN 'center_inside_clipped_bbox' ELSE 'intersection_ratio' END AS reason,
  k0 - tile_x AS tile_x0, l1 - tile_y AS tile_y1 FROM asg""")
def tile_assignment(spark, sf):
    return assigned(spark, sf).select(
        "split", "image_id", "gt_seq", "tile_x", "tile_y", F.floor(F.col("intersection_ratio") * 1000000).alias("share_millionths"),
        "center_inside", "clipped", "reason", "tile_x0", "tile_y1")


@query("tile_statistics", with_views("page", "gt", then=TILES + ASSIGN) + """
SELECT t.split, count(*) AS n_tiles, count(p.image_id) AS positive_tiles, count(*) - count(p.image_id) AS negative_tiles
FROM tiles t LEFT JOIN (SELECT DISTINCT image_id, tile_x, tile_y FROM asg) p ON p.image_id = t.image_id AND p.tile_x = t.tile_x AND p.tile_y = t.tile_y GROUP BY 1""")
def tile_statistics(spark, sf):
    return tiling.tile_statistics(tiling.tile_windows(images(spark, sf)), assigned(spark, sf),
                                  key=["split", "image_id", "tile_x", "tile_y"])


@query("tiles_per_class", with_views("gt", then="one AS (SELECT 1)" + ASSIGN) + """
SELECT class_id, split, count(DISTINCT (image_id, tile_x, tile_y)) AS n_tiles, count(*) AS assignments FROM asg GROUP BY 1, 2""")
def tiles_per_class(spark, sf):
    per_tile = assigned(spark, sf).groupBy("class_id", "split", "image_id", "tile_x", "tile_y").agg(F.count("*").alias("n"))
    return per_tile.groupBy("class_id", "split").agg(F.count("*").alias("n_tiles"), F.sum("n").alias("assignments"))


@query("duplicate_assignments", with_views("gt", then="one AS (SELECT 1)" + ASSIGN) + """
SELECT count(*) FILTER (n = 0) AS unassigned, count(*) FILTER (n = 1) AS once, count(*) FILTER (n > 1) AS duplicated,
  CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) AS extra_assignments
FROM (SELECT b.image_id, b.gt_seq, count(a.tile_x) AS n FROM b LEFT JOIN asg a ON a.image_id = b.image_id AND a.gt_seq = b.gt_seq GROUP BY 1, 2)""")
def duplicate_assignments(spark, sf):
    return tiling.assignment_counts(boxes(spark, sf), assigned(spark, sf), key=["image_id", "gt_seq"])


@query("tile_members", with_views("gt", then="one AS (SELECT 1)" + ASSIGN) + """
SELECT image_id, tile_x, tile_y, string_agg(gt_seq::VARCHAR, ',' ORDER BY gt_seq) AS ids,
  coalesce(string_agg(gt_seq::VARCHAR, ',' ORDER BY gt_seq) FILTER (clipped), '') AS clipped_ids FROM asg GROUP BY 1, 2, 3""")
def tile_members(spark, sf):
    members = tiling.tile_members(assigned(spark, sf), key=["image_id", "tile_x", "tile_y"], id_col="gt_seq")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return members.select("image_id", "tile_x", "tile_y", text("annotation_ids").alias("ids"), text("clipped_ids").alias("clipped_ids"))


@query("negative_sample", with_views("page", "gt", then=TILES + ASSIGN + """,
pos AS (SELECT DISTINCT split, image_id, tile_x, tile_y FROM asg), q AS (SELECT split, floor(count(*) * 0.25) AS n FROM pos GROUP BY 1),
neg AS (SELECT t.split, t.image_id, t.tile_x, t.tile_y, row_number() OVER (PARTITION BY t.split ORDER BY md5('7:' || t.image_id || ':' || t.tile_x || ':' || t.tile_y)) AS r
  FROM tiles t ANTI JOIN pos p ON p.image_id = t.image_id AND p.tile_x = t.tile_x AND p.tile_y = t.tile_y)""") + """
SELECT neg.split, image_id, tile_x, tile_y FROM neg JOIN q ON q.split = neg.split WHERE r <= n""")
def negative_sample(spark, sf):
    tiles = tiling.tile_windows(images(spark, sf))
    return tiling.negative_tiles(tiles, assigned(spark, sf), seed=7).select("split", "image_id", "tile_x", "tile_y")


@query("class_statistics", with_views("gt", then="one AS (SELECT 1)" + ASSIGN) + """
SELECT coalesce(class_id, -1) AS class_id, coalesce(split, '') AS split, grouping(class_id) * 2 + grouping(split) AS level, count(*) AS instances,
  count(DISTINCT image_id) AS images FROM b GROUP BY GROUPING SETS ((class_id, split), (class_id), (split), ())""")
def class_statistics(spark, sf):
    return stats.class_statistics(boxes(spark, sf)).withColumn("level", F.col("level").cast("long")).fillna(-1, ["class_id"]).fillna("", ["split"])


@query("class_rollup", with_views("gt", then="one AS (SELECT 1)" + ASSIGN) + """
SELECT coalesce(split, '') AS split, coalesce(class_id, -1) AS class_id, count(*) AS n, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area FROM b GROUP BY ROLLUP (split, class_id)""")
def class_rollup(spark, sf):
    out = boxes(spark, sf).rollup("split", "class_id").agg(F.count("*").alias("n"), F.sum(box().area).alias("area"))
    return out.fillna(-1, ["class_id"]).fillna("", ["split"])


@query("bbox_percentiles", with_views("gt", then="""
m AS (SELECT class_id, 'width' AS measure, x1 - x0 AS v FROM gt UNION ALL SELECT class_id, 'height', y1 - y0 FROM gt UNION ALL SELECT class_id, 'area', (x1 - x0) * (y1 - y0) FROM gt)""") + """
SELECT class_id, measure, count(*) AS n, min(v)::DOUBLE AS lo, quantile_cont(v, 0.25) * 100 AS p25, quantile_cont(v, 0.5) * 100 AS median, sum(v)::DOUBLE / count(*) AS mean,
  quantile_cont(v, 0.75) * 100 AS p75, CAST(round(quantile_cont(v, 0.95) * 1000) AS BIGINT) AS p95, max(v)::DOUBLE AS hi FROM m GROUP BY 1, 2""")
def bbox_percentiles(spark, sf):
    b = box()
    measured = load(spark, sf, "gt").select("class_id", b.width.alias("width"), b.height.alias("height"), b.area.alias("area"))
    out = stats.box_summary(measured, keys=["class_id"], values=["width", "height", "area"])
    return out.select("class_id", "measure", F.col("count").alias("n"), F.col("min").alias("lo"), (F.col("p25") * 100).alias("p25"),
                      (F.col("median") * 100).alias("median"), "mean", (F.col("p75") * 100).alias("p75"),
                      F.round(F.col("p95") * 1000).cast("long").alias("p95"), F.col("max").alias("hi"))


@query("price_percentiles", """
SELECT l_returnflag AS flag, count(*) AS n, CAST(round(quantile_cont(l_extendedprice, 0.25) * 10000) AS BIGINT) AS p25,
  CAST(round(quantile_cont(l_extendedprice, 0.95) * 10000) AS BIGINT) AS p95, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1""")
def price_percentiles(spark, sf):
    """The same summary over a measure with many distinct values."""
    out = summarize(spark.read.parquet(f"{sf}/lineitem.parquet"), keys=["l_returnflag"], value="l_extendedprice")
    return out.select(F.col("l_returnflag").alias("flag"), F.col("count").alias("n"), F.round(F.col("p25") * 10000).cast("long").alias("p25"),
                      F.round(F.col("p95") * 10000).cast("long").alias("p95"), F.col("max").alias("hi"))


@query("sheet_split", with_views("gt") + """
SELECT page_id * 2 + least(CAST(floor((x0 + x1) / 2 / 980) AS BIGINT), 1) AS page_no, gt_seq, x0 - 980 * least(CAST(floor((x0 + x1) / 2 / 980) AS BIGINT), 1) AS x0 FROM gt""")
def sheet_split(spark, sf):
    src = load(spark, sf, "gt").withColumn("sheet_no", F.col("page_id")).withColumn("width", F.lit(1960))
    return tiling.split_sheets(src, pages_per_sheet=2).select("page_no", "gt_seq", "x0")


@query("class_samples", with_views("gt", then="""
o AS (SELECT class_id, page_id, min(gt_seq) AS gt_seq, md5('11:' || page_id || ':' || class_id) AS h FROM gt GROUP BY 1, 2)""") + """
SELECT class_id, page_id, gt_seq FROM o QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY h, page_id) <= 5""")
def class_samples(spark, sf):
    rows = load(spark, sf, "gt").select("class_id", "page_id", "gt_seq")
    return stats.sample_per_class(rows, class_col="class_id", image_col="page_id", n=5, seed=11)


@query("subset_coverage")
def subset_coverage(spark, sf):
    key = ["image_id", "tile_x", "tile_y"]
    members = F.array_sort(F.collect_list(F.struct(F.concat_ws("-", "image_id", "gt_seq").alias("id"), "class_id")))
    per_tile = assigned(spark, sf).groupBy(*key).agg(members.alias("m"), F.count(F.when(F.col("clipped"), 1)).alias("n_clipped"))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    tiles = tiling.tile_windows(images(spark, sf)).join(per_tile, key, "left").select(
        F.concat_ws("_", *key).alias("tile_id"), F.coalesce(F.transform("m", lambda r: r["id"]), empty("string")).alias("annotation_ids"),
        F.coalesce(F.transform("m", lambda r: r["class_id"]), empty("bigint")).alias("class_ids"), F.coalesce("n_clipped", F.lit(0)).alias("n_clipped"),
        ((F.col("pad_right") > 0) | (F.col("pad_bottom") > 0)).alias("padded"), F.col("m").isNull().alias("is_negative"))
    classes = load(spark, sf, "gt").agg(F.max("class_id")).first()[0] + 1  # numbered from 0
    out = stats.select_subset(tiles, class_count=classes, per_class=2, total=2 * classes + 4, negatives=5, seed=42)
    return out.select("tile_id", F.array_join(F.col("class_ids").cast("array<string>"), ",").alias("class_ids"), "is_negative")


@query("manifest_order", with_views("page", then=TILES) + """
SELECT split, image_id, tile_x, tile_y FROM tiles ORDER BY split, image_id, tile_y, tile_x""")
def manifest_order(spark, sf):
    return stats.manifest_order(tiling.tile_windows(images(spark, sf))).select("split", "image_id", "tile_x", "tile_y")


@query("run_summary", """
WITH l AS (SELECT o_custkey % 50 AS run, o_orderkey AS epoch, o_totalprice AS loss, o_totalprice % 1000 AS metric FROM orders)
SELECT run, min(epoch) AS first_epoch, max(epoch) AS last_epoch, arg_max(epoch, {'m': metric, 'e': -epoch}) + 1 AS best_epoch, max(metric) AS best_metric, min(loss) AS min_loss FROM l GROUP BY 1""")
def run_summary(spark, sf):
    log = spark.read.parquet(f"{sf}/orders.parquet").select(
        (F.col("o_custkey") % 50).alias("run"), F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("loss"), (F.col("o_totalprice") % 1000).alias("metric"))
    return stats.run_summary(log, losses=["loss"], metric="metric")
