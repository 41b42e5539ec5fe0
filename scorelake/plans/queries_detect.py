"""Box algebra, suppression, class mapping, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import boxes as B
from scorelake.functions.vocabulary import CLASS_CONFIDENCE
from scorelake.operators import detect
from scorelake.plans.common import CLASS_MAP_SQL, class_map, detections, per_mille, sql_iou
from scorelake.plans.derived import load, with_views
from scorelake.plans.registry import query


@query("box_measures", with_views("det") + """
SELECT page_id, det_seq, x1 - x0 AS width, y1 - y0 AS height,
  greatest(0, x1 - x0) * greatest(0, y1 - y0) AS area, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy,
  CASE WHEN (x0 + x1) % 2 = 0 THEN (x0 + x1) // 2 WHEN ((x0 + x1) // 2) % 2 = 0 THEN (x0 + x1) // 2 ELSE (x0 + x1) // 2 + 1 END AS icx,
  x1 > x0 AND y1 > y0 AS positive,
  CASE WHEN (x1-x0)*(y1-y0) < 64 THEN 'tiny_lt_64px2' WHEN (x1-x0)*(y1-y0) < 256 THEN 'small_64_to_255px2' ELSE 'medium_ge_256px2' END AS bucket
FROM det""")
def box_measures(spark, sf):
    b = B.box()
    return load(spark, sf, "det").select(
        "page_id", "det_seq", b.width.alias("width"), b.height.alias("height"), b.area.alias("area"), b.cx.alias("cx"),
        b.cy.alias("cy"), B.rounded_center(b)[0].alias("icx"), b.is_positive.alias("positive"),
        B.size_bucket(b.area).alias("bucket"))


@query("box_clip_expand", with_views("gt", then="""
c AS (SELECT *, greatest(x0 - 120, 0) AS cx0, greatest(y0 - 70, 0) AS cy0, least(x1 - 120, 1600) AS cx1, least(y1 - 70, 2500) AS cy1 FROM gt)""") + """
SELECT page_id, gt_seq, cx0, cx1, NOT (cx0 = x0 - 120 AND cy0 = y0 - 70 AND cx1 = x1 - 120 AND cy1 = y1 - 70) AS clipped,
  cy1 - cy0 < 10 AS adjusted,
  CASE WHEN cy1 - cy0 < 10 THEN greatest(0.0::DOUBLE, least((cy0 + cy1) / 2 - 5.0::DOUBLE, 2490.0::DOUBLE)) ELSE cy0 END AS ey0,
  CASE WHEN cy1 - cy0 < 10 THEN greatest(0.0::DOUBLE, least((cy0 + cy1) / 2 - 5.0::DOUBLE, 2490.0::DOUBLE)) + 10.0::DOUBLE ELSE cy1 END AS ey1
FROM c WHERE cx1 > cx0 AND cy1 > cy0""")
def box_clip_expand(spark, sf):
    b = B.box()
    moved = B.Box(b.x0 - 120, b.y0 - 70, b.x1 - 120, b.y1 - 70)
    c, flag = B.clip(moved, F.lit(1600), F.lit(2500))
    e, adjusted = B.expand_min_height(c, 10.0, 2500.0)
    return load(spark, sf, "gt").filter(c.is_positive).select(
        "page_id", "gt_seq", c.x0.alias("cx0"), c.x1.alias("cx1"), flag.alias("clipped"), adjusted.alias("adjusted"),
        e.y0.cast("double").alias("ey0"), e.y1.cast("double").alias("ey1"))


@query("yolo_normalize", with_views("gt") + """
SELECT page_id, gt_seq, (x0 + x1) / 2 / 2800 AS cx, (y0 + y1) / 2 / 2800 AS cy, (x1 - x0) / 2800 AS w, (y1 - y0) / 2800 AS h,
  FALSE AS bad, CAST(round((x0 + x1) / 2 / 2800 * 2800 - (x1 - x0) / 2800 * 2800 / 2) AS BIGINT) AS back_x0 FROM gt""")
def yolo_normalize(spark, sf):
    (cx, cy, w, h), bad = B.normalize(B.box(), 2800)
    out = load(spark, sf, "gt").select("page_id", "gt_seq", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), bad.alias("bad"))
    back = B.denormalize(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), 2800)
    return out.withColumn("back_x0", F.round(back.x0).cast("long"))


@query("tile_to_page", with_views("det") + """
SELECT page_id, det_seq, least(greatest(x0 + 768.0::DOUBLE, 0), 1960) AS x0, least(y0 + 1536.0::DOUBLE, 2800) AS y0,
  least(x1 + 768.0::DOUBLE, 1960) AS x1, least(y1 + 1536.0::DOUBLE, 2800) AS y1
FROM det WHERE (x0 + x1) / 2 < 1024 AND (y0 + y1) / 2 < 1024""")
def tile_to_page(spark, sf):
    inside = detect.in_valid_region(load(spark, sf, "det"), F.lit(1024), F.lit(1024))
    page = B.to_page(B.box(), F.lit(768), F.lit(1536), F.lit(1960), F.lit(2800))
    return inside.select("page_id", "det_seq", *(c.cast("double").alias(n) for c, n in zip(page, page._fields)))


FOLD = """g AS (SELECT page_id, class_id, list({'s': det_seq, 'c': conf_pct, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}
    ORDER BY conf_pct DESC, det_seq) AS l FROM det GROUP BY 1, 2),
k AS (SELECT page_id, class_id, l, list_reduce(list_transform(l, lambda b: [b]), lambda acc, x:
    CASE WHEN len(list_filter(acc, lambda k: %s >= 0.5)) > 0 THEN acc ELSE list_append(acc, x[1]) END) AS kept FROM g)""" % sql_iou("k.", "x[1].")


@query("nms", with_views("det", then=FOLD) + """
SELECT page_id, class_id, u.s AS det_seq, u.c AS conf_pct, u.x0 AS x0, u.y1 AS y1 FROM (SELECT page_id, class_id, unnest(kept) AS u FROM k)""")
def nms(spark, sf):
    det = detections(spark, sf).select("page_id", "class_id", "det_seq", *B.box(), "confidence", "conf_pct")
    return detect.nms(det).select("page_id", "class_id", "det_seq", "conf_pct", "x0", "y1")


@query("nms_sources", with_views("det", then=FOLD + """,
a AS (SELECT page_id, class_id, x.s AS s, x.c AS c, list_filter(kept, lambda k: k.s = x.s OR %s >= 0.5)[1].s AS keeper
  FROM (SELECT page_id, class_id, kept, unnest(l) AS x FROM k))""" % sql_iou("k.", "x.")) + """
SELECT page_id, class_id, keeper AS det_seq, count(*) AS n_sources, max(c) AS best_pct, min(c) AS lowest_pct, CAST(sum(s) AS BIGINT) AS source_checksum
FROM a GROUP BY 1, 2, 3""")
def nms_sources(spark, sf):
    det = detections(spark, sf).select("page_id", "class_id", "det_seq", *B.box(), "confidence")
    out = detect.nms_with_sources(det)
    pct = lambda c: F.round(F.col(c) * 100).cast("long")
    return out.select("page_id", "class_id", "det_seq", "n_sources", pct("confidence").alias("best_pct"),
                      pct("lowest_confidence").alias("lowest_pct"), "source_checksum")


@query("merge_counts", with_views("det", then=FOLD) + """
SELECT page_id, CAST(sum(len(l)) AS BIGINT) AS raw_prediction_count, CAST(sum(len(kept)) AS BIGINT) AS prediction_count,
  CAST(sum(len(l) - len(kept)) AS BIGINT) AS suppressed_prediction_count FROM k GROUP BY 1""")
def merge_counts(spark, sf):
    det = detections(spark, sf).select("page_id", "class_id", "det_seq", *B.box(), "confidence")
    return detect.merge_counts(det)


@query("area_suppression", with_views("gt", then="""
g AS (SELECT page_id, list({'s': gt_seq, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'a': (x1-x0)*(y1-y0)} ORDER BY (x1-x0)*(y1-y0) DESC, gt_seq) AS l FROM gt GROUP BY 1),
k AS (SELECT page_id, list_reduce(list_transform(l, lambda b: [b]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k:
  2 * greatest(0, least(k.x1, x[1].x1) - greatest(k.x0, x[1].x0)) * greatest(0, least(k.y1, x[1].y1) - greatest(k.y0, x[1].y0)) > x[1].a)) > 0
  THEN acc ELSE list_append(acc, x[1]) END) AS kept FROM g)""") + """
SELECT page_id, u.s AS gt_seq, u.a AS area FROM (SELECT page_id, unnest(kept) AS u FROM k)""")
def area_suppression(spark, sf):
    gt = load(spark, sf, "gt").select("page_id", "gt_seq", *B.box())
    return detect.drop_covered(gt, id_col="gt_seq").select("page_id", "gt_seq", B.box().area.alias("area"))


@query("class_mapping_join", with_views("det", then=CLASS_MAP_SQL) + """
SELECT class_name, coalesce(side, '') AS side, count(*) AS n FROM det JOIN cm USING (class_id) GROUP BY 1, 2""")
def class_mapping_join(spark, sf):
    mapped = detect.map_classes(load(spark, sf, "det").select("class_id"), class_map(spark))
    return mapped.groupBy("class_name", "side").agg(F.count("*").alias("n")).fillna("")


@query("candidates_export", with_views("det", then=CLASS_MAP_SQL) + """
SELECT page_id, det_seq, class_name, coalesce(side, '') AS side, x0, y0, x1, y1, conf_pct, 'unmatched' AS association_status FROM det JOIN cm USING (class_id)""")
def candidates_export(spark, sf):
    """Every detection must have a known class, or the job fails."""
    done = detect.export_candidates(load(spark, sf, "det"), class_map(spark))
    return done.select("page_id", "det_seq", "class_name", "side", *B.box(), "conf_pct", "association_status").fillna("", ["side"])


LIMITS = {**CLASS_CONFIDENCE, "trill": 0.9}


@query("class_threshold", with_views("det", then=CLASS_MAP_SQL + ", lim(class_name, t) AS (VALUES " + ", ".join(
    f"('{n}', {t}::DOUBLE)" for n, t in LIMITS.items()) + ")") + """
SELECT class_name, count(*) AS n, CAST(sum(conf_pct) AS BIGINT) AS pct FROM det JOIN cm USING (class_id) LEFT JOIN lim USING (class_name)
WHERE conf_pct::DOUBLE / 100 >= coalesce(t, 0.25::DOUBLE) GROUP BY 1""")
def class_threshold(spark, sf):
    mapped = detect.map_classes(detections(spark, sf).select("class_id", "confidence", "conf_pct"), class_map(spark))
    return detect.apply_thresholds(mapped, {"trill": 0.9}).groupBy("class_name").agg(
        F.count("*").alias("n"), F.sum("conf_pct").alias("pct"))


@query("iou_values", with_views("det") + f"""
SELECT a.page_id, a.obj, {per_mille(sql_iou('a.', 'b.'))} AS iou_millionths FROM det a JOIN det b
ON a.page_id = b.page_id AND a.obj = b.obj AND a.det_seq + 1 = b.det_seq""")
def iou_values(spark, sf):
    det = load(spark, sf, "det")
    both = det.groupBy("page_id", "obj").agg(F.min(F.struct("det_seq", *B.box())).alias("a"),
                                             F.max(F.struct("det_seq", *B.box())).alias("b"))
    value = B.iou(B.box(of=F.col("a")), B.box(of=F.col("b")))
    return both.select("page_id", "obj", F.floor(value * 1000000).alias("iou_millionths"))
