"""Evaluation of detections against ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions.boxes import box
from scorelake.operators import evaluate as E
from scorelake.plans.common import CLASS_MAP_SQL, class_map, detections, sql_iou
from scorelake.plans.derived import load, with_views
from scorelake.plans.registry import query

FOLD = """
SELECT %(keys)s, list_reduce(list_transform(l, lambda b: [b]), lambda acc, x:
  CASE WHEN len(list_filter(acc, lambda k: k.g = x[1].g OR k.p = x[1].p)) > 0 THEN acc ELSE list_append(acc, x[1]) END) AS m
FROM (SELECT %(keys)s, list({'g': g, 'p': p, 'gc': gc, 'pc': pc, 'iou': iou} ORDER BY iou DESC, g DESC, p DESC) AS l FROM %(pairs)s GROUP BY ALL)"""

PAIRS = f"""pr AS (SELECT g.page_id, g.gt_seq AS g, d.det_seq AS p, g.class_id AS gc, d.class_id AS pc, {sql_iou('g.', 'd.')} AS iou
  FROM gt g JOIN det d ON d.page_id = g.page_id WHERE {sql_iou('g.', 'd.')} >= 0.5),
same AS (SELECT * FROM pr WHERE gc = pc),
ms AS (SELECT page_id, unnest(m) AS u FROM ({FOLD % dict(keys='page_id, gc', pairs='same')})),
ma AS (SELECT page_id, unnest(m) AS u FROM ({FOLD % dict(keys='page_id', pairs='pr')})),
cnt AS (SELECT class_id, CAST(sum(t) AS BIGINT) AS tp, CAST(sum(p) - sum(t) AS BIGINT) AS fp, CAST(sum(g) - sum(t) AS BIGINT) AS fn FROM (
  SELECT class_id, 1 AS g, 0 AS p, 0 AS t FROM gt UNION ALL SELECT class_id, 0, 1, 0 FROM det UNION ALL SELECT u.gc, 0, 0, 1 FROM ms) GROUP BY 1)"""

PRF = """, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall"""


def _inputs(spark, sf):
    gt = load(spark, sf, "gt").select("page_id", "gt_seq", "class_id", *box())
    pred = detections(spark, sf).select("page_id", "det_seq", "class_id", *box(), "confidence")
    return gt, pred


@query("greedy_match", with_views("gt", "det", then=PAIRS) + """
SELECT page_id, u.g AS gt_seq, u.p AS pred_seq, CAST(floor(u.iou * 1000000) AS BIGINT) AS iou_millionths FROM ms""")
def greedy_match(spark, sf):
    return E.greedy_match(*_inputs(spark, sf)).select(
        "page_id", "gt_seq", "pred_seq", F.floor(F.col("iou") * 1000000).alias("iou_millionths"))


@query("greedy_match_any_class", with_views("gt", "det", then=PAIRS) + """
SELECT page_id, u.g AS gt_seq, u.p AS pred_seq, u.gc AS gt_class, u.pc AS pred_class FROM ma""")
def greedy_match_any(spark, sf):
    return E.greedy_match(*_inputs(spark, sf), same_class=False).select("page_id", "gt_seq", "pred_seq", "gt_class", "pred_class")


@query("prf_per_class", with_views("gt", "det", then=PAIRS) + f"SELECT class_id, tp, fp, fn{PRF} FROM cnt")
def prf_per_class(spark, sf):
    gt, pred = _inputs(spark, sf)
    return E.prf_per_class(gt, pred, E.greedy_match(gt, pred)).select("class_id", "tp", "fp", "fn", "precision", "recall")


@query("prf_overall", with_views("gt", "det", then=PAIRS) + f"""SELECT tp, fp, fn{PRF} FROM (
  SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM cnt)""")
def prf_overall(spark, sf):
    gt, pred = _inputs(spark, sf)
    return E.prf_overall(E.prf_per_class(gt, pred, E.greedy_match(gt, pred))).select("tp", "fp", "fn", "precision", "recall")


@query("prf_semantic", with_views("gt", "det", then=PAIRS + ", " + CLASS_MAP_SQL) + f"""SELECT class_name, tp, fp, fn{PRF} FROM (
  SELECT class_name, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM cnt JOIN cm USING (class_id) GROUP BY 1)""")
def prf_semantic(spark, sf):
    gt, pred = _inputs(spark, sf)
    per_class = E.prf_per_class(gt, pred, E.greedy_match(gt, pred))
    return E.prf_semantic(per_class, class_map(spark)).select("class_name", "tp", "fp", "fn", "precision", "recall")


@query("confusion_matrix", with_views("gt", "det", then=PAIRS) + """
SELECT gc AS gt_class, pc AS pred_class, count(*) AS n FROM (SELECT u.gc AS gc, u.pc AS pc FROM ma
  UNION ALL SELECT class_id, 40 FROM gt ANTI JOIN (SELECT page_id, u.g AS gt_seq FROM ma) USING (page_id, gt_seq)
  UNION ALL SELECT 40, class_id FROM det ANTI JOIN (SELECT page_id, u.p AS det_seq FROM ma) USING (page_id, det_seq)) GROUP BY 1, 2""")
def confusion_matrix(spark, sf):
    gt, pred = _inputs(spark, sf)
    return E.confusion_matrix(gt, pred, E.greedy_match(gt, pred, same_class=False), background=40)


@query("side_confusion", with_views("gt", "det", then=PAIRS + ", " + CLASS_MAP_SQL) + """
SELECT coalesce(a.side, '') AS side_gt, coalesce(b.side, '') AS side_pred, count(*) AS n FROM ma JOIN cm a ON a.class_id = u.gc JOIN cm b ON b.class_id = u.pc
WHERE a.class_name = b.class_name GROUP BY 1, 2""")
def side_confusion(spark, sf):
    gt, pred = _inputs(spark, sf)
    return E.side_confusion(E.greedy_match(gt, pred, same_class=False), class_map(spark)).fillna("")


@query("size_bucket_recall", with_views("gt", "det", then=PAIRS) + """
SELECT CASE WHEN a < 64 THEN 'tiny_lt_64px2' WHEN a < 256 THEN 'small_64_to_255px2' ELSE 'medium_ge_256px2' END AS bucket, count(*) AS ground_truth,
  count(hit) AS true_positive, count(hit) / count(*) AS recall FROM (SELECT (x1 - x0) * (y1 - y0) AS a, m.g AS hit FROM gt LEFT JOIN
  (SELECT page_id, u.g AS g FROM ms) m ON m.page_id = gt.page_id AND m.g = gt.gt_seq) GROUP BY 1""")
def size_bucket_recall(spark, sf):
    gt, pred = _inputs(spark, sf)
    return E.size_bucket_recall(gt, E.greedy_match(gt, pred))


@query("worst_tiles", with_views("gt", "det", then=PAIRS) + """
SELECT page_id, CAST(sum(t) AS BIGINT) AS tp, CAST(sum(p) - sum(t) AS BIGINT) AS fp, CAST(sum(g) - sum(t) AS BIGINT) AS fn, CAST(sum(p) + sum(g) - 2 * sum(t) AS BIGINT) AS errors FROM (
  SELECT page_id, 1 AS g, 0 AS p, 0 AS t FROM gt UNION ALL SELECT page_id, 0, 1, 0 FROM det UNION ALL SELECT page_id, 0, 0, 1 FROM ms) GROUP BY 1 ORDER BY errors DESC, page_id LIMIT 30""")
def worst_tiles(spark, sf):
    gt, pred = _inputs(spark, sf)
    return E.worst_pages(gt, pred, E.greedy_match(gt, pred), 30)


@query("average_precision", with_views("gt", "det", then=PAIRS + """,
st AS (SELECT d.class_id, d.conf_pct AS c, count(*) AS n, count(m.p) AS h FROM det d LEFT JOIN (SELECT page_id, u.p AS p FROM ms) m ON m.page_id = d.page_id AND m.p = d.det_seq GROUP BY 1, 2),
cu AS (SELECT *, sum(h) OVER w / sum(n) OVER w AS prec FROM st WINDOW w AS (PARTITION BY class_id ORDER BY c DESC)),
en AS (SELECT *, max(prec) OVER (PARTITION BY class_id ORDER BY c) AS env FROM cu)""") + """
SELECT e.class_id, n_gt, CAST(round(area / n_gt * 1000000) AS BIGINT) AS ap_millionths FROM (SELECT class_id, sum(env * h) AS area FROM en GROUP BY 1) e
JOIN (SELECT class_id, count(*) AS n_gt FROM gt GROUP BY 1) g USING (class_id)""")
def average_precision(spark, sf):
    gt, pred = _inputs(spark, sf)
    return E.average_precision(gt, pred, E.greedy_match(gt, pred)).select(
        "class_id", "n_gt", F.round(F.col("ap") * 1000000).cast("long").alias("ap_millionths"))


@query("confidence_summary", with_views("det") + """
SELECT class_id, count(*) AS n, min(conf_pct)::DOUBLE AS lo, quantile_cont(conf_pct, 0.5) AS median, max(conf_pct)::DOUBLE AS hi, count(DISTINCT page_id) AS pages FROM det GROUP BY 1""")
def confidence_summary(spark, sf):
    from scorelake.operators.ranking import summarize

    det = load(spark, sf, "det")
    per_page = det.groupBy("class_id", "page_id").count().groupBy("class_id").agg(F.count("*").alias("pages"))
    out = summarize(det, keys=["class_id"], value="conf_pct").join(per_page, "class_id")
    return out.select("class_id", F.col("count").alias("n"), F.col("min").alias("lo"), "median", F.col("max").alias("hi"), "pages")


@query("overlap_semijoin", with_views("gt", "det") + f"""
SELECT page_id, count(*) AS n FROM det d WHERE EXISTS (SELECT 1 FROM gt g WHERE g.page_id = d.page_id AND {sql_iou('g.', 'd.')} >= 0.5) GROUP BY 1""")
def overlap_semijoin(spark, sf):
    gt, pred = _inputs(spark, sf)
    return E.overlapping_predictions(gt, pred).groupBy("page_id").agg(F.count("*").alias("n"))
