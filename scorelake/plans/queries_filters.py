"""Filters and small attachments."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions.boxes import box
from scorelake.operators import attach, bars, clusters, evaluate, profile, staffs
from scorelake.plans.common import staves
from scorelake.plans.derived import load, with_views
from scorelake.plans.queries_associate import CLOSEST, _full_staves
from scorelake.plans.queries_bars import RANGES
from scorelake.plans.queries_evaluate import _inputs
from scorelake.plans.queries_evaluate import FOLD, PAIRS
from scorelake.plans.registry import query

RANGE = """gr AS (SELECT *, least(7, greatest(0, CAST(floor((y0 - 150) / 310) AS BIGINT))) AS s, 150 + 310 * least(7, greatest(0, CAST(floor((y0 - 150) / 310) AS BIGINT))) AS st FROM gt),
rr AS (SELECT *, st AS rt, st + 70 AS rb FROM gr)"""


def _ranged(spark, sf):
    s = F.least(F.lit(7), F.greatest(F.lit(0), F.floor((F.col("y0") - 150) / 310)))
    return load(spark, sf, "gt").withColumn("range_top", 150 + 310 * s).withColumn("range_bottom", F.col("range_top") + 70)


@query("barlines_in_range", with_views("gt", then=RANGE) + "SELECT page_id, gt_seq FROM rr WHERE y0 >= rt - 7 AND y0 < rb + 7 AND y1 >= rt - 7 AND y1 < rb + 7")
def barlines_in_range(spark, sf):
    return attach.barlines_in_range(_ranged(spark, sf)).select("page_id", "gt_seq")


@query("rests_in_range", with_views("gt", then=RANGE) + "SELECT page_id, gt_seq FROM rr WHERE (y0 BETWEEN rt AND rt + 34 OR y1 BETWEEN rt AND rt + 34) AND y1 - y0 > 14")
def rests_in_range(spark, sf):
    rests = _ranged(spark, sf).withColumn("range_bottom", F.col("range_top") + 34)
    return attach.rests_in_range(rests).select("page_id", "gt_seq")


@query("note_to_the_right", with_views("gt", "note", then="""
p AS (SELECT page_id, gt_seq, x1, CASE WHEN (y0 + y1) % 2 = 0 THEN (y0 + y1) // 2 WHEN (y0 + y1) // 2 % 2 = 0 THEN (y0 + y1) // 2 ELSE (y0 + y1) // 2 + 1 END AS cy FROM gt),
m AS (SELECT p.page_id, p.gt_seq, min({'x': greatest(n.x0, p.x1), 'ng': n.ng}) AS b FROM p JOIN note n ON n.page_id = p.page_id AND n.x0 <= p.x1 + 19 AND n.x1 - 1 >= p.x1 AND n.y0 <= cy AND n.y1 - 1 >= cy GROUP BY 1, 2)""") + """
SELECT gt.page_id, gt.gt_seq, coalesce(b.ng, -1) AS ng FROM gt LEFT JOIN m ON m.page_id = gt.page_id AND m.gt_seq = gt.gt_seq""")
def note_to_the_right(spark, sf):
    boxes = load(spark, sf, "gt").select("page_id", "gt_seq", *box()).withColumn("unit", F.lit(20))
    return attach.note_to_the_right(boxes, load(spark, sf, "note").select("page_id", "ng", *box())).select("page_id", "gt_seq", F.coalesce("ng", F.lit(-1)).alias("ng"))


@query("staff_of_note", with_views("gt", "staff", then=CLOSEST) + """
SELECT page_id, gt_seq, CASE WHEN c1 = c2 OR y BETWEEN up AND low THEN s1 WHEN y < (c1 + c2) / 2 THEN CASE WHEN c1 < c2 THEN s1 ELSE s2 END ELSE CASE WHEN c1 < c2 THEN s2 ELSE s1 END END AS staff_index FROM q""")
def staff_of_note(spark, sf):
    b = box()
    pts = load(spark, sf, "gt").select("page_id", "gt_seq", b.cx.alias("x"), b.cy.alias("y"))
    near = staffs.closest_staffs(pts, _full_staves(spark, sf), point_id="gt_seq")
    return near.select("page_id", "gt_seq", attach.staff_of_note(near).alias("staff_index"))


@query("group_reassign", with_views("note", "staff", then="""
r AS (SELECT page_id, staff_index AS s, y_top AS rt, y_top + 4 * unit AS rb, lead(y_top) OVER w AS nt, lag(y_top + 4 * unit) OVER w AS pb FROM staff WINDOW w AS (PARTITION BY page_id ORDER BY staff_index)),
f AS (SELECT n.page_id, n.ng, max(r.s) AS s FROM note n JOIN r ON r.page_id = n.page_id WHERE (n.y0 BETWEEN rt AND rb OR n.y1 BETWEEN rt AND rb) AND (nt IS NULL OR n.y1 < nt) AND (pb IS NULL OR n.y0 > pb) GROUP BY 1, 2)""") + """
SELECT n.page_id, n.ng, coalesce(f.s, n.staff_index) AS staff_index FROM note n LEFT JOIN f ON f.page_id = n.page_id AND f.ng = n.ng""")
def group_reassign(spark, sf):
    from pyspark.sql import Window as W

    order = W.partitionBy("page_id").orderBy("staff_index")
    bottom = F.col("y_top") + 4 * F.col("unit")
    ranges = load(spark, sf, "staff").select("page_id", "staff_index", F.col("y_top").alias("range_top"), bottom.alias("range_bottom"),
                                             F.lead("y_top").over(order).alias("next_top"), F.lag(bottom).over(order).alias("prev_bottom"))
    return attach.reassign_groups(load(spark, sf, "note").select("page_id", "ng", "staff_index", *box()), ranges).select("page_id", "ng", "staff_index")


@query("bar_elements_only", with_views("note") + """
SELECT page_id, staff_index * 100 + slot AS ng, count(*) AS n FROM note GROUP BY 1, 2 HAVING NOT bool_and(pk % 6 = 0) AND NOT (max(CASE WHEN h % 2 = 0 THEN 1 END) IS NOT NULL AND max(rhythm) <= 0)""")
def bar_elements_only(spark, sf):
    heads = load(spark, sf, "note").select("page_id", (F.col("staff_index") * 100 + F.col("slot")).alias("ng"), "rhythm", (F.col("pk") % 6 == 0).alias("is_ornament"),
                                           F.when(F.col("h") % 2 == 0, 1).alias("chunk"))
    return attach.bar_elements_only(heads).groupBy("page_id", "ng").agg(F.count("*").alias("n"))


@query("boxes_without_barline", with_views("staff", "gt", then=RANGES) + """
SELECT page_id, gt_seq FROM gt WHERE NOT EXISTS (SELECT 1 FROM br WHERE br.page_id = gt.page_id AND br.stop BETWEEN gt.x0 AND gt.x1 - 1)""")
def boxes_without_barline(spark, sf):
    from scorelake.plans.queries_bars import _ranges

    lines = _ranges(spark, sf).select("page_id", F.col("stop").alias("x"))
    return bars.remove_boxes_at(load(spark, sf, "gt").select("page_id", "gt_seq", *box()), lines).select("page_id", "gt_seq")


@query("staff_crops", with_views("staff", then="b AS (SELECT *, y_top + 4 * unit AS yb FROM staff)") + """
SELECT page_id, staff_index, coalesce(CAST(floor((lag(yb) OVER w + y_top) / 2) AS BIGINT), greatest(0, y_top - 4 * unit)) AS crop_top,
  coalesce(CAST(floor((yb + lead(y_top) OVER w) / 2) AS BIGINT), yb + 4 * unit) AS crop_bottom FROM b WINDOW w AS (PARTITION BY page_id, system_no ORDER BY staff_index)""")
def staff_crops(spark, sf):
    rows = load(spark, sf, "staff").withColumn("y_bottom", F.col("y_top") + 4 * F.col("unit"))
    return bars.neighbour_clamped_boxes(rows).select("page_id", "staff_index", "crop_top", "crop_bottom")


@query("window_threshold", with_views("det", then="m AS (SELECT page_id, y0 // 100 AS y, x0 // 100 AS x, class_id % 5 AS channel, sum(conf_pct) / count(*) AS s FROM det GROUP BY 1, 2, 3, 4)") + """
SELECT page_id, y, x, channel FROM m WHERE (channel = 0 AND s >= 60) OR (channel = 1 AND s >= 75)""")
def window_threshold(spark, sf):
    rows = load(spark, sf, "det").select("page_id", F.floor(F.col("y0") / 100).alias("y"), F.floor(F.col("x0") / 100).alias("x"),
                                         (F.col("class_id") % 5).alias("channel"), F.col("conf_pct").alias("score"))
    return profile.threshold_windows(rows, {0: 60.0, 1: 75.0}).select("page_id", "y", "x", "channel")


@query("barline_columns", with_views("staff", then="p AS (SELECT page_id, staff_index, 4 * unit AS h, x, (page_id * 7 + staff_index * 3 + x * 11) % (5 * unit) AS ink FROM (SELECT *, unnest(range(60)) AS x FROM staff))") + """
SELECT page_id, staff_index, x FROM p WHERE ink / h > 0.8""")
def barline_columns(spark, sf):
    rows = load(spark, sf, "staff").withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))))
    rows = rows.withColumn("staff_height", 4 * F.col("unit")).withColumn(
        "ink", (F.col("page_id") * 7 + F.col("staff_index") * 3 + F.col("x") * 11) % (5 * F.col("unit")))
    return bars.barline_columns(rows, 0.8).select("page_id", "staff_index", "x")


@query("lines_in_hull", with_views("gt", "staff", then="h AS (SELECT page_id, min(left_x) AS a, max(right_x) AS b, min(y_top) AS c, max(y_top + 4 * unit) AS d FROM staff GROUP BY 1)") + """
SELECT page_id, gt_seq FROM gt JOIN h USING (page_id) WHERE x0 >= a AND x1 <= b AND (y0 + y1) / 2 BETWEEN c AND d""")
def lines_in_hull(spark, sf):
    return attach.inside_hull(load(spark, sf, "gt"), staves(spark, sf)).select("page_id", "gt_seq")


@query("boxes_in_zones", with_views("gt", "staff") + """
SELECT gt.page_id, gt_seq FROM gt JOIN (SELECT page_id, min(left_x + 200) AS a, max(right_x - 300) AS b FROM staff GROUP BY 1) z ON z.page_id = gt.page_id AND (x0 + x1) / 2 BETWEEN a AND b""")
def boxes_in_zones(spark, sf):
    zones = load(spark, sf, "staff").select("page_id", (F.col("left_x") + 200).alias("x0"), (F.col("right_x") - 300).alias("x1"))
    return attach.in_zones(load(spark, sf, "gt"), zones).select("page_id", "gt_seq")


@query("clef_relabel", with_views("gt") + """
SELECT page_id, gt_seq, CASE WHEN gt_seq % 3 - 1 = 0 AND y0 < 1000 - 6 / 3.0::DOUBLE THEN -2 ELSE gt_seq % 3 - 1 END AS clef FROM gt WHERE y1 - y0 >= 18""")
def clef_relabel(spark, sf):
    rows = load(spark, sf, "gt").withColumns({"unit": F.lit(6), "y_top": F.lit(1000), "clef": F.col("gt_seq") % 3 - 1})
    return attach.relabel_clefs(rows).select("page_id", "gt_seq", "clef")


@query("ornament_marks", with_views("gt", then="""
sz AS (SELECT page_id, list((x1 - x0) * (y1 - y0)) AS l, min((x1 - x0) * (y1 - y0))::DOUBLE AS lo, max((x1 - x0) * (y1 - y0))::DOUBLE AS hi FROM gt GROUP BY 1),
it AS (SELECT page_id, list_reduce(list_transform(range(20), lambda i: {'lo': lo, 'hi': hi}), lambda c, i: {
  'lo': coalesce(list_avg(list_filter(l, lambda v: abs(v - c.lo) <= abs(v - c.hi))), c.lo), 'hi': coalesce(list_avg(list_filter(l, lambda v: abs(v - c.lo) > abs(v - c.hi))), c.hi)}, {'lo': lo, 'hi': hi}) AS c FROM sz)""") + """
SELECT gt.page_id, gt_seq, c.hi / c.lo > 2 AND (x1 - x0) * (y1 - y0) < floor(c.hi / 2) AS is_ornament FROM gt JOIN it ON it.page_id = gt.page_id""")
def ornament_marks(spark, sf):
    return clusters.mark_ornaments(load(spark, sf, "gt").select("page_id", "gt_seq", *box())).select("page_id", "gt_seq", "is_ornament")


def _map_sql(thresholds) -> str:
    """Matches are folded anew for each threshold, and the precision envelopes summed per class."""
    parts = []
    for k, limit in enumerate(thresholds):
        parts.append(f"""
sa{k} AS (SELECT * FROM pr WHERE gc = pc AND iou >= {limit}),
mt{k} AS (SELECT page_id, unnest(m) AS u FROM ({FOLD % dict(keys='page_id, gc', pairs=f'sa{k}')})),
st{k} AS (SELECT d.class_id, d.conf_pct AS c, count(*) AS n, count(m.p) AS h FROM det d LEFT JOIN (SELECT page_id, u.p AS p FROM mt{k}) m
  ON m.page_id = d.page_id AND m.p = d.det_seq GROUP BY 1, 2),
cu{k} AS (SELECT *, sum(h) OVER w / sum(n) OVER w AS prec FROM st{k} WINDOW w AS (PARTITION BY class_id ORDER BY c DESC)),
ap{k} AS (SELECT class_id, sum(env * h) AS area FROM (SELECT *, max(prec) OVER (PARTITION BY class_id ORDER BY c) AS env FROM cu{k}) GROUP BY 1)""")
    areas = " UNION ALL ".join(f"SELECT class_id, {k} AS k, area FROM ap{k}" for k in range(len(thresholds)))
    return PAIRS.split("same AS")[0] + ",".join(p.strip() for p in parts) + f""",
al AS ({areas})
SELECT class_id, CAST(round(coalesce(sum(area), 0) / {len(thresholds)} / n_gt * 1000000) AS BIGINT) AS map_millionths
FROM (SELECT class_id, count(*) AS n_gt FROM gt GROUP BY 1) LEFT JOIN al USING (class_id) GROUP BY class_id, n_gt"""


LEVELS = (0.5, 0.7, 0.9)


@query("mean_average_precision", with_views("gt", "det", then=_map_sql(LEVELS)))
def mean_average_precision(spark, sf):
    gt, pred = _inputs(spark, sf)
    return evaluate.mean_average_precision(gt, pred, LEVELS).select("class_id", F.round(F.col("map") * 1000000).cast("long").alias("map_millionths"))
