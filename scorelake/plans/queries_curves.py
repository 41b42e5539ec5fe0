"""Dynamic letters, slurs and ties."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions.boxes import box
from scorelake.functions.vocabulary import DYNAMIC_PATTERN
from scorelake.operators import curves, dynamics
from scorelake.plans.common import staves
from scorelake.plans.derived import load, with_views
from scorelake.plans.registry import query

LETTERS = """g AS (SELECT page_id, staff_index, list({'s': cand_seq, 'l': letter, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'c': conf_pct::DOUBLE / 100, 'u': unit,
    'cy': (y0 + y1) / 2, 'cx': (x0 + x1) / 2} ORDER BY y0 + y1, x0 + x1, cand_seq) AS l FROM letter GROUP BY 1, 2),
k AS (SELECT page_id, staff_index, unnest(list_reduce(list_transform(l, lambda a: [[a]]), lambda acc, x:
  CASE WHEN len(list_filter(acc, lambda c: x[1][1].x0 - c[-1].x1 >= -0.6::DOUBLE * c[-1].u AND x[1][1].x0 - c[-1].x1 <= 1.8::DOUBLE * c[-1].u AND abs(x[1][1].cy - c[-1].cy) <= 1.3::DOUBLE * c[-1].u)) = 0
  THEN list_append(acc, x[1])
  ELSE list_transform(acc, lambda c, i: CASE WHEN i = list_filter(range(1, len(acc) + 1), lambda q: x[1][1].x0 - acc[q][-1].x1 >= -0.6::DOUBLE * acc[q][-1].u
    AND x[1][1].x0 - acc[q][-1].x1 <= 1.8::DOUBLE * acc[q][-1].u AND abs(x[1][1].cy - acc[q][-1].cy) <= 1.3::DOUBLE * acc[q][-1].u)[-1] THEN list_append(c, x[1][1]) ELSE c END) END)) AS cl FROM g),
cl AS (SELECT page_id, staff_index, list_sort(list_transform(cl, lambda c: {'cx': c.cx, 'cy': c.cy, 's': c.s, 'l': c.l})) AS o, cl FROM k)"""


def combined(spark, sf):
    letters = load(spark, sf, "letter").withColumn("confidence", F.col("conf_pct").cast("double") / 100)
    return dynamics.combine_letters(letters)


@query("dynamic_letters", with_views("letter", then=LETTERS) + f"""
SELECT page_id, staff_index AS staff_key, o[1].s AS cand_seq, list_aggregate(list_transform(o, lambda c: c.l), 'string_agg', '') AS dynamic_text,
  regexp_full_match(list_aggregate(list_transform(o, lambda c: c.l), 'string_agg', ''), '{DYNAMIC_PATTERN.strip("^$")}') AS valid, len(o) AS n_letters,
  list_min(list_transform(cl, lambda c: c.x0)) AS x0, list_max(list_transform(cl, lambda c: c.y1)) AS y1 FROM cl""")
def dynamic_letters(spark, sf):
    return combined(spark, sf).select("page_id", "staff_key", "cand_seq", "dynamic_text", "valid",
                                      F.col("n_letters").cast("long").alias("n_letters"), "x0", "y1")


@query("dynamic_marks", with_views("letter", then=LETTERS) + f"""
SELECT t AS dynamic_text, count(*) AS n FROM (SELECT list_aggregate(list_transform(o, lambda c: c.l), 'string_agg', '') AS t FROM cl)
WHERE regexp_full_match(t, '{DYNAMIC_PATTERN.strip("^$")}') GROUP BY 1""")
def dynamic_marks(spark, sf):
    return combined(spark, sf).filter("valid").groupBy("dynamic_text").agg(F.count("*").alias("n"))


FEATURES = """cm AS (SELECT page_id, component, x, median(y) AS m, count(*) AS n, min(y) AS lo, max(y) AS hi FROM curve_pixel GROUP BY 1, 2, 3),
hu AS (SELECT page_id, component, min(x) AS x0, max(x) + 1 AS x1, min(lo) AS y0, max(hi) + 1 AS y1, sum(n)::BIGINT AS area, count(*) AS nc FROM cm GROUP BY 1, 2),
tt AS (SELECT hu.*, cm.x - hu.x0 AS t, cm.m - hu.y0 AS m, CAST((cm.m - hu.y0) * 2 AS BIGINT) AS y2, greatest(hu.x1 - hu.x0 - 1, 1) AS w FROM cm JOIN hu USING (page_id, component)),
su AS (SELECT page_id, component, x0, y0, x1, y1, area, nc, w, nc::DOUBLE AS s0, sum(t)::DOUBLE AS s1, sum(t*t)::DOUBLE AS s2, sum(t*t*t)::DOUBLE AS s3, sum(t*t*t*t)::DOUBLE AS s4,
  sum(y2)::DOUBLE AS t0, sum(t*y2)::DOUBLE AS t1, sum(t*t*y2)::DOUBLE AS t2, sum(y2*y2)::DOUBLE AS yy,
  median(m) FILTER (t / w <= 0.15::DOUBLE) AS ly, median(m) FILTER (t / w >= 0.85::DOUBLE) AS ry FROM tt GROUP BY ALL),
de AS (SELECT *, s4*(s2*s0 - s1*s1) - s3*(s3*s0 - s1*s2) + s2*(s3*s1 - s2*s2) AS d FROM su),
ab AS (SELECT *, (t2*(s2*s0 - s1*s1) - s3*(t1*s0 - s1*t0) + s2*(t1*s1 - s2*t0)) / d AS a, (s4*(t1*s0 - s1*t0) - t2*(s3*s0 - s1*s2) + s2*(s3*t0 - t1*s2)) / d AS b,
  (s4*(s2*t0 - t1*s1) - s3*(s3*t0 - t1*s2) + t2*(s3*s1 - s2*s2)) / d AS c FROM de),
fe AS (SELECT *, (a*(w/2)*(w/2) + b*(w/2) + c) / 2 AS my, sqrt(greatest(0, yy - a*t2 - b*t1 - c*t0) / s0) / 2 AS rmse FROM ab)"""


@query("curve_features", with_views("curve_pixel", then=FEATURES) + """
SELECT page_id, component, x0, y1, area, nc AS n_columns, ly AS left_y, ry AS right_y, CAST(round(my * 1000) AS BIGINT) AS middle_1000, CAST(round(rmse * 1000) AS BIGINT) AS rmse_1000 FROM fe""")
def curve_features(spark, sf):
    return curves.curve_features(load(spark, sf, "curve_pixel")).select(
        "page_id", "component", "x0", "y1", "area", "n_columns", "left_y", "right_y",
        F.round(F.col("middle_y") * 1000).cast("long").alias("middle_1000"), F.round(F.col("rmse") * 1000).cast("long").alias("rmse_1000"))


@query("curve_gates", with_views("curve_pixel", then=FEATURES + """,
g AS (SELECT *, (ly + ry) / 2 - my AS sag, nc / greatest(x1 - x0, 1) AS cov, (x1 - x0)::DOUBLE AS wd, (y1 - y0)::DOUBLE AS ht FROM fe)""") + """
SELECT page_id, component, CASE WHEN sag > 0 THEN 'above' ELSE 'below' END AS direction,
  CAST(round(1000 * least(1, 0.2::DOUBLE + 0.25::DOUBLE * cov + 0.25::DOUBLE * least(1, abs(sag) / 4 / 0.65::DOUBLE) + 0.2::DOUBLE * greatest(0, 1 - rmse / 2.4::DOUBLE) + 0.1::DOUBLE * least(1, wd / 4 / 5))) AS BIGINT) AS conf_1000
FROM g WHERE wd / 4 BETWEEN 2 AND 18 AND ht / 4 BETWEEN 0.2 AND 4 AND wd / greatest(ht, 1) >= 1.8 AND cov >= 0.55 AND area / nc <= 3.5 AND nc >= 8
  AND abs(sag) / 4 BETWEEN 0.12 AND 2.8 AND rmse / 4 <= 0.6""")
def curve_gates(spark, sf):
    out = curves.gate_curves(curves.curve_features(load(spark, sf, "curve_pixel")).withColumn("unit", F.lit(4.0)))
    return out.select("page_id", "component", F.col("curve_direction").alias("direction"),
                      F.round(F.col("confidence") * 1000).cast("long").alias("conf_1000"))


CURVES = """grp AS (SELECT t.page_id, t.ng, t.x0, t.y0, t.x1, t.y1, (t.x0 + t.x1) / 2 AS cx, CASE WHEN t.is_rest = 1 THEN NULL ELSE t.pitch END AS pitch, s.staff_index, s.unit::DOUBLE AS unit
  FROM note t JOIN staff s USING (page_id)
  QUALIFY row_number() OVER (PARTITION BY t.page_id, t.ng ORDER BY NOT ((t.x0 + t.x1) / 2 BETWEEN s.left_x AND s.right_x),
    abs((t.y0 + t.y1) / 2 - (s.y_top + 2 * s.unit)), s.staff_index) = 1),
ends AS (SELECT page_id, candidate_id, staff_index, unit, conf_pct, 'l' AS e, left_x AS ex, left_y AS ey FROM curve UNION ALL
  SELECT page_id, candidate_id, staff_index, unit, conf_pct, 'r', right_x, right_y FROM curve),
me AS (SELECT e.*, g.ng, g.cx, g.pitch, 1.5::DOUBLE * (abs(e.ex - g.cx) / e.unit) + 0.35::DOUBLE * (greatest(0, g.y0 - e.ey, e.ey - g.y1) / e.unit) AS cost
  FROM ends e JOIN grp g ON g.page_id = e.page_id AND g.staff_index = e.staff_index
  WHERE abs(e.ex - g.cx) / e.unit <= 2.5 AND greatest(0, g.y0 - e.ey, e.ey - g.y1) / e.unit <= 5.5
  QUALIFY row_number() OVER (PARTITION BY e.page_id, e.candidate_id, e.e ORDER BY cost, g.ng) = 1),
lr AS (SELECT c.page_id, c.candidate_id, c.staff_index, c.unit, c.conf_pct, l.ng AS ln, r.ng AS rn, l.cx AS lc, r.cx AS rc, l.pitch AS lp, r.pitch AS rp, l.cost AS lcost, r.cost AS rcost
  FROM curve c LEFT JOIN me l ON l.page_id = c.page_id AND l.candidate_id = c.candidate_id AND l.e = 'l' LEFT JOIN me r ON r.page_id = c.page_id AND r.candidate_id = c.candidate_id AND r.e = 'r'),
bt AS (SELECT lr.*, (SELECT count(*) FROM grp g WHERE g.page_id = lr.page_id AND g.staff_index = lr.staff_index AND g.cx > lr.lc AND g.cx < lr.rc) AS nb FROM lr),
cc AS (SELECT *, CASE WHEN ln IS NULL OR rn IS NULL THEN 'one_or_both_endpoints_unmatched' WHEN ln = rn OR lc >= rc THEN 'endpoints_do_not_span_distinct_ordered_notes'
  WHEN lp IS NULL OR rp IS NULL THEN 'endpoint_pitch_unknown' WHEN lp = rp AND nb = 0 AND (rc - lc) / unit <= 6.5 THEN 'same_pitch_adjacent_notes_and_tie_sized_span'
  WHEN lp = rp THEN 'same_pitch_but_nonadjacent_or_long_span' ELSE 'endpoint_pitch_sets_differ' END AS reason FROM bt),
ct AS (SELECT *, reason NOT IN ('one_or_both_endpoints_unmatched', 'endpoints_do_not_span_distinct_ordered_notes') AS ok,
  CASE reason WHEN 'endpoint_pitch_unknown' THEN 'unknown_curve' WHEN 'same_pitch_adjacent_notes_and_tie_sized_span' THEN 'tie'
    WHEN 'same_pitch_but_nonadjacent_or_long_span' THEN 'slur' WHEN 'endpoint_pitch_sets_differ' THEN 'slur' ELSE '' END AS kind,
  conf_pct::DOUBLE / 100 * least(1.0::DOUBLE / (1.0::DOUBLE + lcost), 1.0::DOUBLE / (1.0::DOUBLE + rcost)) AS rconf FROM cc),
ce AS (SELECT *, ok AND kind <> 'unknown_curve' AND rconf >= 0.45 AS eligible FROM ct)"""


def _curves(spark, sf):
    notes = load(spark, sf, "note").select(
        "page_id", "ng", *box(), F.when(F.col("is_rest") == 1, F.array().cast("array<bigint>")).otherwise(F.array("pitch")).alias("pitches"))
    cand = load(spark, sf, "curve").withColumn("confidence", F.col("conf_pct").cast("double") / 100).withColumn(
        "unit", F.col("unit").cast("double"))
    return curves.associate_curves(cand, notes, staves(spark, sf))


@query("curve_association", with_views("note", "staff", "curve", then=CURVES) + """
SELECT page_id, candidate_id, CASE WHEN ok THEN ln ELSE -1 END AS left_ng, CASE WHEN ok THEN rn ELSE -1 END AS right_ng, kind AS predicted_type, reason,
  CASE WHEN ok THEN CAST(floor(rconf * 1000000) AS BIGINT) ELSE -1 END AS conf_millionths, CASE WHEN ok THEN nb ELSE -1 END AS n_between, eligible FROM ce""")
def curve_association(spark, sf):
    return _curves(spark, sf).select(
        "page_id", "candidate_id", "left_ng", "right_ng", "predicted_type", F.col("classification_reason").alias("reason"),
        F.floor(F.col("relation_confidence") * 1000000).alias("conf_millionths"),
        F.col("intermediate_note_group_count").alias("n_between"), F.coalesce("xml_eligible", F.lit(False)).alias("eligible")).fillna(-1).fillna("")


@query("curve_classification", with_views("note", "staff", "curve", then=CURVES) + """
SELECT kind AS predicted_type, reason, count(*) AS n, count(*) FILTER (eligible) AS n_eligible FROM ce GROUP BY 1, 2""")
def curve_classification(spark, sf):
    return _curves(spark, sf).groupBy(F.coalesce("predicted_type", F.lit("")).alias("predicted_type"), F.col("classification_reason").alias("reason")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("xml_eligible"), 1)).alias("n_eligible"))


@query("curve_counts", with_views("note", "staff", "curve", then=CURVES) + """
SELECT page_id, count(*) AS candidate_count, count(*) FILTER (ok) AS matched_count, count(*) FILTER (NOT ok) AS unmatched_count, count(*) FILTER (eligible) AS xml_eligible_count,
  count(*) FILTER (ok AND NOT eligible) AS xml_suppressed_count, count(*) FILTER (kind = 'tie') AS tie_count, count(*) FILTER (kind = 'slur') AS slur_count FROM ce GROUP BY 1""")
def curve_counts(spark, sf):
    return curves.curve_counts(_curves(spark, sf))


@query("relation_numbers", with_views("note", "staff", "curve", then=CURVES) + """
SELECT page_id, candidate_id, row_number() OVER (PARTITION BY page_id ORDER BY candidate_id) AS number FROM ce WHERE ok""")
def relation_numbers(spark, sf):
    return curves.number_relations(_curves(spark, sf), block=1 << 45).select("page_id", "candidate_id", "number")


@query("tie_finalize", with_views("note", "staff", "curve", then=CURVES + """,
tg AS (SELECT page_id, list({'s': ln, 't': rn, 'c': candidate_id} ORDER BY rconf DESC, candidate_id) AS l FROM ce WHERE kind = 'tie' AND eligible GROUP BY 1),
tf AS (SELECT page_id, unnest(list_reduce(list_transform(l, lambda b: [b]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.s = x[1].s OR k.t = x[1].t)) > 0
  THEN acc ELSE list_append(acc, x[1]) END)) AS u FROM tg)""") + """
SELECT page_id, u.s AS start_ng, u.t AS stop_ng, u.c AS candidate_id FROM tf""")
def tie_finalize(spark, sf):
    return curves.finalize_ties(_curves(spark, sf))


@query("start_stop_parity", with_views("note", "staff", "curve", then=CURVES) + """
SELECT 'slur' AS mark, count(*) FILTER (kind = 'slur' AND eligible) AS starts, count(*) FILTER (kind = 'slur' AND eligible) AS stops FROM ce""")
def start_stop_parity(spark, sf):
    ends = curves.slur_endpoints(_curves(spark, sf).withColumn("number", F.lit(0)))
    return ends.groupBy(F.lit("slur").alias("mark")).agg(
        F.count(F.when(F.col("role") == "start", 1)).alias("starts"), F.count(F.when(F.col("role") == "stop", 1)).alias("stops"))
