"""Symbols, hairpins and staffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions.boxes import box
from scorelake.functions.vocabulary import CLASS_CONFIDENCE, SPANNING_CLASSES
from scorelake.operators import associate, detect, staffs
from scorelake.plans.common import CLASS_MAP_SQL, class_map, detections, per_mille, staves
from scorelake.plans.derived import load, with_views
from scorelake.plans.registry import query

SUPPORTED = ", ".join(f"'{c}'" for c in CLASS_CONFIDENCE if c not in SPANNING_CLASSES)

NEAREST = """SELECT d.page_id, d.det_seq, s.staff_index, s.unit FROM det d JOIN staff s USING (page_id)
QUALIFY row_number() OVER (PARTITION BY d.page_id, d.det_seq ORDER BY NOT ((d.x0 + d.x1) / 2 BETWEEN s.left_x AND s.right_x),
  abs((d.y0 + d.y1) / 2 - (s.y_top + 2 * s.unit)), s.staff_index) = 1"""


@query("nearest_staff", with_views("det", "staff") + NEAREST)
def nearest_staff(spark, sf):
    b = box()
    det = load(spark, sf, "det").select("page_id", "det_seq", *b)
    return staffs.locate_on_staff(det, staves(spark, sf), x=b.cx, y=b.cy).select(
        "page_id", "det_seq", "staff_index", F.col("unit").cast("long").alias("unit"))


def _full_staves(spark, sf):
    return staves(spark, sf).select(
        "page_id", "staff_index", "center_y", F.lit(980.0).alias("x_center"), F.col("y_top").alias("y_upper"),
        (F.col("y_top") + 4 * F.col("unit")).alias("y_lower"), (F.col("unit") + F.col("staff_index") % 3).alias("unit"))


CLOSEST = """st AS (SELECT page_id, staff_index, y_top + 2 * unit AS c, y_top AS up, y_top + 4 * unit AS low, unit + staff_index % 3 AS u FROM staff),
r AS (SELECT g.page_id, g.gt_seq, (g.x0 + g.x1) / 2 AS x, (g.y0 + g.y1) / 2 AS y, st.*, row_number() OVER (PARTITION BY g.page_id, g.gt_seq
  ORDER BY (980 - (g.x0 + g.x1) / 2) * (980 - (g.x0 + g.x1) / 2) + (st.c - (g.y0 + g.y1) / 2) * (st.c - (g.y0 + g.y1) / 2), staff_index) AS k
  FROM gt g JOIN st ON st.page_id = g.page_id),
f AS (SELECT * FROM r WHERE k = 1), o AS (SELECT r.page_id, r.gt_seq, r.k, r.c, r.u, r.staff_index FROM r WHERE k IN (2, 3)),
p AS (SELECT f.page_id, f.gt_seq, f.y, f.staff_index AS s1, f.c AS c1, f.u AS u1, f.up, f.low,
  min(CASE WHEN CASE WHEN abs(f.low - f.y) <= abs(f.up - f.y) THEN o.c > f.c ELSE o.c < f.c END THEN o.k END) AS k2
  FROM f JOIN o ON o.page_id = f.page_id AND o.gt_seq = f.gt_seq GROUP BY ALL),
q AS (SELECT p.*, coalesce(o.staff_index, p.s1) AS s2, coalesce(o.c, p.c1) AS c2, coalesce(o.u, p.u1) AS u2 FROM p LEFT JOIN o
  ON o.page_id = p.page_id AND o.gt_seq = p.gt_seq AND o.k = p.k2)"""


@query("two_closest_staffs", with_views("gt", "staff", then=CLOSEST) + "SELECT page_id, gt_seq, s1, s2 FROM q")
def two_closest_staffs(spark, sf):
    b = box()
    pts = load(spark, sf, "gt").select("page_id", "gt_seq", b.cx.alias("x"), b.cy.alias("y"))
    return staffs.closest_staffs(pts, _full_staves(spark, sf), point_id="gt_seq").select(
        "page_id", "gt_seq", F.col("first.staff_index").alias("s1"), F.col("second.staff_index").alias("s2"))


@query("unit_size", with_views("gt", "staff", then=CLOSEST) + """SELECT page_id, gt_seq, CAST(floor(1000 * CASE WHEN c1 = c2 OR y BETWEEN up AND low THEN u1::DOUBLE
  ELSE abs(y - c1) / (abs(y - c1) + abs(y - c2)) * u1 + abs(y - c2) / (abs(y - c1) + abs(y - c2)) * u2 END) AS BIGINT) AS unit_1000 FROM q""")
def unit_size(spark, sf):
    b = box()
    pts = load(spark, sf, "gt").select("page_id", "gt_seq", b.cx.alias("x"), b.cy.alias("y"))
    near = staffs.closest_staffs(pts, _full_staves(spark, sf), point_id="gt_seq")
    return near.select("page_id", "gt_seq", F.floor(staffs.unit_size(near) * 1000).alias("unit_1000"))


ASSOC = f"""cand AS (SELECT d.page_id, d.det_seq, cm.class_name, cm.side, d.x0, d.y0, d.x1, d.y1, d.conf_pct::DOUBLE / 100 AS conf, n.staff_index
  FROM det d JOIN cm USING (class_id) JOIN (%s) n ON n.page_id = d.page_id AND n.det_seq = d.det_seq),
grp AS (SELECT t.page_id, t.ng, t.x0, t.y0, t.x1, t.y1, s.staff_index, s.unit::DOUBLE AS unit FROM note t JOIN staff s USING (page_id)
  QUALIFY row_number() OVER (PARTITION BY t.page_id, t.ng ORDER BY NOT ((t.x0 + t.x1) / 2 BETWEEN s.left_x AND s.right_x),
    abs((t.y0 + t.y1) / 2 - (s.y_top + 2 * s.unit)), s.staff_index) = 1),
pairs AS (SELECT c.*, g.ng, abs((c.x0 + c.x1) / 2 - (g.x0 + g.x1) / 2) / g.unit AS dx,
  CASE c.side WHEN 'above' THEN greatest(0, g.y0 - c.y1) WHEN 'below' THEN greatest(0, c.y0 - g.y1)
    ELSE greatest(0, g.y0 - c.y1, c.y0 - g.y1) END / g.unit AS gap
  FROM cand c JOIN grp g ON g.page_id = c.page_id AND g.staff_index = c.staff_index
  WHERE c.class_name IN ({SUPPORTED}) AND CASE c.side WHEN 'above' THEN c.y0 + c.y1 <= g.y0 + g.y1 WHEN 'below' THEN c.y0 + c.y1 >= g.y0 + g.y1 ELSE TRUE END),
near AS (SELECT *, dx + 0.35::DOUBLE * gap + 0.15::DOUBLE * (1.0::DOUBLE - conf) AS cost FROM pairs WHERE dx <= 2.5 AND gap <= 4.0
  QUALIFY row_number() OVER (PARTITION BY page_id, det_seq ORDER BY cost, ng) = 1),
res AS (SELECT c.page_id, c.det_seq, c.class_name, n.ng AS matched_ng, n.cost, 1.0::DOUBLE / (1.0::DOUBLE + n.cost) AS score,
  CASE WHEN n.ng IS NULL THEN 'rejected' ELSE 'matched' END AS status,
  CASE WHEN c.class_name NOT IN ({SUPPORTED}) THEN 'unsupported_class' WHEN n.ng IS NULL THEN 'no_plausible_note_group' END AS reason
  FROM cand c LEFT JOIN near n ON n.page_id = c.page_id AND n.det_seq = c.det_seq)""" % NEAREST

DEDUP = """, ded AS (SELECT *, CASE WHEN matched_ng IS NOT NULL THEN row_number() OVER (PARTITION BY page_id, matched_ng, class_name, matched_ng IS NULL ORDER BY score DESC, det_seq) END AS k FROM res)"""


def _candidates(spark, sf):
    mapped = detect.map_classes(detections(spark, sf), class_map(spark))
    return mapped.select("page_id", F.col("det_seq").alias("cand_seq"), "class_name", "side", *box(), "confidence")


def _associated(spark, sf):
    notes = load(spark, sf, "note").select("page_id", "ng", *box())
    return associate.associate_symbols(_candidates(spark, sf), notes, staves(spark, sf))


@query("symbol_association", with_views("det", "note", "staff", then=CLASS_MAP_SQL + ", " + ASSOC) + f"""
SELECT page_id, det_seq, class_name, coalesce(matched_ng, -1) AS matched_ng, coalesce({per_mille('score')}, -1) AS score_millionths, status, coalesce(reason, '') AS reason FROM res""")
def symbol_association(spark, sf):
    return _associated(spark, sf).select(
        "page_id", F.col("cand_seq").alias("det_seq"), "class_name", "matched_ng",
        F.floor(F.col("association_score") * 1000000).alias("score_millionths"),
        F.col("association_status").alias("status"), F.col("association_reason").alias("reason")).fillna(-1).fillna("")


@query("association_dedup", with_views("det", "note", "staff", then=CLASS_MAP_SQL + ", " + ASSOC + DEDUP) + """
SELECT page_id, det_seq, CASE WHEN k = 1 THEN matched_ng ELSE -1 END AS matched_ng, CASE WHEN k > 1 THEN 'rejected' ELSE status END AS status,
  CASE WHEN k > 1 THEN 'duplicate_for_note_group' ELSE coalesce(reason, '') END AS reason FROM ded""")
def association_dedup(spark, sf):
    return associate.keep_best(_associated(spark, sf)).select(
        "page_id", F.col("cand_seq").alias("det_seq"), "matched_ng", F.col("association_status").alias("status"),
        F.col("association_reason").alias("reason")).fillna(-1).fillna("")


@query("association_summary", with_views("det", "note", "staff", then=CLASS_MAP_SQL + ", " + ASSOC + DEDUP) + """
SELECT class_name, count(*) AS candidate_count, count(*) FILTER (k = 1) AS matched_count, count(*) - count(*) FILTER (k = 1) AS rejected_count
FROM ded GROUP BY 1""")
def association_summary(spark, sf):
    return associate.association_summary(associate.keep_best(_associated(spark, sf)), ["class_name"])


@query("association_page_summary", with_views("det", "note", "staff", then=CLASS_MAP_SQL + ", " + ASSOC + DEDUP) + """
SELECT coalesce(page_id, -1) AS page_id, count(*) AS candidate_count, count(*) FILTER (k = 1) AS matched_count, count(*) - count(*) FILTER (k = 1) AS rejected_count
FROM ded GROUP BY ROLLUP (page_id)""")
def association_page_summary(spark, sf):
    done = associate.keep_best(_associated(spark, sf))
    matched = F.count(F.when(F.col("association_status") == "matched", 1))
    return done.rollup("page_id").agg(F.count("*").alias("candidate_count"), matched.alias("matched_count"),
                                      (F.count("*") - matched).alias("rejected_count")).fillna(-1)


HAIRPIN = """pin AS (SELECT d.page_id, d.det_seq, cm.class_name, d.x0, d.y0, d.x1 + 160 AS x1, d.y1 FROM det d JOIN cm USING (class_id)
  WHERE cm.class_name IN ('crescendo', 'diminuendo')),
hs AS (SELECT d.*, s.staff_index FROM pin d JOIN staff s USING (page_id)
  QUALIFY row_number() OVER (PARTITION BY d.page_id, d.det_seq ORDER BY NOT ((d.x0 + d.x1) / 2 BETWEEN s.left_x AND s.right_x),
    abs((d.y0 + d.y1) / 2 - (s.y_top + 2 * s.unit)), s.staff_index) = 1),
grp AS (SELECT t.page_id, t.ng, (t.x0 + t.x1) / 2 AS cx, (t.y0 + t.y1) / 2 AS cy, s.staff_index, s.unit::DOUBLE AS unit FROM note t JOIN staff s USING (page_id)
  QUALIFY row_number() OVER (PARTITION BY t.page_id, t.ng ORDER BY NOT ((t.x0 + t.x1) / 2 BETWEEN s.left_x AND s.right_x),
    abs((t.y0 + t.y1) / 2 - (s.y_top + 2 * s.unit)), s.staff_index) = 1),
hp AS (SELECT h.*, count(g.ng) AS pool,
  min({'d': abs(g.cx - h.x0), 'id': g.ng, 'cy': g.cy, 'u': g.unit}) AS l, min({'d': abs(g.cx - h.x1), 'id': g.ng, 'cy': g.cy, 'u': g.unit}) AS r
  FROM hs h LEFT JOIN grp g ON g.page_id = h.page_id AND g.staff_index = h.staff_index GROUP BY ALL),
hr AS (SELECT *, CASE WHEN pool < 2 THEN 'not_enough_note_groups_for_span' WHEN l.id = r.id THEN 'span_endpoints_not_distinct'
  WHEN greatest(l.d / l.u, r.d / r.u) > 3.75 THEN 'span_endpoints_too_far' END AS reason FROM hp)"""


def _hairpins(spark, sf):
    pins = _candidates(spark, sf).filter(F.col("class_name").isin(*SPANNING_CLASSES)).withColumn("x1", F.col("x1") + 160)
    return associate.associate_hairpins(pins, load(spark, sf, "note").select("page_id", "ng", *box()), staves(spark, sf))


@query("hairpin_association", with_views("det", "note", "staff", then=CLASS_MAP_SQL + ", " + HAIRPIN) + f"""
SELECT page_id, det_seq, class_name, CASE WHEN reason IS NULL THEN l.id ELSE -1 END AS start_ng, CASE WHEN reason IS NULL THEN r.id ELSE -1 END AS stop_ng,
  CASE WHEN reason IS NULL THEN 'matched' ELSE 'rejected' END AS status, coalesce(reason, '') AS reason,
  CASE WHEN reason IS NULL THEN {per_mille('1.0::DOUBLE / (1.0::DOUBLE + l.d / l.u + r.d / r.u)')} ELSE -1 END AS score_millionths,
  CASE WHEN reason IS NULL THEN CASE WHEN (y0 + y1) / 2 < (l.cy + r.cy) / 2 THEN 'above' ELSE 'below' END ELSE '' END AS resolved_side FROM hr""")
def hairpin_association(spark, sf):
    return _hairpins(spark, sf).select(
        "page_id", F.col("cand_seq").alias("det_seq"), "class_name", "start_ng", "stop_ng",
        F.col("association_status").alias("status"), F.col("association_reason").alias("reason"),
        F.floor(F.col("association_score") * 1000000).alias("score_millionths"), "resolved_side").fillna(-1).fillna("")


@query("hairpin_roles", with_views("det", "note", "staff", then=CLASS_MAP_SQL + ", " + HAIRPIN) + """
SELECT page_id, det_seq, 'start' AS role, l.id AS ng FROM hr WHERE reason IS NULL UNION ALL
SELECT page_id, det_seq, 'stop', r.id FROM hr WHERE reason IS NULL""")
def hairpin_roles(spark, sf):
    return associate.hairpin_roles(_hairpins(spark, sf)).select("page_id", F.col("cand_seq").alias("det_seq"), "role", "ng")


@query("symbol_sides", with_views("det", "note", "staff", then=CLASS_MAP_SQL + ", " + ASSOC) + """
SELECT coalesce(c.side, CASE WHEN c.y0 + c.y1 < g.y0 + g.y1 THEN 'above' ELSE 'below' END) AS side, r.class_name, count(*) AS n
FROM res r JOIN cand c ON c.page_id = r.page_id AND c.det_seq = r.det_seq JOIN grp g ON g.page_id = r.page_id AND g.ng = r.matched_ng GROUP BY 1, 2""")
def symbol_sides(spark, sf):
    done = _associated(spark, sf).filter("association_status = 'matched'")
    return done.groupBy(associate.resolved_side().alias("side"), "class_name").agg(F.count("*").alias("n"))
