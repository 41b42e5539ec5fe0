"""Slurs, ties, wedges and pedal in the score."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import music
from scorelake.operators import associate, curves, score, spans
from scorelake.plans.common import CLASS_MAP_SQL
from scorelake.plans.derived import load, with_views
from scorelake.plans.queries_associate import ASSOC, DEDUP, HAIRPIN, _associated, _hairpins
from scorelake.plans.queries_bars import CARRY, altered
from scorelake.plans.queries_curves import CURVES, _curves
from scorelake.plans.registry import query
from scorelake.session import cut_lineage

# Events of a piece: the heads of a slot are one chord. Twenty pages are a piece; a position is a slot of a part's measures.
PLACE = """page_id // 20 AS piece, track AS part, page_id % 20 * 8 + system_no * 4 + slot // 4 AS measure, (page_id % 20 * 8 + system_no * 4) * 4 + slot AS pos"""
CHORDS = CARRY + f""",
e1 AS (SELECT {PLACE}, page_id, ng, is_rest, steps, '<pitch><step>' || ['C','D','E','F','G','A','B'][step + 1] || '</step>' || CASE alter WHEN 1 THEN '<alter>1</alter>' WHEN -1 THEN '<alter>-1</alter>' ELSE '' END || '<octave>' || octave || '</octave></pitch>' AS pi,
  ['C','D','E','F','G','A','B'][step + 1] || CASE alter WHEN 1 THEN '#' WHEN -1 THEN '-' ELSE '' END || octave AS nm,
  CASE WHEN qty % 13 = 0 THEN 0 ELSE CAST([20160, 10080, 5040, 2520][rhythm + 1] * CASE WHEN has_dot = 1 THEN 1.5::DOUBLE ELSE 1 END AS BIGINT) END AS ticks FROM av),
ch AS (SELECT piece, part, measure, pos, coalesce(max(ticks) FILTER (is_rest = 0), max(ticks)) AS ticks, coalesce(list(DISTINCT {{'s': steps, 'n': nm, 'p': pi}} ORDER BY {{'s': steps, 'n': nm, 'p': pi}}) FILTER (is_rest = 0), []) AS ps
  FROM e1 WHERE ticks > 0 GROUP BY 1, 2, 3, 4),
pl AS (SELECT e1.page_id, e1.ng, ch.piece, ch.part, ch.pos, len(ps) AS n_pitches FROM e1 JOIN ch USING (piece, part, pos) WHERE e1.ticks > 0 AND (e1.is_rest = 0 OR len(ps) = 0))"""

TIES = """tg AS (SELECT page_id, list({'s': ln, 't': rn, 'c': candidate_id} ORDER BY rconf DESC, candidate_id) AS l FROM ce WHERE kind = 'tie' AND eligible GROUP BY 1),
tf AS (SELECT page_id, unnest(list_reduce(list_transform(l, lambda b: [b]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.s = x[1].s OR k.t = x[1].t)) > 0
  THEN acc ELSE list_append(acc, x[1]) END)) AS u FROM tg)"""

# Both ends of every span with the place of its note; `n` is the number of pitches there.
ENDS = """rl AS (SELECT page_id, 'slur' AS kind, candidate_id AS span_id, curve_direction AS placement, ln AS s, rn AS t FROM ce JOIN curve USING (page_id, candidate_id) WHERE ce.kind = 'slur' AND eligible
  UNION ALL SELECT page_id, 'tie', u.c, NULL::VARCHAR, u.s, u.t FROM tf
  UNION ALL SELECT page_id, class_name, det_seq, CASE WHEN (y0 + y1) / 2 < (l.cy + r.cy) / 2 THEN 'above' ELSE 'below' END, l.id, r.id FROM hr WHERE reason IS NULL),
en AS (SELECT r.page_id // 20 AS piece, r.page_id, r.kind, r.span_id, r.placement, 'start' AS role, p.part, p.pos, p.n_pitches FROM rl r JOIN pl p ON p.page_id = r.page_id AND p.ng = r.s
  UNION ALL SELECT r.page_id // 20, r.page_id, r.kind, r.span_id, r.placement, 'stop', p.part, p.pos, p.n_pitches FROM rl r JOIN pl p ON p.page_id = r.page_id AND p.ng = r.t),
el AS (SELECT * FROM en WHERE kind <> 'tie' OR n_pitches = 1)"""
SPANS = ENDS + """,
sp AS (SELECT a.piece, a.part, a.page_id, a.kind, CASE WHEN a.kind IN ('crescendo', 'diminuendo') THEN 'wedge' ELSE a.kind END AS lane, a.span_id, a.placement, a.pos AS start, b.pos AS stop FROM el a JOIN el b USING (piece, part, page_id, kind, span_id) WHERE a.role = 'start' AND b.role = 'stop' AND a.pos < b.pos),
so AS (SELECT *, row_number() OVER (PARTITION BY piece, part, lane ORDER BY start, page_id, span_id) AS i FROM sp),
sw AS (SELECT piece, part, lane, i, [stop] AS open, 1 AS number FROM so WHERE i = 1
  UNION ALL
  SELECT n.piece, n.part, n.lane, n.i, CASE WHEN k > len(w.open) THEN list_append(w.open, n.stop) ELSE list_transform(w.open, lambda x, j: CASE WHEN j = k THEN n.stop ELSE x END) END, k
  FROM (SELECT w.*, coalesce(list_position(list_transform(w.open, lambda x: x < n.start), true), len(w.open) + 1) AS k FROM sw w JOIN so n ON n.piece = w.piece AND n.part = w.part AND n.lane = w.lane AND n.i = w.i + 1) w
  JOIN so n ON n.piece = w.piece AND n.part = w.part AND n.lane = w.lane AND n.i = w.i + 1),
nu AS (SELECT so.*, sw.number FROM so JOIN sw USING (piece, part, lane, i))"""

ALL = CLASS_MAP_SQL + ", " + CURVES + ", " + TIES + ", " + HAIRPIN.replace("grp", "hgrp") + ", " + CHORDS + ", "


def _places(notes):
    """Piece, part and position of notes, and how long they sound."""
    rest = F.col("is_rest") == 1
    first = F.col("page_id") % 20 * 8 + F.col("system_no") * 4
    return notes.withColumns({
        "piece": F.floor(F.col("page_id") / 20), "part": F.col("track"), "measure": first + F.floor(F.col("slot") / 4), "pos": first * 4 + F.col("slot"),
        "kind": F.when(rest, "rest").otherwise("note"), "ticks": F.when(F.col("qty") % 13 == 0, 0).otherwise(music.ticks(F.col("rhythm"), F.col("has_dot") == 1, rest))})


def _elements(spark, sf):
    step, octave = music.step_of(F.col("steps")), music.octave_of(F.col("steps"))
    return _places(altered(spark, sf)).select("piece", "part", "measure", "pos", "kind", "steps", music.pitch_name(step, octave, F.col("alter")).alias("pitch"), "ticks")


def _score(spark, sf):
    """Events of all pieces, and the place of each of their notes, which needs no pitches."""
    events = cut_lineage(score.chord_events(_elements(spark, sf)))
    at = events.select("piece", "part", F.col("seq").alias("pos"), F.col("kind").alias("event"), F.size("pitches").alias("n_pitches"))
    placed = _places(load(spark, sf, "note")).filter("ticks > 0").join(at, ["piece", "part", "pos"]).filter("kind = event")
    return events, placed.select("piece", "part", "pos", "n_pitches", F.struct("page_id", "ng").alias("ref_id"))


def _located(spark, sf, placed):
    """Ends of slurs, ties and wedges at their notes. Ties hold between single notes only."""
    page = F.floor(F.col("page_id") / 20).alias("piece")
    ref = lambda name: F.struct("page_id", F.col(name).alias("ng"))
    related = cut_lineage(_curves(spark, sf).filter("xml_eligible"))
    slurs = related.filter("predicted_type = 'slur'").select(page, F.lit("slur").alias("kind"), F.struct("page_id", "candidate_id").alias("span_id"),
                                                            F.col("curve_direction").alias("placement"), ref("left_ng").alias("start_ref"), ref("right_ng").alias("stop_ref"))
    ties = curves.finalize_ties(related).select(page, F.lit("tie").alias("kind"), F.struct("page_id", "candidate_id").alias("span_id"),
                                                F.lit(None).cast("string").alias("placement"), ref("start_ng").alias("start_ref"), ref("stop_ng").alias("stop_ref"))
    wedges = _hairpins(spark, sf).filter("association_status = 'matched'").select(
        page, F.col("class_name").alias("kind"), F.struct("page_id", F.col("cand_seq").alias("candidate_id")).alias("span_id"),
        F.col("resolved_side").alias("placement"), ref("start_ng").alias("start_ref"), ref("stop_ng").alias("stop_ref"))
    ends = spans.endpoints(slurs.unionByName(ties).unionByName(wedges))
    return spans.locate(ends, placed, (F.col("kind") != "tie") | (F.col("n_pitches") == 1))


@query("span_numbers", with_views("det", "note", "staff", "curve", then=ALL + SPANS, recursive=True) + """
SELECT piece, part, kind, page_id, span_id, start, stop, number FROM nu""")
def span_numbers(spark, sf):
    _, placed = _score(spark, sf)
    done = spans.numbered(spans.complete(_located(spark, sf, placed)))
    return done.select("piece", "part", "kind", "span_id.page_id", F.col("span_id.candidate_id").alias("span_id"), "start", "stop", "number")


@query("span_parity", with_views("det", "note", "staff", "curve", then=ALL + ENDS) + """
SELECT kind AS mark, count(*) FILTER (role = 'start') AS starts, count(*) FILTER (role = 'stop') AS stops,
  (SELECT count(*) FROM el a JOIN el b USING (piece, part, page_id, kind, span_id) WHERE a.role = 'start' AND b.role = 'stop' AND a.kind = el.kind) AS both FROM el GROUP BY kind""")
def span_parity(spark, sf):
    _, placed = _score(spark, sf)
    return spans.parity(_located(spark, sf, placed)).select(F.col("kind").alias("mark"), "starts", "stops", "both")


@query("notations_xml", with_views("det", "note", "staff", "curve", then=ALL + SPANS + """,
ev AS (SELECT piece, part, 0 AS o, number, kind, 'stop' AS role, NULL::VARCHAR AS placement, stop AS place FROM nu UNION ALL SELECT piece, part, 1, number, kind, 'start', placement, start FROM nu),
mk AS (SELECT piece, part, place AS pos,
  coalesce(string_agg(DISTINCT CASE WHEN kind = 'tie' THEN '<tie type="' || role || '"/>' END, '' ORDER BY CASE WHEN kind = 'tie' THEN '<tie type="' || role || '"/>' END DESC), '') AS ties,
  coalesce(string_agg(CASE WHEN kind = 'slur' THEN '<slur number="' || number || '"' || coalesce(' placement="' || placement || '"', '') || ' type="' || role || '"/>' END, '' ORDER BY o, number), '') AS slurs,
  coalesce(string_agg(CASE WHEN kind IN ('crescendo', 'diminuendo') THEN '<direction' || coalesce(' placement="' || placement || '"', '') || '><direction-type><wedge type="' || CASE role WHEN 'stop' THEN 'stop' ELSE kind END || '" number="' || number || '"/></direction-type></direction>' END, '' ORDER BY o, number, kind), '') AS before
  FROM ev GROUP BY 1, 2, 3),
ty AS (SELECT ch.*, coalesce(ties, '') AS ties, coalesce(slurs, '') AS slurs, coalesce(before, '') AS before, '<duration>' || ticks || '</duration>' AS du,
  CASE ticks WHEN 20160 THEN '<type>quarter</type>' WHEN 30240 THEN '<type>quarter</type><dot/>' WHEN 10080 THEN '<type>eighth</type>' WHEN 15120 THEN '<type>eighth</type><dot/>'
    WHEN 5040 THEN '<type>16th</type>' WHEN 7560 THEN '<type>16th</type><dot/>' WHEN 2520 THEN '<type>32nd</type>' WHEN 3780 THEN '<type>32nd</type><dot/>' ELSE '' END AS ty FROM ch LEFT JOIN mk USING (piece, part, pos)),
xx AS (SELECT piece, part, measure, pos, before || CASE WHEN len(ps) = 0 THEN '<note><rest/>' || du || ty || '</note>' ELSE array_to_string(list_transform(ps, lambda p, i: '<note>' || CASE WHEN i > 1 THEN '<chord/>' ELSE '' END || p.p || du
  || CASE WHEN i = 1 THEN ties ELSE '' END || ty || CASE WHEN i = 1 AND ties || slurs <> '' THEN '<notations>' || replace(ties, '<tie ', '<tied ') || slurs || '</notations>' ELSE '' END || '</note>'), '') END AS x FROM ty)""", recursive=True) + """
SELECT piece, part, measure, '<measure number="' || (measure + 1) || '">' || string_agg(x, '' ORDER BY pos) || '</measure>' AS xml FROM xx GROUP BY 1, 2, 3""")
def notations_xml(spark, sf):
    events, placed = _score(spark, sf)
    done = spans.numbered(spans.complete(_located(spark, sf, placed)))
    marks = spans.span_marks(done).withColumnRenamed("pos", "seq")
    events = events.join(marks, ["piece", "part", "seq"], "left").withColumn("marks", F.lit(None).cast("array<struct<element:string,placement:string,detail:string>>"))
    return score.measures_xml(events, spans=True)


PEDAL = CLASS_MAP_SQL + ", " + ASSOC + DEDUP + ", " + CARRY + f""",
pp AS (SELECT page_id // 20 AS piece, track AS part, (page_id % 20 * 8 + system_no * 4) * 4 + slot AS pos, CASE class_name WHEN 'pedal_start' THEN 1 ELSE -1 END AS step, det_seq, page_id
  FROM ded JOIN (SELECT page_id, ng AS matched_ng, track, system_no, slot FROM note) USING (page_id, matched_ng) WHERE k = 1 AND class_name IN ('pedal_start', 'pedal_stop')),
ps AS (SELECT *, sum(step) OVER (PARTITION BY piece, part ORDER BY pos, step, page_id, det_seq ROWS UNBOUNDED PRECEDING) AS s FROM pp),
pd AS (SELECT *, s + greatest(0, coalesce(max(-s) OVER (PARTITION BY piece, part ORDER BY pos, step, page_id, det_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) + CASE WHEN step < 0 THEN 1 ELSE 0 END AS depth FROM ps)"""


def _pedal(spark, sf):
    done = associate.keep_best(_associated(spark, sf)).filter("association_status = 'matched' AND class_name IN ('pedal_start', 'pedal_stop')")
    notes = load(spark, sf, "note").select("page_id", F.col("ng").alias("matched_ng"), F.floor(F.col("page_id") / 20).alias("piece"), F.col("track").alias("part"),
                                           ((F.col("page_id") % 20 * 8 + F.col("system_no") * 4) * 4 + F.col("slot")).alias("pos"))
    return done.select("page_id", "cand_seq", "matched_ng", "class_name").join(notes, ["page_id", "matched_ng"]).select(
        "piece", "part", "pos", F.when(F.col("class_name") == "pedal_start", "start").otherwise("stop").alias("role"), F.struct("page_id", "cand_seq").alias("point_id"), "class_name")


@query("pedal_pairs", with_views("det", "note", "staff", then=PEDAL) + """
SELECT piece, part, (SELECT max(b.pos) FROM pd b WHERE b.piece = a.piece AND b.part = a.part AND b.depth = a.depth AND b.step > 0 AND (b.pos < a.pos)) AS start, pos AS stop, depth::BIGINT AS depth
FROM pd a WHERE step < 0 AND depth > 0""")
def pedal_pairs(spark, sf):
    return spans.paired_brackets(_pedal(spark, sf))


@query("pedal_directions", with_views("det", "note", "staff", then=PEDAL) + """
SELECT piece, part, pos, '<direction placement="below"><direction-type><words>' || CASE WHEN step > 0 THEN 'Ped.' ELSE '*' END || '</words></direction-type></direction>' AS direction, count(*) AS n FROM pp GROUP BY 1, 2, 3, 4""")
def pedal_directions(spark, sf):
    text = score.direction_text(F.col("class_name"), F.lit(None).cast("string"))
    rows = _pedal(spark, sf).select("piece", "part", "pos", spans.words_direction(text, F.lit("below")).alias("direction"))
    return rows.groupBy("piece", "part", "pos", "direction").agg(F.count("*").alias("n"))
