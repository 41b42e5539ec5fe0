"""Score events and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import music
from scorelake.operators import associate, score
from scorelake.plans.derived import with_views
from scorelake.plans.queries_associate import ASSOC, DEDUP, _associated
from scorelake.plans.common import CLASS_MAP_SQL
from scorelake.plans.queries_bars import CARRY, altered
from scorelake.plans.registry import query

EVENTS = CARRY + """,
ev AS (SELECT page_id // 20 AS piece, track AS part, page_id % 20 * 8 + system_no * 4 + bar_in_line AS measure, slot * 288230376151711744 + ng AS seq,
  CASE WHEN is_rest = 1 THEN 'rest' ELSE 'note' END AS kind, step, octave, alter, CASE WHEN qty % 13 = 0 THEN 0 ELSE CAST([20160, 10080, 5040, 2520][rhythm + 1] * CASE WHEN has_dot = 1 THEN 1.5::DOUBLE ELSE 1 END AS BIGINT) END AS ticks FROM av),
tx AS (SELECT piece, part, measure, seq, ticks, kind, CASE ticks WHEN 20160 THEN '<type>quarter</type>' WHEN 30240 THEN '<type>quarter</type><dot/>' WHEN 10080 THEN '<type>eighth</type>' WHEN 15120 THEN '<type>eighth</type><dot/>'
    WHEN 5040 THEN '<type>16th</type>' WHEN 7560 THEN '<type>16th</type><dot/>' WHEN 2520 THEN '<type>32nd</type>' WHEN 3780 THEN '<type>32nd</type><dot/>' ELSE '' END AS ty,
  '<pitch><step>' || ['C','D','E','F','G','A','B'][step + 1] || '</step>' || CASE alter WHEN 1 THEN '<alter>1</alter>' WHEN -1 THEN '<alter>-1</alter>' ELSE '' END || '<octave>' || octave || '</octave></pitch>' AS pi FROM ev),
full_ AS (SELECT piece, part, measure, seq, ticks, kind, CASE kind WHEN 'rest' THEN '<note><rest/>' ELSE '<note>' || pi END || '<duration>' || ticks || '</duration>' || ty || '</note>' AS x FROM tx WHERE ticks > 0
  UNION ALL SELECT piece, part, measure, 0, 60480, 'rest', '<note><rest/><duration>60480</duration><type>half</type><dot/></note>' FROM tx GROUP BY piece, part, measure HAVING sum(ticks) = 0)"""


def _events(spark, sf):
    step, octave = music.step_of(F.col("steps")), music.octave_of(F.col("steps"))
    ticks = music.ticks(F.col("rhythm"), F.col("has_dot") == 1, F.col("is_rest") == 1)
    rest = F.col("is_rest") == 1
    elements = altered(spark, sf).select(
        F.floor(F.col("page_id") / 20).alias("piece"), F.col("track").alias("part"), (F.col("page_id") % 20 * 8 + F.col("system_no") * 4 + F.col("bar_in_line")).alias("measure"),
        (F.col("slot") * (1 << 58) + F.col("ng")).alias("seq"), F.when(rest, "rest").otherwise("note").alias("kind"),
        F.when(rest, F.array().cast("array<string>")).otherwise(F.array(music.pitch_name(step, octave, F.col("alter")))).alias("pitches"),
        F.when(F.col("qty") % 13 == 0, 0).otherwise(ticks).alias("ticks"), F.lit(60480).alias("target_ticks"))
    return score.score_events(elements)


@query("score_events", with_views("note", then=EVENTS) + "SELECT piece, part, measure, kind, count(*) AS n, CAST(sum(ticks) AS BIGINT) AS ticks FROM full_ GROUP BY 1, 2, 3, 4")
def score_events(spark, sf):
    return _events(spark, sf).groupBy("piece", "part", "measure", "kind").agg(F.count("*").alias("n"), F.sum("ticks").alias("ticks"))


@query("musicxml_text", with_views("note", then=EVENTS) + """
SELECT piece, part, measure, '<measure number="' || (measure + 1) || '">' || string_agg(x, '' ORDER BY seq) || '</measure>' AS xml FROM full_ GROUP BY 1, 2, 3""")
def musicxml_text(spark, sf):
    return score.measures_xml(_events(spark, sf))


@query("musicxml_lines", with_views("note", then=EVENTS + ", pp AS (SELECT DISTINCT piece, part FROM full_), pc AS (SELECT DISTINCT piece FROM full_), mm AS (SELECT DISTINCT piece, part, measure FROM full_)") + """
SELECT piece, (SELECT count(*) FROM mm WHERE mm.piece = pc.piece) + 3 * (SELECT count(*) FROM pp WHERE pp.piece = pc.piece) + 3 AS n_lines FROM pc""")
def musicxml_lines(spark, sf):
    return score.musicxml_lines(score.measures_xml(_events(spark, sf))).groupBy("piece").agg(F.count("*").alias("n_lines"))


@query("notation_elements", with_views("det", "note", "staff", then=CLASS_MAP_SQL + ", " + ASSOC + DEDUP + """,
el(class_name, element) AS (VALUES """ + ", ".join(f"('{k}', '{v[1]}')" for k, v in score.ELEMENTS.items()) + """),
m AS (SELECT ded.class_name, cm.side FROM ded JOIN det d ON d.page_id = ded.page_id AND d.det_seq = ded.det_seq JOIN cm ON cm.class_id = d.class_id WHERE k = 1)""") + """
SELECT CASE WHEN m.class_name LIKE 'fingering%' THEN 'fingering' WHEN m.class_name LIKE 'tremolo%' THEN 'tremolo' ELSE element END AS element, coalesce(side, '') AS placement,
  CASE WHEN m.class_name LIKE 'fingering%' OR m.class_name LIKE 'tremolo%' THEN split_part(m.class_name, '_', 2) WHEN m.class_name = 'fermata' THEN CASE WHEN side = 'below' THEN 'inverted' ELSE 'upright' END
    WHEN m.class_name = 'marcato' THEN CASE WHEN side = 'below' THEN 'down' ELSE 'up' END ELSE '' END AS detail, count(*) AS n
FROM m LEFT JOIN el USING (class_name) WHERE element IS NOT NULL OR m.class_name LIKE 'fingering%' OR m.class_name LIKE 'tremolo%' GROUP BY 1, 2, 3""")
def notation_elements(spark, sf):
    done = associate.keep_best(_associated(spark, sf)).filter("association_status = 'matched'")
    marks = done.select(score.notation(F.col("class_name"), F.col("side")).alias("m")).filter("m IS NOT NULL")
    return marks.groupBy("m.element", "m.placement", "m.detail").agg(F.count("*").alias("n")).fillna("")
