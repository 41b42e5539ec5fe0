"""Bars, time, keys, pitches."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import music
from scorelake.operators import bars, keys
from scorelake.plans.derived import load, with_views
from scorelake.plans.registry import query

BARLINE = """bl AS (SELECT page_id, system_no, track, unit, 30 + 400 * k + i AS x FROM (
  SELECT *, unnest(range(3)) AS i FROM (SELECT *, unnest(range(5)) AS k FROM staff)) WHERE (page_id * 3 + staff_index * 5 + k + i) % 4 <> 0)"""

RANGES = BARLINE + """,
sh AS (SELECT page_id, system_no, x, unit FROM bl GROUP BY ALL HAVING count(DISTINCT track) > 1),
pt AS (SELECT * FROM (SELECT *, lag(x) OVER (PARTITION BY page_id, system_no ORDER BY x) AS p FROM sh) WHERE p IS NULL OR x <> p + 1),
rg AS (SELECT page_id, system_no, unit, coalesce(lag(x) OVER (PARTITION BY page_id, system_no ORDER BY x), 0) AS start, x AS stop FROM pt),
br AS (SELECT page_id, system_no, start, stop, row_number() OVER (PARTITION BY page_id, system_no ORDER BY stop) - 1 AS bar_in_line FROM rg WHERE stop > start + unit)"""


def _ranges(spark, sf):
    staff = load(spark, sf, "staff")
    cols = staff.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2))))
    cols = cols.filter((F.col("page_id") * 3 + F.col("staff_index") * 5 + F.col("k") + F.col("i")) % 4 != 0).select(
        "page_id", "system_no", "track", "unit", (30 + 400 * F.col("k") + F.col("i")).cast("long").alias("x"))
    return bars.bar_ranges(cols)


@query("barline_islands", with_views("staff", then=RANGES) + "SELECT page_id, system_no, start, stop, bar_in_line FROM br")
def barline_islands(spark, sf):
    return _ranges(spark, sf)


ELEMENTS = """el AS (SELECT page_id, system_no, track, ng AS elem_seq, x0 - 100 + h % 3 AS x0, x0 - 100 + h % 3 + 12 + (qty % 5) * 30 AS x1,
  CASE WHEN is_rest = 1 THEN 2 WHEN pk % 9 = 0 THEN 4 WHEN pk % 11 = 0 THEN 3 ELSE 1 END AS priority FROM note),
eb AS (SELECT el.*, br.bar_in_line FROM el JOIN br ON br.page_id = el.page_id AND br.system_no = el.system_no AND el.x0 >= br.start AND el.x0 < br.stop)"""


def _elements(spark, sf):
    x0 = F.col("x0") - 100 + F.col("h") % 3
    el = load(spark, sf, "note").select(
        "page_id", "system_no", "track", F.col("ng").alias("elem_seq"), x0.alias("x0"),
        (x0 + 12 + (F.col("qty") % 5) * 30).alias("x1"),
        F.when(F.col("is_rest") == 1, 2).when(F.col("pk") % 9 == 0, 4).when(F.col("pk") % 11 == 0, 3).otherwise(1).alias("priority"))
    return bars.elements_in_bars(el, _ranges(spark, sf))


@query("element_to_bar", with_views("staff", "note", then=RANGES + ", " + ELEMENTS) + "SELECT page_id, elem_seq, system_no, track, bar_in_line FROM eb")
def element_to_bar(spark, sf):
    return _elements(spark, sf).select("page_id", "elem_seq", "system_no", "track", "bar_in_line")


@query("bar_sweep", with_views("staff", "note", then=RANGES + ", " + ELEMENTS + """,
ls AS (SELECT page_id, system_no, track, bar_in_line, list({'x0': x0, 'x1': x1, 's': elem_seq} ORDER BY x0, priority, elem_seq) AS l FROM eb GROUP BY 1, 2, 3, 4),
sw AS (SELECT page_id, system_no, track, bar_in_line, list_reduce(list_transform(l, lambda b: [b]), lambda acc, x: CASE WHEN x[1].x0 > acc[-1].x1 THEN list_append(acc, x[1]) ELSE acc END) AS t FROM ls)""") + """
SELECT page_id, system_no, track, bar_in_line, u.s AS elem_seq FROM (SELECT page_id, system_no, track, bar_in_line, unnest(t) AS u FROM sw)""")
def bar_sweep(spark, sf):
    return bars.sweep(_elements(spark, sf), keys=["page_id", "system_no", "track", "bar_in_line"]).select(
        "page_id", "system_no", "track", "bar_in_line", "elem_seq")


LINES = """ln AS (SELECT CAST(floor(page_id / 20) AS BIGINT) AS piece, page_id, system_no, count(*) AS n_bars FROM br GROUP BY 1, 2, 3)"""


def _lines(spark, sf):
    return _ranges(spark, sf).groupBy(F.floor(F.col("page_id") / 20).alias("piece"), "page_id", "system_no").agg(F.count("*").alias("n_bars"))


@query("bar_numbering", with_views("staff", then=RANGES + ", " + LINES) + """
SELECT piece, page_id, system_no, n_bars, CAST(sum(n_bars) OVER (PARTITION BY piece ORDER BY page_id, system_no) - n_bars AS BIGINT) AS first_bar FROM ln""")
def bar_numbering(spark, sf):
    return bars.number_bars(_lines(spark, sf))


TS = """pb AS (SELECT CAST(floor(page_id / 20) AS BIGINT) AS piece, page_id, unnest(range(8)) AS bar_no FROM page),
ch AS (SELECT piece, page_id, bar_no, 2 + (page_id + bar_no) % 5 AS ts_num, CASE WHEN (page_id + bar_no) % 3 = 0 THEN 8 ELSE 4 END AS ts_den FROM pb
  WHERE (page_id % 20 = 0 AND bar_no = 0) OR (page_id * 7 + bar_no * 11) % 31 = 0),
ts AS (SELECT b.piece, b.page_id, b.bar_no, max_by({'n': c.ts_num, 'd': c.ts_den}, c.page_id * 100 + c.bar_no) AS t FROM pb b JOIN ch c ON c.piece = b.piece
  AND c.page_id * 100 + c.bar_no <= b.page_id * 100 + b.bar_no GROUP BY 1, 2, 3)"""


def _page_bars(spark, sf):
    return load(spark, sf, "page").select(F.floor(F.col("page_id") / 20).alias("piece"), "page_id",
                                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("bar_no"))


def _changes(spark, sf):
    mixed = F.col("page_id") + F.col("bar_no")
    return _page_bars(spark, sf).filter(((F.col("page_id") % 20 == 0) & (F.col("bar_no") == 0)) | (
        (F.col("page_id") * 7 + F.col("bar_no") * 11) % 31 == 0)).withColumn("ts_num", 2 + mixed % 5).withColumn(
        "ts_den", F.when(mixed % 3 == 0, 8).otherwise(4).cast("long"))


@query("time_signature_asof", with_views("page", then=TS) + "SELECT piece, page_id, bar_no, t.n AS ts_num, t.d::BIGINT AS ts_den FROM ts")
def time_signature_asof(spark, sf):
    return bars.time_signatures(_page_bars(spark, sf), _changes(spark, sf))


NOTE_TICKS = """nt AS (SELECT *, CAST([20160, 10080, 5040, 2520][rhythm + 1] * CASE WHEN has_dot = 1 THEN 1.5::DOUBLE ELSE 1 END AS BIGINT) AS ticks FROM note)"""


def note_ticks(spark, sf):
    return load(spark, sf, "note").withColumn("ticks", music.ticks(F.col("rhythm"), F.col("has_dot") == 1, F.col("is_rest") == 1))


@query("bar_totals", with_views("note", then=NOTE_TICKS) + """
SELECT page_id, staff_index, bar_in_line, CAST(sum(ticks) AS BIGINT) AS total_ticks, count(*) AS n_elements, 60480 AS target_ticks FROM nt GROUP BY 1, 2, 3""")
def bar_totals(spark, sf):
    el = note_ticks(spark, sf).withColumn("ts_num", F.lit(3)).withColumn("ts_den", F.lit(4))
    return bars.bar_totals(el, keys=["page_id", "staff_index", "bar_in_line"]).drop("ts_num", "ts_den")


@query("bar_audit", with_views("note", then=NOTE_TICKS) + """
SELECT page_id, staff_index, bar_in_line, CAST(sum(ticks) AS BIGINT) AS total_ticks, string_agg(ticks::VARCHAR, ',' ORDER BY ng) AS lengths FROM nt GROUP BY 1, 2, 3 HAVING sum(ticks) <> 60480""")
def bar_audit(spark, sf):
    el = note_ticks(spark, sf).withColumn("ts_num", F.lit(3)).withColumn("ts_den", F.lit(4)).withColumn("elem_seq", F.col("ng"))
    out = bars.bar_audit(el, keys=["page_id", "staff_index", "bar_in_line"])
    return out.select("page_id", "staff_index", "bar_in_line", "total_ticks",
                      F.array_join(F.transform("elements", lambda e: e["ticks"].cast("string")), ",").alias("lengths"))


@query("empty_bars", with_views("page", "note", then=TS + """,
us AS (SELECT DISTINCT CAST(floor(page_id / 20) AS BIGINT) AS piece, page_id % 20 * 8 + bar_in_line AS bar_no FROM note),
ab AS (SELECT DISTINCT piece, page_id % 20 * 8 + bar_no AS bar_no FROM pb)""") + """
SELECT piece, bar_no, row_number() OVER (PARTITION BY piece ORDER BY bar_no) - 1 AS new_bar_no FROM ab SEMI JOIN us USING (piece, bar_no)""")
def empty_bars(spark, sf):
    all_bars = _page_bars(spark, sf).select("piece", (F.col("page_id") % 20 * 8 + F.col("bar_no")).alias("bar_no"))
    used = load(spark, sf, "note").select(
        F.floor(F.col("page_id") / 20).alias("piece"), (F.col("page_id") % 20 * 8 + F.col("bar_in_line")).alias("bar_no"))
    return bars.drop_empty_bars(all_bars, used)


@query("chord_lengths", with_views("note", then=NOTE_TICKS) + """
SELECT page_id, staff_index * 100 + slot AS ng, least(min(ticks), 80640) AS ticks, min(y0) AS y0, max(y1) AS y1, count(DISTINCT rhythm) AS n_rhythms, count(*) AS n_heads FROM nt GROUP BY 1, 2""")
def chord_lengths(spark, sf):
    heads = note_ticks(spark, sf).withColumn("ng", F.col("staff_index") * 100 + F.col("slot")).withColumn("is_ornament", F.lit(False))
    return bars.note_group_lengths(heads).select("page_id", "ng", "ticks", "y0", "y1", "n_rhythms", "n_heads")


CLEF = """bt AS (SELECT piece, page_id, bar_no, unnest(range(4)) AS track FROM pb),
ce AS (SELECT CAST(floor(page_id / 20) AS BIGINT) AS piece, page_id, track, bar_in_line AS bar_no, ng AS seq, CAST(h % 3 - 1 AS BIGINT) AS clef FROM note WHERE pk % 13 = 0),
op(track, allowed) AS (VALUES (0, [1]), (1, [1, 0]), (2, [0, 1]), (3, [-1, 0])),
al AS (SELECT ce.piece, ce.page_id, ce.track, ce.bar_no, max_by(clef, seq) AS clef FROM ce JOIN op USING (track) WHERE list_contains(allowed, clef) GROUP BY 1, 2, 3, 4),
cf AS (SELECT bt.piece, bt.page_id, bt.bar_no, bt.track, CASE WHEN len(allowed) = 1 THEN allowed[1] ELSE coalesce(last_value(al.clef IGNORE NULLS) OVER (PARTITION BY bt.piece, bt.track
  ORDER BY bt.page_id, bt.bar_no), allowed[1]) END AS clef FROM bt JOIN op USING (track) LEFT JOIN al ON al.piece = bt.piece AND al.page_id = bt.page_id AND al.track = bt.track AND al.bar_no = bt.bar_no)"""


def _track_bars(spark, sf):
    return _page_bars(spark, sf).withColumn("track", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))


def _clefs(spark, sf):
    seen = load(spark, sf, "note").filter("pk % 13 = 0").select(
        F.floor(F.col("page_id") / 20).alias("piece"), "page_id", "track", F.col("bar_in_line").alias("bar_no"), F.col("ng").alias("seq"),
        (F.col("h") % 3 - 1).alias("clef"))
    options = spark.createDataFrame([(0, [1]), (1, [1, 0]), (2, [0, 1]), (3, [-1, 0])], "track bigint, allowed array<bigint>")
    return keys.fill_clefs(_track_bars(spark, sf), seen, options)


@query("clef_fill", with_views("page", "note", then=TS + ", " + CLEF) + "SELECT piece, page_id, bar_no, track, clef::BIGINT AS clef FROM cf")
def clef_fill(spark, sf):
    return _clefs(spark, sf)


# a detected key on some bars, from the data; the accidentals of `key_detection` spell such keys
KEYS = """dk AS (SELECT CAST(floor(page_id / 20) AS BIGINT) AS piece, page_id, track, bar_in_line AS bar_no, max(pk % 9 - 4) AS key FROM note WHERE pk % 17 = 0 GROUP BY 1, 2, 3, 4),
kf AS (SELECT bt.piece, bt.page_id, bt.bar_no, bt.track, coalesce(last_value(coalesce(dk.key, CASE WHEN bt.bar_no = 0 AND bt.page_id % 4 = 0 THEN 0 END) IGNORE NULLS) OVER (
  PARTITION BY bt.piece, bt.track ORDER BY bt.page_id, bt.bar_no), 0) AS key FROM bt LEFT JOIN dk ON dk.piece = bt.piece AND dk.page_id = bt.page_id AND dk.track = bt.track AND dk.bar_no = bt.bar_no)"""


def _keys(spark, sf):
    seen = load(spark, sf, "note").filter("pk % 17 = 0").groupBy(
        F.floor(F.col("page_id") / 20).alias("piece"), "page_id", "track", F.col("bar_in_line").alias("bar_no")).agg(F.max(F.col("pk") % 9 - 4).alias("key"))
    starts = _page_bars(spark, sf).filter("bar_no = 0 AND page_id % 4 = 0")
    return keys.fill_keys(_track_bars(spark, sf), seen, starts)


@query("key_fill", with_views("page", "note", then=TS + ", " + CLEF + ", " + KEYS) + "SELECT piece, page_id, bar_no, track, key FROM kf")
def key_fill(spark, sf):
    return _keys(spark, sf)


MODE = """mo AS (SELECT piece, page_id, bar_no, k AS neutral FROM (SELECT piece, page_id, bar_no, key - [0, -1, 2, 0][track + 1] AS k, count(*) AS n FROM kf GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY piece, page_id, bar_no ORDER BY n DESC, k) = 1)"""


@query("key_mode", with_views("page", "note", then=TS + ", " + CLEF + ", " + KEYS + ", " + MODE) + """
SELECT kf.piece, kf.page_id, kf.bar_no, track, neutral, neutral + [0, -1, 2, 0][track + 1] AS key FROM kf JOIN mo USING (piece, page_id, bar_no)""")
def key_mode(spark, sf):
    shifts = spark.createDataFrame([(0, 0), (1, -1), (2, 2), (3, 0)], "track bigint, track_shift bigint")
    return keys.neutral_keys(_keys(spark, sf), shifts)


@query("change_only", with_views("page", "note", then=TS + ", " + CLEF) + """
SELECT piece, track, page_id, bar_no, clef::BIGINT AS clef FROM (SELECT *, lag(clef) OVER (PARTITION BY piece, track ORDER BY page_id, bar_no) AS p FROM cf) WHERE p IS NULL OR p <> clef""")
def change_only(spark, sf):
    out = bars.change_only(_clefs(spark, sf), keys=["piece", "track"], segment="page_id", order=["page_id", "bar_no"], columns=["clef"])
    return out.filter("emit_clef").select("piece", "track", "page_id", "bar_no", "clef")


DETECT = """ac AS (SELECT page_id, staff_index, bar_in_line, slot, min({'pos': pos, 'sh': sh}) AS a FROM (SELECT page_id, staff_index, bar_in_line, slot,
    CASE WHEN h % 2 = 0 THEN [3, 0, 4, 1, 5, 2, 6][slot % 4 + 1] ELSE [6, 2, 5, 1, 4, 0, 3][slot % 4 + 1] END + 1 + 7 * (qty % 2) + (sk % 5) * 0.5::DOUBLE * (pk % 3 = 0)::INT AS pos,
    CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END AS sh FROM note) GROUP BY 1, 2, 3, 4),
ru AS (SELECT page_id, staff_index, bar_in_line, list({'p': (a.pos - 1) - 7 * floor((a.pos - 1) / 7), 's': a.sh} ORDER BY slot) AS r FROM ac GROUP BY 1, 2, 3),
op AS (SELECT *, list_filter(range(1, len(r) + 1), lambda i: (r[i].s = 1 AND abs(r[i].p - 3) <= 1) OR (r[i].s = -1 AND abs(r[i].p - 6) <= 1))[1] AS f FROM ru),
tl AS (SELECT *, r[f:] AS t FROM op)"""


@query("key_detection", with_views("note", then=DETECT) + """
SELECT page_id, staff_index, bar_in_line, CASE WHEN f IS NULL THEN -99
  WHEN len(list_filter(range(1, len(t) + 1), lambda i: abs(t[i].p - [3, 0, 4, 1, 5, 2, 6][(i - 1) % 7 + 1]) < 1.2 OR t[i].p - [3, 0, 4, 1, 5, 2, 6][(i - 1) % 7 + 1] > 5.8)) = len(t) THEN len(t)
  WHEN len(list_filter(range(1, len(t) + 1), lambda i: abs(t[i].p - [6, 2, 5, 1, 4, 0, 3][(i - 1) % 7 + 1]) < 1.2 OR t[i].p - [6, 2, 5, 1, 4, 0, 3][(i - 1) % 7 + 1] > 5.8)) = len(t) THEN -len(t)
  ELSE -99 END AS key FROM tl""")
def key_detection(spark, sf):
    order = lambda table: music.pick(table, F.col("slot") % 4)
    even = F.col("h") % 2 == 0
    noise = F.when(F.col("pk") % 3 == 0, (F.col("sk") % 5) * 0.5).otherwise(0.0)
    acc = load(spark, sf, "note").select(
        F.floor(F.col("page_id") / 20).alias("piece"), "page_id", F.col("staff_index").alias("track"), F.col("bar_in_line").alias("bar_no"), F.col("slot").alias("x"),
        (F.when(even, order(music.SHARP_STEPS)).otherwise(order(music.FLAT_STEPS)) + 1 + 7 * (F.col("qty") % 2) + noise).alias("pos"),
        F.when(even, 1).otherwise(-1).alias("shift"))
    clefs = acc.select("piece", "page_id", "track", "bar_no").distinct().withColumn("clef", F.lit(1))
    return keys.detect_keys(acc, clefs).select(
        "page_id", F.col("track").alias("staff_index"), F.col("bar_no").alias("bar_in_line"), F.coalesce(F.col("key").cast("long"), F.lit(-99)).alias("key"))


CARRY = """st AS (SELECT *, pitch - CASE staff_index % 4 WHEN 2 THEN 6 WHEN 3 THEN 12 ELSE 0 END - 1 AS steps, h % 9 - 4 AS dummy, page_id % 9 - 4 AS fifths FROM note),
cy AS (SELECT *, ((steps % 7) + 7) % 7 AS step, last_value(accidental IGNORE NULLS) OVER (PARTITION BY page_id, staff_index, bar_in_line, steps ORDER BY slot, ng) AS carried FROM st),
av AS (SELECT *, CAST(floor(steps / 7) AS BIGINT) + 5 AS octave, CASE WHEN carried IS NOT NULL THEN carried
  WHEN fifths > 0 AND list_position([3, 0, 4, 1, 5, 2, 6], step) <= fifths THEN 1 WHEN fifths < 0 AND list_position([6, 2, 5, 1, 4, 0, 3], step) <= -fifths THEN -1 ELSE 0 END AS alter FROM cy)"""


def altered(spark, sf):
    clef = music.pick([1, 1, 0, -1], F.col("staff_index") % 4)
    n = load(spark, sf, "note").withColumn("steps", music.diatonic(F.col("pitch"), clef)).withColumn("fifths", F.col("page_id") % 9 - 4)
    return keys.carry_accidentals(n, measure=["page_id", "staff_index", "bar_in_line"], segment="slot", order=["slot", "ng"])


@query("accidental_carry", with_views("note", then=CARRY) + "SELECT page_id, ng, steps, alter::BIGINT AS alter FROM av")
def accidental_carry(spark, sf):
    return altered(spark, sf).select("page_id", "ng", "steps", F.col("alter").cast("long").alias("alter"))


@query("pitch_names", with_views("note", then=CARRY) + """
SELECT page_id, ng, ['C','D','E','F','G','A','B'][step + 1] || CASE alter WHEN 1 THEN '#' WHEN -1 THEN '-' ELSE '' END || octave AS name,
  [0, 2, 4, 5, 7, 9, 11][step + 1] + 12 * (octave + 1) + alter AS midi FROM av""")
def pitch_names(spark, sf):
    step, octave = music.step_of(F.col("steps")), music.octave_of(F.col("steps"))
    return altered(spark, sf).select("page_id", "ng", music.pitch_name(step, octave, F.col("alter")).alias("name"),
                                     music.midi(step, octave, F.col("alter")).alias("midi"))


@query("transpose", with_views("note", then=CARRY + """,
mi AS (SELECT page_id, ng, fifths, [0, 2, 4, 5, 7, 9, 11][step + 1] + 12 * (octave + 1) + alter + ((-(track - 1) * 7) % 12 + 12) % 12 AS m FROM av)""") + """
SELECT page_id, ng, CASE WHEN fifths > 0 THEN ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][m % 12 + 1] ELSE ['C','D-','D','E-','E','F','G-','G','A-','A','B-','B'][m % 12 + 1] END || (m // 12 - 1) AS name FROM mi""")
def transpose(spark, sf):
    step, octave = music.step_of(F.col("steps")), music.octave_of(F.col("steps"))
    number = music.midi(step, octave, F.col("alter"))
    return altered(spark, sf).select("page_id", "ng", music.transposed_name(number, F.col("track") - 1, F.col("fifths") > 0).alias("name"))
