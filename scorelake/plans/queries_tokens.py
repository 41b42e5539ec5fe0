"""Symbol strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import music
from scorelake.functions.vocabulary import KEY_NAMES
from scorelake.operators import tokens as T
from scorelake.plans.derived import load, with_views
from scorelake.plans.registry import query


def _note(i: int) -> str:
    return (f"'note-' || substr('CDEFGAB', CAST((pk + {i * 3}) % 7 + 1 AS INT), 1) || CASE (sk + {i}) % 5 WHEN 0 THEN '#' WHEN 1 THEN 'b' ELSE '' END "
            f"|| CAST(4 + (qty + {i}) % 2 AS VARCHAR(2)) || '_' || CASE (h + {i}) % 4 WHEN 0 THEN 'quarter' WHEN 1 THEN 'eighth' WHEN 2 THEN 'thirty' ELSE 'half' END "
            f"|| CASE WHEN (pk + {i}) % 5 = 0 THEN '.' ELSE '' END")


def _token(i: int) -> str:
    return (f"CASE (h + {i * 7}) % 8 WHEN 0 THEN 'rest-quarter' WHEN 1 THEN 'barline' WHEN 2 THEN {_note(i)} || '|' || {_note(i + 1)} "
            f"WHEN 3 THEN 'multirest-' || CAST(qty * 2 AS VARCHAR(4)) WHEN 4 THEN 'tie' ELSE {_note(i)} END")


LINE = ("SELECT page_id * 4096 + uid % 4096 AS line_key, uid AS line_id, 'clef-G2 keySignature-' || CASE pk % 5 WHEN 0 THEN 'DM' WHEN 1 THEN 'EbM' WHEN 2 THEN 'CM' WHEN 3 THEN 'F#M' "
        "ELSE 'Xx' END || ' timeSignature-2/3 ' || " + " || ' ' || ".join(_token(i) for i in range(8)) + " AS text, page_id FROM {li}")


def lines(spark, sf):
    """The rows of LINE. The eight tokens are one expression over their number: written out, they are more than the JVM compiles."""
    pk, sk, qty, h = (F.col(c) for c in ("pk", "sk", "qty", "h"))
    steps = [f"note-{c}" for c in "CDEFGAB"]
    middles = [f"{sign}{octave}" for sign in ("#", "b", "", "", "") for octave in (4, 5)]
    ends = [f"_{name}{dot}" for name in ("quarter", "eighth", "thirty", "half") for dot in (".", "", "", "", "")]

    def note(i):
        return F.concat(music.pick(steps, (pk + i * 3) % 7), music.pick(middles, (sk + i) % 5 * 2 + (qty + i) % 2), music.pick(ends, (h + i) % 4 * 5 + (pk + i) % 5))

    def token(place):
        i, kind = place["i"], place["kind"]
        return (F.when(kind == 0, "rest-quarter").when(kind == 1, "barline").when(kind == 2, F.concat(note(i), F.lit("|"), note(i + 1)))
                .when(kind == 3, F.concat(F.lit("multirest-"), (qty * 2).cast("string"))).when(kind == 4, "tie").otherwise(note(i)))

    key = music.pick(("DM", "EbM", "CM", "F#M", "Xx"), pk % 5)
    tokens = F.transform(F.array(*(F.struct(F.lit(i).alias("i"), ((h + i * 7) % 8).alias("kind")) for i in range(8))), token)
    text = F.concat(F.lit("clef-G2 keySignature-"), key, F.lit(" timeSignature-2/3 "), F.array_join(tokens, " "))
    return load(spark, sf, "li").select(F.concat_ws("-", "page_id", "uid").alias("line_id"), text.alias("text"))


BASE = "tl AS (SELECT page_id || '-' || line_id AS line_id, text FROM (" + LINE.replace("{li}", "li") + """)),
gr AS (SELECT line_id, unnest(string_split(text, ' ')) AS g, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM tl),
sy AS (SELECT * FROM (SELECT line_id, pos, unnest(string_split(g, '|')) AS symbol, generate_subscripts(string_split(g, '|'), 1) - 1 AS sub_pos FROM gr) WHERE symbol <> 'tie'),
s1 AS (SELECT *, CASE WHEN symbol LIKE 'note%' THEN CASE WHEN split_part(symbol, '_', 1) LIKE '%#%' THEN '#' WHEN split_part(symbol, '_', 1) LIKE '%b%' THEN 'b' ELSE '' END END AS alter_,
  CASE WHEN symbol LIKE 'note%' THEN 'note-' || replace(replace(split_part(split_part(symbol, '_', 1), '-', 2), '#', ''), 'b', '') ELSE 'nonote' END AS pitch,
  CASE WHEN symbol LIKE 'keySignature%' THEN CASE split_part(symbol, '-', 2) WHEN 'DM' THEN 2 WHEN 'EbM' THEN -3 WHEN 'F#M' THEN 6 ELSE 0 END END AS k FROM sy),
s2 AS (SELECT *, coalesce(last_value(k IGNORE NULLS) OVER w, 0) AS fifths, sum(CASE WHEN k IS NOT NULL OR symbol = 'barline' THEN 1 ELSE 0 END) OVER w AS part FROM s1
  WINDOW w AS (PARTITION BY line_id ORDER BY pos, sub_pos)),
s3 AS (SELECT *, coalesce(lag(alter_) OVER (PARTITION BY line_id, part, pitch ORDER BY pos, sub_pos),
  CASE WHEN fifths > 0 AND list_contains(['F','C','G','D','A','E','B'][1:fifths], pitch[6]) THEN '#' WHEN fifths < 0 AND list_contains(['B','E','A','D','G','C','F'][1:-fifths], pitch[6]) THEN 'b' ELSE '' END) AS state FROM s2),
s4 AS (SELECT *, CASE WHEN alter_ IS NULL THEN NULL WHEN alter_ = state THEN '' WHEN alter_ = '' THEN '0' ELSE alter_ END AS visible FROM s3)"""

RHYTHM = """CASE WHEN symbol LIKE 'note%' THEN 'note-' || replace(replace(split_part(symbol, '_', 2), 'thirty', 'thirty_second'), '.', '') || CASE WHEN symbol LIKE '%.%' THEN '.' ELSE '' END
  WHEN symbol LIKE 'multirest-%' THEN CASE WHEN split_part(symbol, '-', 2)::INT <= 1 THEN 'rest-whole' WHEN split_part(symbol, '-', 2)::INT > 50 THEN 'multirest-50' ELSE symbol END
  ELSE replace(symbol, 'timeSignature-2/3', 'timeSignature-2/4') END"""


@query("token_split", with_views("li", then=BASE) + f"""
SELECT line_id, pos, sub_pos, {RHYTHM} AS rhythm, pitch, CASE WHEN visible IS NULL THEN 'nonote' WHEN visible = '#' THEN 'lift_#' WHEN visible = 'b' THEN 'lift_b' WHEN visible = '0' THEN 'lift_N' ELSE 'lift_null' END AS lift FROM s4""")
def token_split(spark, sf):
    out = T.symbol_streams(lines(spark, sf))
    return out.select("line_id", F.col("pos").cast("long").alias("pos"), F.col("sub_pos").cast("long").alias("sub_pos"), "rhythm", "pitch", "lift")


@query("visible_accidentals", with_views("li", then=BASE) + """
SELECT coalesce(visible, '-') AS visible, alter_ AS alter, count(*) AS n FROM s4 WHERE alter_ IS NOT NULL GROUP BY 1, 2""")
def visible_accidentals(spark, sf):
    out = T.visible_accidentals(lines(spark, sf)).filter("alter IS NOT NULL")
    return out.groupBy("visible", "alter").agg(F.count("*").alias("n"))


@query("print_accidentals", with_views("li", then=BASE + """,
p AS (SELECT line_id, pos, sub_pos, CASE WHEN symbol LIKE 'note%' THEN replace(replace(split_part(symbol, '_', 1), '#', ''), 'b', '') || replace(visible, '0', 'N') || '_' || split_part(symbol, '_', 2) ELSE symbol END AS t FROM s4),
c AS (SELECT line_id, pos, string_agg(t, '|' ORDER BY sub_pos) AS t FROM p GROUP BY 1, 2)""") + "SELECT line_id, string_agg(t, '+' ORDER BY pos) AS text FROM c GROUP BY 1")
def print_accidentals(spark, sf):
    return T.print_accidentals(lines(spark, sf))


SORTKEY = "-(strpos('CDEFGAB', pitch[6]) - 1 + 7 * pitch[7]::INT)"


@query("chord_order", with_views("li", then=BASE) + f"""
SELECT line_id, pos, sub_pos, row_number() OVER (PARTITION BY line_id, pos ORDER BY CASE WHEN pitch = 'nonote' THEN 1000 ELSE {SORTKEY} END, sub_pos) - 1 AS chord_pos FROM s4""")
def chord_order(spark, sf):
    out = T.symbol_streams(lines(spark, sf))
    return out.select("line_id", F.col("pos").cast("long").alias("pos"), F.col("sub_pos").cast("long").alias("sub_pos"), F.col("chord_pos").cast("long").alias("chord_pos"))


@query("token_merge", with_views("li", then=BASE + f""",
m AS (SELECT line_id, pos, CASE WHEN pitch = 'nonote' THEN {RHYTHM} ELSE pitch || CASE visible WHEN '#' THEN '#' WHEN 'b' THEN 'b' WHEN '0' THEN 'N' ELSE '' END || '_' || replace({RHYTHM}, 'note-', '') END AS t,
  CASE WHEN pitch = 'nonote' THEN 1000 ELSE {SORTKEY} END AS k, sub_pos FROM s4), c AS (SELECT line_id, pos, string_agg(t, '|' ORDER BY k, sub_pos) AS t FROM m GROUP BY 1, 2)""") + """
SELECT line_id, string_agg(t, '+' ORDER BY pos) AS text FROM c GROUP BY 1""")
def token_merge(spark, sf):
    """Streams with `|` between the notes of a chord, merged back to one string per line."""
    s = T.symbol_streams(lines(spark, sf))
    base = F.col("pos") * 100 + F.col("chord_pos") * 2
    row = lambda seq, *texts: F.struct(seq.alias("seq"), *(t.alias(n) for t, n in zip(texts, ("rhythm", "pitch", "lift"))))
    symbol = row(base, F.col("rhythm"), F.col("pitch"), F.col("lift"))
    bar = row(base - 1, F.lit("|"), F.lit("nonote"), F.lit("nonote"))
    return T.merge_streams(s.select("line_id", F.inline(F.when(F.col("chord_pos") > 0, F.array(bar, symbol)).otherwise(F.array(symbol)))))


VOCAB = [(t, i + 4) for i, t in enumerate(["note-quarter", "note-eighth", "note-half", "rest-quarter", "barline", "clef-G2", "timeSignature-2/4"])]


@query("vocab_encode", with_views("li", then=BASE + ", vo(token, id) AS (VALUES " + ", ".join(f"('{t}', {i})" for t, i in VOCAB) + ")") + f"""
SELECT coalesce(id, 3) AS id, id IS NULL AS unknown, count(*) AS n FROM (SELECT {RHYTHM} AS token FROM s4) LEFT JOIN vo USING (token) GROUP BY 1, 2""")
def vocab_encode(spark, sf):
    stream = T.split_lines(lines(spark, sf)).select(T.rhythm_of(F.col("symbol")).alias("token"))
    vocab = spark.createDataFrame(VOCAB, "token string, id int")
    return T.encode(stream, vocab, default_id=3).groupBy("id", "unknown").agg(F.count("*").alias("n"))


@query("vocab_decode", with_views("li", then="vo(token, id) AS (VALUES " + ", ".join(f"('{t}', {i})" for t, i in VOCAB) + ")") + """
SELECT token, count(*) AS n FROM (SELECT pk % 11 AS id FROM li) JOIN vo USING (id) WHERE token <> 'barline' GROUP BY 1""")
def vocab_decode(spark, sf):
    ids = load(spark, sf, "li").select((F.col("pk") % 11).alias("id"))
    return T.decode(ids, spark.createDataFrame(VOCAB, "token string, id int"), special=["barline"]).groupBy("token").agg(F.count("*").alias("n"))


@query("key_names", with_views("li") + "SELECT f AS fifths, [" + ", ".join(f"'{k}'" for k in KEY_NAMES) + """][f + 8] AS name, count(*) AS n, f AS back,
  CASE WHEN f >= 0 THEN ['','F','FC','FCG','FCGD','FCGDA','FCGDAE','FCGDAEB'][f + 1] ELSE ['','B','BE','BEA','BEAD','BEADG','BEADGC','BEADGCF'][1 - f] END AS notes
FROM (SELECT pk % 15 - 7 AS f FROM li) GROUP BY ALL""")
def key_names(spark, sf):
    f = F.col("fifths")
    per_key = load(spark, sf, "li").groupBy((F.col("pk") % 15 - 7).alias("fifths")).agg(F.count("*").alias("n"))
    return per_key.select("fifths", music.key_of_fifths(f).alias("name"), "n", music.fifths_of_key(music.key_of_fifths(f)).cast("long").alias("back"),
                          F.array_join(music.key_notes(f), "").alias("notes"))


@query("staff_codes", with_views("li", then="""
c AS (SELECT page_id, uid, pk % 7 AS s, 3 + sk % 4 AS o FROM li)""") + """
SELECT page_id, uid, 'n' || ([-1, 0, 1, 2, 3, 4, 5][s + 1] + (o - 4) * 7) AS treble, 'n' || ([-3, -2, -1, 0, 1, 2, 3][s + 1] + (o - 2) * 7) AS bass, substr('CDEFGAB', CAST(s + 1 AS INT), 1) || o AS back FROM c""")
def staff_codes(spark, sf):
    name = F.concat(music.pick(music.STEP_NAMES, F.col("pk") % 7), (3 + F.col("sk") % 4).cast("string"))
    note = F.concat(F.lit("note-"), name, F.lit("_quarter"))
    return load(spark, sf, "li").select("page_id", "uid", music.staff_code(note).alias("treble"), music.staff_code(note, bass=True).alias("bass"),
                                        music.note_of_staff_code(music.staff_code(note)).alias("back"))


@query("token_alignment")
def token_alignment(spark, sf):
    """Tokens of a line against its elements, of which every seventh line misses one and every fifth has one more."""
    plain = F.regexp_replace("text", "([A-G])[#b]+(?=[0-9])", "$1")
    split = F.filter(F.split(plain, " "), lambda t: t != "tie")
    base = lines(spark, sf).select("line_id", split.alias("tokens"))
    code = lambda t: F.when(t.startswith("clef"), F.array(F.lit("c1"))).when(t.startswith("key"), F.array(F.lit("s"), F.lit("s"))).when(
        t == "barline", F.array(F.lit("b"))).when(t.startswith("note") | t.startswith("rest"), F.transform(F.split(t, r"\|"), lambda n: music.staff_code(n))).otherwise(
        F.array().cast("array<string>"))
    codes = F.flatten(F.transform("tokens", code))
    made = base.withColumn("codes", codes)
    noisy = made.withColumn("codes", F.when(F.crc32("line_id") % 7 == 0, F.slice("codes", F.lit(1), F.size("codes") - 1)).when(
        F.crc32("line_id") % 5 == 0, F.array_append("codes", F.lit("n3"))).otherwise(F.col("codes")))
    out = T.align_tokens(noisy)
    return out.select("line_id", F.size("codes").alias("n_codes"), F.size("alignment").alias("n_aligned"),
                      F.aggregate("alignment", F.lit(0), lambda a, m: a + m["displaced"]).alias("displaced"))
