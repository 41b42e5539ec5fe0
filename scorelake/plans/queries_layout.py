"""Attachments, staff lines, windows, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions.boxes import Box, box
from scorelake.operators import attach, clusters, profile, staffs
from scorelake.plans.common import staves
from scorelake.plans.derived import load, with_views
from scorelake.plans.registry import query

ACC = """ac AS (SELECT page_id, ng AS acc_id, accidental AS shift, x0 - 24 AS x0, y0 - 10 + sk % 9 AS y0, x0 - 10 AS x1, y1 + 10 - pk % 5 AS y1 FROM note WHERE accidental IS NOT NULL)"""


def _accidentals(spark, sf):
    n = load(spark, sf, "note").filter("accidental IS NOT NULL")
    return n.select("page_id", F.col("ng").alias("acc_id"), F.col("accidental").alias("shift"), (F.col("x0") - 24).alias("x0"),
                    (F.col("y0") - 10 + F.col("sk") % 9).alias("y0"), (F.col("x0") - 10).alias("x1"), (F.col("y1") + 10 - F.col("pk") % 5).alias("y1"))


@query("accidental_to_note", with_views("note", then=ACC + """,
pb AS (SELECT page_id, acc_id, x1 AS a0, x1 + (x1 - x0) AS a1, CASE WHEN shift >= 0 THEN (y0 + y1) // 2 - (y1 - y0) // 6 ELSE (y0 + y1) // 2 END AS b0,
  CASE WHEN shift >= 0 THEN (y0 + y1) // 2 + (y1 - y0) // 6 ELSE y1 END AS b1 FROM ac),
ov AS (SELECT p.page_id, p.acc_id, n.ng, greatest(0, least(a1, x1) - greatest(a0, x0)) * greatest(0, least(b1, y1) - greatest(b0, y0)) AS area FROM pb p JOIN note n ON n.page_id = p.page_id),
bs AS (SELECT * FROM ov WHERE area > 0 QUALIFY row_number() OVER (PARTITION BY page_id, acc_id ORDER BY area DESC, ng) = 1)""") + """
SELECT ac.page_id, ac.acc_id, coalesce(bs.ng, -1) AS ng, bs.ng IS NULL AS maybe_key_signature FROM ac LEFT JOIN bs ON bs.page_id = ac.page_id AND bs.acc_id = ac.acc_id""")
def accidental_to_note(spark, sf):
    heads = load(spark, sf, "note").select("page_id", "ng", *box())
    return attach.accidental_to_note(_accidentals(spark, sf), heads).select("page_id", "acc_id", F.coalesce("ng", F.lit(-1)).alias("ng"), "maybe_key_signature")


# Chains of one to eight accidentals before a head: each stands 12 to the left of the one it leads to, a little higher; some chains stop short of the head.
CHAIN = """cn AS (SELECT page_id, ng, pk, sk, accidental, x0, y0, y1, unnest(range(pk % 8 + 1)) AS j FROM note WHERE accidental IS NOT NULL),
ac AS (SELECT page_id, (ng % 1152921504606846976) * 8 + j AS acc_id, accidental AS shift, x0 - 12 - 12 * j - CASE WHEN sk % 5 = 0 THEN 12 ELSE 0 END AS x0, y0 - 6 - 9 * j AS y0,
  x0 - 2 - 12 * j - CASE WHEN sk % 5 = 0 THEN 12 ELSE 0 END AS x1, y1 + 6 - 9 * j AS y1 FROM cn),
hd AS (SELECT page_id, staff_index * 16 + slot AS chord_id, min(ng) AS ng, x0, y0, x1, y1 FROM note WHERE is_rest = 0 GROUP BY ALL),
pb AS (SELECT page_id, acc_id, x1 AS a0, x1 + (x1 - x0) AS a1, CASE WHEN shift >= 0 THEN (y0 + y1) // 2 - (y1 - y0) // 6 ELSE (y0 + y1) // 2 END AS b0,
  CASE WHEN shift >= 0 THEN (y0 + y1) // 2 + (y1 - y0) // 6 ELSE y1 END AS b1 FROM ac),
ov AS (SELECT p.page_id, p.acc_id, n.ng, greatest(0, least(a1, x1) - greatest(a0, x0)) * greatest(0, least(b1, y1) - greatest(b0, y0)) AS area FROM pb p JOIN hd n ON n.page_id = p.page_id),
bs AS (SELECT * FROM ov WHERE area > 0 QUALIFY row_number() OVER (PARTITION BY page_id, acc_id ORDER BY area DESC, ng) = 1),
att AS (SELECT ac.*, bs.ng FROM ac LEFT JOIN bs USING (page_id, acc_id)),
nx AS (SELECT a.page_id, a.acc_id, min(b.acc_id) AS next_id FROM att a JOIN ac b ON b.page_id = a.page_id AND a.ng IS NULL AND least(a.x1 + (a.x1 - a.x0) // 2, b.x1) > greatest(a.x1, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) GROUP BY 1, 2),
wk AS (SELECT page_id, acc_id, acc_id AS end_id, 0 AS steps FROM att UNION ALL SELECT wk.page_id, wk.acc_id, nx.next_id, wk.steps + 1 FROM wk JOIN nx ON nx.page_id = wk.page_id AND nx.acc_id = wk.end_id),
en AS (SELECT * FROM wk QUALIFY row_number() OVER (PARTITION BY page_id, acc_id ORDER BY steps DESC) = 1),
ch AS (SELECT e.*, a.ng, b.ng AS end_ng, h.chord_id, (SELECT count(*) FROM hd x WHERE x.page_id = h.page_id AND x.chord_id = h.chord_id) AS n_heads, p.b0, p.b1
  FROM en e JOIN att a USING (page_id, acc_id) JOIN pb p USING (page_id, acc_id) JOIN att b ON b.page_id = e.page_id AND b.acc_id = e.end_id LEFT JOIN hd h ON h.page_id = b.page_id AND h.ng = b.ng),
mt AS (SELECT c.page_id, c.acc_id, c.steps, h.ng AS head FROM ch c JOIN hd h ON h.page_id = c.page_id AND h.chord_id = c.chord_id WHERE c.ng IS NULL AND c.n_heads > 1 AND least(b1, y1) > greatest(b0, y0)
  QUALIFY row_number() OVER (PARTITION BY c.page_id, c.acc_id ORDER BY least(b1, y1) - greatest(b0, y0) DESC, h.ng) = 1),
wn AS (SELECT *, row_number() OVER (PARTITION BY page_id, head ORDER BY steps DESC, acc_id) = 1 AND NOT EXISTS (SELECT 1 FROM att WHERE att.page_id = mt.page_id AND att.ng = mt.head) AS won FROM mt),
ro AS (SELECT ch.*, head, CASE WHEN ch.ng IS NOT NULL THEN 'note' WHEN end_ng IS NULL THEN 'key_signature' WHEN n_heads = 1 THEN 'single_head' WHEN head IS NULL THEN 'no_head' WHEN won THEN 'chord' ELSE 'taken' END AS role
  FROM ch LEFT JOIN wn USING (page_id, acc_id))"""


def _chained(spark, sf):
    notes = load(spark, sf, "note")
    n = notes.filter("accidental IS NOT NULL").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pk") % 8)))
    left = 12 * F.col("j") + F.when(F.col("sk") % 5 == 0, 12).otherwise(0)
    acc = n.select("page_id", (F.col("ng") % (1 << 60) * 8 + F.col("j")).alias("acc_id"), F.col("accidental").alias("shift"), (F.col("x0") - 12 - left).alias("x0"),
                   (F.col("y0") - 6 - 9 * F.col("j")).alias("y0"), (F.col("x0") - 2 - left).alias("x1"), (F.col("y1") + 6 - 9 * F.col("j")).alias("y1"))
    heads = notes.filter("is_rest = 0").select("page_id", "ng", (F.col("staff_index") * 16 + F.col("slot")).alias("chord_id"), *box())
    return attach.accidental_chains(attach.accidental_to_note(acc, heads.drop("chord_id")).drop("maybe_key_signature"), heads)


@query("accidental_chains", with_views("note", then=CHAIN, recursive=True) + """
SELECT page_id, acc_id, end_id, steps::BIGINT AS steps, role, coalesce(CASE WHEN role = 'chord' THEN head ELSE ng END, -1) AS ng FROM ro""")
def accidental_chains(spark, sf):
    return _chained(spark, sf).fillna(-1, ["ng"])


@query("accidental_roles", with_views("note", then=CHAIN, recursive=True) + "SELECT role, max(steps)::BIGINT AS longest, count(*) AS n FROM ro GROUP BY 1")
def accidental_roles(spark, sf):
    return _chained(spark, sf).groupBy("role").agg(F.max("steps").alias("longest"), F.count("*").alias("n"))


@query("dot_to_note", with_views("note", then="""
dt AS (SELECT DISTINCT page_id, x1 + 4 + sk % 50 AS cx, y0 + 6 + pk % 60 AS cy FROM note WHERE has_dot = 1)""") + """
SELECT n.page_id, n.ng AS head_id, EXISTS (SELECT 1 FROM dt WHERE dt.page_id = n.page_id AND cx BETWEEN x1 AND x1 + 2 * unit
  AND cy BETWEEN CASE WHEN is_rest = 1 THEN y0 ELSE greatest(0, y0 - unit) END AND y0 + CASE WHEN is_rest = 1 THEN 2 * unit ELSE unit * 3 // 2 END) AS has_dot FROM note n""")
def dot_to_note(spark, sf):
    n = load(spark, sf, "note")
    heads = n.select("page_id", F.col("ng").alias("head_id"), "unit", (F.col("is_rest") == 1).alias("is_rest"), *box())
    cx, cy = F.col("x1") + 4 + F.col("sk") % 50, F.col("y0") + 6 + F.col("pk") % 60
    dots = n.filter("has_dot = 1").select("page_id", *Box(cx - 2, cy - 2, cx + 2, cy + 2).columns())
    return attach.attach_dots(heads, dots).select("page_id", "head_id", "has_dot")


@query("rest_absorption", with_views("note") + """
SELECT r.page_id, r.ng AS rest_id, min(g.ng) AS ng FROM note r JOIN note g ON g.page_id = r.page_id AND g.staff_index = r.staff_index
WHERE r.is_rest = 1 AND g.is_rest = 0 AND r.x0 < g.x1 AND g.x0 < r.x1 GROUP BY 1, 2""")
def rest_absorption(spark, sf):
    n = load(spark, sf, "note")
    rests = n.filter("is_rest = 1").select("page_id", "staff_index", F.col("ng").alias("rest_id"), *box())
    return attach.absorb_rests(rests, n.filter("is_rest = 0").select("page_id", "staff_index", "ng", *box()))


@query("overlap_drop", with_views("note", then=ACC + """,
c AS (SELECT DISTINCT page_id, x0 - 30 AS x0, y0 AS y0, x0 - 8 AS x1, y1 AS y1 FROM note WHERE is_rest = 0),
cv AS (SELECT a.page_id, a.acc_id, sum(greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0))) AS s,
  max((a.x1 - a.x0) * (a.y1 - a.y0)) AS area FROM ac a JOIN c ON c.page_id = a.page_id GROUP BY 1, 2)""") + """
SELECT page_id, acc_id FROM ac ANTI JOIN (SELECT page_id, acc_id FROM cv WHERE 2 * s > area) USING (page_id, acc_id)""")
def overlap_drop(spark, sf):
    covers = load(spark, sf, "note").filter("is_rest = 0").select(
        "page_id", (F.col("x0") - 30).alias("x0"), "y0", (F.col("x0") - 8).alias("x1"), "y1")
    return attach.drop_covered_by(_accidentals(spark, sf), covers, id_col="acc_id").select("page_id", "acc_id")


@query("median_band", with_views("gt", then="md AS (SELECT page_id, median((x1 - x0) * (y1 - y0)) AS m FROM gt GROUP BY 1)") + """
SELECT page_id, gt_seq FROM gt JOIN md USING (page_id) WHERE (x1 - x0) * (y1 - y0) BETWEEN m * 0.8::DOUBLE AND m * 1.2::DOUBLE""")
def median_band(spark, sf):
    return attach.median_band(load(spark, sf, "gt"), value=box().area).select("page_id", "gt_seq")


@query("tall_lines", with_views("gt", then="""
t AS (SELECT page_id, avg(h) AS top FROM (SELECT page_id, (y1 - y0) * 6 AS h, gt_seq FROM gt QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY y1 - y0 DESC, gt_seq) <= 5) GROUP BY 1)""") + """
SELECT page_id, gt_seq AS line_id FROM gt JOIN t USING (page_id) WHERE (y1 - y0) * 6 >= 3.75 * (16 + page_id % 5 * 2) AND (y1 - y0) * 6 > top * 0.5""")
def tall_lines(spark, sf):
    rows = load(spark, sf, "gt").select("page_id", F.col("gt_seq").alias("line_id"), (box().height * 6).alias("height"), (16 + F.col("page_id") % 5 * 2).alias("unit"))
    return attach.tall_lines(rows).select("page_id", "line_id")


@query("steep_lines", with_views("gt") + """
SELECT page_id, gt_seq FROM gt WHERE degrees(atan2((y1 - y0) * 4, x1 - x0)) >= 75""")
def steep_lines(spark, sf):
    b = box()
    rows = load(spark, sf, "gt").withColumn("y1", b.y0 + b.height * 4)
    return attach.steep_lines(rows).select("page_id", "gt_seq")


@query("size_filters", with_views("gt") + """
SELECT page_id, gt_seq FROM gt WHERE x1 - x0 >= 10 AND y1 - y0 >= 8 AND (x1 - x0) * (y1 - y0) >= 9 * (16 + page_id % 5 * 2) AND x1 - x0 >= y1 - y0""")
def size_filters(spark, sf):
    return attach.size_filter(load(spark, sf, "gt"), min_w=10, min_h=8, min_area=9 * (16 + F.col("page_id") % 5 * 2), min_aspect=1).select("page_id", "gt_seq")


@query("fused_split", with_views("gt", then="n AS (SELECT *, greatest(1, round_even((x1 - x0) / (8 * 1.3::DOUBLE), 0))::BIGINT AS nx, greatest(1, round_even((y1 - y0) / 8.0::DOUBLE, 0))::BIGINT AS ny FROM gt)") + """
SELECT page_id, gt_seq, px AS part_x, py AS part_y, x0 + (x1 - x0) * px // nx AS x0, y0 + (y1 - y0) * (py + 1) // ny AS y1 FROM (
  SELECT *, unnest(range(ny)) AS py FROM (SELECT *, unnest(range(nx)) AS px FROM n))""")
def fused_split(spark, sf):
    return attach.split_fused(load(spark, sf, "gt"), unit=F.lit(8)).select("page_id", "gt_seq", "part_x", "part_y", "x0", "y1")


@query("staff_steps", with_views("note") + """
SELECT page_id, ng, round_even((150 + 310 * staff_index + 2 * unit - (y0 + y1) / 2) / (unit / 2), 0)::BIGINT AS step FROM note""")
def staff_steps(spark, sf):
    return load(spark, sf, "note").select("page_id", "ng", attach.staff_step(box().cy, 150 + 310 * F.col("staff_index"), F.col("unit")).alias("step"))


PROFILE = """rp AS (SELECT page_id, staff_index AS zone, y, CASE WHEN y % unit = 3 AND (y > 3 OR page_id % 3 > 0) THEN 60 + (page_id * 7 + y * 13) % 40 ELSE (page_id + y * 5) % 9 END AS n
  FROM (SELECT *, unnest(range(0, 120)) AS y FROM staff))"""


def _profile(spark, sf):
    zones = load(spark, sf, "staff").repartition("page_id", "staff_index")  # dealt out before each zone becomes 120 rows
    rows = zones.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(119).cast("long"))))
    y, page = F.col("y"), F.col("page_id")
    line = (y % F.col("unit") == 3) & ((y > 3) | (page % 3 > 0))
    return rows.select("page_id", F.col("staff_index").alias("zone"), "y", F.when(line, 60 + (page * 7 + y * 13) % 40).otherwise((page + y * 5) % 9).alias("n"))


@query("profile_zscore", with_views("staff", then=PROFILE + """,
s AS (SELECT page_id, zone, count(*) + 2 AS r, sum(n)::DOUBLE AS s, sum(n * n)::DOUBLE AS ss FROM rp GROUP BY 1, 2)""") + """
SELECT page_id, zone, y, CAST(floor(((n - s / r) / (sqrt(r * ss - s * s) / r)) * 1000) AS BIGINT) AS z_1000 FROM rp JOIN s USING (page_id, zone)""")
def profile_zscore(spark, sf):
    return profile.zscores(_profile(spark, sf)).select("page_id", "zone", "y", F.floor(F.col("z") * 1000).alias("z_1000"))


@query("staff_peaks")
def staff_peaks(spark, sf):
    return profile.staff_line_peaks(_profile(spark, sf)).select("page_id", "zone", "grp", "line_no", "y", F.floor(F.col("z") * 1000).alias("z_1000"))


@query("zone_fill", with_views("staff", then="""
ce AS (SELECT page_id, staff_index AS staff_row, zone, zone * 300 + 250 AS x, y_top + 2 * unit + zone * 2 AS y, unit, (page_id + zone) % 4 = 0 AS partial
  FROM (SELECT *, unnest(range(0, 6)) AS zone FROM staff)),
kn AS (SELECT * FROM ce WHERE NOT partial),
og AS (SELECT * FROM ce WHERE partial AND (staff_row + page_id) % 8 <> 0),
nr AS (SELECT m.page_id, m.staff_row, m.zone, k.zone AS kz, k.x AS kx, k.y AS ky, k.unit AS ku,
  row_number() OVER (PARTITION BY m.page_id, m.staff_row, m.zone ORDER BY abs(k.zone - m.zone), k.zone) AS r
  FROM (SELECT * FROM ce WHERE partial) m JOIN kn k ON k.page_id = m.page_id AND k.staff_row = m.staff_row),
ab AS (SELECT a.*, b.kz AS bz, b.kx AS b_x, b.ky AS b_y FROM nr a LEFT JOIN nr b ON b.r = 2 AND b.page_id = a.page_id AND b.staff_row = a.staff_row AND b.zone = a.zone
  WHERE a.r = 1),
nx AS (SELECT ab.page_id, ab.staff_row, ab.zone, arg_min(struct_pack(x := og.x, y := og.y, unit := og.unit), og.y) AS o
  FROM ab JOIN og ON og.page_id = ab.page_id AND og.zone = ab.zone AND abs(og.y - ab.ky) < ab.ku * 3 GROUP BY 1, 2, 3)""") + """
SELECT page_id, staff_row, zone, x::DOUBLE AS x_center, y::DOUBLE AS y_center, unit::DOUBLE AS unit, false AS is_interpolated FROM kn UNION ALL
SELECT page_id, staff_row, zone, coalesce(o.x, kx + (b_x - kx) * ((zone - kz) / (bz - kz)), kx)::DOUBLE, coalesce(o.y, ky + (b_y - ky) * ((zone - kz) / (bz - kz)), ky)::DOUBLE,
  coalesce(o.unit, ku)::DOUBLE, o IS NULL FROM ab LEFT JOIN nx USING (page_id, staff_row, zone)""")
def zone_fill(spark, sf):
    cells = staves(spark, sf).withColumn("zone", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("x_center", F.col("zone") * 300 + 250)
    cells = cells.withColumn("y_center", F.col("center_y") + F.col("zone") * 2).select("page_id", F.col("staff_index").alias("staff_row"), "zone", "x_center", "y_center", "unit")
    partial = (F.col("page_id") + F.col("zone")) % 4 == 0
    originals = cells.filter(partial & ((F.col("staff_row") + F.col("page_id")) % 8 != 0)).drop("staff_row")
    return profile.fill_zones(cells.filter(~partial), originals)


@query("window_average", with_views("det", then="""
m AS (SELECT page_id, y0 // 100 AS y, x0 // 100 AS x, class_id % 5 AS channel, sum(conf_pct) / count(*) AS s FROM det GROUP BY 1, 2, 3, 4)""") + """
SELECT page_id, y, x, channel, CAST(floor(s * 1000) AS BIGINT) AS score_1000 FROM m QUALIFY row_number() OVER (PARTITION BY page_id, y, x ORDER BY s DESC, channel) = 1""")
def window_average(spark, sf):
    rows = load(spark, sf, "det").select("page_id", F.floor(F.col("y0") / 100).alias("y"), F.floor(F.col("x0") / 100).alias("x"),
                                         (F.col("class_id") % 5).alias("channel"), F.col("conf_pct").alias("score"))
    return profile.average_windows(rows).select("page_id", "y", "x", "channel", F.floor(F.col("score") * 1000).alias("score_1000"))


@query("sliding_occupancy", with_views("staff", then="""
oc AS (SELECT page_id, staff_index, x, CASE WHEN (page_id * 3 + staff_index + x // 7) % 3 = 0 THEN 1 ELSE 0 END AS o FROM (SELECT *, unnest(range(0, 80)) AS x FROM staff)),
hi AS (SELECT * FROM (SELECT *, sum(o) OVER (PARTITION BY page_id, staff_index ORDER BY x RANGE BETWEEN CURRENT ROW AND 5 FOLLOWING) / 6 AS m FROM oc) WHERE m > 0.5),
ru AS (SELECT *, x - row_number() OVER (PARTITION BY page_id, staff_index ORDER BY x) AS g FROM hi)""") + """
SELECT page_id, staff_index, min(x) AS x0, max(x) + 6 AS x1 FROM ru GROUP BY page_id, staff_index, g""")
def sliding_occupancy(spark, sf):
    return profile.occupied_windows(_occupancy(spark, sf), keys=["page_id", "staff_index"], width=6)


def _occupancy(spark, sf):
    cols = load(spark, sf, "staff").withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(79).cast("long"))))
    hit = (F.col("page_id") * 3 + F.col("staff_index") + F.floor(F.col("x") / 7)) % 3 == 0
    return cols.select("page_id", "staff_index", "x", F.when(hit, 1).otherwise(0).alias("occupancy"))


@query("best_range", with_views("staff", then="""
oc AS (SELECT page_id, staff_index, x, (page_id * 3 + staff_index * x + x) % 17 AS v FROM (SELECT *, unnest(range(0, 80)) AS x FROM staff)),
s AS (SELECT *, sum(v) OVER w AS t, count(*) OVER w AS n FROM oc WINDOW w AS (PARTITION BY page_id, staff_index ORDER BY x ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))""") + """
SELECT page_id, staff_index, x, t::BIGINT AS total FROM s WHERE n = 10 QUALIFY row_number() OVER (PARTITION BY page_id, staff_index ORDER BY t DESC, x) = 1""")
def best_range(spark, sf):
    cols = _occupancy(spark, sf).withColumn("value", (F.col("page_id") * 3 + F.col("staff_index") * F.col("x") + F.col("x")) % 17)
    return profile.best_range(cols, keys=["page_id", "staff_index"], length=10)


@query("staff_summary", with_views("staff") + """
SELECT page_id, avg(unit + staff_index % 2) AS global_unit, CAST(floor(avg(unit + staff_index % 2)) AS BIGINT) AS bar_height, count(DISTINCT track) AS n_tracks, count(*) AS n_staves FROM staff GROUP BY 1""")
def staff_summary(spark, sf):
    return staffs.page_units(staves(spark, sf).withColumn("unit", F.col("unit") + F.col("staff_index") % 2))


@query("zone_summary", with_views("staff", then="""
z AS (SELECT page_id, staff_index, 100 + k * 300 AS x0, 400 + k * 300 AS x1, y_top + (k * page_id) % 5 AS yt, y_top + 4 * unit + (k * page_id) % 5 AS yb, unit + k % 3 AS u FROM (SELECT *, unnest(range(6)) AS k FROM staff))""") + """
SELECT page_id, staff_index, min(x0) AS left_x, max(x1) AS right_x, median(yt) AS y_top, median(u) AS unit, max(u) - min(u) AS unit_spread FROM z GROUP BY 1, 2""")
def zone_summary(spark, sf):
    z = load(spark, sf, "staff").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    shift = (F.col("k") * F.col("page_id")) % 5
    parts = z.select("page_id", "staff_index", (100 + F.col("k") * 300).alias("x0"), (400 + F.col("k") * 300).alias("x1"), (F.col("y_top") + shift).alias("y_top"),
                     (F.col("y_top") + 4 * F.col("unit") + shift).alias("y_bottom"), (F.col("unit") + F.col("k") % 3).alias("unit"))
    return staffs.summarize_zones(parts).select("page_id", "staff_index", "left_x", "right_x", "y_top", "unit", "unit_spread")


@query("track_inference", with_views("gt", "staff", then="""
hh AS (SELECT page_id, (y1 - y0) * (1 + gt_seq % 4) / 2.0::DOUBLE AS r FROM gt), ns AS (SELECT page_id, count(*) AS n FROM staff GROUP BY 1),
ok AS (SELECT ns.page_id, i, (SELECT count(*) FROM hh WHERE hh.page_id = ns.page_id AND r > 10 * i) * (i + 1) > n AS ok FROM ns, range(1, 10) t(i))""") + """
SELECT page_id, coalesce(min(i) FILTER (NOT ok), 10) AS n_tracks FROM ok GROUP BY 1""")
def track_inference(spark, sf):
    ratio = box().height * (1 + F.col("gt_seq") % 4) / 2.0
    n = load(spark, sf, "staff").groupBy("page_id").agg(F.count("*").alias("n_staves"))
    return staffs.infer_tracks(load(spark, sf, "gt").select("page_id", ratio.alias("h_ratio")), n).select("page_id", F.col("n_tracks").cast("long").alias("n_tracks"))


@query("note_chunks", with_views("note", recursive=True, then="""
bm AS (SELECT page_id, ng AS beam_id, staff_index AS s, slot AS a, slot + 1 AS b FROM note WHERE rhythm > 0 AND h % 2 = 0),
ed AS (SELECT DISTINCT n.page_id, n.ng, b.beam_id FROM note n JOIN bm b ON b.page_id = n.page_id AND b.s = n.staff_index AND n.slot BETWEEN b.a AND b.b),
nn AS (SELECT DISTINCT x.page_id, x.ng AS u, y.ng AS v FROM ed x JOIN ed y ON y.page_id = x.page_id AND y.beam_id = x.beam_id),
re AS (SELECT page_id, u, u AS v FROM nn UNION SELECT re.page_id, re.u, nn.v FROM re JOIN nn ON nn.page_id = re.page_id AND nn.u = re.v)""") + """
SELECT page_id, u AS ng, min(v) AS chunk FROM re GROUP BY 1, 2""")
def note_chunks(spark, sf):
    n = load(spark, sf, "note")
    top = 150 + 310 * F.col("staff_index")
    stems = n.select("page_id", "ng", F.col("x0").alias("x0"), (top - 20).alias("y0"), "x1", (top + 20).alias("y1"))
    beams = n.filter("rhythm > 0 AND h % 2 = 0").select("page_id", F.col("ng").alias("beam_id"), "x0", (top - 10).alias("y0"), (F.col("x0") + 105).alias("x1"), top.alias("y1"))
    return clusters.note_chunks(stems, beams)


@query("note_size_clusters", with_views("gt", then="""
sz AS (SELECT page_id, list((x1 - x0) * (y1 - y0)) AS l, min((x1 - x0) * (y1 - y0))::DOUBLE AS lo, max((x1 - x0) * (y1 - y0))::DOUBLE AS hi FROM gt GROUP BY 1),
it AS (SELECT page_id, list_reduce(list_transform(range(20), lambda i: {'lo': lo, 'hi': hi}), lambda c, i: {
  'lo': coalesce(list_avg(list_filter(l, lambda v: abs(v - c.lo) <= abs(v - c.hi))), c.lo), 'hi': coalesce(list_avg(list_filter(l, lambda v: abs(v - c.lo) > abs(v - c.hi))), c.hi)}, {'lo': lo, 'hi': hi}) AS c FROM sz)""") + """
SELECT page_id, CAST(round(c.lo * 100) AS BIGINT) AS low_100, CAST(round(c.hi * 100) AS BIGINT) AS high_100 FROM it""")
def note_size_clusters(spark, sf):
    sizes = load(spark, sf, "gt").select("page_id", box().area.alias("size"))
    return clusters.two_means(sizes).select("page_id", F.round(F.col("low_center") * 100).cast("long").alias("low_100"),
                                            F.round(F.col("high_center") * 100).cast("long").alias("high_100"))


@query("box_clusters")
def box_clusters(spark, sf):
    return clusters.merge_nearby(load(spark, sf, "gt").select("page_id", *box()), 60.0)


@query("chord_flags", with_views("note") + """
SELECT page_id, staff_index * 100 + slot AS ng, count(DISTINCT rhythm) = 1 AS same_type, bool_or(rhythm < 2) AS has_stem, sum(CASE WHEN pitch < 0 THEN 1 ELSE -1 END) > 0 AS stem_up, count(*) AS n_heads FROM note GROUP BY 1, 2""")
def chord_flags(spark, sf):
    heads = load(spark, sf, "note").select("page_id", (F.col("staff_index") * 100 + F.col("slot")).alias("ng"), "rhythm", (F.col("rhythm") < 2).alias("has_stem"), (F.col("pitch") < 0).alias("stem_up"))
    return clusters.chord_flags(heads)


# Beams of no, one, two and three bars, a little uneven, and some blots.
THICK = """be AS (SELECT page_id, ng AS beam_id, unit, CASE WHEN rhythm = 0 THEN 0 ELSE rhythm * unit - 3 + h % 7 + CASE WHEN pk % 97 = 0 THEN 3 * unit ELSE 0 END END AS th FROM note),
lm AS (SELECT page_id, count(*) AS total, max(th) AS top, [1, floor(min(unit) * 0.6::DOUBLE)::BIGINT, floor(min(unit) * 1.8::DOUBLE)::BIGINT, floor(min(unit) * 2.7::DOUBLE)::BIGINT, floor(min(unit) * 3.2::DOUBLE)::BIGINT] AS li FROM be GROUP BY 1),
us AS (SELECT *, least(5, len(list_filter(li, lambda x: x <= top)) + 1) AS used FROM lm),
sg AS (SELECT us.page_id, j, count(be.th) AS n FROM us JOIN (SELECT unnest(range(1, 6)) AS j) ON j <= used JOIN be ON be.page_id = us.page_id AND be.th >= li[j] AND (j = used OR be.th < li[j + 1]) GROUP BY 1, 2),
kp AS (SELECT us.*, coalesce((SELECT max(j) FROM sg WHERE sg.page_id = us.page_id AND sg.n >= greatest(us.total // 100, 5)), 0) AS kept FROM us),
cl AS (SELECT be.page_id, beam_id, kept, CASE WHEN kept < used THEN least(th, li[kept + 1]) ELSE th END AS v FROM be JOIN kp USING (page_id)),
ct AS (SELECT page_id, kept, v, count(*) AS n FROM cl GROUP BY 1, 2, 3),
px AS (SELECT page_id, kept, v, row_number() OVER w AS i, CAST(sum(n) OVER w AS BIGINT) AS ns, CAST(sum(n * v) OVER w AS BIGINT) AS ss, CAST(sum(n * v * v) OVER w AS BIGINT) AS qs, count(*) OVER (PARTITION BY page_id) AS m FROM ct WINDOW w AS (PARTITION BY page_id ORDER BY v)),
p0 AS (SELECT page_id, i, ns, ss, qs FROM px UNION ALL SELECT DISTINCT page_id, 0, 0, 0, 0 FROM px),
co AS (SELECT a.page_id, a.i AS t, b.i AS i, (b.qs - a.qs)::DOUBLE - (b.ss - a.ss)::DOUBLE * (b.ss - a.ss)::DOUBLE / (b.ns - a.ns)::DOUBLE AS c FROM p0 a JOIN p0 b ON b.page_id = a.page_id AND b.i > a.i),
dp AS (SELECT page_id, 1 AS j, i, c, 0::BIGINT AS t FROM co WHERE t = 0
  UNION ALL
  SELECT dp.page_id, dp.j + 1, co.i, min(dp.c + co.c), arg_min(dp.i, {'c': dp.c + co.c, 't': dp.i}) FROM dp JOIN co ON co.page_id = dp.page_id AND co.t = dp.i WHERE dp.j < 6 AND dp.i >= dp.j GROUP BY dp.page_id, dp.j, co.i),
bt AS (SELECT DISTINCT px.page_id, least(kept + 1, m) AS j, m AS i FROM px
  UNION ALL
  SELECT bt.page_id, bt.j - 1, dp.t FROM bt JOIN dp ON dp.page_id = bt.page_id AND dp.j = bt.j AND dp.i = bt.i WHERE bt.j > 1)"""


@query("beam_thickness", with_views("note", then=THICK, recursive=True) + """
SELECT cl.page_id, cl.beam_id, (SELECT count(*) FROM bt WHERE bt.page_id = cl.page_id AND bt.i < px.i) AS thickness_class FROM cl JOIN px ON px.page_id = cl.page_id AND px.v = cl.v""")
def beam_thickness(spark, sf):
    blot = F.when(F.col("pk") % 97 == 0, 3 * F.col("unit")).otherwise(0)
    beams = load(spark, sf, "note").select("page_id", F.col("ng").alias("beam_id"), "unit", F.when(F.col("rhythm") == 0, 0).otherwise(
        F.col("rhythm") * F.col("unit") - 3 + F.col("h") % 7 + blot).alias("thickness"))
    return clusters.thickness_classes(beams).select("page_id", "beam_id", F.col("thickness_class").cast("long").alias("thickness_class"))
