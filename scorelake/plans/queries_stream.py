"""Streaming runs over the given tables, driven to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions.boxes import box
from scorelake.operators.detect import nms
from scorelake.operators import associate, detect
from scorelake.plans.common import CLASS_MAP_SQL, class_map, detections, staves
from scorelake.plans.derived import load, with_views
from scorelake.plans.queries_associate import ASSOC
from scorelake.plans.queries_bars import CLEF, KEYS, TS, _changes, _track_bars
from scorelake.plans.queries_detect import FOLD
from scorelake.plans.registry import query
from scorelake.session import scratch_folder
from scorelake.streaming import carry, pages

SCHEMA = "page_id bigint, class_id bigint, det_seq bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint, confidence double, conf_pct bigint"


def _arriving(spark, sf, folder):
    """Detections as files of whole pages, the form in which pages arrive."""
    det = detections(spark, sf).select("page_id", "class_id", "det_seq", *box(), "confidence", "conf_pct")
    det.repartition("page_id").write.parquet(folder + "/in")
    return pages.read_pages(spark, folder + "/in", SCHEMA, files_per_batch=4)


@query("stream_nms", with_views("det", then=FOLD) + """
SELECT page_id, class_id, u.s AS det_seq, u.c AS conf_pct FROM (SELECT page_id, class_id, unnest(kept) AS u FROM k)""")
def stream_nms(spark, sf):
    folder = scratch_folder(spark, "stream-nms")
    pages.process_pages(_arriving(spark, sf, folder), folder + "/out", folder + "/checkpoint", step=nms).awaitTermination()
    return spark.read.parquet(folder + "/out").select("page_id", "class_id", "det_seq", "conf_pct")


@query("stream_totals", with_views("det") + "SELECT page_id // 20 AS piece, count(*) AS n, CAST(sum(conf_pct) AS BIGINT) AS conf_pct FROM det GROUP BY 1")
def stream_totals(spark, sf):
    folder = scratch_folder(spark, "stream-totals")
    arriving = _arriving(spark, sf, folder).withColumn("piece", F.floor(F.col("page_id") / 20))
    pages.write_totals(pages.running_totals(arriving, ["piece"]), folder + "/out", folder + "/checkpoint", ["piece"]).awaitTermination()
    return pages.latest_totals(spark, folder + "/out", ["piece"])


@query("stream_refresh", with_views("det") + "SELECT page_id // 20 AS piece, max(page_id) AS last_page, count(*) AS n FROM det GROUP BY 1")
def stream_refresh(spark, sf):
    """Carried state per piece: only the pieces that a batch touches are computed again."""
    folder = scratch_folder(spark, "stream-refresh")
    det = detections(spark, sf).select("page_id", "class_id", "det_seq", *box(), "confidence", "conf_pct")
    det.withColumn("piece", F.floor(F.col("page_id") / 20)).repartitionByRange("piece").write.parquet(folder + "/in")  # pages of a piece arrive together
    arriving = pages.read_pages(spark, folder + "/in", SCHEMA + ", piece bigint", files_per_batch=4)
    state = lambda: spark.read.parquet(folder + "/in")
    rerun = lambda rows: rows.groupBy("piece").agg(F.max("page_id").alias("last_page"), F.count("*").alias("n"))
    pages.refresh_pieces(arriving, state, rerun, folder + "/out", folder + "/checkpoint").awaitTermination()
    return pages.latest_pieces(spark, folder + "/out").select("piece", "last_page", "n")


@query("stream_once", with_views("det") + "SELECT page_id, class_id, det_seq, conf_pct FROM det")
def stream_once(spark, sf):
    """Half of the files, then, after a restart, all files and each of them a second time."""
    folder = scratch_folder(spark, "stream-once")
    det = detections(spark, sf).select("page_id", "class_id", "det_seq", *box(), "confidence", "conf_pct")
    for mode, some in (("errorifexists", det.filter("page_id % 2 = 0")), ("append", det), ("append", det)):
        some.repartition(4, "page_id").write.mode(mode).parquet(folder + "/in")
        arriving = pages.read_pages(spark, folder + "/in", SCHEMA, files_per_batch=3)
        pages.process_pages(arriving, folder + "/out", folder + "/checkpoint", step=lambda rows: rows).awaitTermination()
    return spark.read.parquet(folder + "/out").select("page_id", "class_id", "det_seq", "conf_pct")


@query("stream_association", with_views("det", "note", "staff", then=FOLD + """,
kd AS (SELECT det.* FROM det JOIN (SELECT page_id, class_id, u.s AS det_seq FROM (SELECT page_id, class_id, unnest(kept) AS u FROM k)) USING (page_id, class_id, det_seq)), """
       + CLASS_MAP_SQL + ", " + ASSOC.replace("FROM det d", "FROM kd d")) + """
SELECT page_id, det_seq, class_name, coalesce(matched_ng, -1) AS matched_ng, status FROM res""")
def stream_association(spark, sf):
    """Arriving detections, each page twice: suppressed, then joined to the note groups of their page."""
    folder = scratch_folder(spark, "stream-association")
    groups, staff, names = load(spark, sf, "note").select("page_id", "ng", *box()), staves(spark, sf), class_map(spark)

    def step(rows):
        found = rows.select("page_id").distinct()
        kept = detect.map_classes(nms(rows), names).select("page_id", F.col("det_seq").alias("cand_seq"), "class_name", "side", *box(), "confidence")
        done = associate.associate_symbols(kept, groups.join(found, "page_id", "left_semi"), staff.join(found, "page_id", "left_semi"))
        return done.select("page_id", F.col("cand_seq").alias("det_seq"), "class_name", F.coalesce("matched_ng", F.lit(-1)).alias("matched_ng"),
                           F.col("association_status").alias("status"))

    det = detections(spark, sf).select("page_id", "class_id", "det_seq", *box(), "confidence", "conf_pct")
    for _ in range(2):
        det.repartition(2, "page_id").write.mode("append").parquet(folder + "/in")
    arriving = pages.read_pages(spark, folder + "/in", SCHEMA, files_per_batch=2)
    pages.process_pages(arriving, folder + "/out", folder + "/checkpoint", step=step).awaitTermination()
    return spark.read.parquet(folder + "/out").drop("batch_id")


@query("stream_carry", with_views("page", "note", then=TS + ", " + CLEF + ", " + KEYS + """,
np AS (SELECT page_id AS p, dense_rank() OVER (PARTITION BY page_id // 20 ORDER BY page_id) - 1 AS k FROM page)""") + """
SELECT cf.piece, cf.page_id, cf.bar_no, cf.track, k * 8 + cf.bar_no AS number, cf.clef::BIGINT AS clef, kf.key, t.n AS ts_num, t.d::BIGINT AS ts_den
FROM cf JOIN kf USING (piece, page_id, bar_no, track) JOIN ts USING (piece, page_id, bar_no) JOIN np ON p = cf.page_id""")
def stream_carry(spark, sf):
    """Bar numbers, clefs, keys and time of pages that arrive out of order, and twice."""
    folder = scratch_folder(spark, "stream-carry")
    key = ["piece", "page_id", "track", "bar_no"]
    options = spark.createDataFrame([(0, [1]), (1, [1, 0]), (2, [0, 1]), (3, [-1, 0])], "track bigint, allowed array<bigint>")
    note = load(spark, sf, "note").select(F.floor(F.col("page_id") / 20).alias("piece"), "page_id", "track", F.col("bar_in_line").alias("bar_no"), "ng", "h", "pk")
    clefs = note.filter("pk % 13 = 0").withColumn("clef", F.col("h") % 3 - 1).join(options, "track").filter(
        (F.size("allowed") > 1) & F.array_contains("allowed", F.col("clef"))).groupBy(*key).agg(F.max_by("clef", "ng").alias("clef"))
    found = note.filter("pk % 17 = 0").groupBy(*key).agg(F.max(F.col("pk") % 9 - 4).alias("key"))
    bars = _track_bars(spark, sf).join(clefs, key, "left").join(found, key, "left").join(_changes(spark, sf), ["piece", "page_id", "bar_no"], "left")
    bars = bars.withColumn("key", F.coalesce("key", F.when((F.col("bar_no") == 0) & (F.col("page_id") % 4 == 0), 0)))
    late = F.pmod(F.xxhash64("page_id"), F.lit(3))
    rows = bars.select("piece", "page_id", "track", "bar_no", "clef", "key", "ts_num", "ts_den").withColumn("turn", late)
    for turn in (2, 0, 1, 0):
        rows.filter(F.col("turn") == turn).drop("turn").repartition(2, "page_id").write.mode("append").parquet(folder + "/in")
        arriving = pages.read_pages(spark, folder + "/in", carry.BARS)
        carry.carry_pages(arriving, folder + "/out", folder + "/checkpoint").awaitTermination()
    done = carry.carried_bars(spark, folder + "/out").join(options, "track")
    return done.select("piece", "page_id", "bar_no", "track", "number", F.coalesce("clef", F.col("allowed")[0]).alias("clef"),
                       F.coalesce("key", F.lit(0)).alias("key"), "time.ts_num", "time.ts_den")
