"""Bar numbers, clefs, keys and time carried over pages that arrive in any order.

A page is reduced to a summary per track: its number of bars and its last clef, key and time. Summaries combine from left to right like sums (the later
value wins where it is set), so what a page inherits is a prefix scan over the summaries of its piece. Bars are stored with what their own page says
and never written again; a late page adds its summary, and only the inherited values of the pages behind it are written anew. Readers
take the newest inherited values and fill what the page leaves open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scorelake.operators.prefix import carry_last, running
from scorelake.session import cut_lineage
from scorelake.streaming.pages import first_delivery

PAGE = ["piece", "page_id", "track"]
CARRIED = ["clef", "key", "time"]
BARS = "piece bigint, page_id bigint, track bigint, bar_no bigint, clef bigint, key bigint, ts_num bigint, ts_den bigint"
#: Pages of a segment of the prefix scan.
SEGMENT = 256


def page_summaries(bars: DataFrame) -> DataFrame:
    """`piece, page_id, track, n_bars, clef, key, time` of bars with `clef, key, time`, NULL where a bar has no change."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("bar_no"))).alias(c) for c in CARRIED]
    return bars.groupBy(*PAGE).agg(F.count("*").alias("n_bars"), *last)


def inherited(summaries: DataFrame) -> DataFrame:
    """What each page inherits: `first_bar`, the bars before it, and `clef_before, key_before, time_before`."""
    rows = summaries.withColumn("seg", F.floor(F.col("page_id") / SEGMENT))
    scan = {"keys": ["piece", "track"], "segment": "seg", "order": ["page_id"]}
    rows = carry_last(rows, **scan, columns=CARRIED, suffix="_before", inclusive=False)
    rows = running(rows, **scan, how="sum", value="n_bars", name="first_bar", inclusive=False)
    return rows.select(*PAGE, "first_bar", *(f"{c}_before" for c in CARRIED))


def _store(df: DataFrame, path: str, batch_id: int) -> None:
    """The rows of a batch; a batch that is run again replaces its own."""
    df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def carry_pages(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Take in arriving bars (columns of BARS); a page comes whole in one file, and pages delivered again are left out."""
    spark = pages.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        time = F.when(F.col("ts_num").isNotNull(), F.struct("ts_num", "ts_den")).alias("time")
        bars = cut_lineage(batch.select(*PAGE, "bar_no", "clef", "key", time))
        so_far = W.partitionBy(*PAGE).orderBy("bar_no").rowsBetween(W.unboundedPreceding, 0)
        _store(bars.select(*PAGE, "bar_no", *(F.last(c, True).over(so_far).alias(c) for c in CARRIED)), out + "/bars", batch_id)
        fresh = page_summaries(bars)
        _store(fresh, out + "/summaries", batch_id)
        touched = fresh.groupBy("piece").agg(F.min("page_id").alias("from_page"))
        known = spark.read.parquet(out + "/summaries").filter(F.col("batch_id") <= batch_id).drop("batch_id")
        known = known.join(touched, "piece")
        later = inherited(known.drop("from_page")).join(touched, "piece").filter("page_id >= from_page").drop("from_page")
        _store(later, out + "/inherited", batch_id)

    arriving = first_delivery(pages, ["page_id", "track", "bar_no"])
    return arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def carried_bars(spark: SparkSession, out: str) -> DataFrame:
    """All bars so far: `piece, page_id, track, bar_no, number, clef, key, time`; `number` counts the bars of the piece from 0."""
    before = [f"{c}_before" for c in CARRIED]
    newest = spark.read.parquet(out + "/inherited").groupBy(*PAGE).agg(F.max_by(F.struct("first_bar", *before), "batch_id").alias("b"))
    place = F.row_number().over(W.partitionBy(*PAGE).orderBy("bar_no")) - 1
    bars = spark.read.parquet(out + "/bars").withColumn("place", place).join(newest, PAGE)
    return bars.select(*PAGE, "bar_no", (F.col("b.first_bar") + F.col("place")).alias("number"),
                       *(F.coalesce(c, F.col(f"b.{c}_before")).alias(c) for c in CARRIED))
