"""Bar calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators import bars, calibrate
from scorelake.plans.queries_bars import note_ticks
from scorelake.plans.registry import query

BAR = ["page_id", "staff_index", "bar_in_line"]


def _text(name: str):
    return F.array_join(F.col(name).cast("array<string>"), ",")


def elements(spark, sf):
    """One element per slot of a bar, as long as the shortest head of its chord (a rest only where no head sounds).

    Eighths and shorter are beamed by half bar.
    """
    rest = F.col("is_rest") == 1
    n = note_ticks(spark, sf).select(
        *BAR, F.col("slot").alias("elem_seq"), "ticks", rest.alias("is_rest"),
        F.when(rest, -1).when((F.col("rhythm") == 0), 0).otherwise(1 + F.floor(F.col("slot") % 4 / 2)).alias("group_id"),
        (F.col("pk") % 5 + 8).alias("beam_l"), (F.col("sk") % 5 + 8).alias("beam_r"), F.col("x1").alias("beam_x"),
        (F.col("y0") - F.col("h") % 9).alias("beam_y"), "ng")
    first = n.groupBy(*BAR, "elem_seq").agg(F.min(F.struct("is_rest", "ticks", "ng", "group_id", "beam_l", "beam_r", "beam_x", "beam_y")).alias("e"))
    return first.select(*BAR, "elem_seq", "e.*").drop("ng").withColumn("ts_num", F.lit(2)).withColumn("ts_den", F.lit(4))


def _bars(spark, sf):
    e = elements(spark, sf)
    kind = F.when(F.col("group_id") > 0, 2).when(F.col("group_id") == -1, 1).otherwise(0)
    out = e.groupBy(*BAR).agg(F.array_sort(F.collect_list(F.struct("elem_seq", "ticks", "is_rest", kind.alias("type")))).alias("r"))
    return out.select(
        *BAR, F.transform("r", lambda x: F.floor(x["ticks"] / 1260).cast("int")).alias("lengths"),
        F.transform("r", lambda x: F.when(x["is_rest"], 0.5).otherwise(1.0)).alias("weights"),
        F.transform("r", lambda x: x["type"]).alias("types"), F.lit(32).alias("target"), F.lit(16).alias("unit"), F.lit(2).alias("ts_num"))


@query("bar_calibration")
def bar_calibration(spark, sf):
    out = calibrate.calibrate_bars(_bars(spark, sf))
    return out.select(*BAR, _text("lengths").alias("lengths"), _text("calibrated").alias("calibrated"),
                      F.aggregate("calibrated", F.lit(0), lambda a, v: a + v).alias("total"))


@query("group_calibration")
def group_calibration(spark, sf):
    out = calibrate.calibrate_groups(_bars(spark, sf))
    return out.select(*BAR, _text("lengths").alias("lengths"), _text("types").alias("types"), _text("calibrated").alias("calibrated"),
                      F.aggregate("calibrated", F.lit(0), lambda a, v: a + v).alias("total"))


@query("tune_bars")
def tune_bars(spark, sf):
    return calibrate.tune_bars(elements(spark, sf), BAR).select(*BAR, "elem_seq", "tune_case", "ticks", "tuned_ticks")


@query("tuned_totals")
def tuned_totals(spark, sf):
    tuned = calibrate.tune_bars(elements(spark, sf), BAR)
    return tuned.groupBy(*BAR, "tune_case").agg(F.sum("ticks").alias("ticks"), F.sum("tuned_ticks").alias("tuned_ticks"),
                                                F.max("target_ticks").alias("target_ticks"))


@query("tune_audit")
def tune_audit(spark, sf):
    tuned = calibrate.tune_bars(elements(spark, sf), BAR).withColumn("ts_num", F.lit(2)).withColumn("ts_den", F.lit(4))
    out = bars.bar_totals(tuned.drop("ticks").withColumnRenamed("tuned_ticks", "ticks"), keys=BAR + ["tune_case"])
    return out.groupBy("tune_case").agg(F.count("*").alias("n_bars"), F.count(F.when(F.col("total_ticks") == F.col("target_ticks"), 1)).alias("n_ok"))
