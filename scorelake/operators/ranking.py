"""Exact order statistics and samples without sorting a whole key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_rank_key(*columns: str | Column, seed: int) -> Column:
    """A reproducible pseudo-random key: md5 of seed and row key (the same text in any engine)."""
    parts = [F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c for c in columns)]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def lowest_n(df: DataFrame, *, keys: Sequence[str], hash_col: str, quota: DataFrame, quota_col: str,
             prefix: int = 4) -> DataFrame:
    """The `quota_col` rows of each key with the smallest hash; `quota` has one row per key.

    Rows are counted per hash prefix, whole prefixes below the quota are taken at once, and only
    the prefix that holds the boundary is ranked.
    """
    buckets = df.withColumn("__b", F.substring(hash_col, 1, prefix))
    upto = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    counts = (buckets.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
              .withColumn("__cum", F.sum("__n").over(upto))
              .join(quota.select(*keys, F.col(quota_col).alias("__quota")), list(keys))
              .filter(F.col("__cum") - F.col("__n") < F.col("__quota"))
              .select(*keys, "__b", (F.col("__quota") - F.col("__cum") + F.col("__n")).alias("__room"), "__n"))
    rows = buckets.join(counts, [*keys, "__b"])
    whole = rows.filter(F.col("__room") >= F.col("__n"))
    edge = rows.filter(F.col("__room") < F.col("__n")).withColumn(
        "__r", F.row_number().over(W.partitionBy(*keys, "__b").orderBy(hash_col))).filter(F.col("__r") <= F.col("__room"))
    return whole.unionByName(edge.drop("__r")).drop("__b", "__room", "__n")


def value_block(value: Column, steps: int = 512) -> Column:
    """A non-decreasing block number of a value: `steps` blocks per doubling on both sides of 0."""
    magnitude = F.floor(F.log2(F.abs(value) + 1) * steps)
    return F.when(value < 0, -magnitude - 1).otherwise(magnitude).cast("long")


def quantiles(df: DataFrame, *, keys: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key.

    Equal values are counted before the shuffle; ranks come from block totals, so neither a hot key
    nor many distinct values meet in one task.
    """
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v"))
              .agg(F.count("*").alias("__n")).withColumn("__b", value_block(F.col("__v"))))
    blocks = counts.groupBy(*keys, "__b").agg(F.sum("__n").alias("__bn"))
    over_key = W.partitionBy(*keys)
    ordered = over_key.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    blocks = (blocks.withColumn("__before", F.coalesce(F.sum("__bn").over(ordered), F.lit(0)))
              .withColumn("__total", F.sum("__bn").over(over_key)))
    wanted = []
    for name, fraction in fractions.items():
        position = (F.col("__total") - 1) * F.lit(fraction)
        low = F.floor(position)
        wanted.append(F.struct(F.lit(name).alias("q"), low.alias("low"),
                               F.least(low + 1, F.col("__total") - 1).alias("high"),
                               (position - low).alias("weight")))
    # only blocks that hold a wanted rank go on
    blocks = blocks.withColumn("__want", F.filter(F.array(*wanted), lambda w: (
        (w["low"].between(F.col("__before"), F.col("__before") + F.col("__bn") - 1))
        | (w["high"].between(F.col("__before"), F.col("__before") + F.col("__bn") - 1))))).filter(F.size("__want") > 0)
    inside = W.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)
    ranked = (counts.join(blocks.select(*keys, "__b", "__before", "__want"), [*keys, "__b"])
              .withColumn("__lo", F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
              .withColumn("__hi", F.col("__lo") + F.col("__n") - 1)
              .withColumn("__w", F.explode("__want")))
    low_value = F.max(F.when(F.col("__w.low").between(F.col("__lo"), F.col("__hi")), F.col("__v")))
    high_value = F.max(F.when(F.col("__w.high").between(F.col("__lo"), F.col("__hi")), F.col("__v")))
    points = ranked.groupBy(*keys, F.col("__w.q").alias("q")).agg(
        (low_value + (high_value - low_value) * F.max("__w.weight")).alias("x"))
    return points.groupBy(*keys).agg(*(F.max(F.when(F.col("q") == n, F.col("x"))).alias(n) for n in fractions))


def summarize(df: DataFrame, *, keys: Sequence[str], value: str) -> DataFrame:
    """count, min, p25, median, mean, p75, p95, max of a value per key."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.min(F.col(value).cast("double")).alias("min"),
        F.avg(value).alias("mean"), F.max(F.col(value).cast("double")).alias("max"))
    points = quantiles(df, keys=keys, value=value,
                       fractions={"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})
    condition = F.lit(True)
    for key in keys:
        condition = condition & base[key].eqNullSafe(points[key])
    return base.join(points, condition, "left").select(
        *(base[k] for k in keys), "count", "min", "p25", "median", "mean", "p75", "p95", "max")
