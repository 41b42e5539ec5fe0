"""Running aggregates in two levels.

A window over a hot key would sort the whole key in one task. Here the key is cut in segments (a
column that never decreases along the order, such as a page or a block of pixels): totals per
segment are combined first, a small window runs over the segments, and the row-level window only
spans one segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _both(df: DataFrame, per_segment: DataFrame, keys: Sequence[str], segment: str) -> DataFrame:
    return df.join(per_segment, [*keys, segment], "left")


def carry_last(df: DataFrame, *, keys: Sequence[str], segment: str, order: Sequence[str],
               columns: Sequence[str], suffix: str = "_filled", inclusive: bool = True) -> DataFrame:
    """Add `<column><suffix>`: the last non-null value at (or before) each row."""
    position = F.struct(*order)
    totals = df.groupBy(*keys, segment).agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"__{c}") for c in columns))
    before = W.partitionBy(*keys).orderBy(segment).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, segment, *(F.last(f"__{c}", True).over(before).alias(f"__{c}") for c in columns))
    upto = W.partitionBy(*keys, segment).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    out = _both(df, totals, keys, segment)
    for c in columns:
        out = out.withColumn(c + suffix, F.coalesce(F.last(c, True).over(upto), F.col(f"__{c}")))
    return out.drop(*(f"__{c}" for c in columns))


def running(df: DataFrame, *, keys: Sequence[str], segment: str, order: Sequence[str], how: str,
            value: str | Column, name: str, inclusive: bool = True) -> DataFrame:
    """Add a running `sum` or `max` of `value`; rows before the first one give NULL (max) or 0 (sum)."""
    value = F.col(value) if isinstance(value, str) else value
    fn = {"sum": F.sum, "max": F.max}[how]
    work = df.withColumn("__v", value)
    totals = work.groupBy(*keys, segment).agg(fn("__v").alias("__t"))
    before = W.partitionBy(*keys).orderBy(segment).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, segment, fn("__t").over(before).alias("__t"))
    upto = W.partitionBy(*keys, segment).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    inner = fn("__v").over(upto)
    if how == "sum":
        total = F.coalesce(inner, F.lit(0)) + F.coalesce(F.col("__t"), F.lit(0))
    else:
        total = F.greatest(inner, F.col("__t"))
    return _both(work, totals, keys, segment).withColumn(name, total).drop("__v", "__t")


def row_number(df: DataFrame, *, keys: Sequence[str], segment: str, order: Sequence[str], name: str) -> DataFrame:
    """1-based position of each row in its key."""
    return running(df, keys=keys, segment=segment, order=order, how="sum", value=F.lit(1).cast("long"), name=name)


def islands(df: DataFrame, *, keys: Sequence[str], segment: str, order: Sequence[str], starts: Column,
            name: str) -> DataFrame:
    """Number the runs of rows; `starts` is true on the first row of a run."""
    return running(df, keys=keys, segment=segment, order=order, how="sum",
                   value=F.when(starts, 1).otherwise(0).cast("long"), name=name)
