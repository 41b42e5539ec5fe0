"""Preconditions that stop a job: assertions inside the plan, checked while the rows are read.

An assertion is a filter that lets every row pass or raises an error that names the offender. It costs no pass of its own and nothing reaches the
driver. Only rows that the job reads are checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, condition: Column, message: Column | str) -> DataFrame:
    """`df`; the job fails with `message` at a row for which `condition` is false or NULL."""
    message = F.lit(message) if isinstance(message, str) else message
    return df.filter(F.coalesce(condition, F.lit(False)) | F.raise_error(message).cast("boolean"))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """`df`; an error at once if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    """One row per key; the job fails with the first key that has more rows. Values other than the key must not matter for the choice."""
    rest = [c for c in df.columns if c not in key]
    counted = df.groupBy(*key).agg(F.count("*").alias("n_rows"), *(F.first(c).alias(c) for c in rest))
    named = F.concat_ws(", ", *(F.concat(F.lit(f"{k} "), F.coalesce(F.col(k).cast("string"), F.lit("NULL"))) for k in key))
    return require(counted, F.col("n_rows") == 1, F.concat(F.lit("repeated key: "), named)).select(*df.columns)


def require_known(df: DataFrame, known: DataFrame, key: str, what: str) -> DataFrame:
    """`df` with the columns of `known`, one row per `key`; the job fails with the key that `known` lacks."""
    found = df.join(known.withColumn("is_known", F.lit(True)), key, "left")
    return require(found, F.col("is_known"), F.concat(F.lit(f"unknown {what}: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))).drop("is_known")
