"""Helpers shared by the operators: tables, staged results, Arrow text slices and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]"


#: Rows of an Arrow batch: texts are long, and a batch is in memory several times over.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts; sets the session's Arrow batches to BATCH_ROWS, which bounds the memory of Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: under `spark.checkpoint.dir`.

    Only a local session may go without that setting; it then gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut and lost executors lose nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def with_uid(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns and `uid`, a number of the row; stage the result before it is used twice."""
    return df.select(*columns, F.monotonically_increasing_id().alias("uid"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about `most` bytes of `column`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


#: A key with more than one in HOT_SHARE of all rows is joined by broadcast: there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1000


def join_copies(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of staged `rows` with one row per `key` in staged `groups`, whose `size` is the number of rows with that key.

    Rows of the few keys that hold many rows stay where they are and get a broadcast; the rest is shuffled.
    """
    bound = max(rows.count() // HOT_SHARE, 1)
    hot = groups.filter(F.col(size) > bound)
    some = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(F.col(size) <= bound), key)
    return some.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """`id, label` for every node of `edges(src, dst)`; the label is the smallest id reachable.

    Stars are folded first: every node goes to the smallest of its neighbours' neighbours below it, and only edges between different such
    nodes are left, few where groups hang on hubs. On these, each round takes the smallest label among the neighbours (combined
    before the shuffle) and then the label of that label, so that long chains need few rounds, until nothing moves.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = staged(both.groupBy(F.col("src").alias("id")).agg(F.least(F.col("id"), F.min("dst")).alias("near")), "near")
    below = near.select(F.col("id").alias("near"), F.col("near").alias("below"))
    start = staged(near.join(below, "near").select("id", F.col("below").alias("top")), "tops")
    left = edges.join(start.select(F.col("id").alias("src"), F.col("top").alias("a")), "src")
    left = left.join(start.select(F.col("id").alias("dst"), F.col("top").alias("b")), "dst").filter("a <> b")
    rest = staged(left.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct(), "edges")
    if rest.isEmpty():
        return start.select("id", F.col("top").alias("label"))
    labels = _settled(rest)
    return staged(start.join(labels.withColumnRenamed("id", "top"), "top", "left").select("id", F.coalesce("label", "top").alias("label")), "labels")


def _settled(edges: DataFrame) -> DataFrame:
    """Labels of the nodes of staged, distinct `edges`."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    labels = staged(both.groupBy(F.col("src").alias("id")).agg(F.least(F.col("id"), F.min("dst")).alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("id").alias("dst"), "label"), "dst")
                .groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near")))
        hooked = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("further"))
        stepped = staged(hooked.join(jump, "next", "left")
                         .select("id", "label", F.least("next", F.coalesce("further", "next")).alias("next")), "labels")
        labels = stepped.select("id", F.col("next").alias("label"))
        if stepped.filter("label <> next").isEmpty():
            return labels
