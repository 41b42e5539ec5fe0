"""Exact dedup on a persistent digest index (built-in functions only).

The index is a table bucketed and sorted by the SHA-256 of the normalised text. A batch of documents is first
reduced to one row per digest (combined before the shuffle), an anti-join by sort and merge finds the digests that the
index lacks, and these are appended. The index side needs no exchange, as its buckets are the join's partitioning.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import WHITE, join_copies, shared_folder, staged, text_or_empty


class DigestIndex:
    """Digests seen so far: `digest, keep_id, keep_chars, keep_uid, batch`, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 32):
        self.spark, self.buckets = spark, buckets
        self.folder = folder or shared_folder(spark, "digests")
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, keep_chars INT, keep_uid BIGINT, batch STRING) "
                  f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.folder}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        columns = self.rows().columns
        fresh.select(*columns).repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def add(self, docs: DataFrame) -> DataFrame:
        """Decide on a batch and append its new digests: one row per document.

        Columns: `doc_id, n_chars, keep_id, group_size, kept, text_sha256`. The row that stays has the most code points,
        then the smallest `doc_id` (null last), then comes first in the table, so that of repeated rows one stays. A digest
        already in the index drops all its rows and names the document kept then. Null texts count as empty.
        `group_size` counts the rows of this batch.
        """
        rows = staged(digests(docs), "batch")
        best = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "uid")
        groups = staged(rows.groupBy("digest").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
                        .select("digest", "group_size", F.col("best.doc_id").alias("keep_id"),
                                F.col("best.uid").alias("keep_uid"), (-F.col("best.col1")).alias("keep_chars")), "groups")
        batch = uuid.uuid4().hex
        seen = self.rows().select("digest").hint("merge")
        self.append(staged(groups.join(seen, "digest", "left_anti"), "fresh").withColumn("batch", F.lit(batch)))
        known = groups.select("digest", "group_size").join(self.rows(), "digest").withColumn("fresh", F.col("batch") == batch)
        known = staged(known.drop("batch"), "known")

        return join_copies(rows, known, "digest", "group_size").select(
            "doc_id", "n_chars", "keep_id", "group_size", (F.col("fresh") & (F.col("uid") == F.col("keep_uid"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"))


def digest_of(text: str = "text"):
    """SHA-256 of the text without white space, as bytes."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text), f"{WHITE}+", ""), 256))


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text_or_empty()).alias("n_chars"),
                       digest_of().alias("digest"), F.monotonically_increasing_id().alias("uid"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Repeated rows with one `doc_id` stay once."""
    index = index or DigestIndex(docs.sparkSession)
    kept = (index.add(docs).filter("kept")
            .select(F.col("doc_id").alias("k_id"), "n_chars", F.unhex("text_sha256").alias("k_digest")))
    kept = staged(kept, "kept")
    wide = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("k_id"), text_or_empty().alias("t"))
    wide = wide.select("row", "k_id", F.length("t").alias("n_chars"), digest_of("t").alias("k_digest"))
    same = (wide["k_id"].eqNullSafe(kept["k_id"])) & (wide["n_chars"] == kept["n_chars"]) & (wide["k_digest"] == kept["k_digest"])
    found = wide.join(kept, same, "left_semi")
    ids = docs.select(F.col("doc_id").cast("long").alias("k_id")).groupBy("k_id").count().filter("count > 1").select("k_id")
    ids = staged(ids, "repeated")
    if ids.isEmpty():
        return found.select("row.*")
    twice = found["k_id"].eqNullSafe(ids["k_id"])
    once = found.join(ids, twice, "left_semi").groupBy("k_id", "k_digest").agg(F.first("row").alias("row"))
    return found.join(ids, twice, "left_anti").select("row.*").unionByName(once.select("row.*"))
