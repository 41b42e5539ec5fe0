"""A corpus from `documents`: toxic documents go, then exact copies, then near copies, and the rest is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelake.llm import exact, near, packing, toxic
from scorelake.llm.common import staged, table
from scorelake.llm.queries import BYTE_BPE, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts stay, columns and repeated rows are as they were."""
    return toxic.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest stays, then the smallest `doc_id`; null counts as empty. Of repeated rows one stays."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word similarity of 0.8 the smallest `doc_id` stays; texts without words are in no group."""
    return near.near_dedup(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in sequences of at most 1024 tokens; null and empty texts are the end id alone."""
    return packing.pack_documents(docs, vocabulary(BYTE_BPE))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("MinHash near-dedup", drop_near_copies), ("packing", pack)]

#: No SQL: the classifier, the exact linkage of near copies and the packing are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`; each result is written as Parquet and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
