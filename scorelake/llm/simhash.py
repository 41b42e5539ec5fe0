"""SimHash fingerprints of whole texts, and all fingerprints within a Hamming radius.

The terms of a text are its pairs of neighbouring words; each distinct term votes with its weight (growing with the logarithm of its count)
for or against each of BITS bits by its hash, and the sign of a bit's sum is the bit. The share of bits in which two fingerprints
differ estimates the angle between the weighted term vectors, whose cosine is the likeness.

For the search, a fingerprint is cut into BLOCKS blocks: two that differ in fewer than BLOCKS bits agree in one block at least. One
table per block, permuted so that the block leads, is joined on it; a pair counts in the first block where it agrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import join_copies, slices, staged
from scorelake.llm.shingles import LEFT, RIGHT, U64, mix, text_bytes, words
from scorelake.session import ship_package

BITS, BLOCKS = 256, 8
RADIUS = BLOCKS - 1
_SALT = np.arange(1, BITS // 64 + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)


def vote(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """BITS bits as bytes from distinct term hashes and their whole weights; a sum of zero gives a zero bit."""
    sums, total = np.zeros(BITS, dtype=np.int64), int(weights.sum())
    for a in range(0, len(terms), 4096):
        bits = np.unpackbits(mix(terms[a:a + 4096, None] + _SALT).view(np.uint8).reshape(-1, BITS // 8), axis=1)
        part = weights[a:a + 4096]
        sums += bits.sum(axis=0, dtype=np.int64) * 16
        heavy = part > 16
        if heavy.any():
            sums += (part[heavy] - 16) @ bits[heavy].astype(np.int64)
    return np.packbits(2 * sums > total)


def fingerprints(column: pa.Array) -> np.ndarray:
    """One row of bytes per text; a text of one word has it as its only term, one without words has no votes and zero bits."""
    data, offsets = text_bytes(column)
    h, at = words(data, offsets)
    pairs = mix(h[:-1] * LEFT + h[1:] * RIGHT)
    out = np.zeros((len(offsets) - 1, BITS // 8), dtype=np.uint8)
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if b > a:
            terms, counts = np.unique(pairs[a:b - 1] if b - a > 1 else h[a:b], return_counts=True)
            out[k] = vote(terms, 16 + np.rint(16 * np.log2(counts)).astype(np.int64))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated cosine, 0 to 1, of the terms of two lists of fingerprints, pair by pair."""
    apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return np.maximum(np.cos(np.pi * apart / BITS), 0.0)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


OUT = ("pid int, kind int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
       "near_next double, text string")


def _rows(pid: int, kind: int, ids: list, texts: list[str], following: list[str], prints: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    changed = [edited(t, f) for t, f in zip(texts, following)]
    new = fingerprints(pa.array(changed, pa.large_string()))
    n = len(texts)
    return pa.record_batch({
        "pid": pa.array([pid] * n, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
        "fingerprint": pa.array([p.tobytes().hex() for p in prints], pa.string()),
        "edited_fingerprint": pa.array([p.tobytes().hex() for p in new], pa.string()),
        "near_edited": pa.array(likeness(prints, new)), "near_next": pa.array(likeness(prints, after)), "text": pa.nulls(n, pa.string())})


def _border(pid: int, kind: int, doc_id: int | None, text: str) -> pa.RecordBatch:
    empty = {"edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
    return pa.record_batch({"pid": pa.array([pid], pa.int32()), "kind": pa.array([kind], pa.int32()), "doc_id": pa.array([doc_id], pa.int64()),
                            "n_chars": pa.array([len(text)], pa.int64()), **{k: pa.nulls(1, v) for k, v in empty.items()}, "text": pa.array([text])})


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order: each with the next one's text. The first row is also given as a head (kind 2), the last as a tail
    that waits for the next range's head (kind 1)."""
    pid, last = TaskContext.get().partitionId(), None
    for batch in slices(batches, "text"):
        ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
        prints = fingerprints(pa.array(texts, pa.large_string()))
        if last is None:
            yield _border(pid, 2, ids[0], texts[0])
        else:
            ids, texts, prints = [last[0], *ids], [last[1], *texts], np.vstack([last[2][None], prints])
        if len(texts) > 1:
            yield _rows(pid, 0, ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
        last = ids[-1], texts[-1], prints[-1]
    if last is not None:
        yield _border(pid, 1, last[0], last[1])


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts, following = batch.column("text").to_pylist(), batch.column("following").to_pylist()
        prints, after = (fingerprints(pa.array(x, pa.large_string())) for x in (texts, following))
        yield _rows(0, 0, batch.column("doc_id").to_pylist(), texts, following, prints, after)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """`doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next` per document.

    Documents follow one another by falling `doc_id` (nulls last, equal ids in table order), the first after the last. Ranges of ids are dealt
    out and sorted, so a task has each text's follower at hand; only the first text of each range is passed on to the range before.
    Null texts count as empty; equal texts have equal fingerprints.
    """
    spark = docs.sparkSession
    ship_package(spark)
    order = F.desc_nulls_last("doc_id"), F.col("uid")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("uid"))
    done = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_ordered, OUT), "prints")
    ranges = sorted(r["pid"] for r in done.filter("kind = 2").select("pid").collect())
    after = spark.createDataFrame([(p, q) for p, q in zip(ranges, ranges[1:] + ranges[:1])], "pid int, next int")
    heads = done.filter("kind = 2").select(F.col("pid").alias("next"), F.col("text").alias("following"))
    tails = done.filter("kind = 1").select("pid", "doc_id", "text").join(F.broadcast(after), "pid").join(heads, "next")
    joined = tails.select("doc_id", "text", "following").mapInArrow(_tails, OUT)
    return done.filter("kind = 0").unionByName(joined).drop("pid", "kind", "text")


def _blocks(column: str):
    return F.array(*(F.conv(F.substring(column, 1 + k * 8, 8), 16, 10).cast("long") for k in range(BITS // 32)))


def near_fingerprints(prints: DataFrame, queries: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """`query, fingerprint, apart` for each distinct fingerprint of `queries` and every distinct one of `prints` within `radius` bits.

    Both tables have a column `fingerprint`; nulls are left out. All pairs within the radius are found (pigeonhole).
    """
    if radius >= BLOCKS:
        raise ValueError(f"{BLOCKS} blocks find radii below {BLOCKS}")
    tables = []
    for df, name in ((queries, "query"), (prints, "fingerprint")):
        distinct = df.select("fingerprint").dropna().distinct()
        cut = distinct.select(F.unhex("fingerprint").alias(name), F.posexplode(_blocks("fingerprint")).alias("slot", "block"))
        tables.append(cut.select(name, (F.col("slot").cast("long") * (1 << 32) + F.col("block")).alias("key")))
    found = tables[0].join(tables[1], "key").select(
        F.lower(F.hex("query")).alias("query"), F.lower(F.hex("fingerprint")).alias("fingerprint"), F.floor(F.col("key") / (1 << 32)).alias("slot"))
    found = found.select("*", _blocks("query").alias("a"), _blocks("fingerprint").alias("b"))
    first = F.array_position(F.zip_with("a", "b", lambda x, y: x == y), True)
    apart = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (found.filter(first == F.col("slot") + 1)
            .select("query", "fingerprint", apart.alias("apart")).filter(F.col("apart") <= radius))


def with_neighbours(prints: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """The rows of `prints` with `n_near`: for ids divisible by 20, how many documents have a fingerprint within the radius (the
    document itself and copies included); null for the others."""
    prints = staged(prints, "fingerprints")
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    copies = staged(prints.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.sum(asked.cast("long")).alias("asked")), "copies")
    pairs = near_fingerprints(copies, copies.filter("asked > 0"), radius=radius)
    counts = staged(pairs.join(copies.select("fingerprint", "copies"), "fingerprint").groupBy("query").agg(F.sum("copies").alias("n_near"))
                    .join(copies.select(F.col("fingerprint").alias("query"), "asked"), "query").withColumnRenamed("query", "fingerprint"), "near")
    found = join_copies(prints.filter(asked), counts, "fingerprint", "asked").drop("asked")
    return found.unionByName(prints.filter(~asked).withColumn("n_near", F.lit(None).cast("long")))
