"""Packing by first-fit decreasing, with a tournament tree of bin capacities, in randomised groups of documents.

A document becomes its token ids and an end id, cut into full sequences and a rest. Full sequences need no search. The
rests of a group are placed by falling size into the first bin with room, found by descending a tree that holds the largest
free capacity below each node. A group has about GROUP documents whatever the size of the table, so that it fits a task;
rows are dealt by the hash of a row number, so copies or one source don't meet in a group more than by chance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import slices, staged
from scorelake.llm.tokens import encoder
from scorelake.session import ship_package

GROUP = 4096


def first_fit_decreasing(sizes: Sequence[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item; items of equal size in their given order."""
    leaves = 1
    while leaves < max(len(sizes), 1):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        node, size = 1, sizes[i]
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - free[node]
        free[node] -= size
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
    return bins, offsets


def _tokenize(path: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path).encode
        end = end_id.to_bytes(4, "little")
        for batch in slices(batches, "text"):
            counts, sums = [], []
            for text in batch.column("text").to_pylist():
                ids = code(text or "") + end
                counts.append(len(ids) // 4)
                sums.append([zlib.crc32(ids[a:a + 4 * width]) for a in range(0, len(ids), 4 * width)])
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "uid": batch.column("uid"),
                                   "doc_tokens": pa.array(counts, pa.int64()), "sums": pa.array(sums, pa.list_(pa.int64()))})
    return run


def _place(width: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid")
        tails, full = (rows["doc_tokens"] % width).tolist(), rows["doc_tokens"] // width
        at = [i for i, n in enumerate(tails) if n]
        bins, offsets = first_fit_decreasing([tails[i] for i in at], width)
        base = int(rows["box"].iloc[0]) << 32
        used = max(bins, default=-1) + 1
        out = pd.DataFrame({"uid": rows["uid"], "first_full": base + used + full.cumsum() - full, "tail_sequence": base, "tail_offset": 0})
        out.iloc[at, 2] = [base + b for b in bins]
        out.iloc[at, 3] = offsets
        return out
    return run


def pack_documents(docs: DataFrame, path: str, *, width: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents in sequences of at most `width` ids.

    One row per piece: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`. Null and empty texts are the end id
    alone; repeated rows and null ids are documents of their own. A `sequence_id` belongs to one sequence of the table.
    """
    ship_package(docs.sparkSession)
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("uid"))
                  .mapInArrow(_tokenize(path, end_id, width), "doc_id long, uid long, doc_tokens long, sums array<long>"), "tokens")
    boxes = rows.count() // GROUP + 1
    dealt = rows.select("uid", "doc_tokens", F.pmod(F.xxhash64("uid"), F.lit(boxes)).alias("box"))
    placed = dealt.groupBy("box").applyInPandas(_place(width), "uid long, first_full long, tail_sequence long, tail_offset long")
    pieces = rows.join(placed, "uid").select("*", F.posexplode("sums").alias("k", "ids_crc32"))
    start = F.col("k").cast("long") * width
    is_full = F.col("doc_tokens") - start >= width
    return pieces.select(
        "doc_id", start.alias("start"), F.least(F.lit(width), F.col("doc_tokens") - start).cast("long").alias("length"), "ids_crc32",
        "doc_tokens", F.when(is_full, F.col("first_full") + F.col("k")).otherwise(F.col("tail_sequence")).alias("sequence_id"),
        F.when(is_full, F.lit(0)).otherwise(F.col("tail_offset")).cast("long").alias("offset"))
