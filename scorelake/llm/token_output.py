"""Packed id matrices for training: best-fit decreasing, with a segment tree over capacities.

Documents longer than a sequence are cut without loss into full sequences and a rest. In each randomised group of documents the
rests are placed by falling size into the fullest bin that has room: the leaves of the tree are the capacities, a node tells
whether a bin below it is open, and the search walks to the smallest capacity that is large enough. A shard of the
output holds one group: the id matrix in row order, the cumulative segment lengths of each row and where positions start again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import shared_folder, slices
from scorelake.llm.tokens import encoder
from scorelake.session import ship_package

GROUP = 2048
SHARD = ("shard long, width int, ids binary, segments array<int>, cu_lengths array<int>, resets array<int>, doc_ids array<long>, "
         "starts array<long>")


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item: the fullest bin with room, of equally full ones the one opened or filled last."""
    leaves = 1 << capacity.bit_length()
    open_below = [0] * (2 * leaves)
    holders: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = [0] * len(sizes), [0] * len(sizes), 0

    def note(leaf: int, change: int) -> None:
        node = leaf + leaves
        while node:
            open_below[node] += change
            node //= 2

    def smallest(size: int) -> int:
        node = size + leaves
        if open_below[node]:
            return size
        while node > 1 and (node & 1 or not open_below[node + 1]):
            node //= 2
        if node <= 1:
            return -1
        node += 1
        while node < leaves:
            node = 2 * node + (not open_below[2 * node])
        return node - leaves

    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room = smallest(sizes[i])
        if room < 0:
            room, which, made = capacity, made, made + 1
        else:
            which = holders[room].pop()
            note(room, -1)
        bins[i], offsets[i] = which, capacity - room
        if room > sizes[i]:
            holders[room - sizes[i]].append(which)
            note(room - sizes[i], 1)
    return bins, offsets


def _narrow(ids: bytes) -> bytes:
    """Ids of 32 bits as ids of 16 bits; an error if one needs more."""
    wide = np.frombuffer(ids, dtype="<u4")
    if wide.max(initial=0) >= 1 << 16:
        raise ValueError("an id of 65,536 or above does not fit into the matrix")
    return wide.astype("<u2").tobytes()


def _ids(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end, kind = encoder(path).encode, end_id.to_bytes(4, "little"), pa.binary()
        for batch in slices(batches, "text"):
            ids = [_narrow(code(t or "") + end) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "uid": batch.column("uid"), "box": batch.column("box"),
                                   "named": batch.column("named"), "ids": pa.array(ids, kind)})
    return run


def _matrix(width: int, pad_id: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid")
        doc_ids = [d if named else None for d, named in zip(rows["doc_id"].tolist(), rows["named"])]
        ids = [np.frombuffer(x, dtype="<u2") for x in rows["ids"]]
        pieces = [(d, a, min(width, len(x) - a)) for d, x in enumerate(ids) for a in range(0, len(x), width)]
        bins, offsets = best_fit_decreasing([p[2] for p in pieces], width)
        matrix = np.full((max(bins, default=-1) + 1, width), pad_id, dtype="<u2")
        within: list[list[tuple[int, int]]] = [[] for _ in range(len(matrix))]
        for p, ((d, a, n), b, at) in enumerate(zip(pieces, bins, offsets)):
            matrix[b, at:at + n] = ids[d][a:a + n]
            within[b].append((at, p))
        order = [p for row in within for _, p in sorted(row)]
        lengths = [np.cumsum([0, *(pieces[p][2] for _, p in sorted(row))]).tolist() for row in within]
        return pd.DataFrame({
            "shard": [int(rows["box"].iloc[0])], "width": [width], "ids": [matrix.tobytes()], "segments": [[len(x) - 1 for x in lengths]],
            "cu_lengths": [[n for x in lengths for n in x]], "resets": [[n for x in lengths for n in x[:-1]]],
            "doc_ids": [[doc_ids[pieces[p][0]] for p in order]],
            "starts": [[pieces[p][1] for p in order]]})
    return run


def write_packed(docs: DataFrame, path: str, folder: str, *, width: int = 1024, end_id: int = 0, pad_id: int = 0) -> None:
    """Write shards of `ids` (rows of `width` unsigned 16-bit ids), with, over the rows in turn: `segments` per row, `cu_lengths`
    (0, then the end of each segment), `resets` (where positions begin again at 0), and `doc_ids`, `starts` of the segments.

    Null and empty texts are the end id alone. Ids of 65,536 or above are an error. Every row of the table is written once.
    """
    spark = docs.sparkSession
    ship_package(spark)
    boxes = docs.count() // GROUP + 1
    number = F.col("doc_id").cast("long")
    dealt = docs.select(F.coalesce(number, F.lit(0)).alias("doc_id"), number.isNotNull().alias("named"), "text", F.monotonically_increasing_id().alias("uid"))
    dealt = dealt.withColumn("box", F.pmod(F.xxhash64("uid"), F.lit(boxes)))
    (dealt.mapInArrow(_ids(path, end_id), "doc_id long, uid long, box long, named boolean, ids binary")
     .groupBy("box").applyInPandas(_matrix(width, pad_id), SHARD).write.parquet(folder))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard in batch.to_pylist():
            width, out, p, c = shard["width"], [], 0, 0
            matrix = np.frombuffer(shard["ids"], dtype="<u2").reshape(-1, width)
            for r, count in enumerate(shard["segments"]):
                ends = shard["cu_lengths"][c:c + count + 1]
                for a, b in zip(ends, ends[1:]):
                    out.append((shard["doc_ids"][p], shard["starts"][p], b - a, zlib.crc32(matrix[r, a:b].astype("<u4").tobytes()),
                                (shard["shard"] << 32) + r, shard["resets"][p]))
                    p += 1
                c += count + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in zip(*out)], names=["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"])


def read_segments(spark, folder: str) -> DataFrame:
    """The segments of written shards, cut out of the matrices again."""
    return spark.read.parquet(folder).mapInArrow(
        _segments, "doc_id long, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_segments(docs: DataFrame, path: str) -> DataFrame:
    """Write the matrices of all documents to the shared folder and read their segments."""
    folder = shared_folder(docs.sparkSession, "matrices")
    write_packed(docs, path, folder)
    return read_segments(docs.sparkSession, folder)
