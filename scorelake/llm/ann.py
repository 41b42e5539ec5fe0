"""Nearest vectors by cosine with an inverted multi-index.

The halves of the unit vectors are quantised apart, so that k centroids of each half make k * k cells. A query takes cells by the sum of its
distances to both centroids, with a heap, until they hold a fixed share of all entries; the sum it stops at describes
the cells it takes, and with that number alone it is sent to the parts that hold some of them. A part is a bounded run of cells (a larger
row of cells is dealt over several parts); it ranks the entries in the query's cells by their true cosine.

Equal vectors are one entry with its smallest ids, so a vector of a third of all rows is no larger than others. The centroids, and the share of
entries that finds enough of the true neighbours, come from a bounded sample; every row is indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import join_copies, staged
from scorelake.session import ship_package

#: Vectors that centroids are fitted to, and of these, queries that the share of entries is fitted to.
SAMPLE, TRIALS = 16_384, 256
#: Share of the true neighbours within the sample that the cells taken must hold.
RECALL = 0.97
#: A query takes at least this many entries: small tables are searched whole.
AT_LEAST = 2_000
#: Most centroids of a half; cell counts, at most MOST ** 2, are held by driver and tasks.
MOST = 256
#: Entries of a part.
PART = 16_384
ROUNDS = 10


def unit_halves(vectors: np.ndarray) -> list[np.ndarray]:
    """Both halves of the vectors at length one; the scale is a power of two first, so that no square overflows."""
    scaled = scale(vectors)
    unit = scaled / np.sqrt((scaled ** 2).sum(axis=1, keepdims=True))
    cut = unit.shape[1] // 2
    return [unit[:, :cut], unit[:, cut:]]


def scale(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component to about one; cosines stay as they are, bit by bit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row, every sum taken from the first component to the last in double precision."""
    a, b = scale(left).T, scale(right).T
    dot, one, two = np.zeros(a.shape[1]), np.zeros(a.shape[1]), np.zeros(a.shape[1])
    for x, y in zip(a, b):
        dot, one, two = dot + x * y, one + x * x, two + y * y
    return dot / (np.sqrt(one) * np.sqrt(two))


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points ** 2).sum(axis=1)[:, None] - 2 * points @ centroids.T + (centroids ** 2).sum(axis=1)


def fit_centroids(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from `k` of the points; a centroid without points stays."""
    centroids = points[np.random.default_rng(seed).choice(len(points), k, replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = distances(points, centroids).argmin(axis=1)
        held = np.bincount(nearest, minlength=k)
        sums = np.stack([np.bincount(nearest, weights=column, minlength=k) for column in points.T], axis=1) if points.shape[1] else centroids
        centroids = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centroids)
    return centroids


def assign(vectors: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """The two centroids of each vector."""
    return np.stack([distances(half, book).argmin(axis=1) for half, book in zip(unit_halves(vectors), books)], axis=1)


def reach(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> float:
    """The sum of distances at which the cells taken so far hold `wanted` entries; `sizes[i, j]` counts the entries of a cell.

    One frontier per row of the order by `first`; a row is opened when the row before it is.
    """
    rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    d1, d2, held = first[rows].tolist(), second[columns].tolist(), sizes[rows][:, columns].tolist()
    heap, total, summed = [(d1[0] + d2[0], 0, 0)], 0, -np.inf
    while heap:
        summed, a, b = heap[0]
        total += held[a][b]
        if total >= wanted:
            break
        if b + 1 < len(d2):
            heapq.heapreplace(heap, (d1[a] + d2[b + 1], a, b + 1))
        else:
            heapq.heappop(heap)
        if b == 0 and a + 1 < len(d1):
            heapq.heappush(heap, (d1[a + 1] + d2[0], a + 1, 0))
    return summed


def fit_share(vectors: np.ndarray, books: list[np.ndarray], count: int) -> float:
    """The smallest share of entries whose cells hold RECALL of the `count` true neighbours, over TRIALS vectors of the sample."""
    unit = np.concatenate(unit_halves(vectors), axis=1)
    tried = np.linspace(0, len(unit) - 1, min(TRIALS, len(unit))).astype(int)
    likeness = unit[tried] @ unit.T
    likeness[np.arange(len(tried)), tried] = -np.inf
    count = min(count, len(unit) - 1)
    if count < 1:
        return 1.0
    true = np.argpartition(-likeness, count - 1, axis=1)[:, :count]
    cells = assign(vectors, books)
    halves = [distances(half[tried], book) for half, book in zip(unit_halves(vectors), books)]
    summed = halves[0][:, cells[:, 0]] + halves[1][:, cells[:, 1]]
    order = np.sort(summed, axis=1)
    needed = np.stack([np.searchsorted(row, row_all[place], side="right") for row, row_all, place in zip(order, summed, true)])
    return float(np.quantile(needed, RECALL)) / len(unit)


def valid_vectors(rows: DataFrame) -> DataFrame:
    """`vec_id, v` of the vectors that take part: as long as most are (ties to the longer), finite, not null, not zero."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        "vec_id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> coalesce(x = x AND abs(x) < double('Infinity'), false)) AND exists(v, x -> x <> 0)")
    lengths = rows.groupBy(F.size("v").alias("d")).count()
    usual = lengths.agg(F.max(F.struct("count", "d"))["d"].alias("d")).first()["d"]
    return rows.filter(F.size("v") == F.lit(usual)) if usual else rows


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class MultiIndex:
    """Entries of a table of vectors in cells of two quantised halves, staged in the shared folder."""

    def __init__(self, rows: DataFrame, count: int = 5):
        """`rows(vec_id, embedding)`; searches are for the `count` nearest besides a query's own row.

        Vectors that are null, zero, of another length than most, or hold a null or non-finite component take no part. Repeated rows of one
        `vec_id` with equal vectors are one row; with different vectors each is an entry.
        """
        self.spark, self.count = rows.sparkSession, count
        ship_package(self.spark)
        self.rows = staged(valid_vectors(rows).withColumn("h", F.xxhash64("v")), "vectors")
        ranked = self.rows.distinct().withColumn("place", F.expr("row_number() OVER (PARTITION BY h, v ORDER BY vec_id)")).filter(f"place <= {count + 1}")
        entries = ranked.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        entries = staged(entries, "distinct")
        self.size = entries.count()
        if not self.size:
            return
        sample = matrix(entries.orderBy(F.xxhash64(F.col("ids")[0]), "h").select("v").limit(SAMPLE).toArrow().column("v"))
        k = min(1 << max(3, round(np.log2(self.size ** 0.5 / 3))), MOST, len(sample))
        self.books = books = [fit_centroids(half, k, seed) for seed, half in enumerate(unit_halves(sample))]
        self.wanted = min(self.size, max(AT_LEAST, int(np.ceil(fit_share(sample, books, count) * self.size))))

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cells = assign(matrix(batch.column("v")), books)
                    yield pa.record_batch({"v": batch.column("v"), "ids": batch.column("ids"), "i": pa.array(cells[:, 0]), "j": pa.array(cells[:, 1])})

        self.entries = staged(entries.mapInArrow(coded, "v array<double>, ids array<long>, i long, j long"), "cells")
        self.sizes = np.zeros((k, k), dtype=np.int64)
        for i, j, n in self.entries.groupBy("i", "j").count().collect():
            self.sizes[i, j] = n
        self.first, self.parts = deal_parts(self.sizes.sum(axis=1))

    def search(self, queries: DataFrame) -> DataFrame:
        """`query_id, rank, vec_id, score` for every row of `queries(vec_id)` that takes part in the index; ties go to the smaller `vec_id`."""
        out = "query_id long, rank int, vec_id long, score double"
        if not self.size:
            return self.spark.createDataFrame([], out)
        asked = staged(self.rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "h", "v").distinct(), "asked")
        single = staged(asked.groupBy("h", "v").agg(F.min("vec_id").alias("query"), F.count("*").alias("n")), "queries")
        found = self._nearest(single.select("query", "v"))
        best = found.withColumn("place", F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)")).filter(f"place <= {self.count + 1}")
        lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
        answered = staged(single.join(lists, "query").select("h", "v", "n", "near"), "answers")
        each = join_copies(asked, answered, ["h", "v"], "n").select(F.col("vec_id").alias("query_id"), "near")
        others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, self.count)
        return each.select("query_id", F.posexplode(others).alias("at", "x")).select(
            "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))

    def _nearest(self, single: DataFrame) -> DataFrame:
        """`query, vec_id, score`: per query and part at most `count + 1` entries, the query's own included."""
        books, sizes, wanted, first, parts, most = self.books, self.sizes, self.wanted, self.first, self.parts, self.count + 1
        filled = sizes.sum(axis=1) > 0

        def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                near = [distances(half, book) for half, book in zip(unit_halves(matrix(batch.column("v"))), books)]
                taken, part, limits = [], [], []
                for q in range(batch.num_rows):
                    limit = reach(near[0][q], near[1][q], sizes, wanted)
                    rows = np.flatnonzero(filled & (near[0][q] + near[1][q].min() <= limit + 1e-9))
                    at = np.unique(np.concatenate([np.arange(first[i], first[i] + parts[i]) for i in rows]))
                    taken.append(np.full(len(at), q))
                    part.append(at)
                    limits.append(np.full(len(at), limit))
                taken = np.concatenate(taken)
                yield pa.record_batch({"part": pa.array(np.concatenate(part)), "query": batch.column("query").take(pa.array(taken)),
                                       "reach": pa.array(np.concatenate(limits)), "v": batch.column("v").take(pa.array(taken))})

        def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = Part(books, most)
            for batch in batches:
                yield from part.take(batch)

        spread = self.spark.createDataFrame([(i, int(first[i]), int(parts[i])) for i in range(len(first))], "i long, first long, parts long")
        entries = self.entries.join(F.broadcast(spread), "i").select(
            (F.col("first") + F.pmod(F.xxhash64("ids"), F.col("parts"))).alias("part"), F.lit(None).cast("long").alias("query"),
            F.lit(None).cast("double").alias("reach"), "v", "ids", "i", "j")
        asked = single.mapInArrow(probes, "part long, query long, reach double, v array<double>")
        asked = asked.select("part", "query", "reach", "v", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("long").alias("i"),
                             F.lit(None).cast("long").alias("j"))
        dealt = entries.unionByName(asked).repartition("part").sortWithinPartitions("part", F.col("query").asc_nulls_first(), "i", "j")
        return dealt.mapInArrow(ranked, "query long, vec_id long, score double")


def deal_parts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of cells its first part and its number of parts: runs of rows share a part up to PART entries, larger rows take several."""
    first, parts, part, held = [], [], 0, 0
    for n in rows.tolist():
        own = max(1, -(-n // PART))
        if held and (own > 1 or held + n > PART):
            part, held = part + 1, 0
        first.append(part)
        parts.append(own)
        if own > 1:
            part, held = part + own, 0
        else:
            held += n
    return np.array(first), np.array(parts)


class Part:
    """Takes rows in order of part, entries before queries, and answers the queries a batch at a time."""

    def __init__(self, books: list[np.ndarray], most: int):
        self.books, self.most, self.part, self.held, self.ready = books, most, None, [], None

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        for a, b in zip(cuts, cuts[1:]):
            some = batch.slice(a, b - a)
            if parts[a] != self.part:
                self.part, self.held, self.ready = parts[a], [], None
            entries = some.column("query").null_count
            if entries:
                self.held.append(some.slice(0, entries).select(["v", "ids", "i", "j"]))
            if entries < some.num_rows and self.held:
                yield self.answer(some.slice(entries))

    def answer(self, asked: pa.RecordBatch) -> pa.RecordBatch:
        if self.ready is None:
            held = pa.Table.from_batches(self.held)
            vectors = matrix(held.column("v"))
            self.ready = vectors, np.concatenate(unit_halves(vectors), axis=1), held.column("ids").to_pylist(), held.column("i").to_numpy(), held.column("j").to_numpy()
        vectors, unit, ids, row, column = self.ready
        wanted = matrix(asked.column("v"))
        halves = unit_halves(wanted)
        flat, limit = np.concatenate(halves, axis=1), asked.column("reach").to_numpy()
        near = [distances(half, book) for half, book in zip(halves, self.books)]
        bounds = np.searchsorted(row, np.arange(len(self.books[0]) + 1))
        who, what, close = [], [], []
        for i in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[i], bounds[i + 1]
            left = limit - near[0][:, i]
            some = np.flatnonzero(near[1].min(axis=1) <= left + 1e-12)
            if not len(some):
                continue
            likeness = flat[some] @ unit[a:b].T
            likeness[near[1][some][:, column[a:b]] > left[some, None] + 1e-12] = -np.inf
            if b - a > self.most:
                least = np.partition(likeness, b - a - self.most, axis=1)[:, b - a - self.most, None] - 1e-9
                q, e = np.nonzero((likeness >= least) & (likeness > -np.inf))
            else:
                q, e = np.nonzero(likeness > -np.inf)
            who.append(some[q])
            what.append(e + a)
            close.append(likeness[q, e])
        q, e, s = _best(np.concatenate(who), np.concatenate(what), np.concatenate(close), self.most) if who else (np.zeros(0, int),) * 3
        exact = cosines(wanted[q], vectors[e]) if len(q) else np.zeros(0)
        found = sorted((int(x), -float(y), z) for x, y, k in zip(q, exact, e) for z in ids[k])
        kept, last, seen = [], None, 0
        for x, y, z in found:
            seen = seen + 1 if x == last else 1
            last = x
            if seen <= self.most:
                kept.append((x, z, -y))
        names = asked.column("query").to_pylist()
        return pa.record_batch({"query": pa.array([names[x] for x, _, _ in kept], pa.int64()), "vec_id": pa.array([z for _, z, _ in kept], pa.int64()),
                                "score": pa.array([y for _, _, y in kept], pa.float64())})


def _best(who: np.ndarray, what: np.ndarray, close: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each `who` the `most` closest, and all that are as close as the last of them but for rounding."""
    order = np.lexsort((-close, who))
    who, what, close = who[order], what[order], close[order]
    start = np.searchsorted(who, who)
    last = np.minimum(start + most, np.searchsorted(who, who, side="right")) - 1
    good = close >= close[last] - 1e-9
    return who[good], what[good], close[good]
