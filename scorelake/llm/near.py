"""Near-duplicates by MinHash: a multi-index Hamming join of b-bit signatures, confirmed on full sets.

A signature holds CHUNKS * WIDTH minima of 16 bits. Two signatures that differ in fewer than 2 * CHUNKS places have a chunk with
at most one differing place (pigeonhole), so each chunk is indexed once per place that may be wrong, by the rest of the chunk:
all pairs under that distance share a key. Sets of similarity 0.8 differ in a fifth of the places; they share no key with a
probability of 2e-6, the more similar ones less.

Links are confirmed on the full sets, so that only real links join documents. In the group of a key every member is paired with the
group's smallest (a star, not all pairs). For members far from that one, pairs are added until every two members that may be alike are
joined by a chain of pairs, cell by cell. These pairs span families: all members that may be alike are in one. Where confirmed links don't join a whole family, its members outside the largest component
are compared with all its members, sets in hand, in cells of bounded size that give back one link per component at most. Texts with
equal sets are one member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import components, join_copies, slices, staged
from scorelake.llm.shingles import U64, mix, shingle_sets
from scorelake.session import ship_package

CHUNKS, WIDTH = 10, 5
PLACES = CHUNKS * WIDTH
#: Of the first 50 places one bit each is carried beside a key; pairs of similarity 0.8 differ in 5 of them on average, in more than
#: FAR with a probability under 1e-6.
FAR = 18
#: Members of one side of a cell.
CELL = 512

_seeds = np.random.default_rng(7).integers(0, 1 << 64, (2, PLACES), dtype=U64)
FACTOR, SHIFT = _seeds[0] | U64(1), _seeds[1]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The lowest 16 bits of the minima of PLACES hash functions over a set."""
    low = np.full(PLACES, np.iinfo(np.uint64).max, dtype=U64)
    for a in range(0, len(hashes), 2048):
        values = np.multiply.outer(FACTOR, hashes[a:a + 2048])  # a row per function, so that its minimum runs along memory
        values += SHIFT[:, None]
        low = np.minimum(low, values.min(axis=1))
    return low.astype("<u2")


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), size)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "uid": batch.column("uid"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set_id": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                "sig": pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())})
    return run


def _elements(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), size)
            yield pa.record_batch({
                "set_id": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                "elements": pa.array([s.tobytes() for s in sets], pa.binary())})
    return run


def _identified(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "r_text"):
            sets = shingle_sets(batch.column("r_text"), size)
            yield pa.record_batch({
                "row": batch.column("row"), "r_id": batch.column("r_id"),
                "r_set": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                "n": pa.array([len(s) for s in sets], pa.int64())})
    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every chunk of a signature without each of its places in turn, as a 64-bit key."""
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), dtype="<u2").reshape(-1, PLACES).astype(U64)
            bits = np.packbits((sig & U64(1)).astype(np.uint8), axis=1)
            sketch = np.zeros((len(sig), 8), dtype=np.uint8)
            sketch[:, :bits.shape[1]] = bits
            rep = part.column("rep").to_numpy()
            keys = []
            for c in range(CHUNKS):
                for gone in range(WIDTH):
                    h = np.full(len(sig), c * WIDTH + gone + 1, dtype=U64)
                    for k in range(WIDTH):
                        if k != gone:
                            h = mix(h * U64(0x9E3779B97F4A7C15) + sig[:, c * WIDTH + k])
                    keys.append(h)
            yield pa.record_batch({"key": pa.array(np.concatenate(keys).view(np.int64)), "rep": pa.array(np.tile(rep, PLACES)),
                                   "sketch": pa.array(np.tile(sketch.view(np.int64).ravel(), PLACES))})


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            good = np.zeros(len(left), dtype=bool)
            for i, (a, b) in enumerate(zip(left, right)):
                small, large = sorted((len(a) // 8, len(b) // 8))
                if 100 * small >= percent * large:
                    both = len(np.intersect1d(np.frombuffer(a, dtype=U64), np.frombuffer(b, dtype=U64), assume_unique=True))
                    good[i] = 100 * both >= percent * (small + large - both)
            yield pa.record_batch({"src": batch.column("src"), "dst": batch.column("dst")}).filter(pa.array(good))
    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal `columns` from a sorted stream of batches, each whole."""
    rest: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        new = pa.concat_tables([rest, new]).combine_chunks() if rest is not None else new
        ids = np.stack([new.column(c).to_numpy() for c in columns])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist()]
        for a, b in pairwise(cuts):
            yield new.slice(a, b - a)
        rest = new.slice(cuts[-1])
    if rest is not None and len(rest):
        yield rest


def _joined(labels: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """Labels after the labels of each pair are made one."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for x, y in pairs:
        x, y = top(x), top(y)
        parent[max(x, y)] = min(x, y)
    values, place = np.unique(labels, return_inverse=True)
    return np.array([top(v) for v in values.tolist()], dtype=np.int64)[place]


def bridges(apart: np.ndarray, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs (row, column) no more than FAR apart that join all rows and columns which a chain of such pairs joins.

    `one` and `two` are the labels of rows and columns; equal labels are joined already. First every row and column gives its closest partner of
    another label, then, round by round, every set of joined ones gives its closest pair to the outside (Boruvka), until none is left.
    """
    n, first = len(one), True
    while True:
        outside = np.where(one[:, None] == two, 99, apart)
        found: dict[tuple[int, int], int] = {}
        for i, j in ((np.arange(n), outside.argmin(axis=1)), (outside.argmin(axis=0), np.arange(len(two)))):
            gap = outside[i, j]
            found |= {(x, y): g for x, y, g in zip(i.tolist(), j.tolist(), gap.tolist()) if g <= FAR}
        if not found:
            return
        if not first:  # the closest pair of each label is enough
            best: dict[int, tuple[int, tuple[int, int]]] = {}
            for pair, gap in found.items():
                for label in (int(one[pair[0]]), int(two[pair[1]])):
                    best[label] = min(best.get(label, (99, pair)), (gap, pair))
            found = {pair: gap for gap, pair in best.values()}
        yield from found
        labels = _joined(np.concatenate([one, two]), [(int(one[i]), int(two[j])) for i, j in found])
        one, two, first = labels[:n], labels[n:], False


def _closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each cell, pairs that join all members which pairs under FAR join; members tied to one hub are joined already."""
    for group in _whole_groups(batches, ["key", "low", "high"]):
        rep, tie, block, sketch = (group.column(c).to_numpy() for c in ("rep", "tie", "block", "sketch"))
        one, two = np.flatnonzero(block == group.column("low")[0].as_py()), np.flatnonzero(block == group.column("high")[0].as_py())
        if len(one) and len(two):
            apart = np.bitwise_count(sketch[one, None] ^ sketch[two]).astype(np.int16)
            pairs = [(int(rep[one[i]]), int(rep[two[j]])) for i, j in bridges(apart, tie[one], tie[two])]
            found = dict.fromkeys((max(p), min(p)) for p in pairs)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["src", "dst"])


def _strays(members: DataFrame) -> DataFrame:
    """Pairs that join members far from their group's hub to all they may be alike to. Groups are cut into blocks, pairs of blocks are cells."""
    blocks = F.floor(F.col("n") / CELL).cast("int") + 1
    laid = (members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "tie", "sketch"))
    return (laid.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
            .mapInArrow(_closest, "src long, dst long").distinct())


def _compare(percent: int):
    """In each cell every stray with every member, by their sets: one link to each other component that it is alike to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_groups(batches, ["family", "row", "line"]):
            stray, rep, comp = (group.column(c).to_numpy(zero_copy_only=False) for c in ("stray", "rep", "comp"))
            sets = [np.frombuffer(x, dtype=U64) for x in group.column("elements").to_pylist()]
            ours, theirs = np.flatnonzero(stray), np.flatnonzero(~stray)
            if not len(ours) or not len(theirs):
                continue
            sizes = np.array([len(sets[i]) for i in theirs])
            joined, starts = np.concatenate([sets[i] for i in theirs]), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            links: set[tuple[int, int]] = set()
            for i in ours:
                own = sets[i]
                place = np.minimum(np.searchsorted(own, joined), len(own) - 1)
                both = np.add.reduceat((own[place] == joined).astype(np.int64), starts)
                alike = (100 * both >= percent * (len(own) + sizes - both)) & (comp[theirs] != comp[i])
                _, first = np.unique(comp[theirs[alike]], return_index=True)
                links |= {(int(rep[i]), int(r)) for r in rep[theirs[alike]][first]}
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["src", "dst"])
    return run


def _family_links(nodes: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links that join the components of a family: `nodes(rep, family, comp)`, staged. Cells are blocks of strays by blocks of members."""
    sizes = nodes.groupBy("family", "comp").agg(F.count("*").alias("n"))
    whole = (sizes.groupBy("family").agg(F.sum("n").alias("n"), F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("main"))
             .filter("n > 2 AND comps > 1")
             .select("family", F.col("main.comp").alias("main"), (F.floor(F.col("n") / CELL) + 1).cast("int").alias("lines"),
                     (F.floor((F.col("n") - F.col("main.n")) / CELL) + 1).cast("int").alias("rows")))
    held = staged(nodes.join(whole, "family").join(full, "rep"), "families")
    block = lambda count, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    members = held.select("family", every("rows").alias("row"), block("lines", 1).alias("line"), F.lit(False).alias("stray"), "rep", "comp", "elements")
    strays = held.filter("comp <> main").select("family", block("rows", 2).alias("row"), every("lines").alias("line"), F.lit(True).alias("stray"),
                                                "rep", "comp", "elements")
    return (members.unionByName(strays).repartition("family", "row", "line").sortWithinPartitions("family", "row", "line")
            .mapInArrow(_compare(percent), "src long, dst long"))


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: `doc_id, n_shingles, component_id, kept`, with `uid` of the row and `set_id`.

    Documents are linked if their sets of distinct word shingles (A-Z as a-z) share `percent` of the union; components are
    taken over links. `component_id` is the smallest `doc_id` in the component and that document is kept; of rows that repeat this
    `doc_id` the first stays. Null ids count as the largest. Texts without words (or null) have an empty set, link with
    nothing and stay.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = staged(source.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(
        _sketches(words), "doc_id long, uid long, n_shingles long, set_id binary, sig binary"), "sets")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    classes = staged(sets.filter("n_shingles > 0").groupBy("set_id").agg(
        F.min("uid").alias("rep"), F.min(first).alias("first"), F.first("sig").alias("sig"), F.count("*").alias("copies")), "classes")

    keys = classes.select("rep", "sig").mapInArrow(_keys, "key long, rep long, sketch long")
    hubs = (keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("rep", "sketch")).alias("hub"))
            .filter("n > 1").select("key", "n", F.col("hub.rep").alias("hub"), F.col("hub.sketch").alias("hub_sketch")))
    members = staged(keys.join(hubs, "key").select(
        "key", "n", "rep", "sketch", "hub", (F.bit_count(F.col("sketch").bitwiseXOR(F.col("hub_sketch"))) <= FAR).alias("close")), "members")

    stars = members.filter("close AND rep <> hub").select(F.col("rep").alias("src"), F.col("hub").alias("dst"))
    loose = members.filter("n > 2 AND NOT close").select("key").distinct()
    strays = _strays(members.join(loose, "key").withColumn("tie", F.when(F.col("close"), F.col("hub")).otherwise(F.col("rep"))))
    pairs = staged(stars.unionByName(strays).distinct(), "pairs")

    nodes = pairs.select(F.col("src").alias("rep")).unionByName(pairs.select(F.col("dst").alias("rep"))).distinct()
    wanted = staged(classes.join(nodes, "rep").select("rep", "set_id", F.col("first.doc_id").alias("w_id")), "wanted")
    texts = source.join(wanted.select("w_id").distinct(), source["doc_id"].eqNullSafe(F.col("w_id")), "left_semi")
    full = staged(texts.select("text").mapInArrow(_elements(words), "set_id binary, elements binary")
                  .join(wanted, "set_id").groupBy("rep").agg(F.first("elements").alias("elements")), "full")

    links = staged(pairs.join(full.select(F.col("rep").alias("src"), F.col("elements").alias("left")), "src")
                   .join(full.select(F.col("rep").alias("dst"), F.col("elements").alias("right")), "dst")
                   .select("src", "dst", "left", "right").mapInArrow(_confirm(percent), "src long, dst long"), "links")
    families = components(pairs).select(F.col("id").alias("rep"), F.col("label").alias("family"))
    nodes = families.join(components(links).withColumnRenamed("id", "rep"), "rep", "left").select(
        "rep", "family", F.coalesce("label", "rep").alias("comp"))
    inside = staged(_family_links(staged(nodes, "nodes"), full, percent), "inside")  # compared once, read three times
    labels = components(links.unionByName(inside))

    whole = staged(classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "set_id", "copies", "first", F.coalesce("label", "rep").alias("label")), "labelled")
    keep = whole.groupBy("label").agg(F.min("first").alias("keep"))
    chosen = staged(whole.join(keep, "label").select("set_id", "copies", "keep"), "chosen")
    linked = join_copies(sets.filter("n_shingles > 0").drop("sig"), chosen, "set_id", "copies").select(
        "doc_id", "n_shingles", F.col("keep.doc_id").alias("component_id"), (F.col("uid") == F.col("keep.uid")).alias("kept"), "uid", "set_id")
    alone = sets.filter("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "uid", "set_id")
    return linked.unionByName(alone)


def near_dedup(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Repeated rows with one `doc_id` and equal sets stay once."""
    kept = staged(near_duplicates(docs.select("doc_id", "text"), words=words, percent=percent)
                  .filter("kept").select(F.col("doc_id").alias("k_id"), F.col("set_id").alias("k_set")), "kept")
    number = F.col("doc_id").cast("long")
    wide = docs.select(F.struct("*").alias("row"), number.alias("r_id"), F.col("text").alias("r_text"))
    found = wide.join(kept.select("k_id").distinct(), F.col("r_id").eqNullSafe(F.col("k_id")), "left_semi")
    ids = staged(docs.select(number.alias("t_id")).groupBy("t_id").count().filter("count > 1").select("t_id"), "repeated")
    if ids.isEmpty():
        return found.select("row.*")
    twice = F.col("r_id").eqNullSafe(F.col("t_id"))
    again = found.join(ids, twice, "left_semi")
    schema = T.StructType([*again.select("row", "r_id").schema.fields, T.StructField("r_set", T.BinaryType()), T.StructField("n", T.LongType())])
    again = (again.mapInArrow(_identified(words), schema)
             .join(kept, F.col("r_id").eqNullSafe(F.col("k_id")) & (F.col("r_set") == F.col("k_set")), "left_semi"))
    once = again.filter("n > 0").groupBy("r_id", "r_set").agg(F.first("row").alias("row"))
    return (found.join(ids, twice, "left_anti").select("row.*").unionByName(once.select("row.*"))
            .unionByName(again.filter("n = 0").select("row.*")))
