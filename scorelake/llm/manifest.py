"""A Merkle manifest of a dataset: leaves, roots per source, one root, and a proof for every row.

Leaves are put in order and dealt into aligned blocks of FANOUT ** HEIGHT; each block's subtree is built where the block lies. The
blocks then find the tree above them by a butterfly exchange: in each round the members of an aligned group of FANOUT
subtrees swap their roots, and every block hashes the common ancestor by itself. After the last round each block holds its
whole upper proof; nothing is handed down again. Where the last subtree of a run has fewer blocks than the others, its blocks share out the messages.

The roots of all sources are the leaves of one more such tree, so that neither rows of a source nor sources are ever gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import join_copies, staged
from scorelake.session import ship_package

FANOUT = 3
#: Levels inside a block: 2187 leaves, a quarter of a megabyte of digests.
HEIGHT = 7
#: Rounds of the exchange between two written tables.
ROUNDS = 4

PATH = "array<struct<at: int, run: array<string>>>"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def row_hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def subtree(leaves: list[str], levels: int | None) -> list[list[str]]:
    """All levels from the leaves up: `levels` steps, or until one node is left."""
    out = [leaves]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        below = out[-1]
        out.append([row_hash(*below[i:i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return out


def path_of(levels: list[list[str]], place: int) -> list[tuple[int, list[str]]]:
    """For each step up, the place in the run and the run."""
    steps = []
    for nodes in levels[:-1]:
        run = place - place % FANOUT
        steps.append((place - run, nodes[run:run + FANOUT]))
        place //= FANOUT
    return steps


def fold(digest: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that follows from a leaf and the siblings of its path."""
    for at, run in path:
        digest = row_hash(*run[:at], digest, *run[at + 1:])
    return digest


def in_order(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Staged `leaves(tree, leaf, …)` with `pos`, the place of a leaf in its tree by the columns `order`, and `n`, the tree's leaves.

    Rows are dealt by ranges of tree, order and row number, so that a tree, or one value, of a third of all rows takes many tasks.
    """
    numbered = staged(leaves.withColumn("uid", F.monotonically_increasing_id()), "leaves")
    ranged = staged(numbered.repartitionByRange("tree", *order, "uid").withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    starts = counts.select("tree", "part", F.expr("sum(rows) OVER (PARTITION BY tree ORDER BY part) - rows").alias("before"),
                           F.expr("sum(rows) OVER (PARTITION BY tree)").alias("n"))
    place = f"row_number() OVER (PARTITION BY tree, part ORDER BY {', '.join(order)}, uid)"
    return (ranged.join(starts, ["tree", "part"]).withColumn("pos", F.expr(f"before + {place} - 1"))
            .drop("part", "before", "uid"))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows one by one: a row is a whole block."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def blocks_of(placed: DataFrame, carried: list[str], height: int) -> DataFrame:
    """One row per block: `tree, block, width` (blocks of the tree), `members` in order, at most FANOUT ** height of them, and the block's root."""
    size = FANOUT ** height
    members = placed.groupBy("tree", F.expr(f"pos div {size}").alias("block"), F.expr(f"(n + {size - 1}) div {size}").alias("width")).agg(
        F.array_sort(F.collect_list(F.struct((F.col("pos") % size).cast("int").alias("place"), "leaf", *carried))).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [_levels(row, height)[-1][0] for row in _rows(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], names=[*batch.schema.names, "digest"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields)
    return staged(members.mapInArrow(run, columns + ", digest string"), "blocks")


def butterfly(blocks: DataFrame) -> DataFrame:
    """`tree, block, width, digest, path`: the root of the block's tree and the block's path to it."""
    state = blocks.select("tree", "block", "width", "digest", F.expr(f"cast(array() as {PATH})").alias("path"))
    done, left = state.filter("width <= 1"), state.filter("width > 1")
    widest = left.agg(F.max("width")).first()[0] or 1
    step, span = 0, 1
    while span < widest:
        left = exchange(left, span)
        step, span = step + 1, span * FANOUT
        if step % ROUNDS == 0 or span >= widest:
            left = staged(left, "butterfly")
    return done.unionByName(left)


def exchange(state: DataFrame, span: int) -> DataFrame:
    """One round: subtrees of `span` blocks swap roots within runs of FANOUT; trees that have reached their root stay as they are.

    A block sends its subtree's root to the block of the same offset in each sibling subtree. If its own subtree is the shorter last one of
    `size` blocks, it also serves the offsets that lie a multiple of `size` further, so all get an answer and the load is even.
    """
    node, run = f"block div {span}", f"(block div {span * FANOUT}) * {FANOUT}"
    own = f"least({span}L, width - ({node}) * {span})"
    target = f"least({span}L, width - s * {span})"
    offset = f"block % {span}"
    spread = f"""transform(filter(sequence({run}, {run} + {FANOUT - 1}), s -> s * {span} < width AND s <> {node} AND {offset} < {target}),
                           s -> sequence(s * {span} + {offset}, s * {span} + {target} - 1, {own}))"""
    sent = state.select("tree", "width", "digest", F.expr(f"cast(({node}) % {FANOUT} as int)").alias("place"),
                        F.explode(F.expr(f"concat(array(struct(block as dest, path as path)), "
                                         f"transform(flatten({spread}), b -> struct(b as dest, cast(null as {PATH}) as path)))")).alias("m"))
    met = sent.groupBy("tree", F.col("m.dest").alias("block"), "width").agg(
        F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("nodes"), F.max("m.path").alias("path"))
    grown = met.withColumn("run", F.col("nodes.digest")).withColumn("at", F.expr(f"cast(({node}) % {FANOUT} as int)"))
    above = F.expr(f"width > {span}")
    return grown.select(
        "tree", "block", "width",
        F.when(above, F.sha2(F.array_join("run", ""), 256)).otherwise(F.col("run")[0]).alias("digest"),
        F.when(above, F.concat("path", F.array(F.struct("at", "run")).cast(PATH))).otherwise(F.col("path")).alias("path"))


def tree_paths(leaves: DataFrame, order: list[str], carried: list[str], height: int) -> DataFrame:
    """The staged blocks of `leaves(tree, leaf, …)`: `tree, block, width, members` and `root, path` of the block."""
    blocks = blocks_of(in_order(leaves, order), carried, height)
    tops = butterfly(blocks).select("tree", "block", F.col("digest").alias("root"), "path")
    return staged(blocks.drop("digest").join(tops, ["tree", "block"]), "paths")


def _steps(path: list[dict]) -> list[tuple[int, list[str]]]:
    return [(step["at"], step["run"]) for step in path]


def _levels(row: dict, height: int) -> list[list[str]]:
    """The levels of a block: all of them where its tree has more blocks, else up to the root."""
    return subtree([m["leaf"] for m in row["members"]], height if row["width"] > 1 else None)


def _subroots(height: int):
    kind = pa.list_(pa.struct([("at", pa.int32()), ("run", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                levels = _levels(row, height)
                paths = [path_of(levels, place) + _steps(row["path"]) for place in range(len(row["members"]))]
                yield pa.record_batch({
                    "tree": pa.array([m["name"] for m in row["members"]], pa.string()), "n_blocks": pa.array([m["n_blocks"] for m in row["members"]], pa.int64()),
                    "whole": pa.array([row["root"]] * len(paths), pa.string()),
                    "above": pa.array([[{"at": at, "run": nodes} for at, nodes in path] for path in paths], kind)})
    return run


def _proofs(height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                members, above = row["members"], _steps(row["path"]) + _steps(row["above"])
                levels = _levels(row, height)
                paths = [path_of(levels, place) + above for place in range(len(members))]
                folded = [fold(m["claimed"] or m["leaf"], path) for m, path in zip(members, paths)]
                yield pa.record_batch({
                    "doc_id": pa.array([m["doc_id"] for m in members], pa.int64()), "leaf": pa.array([m["leaf"] for m in members]),
                    "subroot": pa.array([row["root"]] * len(members)), "root": pa.array([row["whole"]] * len(members)),
                    "proof": pa.array([[sibling for at, nodes in path for sibling in (*nodes[:at], *nodes[at + 1:])] for path in paths], pa.list_(pa.string())),
                    "folded_root": pa.array(folded)})
    return run


def manifest(docs: DataFrame, claimed: Column | None = None, *, height: int = HEIGHT) -> DataFrame:
    """One row per row of `docs`: `doc_id, leaf, subroot, root, proof, folded_root, verified`.

    A leaf is the digest of `doc_id, source, lang, n_chars, text`; null fields count as `-`. Leaves of a source (null is a source, the first) go by
    `doc_id`, null first; rows with one `doc_id` by their leaf, so that repeated rows, which have equal leaves, may change places without
    any effect on a root. `proof` holds the siblings from the bottom up, from left to right. `folded_root` follows from
    the leaf of the text `claimed` (default: the text itself; null: the text is null) and these siblings; `verified` says whether it is `root`.
    Columns of other names don't count. An empty table has no rows and no root. Blocks hold FANOUT ** `height` leaves.
    """
    ship_package(docs.sparkSession)
    ids = F.col("doc_id").cast("long")
    fixed = [ids, F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    leaf, other = leaf_digest(*fixed, F.col("text")), leaf_digest(*fixed, F.col("text") if claimed is None else claimed)
    leaves = docs.select(F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("v"), "source")).alias("tree"), ids.alias("doc_id"),
                         leaf.alias("leaf"), F.when(other != leaf, other).alias("claimed"))
    blocks = tree_paths(leaves, ["doc_id", "leaf"], ["doc_id", "claimed"], height)
    tops = blocks.filter("block = 0").select(F.lit("").alias("tree"), F.col("root").alias("leaf"), F.col("tree").alias("name"), F.col("width").alias("n_blocks"))
    sources = tree_paths(tops, ["name"], ["name", "n_blocks"], height)
    sources = staged(sources.mapInArrow(_subroots(height), f"tree string, n_blocks long, whole string, above {PATH}"), "sources")
    whole = join_copies(blocks, sources, "tree", "n_blocks").select("members", "width", "root", "path", "whole", "above")
    rows = whole.mapInArrow(_proofs(height), "doc_id long, leaf string, subroot string, root string, proof array<string>, folded_root string")
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
