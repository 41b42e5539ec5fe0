"""Phrases whose words stand together: counts by top-order marginalisation.

Every word of a piece opens one window of `longest` words: its own column and lead columns for the words that follow, padded with
empty words behind the end of the piece. Only these longest windows are counted. A phrase's count is the sum over all windows that begin with it, so
shorter counts are sums over prefixes: first without the last word (where the exchange has put the windows), then ROLLUP over what is left.

Windows are counted per task in chunks of text before they are shuffled, packed by first word and a hash of the second, so that a word of a
third of the table is spread over the words that follow it. Text is never shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import staged, text_or_empty
from scorelake.llm.shingles import LOWER, text_bytes
from scorelake.session import ship_package

#: Bytes of text whose windows are counted together in a task.
CHUNK = 1 << 23
OUT_ROWS = 1 << 14
#: Shares that the windows of one first word are spread over.
BUCKETS = 64

BLANK, STOP = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09]] = True
STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


def window_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of all texts (A-Z as a-z), the row of each, and a number that differs between the pieces of all rows."""
    data, offsets = text_bytes(texts)
    inner = ~(BLANK[data] | STOP[data])
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.concatenate([[False], inner[:-1]])[:len(data)], np.concatenate([inner[1:], [False]])[:len(data)]
    start = np.flatnonzero(inner & (~before | edge[:-1]))
    end = np.flatnonzero(inner & (~after | edge[1:])) + 1
    del edge, before, after
    row = np.searchsorted(offsets, start, side="right") - 1
    piece = np.searchsorted(np.flatnonzero(STOP[data]), start) + row
    at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    letters = LOWER[data[inner]].tobytes()
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(letters)])
    return words, row, piece


def count_windows(langs: pa.Array, texts: pa.Array, longest: int) -> Iterator[pa.RecordBatch]:
    """The distinct windows of these rows, packed by language, first word and a hash of the second: `lang, w1, bucket, tails`.

    `tails` holds a line per window: its other words and its count, by spaces.
    """
    words, row, piece = window_words(texts)
    if not len(words):
        return
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lang = langs.dictionary_encode()
    spoken = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
    size, total = len(coded.dictionary) + 1, len(code)
    lead = [code]
    for k in range(1, longest):
        shifted = np.full(total, size - 1)
        shifted[:max(total - k, 0)] = np.where(piece[k:] == piece[:max(total - k, 0)], code[k:], size - 1)
        lead.append(shifted)
    bucket = np.array([zlib.crc32(word) % BUCKETS for word in coded.dictionary.cast(pa.large_binary()).to_pylist()] + [0])
    _, group = np.unique((spoken * size + code) * BUCKETS + bucket[lead[1]], return_inverse=True)
    key = group
    for column in lead[1:-1]:
        _, key = np.unique(key * size + column, return_inverse=True)
    _, first, counts = np.unique(key * size + lead[-1], return_index=True, return_counts=True)
    named = pa.concat_arrays([coded.dictionary, pa.array([""], pa.large_string())])
    tongue, space = lang.dictionary.cast(pa.large_string()), pa.scalar(" ", pa.large_string())
    starts = np.flatnonzero(np.diff(group[first], prepend=-1))
    ends = np.append(starts[1:], len(first))
    for a in range(0, len(starts), OUT_ROWS):
        heads, to = first[starts[a:a + OUT_ROWS]], ends[min(a + OUT_ROWS, len(starts)) - 1]
        some = first[starts[a]:to]
        parts = [named.take(pa.array(column[some])) for column in lead[1:]]
        lines = pc.binary_join_element_wise(*parts, pa.array(counts[starts[a]:to]).cast(pa.large_string()), space)
        offsets = np.append(starts[a:a + OUT_ROWS], to) - starts[a]
        tails = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), lines), pa.scalar("\n", pa.large_string()))
        yield pa.record_batch({"lang": tongue.take(pa.array(spoken[heads])).cast(pa.string()), "w1": named.take(pa.array(code[heads])).cast(pa.string()),
                               "bucket": pa.array(bucket[lead[1][heads]], pa.int32()), "tails": tails.cast(pa.string())})


def _windows(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= CHUNK:
                yield from counted(held)
                held, size = [], 0
        if held:
            yield from counted(held)

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        yield from count_windows(table["lang"].cast(pa.large_string()).combine_chunks(), table["text"].cast(pa.large_string()).combine_chunks(), longest)
    return run


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """`lang, m, phrase, f` for every phrase of `m <= longest` words that occurs `least` times or more in a language, and `lang, n`.

    Counts are exact and cover all rows; a null text is empty and has no phrases, a null language is `und`. Documents of any length
    are read whole. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    given = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    packed = given.mapInArrow(_windows(longest), "lang string, w1 string, bucket int, tails string").repartition("lang", "w1", "bucket")
    names = [f"w{k}" for k in range(1, longest)]
    keys = ["lang", "bucket", *names]
    lines = packed.select("lang", "w1", "bucket", F.explode(F.split("tails", "\n", -1)).alias("line"))
    part = lambda k: F.substring_index(F.substring_index("line", " ", k), " ", -1)
    windows = lines.select("lang", "w1", "bucket", *[part(k - 1).alias(f"w{k}") for k in range(2, longest)], part(longest - 1).alias("last"),
                           F.substring_index("line", " ", -1).cast("long").alias("c"))
    top = windows.groupBy(*keys, "last").agg(F.sum("c").alias("c"))
    frequent = F.when((F.col("last") != "") & (F.col("c") >= least), F.struct("last", "c"))
    both = top.select(*keys, F.explode(F.array(frequent, F.struct(F.lit(None).cast("string").alias("last"), "c"))).alias("e")).filter("e IS NOT NULL")
    sums = both.groupBy(*keys, "e.last").agg(F.sum("e.c").alias("c"))
    if longest > 2:  # a rare last word of a prefix is of no use any more: the shorter prefixes keep its count
        sums = sums.withColumn(names[-1], F.when(F.col("c") >= least, F.col(names[-1])).otherwise(""))
    sums = staged(sums.groupBy("lang", *names, "last").agg(F.sum("c").alias("c")), "prefixes")

    whole = sums.filter("last IS NOT NULL").select("lang", F.lit(longest).alias("m"), F.concat_ws(" ", *names, "last").alias("phrase"), "c")
    rolled = sums.filter("last IS NULL").rollup("lang", *names).agg(F.sum("c").alias("c"), F.grouping_id().alias("level"))
    given = F.lit(longest - 1) - F.bit_count("level")
    ending = F.coalesce(*[F.col(name) for name in reversed(names)], F.lit(""))
    rolled = (rolled.filter("lang IS NOT NULL").withColumn("m", given).filter((F.col("m") == 0) | ((ending != "") & (F.col("c") >= least)))
              .select("lang", "m", F.concat_ws(" ", *names).alias("phrase"), "c"))
    levels = staged(whole.unionByName(rolled).withColumnRenamed("c", "f"), "phrases")
    return levels.filter("m > 0"), levels.filter("m = 0").select("lang", F.col("f").alias("n"))


def _counted_part(rows: DataFrame, phrases: DataFrame, words: int, part: str, name: str) -> DataFrame:
    """`rows` with the count of the phrase in column `part` as `name`; parts of very frequent phrases come by broadcast.

    Fewer than 1000 phrases of each length lie above a thousandth of all words, whatever the table; the rest is shuffled.
    """
    counts = phrases.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    bound = F.lit(words // 1000)
    hot = F.broadcast(counts.filter(F.col(name) > bound))
    found = rows.join(hot, ["lang", part])
    rest = rows.join(hot.select("lang", part), ["lang", part], "left_anti").join(counts.filter(F.col(name) <= bound), ["lang", part])
    return found.unionByName(rest)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, top: int = 2000) -> DataFrame:
    """Each language's `top` phrases of 2 to `longest` words: `lang, rank, phrase, a, l, r, n, score`.

    A phrase counts `a >= least` times. Each cut into two parts with counts `l, r` scores `floor(1000000 * a * a / (l * r))`; the lowest cut counts,
    equal ones by the shortest first part. A phrase inside a longer one that has `cover` percent of its count is dropped. Ranks go by
    score, count and then bytes of the phrase, so there are no ties. Arithmetic is in decimals of 38 digits.
    """
    phrases, totals = phrase_counts(docs, longest, least)
    words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = phrases.filter("m > 1").withColumnRenamed("f", "a")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    listed = F.split("phrase", " ", -1)
    cuts = cuts.withColumn("first", F.array_join(F.slice(listed, F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("rest", F.array_join(F.slice(listed, F.col("k") + 1, F.col("m") - F.col("k")), " "))
    cuts = _counted_part(_counted_part(staged(cuts, "cuts"), phrases, words, "first", "l"), phrases, words, "rest", "r")
    big = "cast({} as decimal(19, 0))"
    score = F.expr(f"cast(1000000 as decimal(7, 0)) * {big.format('a')} * {big.format('a')} div ({big.format('l')} * {big.format('r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "m", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "m", "a", "cut.l", "cut.r", "cut.score")

    listed = F.split("phrase", " ", -1)
    inner = F.array(F.array_join(F.slice(listed, F.lit(1), F.col("m") - 1), " "), F.array_join(F.slice(listed, F.lit(2), F.col("m") - 1), " "))
    within = found.filter("m > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    within = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {cover} * a")

    kept = staged(kept.drop("longer", "m"), "collocations")
    salts = max(1, math.isqrt(kept.count() // top))  # a salt, and all that the salts leave over, are then about equally large
    order = "ORDER BY score DESC, a DESC, phrase"
    if salts > 1:
        kept = (kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
                .withColumn("place", F.expr(f"row_number() OVER (PARTITION BY lang, salt {order})")).filter(f"place <= {top}").drop("salt", "place"))
    ranked = kept.withColumn("rank", F.expr(f"cast(row_number() OVER (PARTITION BY lang {order}) as bigint)")).filter(f"rank <= {top}")
    return ranked.join(F.broadcast(totals) if totals.count() < 1000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
