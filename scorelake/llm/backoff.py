"""Stupid-backoff language-model scores of every document, by counts of the other documents.

A word's score is the relative frequency of the longest n-gram that ends with it and was seen, times ALPHA for each order that had to be
given up. Counts leave the scored document out, or every n-gram of the corpus would be seen.

Relations: slices of documents explode into n-grams and are reduced to distinct ones with counts before anything is shuffled. Counts are
dealt out by hash into parts, where the count table of a part is made and joined to the n-grams asked for; each slice gets its counts
back in the order in which it sent its n-grams, and scores are summed per document. A frequent n-gram is one entry per slice,
never a row per occurrence. Rows carry packed arrays, as n-grams are many and short: an n-gram travels as the ranks of its words among the
most frequent ones, rarer words as hashes, once per row. The receiver makes the n-gram's hash from that again, so the ranks only shorten rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import slices
from scorelake.llm.shingles import LEFT, RIGHT, U64, mix, text_bytes, words
from scorelake.session import ship_package

ALPHA = 0.4
#: Longest n-gram; bytes of text of a slice and of a part. On a large table both grow, so that slices times parts stays small.
ORDER, SLICE_BYTES, PART_BYTES = 3, 2 << 20, 8 << 20
#: In the place of an n-gram that would leave its document.
NONE = U64(0)
#: Words that travel as ranks, of the most frequent ones in each slice; the code of a rarer word, and the most parts that fit beside three codes.
FREQUENT, OF_SLICE, RARE, MAX_PARTS = 65535, 8192, 65535, 65535


def _extended(whole: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    return mix(whole * LEFT + word * RIGHT + U64(k))


def _sorted_places(values: np.ndarray) -> np.ndarray:
    """The stable order of hashes: their upper bits are sorted with the place below them, which is several times faster than sorting places."""
    bits = max(len(values) - 1, 1).bit_length()
    low = U64((1 << bits) - 1)
    places = (np.sort((values & ~low) | np.arange(len(values), dtype=U64)) & low).astype(np.int64)
    found = values[places]
    if (found[1:] < found[:-1]).any():  # equal upper bits of different hashes
        return np.argsort(values, kind="stable")
    return places


def _by_codes(part: np.ndarray, columns: list[np.ndarray], count: int) -> np.ndarray:
    """The stable order by part, below `count`, and then by columns of 16 bits: as many as fit are sorted in one number with the place below it."""
    bits, head = max(len(part) - 1, 1).bit_length(), list(columns)
    order = np.arange(len(part))
    while head and count.bit_length() + 16 * len(head) + bits > 64:
        order = order[np.argsort(head.pop()[order], kind="stable")]
    key = part
    for c in head:
        key = key << U64(16) | c.astype(U64)
    return order[(np.sort(key[order] << U64(bits) | np.arange(len(part), dtype=U64)) & U64((1 << bits) - 1)).astype(np.int64)]


class Frequent:
    """Ranks of frequent words, by their hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.rank = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.rank]

    def codes(self, words: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(words), RARE, dtype=np.uint16)
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words, self.rank[at], RARE).astype(np.uint16)


class Grams:
    """The n-grams of a slice: for each order their places in order of their hashes, and the distinct ones. An n-gram that would leave its document has none."""

    def __init__(self, texts: pa.Array, order: int):
        data, offsets = text_bytes(texts)
        self.words, self.at = words(data, offsets)
        n = len(self.words)
        ends = np.repeat(self.at[1:], np.diff(self.at))
        self.doc = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        self.places, self.distinct, self.first, self.counts, whole = [], [], [], [], np.full(n, 1, dtype=U64)
        for k in range(order):
            whole = _extended(whole, np.concatenate([self.words[k:], np.zeros(min(k, n), dtype=U64)]), k)
            hashes = np.where(np.arange(n) + k < ends, np.maximum(whole, U64(1)), NONE)
            places = _sorted_places(hashes)
            places = places[np.count_nonzero(hashes == NONE):]
            start = np.flatnonzero(~_same(hashes[places]))
            self.places.append(places)
            self.first.append(places[start])
            self.distinct.append(hashes[places[start]])
            self.counts.append(np.diff(start, append=len(places)))

    def parts(self, frequent: Frequent, count: int) -> Iterator[tuple[int, list[np.ndarray], list[list[np.ndarray]]]]:
        """For each part the places in `distinct` of each order, and the codes of their words one by one.

        An n-gram lies in the part of its first rare word, so that this word travels once, or else of its own hash.
        """
        code, placed = np.zeros(len(self.words), dtype=np.uint16), []
        code[self.places[0]] = np.repeat(frequent.codes(self.words[self.first[0]]), self.counts[0])
        for k, (hashes, first) in enumerate(zip(self.distinct, self.first)):
            at, columns = hashes, [code[first + j] for j in range(k + 1)]
            for j in range(k, -1, -1):
                at = np.where(columns[j] == RARE, self.words[first + j], at)
            part = at % U64(count)
            order = _by_codes(part, columns, count)
            placed.append((order, np.searchsorted(part[order], np.arange(count + 1))))
        for p in np.flatnonzero(sum(np.diff(cuts) for _, cuts in placed)).tolist():
            places = [order[cuts[p]:cuts[p + 1]] for order, cuts in placed]
            yield p, places, [[code[self.first[k][x] + j] for j in range(k + 1)] for k, x in enumerate(places)]

    def rare(self, places: list[np.ndarray], codes: list[list[np.ndarray]]) -> np.ndarray:
        """Hashes of the rare words of the given places, in the order in which their codes come."""
        return np.concatenate([self.words[self.first[k][x] + j][codes[k][j] == RARE] for k, x in enumerate(places) for j in range(k + 1)])

    def scores(self, totals: list[np.ndarray], all_words: int) -> np.ndarray:
        """Sum of the words' log scores of each document, from the corpus counts of `distinct`."""
        sizes = np.diff(self.at)
        rest = np.maximum((all_words - sizes)[self.doc], 1).astype(np.float64)
        others = []
        for places, counts, total in zip(self.places, self.counts, totals):
            doc, new = self.doc[places], np.zeros(len(places), dtype=bool)
            new[np.cumsum(counts) - counts] = True  # equal n-grams lie together, and those of a document in them
            new[1:] |= doc[1:] != doc[:-1]
            run = np.cumsum(new) - 1
            other = np.zeros(len(self.doc), dtype=np.int64)
            other[places] = np.repeat(total, counts) - np.bincount(run)[run]
            others.append(other)
        score = np.log(1.0 / rest)
        place = np.arange(len(self.doc)) - self.at[self.doc]
        for k in range(1, len(self.places) + 1):  # ending at each word; longer ones replace shorter ones
            here = np.arange(len(self.doc)) - (k - 1)
            fits = place >= k - 1
            seen = np.zeros(len(self.doc), dtype=bool)
            seen[fits] = others[k - 1][here[fits]] > 0
            below = others[k - 2][here[seen]] if k > 1 else rest[seen]
            score[fits & ~seen] += np.log(ALPHA)
            score[seen] = np.log(others[k - 1][here[seen]] / below)
        sums = np.concatenate([[0.0], np.cumsum(score)])
        return sums[self.at[1:]] - sums[self.at[:-1]]


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.Codec("zstd", 3).compress(data, asbytes=True)


def _widened(data: bytes) -> bytes:
    return pa.Codec("zstd", 3).decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True)


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte: all lowest bytes, then the next ones, up to the last that is used."""
    wide = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    used = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return b"".join(_framed(_squeezed(wide[:, i].tobytes())) for i in range(used))


def _framed(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + data


def numbers(data: bytes, n: int) -> np.ndarray:
    out, at, i = np.zeros((n, 8), dtype=np.uint8), 0, 0
    while at < len(data):
        size = int.from_bytes(data[at:at + 4], "little")
        out[:, i] = np.frombuffer(_widened(data[at + 4:at + 4 + size]), dtype=np.uint8)
        at, i = at + 4 + size, i + 1
    return out.view("<u8").ravel()


def packed(codes: list[list[np.ndarray]], rare: np.ndarray) -> list[bytes]:
    """Sorted codes of n-grams by order: the first word by its steps, the second by its steps below an equal first one, the third as it is."""
    known, at = np.unique(rare, return_inverse=True)
    out = [np.array([*(len(c[0]) for c in codes), len(known), len(rare)], dtype="<u8").tobytes(), planes(np.diff(known, prepend=NONE)), planes(at)]
    for columns in codes:
        for j, c in enumerate(columns):
            wide = c.astype(np.int64)
            out.append(planes(wide if j > 1 else np.diff(wide, prepend=0) if not j else np.where(_same(columns[0]), np.diff(wide, prepend=0), wide)))
    return out


def _same(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[False], values[1:] == values[:-1]])[:len(values)]


def unpacked(data: list[bytes], frequent: Frequent) -> np.ndarray:
    """Hashes of the packed n-grams, all of one order behind those of the order below."""
    sizes = np.frombuffer(data[0], dtype="<u8").astype(np.int64).tolist()
    known = np.cumsum(numbers(data[1], sizes[-2]), dtype=U64)
    rare, left, at = known[numbers(data[2], sizes[-1]).astype(np.int64)], 0, 3
    hashes = np.concatenate([frequent.hashes, np.zeros(RARE + 1 - len(frequent.hashes), dtype=U64)])
    out = []
    for k, n in enumerate(sizes[:-2]):
        whole = np.full(n, 1, dtype=U64)
        for j in range(k + 1):
            c = numbers(data[at + j], n).astype(np.int64)
            if j == 0:
                first = c = np.cumsum(c)
            elif j == 1 and n:
                start = np.maximum.accumulate(np.where(_same(first), 0, np.arange(n)))
                steps = np.cumsum(c)
                c = steps - steps[start] + c[start]
            word, hidden = hashes[c], np.flatnonzero(c == RARE)
            word[hidden] = rare[left:left + len(hidden)]
            left += len(hidden)
            whole = _extended(whole, word, j)
        out.append(np.maximum(whole, U64(1)))
        at += k + 1
    return np.concatenate(out)


def small_numbers(values: np.ndarray) -> bytes:
    """Counts, mostly below 255, which are one byte."""
    big = values >= 255
    return _squeezed(np.where(big, 255, values).astype(np.uint8).tobytes() + values[big].astype("<u8").tobytes())


def of_small(data: bytes, n: int) -> np.ndarray:
    raw = _widened(data)
    out = np.frombuffer(raw, dtype=np.uint8, count=n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, dtype="<u8", offset=n).astype(np.int64)
    return out


def _frequent(size: int):
    """Counts of a slice's most frequent words, and of all its words under NULL."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", size):
            found, counts = np.unique(words(*text_bytes(batch.column("text")))[0], return_counts=True)
            best = np.argsort(-counts, kind="stable")[:OF_SLICE]
            yield pa.record_batch({"word": pa.array([None, *found[best].view(np.int64).tolist()], pa.int64()),
                                   "n": pa.array([counts.sum(), *counts[best]], pa.int64())})
    return run


def _requests(order: int, frequent: Frequent, parts: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(slices(batches, "text", size)):
            grams = Grams(batch.column("text"), order)
            used, sent, counts = [], [], []
            for p, places, codes in grams.parts(frequent, parts):
                used.append(p)
                sent.append(packed(codes, grams.rare(places, codes)))
                counts.append(small_numbers(np.concatenate([grams.counts[i][x] for i, x in enumerate(places)])))
            yield pa.record_batch({"part": pa.array(used, pa.int32()), "slice": pa.array([first + k] * len(used), pa.int64()),
                                   "grams": pa.array(sent, pa.list_(pa.binary())), "counts": pa.array(counts, pa.binary())})
    return run


def _slices(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(slices(batches, "text", size)):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield pa.record_batch({
                "slice": pa.array([first + k]), "part": pa.array([-1], pa.int32()), "blob": pa.array([_squeezed(b"".join(texts))], pa.binary()),
                "doc_ids": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64()))})
    return run


def _texts(row: dict) -> pa.Array:
    data, ends = _widened(row["blob"]), np.cumsum([0, *row["sizes"]]).tolist()
    return pa.array([data[a:b] for a, b in zip(ends, ends[1:])], pa.binary())


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Lists of rows with an equal key from a stream sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _answers(frequent: Frequent):
    """The count table of each part, joined to what each slice asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "part"):
            asked = [unpacked(r["grams"], frequent) for r in rows]
            counts = [of_small(r["counts"], len(a)) for r, a in zip(rows, asked)]
            _, inverse = np.unique(np.concatenate(asked), return_inverse=True)
            totals = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)[inverse]
            cuts = np.cumsum([0, *(len(a) for a in asked)])
            for r, hashes, a, b in zip(rows, asked, cuts, cuts[1:]):
                check = zlib.crc32(hashes.tobytes()).to_bytes(4, "little")
                yield pa.record_batch({"slice": pa.array([r["slice"]]), "part": pa.array([r["part"]], pa.int32()),
                                       "blob": pa.array([check + small_numbers(totals[a:b])], pa.binary())})
    return run


def _scored(order: int, frequent: Frequent, parts: int, all_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "slice"):
            blobs = {r["part"]: r["blob"] for r in rows if r["part"] >= 0}
            texts = next(r for r in rows if r["part"] < 0)
            grams = Grams(_texts(texts), order)
            totals = [np.zeros(len(d), dtype=np.int64) for d in grams.distinct]
            for p, places, _ in grams.parts(frequent, parts):
                hashes = np.concatenate([grams.distinct[k][x] for k, x in enumerate(places)])
                if p not in blobs or zlib.crc32(hashes.tobytes()) != int.from_bytes(blobs[p][:4], "little"):
                    raise ValueError("the input gave other rows when it was read again; stage it first")
                found, cuts = of_small(blobs[p][4:], len(hashes)), np.cumsum([0, *map(len, places)])
                for k, x in enumerate(places):
                    totals[k][x] = found[cuts[k]:cuts[k + 1]]
            sizes, sums = np.diff(grams.at), grams.scores(totals, all_words)
            yield pa.record_batch({
                "doc_id": pa.array(texts["doc_ids"], pa.int64()), "n_words": pa.array(sizes, pa.int64()), "log_score": pa.array(sums, pa.float64()),
                "per_word": pa.array([s / n if n else None for s, n in zip(sums.tolist(), sizes.tolist())], pa.float64())})
    return run


def score_documents(docs: DataFrame, *, order: int = ORDER, slice_bytes: int = SLICE_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """`doc_id, n_words, log_score, per_word` per document: the sum of natural logarithms of its words' scores, and their mean.

    Words are runs without white space, A-Z as a-z. Texts without words (or null) have the sum 0 and no mean. Words that no other document has
    score ALPHA times the share of one word. Repeated rows and null ids are documents of their own. `docs` is read three times and must
    give the same rows in the same order, as a table does; otherwise the job fails.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(size // part_bytes + 1, MAX_PARTS)
    common = rows.mapInArrow(_frequent(slice_bytes), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    common = common.orderBy(F.col("word").isNotNull(), F.desc("n"), "word").limit(FREQUENT + 1).toArrow()
    all_words = common["n"][0].as_py() if len(common) else 0
    frequent = Frequent(common["word"].slice(1).to_numpy().view(U64))
    asked = rows.mapInArrow(_requests(order, frequent, parts, slice_bytes), "part int, slice long, grams array<binary>, counts binary")
    answers = asked.repartition("part").sortWithinPartitions("part").mapInArrow(_answers(frequent), "slice long, part int, blob binary")
    texts = rows.mapInArrow(_slices(slice_bytes), "slice long, part int, blob binary, doc_ids array<long>, sizes array<long>")
    both = texts.unionByName(answers, allowMissingColumns=True)
    return both.repartition("slice").sortWithinPartitions("slice").mapInArrow(
        _scored(order, frequent, parts, all_words), "doc_id long, n_words long, log_score double, per_word double")
