"""Exact merge-type piece encoding by backtracking, and decoding.

Pieces of a published model are encoded as that library's merging does, without running the merges over the text: from the left, the
longest piece that starts here (Aho-Corasick) is tried, then its prefixes, and taken if it is compatible with the piece before
it, that is if merging the two texts anew gives the same two pieces. Positions from which nothing worked are cleared in a bitfield,
so none is tried twice and the time is linear. Texts fall apart at the word mark and at characters without a piece, as no piece
crosses them; the pieces of a word are kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import slices
from scorelake.session import ship_package

MARK = "▁"
#: Words held at once; then they are the older ones, of which those met again stay, and the table starts anew. Longer words are never held.
WORDS, LONGEST = 1 << 18, 40
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceEncoder:
    """Ids and text of a merge-type model with byte fallback, a word mark in front and no further normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self._decimal = [str(i) for i in range(size)]
        self.ids = {self.text[i]: i for i in plain}
        self.byte_ids = {int(self.text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self._bytes = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        levels = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: levels[s] for p, s in self.score.items()}
        self.parts: dict[str, tuple[str, str]] = {}
        for piece in sorted(self.rank, key=len):
            if len(piece) > 1 and (last := self._last_merge(piece)):
                self.parts[piece] = last
        self._automaton = ahocorasick.Automaton()
        whole = [p for p in self.rank if len(p) == 1 or p in self.parts]
        for piece in whole:
            self._automaton.add_word(piece, len(piece))
        self._automaton.make_automaton()
        known = set(whole)
        self._shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known), None) for p in whole}
        self._fits: dict[tuple[str, str], bool] = {}
        self._chars = {c for c in self.ids if len(c) == 1}
        self._words: dict[str, tuple[str, int, str]] = {}
        self._older: dict[str, tuple[str, int, str]] = {}

    def merge(self, text: str) -> list[str]:
        """The library's rule itself: merge the best pair, of equal ones the leftmost, until none is a piece."""
        symbols: list[str | None] = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank, heap = self.rank, []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := rank.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (r, i, j, len(symbols[i]) + len(symbols[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if symbols[i] is None or after[i] != j or symbols[j] is None or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i], symbols[j] = symbols[i] + symbols[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s is not None]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge completes the piece; None if merging its text does not give the piece."""
        symbols = list(piece)
        while len(symbols) > 2:
            best = min(((r, i) for i in range(len(symbols) - 1) if (r := self.rank.get(symbols[i] + symbols[i + 1])) is not None), default=None)
            if best is None:
                return None
            i = best[1]
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
        return (symbols[0], symbols[1])

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging `left + right` gives these two: undo their merges, the latest first, and look for a pair across
        the border that would have been merged before the one undone."""
        known = self._fits.get((left, right))
        if known is None:
            known, x, y, limit = True, left, right, float("inf")
            while True:
                across = self.rank.get(x + y)
                if across is not None and across < limit:
                    known = False
                    break
                rx, ry = self.rank[x] if x in self.parts else -1, self.rank[y] if y in self.parts else -1
                if rx < 0 and ry < 0:
                    break
                if rx > ry:
                    x, limit = self.parts[x][1], rx
                else:  # of equal pairs the left one is merged first, so that one across the border comes before this
                    y, limit = self.parts[y][0], ry + 1
            if len(self._fits) >= 1 << 19:
                self._fits.clear()
            self._fits[left, right] = known
        return known

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text whose characters all have pieces."""
        n = len(text)
        if text in self._shorter:  # a piece that its own merges lead to
            return [text]
        longest = [1] * n
        for end, size in self._automaton.iter(text):
            if size > longest[end - size + 1]:
                longest[end - size + 1] = size
        open_at, out, at = bytearray(b"\1" * (n + 1)), [], 0
        piece: str | None = text[:longest[0]] if n else None
        fits, shorter = self._fits, self._shorter
        while at < n:
            last = out[-1] if out else None
            while piece is not None:
                if open_at[at + len(piece)]:
                    good = last is None or fits.get((last, piece))
                    if good or good is None and self.compatible(last, piece):
                        break
                piece = shorter[piece]
            if piece is not None:
                out.append(piece)
                at += len(piece)
                piece = text[at:at + longest[at]] if at < n else None
            else:
                open_at[at] = 0
                at -= len(out[-1])
                piece = out.pop()
        return out

    def _unit(self, text: str) -> list[int]:
        if self._chars.issuperset(text):
            # runs of marks are pieces of equal rank, to which the compatibility of neighbours does not extend
            return [self.ids[p] for p in (self.merge(text) if MARK * 2 in text else self.backtrack(text))]
        ids, run = [], []
        for char in [*text, ""]:
            if char in self.ids:
                run.append(char)
                continue
            if run:
                part = "".join(run)
                ids += [self.ids[p] for p in (self.merge(part) if MARK * 2 in part else self.backtrack(part))]
                run = []
            ids += [self.byte_ids[b] for b in char.encode()]
        return ids

    def _word(self, key: str, unit: str) -> tuple[str, int, str]:
        found = self._older.get(key)
        if found is None:
            ids = self._unit(unit)
            text = unit.replace(MARK, " ") if self._chars.issuperset(unit) else self.pieces_text(ids)
            found = (",".join([self._decimal[i] for i in ids]), len(ids), text)
        if len(key) <= LONGEST:
            if len(self._words) >= WORDS:
                self._older = dict(self._words)
                self._words.clear()
            self._words[key] = found
        return found

    def pieces_text(self, ids: list[int]) -> str:
        parts = [self._bytes[i] if i in self._bytes else self.text[i].encode() for i in ids]
        return b"".join(parts).decode("utf-8", "replace").replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, without the blank that stands for the word mark in front."""
        return self.pieces_text(ids).removeprefix(" ")

    def words(self, text: str) -> list[tuple[str, int, str]]:
        """For each part of a text: its ids as decimals with commas, their number, and the text decoded from them."""
        if not text:
            return []
        known, word = self._words, self._word
        keys = text.replace("\n", " \n").split(" ")
        if "" in keys or MARK in text:
            units = _UNITS.findall(MARK + text.replace(" ", MARK))
            return [known.get(u) or word(u, u) for u in units]
        # a key that begins with a line feed has no word mark before it
        return [known.get(k) or word(k, k if k[0] == "\n" else MARK + k) for k in keys]

    def encode(self, text: str) -> list[int]:
        return [int(i) for w in self.words(text) for i in w[0].split(",")]


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _run(path: str, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = piece_encoder(path).words
        for batch in slices(batches, "text"):
            found = [words(t or "") for t in batch.column("text").to_pylist()]
            ids = [",".join([w[0] for w in f]) for f in found]
            texts = ["".join([w[2] for w in f]).removeprefix(" ") for f in found]
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([sum([w[1] for w in f]) for f in found], pa.int64())}
            if whole:
                columns["ids"] = pa.array([[int(i) for i in x.split(",")] if x else [] for x in ids], pa.list_(pa.int32()))
                columns["decoded"] = pa.array(texts)
            else:
                columns["ids_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids])
                columns["decoded_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts])
            yield pa.record_batch(columns)
    return run


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """`doc_id, n_tokens, ids, decoded` per document; null and empty texts have no ids and decode to the empty text."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _run(path, True), "doc_id long, n_tokens long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """`doc_id, n_tokens, ids_sha256, decoded_sha256`: digests of what `encode_pieces` gives, made in the same tasks."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _run(path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
