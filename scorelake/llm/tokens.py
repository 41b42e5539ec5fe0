"""Byte-level BPE ids of whole texts, one lookup per word."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: How the published pre-tokenizer of this vocabulary cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text in which each space has other text on both sides can be cut before its spaces, as no token crosses such a place.
_PLAIN = re.compile(r" (?=\s|\Z)")
#: Words held at once, then the table starts anew; longer words are never held.
WORDS, LONGEST = 1 << 17, 40


class Encoder:
    """Ids of a byte-level BPE given as the JSON file of the `tokenizers` library, as it gives them by default: added tokens within a
    text are cut out first and have their own ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = spec.get("added_tokens", [])
        if any(t.get(how) for t in added for how in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = {t["content"]: np.asarray([t["id"]], dtype="<u4").tobytes() for t in added}
        self._cuts = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        # printable bytes stand for themselves, the others for the code points from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.added}
        self._encode = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = np.asarray(self._encode(word), dtype="<u4").tobytes()
        if len(word) <= LONGEST:
            if len(self._known) >= WORDS:
                self._known.clear()
            self._known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if any(token in text for token in self.added):
            return b"".join([self.added.get(part) or self._ordinary(part) for part in self._cuts.split(text)])
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        if _PLAIN.search(text):
            return np.asarray(self._encode(text), dtype="<u4").tobytes()
        known, parts = self._known, text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]
        return b"".join([known.get(word) or self._word(word) for word in parts])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
