import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scorelake.llm import packing, token_output
from scorelake.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", "\n", " the", "don't", " ", " ", "9", "é", "!?", "\x1c", "\x00", "\U0001f600", "\t", "<|endoftext|>", "<|"]), max_size=25))
def test_ids_are_the_librarys(parts):
    t = Tokenizer.from_file(PATH)
    text = "".join(parts)
    assert np.frombuffer(Encoder_().encode(text), dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def Encoder_(held=[]):  # noqa: B006
    if not held:
        held.append(Encoder(PATH))
    return held[0]


def naive_first_fit(sizes, capacity):
    free, bins = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, f in enumerate(free) if f >= sizes[i]), None)
        if b is None:
            free.append(capacity)
            b = len(free) - 1
        bins[i] = (b, capacity - free[b])
        free[b] -= sizes[i]
    return [bins[i] for i in range(len(sizes))]


def naive_best_fit(sizes, capacity):
    free, at = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room = min((f for f in free if f >= sizes[i]), default=None)
        if room is None:
            free.append(capacity)
            room = capacity
        free[free.index(room)] -= sizes[i]
        at[i] = capacity - room
    return at, len(free)


@given(st.lists(st.integers(1, 64), max_size=80))
def test_trees_are_the_plain_rules(sizes):
    assert list(zip(*packing.first_fit_decreasing(sizes, 64))) == naive_first_fit(sizes, 64)
    bins, offsets = token_output.best_fit_decreasing(sizes, 64)
    at, n = naive_best_fit(sizes, 64)
    assert offsets == at and len(set(bins)) == n


def check(rows, docs, tokenizer):
    """Each id in one piece, sequences gapless from 0 and at most 1024 long."""
    want = []
    for r in docs:
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(str(r["doc_id"]), a, min(1024, len(ids) - a), zlib.crc32(ids[a:a + 1024].tobytes())) for a in range(0, len(ids), 1024)]
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    return sum(n for p in sequences.values() for _, n in p) / (1024 * len(sequences))


@pytest.mark.parametrize("pack", [packing.pack_documents, token_output.packed_segments])
def test_packing(documents, awkward, nothing, tokenizer, pack):
    assert check(pack(documents, PATH).collect(), documents.collect(), tokenizer) > 0.97
    check(pack(awkward, PATH).collect(), awkward.collect(), tokenizer)
    assert pack(nothing, PATH).collect() == []


def test_added_tokens_and_wide_ids(tokenizer):
    for text in ("a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> x<|endoftext|><|endoftext|>", "<|endoftext"):
        assert np.frombuffer(Encoder_().encode(text), dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        token_output._narrow(np.array([1, 1 << 16], dtype="<u4").tobytes())
