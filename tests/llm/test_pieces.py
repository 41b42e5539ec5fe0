import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm.pieces import PieceEncoder, encode_pieces, piece_digests

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = PieceEncoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "an", "the", " ", "  ", "   ", "\n", "\t", "\r", "▁", "▁▁", "é", "ß", "\U0001f600", "\x00", "aaa", "bab", "9", "…",
                                 "　", "ing", "return", "=", "==", "梦", "ﬁ", "<s>", "<0x41>", "zz", "ss"]), max_size=20))
def test_ids_and_text_are_the_librarys(parts):
    text = "".join(parts)
    ids = LIBRARY.encode(text)
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids)


def test_long_words():
    rng = random.Random(1)
    for letters in ("ab", "aeint", "abcdefghijklmnopqrstuvwxyz", "a"):
        for _ in range(60):
            text = "".join(rng.choices(letters, k=rng.randint(1, 300)))
            assert OWN.encode(text) == LIBRARY.encode(text)


def test_documents(documents, awkward, nothing):
    for docs in (documents, awkward):
        want = []
        for r in docs.collect():
            ids = LIBRARY.encode(r["text"] or "")
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), LIBRARY.decode(ids) if ids else "")]
            want.append((str(r["doc_id"]), len(ids), *digest))
        got = piece_digests(docs, PATH).collect()
        assert sorted((str(r["doc_id"]), *r[1:]) for r in got) == sorted(want)
    full = {r["n_tokens"]: r for r in encode_pieces(awkward, PATH).collect()}
    assert all(len(r["ids"]) == n and r["decoded"] == (LIBRARY.decode(r["ids"]) if n else "") for n, r in full.items())
    assert piece_digests(nothing, PATH).collect() == []


@pytest.mark.parametrize("text", ["", " ", "a ", " a", "a\n", "\n", "\n\n", "a\n b", " \n"])
def test_borders(text):
    assert OWN.encode(text) == LIBRARY.encode(text)
