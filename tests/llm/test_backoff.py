import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scorelake.llm import backoff


def brute(rows, order):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) for r in rows]
    own = [[Counter(tuple(d[i:i + k]) for i in range(len(d) - k + 1)) for k in range(1, order + 1)] for d in docs]
    total = [sum((o[k] for o in own), Counter()) for k in range(order)]
    n = sum(map(len, docs))
    out = []
    for r, d, o in zip(rows, docs, own):
        rest, score = max(n - len(d), 1), 0.0
        for i in range(len(d)):
            given = 0
            for k in range(min(order, i + 1), 0, -1):
                gram = tuple(d[i - k + 1:i + 1])
                c = total[k - 1][gram] - o[k - 1][gram]
                if c > 0:
                    score += math.log(c / (total[k - 2][gram[:-1]] - o[k - 2][gram[:-1]] if k > 1 else rest)) + given * math.log(backoff.ALPHA)
                    break
                given += 1
            else:
                score += math.log(1 / rest) + given * math.log(backoff.ALPHA)
        out.append((str(r["doc_id"]), len(d), score))
    return sorted(out)


@pytest.mark.parametrize(("which", "order"), [("documents", 2), ("awkward", 2), ("awkward", 3)])
def test_scores_are_brute_force(request, which, order):
    docs = request.getfixturevalue(which)
    got = backoff.score_documents(docs, order=order, slice_bytes=20000, part_bytes=50000).collect()
    want = brute(docs.collect(), order)
    found = sorted((str(r["doc_id"]), r["n_words"], r["log_score"]) for r in got)
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert [x[2] for x in found] == pytest.approx([x[2] for x in want], rel=1e-9, abs=1e-6)
    assert all((r["per_word"] is None) == (r["n_words"] == 0) for r in got)


def test_empty(nothing):
    assert backoff.score_documents(nothing).collect() == []


def test_registered_query_uses_triples(spark, documents):
    from scorelake.llm import queries

    got = queries.op1_stupid_backoff(spark, "/root/testdata/sf0.001").collect()
    want = brute(documents.collect(), 3)
    found = sorted((str(r["doc_id"]), r["n_words"], r["log_score"]) for r in got)
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert [x[2] for x in found] == pytest.approx([x[2] for x in want], rel=1e-9, abs=1e-6)


def test_requests_are_short_and_exact():
    """An n-gram of frequent words travels in less than five bytes (a hash of its own took seven), rare words as hashes; the hashes come back."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{int(x)}" if x < 2000 else f"rare{rng.integers(1 << 40)}" for x in rng.pareto(0.6, 4000)) for _ in range(10)]
    grams = backoff.Grams(pa.array(["", None, "one", *texts]), 3)
    found, counts = np.unique(grams.words, return_counts=True)
    frequent = backoff.Frequent(found[np.argsort(-counts, kind="stable")[:2000]])
    sent, seen = 0, [set(), set(), set()]
    for p, places, codes in grams.parts(frequent, 4):
        data = backoff.packed(codes, grams.rare(places, codes))
        want = np.concatenate([grams.distinct[k][x] for k, x in enumerate(places)])
        assert (backoff.unpacked(data, frequent) == want).all()
        sent += sum(map(len, data))
        for k, x in enumerate(places):
            seen[k].update(x.tolist())
    assert [len(x) for x in seen] == [len(d) for d in grams.distinct]
    assert sent < 5 * sum(map(len, seen))
    numbers = np.array([0, 1, 254, 255, 256, 1 << 40])
    assert (backoff.of_small(backoff.small_numbers(numbers), 6) == numbers).all()


def test_sorting_with_places_below_the_value():
    """Equal values keep their order, also where the upper bits do not tell values apart, and codes that do not fit into one number are sorted in passes."""
    rng = np.random.default_rng(5)
    for values in (rng.integers(0, 1 << 64, 5000, dtype=np.uint64), rng.integers(0, 40, 5000, dtype=np.uint64), np.zeros(0, dtype=np.uint64),
                   (np.uint64(7) << np.uint64(50)) + rng.integers(0, 4000, 5000, dtype=np.uint64)):
        assert np.array_equal(backoff._sorted_places(values), np.argsort(values, kind="stable"))
    for count in (1, 6, 65535):
        part = rng.integers(0, count, 5000, dtype=np.uint64)
        for k in range(4):
            columns = [rng.choice([0, 3, 65535], 5000).astype(np.uint16) for _ in range(k)]
            assert np.array_equal(backoff._by_codes(part, columns, count), np.lexsort([*columns[::-1], part]))
