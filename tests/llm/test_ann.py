import math

import numpy as np
import pytest

from scorelake.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, v string, h string, part string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "v", "h", "p") for i, v in rows], SCHEMA).repartition(4)


def brute(rows, every, count):
    d = max([len(v) for _, v in rows if v] or [0])
    good = {}
    for i, v in rows:
        if i is not None and v and len(v) == d and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=np.float32).astype(float)
    out = []
    for q in sorted(good):
        if q % every:
            continue
        near = sorted((-float(ann.cosines(good[q][None], good[c][None])[0]), c) for c in good if c != q)[:count]
        out += [(q, k, c, -s) for k, (s, c) in enumerate(near, 1)]
    return out


def got(df, every, count):
    found = ann.MultiIndex(df, count).search(df.filter(f"vec_id % {every} = 0"))
    return sorted(tuple(r[x] for x in ("query_id", "rank", "vec_id", "score")) for r in found.collect())


def test_small_tables_are_exact(spark):
    """Copies, scaled copies, nulls, zeros, non-finite values, other lengths, repeated rows; a table of fewer than AT_LEAST entries."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(200)]
    rows += [(200 + i, rows[7][1]) for i in range(120)] + [(400 + i, [2 * x for x in rows[8][1]]) for i in range(9)]
    rows += [(500, None), (510, [0.0] * 6), (520, [1.0, None, 1, 1, 1, 1]), (530, [1.0, math.nan, 1, 1, 1, 1]), (540, [math.inf, 1, 1, 1, 1, 1]),
             (550, [1.0, 2.0]), (560, []), (None, rows[0][1]), (570, [3e38] * 6), (580, [1e-38] * 6), rows[10], rows[10]]
    assert got(frame(spark, rows), 10, 5) == brute(rows, 10, 5)


@pytest.mark.parametrize("n, d", [(0, 3), (1, 3), (2, 3), (4, 1)])
def test_fewer_candidates_than_wanted(spark, n, d):
    rows = [(i, [float(i + 1)] * d) for i in range(n)]
    assert got(frame(spark, rows), 1, 5) == brute(rows, 1, 5)


def test_recall_with_small_parts(spark, monkeypatch):
    """Cells are searched in part only; scores are exact and at least nine of ten neighbours are found."""
    monkeypatch.setattr(ann, "AT_LEAST", 50)
    monkeypatch.setattr(ann, "PART", 300)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.5 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(1500 + i, rows[0][1]) for i in range(500)]
    found, want = got(frame(spark, rows), 20, 5), brute(rows, 20, 5)
    assert len(found) == len(want)
    true = {(q, c): s for q, _, c, s in want}
    assert sum((q, c) in true for q, _, c, _ in found) >= 0.9 * len(want)
    assert all(true.get((q, c), s) == s for q, _, c, s in found)


def test_heap_takes_cells_in_order_of_the_summed_distance():
    rng = np.random.default_rng(5)
    for _ in range(50):
        first, second = rng.random(7), rng.random(5)
        sizes = rng.integers(0, 4, (7, 5))
        sums = np.sort((first[:, None] + second).ravel())
        for wanted in (1, 10, int(sizes.sum())):
            limit = ann.reach(first, second, sizes, wanted)
            taken = sizes[first[:, None] + second <= limit].sum()
            below = sizes[first[:, None] + second < limit].sum()
            assert below < wanted <= taken and limit in sums
