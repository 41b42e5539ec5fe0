import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from scorelake.llm import exact, near
from scorelake.llm.shingles import shingle_sets


def pairs_of(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def brute_near(rows, words, percent=80):
    sets = [pairs_of(r["text"], words) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        k = (r["doc_id"] is None, r["doc_id"] or 0)
        best[root(i)] = min(best.get(root(i), k), k)
    return sorted((str(r["doc_id"]), len(s), str(None if best[root(i)][0] else best[root(i)][1])) for i, (r, s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("words", [2, 5])
@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_near_is_brute_force(request, which, words):
    docs = request.getfixturevalue(which)
    got = near.near_duplicates(docs, words=words).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_near(docs.collect(), words)
    kept = defaultdict(int)
    for r in got:
        if r["n_shingles"]:
            kept[r["component_id"]] += r["kept"]
            assert not r["kept"] or r["doc_id"] == r["component_id"]
        else:
            assert r["kept"]
    assert set(kept.values()) == {1}


def test_near_rounds_reach_links_that_no_star_shows(spark, monkeypatch):
    """A chain in one group of keys: neighbours are alike, the ends are not; cells and rounds must find all links."""
    monkeypatch.setattr(near, "CELL", 8)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i:3 * i + 60])) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.near_duplicates(docs, words=2).collect()
    want = brute_near([{"doc_id": i, "text": t} for i, t in rows], 2)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want


def test_near_dedup_rows(awkward, nothing):
    got = near.near_dedup(awkward, words=2)
    assert got.columns == awkward.columns
    rows = near.near_duplicates(awkward, words=2)
    assert got.count() == rows.filter("kept").count()
    assert near.near_dedup(nothing).collect() == [] and near.near_duplicates(nothing).collect() == []


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
    out = []
    for text, members in groups.items():
        keep, sha = min(members), hashlib.sha256(text.encode()).hexdigest()
        out += [(str(None if m[1] else m[2]), str(None if keep[1] else keep[2]), len(members), sha) for m in members]
    return sorted(out)


def test_exact_is_brute_force(awkward, nothing):
    got = exact.DigestIndex(awkward.sparkSession, buckets=3).add(awkward).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == brute_exact(awkward.collect())
    assert len({r["text_sha256"] for r in got}) == sum(r["kept"] for r in got)
    stay = exact.exact_dedup(awkward)
    assert stay.columns == awkward.columns and stay.count() == sum(r["kept"] for r in got)
    assert exact.exact_dedup(nothing).collect() == []


def test_index_persists(spark):
    first = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(4, "a  b "), (5, "d"), (6, "d")], "doc_id long, text string")
    index = exact.DigestIndex(spark, buckets=2)
    assert {r["doc_id"] for r in index.add(first).filter("kept").collect()} == {1, 3}
    again = exact.DigestIndex(spark, index.folder, buckets=2)
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in again.add(second).collect()}
    assert got == {4: (1, False), 5: (5, True), 6: (5, False)}
    assert again.rows().count() == 3
    plan = again.rows().select("digest").hint("merge").join(again.rows().select("digest").distinct(), "digest")._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def keys_of(texts):
    """For every text its index keys, each with the word pairs that it is made of."""
    out = []
    for text in texts:
        words = text.split()
        pairs = [" ".join(p) for p in zip(words, words[1:])]
        hashes = np.array([shingle_sets(pa.array([p]), 2)[0][0] for p in pairs], dtype=np.uint64)
        least = [pairs[i] for i in (hashes[:, None] * near.FACTOR + near.SHIFT).argmin(axis=0)]
        batch = pa.record_batch({"sig": pa.array([near.signature(np.unique(hashes)).tobytes()]), "rep": pa.array([0])})
        made = next(near._keys(iter([batch]))).column("key").to_pylist()
        places = [[c * near.WIDTH + k for k in range(near.WIDTH) if k != gone] for c in range(near.CHUNKS) for gone in range(near.WIDTH)]
        out.append({key: [least[p] for p in at] for key, at in zip(made, places)})
    return out


def bits_of(text):
    """The bits of a signature that are carried beside its keys."""
    return near.signature(shingle_sets(pa.array([text]), 2)[0]) & 1


@pytest.mark.parametrize("seed", range(2))
def test_far_hubs_hide_no_link(spark, seed):
    """Two pairs of very close texts with links between the pairs; each key they share has a short text, first in the table, as its hub."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(400)]

    def changed(words, n):
        words = list(words)
        for i in rng.sample(range(5, 395), n):
            words[i] = f"x{rng.randrange(10 ** 6)}"
        return words

    one, two = base, changed(base, 18)
    texts = [" ".join(t) for t in (one, two, changed(one, 1), changed(two, 1))]
    made = keys_of(texts)
    shared = list({key: made[a][key] for a in (0, 2) for b in (1, 3) for key in made[a].keys() & made[b].keys()}.values())
    marks = [bits_of(t) for t in texts]
    tries = ([" ".join(f"{pair} f{i}q{j}n{n}" for j, pair in enumerate(pairs)) for n in range(200)] for i, pairs in enumerate(shared))
    short = [next(t for t in some if min((bits_of(t) != m).sum() for m in marks) > near.FAR) for some in tries]
    rows = [(100 + i, t) for i, t in enumerate(short)] + [(i + 1, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = near.near_duplicates(docs, words=2).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_near([{"doc_id": i, "text": t} for i, t in rows], 2)


def test_bridges_join_what_chains_of_pairs_join():
    rng = np.random.default_rng(8)
    for _ in range(40):
        n = int(rng.integers(2, 40))
        apart = rng.integers(0, 60, (n, n))
        apart = np.minimum(apart, apart.T)
        labels = rng.integers(0, n, n)

        def classes(pairs):
            parts = [{("l", int(v))} | {i for i in range(n) if labels[i] == v} for v in set(labels.tolist())]
            for a, b in pairs:
                x, y = (next(p for p in parts if v in p) for v in (a, b))
                if x is not y:
                    parts.remove(y)
                    x |= y
            return sorted(sorted(map(str, p)) for p in parts)

        far = [(i, j) for i in range(n) for j in range(n) if apart[i, j] <= near.FAR]
        assert classes(near.bridges(apart, labels, labels)) == classes(far)


def test_signature_of_a_long_set():
    """Minima over all blocks of a set, function by function."""
    hashes = np.random.default_rng(3).integers(0, 1 << 64, 5000, dtype=np.uint64)
    want = [int((hashes * f + s).min()) & 0xFFFF for f, s in zip(near.FACTOR, near.SHIFT)]
    assert near.signature(hashes).tolist() == want
