import hashlib
import random

import numpy as np

from scorelake.llm import simhash


def test_documents(documents, awkward, nothing):
    for docs in (documents, awkward.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted(docs.collect(), key=lambda r: -r["doc_id"])
        got = {r["doc_id"]: r for r in simhash.with_neighbours(simhash.fingerprint_documents(docs)).collect()}
        assert len(got) == len(rows)
        prints = {}
        for r, after in zip(rows, rows[1:] + rows[:1]):
            text, g = r["text"] or "", got[r["doc_id"]]
            third = len(text) // 3
            changed = text[:len(text) - third] + (after["text"] or "")[:third]
            assert g["n_chars"] == len(text) and g["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
            assert prints.setdefault(text, g["fingerprint"]) == g["fingerprint"]
            assert 0 <= g["near_next"] <= 1 and 0 <= g["near_edited"] <= 1
        as_bits = {i: np.unpackbits(np.frombuffer(bytes.fromhex(g["fingerprint"]), dtype=np.uint8)) for i, g in got.items()}
        for i, g in got.items():
            want = sum(int((as_bits[i] ^ b).sum()) <= simhash.RADIUS for b in as_bits.values()) if i % 20 == 0 else None
            assert g["n_near"] == want
    assert simhash.with_neighbours(simhash.fingerprint_documents(nothing)).collect() == []


def test_many_ranges(spark):
    """Followers across the borders of ranges, some of them empty."""
    docs = spark.createDataFrame([(i * i, f"word{i} " * (i % 7) + "x" * (i % 11)) for i in range(61)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {r["doc_id"]: r for r in simhash.fingerprint_documents(docs).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = sorted(docs.collect(), key=lambda r: -r["doc_id"])
    assert len(got) == 61
    for r, after in zip(rows, rows[1:] + rows[:1]):
        assert got[r["doc_id"]]["edited_sha256"] == hashlib.sha256(simhash.edited(r["text"], after["text"]).encode()).hexdigest()
        a, b = (np.frombuffer(bytes.fromhex(got[x["doc_id"]]["fingerprint"]), dtype=np.uint8)[None] for x in (r, after))
        assert got[r["doc_id"]]["near_next"] == simhash.likeness(a, b)[0]


def test_likeness_follows_the_edit(documents):
    got = [r for r in simhash.fingerprint_documents(documents).collect() if r["n_chars"] > 600]
    assert np.mean([r["near_edited"] for r in got]) > 0.5 > 0.3 > np.mean([r["near_next"] for r in got])


def test_nulls_and_repeated_rows(awkward):
    assert simhash.with_neighbours(simhash.fingerprint_documents(awkward)).count() == awkward.count()


def test_radius(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(256) for _ in range(5)]
    prints = {f"{b ^ sum(1 << p for p in rng.sample(range(256), k)):064x}" for b in base for k in range(12) for _ in range(4)}
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    got = {(r["query"], r["fingerprint"], r["apart"]) for r in simhash.near_fingerprints(df, df).collect()}
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert got == {(a, b, apart(a, b)) for a in prints for b in prints if apart(a, b) <= 7}
