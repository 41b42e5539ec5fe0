"""Chains of accidentals, and pages that arrive twice or late."""

import random

import pytest

from scorelake.operators import attach
from scorelake.streaming import carry, pages

ACC = "page_id int, acc_id bigint, shift int, x0 bigint, y0 bigint, x1 bigint, y1 bigint"


def test_chain_ends_by_pointer_doubling(spark):
    rng = random.Random(3)
    edges, want = [], []
    for page in range(3):
        for chain in range(20):
            ids = rng.sample(range(chain * 100, chain * 100 + 100), rng.randint(2, 70))
            edges += [(page, a, b) for a, b in zip(ids, ids[1:])]
            want += [(page, a, ids[-1], len(ids) - 1 - k) for k, a in enumerate(ids[:-1])]
    got = attach.chain_ends(spark.createDataFrame(edges, "page_id int, acc_id bigint, next_id bigint"))
    assert sorted(tuple(r) for r in got.select("page_id", "acc_id", "end_id", "steps").collect()) == sorted(want)


def test_roles_in_front_of_a_chord(spark):
    """Three accidentals before a chord of three heads, one before a single head, two before nothing."""
    heads = spark.createDataFrame([(0, 1, 7, 100, 100, 112, 112), (0, 2, 7, 100, 120, 112, 132), (0, 3, 7, 100, 140, 112, 152), (0, 4, 8, 300, 100, 312, 112)],
                                  "page_id int, ng bigint, chord_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    acc = spark.createDataFrame([
        (0, 10, 1, 88, 95, 98, 117), (0, 11, 1, 76, 110, 86, 136), (0, 12, 1, 64, 128, 74, 162),
        (0, 20, 0, 288, 95, 298, 117), (0, 21, 0, 276, 95, 286, 117), (0, 30, -1, 500, 95, 510, 117), (0, 31, -1, 512, 95, 522, 117)], ACC)
    done = attach.accidental_chains(attach.accidental_to_note(acc, heads.drop("chord_id")).drop("maybe_key_signature"), heads)
    got = {r["acc_id"]: (r["end_id"], r["steps"], r["role"], r["ng"]) for r in done.collect()}
    assert got == {10: (10, 0, "note", 1), 11: (10, 1, "chord", 2), 12: (10, 2, "chord", 3), 20: (20, 0, "note", 4), 21: (20, 1, "single_head", None),
                   30: (31, 1, "key_signature", None), 31: (31, 0, "key_signature", None)}


def test_a_page_delivered_again_appears_once(spark, tmp_path):
    folder = str(tmp_path)
    schema = "page_id bigint, det_seq bigint, v string"
    for turn, (ids, within) in enumerate([((0, 1, 2), "1 day"), ((2, 3), "1 day"), ((0, 3, 4), "1 day")]):
        spark.createDataFrame([(p, s, f"t{turn}") for p in ids for s in range(3)], schema).coalesce(1).write.mode("append").parquet(folder + "/in")
        arriving = pages.read_pages(spark, folder + "/in", schema)
        pages.process_pages(arriving, folder + "/out", folder + "/checkpoint", step=lambda rows: rows, within=within).awaitTermination()
    got = sorted((r["page_id"], r["det_seq"], r["v"]) for r in spark.read.parquet(folder + "/out").collect())
    assert got == sorted((p, s, v) for p, v in ((0, "t0"), (1, "t0"), (2, "t0"), (3, "t1"), (4, "t2")) for s in range(3))


def _deliver(spark, folder, rows, step, schema="page_id bigint, det_seq bigint, v string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder + "/in")
    pages.process_pages(pages.read_pages(spark, folder + "/in", schema), folder + "/out", folder + "/checkpoint", step=step).awaitTermination()


@pytest.mark.parametrize("few", [0, 100_000])
def test_what_arrived_is_kept_in_files(spark, tmp_path, monkeypatch, few):
    """Rows of a known page that are new are taken, known ones are not, NULL counts as a value; no state store has to hold them all."""
    monkeypatch.setattr(pages, "FEW_PAGES", few)
    folder = str(tmp_path)
    same = lambda rows: rows
    _deliver(spark, folder, [(1, 1, "a"), (1, 1, "a"), (2, None, "a"), (None, 1, "a")], same)
    _deliver(spark, folder, [(1, 1, "b"), (1, 2, "b"), (2, None, "b"), (None, 1, "b"), (None, 2, "b")], same)
    _deliver(spark, folder, [(1, 1, "c"), (1, 2, "c"), (3, 1, "c")], same)
    got = sorted((tuple(r) for r in spark.read.parquet(folder + "/out").select("page_id", "det_seq", "v").collect()), key=str)
    assert got == sorted([(1, 1, "a"), (2, None, "a"), (None, 1, "a"), (1, 2, "b"), (None, 2, "b"), (3, 1, "c")], key=str)
    assert not (tmp_path / "checkpoint" / "state").exists()


def test_a_batch_that_failed_is_run_again(spark, tmp_path):
    """Rows that were put away before the step failed do not count as delivered."""
    folder, broken = str(tmp_path), [True]

    def step(rows):
        if rows.filter("v = 'b'").count() and broken.pop():
            broken.append(False)
            raise ValueError("first try")
        return rows

    _deliver(spark, folder, [(1, 1, "a")], step)
    with pytest.raises(Exception, match="first try"):
        _deliver(spark, folder, [(2, 1, "b"), (1, 1, "b")], step)
    _deliver(spark, folder, [(3, 1, "c")], step)
    got = sorted(tuple(r) for r in spark.read.parquet(folder + "/out").select("page_id", "det_seq", "v").collect())
    assert got == [(1, 1, "a"), (2, 1, "b"), (3, 1, "c")]


def test_late_pages_change_only_what_follows(spark, tmp_path):
    """Pages 2 and 3, then 0, then 1: values of pages before the late one are not written again."""
    folder = str(tmp_path)
    page = {0: [(1, None, 3), (None, 2, None)], 1: [(None, None, None), (0, None, 5)], 2: [(None, -1, None), (None, None, None), (None, None, None)], 3: [(None, None, None)]}
    for turn in ((2, 3), (0,), (1,)):
        rows = [(0, p, 0, b, c, k, n, n and 4) for p in turn for b, (c, k, n) in enumerate(page[p])]
        spark.createDataFrame(rows, carry.BARS).coalesce(1).write.mode("append").parquet(folder + "/in")
        carry.carry_pages(pages.read_pages(spark, folder + "/in", carry.BARS), folder + "/out", folder + "/checkpoint").awaitTermination()
    written = {(r["batch_id"], r["page_id"]) for r in spark.read.parquet(folder + "/out/inherited").collect()}
    assert written == {(0, 2), (0, 3), (1, 0), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)}
    want, clef, key, time, number = [], None, None, None, 0
    for p in range(4):
        for b, (c, k, n) in enumerate(page[p]):
            clef, key, time = (c if c is not None else clef), (k if k is not None else key), ((n, 4) if n else time)
            want.append((p, b, number, clef, key, time))
            number += 1
    got = [(r["page_id"], r["bar_no"], r["number"], r["clef"], r["key"], r["time"] and tuple(r["time"])) for r in carry.carried_bars(spark, folder + "/out").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
