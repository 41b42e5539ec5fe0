"""Searches against brute force."""

import itertools
import random

from scorelake.operators import calibrate as C
from scorelake.operators import tokens as T
from scorelake.operators.clusters import ward_labels
from scorelake.operators.profile import find_line_peaks


def test_bar_is_cheapest():
    rng = random.Random(1)
    for _ in range(200):
        n, target = rng.randint(1, 5), rng.choice([4, 6, 8, 12])
        lengths = tuple(rng.choice([1, 2, 3, 4, 6, 8, 5]) for _ in range(n))
        weights = tuple(rng.choice([1, 0.5]) for _ in range(n))
        moves = [C.note_moves(v, w, target) for v, w in zip(lengths, weights)]
        costs = [sum(m[v] for m, v in zip(moves, c)) for c in itertools.product(*moves) if sum(c) == target]
        got = C._bar(lengths, weights, target)
        assert sum(got) == target
        if costs:
            assert abs(sum(m[v] for m, v in zip(moves, got)) - min(costs)) < 1e-9


def test_groups_add_up():
    for lengths, types in (((8, 10, 8, 4), (0, 2, 0, 0)), ((8, 4, 4, 12), (0, 1, 1, 0)), ((24, 12, 12), (0, 0, 2))):
        assert sum(C._groups(lengths, types, 36, 4, 9)) == 36


def test_one_of_five_equal_notes_goes():
    assert C._bar((1, 1, 1, 1, 1), (1, 1, 0.5, 1, 1), 4) == [1, 1, 0, 1, 1]


ELEMENT = "bar int, elem_seq bigint, ticks bigint, is_rest boolean, group_id bigint, beam_l bigint, beam_r bigint, beam_x bigint, beam_y bigint, ts_num int, ts_den int"


def test_tuned_bars_fill_the_measure(spark):
    rows = []
    for bar in range(60):
        rng = random.Random(bar)
        for i in range(rng.randint(2, 6)):
            rest = rng.random() < 0.2
            rows.append((bar, i, rng.choice([20160, 10080, 5040, 15120]), rest, -1 if rest else rng.choice([0, 1, 2]) if i else 0, 9, 9, i * 20, 50, 3, 4))
    out = C.tune_bars(spark.createDataFrame(rows, ELEMENT), ["bar"])
    per_bar = {r.bar: r for r in out.groupBy("bar", "tune_case").agg({"tuned_ticks": "sum", "elem_seq": "count"}).collect()}
    count = {b: sum(1 for r in rows if r[0] == b) for b in per_bar}
    for bar, r in per_bar.items():
        assert r["count(elem_seq)"] == count[bar]
        if r.tune_case != "singles_and_beats":
            assert r["sum(tuned_ticks)"] == 60480, r


def test_tuplet_and_even_groups(spark):
    triplet = [(0, i, 10080, False, 1, 9, 9, i * 20, 50, 1, 4) for i in range(3)]
    got = sorted((r.elem_seq, r.tuned_ticks, r.tune_case) for r in C.tune_bars(spark.createDataFrame(triplet, ELEMENT), ["bar"]).collect())
    assert got == [(i, 6720, "one_beat_per_group") for i in range(3)]


def test_alignment():
    code = {"note-C5_quarter": "n6", "note-D5_quarter": "n7", "rest-quarter": "r0", "note-E6_quarter": "n15"}
    tokens = ["clef-G2", "keySignature-DM", "note-C5_quarter", "note-D5_quarter", "barline", "rest-quarter"]
    assert T.align_one(tokens, ["c1", "s", "s", "n6", "n7", "b", "r0"], code) == [(0, 0, 0), (1, 1, 0), (2, 1, 0), (3, 2, 0), (4, 3, 0), (5, 4, 0), (6, 5, 0)]
    assert T.align_one(["note-C5_quarter", "note-D5_quarter"], ["n7"], code) == [(0, 1, 0)]
    assert T.align_one(["note-E6_quarter"], ["n16"], code) == [(0, 0, 1)]
    chord = ["note-C5_quarter|note-D5_quarter"]
    assert T.align_one(chord, ["n7", "n6"], code) == [(0, 0, 0), (1, 0, 0)]


def test_ward_and_peaks():
    import numpy as np

    labels = ward_labels(np.array([[0.0, 0], [1, 0], [50, 0], [51, 0], [200, 0]]), 10)
    assert labels.tolist() == [0, 0, 2, 2, 4]
    z = np.array([0, 0, 5, 5, 0, 0, 0, 3, 0, 0, 0, 0, 4, 0.0])
    assert find_line_peaks(z, 1, 3, 1.0) == [2, 7, 12]
    assert find_line_peaks(z, 1, 6, 1.0) == [2, 12]


def test_copies_keep_their_weight_in_clusters(spark):
    import numpy as np

    from scorelake.operators.clusters import merge_nearby

    # three copies at 0 and one point at 10: the distance of the clusters is sqrt(1.5) * 10
    assert len(set(ward_labels(np.array([[0.0, 0], [10, 0]]), 11, np.array([3, 1])))) == 2
    assert len(set(ward_labels(np.array([[0.0, 0], [10, 0]]), 12.3, np.array([3, 1])))) == 1
    rng = np.random.default_rng(4)
    for _ in range(20):
        points = rng.integers(0, 30, (8, 2)).astype(float)
        points = np.unique(points, axis=0)
        copies = rng.integers(1, 5, len(points))
        which = np.repeat(np.arange(len(points)), copies)
        whole, folded = ward_labels(points[which], 9.5), ward_labels(points, 9.5, copies)
        assert all((whole[i] == whole[j]) == (folded[which[i]] == folded[which[j]]) for i in range(len(which)) for j in range(i))
    boxes = [(0, 0.0, 0.0, 4.0, 4.0)] * 3 + [(0, 10.0, 0.0, 14.0, 4.0)]
    got = merge_nearby(spark.createDataFrame(boxes, "page_id int, x0 double, y0 double, x1 double, y1 double"), 11.0).collect()
    assert sorted((r.x0, r.n) for r in got) == [(0.0, 3), (10.0, 1)]


def test_two_means_settle(spark):
    """Centers that need many rounds: values that grow geometrically, against the plain rule run until nothing moves."""
    from scorelake.operators.clusters import two_means

    rng = random.Random(8)
    pages = {0: [float(i) for i in range(1, 301)] * 3 + [1000.0], 1: [1.1 ** i for i in range(120)], 2: [5.0], 3: [rng.paretovariate(0.7) for _ in range(500)]}
    got = {r.page_id: (r.low_center, r.high_center) for r in two_means(
        spark.createDataFrame([(p, v) for p, values in pages.items() for v in values], "page_id int, size double")).collect()}
    for page, values in pages.items():
        lo, hi = min(values), max(values)
        while True:
            low, high = [v for v in values if abs(v - lo) <= abs(v - hi)], [v for v in values if abs(v - lo) > abs(v - hi)]
            now = (sum(low) / len(low) if low else lo, sum(high) / len(high) if high else hi)
            if max(abs(now[0] - lo), abs(now[1] - hi)) < 1e-12:
                break
            lo, hi = now
        assert max(abs(got[page][0] - lo), abs(got[page][1] - hi)) < 1e-6, page


def test_alignment_is_the_best_of_all(spark):
    """Against trying every sequence of moves on small lines."""
    rng = random.Random(6)
    names = [f"note-{c}" for c in "abcd"] + ["rest-x"]

    def best(tokens, codes, note_codes):
        if not tokens or not codes:
            return (0, 0)
        token = tokens[0]
        if isinstance(token, str) and "|" in token:
            order = sorted(token.split("|"), key=lambda t: codes.index(note_codes[t]) if note_codes[t] in codes else -1)
            return best([*order, *tokens[1:]], codes, note_codes)
        options = []
        for leave_token, leave_element, displaced in T._moves(token, note_codes.get(token), codes[0]):
            a, b = best(tokens[leave_token:], codes[leave_element:], note_codes)
            options.append((a + (displaced is not None), b - (displaced or 0)))
        return max(options)

    for _ in range(300):
        note_codes = {n: f"n{rng.randint(-4, 15)}" if n[0] == "n" else "r0" for n in names}
        tokens = [rng.choice([*names, "note-a|note-b", "keySignature", "clef-G2", "barline", "time"]) for _ in range(rng.randint(0, 5))]
        codes = [rng.choice([*note_codes.values(), "s", "c1", "b", "n14"]) for _ in range(rng.randint(0, 6))]
        got = T.align_one(tokens, codes, note_codes)
        assert (len(got), -sum(x[2] for x in got)) == best(tokens, codes, note_codes)
        assert [x[0] for x in got] == sorted({x[0] for x in got})


def test_chords_are_as_long_as_their_shortest_head(spark):
    from scorelake.plans.queries_bars import note_ticks
    from scorelake.plans.queries_calibrate import BAR, elements

    sf = "/root/testdata/sf0.001"
    heads = {}
    for r in note_ticks(spark, sf).select(*BAR, "slot", "ticks", "is_rest").collect():
        heads.setdefault(tuple(r[:4]), []).append((r.is_rest == 1, r.ticks))
    got = {tuple(r[:4]): (r.is_rest, r.ticks) for r in elements(spark, sf).select(*BAR, "elem_seq", "is_rest", "ticks").collect()}
    assert got == {k: min(v) for k, v in heads.items()}
