"""Steps whose cost must grow no faster than their input."""

import random
import statistics

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from __spark_entry__ import queries
from scorelake.operators import associate, attach, components, curves, evaluate, greedy, keys, profile, spans, tokens
from scorelake.plans import queries_spans
from scorelake.streaming import pages


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_is_never_broadcast(spark):
    """An explode makes far more rows than the planner expects, so a join back of the sums sent the profile through the driver."""
    zones = spark.range(40).select(F.floor(F.col("id") / 8).alias("page_id"), (F.col("id") % 8).alias("zone"))
    rows = zones.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(119)))).withColumn(
        "n", F.when(F.col("y") % 16 == 3, 60 + F.col("y") % 7).otherwise(F.col("y") % 9))
    z = profile.zscores(rows)
    assert "Broadcast" not in plan_of(z)
    lines = profile.staff_line_peaks(rows)
    assert "Broadcast" not in plan_of(lines)
    assert z.count() == 40 * 120 and lines.groupBy("page_id", "zone").count().count() == 40


def test_pixels_move_once(spark):
    """Column medians, hull and sums of a component come from one shuffle of its pixels."""
    rng = random.Random(5)
    pixels = [(p, c, x, rng.randint(0, 9) if x % 4 else None) for p in range(2) for c in range(5) for x in range(12) for _ in range(rng.randint(1, 5))]
    done = curves.curve_features(spark.createDataFrame(pixels, "page_id long, component long, x long, y long"))
    assert plan_of(done).count("Exchange") == 1
    for r in done.collect():
        mine = [(x, y) for p, c, x, y in pixels if (p, c) == (r["page_id"], r["component"])]
        medians = {x: statistics.median(y for a, y in mine if a == x and y is not None) for x in range(12) if x % 4}
        assert (r["area"], r["n_columns"]) == (len(mine), 12)
        top = min(y for _, y in mine if y is not None)
        assert r["left_y"] == medians[1] - top  # columns 0 and 1, of which 0 is empty


def test_components_of_a_page_in_one_pass(spark, monkeypatch):
    """Ordinary pages take no rounds over all links; both ways agree with a plain search, also where members and links have equal ids."""
    rng = random.Random(7)
    links = [(p, rng.randint(0, 40), rng.randint(0, 30)) for p in range(6) for _ in range(45)]
    want = set()
    for p in range(6):
        left = {m for q, m, _ in links if q == p}
        while left:
            group, more = set(), {min(left)}
            while more:
                group |= more
                shared = {k for q, m, k in links if q == p and m in group}
                more = {m for q, m, k in links if q == p and k in shared} - group
            want |= {(p, m, min(group)) for m in group}
            left -= group
    df = spark.createDataFrame(links, "page_id long, member long, link long")
    assert {tuple(r) for r in components.page_components(df, max_links=10).collect()} == want
    monkeypatch.setattr(components, "connected_components", None)
    assert {tuple(r) for r in components.page_components(df).collect()} == want


def test_chains_of_a_page_in_one_pass(spark, monkeypatch):
    """Ordinary pages take no rounds of pointer doubling; larger ones do, with the same outcome."""
    edges, want = [], set()
    for page, length in enumerate((3, 9, 40)):
        edges += [(page, k, k + 1) for k in range(length)]
        want |= {(page, k, length, length - k) for k in range(length)}
    df = spark.createDataFrame(edges, "page_id int, acc_id bigint, next_id bigint")
    columns = ["page_id", "acc_id", "end_id", "steps"]
    assert {tuple(r) for r in attach.chain_ends(df, max_links=10).select(*columns).collect()} == want
    monkeypatch.setattr(attach, "_doubled", None)
    assert {tuple(r) for r in attach.chain_ends(df).select(*columns).collect()} == want


def test_a_batch_asks_the_state_store_once(spark, tmp_path):
    """A step of several jobs does not sort out the delivered pages again for each of them."""
    seen = []

    def step(rows):
        seen.append(rows._jdf.queryExecution().toRdd().toDebugString())
        return rows

    folder, schema = str(tmp_path), "page_id bigint, det_seq bigint"
    spark.createDataFrame([(0, 0), (0, 1), (0, 1)], schema).coalesce(1).write.parquet(folder + "/in")
    pages.process_pages(pages.read_pages(spark, folder + "/in", schema), folder + "/out", folder + "/checkpoint", step=step).awaitTermination()
    assert seen and not any("StateStore" in lineage for lineage in seen)
    assert spark.read.parquet(folder + "/out").count() == 2


def test_streams_are_made_once_for_merging(spark):
    assert plan_of(queries()["token_merge"](spark, "/root/testdata/sf0.001")).count("FileScan parquet") == 1


def test_lines_are_read_without_interpreted_folds(spark):
    """Lambdas over the symbols of a line are never compiled and took most of the time; the groups of a batch are read once each."""
    text = "clef-G2 keySignature-DM  note-C5_quarter|tie|note-F#5_half note-F5_thirty.|gracenote-Bb4_eighth tie barline note-F5_quarter rest-quarter keySignature-EbM note-Bb4_half note-_x note-F#5_half"
    lines = spark.createDataFrame([("a", text), ("b", None), ("c", "tie"), ("d", "barline")], "line_id string, text string")
    done = tokens.visible_accidentals(lines)
    assert "lambda" not in plan_of(done)
    rows = done.select("line_id", "pos", "sub_pos", "chord_pos", "symbol", "pitch", "visible").orderBy("line_id", "pos", "sub_pos").collect()
    assert [tuple(r) for r in rows] == [
        ("a", 0, 0, 0, "clef-G2", "nonote", None), ("a", 1, 0, 0, "keySignature-DM", "nonote", None),
        ("a", 2, 0, 1, "note-C5_quarter", "note-C5", "0"), ("a", 2, 2, 0, "note-F#5_half", "note-F5", ""),
        ("a", 3, 0, 0, "note-F5_thirty.", "note-F5", "0"), ("a", 3, 1, 1, "gracenote-Bb4_eighth", "note-B4", "b"),
        ("a", 5, 0, 0, "barline", "nonote", None), ("a", 6, 0, 0, "note-F5_quarter", "note-F5", "0"), ("a", 7, 0, 0, "rest-quarter", "nonote", None),
        ("a", 8, 0, 0, "keySignature-EbM", "nonote", None), ("a", 9, 0, 0, "note-Bb4_half", "note-B4", ""), ("a", 10, 0, 0, "note-_x", "note-", ""),
        ("a", 11, 0, 0, "note-F#5_half", "note-F5", "#"), ("d", 0, 0, 0, "barline", "nonote", None)]


def test_alignment_of_a_matching_line_is_linear(monkeypatch):
    """A line that misses an element tries no pairs far from its own; one with elements left over is aligned in full."""
    calls, moves = [], tokens._moves
    monkeypatch.setattr(tokens, "_moves", lambda *a: calls.append(1) or moves(*a))
    code = {f"note-{k}": f"n{3 * k}" for k in range(200)}
    line, codes = list(code), list(code.values())
    assert tokens.align_one(line, codes[1:], code) == [(i, i + 1, 0) for i in range(199)]
    assert len(calls) <= 4 * 200
    assert len(tokens.align_one(line, ["b", "b", "b", *codes], code)) == 200


def test_a_batch_reads_its_own_pieces(spark, tmp_path):
    """Files with other pieces are skipped by their statistics, pieces delivered again replace their rows, and no folder is made per piece."""
    read, folder = [], str(tmp_path)
    rows = lambda pieces, page: spark.createDataFrame([(p, page) for p in pieces], "piece bigint, page_id bigint").coalesce(1)

    def rerun(state):
        read.append(plan_of(state))
        return state.groupBy("piece").agg(F.max("page_id").alias("last_page"), F.count("*").alias("n"))

    def deliver():
        arriving = pages.read_pages(spark, folder + "/in", "piece bigint, page_id bigint", files_per_batch=1)
        pages.refresh_pieces(arriving, lambda: spark.read.parquet(folder + "/in"), rerun, folder + "/out", folder + "/checkpoint").awaitTermination()

    rows(range(5), 1).write.parquet(folder + "/in")
    deliver()
    rows(range(1000, 1003), 7).write.mode("append").parquet(folder + "/in")
    rows([2], 9).write.mode("append").parquet(folder + "/in")
    deliver()
    done = {tuple(r) for r in pages.latest_pieces(spark, folder + "/out").select("piece", "last_page", "n").collect()}
    assert done == {(p, 9 if p == 2 else 1, 2 if p == 2 else 1) for p in range(5)} | {(p, 7, 1) for p in range(1000, 1003)}
    assert len(read) == 3 and all("GreaterThanOrEqual(piece" in plan for plan in read)
    assert not [f for f in (tmp_path / "out").iterdir() if f.name.startswith("piece=")]


def test_pairs_are_matched_in_one_pass(spark):
    """Folds in lambdas are never compiled; a null side is never taken, and equal ids of two groups do not meet."""
    rng = random.Random(9)
    pairs = [(rng.choice([None, 0, 1]), rng.choice([None, *range(8)]), rng.choice([None, *range(8)]), i) for i in range(120)]
    done = greedy.match(spark.createDataFrame(pairs, "page_id long, a long, b long, p long").repartition(5), keys=["page_id"], left="a", right="b", priority=[F.col("p")], payload=["p"])
    assert "lambda" not in plan_of(done)
    want, used = [], set()
    for page, a, b, p in pairs:
        sides = {(page, k, v) for k, v in (("a", a), ("b", b)) if v is not None}
        if not sides & used:
            used |= sides
            want.append((page, a, b, p))
    assert sorted(map(repr, map(tuple, done.collect()))) == sorted(map(repr, want))


def test_levels_of_precision_are_matched_once(spark, monkeypatch):
    """Matches at a higher IoU are those of the lowest level that reach it; detections of one id count each, as in a join."""
    rng, calls, match = random.Random(10), [], evaluate.greedy_match
    boxes = lambda n: [(p, i, i % 2, x, y, x + rng.randint(6, 12), y + rng.randint(6, 12), rng.choice([0.2, 0.5, 0.9]))
                       for p in range(3) for i in range(n) for x, y in [(rng.randint(0, 30), rng.randint(0, 30))]]
    schema = "page_id long, {} long, class_id long, x0 long, y0 long, x1 long, y1 long, confidence double"
    gt, pred = spark.createDataFrame(boxes(25), schema.format("gt_seq")), spark.createDataFrame(boxes(40), schema.format("det_seq"))
    pred = pred.unionByName(pred.filter("det_seq < 5"))
    monkeypatch.setattr(evaluate, "greedy_match", lambda *a, **k: calls.append(1) or match(*a, **k))
    got = {r["class_id"]: r["map"] for r in evaluate.mean_average_precision(gt, pred, (0.5, 0.3, 0.7)).collect()}
    assert len(calls) == 1
    each = [{r["class_id"]: r["ap"] for r in evaluate.average_precision(gt, pred, match(gt, pred, iou_threshold=t)).collect()} for t in (0.5, 0.3, 0.7)]
    assert got.keys() == each[0].keys() and all(abs(got[c] - sum(e[c] for e in each) / 3) < 1e-12 and got[c] > 0 for c in got)


def test_symbols_are_matched_once_and_crowded_cells_in_parts(spark):
    """The best symbol of a note group needs no second matching of all symbols; equal costs go to the smaller id, with any number of arrays per cell."""
    rng = random.Random(13)
    cand = spark.createDataFrame([(p, i, "accent", rng.choice(["above", "below", None]), x, y, x + 4.0, y + 4.0, 0.5) for p in range(2) for i in range(60)
                                  for x, y in [(float(rng.randrange(0, 300, 10)), float(rng.randrange(0, 120, 10)))]] + [(1, 60, "accent", None, 50.0, None, 54.0, None, 0.5)] * 2,
                                 "page_id long, cand_seq long, class_name string, side string, x0 double, y0 double, x1 double, y1 double, confidence double")
    rows = [(p, (1 << 57) + i, x, y, x + 10.0, y + 10.0) for p in range(2) for i in range(90)
            for x, y in [(float(rng.randrange(0, 300, 20)), float(rng.randrange(20, 100, 20)))]]
    groups = spark.createDataFrame(rows, "page_id long, ng long, x0 double, y0 double, x1 double, y1 double")
    found = [associate.associate_symbols(cand, groups, None, max_partners=n) for n in (512, 4)]
    want = []
    for c in cand.collect():
        best = []
        for p, ng, x0, y0, x1, y1 in rows:
            known = c["y0"] is not None
            gaps = {"above": max(0.0, y0 - c["y1"]), "below": max(0.0, c["y0"] - y1)} if known else {"above": 0.0, "below": 0.0}
            side, dx = c["side"], abs((c["x0"] + c["x1"]) / 2 - (x0 + x1) / 2) / 12.0
            gap = (gaps[side] if side else max(gaps.values())) / 12.0
            ok = not side or (c["y0"] + c["y1"] <= y0 + y1 if side == "above" else c["y0"] + c["y1"] >= y0 + y1)
            if p == c["page_id"] and dx <= 2.5 and gap <= 4.0 and ok:
                best.append((dx + 0.35 * gap + 0.15 * 0.5, ng))
        want.append((c["page_id"], c["cand_seq"], *(min(best)[::-1] if best else (None, None))))
    for df in found:
        got = df.select("page_id", "cand_seq", "matched_ng", "association_cost").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    plan = plan_of(associate.keep_best(found[0]))
    assert plan.count("MapInArrow") == 1


def test_places_of_notes_carry_no_accidentals(spark, monkeypatch):
    """Accidentals of all notes are carried for the events alone, and slurs, ties and wedges meet their notes in one join."""
    sf, calls, locate = "/root/testdata/sf0.001", [], spans.locate
    _, placed = queries_spans._score(spark, sf)
    assert "Window" not in plan_of(placed)
    monkeypatch.setattr(spans, "locate", lambda *a: calls.append(1) or locate(*a))
    located = queries_spans._located(spark, sf, placed)
    assert len(calls) == 1 and {"slur", "tie"} <= {r["kind"] for r in located.select("kind").distinct().collect()}


def test_pages_of_boxes_share_a_pass(spark):
    """clusters of many small pages come from passes over whole batches, not from a pandas frame per page; pages may lie across batches."""
    from scorelake.operators.clusters import merge_nearby, ward_labels

    rng = random.Random(26)
    rows = [(p or None, rng.randint(0, 60), rng.randint(0, 60)) for p in range(30) for _ in range(rng.randint(1, 12))]
    boxes = spark.createDataFrame(rows, "page_id long, x0 long, y0 long").selectExpr("*", "x0 + 2 AS x1", "y0 + 4 AS y1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        merged = merge_nearby(boxes, 9.0)
        assert "FlatMapGroupsInPandas" not in plan_of(merged)
        got = sorted(map(repr, merged.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for p in range(30):
        mine = sorted((x + 1.0, y + 2.0) for q, x, y in rows if q == (p or None))
        points = np.array(sorted(set(mine)))
        labels = ward_labels(points, 9.0, np.array([mine.count(tuple(c)) for c in points]))
        for label in set(labels):
            xs, ys = points[labels == label].T
            n = sum(mine.count(tuple(c)) for c in points[labels == label])
            want.append(Row(page_id=p or None, x0=int(min(xs)) - 1, y0=int(min(ys)) - 2, x1=int(max(xs)) + 1, y1=int(max(ys)) + 2, n=n))
    assert got == sorted(map(repr, want))


def test_both_ends_of_a_curve_meet_their_staff_once(spark):
    """F28, F31, F32: one join and one pass for both ends; staffs with many groups go by cells, with the same outcome."""
    rng = random.Random(31)
    groups = [(p, n, x, x + 10, y, y + 12, [n % 3]) for p in range(3) for n in range(40) for x, y in [(rng.randrange(0, 900), rng.randrange(80, 140))]]
    rows = [(p, c, 0, 10.0, x, rng.randrange(70, 150), x + rng.randrange(0, 200), rng.randrange(70, 150), 0.9) for p in range(3) for c in range(30)
            for x in [rng.randrange(0, 900)]]
    cand = spark.createDataFrame(rows, "page_id long, candidate_id long, staff_index long, unit double, left_x long, left_y long, right_x long, right_y long, confidence double")
    notes = spark.createDataFrame(groups, "page_id long, ng long, x0 long, x1 long, y0 long, y1 long, pitches array<long>")
    staff = spark.createDataFrame([(p, 0, 0, 1000, 110.0, 10.0) for p in range(3)], "page_id long, staff_index long, left_x long, right_x long, center_y double, unit double")
    placed = curves.placed_groups(notes, staff)
    whole = curves.match_endpoints(cand, placed)
    assert plan_of(whole).count("MapInArrow") == 1
    got = {(r["page_id"], r["candidate_id"]): r for r in whole.collect()}
    cells = {(r["page_id"], r["candidate_id"]): r for r in curves.match_endpoints(cand, placed, max_partners=5).collect()}
    assert got == cells and len(got) == 90 and {r["left"] is None for r in got.values()} == {True, False}
    for p, c, _, unit, lx, ly, rx, ry, _ in rows:
        for end, x, y in (("left", lx, ly), ("right", rx, ry)):
            costs = []
            for q, n, x0, x1, y0, y1, _ in groups:
                dx, dy = abs(x - (x0 + x1) / 2) / unit, max(0.0, y0 - y, y - y1) / unit
                if q == p and dx <= curves.MAX_HORIZONTAL_UNITS and dy <= curves.CURVE_VERTICAL_UNITS:
                    costs.append(1.5 * dx + 0.35 * dy)
            mine = got[p, c][end]
            assert (mine and mine["cost"]) == (min(costs) if costs else None)


def test_edges_of_hairpins_meet_their_staff_once(spark):
    """Both edges find the closest group in one join, also beside equal distances and copies; crowded staves are merged with theirs and give the same."""
    rng = random.Random(9)
    box = lambda x, y: (float(x), float(y), float(x + 10), float(y + 10))
    heads = [(p, k, *box(rng.randrange(0, 900, 10), 95)) for p in range(3) for k in range(1 + 7 * p)]
    made = [(p, k, "crescendo", None, float(x := rng.randrange(0, 900, 5)), 125., float(x + rng.randrange(20, 200, 5)), 145., 0.9) for p in range(4) for k in range(15)]
    groups = spark.createDataFrame(heads, "page_id int, ng bigint, x0 double, y0 double, x1 double, y1 double")
    pins = spark.createDataFrame(made, "page_id int, cand_seq bigint, class_name string, side string, x0 double, y0 double, x1 double, y1 double, confidence double")
    near = lambda p, x: min(((abs(x - (h[2] + h[4]) / 2), h[1]) for h in heads if h[0] == p), default=None)
    want = set()
    for p, k, _, _, x0, _, x1, _, _ in made:
        a, b = near(p, x0), near(p, x1)
        reason = ("not_enough_note_groups_for_span" if sum(h[0] == p for h in heads) < 2 else "span_endpoints_not_distinct" if a[1] == b[1]
                  else "span_endpoints_too_far" if max(a[0], b[0]) / 10 > 3.75 else None)
        want.add((p, k, reason, None if reason else a[1], None if reason else b[1]))
    assert len({w[2] for w in want}) == 4
    columns = ["page_id", "cand_seq", "association_reason", "start_ng", "stop_ng"]
    done = associate.associate_hairpins(pins, groups, None, fallback_unit=10)
    assert {tuple(r) for r in done.select(*columns).collect()} == want and plan_of(done).count("Exchange hash") <= 4
    assert {tuple(r) for r in associate.associate_hairpins(pins, groups, None, fallback_unit=10, max_partners=10).select(*columns).collect()} == want


def test_notes_move_once_for_their_accidentals(spark):
    """One shuffle in place of one for the window, one for totals and two for the way back; large groups go by segments with the same outcome."""
    rng = random.Random(2)
    made = [(p, slot, ng, 14 + rng.randrange(3), rng.choice([None, None, -1, 0, 1]), p % 9 - 4) for p in range(4) for slot in range(12) for ng in range(3)]
    notes = spark.createDataFrame(made, "page_id long, slot long, ng long, steps long, accidental long, fifths long")
    done = [keys.carry_accidentals(notes, measure=["page_id"], segment="slot", order=["slot", "ng"], **more) for more in ({}, {"max_group": 8})]
    assert plan_of(done[0]).count("Exchange hash") == 1
    rows = [{tuple(r) for r in d.select("page_id", "slot", "ng", "alter").collect()} for d in done]
    assert rows[0] == rows[1] and len(rows[0]) == len(made)
    held = {}
    for p, slot, ng, steps, own, _ in made:
        held[p, steps] = held.get((p, steps)) if own is None else own
        if held[p, steps] is not None:
            assert (p, slot, ng, held[p, steps]) in rows[0]
