"""Oversized groups take another way and give the same rows; one page holds most of the data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.functions.boxes import box
from scorelake.operators import associate, clusters, detect, evaluate, prefix, ranking
from scorelake.operators.components import connected_components


def same(a, b):
    assert a.columns == b.columns
    left, right = sorted(map(tuple, a.collect()), key=repr), sorted(map(tuple, b.collect()), key=repr)
    assert left == right and left


@pytest.fixture(scope="module")
def det(spark):
    rng = np.random.default_rng(5)
    out = []
    for i in range(900):
        page = 0 if i < 600 else int(rng.integers(1, 6))
        x, y = (int(v) for v in rng.integers(0, 260, 2))
        w, h = (int(v) for v in rng.integers(6, 40, 2))
        if i % 3 == 0:
            x, y, w, h = 100, 100, 20, 20  # a third are copies of one box
        out.append((page, i % 2, i, float(x), float(y), float(x + w), float(y + h), float(rng.integers(1, 6)) / 10))
    return spark.createDataFrame(out, "page_id int, class_id int, det_seq bigint, x0 double, y0 double, x1 double, y1 double, confidence double").cache()


def greedy_nms(rows, threshold=0.5):
    kept = []
    for r in sorted(rows, key=lambda r: (-r.confidence, r.det_seq)):
        for k in kept:
            w = max(0, min(k.x1, r.x1) - max(k.x0, r.x0))
            h = max(0, min(k.y1, r.y1) - max(k.y0, r.y0))
            union = (k.x1 - k.x0) * (k.y1 - k.y0) + (r.x1 - r.x0) * (r.y1 - r.y0) - w * h
            if union and w * h / union >= threshold:
                break
        else:
            kept.append(r)
    return {(r.page_id, r.det_seq) for r in kept}


def test_suppression(det):
    cols = ["page_id", "class_id", "det_seq", "keeper_seq"]
    folded = detect.assign_keepers(det).select(*cols)
    same(folded, detect.assign_keepers(det, max_group=40).select(*cols))
    want = set()
    for page in range(6):
        for c in range(2):
            want |= greedy_nms([r for r in det.collect() if r.page_id == page and r.class_id == c])
    assert {(r.page_id, r.det_seq) for r in folded.filter("det_seq = keeper_seq").collect()} == want


def test_suppression_is_idempotent(det):
    once = detect.nms(det)
    same(once, detect.nms(once).select(once.columns))


def test_area_suppression(det):
    boxes = det.select("page_id", F.col("det_seq").alias("id"), *box())
    same(detect.drop_covered(boxes, id_col="id").select("page_id", "id"), detect.drop_covered(boxes, id_col="id", max_group=20).select("page_id", "id"))


def test_matching(det):
    gt = det.filter("det_seq % 2 = 0").select("page_id", F.col("det_seq").alias("gt_seq"), "class_id", *box())
    pred = det.filter("det_seq % 7 <> 0").withColumn("x0", F.col("x0") + 1)
    a = evaluate.greedy_match(gt, pred)
    same(a, evaluate.greedy_match(gt, pred, max_group=5))
    assert a.groupBy("page_id", "gt_seq").count().filter("count > 1").isEmpty()
    assert a.groupBy("page_id", "pred_seq").count().filter("count > 1").isEmpty()


def test_association_partners_and_staves(spark, det):
    groups = det.filter("det_seq % 2 = 0").select("page_id", F.col("det_seq").alias("ng"), *box())
    cand = det.select("page_id", F.col("det_seq").alias("cand_seq"), F.lit("accent").alias("class_name"),
                      F.when(F.col("det_seq") % 2 == 0, "above").alias("side"), *box(), "confidence")
    staff = spark.createDataFrame([(p, s, 0.0, 300.0, 60.0 + 70 * s, 10.0) for p in range(6) for s in range(4)],
                                  "page_id int, staff_index bigint, left_x double, right_x double, center_y double, unit double")
    cols = ["cand_seq", "matched_ng", "association_cost", "association_reason"]
    base = associate.associate_symbols(cand, groups, staff).select(*cols)
    same(base, associate.associate_symbols(cand, groups, staff, max_partners=3).select(*cols))
    from scorelake.operators.staffs import staff_lookup
    same(base, associate.associate_symbols(cand, groups, staff_lookup(staff, max_staves=2)).select(*cols))


def test_row_order_does_not_matter(spark, det):
    shuffled = det.orderBy(F.rand(3)).repartition(5)
    same(detect.assign_keepers(det).select("page_id", "det_seq", "keeper_seq"), detect.assign_keepers(shuffled).select("page_id", "det_seq", "keeper_seq"))


def test_box_clusters_of_a_large_page(spark):
    pts = [(0, float(x), float(y), float(x + 4), float(y + 4)) for x in (0, 6, 200, 206, 500) for y in (0, 5, 300)]
    df = spark.createDataFrame(pts, "page_id int, x0 double, y0 double, x1 double, y1 double")
    same(clusters.merge_nearby(df, 20.0), clusters.merge_nearby(df, 20.0, max_group=3))
    assert clusters.merge_nearby(df, 20.0).count() == 6


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i != 20] + [(100, 101)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 200]], "id bigint")
    got = {r.id: r.label for r in connected_components(nodes, df).collect()}
    assert got == {i: (0 if i <= 20 else 21) for i in range(41)} | {100: 100, 101: 100, 200: 200}


def test_lowest_n_is_exact(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, "a").otherwise("b").alias("split"), "id")
    df = df.withColumn("hash", ranking.hash_rank_key("id", seed=1))
    quota = spark.createDataFrame([("a", 333), ("b", 7)], "split string, q bigint")
    got = ranking.lowest_n(df, keys=["split"], hash_col="hash", quota=quota, quota_col="q", prefix=1).collect()
    rows = df.collect()
    for split, n in (("a", 333), ("b", 7)):
        want = sorted((r.hash, r.id) for r in rows if r.split == split)[:n]
        assert sorted((r.hash, r.id) for r in got if r.split == split) == want


def test_summary_of_a_hot_key(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=900) * 50, np.full(300, 7.25), [-3.0]])
    df = spark.createDataFrame([("hot", float(v)) for v in values] + [("one", 4.0)], "k string, v double")
    got = {r.k: r for r in ranking.summarize(df, keys=["k"], value="v").collect()}
    for name, q in (("p25", 25), ("median", 50), ("p75", 75), ("p95", 95)):
        assert abs(got["hot"][name] - np.percentile(values, q)) < 1e-9
        assert got["one"][name] == 4.0
    assert got["hot"]["count"] == len(values)


def test_running_aggregates_in_segments(spark):
    rows = [("a", i, (i * 7) % 11, None if i % 3 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, pos bigint, v bigint, mark bigint").withColumn("seg", F.floor(F.col("pos") / 16))
    out = prefix.running(df, keys=["k"], segment="seg", order=["pos"], how="sum", value="v", name="s")
    out = prefix.running(out, keys=["k"], segment="seg", order=["pos"], how="max", value="v", name="m", inclusive=False)
    out = prefix.carry_last(out, keys=["k"], segment="seg", order=["pos"], columns=["mark"])
    for r in out.collect():
        past = [x for x in rows if x[1] <= r.pos]
        assert r.s == sum(x[2] for x in past)
        assert r.m == max((x[2] for x in past if x[1] < r.pos), default=None)
        assert r.mark_filled == max(x[3] for x in past if x[3] is not None)


def test_matching_of_copies(det):
    gt = det.filter("det_seq % 2 = 0").select("page_id", F.col("det_seq").alias("gt_seq"), "class_id", *box())
    gt = gt.withColumn("class_id", F.lit(0))
    pred = det.withColumn("class_id", F.lit(0)).withColumn("x1", F.col("x1") + F.col("det_seq") % 2)
    same(evaluate.greedy_match(gt, pred), evaluate.greedy_match(gt, pred, max_copies=20))
