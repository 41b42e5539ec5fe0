import random
from collections import Counter

import pytest


def test_coverage_subset_shows_every_class(spark):
    from scorelake.plans import queries_dataset

    sf = "/root/testdata/sf0.001"
    classes = {r["class_id"] for r in queries_dataset.assigned(spark, sf).select("class_id").distinct().collect()}
    rows = queries_dataset.subset_coverage(spark, sf).collect()
    shown = Counter(c for r in rows for c in {int(c) for c in r["class_ids"].split(",") if c})
    assert len(classes) == 40 and set(shown) == classes and min(shown.values()) >= 2
    assert len({r["tile_id"] for r in rows}) == len(rows) and sum(r["is_negative"] for r in rows) <= 5


@pytest.mark.parametrize("keep", [1, 3, 64])
def test_subset_is_the_plain_choice_in_few_jobs(spark, keep):
    """the tiles of all classes are ranked in one pass, not in a job per class; lists that run out ask the whole table."""
    from scorelake.operators.ranking import hash_rank_key
    from scorelake.operators.stats import select_subset

    rng = random.Random(27)
    kinds = [rng.randrange(12) for _ in range(60)]
    shown = [sorted(rng.sample(range(60), rng.choice([0, 1, 3, 6]))) for _ in range(80)]
    rows = [(f"t{i}", [f"a{a}" for a in ids], [kinds[a] for a in ids], rng.randrange(2), rng.random() < 0.3, not ids) for i, ids in enumerate(shown)]
    tiles = spark.createDataFrame(rows, "tile_id string, annotation_ids array<string>, class_ids array<long>, n_clipped int, padded boolean, is_negative boolean")
    spark.sparkContext.setJobGroup(f"subset-{keep}", "")
    try:
        got = {r["tile_id"] for r in select_subset(tiles, class_count=12, per_class=2, total=28, negatives=3, seed=5, keep=keep).collect()}
    finally:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"subset-{keep}"))
        spark.sparkContext._jsc.clearJobGroup()
    h = {r["tile_id"]: r["h"] for r in tiles.select("tile_id", hash_rank_key("tile_id", seed=5).alias("h")).collect()}
    chosen, seen = [], set()
    for c in [*range(12), None]:
        pool = [r for r in rows if not r[5] and r[0] not in chosen and (c is None or c in r[2])]
        pool.sort(key=lambda r: (len(seen & set(r[1])), r[3] > 0, r[4], 0 if c is None else abs(r[2].count(c) - 3), len(r[1]), h[r[0]]))
        for r in pool[:28 - len(chosen) if c is None else 2]:
            chosen.append(r[0])
            seen |= set(r[1])
    empty = sorted((r for r in rows if r[5]), key=lambda r: h[r[0]])
    clear = [r for r in empty if not r[4]]
    assert got == set(chosen) | {r[0] for r in (clear if len(clear) >= 3 else empty)[:3]}
    assert keep < 64 or jobs < 12
