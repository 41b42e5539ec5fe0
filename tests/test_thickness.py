"""Beam thickness classes against every possible split."""

import random
from itertools import combinations

from scorelake.operators import clusters


def classes(values, unit):
    """The rule in plain Python: limits, parts given up, then the best of all splits."""
    limits = [1, *(int(unit * x) for x in clusters.THICKNESS_UNITS)]
    used = min(len(limits), sum(x <= max(values) for x in limits) + 1)
    floor, clip = max(len(values) // 100, 5), None
    while used and sum(limits[used - 1] <= v and (clip is None or v < clip) for v in values) < floor:
        used -= 1
        clip = limits[used]
    values = [v if clip is None else min(v, clip) for v in values]
    found = sorted(set(values))
    k = min(used + 1, len(found))

    def error(low, high):
        run = [v for v in values if found[low] <= v <= found[high - 1]]
        return sum(v * v for v in run) - sum(run) ** 2 / len(run)

    best = min(combinations(range(1, len(found)), k - 1), key=lambda cut: round(sum(error(a, b) for a, b in zip((0, *cut), (*cut, len(found)))), 6))
    return [sum(v >= found[c] for c in best) for v in values]


def test_the_best_of_all_splits(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for page in range(25):
        unit = rng.choice([10, 16, 20])
        kinds = rng.sample([0, unit, 2 * unit, 3 * unit, 5 * unit], rng.randint(1, 4))
        values = [max(0, rng.choice(kinds) + rng.randint(-1, 1)) for _ in range(rng.choice([1, 6, 60, 300]))] + [9 * unit] * rng.randint(0, 3)
        rows += [(page, i, v, unit) for i, v in enumerate(values)]
        want |= {(page, i): c for i, c in enumerate(classes(values, unit))}
    beams = spark.createDataFrame(rows, "page_id int, beam_id int, thickness int, unit int")
    got = {(r["page_id"], r["beam_id"]): r["thickness_class"] for r in clusters.thickness_classes(beams).collect()}
    assert got == want
