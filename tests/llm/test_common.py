import random

import pytest

from scorelake.llm.common import components


@pytest.mark.parametrize("kind", ["chain", "shuffled chain", "stars", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(kind)
    names = list(range(60))
    if kind == "shuffled chain":
        rng.shuffle(names)
    edges = {"chain": [(i, i + 1) for i in range(59) if i != 30], "shuffled chain": [(names[i], names[i + 1]) for i in range(59) if i % 20],
             "stars": [(i, i % 4) for i in range(4, 60)] + [(1, 3)], "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(40)], "none": []}[kind]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {v: root(v) for v in parent}
