import hashlib

import pytest
from pyspark.sql import functions as F

from scorelake.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return h(*[field(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def climb(nodes, at):
    """Root of `nodes`, and the runs that lead to it from place `at`."""
    path = []
    while len(nodes) > 1:
        a = at - at % 3
        path.append((at - a, nodes[a:a + 3]))
        nodes, at = [h(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)], at // 3
    return nodes[0], path


def brute(rows, change):
    sources = {}
    for r in rows:
        sources.setdefault((r["source"] is not None, (r["source"] or "").encode()), []).append(r)
    keys = sorted(sources)
    groups = {k: sorted(v, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))) for k, v in sources.items()}
    leaves = {k: [leaf(r, r["text"]) for r in v] for k, v in groups.items()}
    tops = [climb(leaves[k], 0)[0] for k in keys]
    out = []
    for j, k in enumerate(keys):
        root, above = climb(tops, j)
        for i, r in enumerate(groups[k]):
            path = climb(leaves[k], i)[1] + above
            folded = leaf(r, change(r))
            for at, run in path:
                folded = h(*run[:at], folded, *run[at + 1:])
            proof = [s for at, run in path for n, s in enumerate(run) if n != at]
            out.append((str(r["doc_id"]), leaves[k][i], tops[j], root, proof, folded, folded == root))
    return sorted(out)


def got(docs, **kw):
    names = ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    return sorted((str(r["doc_id"]), *[r[n] for n in names[1:]]) for r in manifest.manifest(docs, **kw).collect())


@pytest.mark.parametrize("height", [1, 2])
@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_small_blocks_and_many_rounds_are_brute_force(request, which, height):
    """Blocks of 3 and 9 leaves, so that the exchange runs several rounds with short last subtrees."""
    docs = request.getfixturevalue(which)
    want = brute(docs.collect(), lambda r: r["text"] and r["text"].replace("\n", ""))
    assert got(docs, claimed=F.replace("text", F.lit("\n"), F.lit("")), height=height) == want


@pytest.mark.parametrize("n", [1, 4, 28, 100])
def test_every_width_of_one_source(spark, n):
    rows = [(i, "a", "en", 1, f"text {i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    want = brute(docs.collect(), lambda r: r["text"])
    assert got(docs, height=1) == want and all(r[-1] for r in want)


def test_many_sources_nulls_first_and_clashing_columns(spark):
    names = [None, "", "n", "v", "é", "\U0001f600", "z", *[f"s{i}" for i in range(30)]]
    rows = [(i, s, None, None, None, "x", 7, "y") for i, s in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, tree string, block int, path string")
    assert got(docs, height=1) == brute(docs.collect(), lambda r: r["text"])


def test_one_id_for_all_rows_and_no_rows(spark, nothing):
    rows = [(1, "a", "en", 1, "same" if i % 3 else f"t{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert got(docs) == brute(docs.collect(), lambda r: r["text"])
    assert got(nothing) == []
