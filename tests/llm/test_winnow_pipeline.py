import re

import pytest

from scorelake.llm import exact, near, toxic, winnow


def brute_lines(rows, hashes, gram, window):
    """The rule on plain lists; `hashes` gives the operator's hash of a gram, which orders the windows."""
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    filled = [[(line.strip(winnow.BLANKS), i) for i, line in enumerate((r["text"] or "").split("\n")) if line.strip(winnow.BLANKS)] for r in rows]
    texts = [[t for t, _ in f] for f in filled]
    first, marks = {}, []
    for d, t in enumerate(texts):
        grams = [tuple(t[i:i + gram]) for i in range(len(t) - gram + 1)]
        places = {min(range(a, min(a + window, len(grams))), key=lambda i: (hashes[grams[i]], -i)) for a in range(max(len(grams) - window, 0) + 1)} if grams else set()
        for p in sorted(places):
            first.setdefault(grams[p], (d, p))
            marks.append((d, p, grams[p]))
    out = [set() for _ in rows]
    for d, p, g in marks:
        s, q = first[g]
        if (s, q) == (d, p):
            continue
        a, b = texts[d], texts[s]
        same = [0 <= i - p + q < len(b) and a[i] == b[i - p + q] for i in range(len(a))]
        for i in range(len(a) - gram + 1):
            if all(same[i:i + gram]):
                out[d] |= {filled[d][k][1] for k in range(i, i + gram)}
    return [(str(r["doc_id"]), sorted(o)) for r, o in zip(rows, out)]


@pytest.mark.parametrize(("gram", "window"), [(2, 2), (3, 4), (1, 1)])
def test_lines_are_brute_force(spark, documents, awkward, gram, window):
    from pyspark.sql import functions as F

    passage = "first line\nsecond line \n\n third line\nfourth line"
    made = [(1, f"x1\nx2\n{passage}\ny"), (2, f"{passage}\nz\n{passage}"), (3, "second line\nthird line"), (4, None), (5, "first line\nother"), (6, "\n\n"),
            (7, "a\na\na\na\na"), (8, "a\na\nb")]
    made = spark.createDataFrame(made, "doc_id long, text string")
    for docs in (made, documents, awkward.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = docs.select("doc_id", "text").collect()
        grams = set()
        for r in rows:
            t = [x.strip(winnow.BLANKS) for x in (r["text"] or "").split("\n") if x.strip(winnow.BLANKS)]
            grams |= {tuple(t[i:i + gram]) for i in range(len(t) - gram + 1)}
        table = spark.createDataFrame([(list(g),) for g in grams], "g array<string>")
        hashes = {tuple(r["g"]): r["h"] for r in table.select("g", F.xxhash64(F.transform("g", lambda x: F.xxhash64(x))).alias("h")).collect()}
        got = {str(r["doc_id"]): r for r in winnow.without_repeats(docs, gram=gram, window=window).collect()}
        for (doc, removed), r in zip(brute_lines(rows, hashes, gram, window), sorted(rows, key=lambda r: r["doc_id"])):
            assert sorted(got[doc]["removed"]) == removed
            kept = [x for i, x in enumerate((r["text"] or "").split("\n")) if i not in set(removed)]
            assert (got[doc]["text"] or "") == "\n".join(kept)


def test_lines_against_all_earlier_places(spark, documents, awkward):
    """Every run of two lines and every long line that any earlier place has, not only the first place of a fingerprint."""
    far = "a long line " * 10
    made = [(1, "g1\ng2"), (2, f"u\nx\ng1\ng2\ny\n{far}"), (3, f"v\nx\ng1\ng2\ny\nw\n{far}\nu"), (4, far), (5, "u"), (6, "x\ng1\nq\ng2\ny"), (7, f" {far}\n\nu\nv")]
    made = spark.createDataFrame(made, "doc_id long, text string")
    for docs in (made, documents, awkward.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
        seen, want = set(), {}
        for r in rows:
            lines = [(i, x.strip(winnow.BLANKS)) for i, x in enumerate((r["text"] or "").split("\n")) if x.strip(winnow.BLANKS)]
            out = set()
            for units in ([[a, b] for a, b in zip(lines, lines[1:])] + [[a] for a in lines if len(a[1]) >= winnow.LONG]):
                key = tuple(x for _, x in units)
                out |= {i for i, _ in units} if key in seen else set()
                seen.add(key)
            want[r["doc_id"]] = sorted(out)
        got = {r["doc_id"]: sorted(r["removed"]) for r in winnow.without_repeats(docs, long=winnow.LONG).collect()}
        assert got == want


def test_lines_of_awkward_tables(awkward, nothing):
    assert winnow.without_repeats(awkward).count() == awkward.count()
    assert winnow.without_repeats(nothing).collect() == []


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage, rows = docs, {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        stage = step(spark, stage, sf)
        assert stage.schema == docs.schema or stage.columns == docs.columns
        rows[name] = {r["doc_id"] for r in stage.collect()}
    model = toxic.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert rows["toxicity"] == {r["doc_id"] for r in toxic.score(docs, model).filter("predicted = 0").collect()}
    texts = {r["doc_id"]: re.sub(exact.WHITE, "", r["text"]) for r in docs.collect()}
    assert len({texts[i] for i in rows["exact dedup"]}) == len(rows["exact dedup"]) == len({texts[i] for i in rows["toxicity"]})
    left = near.near_duplicates(docs.filter(docs["doc_id"].isin(sorted(rows["exact dedup"]))), words=5).filter("kept").collect()
    assert rows["MinHash near-dedup"] == {r["doc_id"] for r in left}
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == rows["MinHash near-dedup"]


def test_stages_on_awkward_tables(awkward, nothing):
    import corpus_pipeline

    spark = awkward.sparkSession
    for docs in (awkward, nothing):
        stage = docs
        for _, step in corpus_pipeline.STAGES:
            stage = step(spark, stage, "/root/testdata/sf0.001")
        assert bool(stage.count()) == bool(docs.count())
