import random

import numpy as np
from pyspark.sql import functions as F

from scorelake.llm import toxic

SMALL = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxic.train(docs, labels)
    got = toxic.score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    insult = docs.filter(F.col("text").rlike("(?i)idiot|moron|scum|worthless|pathetic|loser|clown|trash")).select("doc_id").collect()
    insult = {r["doc_id"] for r in insult}
    known = [r for r in got if r["toxic"] == (r["doc_id"] in insult)]  # the rest of the labels is noise at this scale
    good = [r for r in known if r["predicted"] == r["toxic"]]
    assert len(known) > 50 and len(good) / len(known) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    rng = random.Random(2)
    clean = [r["text"] for r in docs.join(labels.filter("toxic = 0"), "doc_id").select("text").collect() if len(r["text"]) < 2000]
    odd = {"id-iot", "m.o.r.o.n", "s c u m", "wor*thless", "PATHETIC", "tra sh trash", "idiiot", "l*o*s*e*r"}
    numbers = model.lookup()
    slope = lambda t: 1 / (1 + np.exp(-(min(toxic.margins([t], model, numbers)[0], toxic.CEILING) * model.slope + model.shift)))
    for word in odd:
        at = rng.choice(clean).split(" ")
        at.insert(len(at) // 2, word)
        assert slope(" ".join(at)) >= toxic.THRESHOLD, word


def test_margin_is_the_kernel_machine(spark):
    """The folded table gives the same as summing the explicit features of each stretch."""
    rng = np.random.default_rng(0)
    letters = "abcdefgh"
    table = np.zeros((toxic.LETTERS + 1) ** 3, dtype=np.float32)
    numbers = toxic.letter_numbers(letters)
    codes = [int((a * (toxic.LETTERS + 1) + b) * (toxic.LETTERS + 1) + c) for a in range(1, 9) for b in range(1, 9) for c in range(1, 9)]
    table[codes] = rng.normal(size=len(codes))
    model = toxic.Model(letters, table, 0.25, 1.0, 0.0)
    words = ["".join(rng.choice(list(letters + "xy"), n)) for n in (1, 2, 3, 7, 12, 30)]
    want = 0.25 + max(sum(v * table[c] for c, v in toxic.triples([w[i:]], numbers)[0].items()) for w in words for i in range(len(w)))
    assert abs(toxic.margins([" ".join(words)], model, numbers)[0] - want) < 1e-4
    assert toxic.margins(["", " \n"], model, numbers).tolist() == [toxic.NOTHING] * 2


def test_awkward_tables(awkward, nothing, spark):
    labels = awkward.select("doc_id", F.expr("int(doc_id % 2)").alias("toxic"), F.lit(1).alias("quality"))
    got = toxic.score_toxicity(awkward, labels)
    assert got.count() == awkward.count() and got.filter("score is null or held_out is null").count() == 0
    stay = toxic.drop_toxic(awkward, labels)
    assert stay.columns == awkward.columns
    assert toxic.score_toxicity(nothing, labels.limit(0)).collect() == []
    assert toxic.drop_toxic(awkward, labels.limit(0)).count() == awkward.count()


def test_weak_words_add_up(spark):
    """Beginnings that clean texts of a language have now and then, toxic ones several times; held-out documents of all labels count."""
    rng = random.Random(3)
    syllables = ["ach", "lich", "keit", "ung", "ver", "ge", "ein", "au", "pf", "te", "zu", "sch"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    rows = []
    for i in range(600):
        text, bad = [word() for _ in range(120)], i % 6 == 0
        for _ in range(rng.randint(4, 8) if bad else rng.random() < 0.2):
            text.insert(rng.randrange(len(text)), "brumwex" + word())
        rows.append((i, " ".join(text), "de", int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(4)
    got = toxic.score_toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic")).join(docs, "doc_id").filter("held_out").collect()
    found = sum(r["toxic"] * r["predicted"] for r in got)
    assert found >= 0.9 * sum(r["toxic"] for r in got) > 10
    assert found >= 0.9 * sum(r["predicted"] for r in got)
    stay = {r["doc_id"] for r in toxic.drop_toxic(docs, docs.select("doc_id", "toxic")).collect()}
    assert stay == {r["doc_id"] for r in toxic.score_toxicity(docs, docs.select("doc_id", "toxic")).filter("predicted = 0").collect()}
