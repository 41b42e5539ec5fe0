import re
from collections import Counter

import pytest

from scorelake.llm import phrases


def pieces_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def counts_of(rows, longest):
    f, n = Counter(), Counter()
    for r in rows:
        lang = r["lang"] if r["lang"] is not None else "und"
        for ws in pieces_of(r["text"]):
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                f.update((lang, tuple(ws[i:i + m])) for i in range(len(ws) - m + 1))
    return f, +n


def brute(rows, longest, least, cover, top):
    f, n = counts_of(rows, longest)
    out = []
    for lang in n:
        found = []
        some = {p: a for (l, p), a in f.items() if l == lang and a >= least and len(p) > 1}
        longer = Counter()
        for q, b in some.items():
            for i in range(len(q)):
                for j in range(i + 2, len(q) + 1):
                    if j - i < len(q):
                        longer[q[i:j]] = max(longer[q[i:j]], b)
        for p, a in some.items():
            if longer[p] and 100 * longer[p] >= cover * a:
                continue
            cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def got(docs, *args):
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r[x] for x in names) for r in phrases.collocations(docs, *args).collect())


@pytest.mark.parametrize("args", [(3, 3, 50, 2000), (2, 2, 50, 20), (4, 2, 70, 2000)])
@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_brute_force(request, which, args):
    docs = request.getfixturevalue(which)
    assert got(docs, *args) == brute(docs.collect(), *args)


def test_counts_of_all_lengths(documents):
    f, n = counts_of(documents.collect(), 3)
    p, totals = phrases.phrase_counts(documents, 3, 1)
    assert {(r["lang"], r["phrase"]): r["f"] for r in p.collect()} == {(lang, " ".join(ws)): a for (lang, ws), a in f.items()}
    assert {r["lang"]: r["n"] for r in totals.collect()} == dict(n)


def test_chunks_salts_and_frequent_words(documents, monkeypatch):
    """Chunks of one batch, ranks cut per salt, and both ways of looking up a part give the same rows."""
    monkeypatch.setattr(phrases, "CHUNK", 1)
    assert got(documents, 3, 3, 50, 30) == brute(documents.collect(), 3, 3, 50, 30)


def test_separators_overlaps_and_odd_languages(spark, nothing):
    rows = [("a a a a. A\ta,a", "x\ny"), ("b  c\x0bb c\x0cb c!b c", None), ("b c", ""), ("", "z"), (None, "z"), (" . , ", "z"), ("é É b c\rÉ é", None)] * 4
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert got(docs, 3, 2, 50, 2000) == brute(docs.collect(), 3, 2, 50, 2000)
    assert got(nothing, 3, 2, 50, 2000) == []


def test_products_beyond_64_bits(spark, monkeypatch):
    """The expressions of the score on counts near 10 ** 12."""
    row = spark.sql("SELECT cast(1000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) * cast(a as decimal(19, 0)) div "
                    "(cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) AS score FROM VALUES (999999999999, 1000000000001, 1000000000007) AS t(a, l, r)").first()
    assert row["score"] == 1000000 * 999999999999 ** 2 // (1000000000001 * 1000000000007)
