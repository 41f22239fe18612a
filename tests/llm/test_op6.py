import re
from html import unescape

import duckdb
import numpy as np

from manyfold.llm import op6_html as op
from manyfold.llm.dom import blocks_of, parse

SCHEMA = "page_id long, url string, html string, text string, n_chars string"
PAGE = """<!DOCTYPE html><html><head><title>t &lt; x</title><style>p{}</style><script>var a="</p></head>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Title of  it</h1><p>First &amp; &eacute;<b>bold</b> text, with many words in it.<br>Second line goes on here.<p>Unclosed paragraph that ends here.
<ul><li>one thing to say</li><li>another thing to say</li></ul></article>
<div class="comments"><h2>Comments</h2><div class="comment"><p>Reader says something.</p></div></div><form><p>Subscribe</p><button>ok</button></form><footer>&copy; Site</footer></body></html>"""
TEXT = "Title of it\nFirst & ébold text, with many words in it. Second line goes on here.\nUnclosed paragraph that ends here.\none thing to say\nanother thing to say"


def test_a_page(spark):
    rows = [(1, "u", PAGE, "x", "y"), (2, None, None, None, None), (3, "", "", "", ""), (None, "u", PAGE, "", ""), (1, "u", PAGE, "x", "y"), (4, "u", "<nav><a href=x>" + "<div>" * 5000, "", ""), (5, "u", PAGE.replace("First", "First " + "word " * 200_000), "", "")]
    got = op.extract(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 7 and by[1].text == by[None].text == TEXT and by[1].n_chars == len(TEXT)
    assert by[2].text == by[3].text == by[4].text == "" and by[2].n_chars == 0 and by[2].url is None
    assert by[5].n_chars == len(TEXT) + 5 * 200_000


def test_held_out_pages():
    model = op.train()
    wrong = total = 0
    for html, labels in op.composed(150, seed=77):
        nodes = parse(html)
        kept = op.decode(nodes, model.margin(op.features(nodes)))
        wrong += sum(a != b for a, b in zip(kept, labels, strict=True))
        total += len(labels)
    assert wrong / total < 0.01


def test_all_sample_pages(spark):
    """Held against a reading of the pages by their one known layout."""
    pages = dict(duckdb.sql("select page_id, html from '/root/testdata/sf0.01/pages.parquet'").fetchall())
    got = {r.page_id: r.text for r in op.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    for page, html in pages.items():
        inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert got[page] == "\n".join(b for b in blocks if b)


def test_decoding_is_consistent_and_best():
    rng = np.random.default_rng(0)
    for seed in range(40):
        html, _ = op.composed(1, seed)[0]
        nodes = parse(html)[:9]
        ids = {id(x): i for i, x in enumerate(nodes)}
        up = [ids[id(x.parent)] if x.parent else -1 for x in nodes]
        margin = rng.normal(0, 2, len(nodes))
        kept = op.decode(nodes, margin)

        def score(labels, margin=margin):
            return sum(-np.logaddexp(0, -m if k else m) for k, m in zip(labels, margin, strict=True))

        def allowed(labels, up=up, n=len(nodes)):
            """No article below an element that left the article or has article above it and is none."""
            for i in range(n):
                j, left = up[i], False
                while labels[i] and j >= 0:
                    left |= not labels[j]
                    if left and labels[j]:
                        return False
                    j = up[j]
            return True

        best = max((tuple(bool(b >> i & 1) for i in range(len(nodes))) for b in range(2 ** len(nodes))), key=lambda c: score(c) if allowed(c) else -np.inf)
        assert allowed(kept) and abs(score(kept) - score(best)) < 1e-9


def test_parser_repairs():
    nodes = parse("a < b <p>x<p>y</div><table><tr><td>1<td>2</table><!-- <p>no --><li>z")
    assert blocks_of(nodes, [True] * len(nodes)) == ["a < b", "x", "y", "1", "2", "z"]
    assert blocks_of(parse("<p>cut &am"), [True] * 2) == ["cut &am"]


def test_empty(spark):
    assert op.extract(spark.createDataFrame([], SCHEMA)).count() == 0
