"""Main-text extraction: gradient-boosted trees over DOM-node features, decoded along the page's hierarchy.

Every block element of a page gets features: what it is, its depth, the text, link and markup density of its subtree, words of
its class, id and role attributes and those of its nearest marked ancestor, and its place and share among its siblings.
Boosted regression trees (logistic loss, histogram splits) turn them into the chance that the element belongs to the
article.  Decoding then picks the likeliest labelling in which an element is either context of the article (above it),
article, or boilerplate; below boilerplate everything is boilerplate, and below article there is no context.  So no
ancestor and descendant contradict each other.

The trees are trained on the driver from pages that this module composes itself: many layouts, known labels, a fixed number
(PAGES) and seed.  They take a few seconds and a few hundred kB, whatever the table's size, and are then broadcast.

Defined cases: a null or empty page has an empty text; a page without markup is one block and judged like any other; cut-off
and wrongly nested markup is repaired the way browsers do; very long and very deep pages are read whole; repeated rows are
judged one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyfold.llm.dom import Node, blocks_of, parse

#: Attribute words that speak for and against the article; the trees decide what they are worth.
FOR = frozenset("article content post entry main story text body page blog prose copy paragraph column".split())
AGAINST = frozenset(
    "ad ads advert advertisement adverts aside author banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright dialog disclaimer disqus footer foot form gdpr header legal login masthead menu meta modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted recommended related reply respond search share sharing sidebar side social sponsor sponsored subscribe tags toolbar topbar widget".split()
)
KINDS = (("p", "pre", "blockquote"), ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), ("ul", "ol", "menu", "dl", "dir"), ("li", "dt", "dd"), ("table", "tbody", "thead", "tfoot", "tr", "td", "th"), ("article", "main"), ("nav",), ("footer",), ("header",), ("aside", "dialog"), ("form", "fieldset", "legend", "search"), ("html", "body"), ("figure", "figcaption", "details", "summary"))
KIND = {tag: k for k, tags in enumerate(KINDS) for tag in tags}
PAGES, TREES, DEPTH, BINS, RATE, SEED = 500, 60, 5, 32, 0.25, 11
NONE = len(KINDS)


def features(nodes: list[Node]) -> np.ndarray:
    """One row of features per node."""
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    own, linked, words = [0] * n, [0] * n, [0] * n
    below, kids = [0] * n, [0] * n
    up = [0] * n
    for i, x in enumerate(nodes):
        up[i] = place[id(x.parent)] if x.parent else 0
        text = "".join([t for t in x.items if t.__class__ is str]) if len(x.items) != 1 else x.items[0] if x.items[0].__class__ is str else ""
        own[i], linked[i], words[i] = len(text.strip()), x.linked, text.count(" ") + 1 if text.strip() else 0
        if i:
            kids[up[i]] += 1
    all_text, all_linked, all_words, paragraphs = own[:], linked[:], words[:], [x.tag == "p" and 1 or 0 for x in nodes]
    for i in range(n - 1, 0, -1):  # children stand after their parents
        u = up[i]
        all_text[u] += all_text[i]
        all_linked[u] += all_linked[i]
        all_words[u] += all_words[i]
        paragraphs[u] += paragraphs[i]
        below[u] += below[i] + 1
    seen = [0] * n
    rows = []
    total = all_text[0] + 1
    marks: list[tuple[int, int, int]] = [(NONE, 0, 0)] * n  # nearest ancestor that says something, and its words
    for i, x in enumerate(nodes):
        u = up[i]
        good = sum(t in FOR for t in x.attributes)
        bad = sum(t in AGAINST for t in x.attributes)
        kind = KIND.get(x.tag, NONE)
        telling = good or bad or 5 <= kind <= 10
        upper = marks[u] if i else (NONE, 0, 0)
        marks[i] = (kind, good, bad) if telling else upper
        index = seen[u] if i else 0
        if i:
            seen[u] += 1
        size, around = all_text[i], all_text[u] + 1
        rows.append(
            (
                kind, x.depth, good, bad, *upper, KIND.get(nodes[u].tag, NONE), size, all_linked[i] / (size + 1), size / (below[i] + 1), all_words[i], size / (all_words[i] + 1), below[i], kids[i], own[i], paragraphs[i],
                index, kids[u] - 1 - index, (index + 1) / (kids[u] + 1), size / around, size / total, all_linked[u] / around, paragraphs[u], i / n, len(x.attributes),
            )
        )
    return np.array(rows, np.float32)


@dataclass
class Boosted:
    """Complete binary trees in arrays: feature and cut of each inner node, value of each leaf."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Boosted:
    """Newton boosting of the logistic loss with histogram splits, level by level."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    start = float(np.log(share / (1 - share)))
    margin = np.full(n, start)
    inner = 2**DEPTH - 1
    model = Boosted(edges, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, 2**DEPTH)), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p) + 1e-6
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            local = at - first
            best = np.full(wide, 1e-3)
            pick_f, pick_b = np.zeros(wide, np.int64), np.full(wide, BINS, np.int64)
            for j in range(d):
                slot = local * BINS + binned[:, j]
                gs = np.bincount(slot, g, wide * BINS).reshape(wide, BINS).cumsum(1)
                hs = np.bincount(slot, h, wide * BINS).reshape(wide, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 2) | (ht - hs < 2)] = 0
                gain[:, len(edges[j]):] = 0
                top = gain.argmax(1)
                value = gain[np.arange(wide), top]
                better = value > best
                best[better], pick_f[better], pick_b[better] = value[better], j, top[better]
            model.feature[t, first:first + wide] = pick_f
            model.cut[t, first:first + wide] = [edges[f][b] if b < len(edges[f]) else np.inf for f, b in zip(pick_f, pick_b, strict=True)]
            at = 2 * at + 1 + (binned[np.arange(n), pick_f[local]] > pick_b[local])
        leaf = at - inner
        model.value[t] = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        margin += model.value[t][leaf]
    return model


def decode(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    """The likeliest consistent labelling; true for the nodes of the article."""
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    up = [place[id(x.parent)] if x.parent else 0 for x in nodes]
    margin = np.clip(margin, -30, 30)
    yes, no = (-np.logaddexp(0, -margin)).tolist(), (-np.logaddexp(0, margin)).tolist()
    article, boiler, context = yes[:], no[:], no[:]
    for i in range(n - 1, 0, -1):
        u = up[i]
        boiler[u] += boiler[i]
        article[u] += max(article[i], boiler[i])
        context[u] += max(article[i], boiler[i], context[i])
    kept, state = [False] * n, [""] * n
    for i in range(n):
        above = state[up[i]] if i else "context"
        if above == "boiler":
            state[i] = "boiler"
            continue
        ranked = [(article[i], "article"), (boiler[i], "boiler")] + ([(context[i], "context")] if above == "context" else [])
        state[i] = max(ranked)[1]
        kept[i] = state[i] == "article"
    return kept


def extract_batch(model: Boosted, pages: list[str | None]) -> list[str]:
    """Main texts of pages; the trees see the nodes of all pages of a batch at once."""
    parsed = [parse(p) if p else None for p in pages]
    made = [features(nodes) for nodes in parsed if nodes]
    margins = model.margin(np.concatenate(made)) if made else np.zeros(0)
    out, at = [], 0
    for nodes in parsed:
        if not nodes:
            out.append("")
            continue
        kept = decode(nodes, margins[at:at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(blocks_of(nodes, kept)))
    return out


# The pages to learn from.  A part of a page is (html, labels): the labels of its block elements in page order.


class _Composer:
    """Composes pages of many layouts with a label for every block element."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.out: list[str] = []
        self.labels: list[bool] = [False]  # the page itself

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice("bcdfghklmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(4, 14).capitalize() + self.rng.choice([".", ".", "!", "?"]) for _ in range(self.rng.randint(low, high)))

    def open(self, tag: str, label: bool, names: str = "") -> None:
        chosen = self.rng.choice(names.split()) if names else ""
        attribute = self.rng.choice([f' class="{chosen}"', f' id="{chosen}"', f' class="{chosen} x{self.rng.randint(1, 9)}"']) if chosen else ""
        self.out.append(f"<{tag}{attribute}>")
        self.labels.append(label)

    def element(self, tag: str, label: bool, text: str, names: str = "", close: bool = True) -> None:
        self.open(tag, label, names)
        self.out.append(text + (f"</{tag}>" if close else ""))

    def linked_list(self, label: bool, low: int = 2, high: int = 9, size: int = 2) -> None:
        tag = self.rng.choice(["ul", "ul", "ol"])
        self.open(tag, label)
        for _ in range(self.rng.randint(low, high)):
            text = self.words(1, size)
            self.element("li", label, f'<a href="/{text[:5]}">{text}</a>')
        self.out.append(f"</{tag}>")

    def boiler(self, kind: str) -> None:
        r = self.rng
        if kind == "nav":
            tag = r.choice(["nav", "nav", "div"])
            self.open(tag, False, "" if tag == "nav" and r.random() < 0.6 else "nav menu navbar navigation topbar breadcrumb")
            self.linked_list(False)
            self.out.append(f"</{tag}>")
        elif kind == "header":
            tag = r.choice(["header", "div"])
            self.open(tag, False, "" if tag == "header" and r.random() < 0.5 else "header masthead banner topbar")
            self.element(r.choice(["h1", "p", "div"]), False, self.words(1, 5))
            if r.random() < 0.5:
                self.boiler("nav")
            self.out.append(f"</{tag}>")
        elif kind == "footer":
            tag = r.choice(["footer", "footer", "div"])
            self.open(tag, False, "" if tag == "footer" and r.random() < 0.6 else "footer legal copyright foot")
            self.out.append("&copy; " + r.choice([self.words(1, 8), self.sentences(1, 5)]))
            if r.random() < 0.4:
                self.element("p", False, r.choice([self.words(1, 8), self.sentences(1, 3)]))
            if r.random() < 0.3:
                self.linked_list(False)
            self.out.append(f"</{tag}>")
        elif kind in ("ad", "notice"):
            tag = r.choice(["div", "div", "section", "aside", "p"])
            self.open(tag, False, "ad ads advert banner sponsored promo advertisement" if kind == "ad" else "cookie notice consent newsletter popup disclaimer subscribe gdpr notification")
            self.out.append(r.choice([self.words(1, 12), self.sentences(1, 6), self.sentences(1, 3)]))
            if tag != "p" and r.random() < 0.3:
                self.element("p", False, self.sentences(1, 3))
            self.out.append(f"</{tag}>")
        elif kind == "side":
            tag = r.choice(["aside", "aside", "div"])
            self.open(tag, False, "" if tag == "aside" and r.random() < 0.5 else "sidebar related widget side recommended")
            self.element(r.choice(["h2", "h3", "h4"]), False, self.words(1, 4))
            if r.random() < 0.6:
                self.linked_list(False, size=7)
            else:
                self.element("p", False, self.sentences(1, 4))
            self.out.append(f"</{tag}>")
        elif kind == "form":
            self.open("form", False, r.choice(["", "search login newsletter subscribe"]))
            self.out.append(self.words(1, 3) + "<input name=q><select><option>x</select><button>ok</button>")
            if r.random() < 0.4:
                self.element("p", False, self.sentences(1, 2))
            self.out.append("</form>")
        elif kind == "share":
            self.open("div", False, "share social sharing tags author byline meta")
            self.out.append(self.words(1, 6))
            if r.random() < 0.5:
                self.linked_list(False)
            self.out.append("</div>")
        else:
            tag = r.choice(["section", "div", "div"])
            self.open(tag, False, "comments comment disqus respond")
            self.element(r.choice(["h2", "h3"]), False, self.words(1, 3))
            for _ in range(r.randint(1, 6)):
                self.open("div", False, "comment reply")
                self.element("p", False, self.sentences(1, 6))
                self.out.append("</div>")
            self.out.append(f"</{tag}>")

    def article(self) -> None:
        r = self.rng
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        self.open(tag, True, "" if tag in ("article", "main") and r.random() < 0.7 else "article content post entry main story text body")
        inner = r.random() < 0.25
        if inner:
            self.open("div", True, r.choice(["", "content entry text body prose"]))
        if r.random() < 0.85:
            self.element("h1", True, self.words(1, 12), close=r.random() < 0.95)
        long = r.random() < 0.8
        for k in range(r.choice([0, 1, 1, 2, 3, 5, 8, 20, 60]) if r.random() < 0.97 else 150):
            x = r.random()
            if x < 0.8 or k == 0:
                text = self.sentences(1, 9) if long else self.words(1, 7)
                if r.random() < 0.15:
                    text = "<b>" + text + r.choice(["</b>", "<br>", ""])
                if r.random() < 0.1:
                    text += f' <a href="/x">{self.words(1, 3)}</a> ' + self.words(1, 4)
                self.element("p", True, text, close=r.random() < 0.85)
            elif x < 0.88:
                self.element(r.choice(["h2", "h3"]), True, self.words(1, 7))
            elif x < 0.93:
                self.open(r.choice(["ul", "ol"]), True)
                for _ in range(r.randint(2, 6)):
                    self.element("li", True, self.sentences(1, 2) if r.random() < 0.6 else self.words(1, 5))
                self.out.append("</ul></ol>")
            elif x < 0.96:
                self.element(r.choice(["blockquote", "pre"]), True, self.sentences(1, 4))
            elif x < 0.98:
                self.open("table", True)
                for _ in range(r.randint(1, 4)):
                    self.open("tr", True)
                    self.element("td", True, self.words(1, 3))
                    self.element("td", True, self.words(1, 3))
                    self.out.append("</tr>")
                self.out.append("</table>")
            else:
                self.boiler(r.choice(["ad", "share", "side", "notice"]))
        if inner:
            self.out.append("</div>")
        self.out.append(f"</{tag}>")

    def page(self) -> tuple[str, list[bool]]:
        r = self.rng
        self.out.append("<!DOCTYPE html><html><head><title>x</title></head>")
        self.open("body", False)
        wrapped = r.random() < 0.4
        if wrapped:
            self.open("div", False, r.choice(["", "page wrapper container layout"]))
        for kind, chance in (("header", 0.5), ("nav", 0.8), ("notice", 0.25), ("form", 0.2), ("side", 0.2), ("ad", 0.5)):
            if r.random() < chance:
                self.boiler(kind)
        holder = r.random() < 0.25
        if holder:
            self.open(r.choice(["div", "main"]), False, r.choice(["", "main container row"]))
        if r.random() < 0.96:
            self.article()
        for kind, chance in (("share", 0.2), ("comments", 0.3), ("side", 0.3), ("ad", 0.3), ("form", 0.15)):
            if r.random() < chance:
                self.boiler(kind)
        if holder:
            self.out.append("</div></main>")
        if r.random() < 0.85:
            self.boiler("footer")
        if r.random() < 0.2:
            self.boiler("notice")
        if wrapped:
            self.out.append("</div>")
        return "".join(self.out) + "</body></html>", self.labels


def composed(pages: int, seed: int) -> list[tuple[str, list[bool]]]:
    """Pages with a label for each block element."""
    rng = random.Random(seed)
    return [_Composer(rng).page() for _ in range(pages)]


_trained: dict[tuple[int, int], Boosted] = {}


def train(pages: int = PAGES, seed: int = SEED) -> Boosted:
    """Trees fitted to composed pages; kept for the session, as they depend on nothing else."""
    if (pages, seed) not in _trained:
        x, y = [], []
        for html, labels in composed(pages, seed):
            nodes = parse(html)
            if len(nodes) != len(labels):
                raise AssertionError("a composed page was read differently")
            x.append(features(nodes))
            y += labels
        _trained[pages, seed] = boost(np.concatenate(x), np.array(y, float))
    return _trained[pages, seed]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Return ``(<id_col>, <url_col>, text, n_chars)`` for every row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(train())

    @F.arrow_udf("string")
    def main_text(html: pa.Array) -> pa.Array:
        out: list[str] = []
        for at in range(0, len(html), 64):
            out += extract_batch(shared.value, html.slice(at, 64).to_pylist())
        return pa.array(out, pa.string())

    # nondeterministic: else the two uses of the text would each run it
    found = pages.select(F.col(id_col), F.col(url_col), main_text.asNondeterministic()(F.col(html_col)).alias("text"))
    return found.select(id_col, url_col, "text", F.length("text").cast("long").alias("n_chars"))
