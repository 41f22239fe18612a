"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Vectors of one label are compared by cosine, that is by the distance of unit vectors.  Equal vectors form a class first,
so copies cost nothing.  The classes of a label are dealt into blocks of about ``BLOCK`` rows, in the order of a projection;
each block becomes a cover tree: nested levels whose radii halve, every node within its level's radius of its parent.
Blocks are traversed in pairs: a pair of nodes is pruned when the distance of the centres less both covering radii
exceeds the threshold's, and taken whole when the sum stays below it.  Single pairs are decided by the cosine in double
precision.  Blocks whose projections lie further apart than the threshold never meet (a projection shortens distances).

A task holds two blocks, whatever share of the rows a label has, and returns for each class the number of rows linked to it
and a spanning forest of its links, never the pairs themselves.  Work is quadratic in a label's classes where vectors
are spread evenly over many dimensions, as no exact bound prunes those; clustered vectors are pruned.

Defined cases: a null label, and vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different length don't link; repeated ids are rows of their own; a null id keeps its row but names no
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyfold.operators.graph import connected_components
from manyfold.operators.storage import materialise

THRESHOLD = 0.98
BLOCK = 1024
#: Steps of the projection's distribution by which a label's rows are dealt into blocks; beyond, blocks are cut by hash.
STEPS = 256
#: Distances this near a bound are left to the exact decision.
SLACK = 1e-6


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class CoverTree:
    """Cover tree over unit vectors: ``centre``, covering ``radius``, ``kids`` and member ``rows`` of each node; 0 is the root."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        centre, radius, self.kids, self.rows = [], [], [], []
        todo = [(np.arange(len(unit)), 1, -1)]
        while todo:
            members, level, parent = todo.pop()
            node = len(centre)
            reach = float(_apart(unit[members], unit[members[:1]]).max()) if len(members) > 1 else 0.0
            centre.append(members[0])
            radius.append(reach)
            self.kids.append([])
            self.rows.append(members)
            if parent >= 0:
                self.kids[parent].append(node)
            if len(members) == 1:
                continue
            while level > -20 and 2.0**level >= reach:
                level -= 1
            if level == -20:  # equal directions
                todo += [(members[i:i + 1], level, node) for i in range(len(members))]
                continue
            left = members  # greedy net: centres more than 2 ** level apart, each row with the first centre near it
            while len(left):
                near = _apart(unit[left], unit[left[:1]])[:, 0] <= 2.0**level
                near[0] = True
                todo.append((left[near], level, node))
                left = left[~near]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.kids = [np.array(k if k else [i]) for i, k in enumerate(self.kids)]
        self.leaf = np.array([len(r) == 1 for r in self.rows])


class Links:
    """Per class the number of linked rows, and a spanning forest."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.counts = weights, np.zeros(len(weights), np.int64)
        self.parent, self.forest = np.arange(len(weights)), []

    def _roots(self, x: np.ndarray) -> np.ndarray:
        while (up := self.parent[self.parent[x]] != self.parent[x]).any():
            self.parent[x[up]] = self.parent[self.parent[x[up]]]
        return self.parent[x]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        self.counts += np.bincount(a, self.weights[b], len(self.counts)).astype(np.int64) + np.bincount(b, self.weights[a], len(self.counts)).astype(np.int64)
        self.unite(a, b)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self._roots(a), self._roots(b)
        fresh = np.flatnonzero(x != y)
        _, first = np.unique(x[fresh] * len(self.parent) + y[fresh], return_index=True)
        for i in fresh[first].tolist():
            p, q = a[i:i + 1], b[i:i + 1]
            x, y = int(self._roots(p)[0]), int(self._roots(q)[0])
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.forest.append((int(p[0]), int(q[0])))

    def whole(self, left: np.ndarray, right: np.ndarray) -> None:
        self.counts[left] += self.weights[right].sum()
        self.counts[right] += self.weights[left].sum()
        self.unite(np.full(len(right), left[0]), right)
        self.unite(left, np.full(len(left), right[0]))

    def within(self, rows: np.ndarray) -> None:
        self.counts[rows] += self.weights[rows].sum() - self.weights[rows]
        self.unite(np.full(len(rows) - 1, rows[0]), rows[1:])


def traverse(left: CoverTree, right: CoverTree, given: np.ndarray, shift: int, links: Links, threshold: float) -> None:
    """All links between two trees, or within one given twice.  Row i of ``right`` is row ``shift + i`` of given and links."""
    reach, same = float(np.sqrt(2 - 2 * threshold)), left is right
    lengths = np.sqrt((given * given).sum(1))
    front = [(0, 0)]
    while front:
        x, y = front.pop()
        xs, ys = left.kids[x], right.kids[y]
        apart = _apart(left.unit[left.centre[xs]], right.unit[right.centre[ys]])
        bound = left.radius[xs][:, None] + right.radius[ys][None, :]
        live = apart - bound <= reach + SLACK
        if same and x == y:
            live = np.triu(live)
        i, j = np.nonzero(live)
        a, b, sure = xs[i], ys[j], (apart + bound)[i, j] < reach - SLACK
        single = left.leaf[a] & right.leaf[b]
        p, q = left.centre[a[single]], right.centre[b[single]] + shift
        if same:
            p, q = p[p != q], q[p != q]
        near = np.einsum("ij,ij->i", given[p], given[q]) / (lengths[p] * lengths[q]) >= threshold
        if near.any():
            links.pairs(p[near], q[near])
        for a, b, all_in in zip(a[~single].tolist(), b[~single].tolist(), sure[~single].tolist(), strict=True):
            if same and a == b:
                if 2 * left.radius[a] < reach - SLACK:
                    links.within(left.rows[a])
                else:
                    front.append((a, b))
            elif all_in:
                links.whole(left.rows[a], right.rows[b] + shift)
            else:
                front.append((a, b))


def link_blocks(blocks: list[tuple[np.ndarray, np.ndarray]], threshold: float = THRESHOLD) -> Links:
    """Links within one block or between two, each ``(vectors, weights)``."""
    given = np.concatenate([v for v, _ in blocks]).astype(float)
    links = Links(np.concatenate([w for _, w in blocks]))
    unit = given / np.sqrt((given * given).sum(1))[:, None]
    cut = len(blocks[0][0])
    left = CoverTree(unit[:cut])
    traverse(left, CoverTree(unit[cut:]) if len(blocks) > 1 else left, given, cut if len(blocks) > 1 else 0, links, threshold)
    return links


def _classes(vectors: DataFrame) -> DataFrame:
    """Distinct vectors of each label with their number of rows and their projection."""
    grouped = vectors.groupBy("label", "v").agg(F.count(F.lit(1)).alias("weight"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    turned = F.transform("v", lambda x, i: F.when(i % 2 == 0, x.cast("double")).otherwise(-x.cast("double")))
    along = F.aggregate(turned, F.lit(0.0), lambda s, x: s + x) / (norm * F.sqrt(F.size("v")))
    return grouped.select("label", "v", "weight", F.size("v").alias("dim"), along.alias("along"), F.monotonically_increasing_id().alias("cls"))


def _blocks(classes: DataFrame, block: int) -> DataFrame:
    """One row per block: ``(label, dim, block, low, high, cls[], weight[], values[])``."""
    shares = [k / STEPS for k in range(1, STEPS)]
    spread = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("along", shares, 2000).alias("steps"))
    at = classes.join(spread, ["label", "dim"])
    wanted = F.least(F.lit(STEPS), F.ceil(F.col("n") / block))
    step = F.size(F.filter("steps", lambda s: s < F.col("along")))
    at = at.withColumn("q", F.floor(step * wanted / STEPS)).drop("steps", "n")
    counted = at.groupBy("label", "dim", "q").agg(F.count(F.lit(1)).alias("c"))
    dealt = at.join(counted, ["label", "dim", "q"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.ceil(F.col("c") / block)))
    return dealt.groupBy("label", "dim", "q", "part").agg(F.min("along").alias("low"), F.max("along").alias("high"), F.collect_list("cls").alias("cls"), F.collect_list("weight").alias("weight"), F.flatten(F.collect_list("v")).alias("values"))


def class_links(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Rows ``(a, b, n)``: n linked rows of class a (b null), or a forest link between a and b (n null)."""
    blocks = materialise(_blocks(classes, block).withColumn("block", F.struct("q", "part")))
    # pairs of blocks are found among their bounds alone, a row a block; each block is then copied to the pairs it is in
    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK
    bounds = materialise(blocks.select("label", "dim", "block", "low", "high"))
    others = bounds.select("label", "dim", F.col("block").alias("two"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    near = (F.col("low2") - F.col("high") <= reach) & (F.col("low") - F.col("high2") <= reach)
    met = bounds.withColumnRenamed("block", "one").join(others, ["label", "dim"]).where((F.col("one") <= F.col("two")) & near)
    pairs = met.select("label", "dim", F.struct("one", "two").alias("pair"), F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
    spread = pairs.join(blocks.select("label", "dim", "block", "cls", "weight", "values"), ["label", "dim", "block"]).select("label", "dim", "cls", "weight", "values", "pair")
    keyed = spread.select("label", "dim", F.col("pair.one.q").alias("q1"), F.col("pair.one.part").alias("p1"), F.col("pair.two.q").alias("q2"), F.col("pair.two.part").alias("p2"), "cls", "weight", "values")

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.asarray(v, float).reshape(len(w), -1), np.asarray(w, np.int64)) for v, w in zip(rows["values"], rows["weight"], strict=True)]
        names = np.concatenate([np.asarray(c, np.int64) for c in rows["cls"]])
        links = link_blocks(parts, threshold)
        some = np.flatnonzero(links.counts)
        counts = pd.DataFrame({"a": names[some], "b": None, "n": links.counts[some]})
        forest = pd.DataFrame({"a": [names[a] for a, _ in links.forest], "b": [names[b] for _, b in links.forest], "n": None})
        return pd.concat([counts.astype("Int64"), forest.astype("Int64")])

    return keyed.groupBy("label", "dim", "q1", "p1", "q2", "p2").applyInPandas(link, "a long, b long, n long")


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Return ``(<id_col>, n_links, component_id, kept)`` for each row of ``table``."""
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & ~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    valid = rows.where(sound)
    classes = materialise(_classes(valid))
    found = materialise(class_links(classes, threshold, block))
    counts = found.where("n is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("b is not null"), "a", "b").withColumnsRenamed({"node": "cls", "component": "root"})
    named = materialise(valid.join(classes.select("label", "v", "cls", "weight"), ["label", "v"]).select("id", "cls", "weight"))
    rooted = classes.select("cls").join(parts, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("cls").agg(F.min("id").alias("least")).join(rooted, "cls")
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(of_root, "root").join(counts, "cls", "left").select("cls", "component_id", F.coalesce("n", F.lit(0)).alias("n"))
    linked = named.join(of_class, "cls").select("id", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id")
    alone = rows.where(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


#: DuckDB SQL for the query's rows: all pairs of a label, and labels handed on along links until nothing changes.
SQL = """
with recursive sound as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as src, b.vec_id as dst from sound a join sound b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select vec_id as node, vec_id as root from embeddings union select l.dst, r.root from reach r join links l on l.src = r.node),
least as (select node, min(root) as component_id from reach group by 1)
select v.vec_id, (select count(*) from links where src = v.vec_id) as n_links, component_id, v.vec_id = component_id as kept from embeddings v join least on node = v.vec_id
"""
