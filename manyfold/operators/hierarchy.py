"""Queries over a hierarchy (taxonomy): ancestors, lowest common ancestors, weighted majorities, clade reports.

A hierarchy is a table ``(taxid, parent, rank, name)`` whose root is its own parent.  Ancestors are kept as a closure, so every
query is a join and an aggregation; the closure has as many rows as nodes times depth, whatever the number of hits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manyfold.operators.storage import materialise

#: Ranks from the lowest up, and the letters of the main ranks.
RANKS = ("forma", "varietas", "subspecies", "species", "species subgroup", "species group", "subgenus", "genus", "subtribe", "tribe", "subfamily", "family", "superfamily", "parvorder", "infraorder", "suborder", "order", "superorder", "infraclass", "subclass", "class", "superclass", "subphylum", "phylum", "superphylum", "subkingdom", "kingdom", "superkingdom")
LETTERS = {"species": "s", "genus": "g", "family": "f", "order": "o", "class": "c", "phylum": "p", "kingdom": "k", "superkingdom": "d"}
#: Rank number of what has no rank above it.
TOP = len(RANKS) + 1
BLOCKED = (12908, 28384)


def closure(nodes: DataFrame, max_rounds: int = 12) -> DataFrame:
    """``(taxid, ancestor, up)``: every node with itself (up 0) and its ancestors, ``up`` steps away.

    Paths double in length each round, so a tree of depth n takes log2(n) rounds.
    """
    own = nodes.select("taxid", F.col("taxid").alias("ancestor"), F.lit(0).alias("up"))
    steps = nodes.where("parent != taxid").select("taxid", F.col("parent").alias("ancestor"), F.lit(1).alias("up"))
    known = materialise(own.unionByName(steps))
    count = known.count()
    for _ in range(max_rounds):
        onward = known.select(F.col("taxid").alias("ancestor"), F.col("ancestor").alias("next"), F.col("up").alias("more"))
        known = materialise(known.join(onward, "ancestor").groupBy("taxid", F.col("next").alias("ancestor")).agg(F.min(F.col("up") + F.col("more")).alias("up")))
        before, count = count, known.count()
        if count == before:
            return known
    raise RuntimeError(f"the hierarchy is deeper than 2 ** {max_rounds}, or has a cycle")


def lineages(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """``nodes`` with ``depth``, ``ancestors`` (ids from the root to the node) and ``lineage`` (names without the root's)."""
    letter = _letter(F.col("rank"))
    named = nodes.select(F.col("taxid").alias("ancestor"), F.concat(letter, F.lit("_"), F.col("name")).alias("__label"))
    grouped = paths.join(named, "ancestor").groupBy("taxid").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("o"), F.col("ancestor").alias("a"), F.col("__label").alias("l")))).alias("p"))
    told = grouped.select("taxid", (F.size("p") - 1).alias("depth"), F.col("p.a").alias("ancestors"), F.array_join(F.slice(F.col("p.l"), 2, F.size("p")), ";").alias("lineage"))
    return nodes.join(told, "taxid")


def _letter(rank: Column) -> Column:
    out = F.lit("-")
    for name, letter in LETTERS.items():
        out = F.when(rank == name, letter).otherwise(out)
    return out


def rank_number(rank: Column) -> Column:
    """The rank's number from 1, null if it has none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, RANKS)), rank), F.lit(0)).cast("int")


# --- expressions over taxa

_TOKEN = re.compile(r"\s*(\d+|&&|\|\||[!(),])")


def taxon_expression(text: str, ancestors: Column) -> Column:
    """A condition such as ``(2||2759)&&!9606`` on a node's ancestors (itself included); ``,`` means or."""
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:]!r}")
        tokens.append(m[1])
        at = m.end()
    tokens.append("")
    place = 0

    def either() -> Column:
        nonlocal place
        out = both()
        while tokens[place] in ("||", ","):
            place += 1
            out = out | both()
        return out

    def both() -> Column:
        nonlocal place
        out = one()
        while tokens[place] == "&&":
            place += 1
            out = out & one()
        return out

    def one() -> Column:
        nonlocal place
        token = tokens[place]
        place += 1
        if token == "!":
            return ~one()
        if token == "(":
            out = either()
            if tokens[place] != ")":
                raise ValueError("a bracket isn't closed")
            place += 1
            return out
        if not token.isdigit():
            raise ValueError("a taxon is missing")
        return F.coalesce(F.array_contains(ancestors, F.lit(int(token)).cast("long")), F.lit(False))

    out = either()
    if tokens[place]:
        raise ValueError(f"unexpected {tokens[place]!r}")
    return out


def filter_taxa(table: DataFrame, mapping: DataFrame, lined: DataFrame, expression: str, column: str = "target") -> DataFrame:
    """Rows whose item's taxon satisfies an expression; mapping ``(item, taxid)``, lined from ``lineages``."""
    known = mapping.join(lined.select("taxid", "ancestors"), "taxid").where(taxon_expression(expression, F.col("ancestors")))
    return table.join(known.select(F.col("item").alias(column)).distinct(), column, "left_semi").select(*table.columns)


def add_taxa(table: DataFrame, mapping: DataFrame, lined: DataFrame, column: str = "target") -> DataFrame:
    """Rows with taxid, rank, name and lineage of their item; rows without a taxon go."""
    named = mapping.select(F.col("item").alias(column), "taxid").join(lined.select("taxid", "rank", "name", "lineage"), "taxid")
    return table.join(named, column).select(*table.columns, "taxid", "rank", "name", "lineage")


# --- lowest common ancestors and majorities


def _votes(table: DataFrame, mapping: DataFrame, lined: DataFrame, blocked: tuple[int, ...], column: str, weight: Column) -> DataFrame:
    """``(key, taxid, ancestors, weight)`` of hits; taxid and ancestors are null without a known taxon outside blocked subtrees."""
    known = mapping.select(F.col("item").alias(column), "taxid").join(lined.select("taxid", "ancestors"), "taxid")
    known = known.where(~F.arrays_overlap("ancestors", F.array(*[F.lit(b).cast("long") for b in blocked]))) if blocked else known
    return table.select("key", column, weight.cast("double").alias("weight")).join(known, column, "left").select("key", "taxid", "ancestors", "weight")


def _named(found: DataFrame, keys: DataFrame, lined: DataFrame) -> DataFrame:
    """Every key with its taxon; 0, ``no rank``, ``unclassified`` where there is none."""
    told = found.join(lined.select("taxid", "rank", "name"), "taxid")
    out = keys.select("key").distinct().join(told, "key", "left")
    fill = {"taxid": F.lit(0).cast("long"), "rank": F.lit("no rank"), "name": F.lit("unclassified")}
    return out.select(*[F.coalesce(F.col(c), fill[c]).alias(c) if c in fill else F.col(c) for c in out.columns])


def lowest_common_ancestor(table: DataFrame, mapping: DataFrame, lined: DataFrame, keys: DataFrame | None = None, blocked: tuple[int, ...] = BLOCKED, column: str = "target") -> DataFrame:
    """``(key, taxid, rank, name)``: of each entry's hits, the deepest taxon above all of them.

    Paths from the root have in common what the first and the last of them in order have in common, so an entry's hits
    shrink to two paths before they are shuffled.
    """
    votes = _votes(table, mapping, lined, blocked, column, F.lit(1.0))
    ends = votes.groupBy("key").agg(F.min("ancestors").alias("__a"), F.max("ancestors").alias("__b"))
    # two paths of a tree that have parted don't meet again
    shared = F.size(F.filter(F.zip_with("__a", "__b", lambda x, y: x == y), lambda same: same))
    common = ends.select("key", F.get("__a", shared - 1).alias("taxid"))
    return _named(common.where("taxid is not null"), keys if keys is not None else common, lined)


def vote_weight(mode: str, evalue: Column, score: Column | None = None) -> Column:
    """Weight of a vote: ``uniform``, ``minus_log_evalue`` (1000 for an e-value of zero) or ``score``."""
    if mode == "uniform":
        return F.lit(1.0)
    if mode == "minus_log_evalue":
        return F.when(evalue > 0, -F.log(evalue)).otherwise(1000.0)
    if mode == "score" and score is not None:
        return score
    raise ValueError("mode is uniform, minus_log_evalue or score")


def majority_ancestor(table: DataFrame, mapping: DataFrame, lined: DataFrame, majority: float = 0.5, weight: Column | None = None, keys: DataFrame | None = None, blocked: tuple[int, ...] = BLOCKED, column: str = "target") -> DataFrame:
    """``(key, taxid, rank, name, n, assigned, agreeing, share)``: the lowest taxon that holds the majority of the weight.

    Candidates have a hit of their own, or hits below two children or more; of those with enough of the weight, the one
    whose nearest rank is lowest wins, then the larger share, then the smaller id.
    """
    votes = _votes(table, mapping, lined, blocked, column, weight if weight is not None else F.lit(1.0))
    # exact sums, so that a share of just the majority doesn't depend on the order of rows
    exact = votes.select("key", "taxid", F.col("weight").try_cast("decimal(30,15)").alias("weight"))
    # all sums over an entry come from its distinct taxa; most entries have few hits of a taxon, so nothing is gained by summing up before the shuffle
    by_taxon = exact.repartition("key", "taxid").groupBy("key", "taxid").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("c"))
    known = F.col("taxid").isNotNull()
    totals = by_taxon.groupBy("key").agg(F.sum(F.when(known, F.col("w"))).alias("__all"), F.sum(F.when(known, F.col("c"))).alias("assigned"), F.sum("c").alias("n"))
    spread = by_taxon.where(known).join(lined.select("taxid", "ancestors"), "taxid").select("key", "w", "c", F.posexplode("ancestors").alias("__i", "ancestor"), F.col("ancestors"))
    child = F.get("ancestors", F.col("__i") + 1)
    sums = spread.withColumn("__child", F.coalesce(child, F.lit(0))).drop("ancestors").groupBy("key", "ancestor", "__child").agg(F.sum("w").alias("w"), F.sum("c").alias("c"))
    above = sums.groupBy("key", "ancestor").agg(F.sum("w").alias("w"), F.sum("c").alias("agreeing"), F.count(F.lit(1)).alias("__kids"), F.min("__child").alias("__own"))
    ranked = lined.select(F.col("taxid").alias("ancestor"), "ancestors")
    numbered = lined.select("taxid", rank_number(F.col("rank")).alias("__r"))
    lowest = ranked.select("ancestor", F.posexplode("ancestors").alias("__i", "taxid")).join(numbered, "taxid").where("__r is not null").groupBy("ancestor").agg(F.max_by("__r", "__i").alias("__rank"))
    # the hierarchy's own size bounds this table, not the hits'
    candidates = above.where("__kids > 1 or __own = 0").join(totals, "key").join(lowest, "ancestor", "left").withColumn("share", F.col("w").cast("double") / F.col("__all").cast("double")).where(F.col("share") >= majority)
    best = F.min(F.struct(F.coalesce("__rank", F.lit(TOP)).alias("r"), (-F.col("share")).alias("s"), F.col("ancestor").alias("taxid"), F.col("agreeing").alias("agreeing")))
    chosen = candidates.groupBy("key").agg(best.alias("b")).select("key", "b.taxid", "b.agreeing", (-F.col("b.s")).alias("share"))
    out = _named(chosen, keys if keys is not None else totals, lined).join(totals.select("key", "n", "assigned"), "key", "left")
    zero = F.lit(0).cast("long")
    return out.select("key", "taxid", "rank", "name", F.coalesce("n", zero).alias("n"), F.coalesce("assigned", zero).alias("assigned"), F.coalesce("agreeing", zero).alias("agreeing"), F.round(F.coalesce("share", F.lit(0.0)), 2).alias("share"))


def clade_report(assigned: DataFrame, lined: DataFrame) -> DataFrame:
    """Counts of entries per clade: ``(taxid, rank, name, depth, percent, clade, own, path)`` of taxa with any.

    assigned: ``(key, taxid)``, 0 for none.  Sorting by ``path`` gives the tree depth first, larger clades first; it holds
    minus the clade's count and the id for each taxon from the root.
    """
    own = assigned.groupBy("taxid").agg(F.count(F.lit(1)).alias("own"))
    total = own.agg(F.sum("own").alias("__total"))
    rolled = own.join(lined.select("taxid", "ancestors"), "taxid").select(F.explode("ancestors").alias("taxid"), F.col("own").alias("clade")).groupBy("taxid").agg(F.sum("clade").alias("clade"))
    # clades, not entries: bounded by the hierarchy
    steps = lined.join(rolled.select("taxid"), "taxid", "left_semi").select("taxid", F.posexplode("ancestors").alias("__i", "ancestor")).join(rolled.withColumnsRenamed({"taxid": "ancestor", "clade": "__c"}), "ancestor")
    paths = steps.groupBy("taxid").agg(F.array_sort(F.collect_list(F.struct("__i", (-F.col("__c")).alias("c"), "ancestor"))).alias("p")).select("taxid", F.flatten(F.transform("p", lambda x: F.array(x["c"], x["ancestor"]))).alias("path"))
    known = lined.select("taxid", "rank", "name", "depth").join(rolled, "taxid").join(paths, "taxid").join(own, "taxid", "left")
    named = known.select("taxid", "rank", "name", "depth", "clade", F.coalesce("own", F.lit(0)).alias("own"), "path")
    none = own.where("taxid = 0").select("taxid", F.lit("no rank").alias("rank"), F.lit("unclassified").alias("name"), F.lit(0).alias("depth"), F.col("own").alias("clade"), "own", F.array(F.lit(-(2**62)), F.lit(0).cast("long")).alias("path"))
    return none.unionByName(named).join(total, F.lit(True)).select("taxid", "rank", "name", "depth", (100 * F.col("clade") / F.col("__total")).alias("percent"), "clade", "own", "path")
