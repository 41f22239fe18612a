"""Clustering of similarity graphs: components, greedy choices in parallel rounds, hash buckets, and composition.

Edges are a table ``(src, dst, score)``; nodes ``(key, length)``.  Sequential rules (take the longest, take the largest) become
rounds that decide every node whose outcome is settled, so the result is that of the sequential rule, and no component ever
has to fit into one task.  Rounds are cut through shared tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manyfold.operators.candidates import _hash, identical_places
from manyfold.operators.graph import connected_components
from manyfold.operators.storage import materialise


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge between different nodes, the best score of repeated ones."""
    both = edges.select("src", "dst", "score").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"))
    return both.where("src != dst").groupBy("src", "dst").agg(F.max("score").alias("score"))


def by_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(rep, member)``: connected components, named by their longest node (ties: the smallest key)."""
    parts = connected_components(edges.select("src", "dst"))
    named = nodes.join(parts.select(F.col("node").alias("key"), "component"), "key", "left").select("key", "length", F.coalesce("component", "key").alias("component"))
    best = named.groupBy("component").agg(F.min(F.struct((-F.col("length")).alias("l"), F.col("key").alias("k")))["k"].alias("rep"))
    return named.join(best, "component").select("rep", F.col("key").alias("member"))


def greedy_by_length(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(rep, member)``: longest first, a node that isn't taken becomes a representative and takes its free neighbours.

    edges: src -> dst, directed; a node that lists no neighbour takes none.  In each round nodes without an undecided earlier
    node that could take them become representatives, and what they reach is taken by the earliest of them.
    """
    order = nodes.select("key", F.struct((-F.col("length")).alias("l"), F.col("key").alias("k")).alias("o"))
    lists = edges.where("src != dst").select("src", "dst").distinct()
    ranked = lists.join(order.select(F.col("key").alias("src"), F.col("o").alias("so")), "src").join(order.select(F.col("key").alias("dst"), F.col("o").alias("do")), "dst")
    left = materialise(ranked.where("so < do").select("src", "dst", "so"))
    undecided = materialise(nodes.select("key"))
    result = None
    for _ in range(max_rounds):
        blocked = left.select(F.col("dst").alias("key")).distinct()
        reps = materialise(undecided.join(blocked, "key", "left_anti"))
        found = reps.select(F.col("key").alias("rep"), F.col("key").alias("member"))
        taken = left.join(reps.select(F.col("key").alias("src")), "src").groupBy("dst").agg(F.min(F.struct("so", "src"))["src"].alias("rep"))
        # a node may also be reached by an earlier representative that is still undecided; it waits for that one
        first = left.groupBy("dst").agg(F.min(F.struct("so", "src"))["src"].alias("first"))
        sure = materialise(taken.join(first, "dst").where("rep = first").select("rep", F.col("dst").alias("member")))
        step = found.unionByName(sure.select("rep", "member"))
        result = materialise(step if result is None else result.unionByName(step))
        gone = step.select(F.col("member").alias("key"))
        undecided = materialise(undecided.join(gone, "key", "left_anti"))
        if undecided.isEmpty():
            return result
        taken_now = sure.select(F.col("member").alias("__m"))
        left = materialise(left.join(gone, left["dst"] == gone["key"], "left_anti").join(taken_now, left["src"] == F.col("__m"), "left_anti"))
    raise RuntimeError(f"not settled in {max_rounds} rounds")


def set_cover(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(rep, member)``: the node with most uncovered neighbours is taken again and again (ties: longest, smallest key).

    Per round every node that beats all candidates within two steps is taken: their covers can't meet, so the order among
    them doesn't matter.  At last a covered node goes to the adjacent representative with the best score (ties: taken earlier).
    """
    links = materialise(symmetric(edges))
    size = nodes.select(F.col("key").alias("src"), "length")
    own = nodes.select(F.col("key").alias("src"), F.col("key").alias("dst"))
    cover = materialise(links.select("src", "dst").unionByName(own))  # what a node would cover: itself and its neighbours
    reps = None
    for k in range(max_rounds):
        rank = cover.groupBy("src").agg(F.count(F.lit(1)).alias("n")).join(size, "src").select("src", F.struct((-F.col("n")).alias("n"), (-F.col("length")).alias("l"), F.col("src").alias("k")).alias("o"))
        ranked = cover.join(rank, "src")
        # two candidates clash if they would cover the same node
        best_here = ranked.groupBy("dst").agg(F.min("o").alias("b"))
        winners = materialise(ranked.join(best_here, "dst").groupBy("src").agg(F.min((F.col("o") == F.col("b")).cast("int")).alias("w")).where("w = 1").select("src", F.lit(k).alias("round")))
        reps = materialise(winners if reps is None else reps.unionByName(winners))
        covered = materialise(cover.join(winners, "src").select("dst").distinct())
        cover = materialise(cover.join(covered, "dst", "left_anti").select("src", "dst"))
        if cover.isEmpty():
            break
    else:
        raise RuntimeError(f"not settled in {max_rounds} rounds")
    joined = links.join(reps, "src").join(reps.select(F.col("src").alias("dst"), F.lit(True).alias("is_rep")), "dst", "left").where("is_rep is null")
    best = joined.groupBy("dst").agg(F.min(F.struct((-F.col("score")).alias("s"), "round", "src"))["src"].alias("rep"))
    return reps.select(F.col("src").alias("rep"), F.col("src").alias("member")).unionByName(best.select("rep", F.col("dst").alias("member")))


def merge_clusters(first: DataFrame, second: DataFrame) -> DataFrame:
    """Members of ``first`` under the representatives that ``second`` gives to theirs; both ``(rep, member)``."""
    upper = second.select(F.col("member").alias("__rep"), F.col("rep").alias("__top"))
    return first.join(upper, first["rep"] == upper["__rep"], "left").select(F.coalesce("__top", "rep").alias("rep"), "member")


def by_hash(table: DataFrame, least_identity: float = 1.0, groups: tuple[str, str] | None = None, how: str = "xxhash64", max_rounds: int = 1000) -> DataFrame:
    """``(rep, member, identity)``: sequences of the same length whose reduced letters are the same, compared place by place.

    groups: ``translate`` tables that reduce the alphabet.  In every bucket the smallest key takes what is identical enough; what
    isn't starts again by itself.  A bucket is never paired with itself: every sequence meets one representative a round.
    """
    reduced = F.translate("seq", *groups) if groups else F.col("seq")
    left = materialise(table.select("key", "seq", _hash(reduced, how).alias("bucket"), F.length("seq").alias("n")))
    result = None
    for _ in range(max_rounds):
        reps = left.groupBy("bucket", "n").agg(F.min(F.struct("key", "seq")).alias("r"))
        compared = left.join(reps, ["bucket", "n"])
        share = F.when((F.col("n") == 0) | (F.col("seq") == F.col("r.seq")), 1.0).otherwise(identical_places(F.col("r.seq"), F.col("seq"), F.lit(0)) / F.col("n"))
        judged = materialise(compared.select(F.col("r.key").alias("rep"), F.col("key").alias("member"), share.alias("identity"), "seq", "bucket", "n"))
        step = judged.where(F.col("identity") >= least_identity).select("rep", "member", "identity")
        result = materialise(step if result is None else result.unionByName(step))
        left = materialise(judged.where(F.col("identity") < least_identity).select(F.col("member").alias("key"), "seq", "bucket", "n"))
        if left.isEmpty():
            return result
    raise RuntimeError(f"not settled in {max_rounds} rounds")


def cover_sets(members: DataFrame, clusters: DataFrame, least_share: float = 0.5, max_rounds: int = 10_000) -> DataFrame:
    """Greedy clustering of sets (proteomes): ``(rep, member, shared, share)``.

    members: ``(key, set_id)``; clusters: ``(rep, member)`` of the keys.  The set with most clusters is taken (ties: fewer members,
    smaller id) with all sets that have at least ``least_share`` of their clusters in common with it; then again among the rest.
    """
    held = materialise(members.join(clusters.select(F.col("member").alias("key"), F.col("rep").alias("cluster")), "key").select("set_id", "cluster").distinct())
    sizes = materialise(members.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_members")).join(held.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")), "set_id"))
    # one table a round: sets that are taken carry their representative and what they share with it
    state = sizes.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("rep", members.schema["set_id"].dataType), ("shared", "long"), ("share", "double"))])
    for _ in range(max_rounds):
        top = state.where("rep is null").orderBy(F.desc("n"), "n_members", "set_id").first()
        if top is None:
            return state.select("rep", F.col("set_id").alias("member"), "shared", "share")
        own = held.where(F.col("set_id") == top["set_id"]).select("cluster")
        common = held.join(own, "cluster", "left_semi").groupBy("set_id").agg(F.count(F.lit(1)).alias("__c"))
        met = state.join(common, "set_id", "left").withColumn("__takes", F.col("rep").isNull() & F.coalesce(F.col("__c") / F.col("n") >= least_share, F.lit(False)))
        told = {"rep": F.lit(top["set_id"]), "shared": F.col("__c"), "share": F.col("__c") / F.col("n")}
        state = materialise(met.select("set_id", "n_members", "n", *[F.when(F.col("__takes"), v).otherwise(F.col(c)).alias(c) for c, v in told.items()]))
    raise RuntimeError(f"not settled in {max_rounds} rounds")


def representatives_first(clusters: DataFrame) -> DataFrame:
    """Clusters as a keyed table ``(key, pos, target)`` with the representative on the first line."""
    order = Window.partitionBy("rep").orderBy(F.desc(F.col("rep") == F.col("member")), "member")
    return clusters.select(F.col("rep").alias("key"), F.row_number().over(order).cast("long").alias("pos"), F.col("member").alias("target"))
