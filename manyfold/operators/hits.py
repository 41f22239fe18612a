"""Analytics on similarity hits: reciprocal best hits, coverage, domains, pairing, and p-values of sets.

Coordinates are 0-based and closed; a hit on the other strand has start > end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The smallest normal double, which stands for a p-value of zero.
TINY = 2.2250738585072014e-308


# --- reciprocal hits


def reciprocal_by_score(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Lines b -> a that score as much as a's best line a -> b: ``(key, target, score)``, keyed by a.

    Of ``backward`` (keyed by b) all lines that tie with b's best count.  Scores are compared, targets are not; a with a
    backward line above its best forward line has none.
    """
    best = forward.groupBy("key").agg(F.max("score").alias("__best"))
    top = F.max("score").over(Window.partitionBy("key"))
    ties = backward.withColumn("__top", top).where("score = __top").select(F.col("target").alias("key"), F.col("key").alias("target"), "score")
    most = F.max("score").over(Window.partitionBy("key"))
    ranked = ties.withColumn("__most", most).join(best, "key")
    return ranked.where("score = __best and __most <= __best").select("key", "target", "score")


def reciprocal_pairs(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Pairs ``(key, target, score)`` in which each is the other's best hit (ties by the smaller target)."""

    def best(table: DataFrame) -> DataFrame:
        return table.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("target").alias("t"))).alias("b")).select("key", F.col("b.t").alias("target"), (-F.col("b.s")).alias("score"))

    back = best(backward).select(F.col("target").alias("key"), F.col("key").alias("target"))
    return best(forward).join(back, ["key", "target"]).select("key", "target", "score")


def transpose_hits(table: DataFrame, evalue: Column | None = None, most: float = float("inf")) -> DataFrame:
    """Hits seen from the target: coordinates change sides, I and D in ``cigar`` as well, and ``diagonal`` its sign.

    evalue: an expression for the new e-value over the new columns; lines above ``most`` go, the rest is numbered in the order
    of hits (e-value, score, target length, target).
    """
    sides = {"key": "target", "target": "key", "qstart": "tstart", "tstart": "qstart", "qend": "tend", "tend": "qend", "qlen": "tlen", "tlen": "qlen"}
    changed = {"cigar": F.translate("cigar", "ID", "DI"), "diagonal": -F.col("diagonal")} if {"cigar", "diagonal"} & set(table.columns) else {}
    columns = [changed[c].alias(c) if c in changed else F.col(sides.get(c, c)).alias(c) for c in table.columns if c != "pos"]
    out = table.select(*columns)
    if evalue is not None:
        out = out.withColumn("evalue", evalue)
    order = Window.partitionBy("key").orderBy("evalue", F.desc("score"), "tlen", "target", "qstart", "tstart")
    return out.where(F.col("evalue") <= most).withColumn("pos", F.row_number().over(order).cast("long"))


# --- coverage and domains


def coverage_summary(table: DataFrame) -> DataFrame:
    """Per entry: number of hits, covered share of the query (each part once), summed share, mean identity.

    Lengths are end - start; the union of the intervals comes from the running maximum of the ends before.
    """
    low, high = F.least("qstart", "qend"), F.greatest("qstart", "qend")
    order = Window.partitionBy("key").orderBy("__low", "__high", "pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("__high").over(order), F.lit(-1))
    placed = table.withColumn("__low", low).withColumn("__high", high).withColumn("__before", before)
    fresh = F.greatest("__before", "__high") - F.greatest("__before", "__low")
    size = F.max("qlen")
    return placed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(fresh) / size).alias("unique_coverage"), (F.sum(F.col("__high") - F.col("__low")) / size).alias("summed_coverage"), F.avg("identity").alias("mean_identity")
    )


def _pick(spans: np.ndarray, size: int, overlap: float) -> list[int]:
    """Rows of ``spans`` (start, end) taken in order when at most the share ``overlap`` of them is covered already."""
    covered, taken = np.zeros(size + 1, bool), []
    for i, (a, b) in enumerate(spans):
        low, high = min(a, b), max(a, b)
        if covered[low:high].sum() / (high - low + 1) <= overlap:
            covered[low:high] = True
            taken.append(i)
    return taken


def pick_domains(table: DataFrame, overlap: float = 0.0, coverage: float = 0.0, most_evalue: float | None = None) -> DataFrame:
    """Greedy choice of hits that don't overlap on the query, in the order of ``pos``; other columns stay.

    coverage: least share of the target that a hit covers.  With ``most_evalue`` lines are taken in the order of e-values, which
    must lie below it, and the coverage must be exceeded.  Every choice depends on the ones before, so an entry's lines are
    judged by one task, which holds them and one flag per place of the query.
    """
    share = (F.abs(F.col("tend") - F.col("tstart")) + 1) / F.col("tlen")
    fits = (F.col("qstart") < F.col("qlen")) & (F.col("qend") < F.col("qlen"))
    if most_evalue is None:
        good, order = table.where(fits & (share >= coverage)), ["pos"]
    else:
        good, order = table.where(fits & (share > coverage) & (F.col("evalue") < most_evalue)), ["evalue", "pos"]

    @F.arrow_udf("array<boolean>")
    def picked(starts: pa.Array, ends: pa.Array, sizes: pa.Array) -> pa.Array:
        out = []
        for a, b, n in zip(starts.to_pylist(), ends.to_pylist(), sizes.to_pylist(), strict=True):
            taken = set(_pick(np.array([a, b]).T, int(n), overlap))
            out.append([i in taken for i in range(len(a))])
        return pa.array(out, pa.list_(pa.bool_()))

    rows = F.sort_array(F.collect_list(F.struct(*order, *[c for c in good.columns if c not in order])))
    held = good.groupBy("key").agg(rows.alias("__rows"), F.max("qlen").alias("__size"))
    chosen = held.select(F.arrays_zip("__rows", picked(F.col("__rows.qstart"), F.col("__rows.qend"), F.col("__size")).alias("__taken")).alias("__z"))
    return chosen.select(F.inline("__z")).where("__taken").select(*[F.col(f"__rows.{c}").alias(c) for c in good.columns])


def chain_diagonals(table: DataFrame) -> DataFrame:
    """Join hits of a (key, target, strands) that lie on one diagonal and overlap or touch: ``(key, target, qstart, ..., n)``.

    Gaps and islands: a hit that starts behind all ends before begins a new chain.
    """
    named = table.select(
        "key", "target", (F.col("qstart") > F.col("qend")).alias("qback"), (F.col("tstart") > F.col("tend")).alias("tback"),
        F.least("qstart", "qend").alias("q0"), F.greatest("qstart", "qend").alias("q1"), F.least("tstart", "tend").alias("t0"), F.greatest("tstart", "tend").alias("t1"),
    ).withColumn("diagonal", F.col("q0") - F.col("t0"))
    group = ["key", "target", "qback", "tback", "diagonal"]
    order = Window.partitionBy(*group).orderBy("q0", "q1")
    before = F.max("q1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("q0") > F.coalesce(before, F.lit(-2)) + 1).cast("int")
    marked = named.withColumn("__fresh", fresh).withColumn("__chain", F.sum("__fresh").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = marked.groupBy(*group, "__chain").agg(F.min("q0").alias("q0"), F.max("q1").alias("q1"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count(F.lit(1)).alias("n"))
    turn = lambda back, a, b: F.when(F.col(back), F.col(b)).otherwise(F.col(a))
    return joined.select("key", "target", turn("qback", "q0", "q1").alias("qstart"), turn("qback", "q1", "q0").alias("qend"), turn("tback", "t0", "t1").alias("tstart"), turn("tback", "t1", "t0").alias("tend"), "n")


def to_contig(table: DataFrame, orfs: DataFrame) -> DataFrame:
    """Query coordinates of hits of open reading frames on their contigs: ``orfs`` ``(orf, contig, start, stop, contig_length)``.

    A frame with start > stop lies on the other strand, so its hits run backwards.
    """
    named = orfs.select(F.col("orf").alias("key"), "contig", "start", "stop", "contig_length")
    sign = F.when(F.col("start") > F.col("stop"), -1).otherwise(1)
    out = table.join(named, "key").withColumn("qstart", F.col("start") + sign * F.col("qstart")).withColumn("qend", F.col("start") + sign * F.col("qend")).withColumn("qlen", F.col("contig_length"))
    return out.withColumn("key", F.col("contig")).select(*table.columns)


def protein_to_nucleotide(table: DataFrame) -> DataFrame:
    """Hits of proteins as hits of their codons: starts times 3, ends times 3 plus 2, run lengths of ``cigar`` times 3."""
    runs = F.regexp_extract_all("cigar", F.lit(r"\d+[MID]"), F.lit(0))
    tripled = F.array_join(F.transform(runs, lambda r: F.concat((F.substring(r, F.lit(1), F.length(r) - 1).cast("int") * 3).cast("string"), F.right(r, F.lit(1)))), "")
    return table.withColumns({"qstart": F.col("qstart") * 3, "qend": F.col("qend") * 3 + 2, "tstart": F.col("tstart") * 3, "tend": F.col("tend") * 3 + 2, "qlen": F.col("qlen") * 3, "tlen": F.col("tlen") * 3, "cigar": tripled})


# --- pairing of chains


def pair_best(table: DataFrame, group: str = "group", chain: str = "chain", taxon: str = "taxon", everywhere: bool = False) -> DataFrame:
    """Per group, the best hit of each chain and taxon, for taxa with hits in two chains or more (``everywhere``: in all)."""
    order = Window.partitionBy(group, chain, taxon).orderBy(F.desc("score"), "target", "pos")
    best = table.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")
    present = F.count(F.lit(1)).over(Window.partitionBy(group, taxon))
    if not everywhere:
        return best.withColumn("__n", present).where("__n > 1").drop("__n")
    chains = table.groupBy(group).agg(F.count_distinct(chain).alias("__all"))
    return best.withColumn("__n", present).join(chains, group).where("__n = __all").drop("__n", "__all")


def pair_nearest(left: DataFrame, right: DataFrame, most: int, group: str = "group", number: str = "number") -> DataFrame:
    """For each left row ``(group, number, id)`` the right row of its group whose number is nearest, within ``most``.

    An as-of join both ways by one sort: the last right row before and the first one after; the one before wins a tie.
    """
    both = left.select(F.col(group).alias("g"), F.col(number).alias("x"), F.col("id").alias("own"), F.lit(None).cast(right.schema["id"].dataType).alias("other"))
    both = both.unionByName(right.select(F.col(group).alias("g"), F.col(number).alias("x"), F.lit(None).cast(left.schema["id"].dataType).alias("own"), F.col("id").alias("other")))
    named = F.when(F.col("other").isNotNull(), F.struct("x", "other"))
    order = Window.partitionBy("g").orderBy("x")
    down = F.max(named).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    up = F.min(named).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    seen = both.withColumn("__down", down).withColumn("__up", up).where("own is not null")
    lower, upper = F.col("x") - F.col("__down.x"), F.col("__up.x") - F.col("x")
    below = upper.isNull() | (lower <= upper)
    out = seen.select(F.col("g").alias(group), F.col("own").alias("id"), F.when(below, F.col("__down.other")).otherwise(F.col("__up.other")).alias("nearest"), F.when(below, lower).otherwise(upper).alias("distance"))
    return out.where(F.col("distance") <= most)


# --- sets


def best_per_set(table: DataFrame, sizes: DataFrame, simple: bool = False) -> DataFrame:
    """Best hit per query and target set: ``(key, set_id, target, log_p)``; table ``(key, set_id, target, evalue, pos)``.

    sizes: ``(set_id, n)``.  With one hit (or ``simple``) log p comes from the e-value, -log(n + 1) calibrated; with more it is
    minus the distance of the two best -log(evalue / n).
    """
    named = table.join(sizes.select("set_id", F.col("n").alias("__n")), "set_id")
    p = F.when(F.col("evalue") == 0, F.lit(TINY)).otherwise(F.col("evalue") / F.col("__n"))
    scored = named.withColumn("__s", -F.log(p))
    order = Window.partitionBy("key", "set_id").orderBy(F.desc("__s"), F.desc("pos"))
    ranked = scored.withColumn("__rank", F.row_number().over(order)).withColumn("__second", F.lead("__s").over(order)).withColumn("__first", F.min_by("target", F.struct("evalue", "pos")).over(Window.partitionBy("key", "set_id")))
    best = ranked.where("__rank = 1")
    one = F.when(F.col("evalue") == 0, math.log(TINY)).when(F.col("evalue") < 1e-3, F.log("evalue")).otherwise(F.log(1 - F.exp(-F.col("evalue")))) - F.log(F.col("__n") + 1)
    alone = F.lit(simple) | F.col("__second").isNull()
    return best.select("key", "set_id", F.when(alone, F.col("__first")).otherwise(F.col("target")).alias("target"), F.when(alone, one).otherwise(F.col("__second") - F.col("__s")).alias("log_p"))


def _log_tails(orfs: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of k = 1 .. orfs: log of the chance that at least k orfs lie below the threshold, and log of (k - 1)!."""
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, orfs + 1, dtype=np.float64)))))
    k = np.arange(1, orfs + 1)
    terms = logs[orfs] - logs[1:] - logs[orfs - k] + k * math.log(threshold) + (orfs - k) * math.log1p(-threshold)
    return np.logaddexp.accumulate(terms[::-1])[::-1], logs[:-1]


def _multihit_values(r: Sequence[float], orfs: int, alpha: float) -> list[float]:
    """Truncated Fisher p-values of one number of orfs; r sums log(alpha / (orfs + 1)) - log p of the p-values below it.

    A term's factors can be out of a number's range either way while the term isn't, so they are multiplied as logs.
    """
    threshold, out, tails = alpha / (orfs + 1), [], None
    for x in r:
        if threshold <= 0 or x == 0:
            out.append(1.0)
        elif math.isinf(x):
            out.append(0.0)
        elif threshold >= 1:
            out.append(math.exp(-x))
        else:
            tails = tails or _log_tails(orfs, threshold)
            logs = np.arange(orfs) * math.log(x) - tails[1] - x + tails[0]
            top = logs.max()
            out.append(float(np.exp(top) * np.exp(logs - top).sum()))
    return out


def _multihit(log_p: Sequence[float], orfs: int, alpha: float) -> float:
    """Truncated Fisher p-value of the log p-values below log(alpha / (orfs + 1))."""
    log_t = math.log(alpha / (orfs + 1)) if alpha > 0 else -math.inf
    return _multihit_values([sum(log_t - p for p in log_p if p < log_t)], orfs, alpha)[0]


def combine_sets(table: DataFrame, sizes: DataFrame, n_targets: int, mode: str = "multihit", alpha: float = 1.0) -> DataFrame:
    """One value per (query set, target set): table ``(set_id, target_set, log_p)``, sizes ``(set_id, n)`` of query sets.

    mode: ``minimum`` and ``product`` of the p-values and ``multihit`` (truncated Fisher) give e-values, times the number of
    target sets; ``truncated`` gives the score of the truncated product.
    """
    named = table.join(sizes.select("set_id", F.col("n").alias("__n")), "set_id")
    grouped = named.groupBy("set_id", "target_set", "__n")
    if mode == "minimum":
        value = (1 - F.exp(-F.exp(F.least(F.min("log_p"), F.lit(0.0))) * F.col("__n"))) * n_targets
        return grouped.agg(value.alias("value")).drop("__n")
    if mode == "product":
        return grouped.agg((F.exp(F.sum("log_p")) * n_targets).alias("value")).drop("__n")
    if mode == "truncated":
        threshold = F.log(F.lit(alpha) / (F.col("__n") + 1))
        over = F.when(F.col("log_p") < threshold, threshold - F.col("log_p"))
        summed = named.withColumn("__over", over).groupBy("set_id", "target_set", "__n").agg(F.sum("__over").alias("__r"), F.min("log_p").alias("__m"))
        return summed.select("set_id", "target_set", F.when(F.col("__r").isNull(), -F.least("__m", F.lit(0.0))).otherwise(F.col("__r") - threshold).alias("value"))
    if mode != "multihit":
        raise ValueError("mode is multihit, minimum, product or truncated")

    @F.arrow_udf("double")
    def combined(over: pa.Array, orfs: pa.Array) -> pa.Array:
        x, n, out = over.to_numpy(zero_copy_only=False), orfs.to_numpy(zero_copy_only=False), np.zeros(len(over))
        for size in np.unique(n).tolist():
            out[n == size] = np.array(_multihit_values(x[n == size].tolist(), size, alpha)) * n_targets
        return pa.array(out, pa.float64())

    # all that a pair of sets needs of its p-values is one sum
    least = F.log(F.lit(alpha) / (F.col("__n") + 1)) if alpha > 0 else F.lit(float("-inf"))
    over = F.sum(F.when(F.col("log_p") < least, least - F.col("log_p")).otherwise(0.0))
    return grouped.agg(over.alias("__r")).select("set_id", "target_set", combined(F.col("__r"), F.col("__n").cast("int")).alias("value"))


def set_matrix(members: DataFrame, table: DataFrame, target_sets: DataFrame) -> DataFrame:
    """Share of each query set's members with a hit in each target set, zeros too: ``(query_set, target_set, share)``.

    members: ``(key, query_set)``; target_sets: ``(target, target_set)``.  The matrix is sets by sets, not members.
    """
    sizes = members.groupBy("query_set").agg(F.count_distinct("key").alias("__n"))
    others = target_sets.select("target_set").distinct()
    found = table.join(members, "key").join(target_sets, "target").groupBy("query_set", "target_set").agg(F.count_distinct("key").alias("__hit"))
    # every set meets every other one: that is the result asked for
    dense = sizes.join(others, F.lit(True))
    return dense.join(found, ["query_set", "target_set"], "left").select("query_set", "target_set", (F.coalesce("__hit", F.lit(0)) / F.col("__n")).alias("share"))
