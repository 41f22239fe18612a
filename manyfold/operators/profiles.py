"""Star alignments, profiles and scoring of members against them.

A star alignment is a table ``(key, member, place, letter)``: for every member the letter that stands at a place of the key's
sequence (``-`` for a gap), so profiles are plain aggregations by place and letter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manyfold.operators.storage import materialise

#: Fixed values of the pseudocount rule: admixture min(1, A / (1 + diversity / B)).
ADMIX_A, ADMIX_B = 1.1, 4.1


def star_ungapped(hits: DataFrame, sequences: DataFrame, with_key: bool = True) -> DataFrame:
    """Star alignment of hits without gaps ``(key, target, qstart, qend, tstart)`` with the key's own sequence added."""
    texts = hits.join(sequences.select(F.col("key").alias("target"), "seq"), "target")
    part = F.substring(F.col("seq"), (F.col("tstart") + 1).cast("int"), (F.col("qend") - F.col("qstart") + 1).cast("int"))
    rows = texts.select("key", F.col("target").alias("member"), F.posexplode(_letters(part)).alias("i", "letter"), "qstart").select("key", "member", (F.col("qstart") + F.col("i")).cast("long").alias("place"), "letter")
    if not with_key:
        return rows
    own = sequences.join(hits.select("key").distinct(), "key", "left_semi")
    return rows.unionByName(own.select("key", F.col("key").alias("member"), F.posexplode(_letters(F.col("seq"))).alias("i", "letter")).select("key", "member", F.col("i").cast("long").alias("place"), "letter"))


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def star_gapped(hits: DataFrame, sequences: DataFrame) -> DataFrame:
    """Star alignment of hits with ``cigar``: D letters (the member's insertions) are left out, I gives a gap."""
    texts = hits.join(sequences.select(F.col("key").alias("target"), "seq"), "target")
    runs = F.transform(F.regexp_extract_all("cigar", F.lit(r"\d+[MID]"), F.lit(0)), lambda r: F.struct(F.substring(r, F.lit(1), F.length(r) - 1).cast("long").alias("n"), F.right(r, F.lit(1)).alias("c")))
    none = F.array().cast("array<struct<q:bigint,t:bigint,n:bigint,c:string>>")
    start = F.struct(F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("t"), none.alias("all"))
    placed = F.aggregate(
        runs, start,
        lambda a, r: F.struct((a["q"] + F.when(r["c"] != "D", r["n"]).otherwise(0)).alias("q"), (a["t"] + F.when(r["c"] != "I", r["n"]).otherwise(0)).alias("t"), F.concat(a["all"], F.array(F.struct(a["q"].alias("q"), a["t"].alias("t"), r["n"].alias("n"), r["c"].alias("c")))).alias("all")),
        lambda a: F.filter(a["all"], lambda x: x["c"] != "D"),
    )
    spread = texts.select("key", F.col("target").alias("member"), "seq", "qstart", "tstart", F.explode(placed).alias("r"))
    part = F.when(F.col("r.c") == "M", F.substring(F.col("seq"), (F.col("tstart") + F.col("r.t") + 1).cast("int"), F.col("r.n").cast("int"))).otherwise(F.repeat(F.lit("-"), F.col("r.n").cast("int")))
    rows = spread.select("key", "member", (F.col("qstart") + F.col("r.q")).alias("at"), F.posexplode(_letters(part)).alias("i", "letter"))
    return rows.select("key", "member", (F.col("at") + F.col("i")).cast("long").alias("place"), "letter")


def msa_rows(star: DataFrame, sequences: DataFrame) -> DataFrame:
    """``(key, member, row)``: each member's row of the alignment, gaps where it has no letter."""
    sizes = sequences.select("key", F.length("seq").alias("n"))
    ordered = star.groupBy("key", "member").agg(F.array_sort(F.collect_list(F.struct("place", "letter"))).alias("r")).join(sizes, "key")
    # a row is as long as the key's sequence: gaps before, between and behind the letters
    prev = lambda i: F.when(i > 0, F.get("r", i - 1)["place"]).otherwise(-1)
    body = F.array_join(F.transform("r", lambda x, i: F.concat(F.repeat(F.lit("-"), (x["place"] - prev(i) - 1).cast("int")), x["letter"])), "")
    return ordered.select("key", "member", F.rpad(body, F.col("n"), F.lit("-")).alias("row"))


def counts(star: DataFrame) -> DataFrame:
    """``(key, place, letter, n)``, gaps left out."""
    return star.where("letter != '-'").groupBy("key", "place", "letter").agg(F.count(F.lit(1)).alias("n"))


def weights(star: DataFrame) -> DataFrame:
    """Position-based weights ``(key, member, weight)``: a letter that few members share counts more; they sum to 1 per key."""
    real = star.where("letter != '-'")
    per = counts(star)
    kinds = per.groupBy("key", "place").agg(F.count(F.lit(1)).alias("kinds"))
    length = real.groupBy("key", "member").agg(F.count(F.lit(1)).alias("size"))
    joined = real.join(per, ["key", "place", "letter"]).join(kinds, ["key", "place"]).join(length, ["key", "member"])
    raw = joined.groupBy("key", "member").agg(F.sum(1 / (F.col("n") * F.col("kinds") * (F.col("size") + 30))).alias("w"))
    total = raw.groupBy("key").agg(F.sum("w").alias("t"))
    return raw.join(total, "key").select("key", "member", (F.col("w") / F.col("t")).alias("weight"))


def frequencies(star: DataFrame, weighted: DataFrame) -> DataFrame:
    """``(key, place, letter, share)`` by weighted members; shares of a place sum to 1."""
    summed = star.where("letter != '-'").join(weighted, ["key", "member"]).groupBy("key", "place", "letter").agg(F.sum("weight").alias("w"))
    total = summed.groupBy("key", "place").agg(F.sum("w").alias("t"))
    return summed.join(total, ["key", "place"]).select("key", "place", "letter", (F.col("w") / F.col("t")).alias("share"))


def diversity(shares: DataFrame) -> DataFrame:
    """``(key, place, neff)``: the effective number of letters, exp of the entropy."""
    return shares.groupBy("key", "place").agg(F.exp(-F.sum(F.col("share") * F.log("share"))).alias("neff"))


def log_odds(shares: DataFrame, background: DataFrame, scale: float = 8.0) -> DataFrame:
    """``(key, place, letter, score)`` for every background letter: log2 odds of shares mixed with the background, in a byte.

    The background's part falls with a place's diversity.
    """
    mixed = diversity(shares).withColumn("tau", F.least(F.lit(1.0), ADMIX_A / (1 + F.col("neff") / ADMIX_B)))
    # one row per place and letter of a fixed alphabet
    dense = mixed.join(F.broadcast(background.select("letter", F.col("share").alias("p"))), F.lit(True)).join(shares, ["key", "place", "letter"], "left")
    q = (1 - F.col("tau")) * F.coalesce("share", F.lit(0.0)) + F.col("tau") * F.col("p")
    score = F.round(F.log2(q / F.col("p")) * scale)
    return dense.select("key", "place", "letter", F.least(F.greatest(score, F.lit(-128.0)), F.lit(127.0)).cast("int").alias("score"))


def consensus(counted: DataFrame) -> DataFrame:
    """``(key, seq)``: per place the most frequent letter (ties: the first in the alphabet)."""
    best = counted.groupBy("key", "place").agg(F.min(F.struct((-F.col("n")).alias("o"), "letter"))["letter"].alias("letter"))
    return best.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "letter"))), lambda x: x["letter"]), "").alias("seq"))


def member_scores(star: DataFrame, scores: DataFrame) -> DataFrame:
    """``(key, member, score, covered)``: each member against the key's log odds."""
    return star.where("letter != '-'").join(scores, ["key", "place", "letter"]).groupBy("key", "member").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("covered"))


def pick_representative(scored: DataFrame) -> DataFrame:
    """``(key, member)`` with the best score (ties: more covered, the key itself, the smaller id)."""
    order = F.struct((-F.col("score")).alias("s"), (-F.col("covered")).alias("c"), (F.col("key") != F.col("member")).alias("o"), F.col("member").alias("m"))
    return scored.groupBy("key").agg(F.min(order)["m"].alias("member"))


# --- profiles of alignments without gaps, an entry at a time


def packed_star(hits: DataFrame, sequences: DataFrame) -> DataFrame:
    """``(key, start, text, n, member, own)``: the rows of ``star_ungapped`` in one piece, equal ones once.

    n: how many members have it; member: the smallest of them; own: 1 if the key is one.
    """
    hits = materialise(hits.select("key", "target", "qstart", "qend", "tstart"))
    texts = hits.join(sequences.select(F.col("key").alias("target"), "seq"), "target")
    part = F.substring(F.col("seq"), (F.col("tstart") + 1).cast("int"), (F.col("qend") - F.col("qstart") + 1).cast("int"))
    rows = texts.select("key", F.col("target").alias("member"), F.col("qstart").cast("long").alias("start"), part.alias("text"))
    own = sequences.join(hits.select("key").distinct(), "key", "left_semi").select("key", F.col("key").alias("member"), F.lit(0).cast("long").alias("start"), F.col("seq").alias("text"))
    whole = rows.unionByName(own).where("text != ''").repartition("key")
    return whole.groupBy("key", "start", "text").agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("member"), F.max((F.col("key") == F.col("member")).cast("int")).alias("own"))


def _entry(table: pa.Table, letters: str, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of an entry's packed rows: places with a letter, their diversity and log odds, and each row's places and letters."""
    texts, starts, n = table.column("text").to_pylist(), table.column("start").to_pylist(), table.column("n").to_numpy()
    codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    alphabet = np.unique(np.concatenate([np.unique(c) for c in codes]))
    kinds = [np.searchsorted(alphabet, c) for c in codes]
    size = max(a + len(c) for a, c in zip(starts, codes, strict=True))
    count = np.zeros((size, len(alphabet)))
    spans = [np.arange(a, a + len(c)) for a, c in zip(starts, codes, strict=True)]
    for at, kind, many in zip(spans, kinds, n, strict=True):
        count[at, kind] += many
    rarity = count * (count > 0).sum(1)[:, None]
    weight = np.array([(1 / (rarity[at, kind] * (len(at) + 30))).sum() for at, kind in zip(spans, kinds, strict=True)])
    weight /= (weight * n).sum()
    share = np.zeros_like(count)
    for at, kind, w in zip(spans, kinds, weight * n, strict=True):
        share[at, kind] += w
    held = np.flatnonzero(count.any(axis=1))
    share = share[held] / share[held].sum(1, keepdims=True)
    neff = np.exp(-(share * np.log(np.where(share > 0, share, 1.0))).sum(1))
    tau = np.minimum(1.0, ADMIX_A / (1 + neff / ADMIX_B))[:, None]
    wide = np.zeros((len(held), len(letters)))
    order = np.array([ord(c) for c in letters], np.uint32)
    at = np.minimum(np.searchsorted(alphabet, order), len(alphabet) - 1)
    known = alphabet[at] == order
    wide[:, known] = share[:, at[known]]
    odds = np.log2(((1 - tau) * wide + tau * p) / p) * 8.0
    score = np.clip(np.copysign(np.floor(np.abs(odds) + 0.5), odds), -128, 127).astype(np.int32)
    places = np.full(size, -1)
    places[held] = np.arange(len(held))
    column = np.full(len(alphabet), -1)
    column[at[known]] = np.flatnonzero(known)
    return held, neff, score, [places[x] for x in spans], [column[k] for k in kinds]


def packed_profile(packed: DataFrame, background: DataFrame, give: str) -> DataFrame:
    """What ``packed_star`` rows make, an entry a group: nothing the size of letters times members is shuffled.

    give: ``scores`` ``(key, place, scores)``, the log odds of the background's letters in their order; ``neff`` ``(key, place, neff)``; or
    ``best`` ``(key, member)``, as ``pick_representative`` chooses.  A group holds an entry's different rows.
    """
    listed = sorted((r["letter"], r["share"]) for r in background.collect())
    letters, p = "".join(x for x, _ in listed), np.array([y for _, y in listed])

    def made(table: pa.Table) -> pa.Table:
        held, neff, score, places, columns = _entry(table, letters, p)
        key = table.column("key")[0].as_py()
        if give == "best":
            told = []
            for at, kind, member, own in zip(places, columns, table.column("member").to_pylist(), table.column("own").to_pylist(), strict=True):
                good = kind >= 0
                told.append((-int(score[at[good], kind[good]].sum()), -int(good.sum()), 0 if own else 1, key if own else member))
            return pa.table({"key": pa.array([key], pa.int64()), "member": pa.array([min(told)[3]], pa.int64())})
        keys, where = pa.array(np.full(len(held), key, np.int64)), pa.array(held.astype(np.int64))
        if give == "neff":
            return pa.table({"key": keys, "place": where, "neff": pa.array(neff)})
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, score.size + 1, len(letters) or 1, dtype=np.int32)), pa.array(score.ravel()))
        return pa.table({"key": keys, "place": where, "scores": rows})

    schema = {"best": "key long, member long", "neff": "key long, place long, neff double", "scores": "key long, place long, scores array<int>"}[give]
    return packed.groupBy("key").applyInArrow(made, schema)


def spread_scores(rows: DataFrame, background: DataFrame) -> DataFrame:
    """``(key, place, letter, score)`` of the ``scores`` of ``packed_profile``."""
    letters = F.array(*[F.lit(x) for x in sorted(r["letter"] for r in background.collect())])
    return rows.select("key", "place", F.posexplode("scores").alias("__i", "score")).select("key", "place", F.get(letters, F.col("__i")).alias("letter"), "score")


def codon_rows_ungapped(hits: DataFrame, codons: DataFrame, sequences: DataFrame) -> DataFrame:
    """``codon_rows`` of alignments without gaps: each member's stretch of codons, cut out whole."""
    hits = materialise(hits.select("key", "target", "qstart", "qend", "tstart"))
    sizes = sequences.select("key", F.length("seq").cast("long").alias("__n"))
    own = sizes.where("__n > 0").join(hits.select("key").distinct(), "key", "left_semi").select("key", F.col("key").alias("target"), F.lit(0).cast("long").alias("qstart"), (F.col("__n") - 1).alias("qend"), F.lit(0).cast("long").alias("tstart"))
    texts = hits.unionByName(own).join(sizes, "key").join(codons.select(F.col("key").alias("target"), F.col("seq").alias("c")), "target")
    part = F.substring(F.col("c"), (F.col("tstart") * 3 + 1).cast("int"), ((F.col("qend") - F.col("qstart") + 1) * 3).cast("int"))
    gaps = lambda n: F.repeat(F.lit("---"), n.cast("int"))
    return texts.select("key", F.col("target").alias("member"), F.concat(gaps(F.col("qstart")), part, gaps(F.col("__n") - 1 - F.col("qend"))).alias("row"))


def filter_msa(rows: DataFrame, least_coverage: float = 0.0, least_identity: float = 0.0, most_identity: float = 0.9, least_score: float = -50.0, diff: int = 0, match: float = 2.0, mismatch: float = -1.0) -> DataFrame:
    """``(key, member)``: alignment rows ``(key, member, row)`` without what is alike, the key's own row always kept.

    A member must cover the key's letters, resemble it, and score ``least_score`` a column with it at least.  Then members are taken
    from the longest on (ties: the smaller id) when their identity with each one taken so far is at most ``most_identity``.
    With ``diff``, the bound starts low and rises in steps until so many rows are taken (or ``most_identity`` is reached), so the most
    different rows come first.  An entry's rows are one alignment, as wide as the key and as long as the search's best hits.
    """

    def chosen(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("member").reset_index(drop=True)
        width = max(map(len, table["row"]), default=0)
        codes = np.array([np.frombuffer(r.ljust(width, "-").encode("utf-32-le"), np.int32) for r in table["row"]]).reshape(len(table), width)
        letters = codes != ord("-")
        own = table.index[table["member"] == key[0]]
        first = int(own[0]) if len(own) else int(letters.sum(1).argmax())
        both = letters & letters[first]
        same = (both & (codes == codes[first])).sum(1)
        size = np.maximum(1, both.sum(1))
        good = (both.sum(1) >= least_coverage * letters[first].sum()) & (same >= least_identity * size) & (same * match + (both.sum(1) - same) * mismatch >= least_score * size)
        order = [i for i in sorted(range(len(table)), key=lambda i: (-letters[i].sum(), i)) if good[i] and i != first]
        taken = [first]
        bounds = [most_identity] if not diff else [b for b in np.arange(min(0.3, most_identity), most_identity, 0.05)] + [most_identity]
        for bound in bounds:
            for i in order:
                if i not in taken:
                    shared = letters[taken] & letters[i]
                    alike = (shared & (codes[taken] == codes[i])).sum(1) / np.maximum(1, shared.sum(1))
                    if (alike <= bound).all():
                        taken.append(i)
            if diff and len(taken) >= diff:
                break
        return pd.DataFrame({"key": key[0], "member": table["member"].iloc[sorted(taken)]})

    return rows.groupBy("key").applyInPandas(chosen, "key long, member long")


def filter_members(star: DataFrame, least_coverage: float = 0.0, least_identity: float = 0.0, most_identity: float = 1.0) -> DataFrame:
    """``(key, member, coverage, identity)`` of members that cover and resemble the key enough, without repeats.

    Of members with the same letters at the same places the smallest stays; members more identical to the key than
    ``most_identity`` go, but the key itself stays.
    """
    own = star.where("key = member").select("key", "place", F.col("letter").alias("__k"))
    joined = star.where("letter != '-'").join(own, ["key", "place"])
    sizes = own.groupBy("key").agg(F.count(F.lit(1)).alias("__n"))
    told = joined.groupBy("key", "member").agg(F.count(F.lit(1)).alias("c"), F.sum((F.col("letter") == F.col("__k")).cast("long")).alias("i"), F.sum(F.xxhash64("place", "letter").cast("decimal(38,0)")).alias("h")).join(sizes, "key")
    named = told.select("key", "member", (F.col("c") / F.col("__n")).alias("coverage"), (F.col("i") / F.col("c")).alias("identity"), "h")
    good = named.where(((F.col("coverage") >= least_coverage) & (F.col("identity") >= least_identity) & (F.col("identity") <= most_identity)) | (F.col("key") == F.col("member")))
    first = F.row_number().over(Window.partitionBy("key", "h", "coverage").orderBy(F.col("key") != F.col("member"), "member"))
    return good.withColumn("__r", first).where("__r = 1").select("key", "member", "coverage", "identity")


def representative_sequence(star: DataFrame) -> DataFrame:
    """``(key, seq)``: the key's own letters in a star alignment, in order."""
    own = star.where("key = member and letter != '-'").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "letter"))).alias("r"))
    return own.select("key", F.array_join(F.transform("r", lambda x: x["letter"]), "").alias("seq"))


def codon_rows(star: DataFrame, codons: DataFrame, sequences: DataFrame) -> DataFrame:
    """``(key, member, row)``: the alignment's rows with each letter as its codon, three gaps for a gap.

    codons: ``(key, seq)`` of the members' nucleotides, three for each letter of their sequence, read on as letters are laid out.
    """
    letters = star.where("letter != '-'")
    first = letters.groupBy("key", "member").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "letter"))), lambda x: x["letter"]), "").alias("part"), F.array_sort(F.collect_list("place")).alias("places"))
    whole = sequences.select(F.col("key").alias("member"), F.col("seq").alias("s")).join(codons.select(F.col("key").alias("member"), F.col("seq").alias("c")), "member")
    laid = first.join(whole, "member").withColumn("at", F.instr("s", F.col("part")) - 1).join(sequences.select("key", F.length("seq").alias("n")), "key")
    before = lambda i: F.when(i > 0, F.get("places", i - 1)).otherwise(-1)
    body = F.array_join(F.transform("places", lambda p, i: F.concat(F.repeat(F.lit("---"), (p - before(i) - 1).cast("int")), F.substring(F.col("c"), ((F.col("at") + i) * 3 + 1).cast("int"), F.lit(3)))), "")
    return laid.select("key", "member", F.rpad(body, F.col("n") * 3, F.lit("-")).alias("row"))
