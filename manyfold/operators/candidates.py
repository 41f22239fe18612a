"""Candidate pairs of similar sequences: joins on shared k-mers, and scores along diagonals.

Sequences are tables ``(key, seq)``.  A diagonal is the place in the query less the place in the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manyfold.functions.predicates import can_be_covered
from manyfold.functions.sequence import kmers

MATCH, MISMATCH = 2, -1
#: Base of the rolling hash: an odd number with mixed bits.
ROLL = 0x9E3779B97F4A7C15
#: Distinct words of the queries that are broadcast to thin out the targets' words, 8 bytes each; with more, nothing is broadcast.
BROADCAST_WORDS = 1 << 22
#: Letters of queries that are broadcast at once by the exhaustive scans.
QUERY_BLOCK = 1 << 20


def _hash(word: Column, how: str) -> Column:
    return F.md5(word) if how == "md5" else F.xxhash64(word)


def encode(seq: str) -> np.ndarray:
    """Code points of a sequence, ASCII letters in upper case."""
    codes = np.frombuffer(seq.encode("utf-32-le", "surrogatepass"), np.int32)
    return np.where((codes >= 97) & (codes <= 122), codes - 32, codes)


def rolling_hashes(seq: str, k: int) -> np.ndarray:
    """The hash of every word of length k: its letters as digits to the base ROLL, modulo 2 ** 64."""
    letters = np.frombuffer(seq.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(letters) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = letters[:n].copy()
    for j in range(1, k):
        out *= np.uint64(ROLL)
        out += letters[j:j + n]
    return out


def lowest_kmers(table: DataFrame, k: int, per_sequence: int, scale: float = 0.0) -> DataFrame:
    """``(key, length, kmer, place)``: each sequence's distinct k-mers with the lowest rolling hashes, at their first place.

    ``per_sequence`` of them, and ``scale`` more per letter.  They are chosen within the row, so only they are shuffled; a
    batch of rows is hashed by vector operations, in time linear in its letters.
    """

    @F.arrow_udf("array<struct<kmer:string,place:long>>")
    def chosen(seqs: pa.Array) -> pa.Array:
        rows = []
        for seq in seqs.to_pylist():
            _, first = np.unique(rolling_hashes(seq or "", k), return_index=True)
            rows.append([{"kmer": seq[p:p + k], "place": p} for p in first[:per_sequence + int(len(seq or "") * scale)].tolist()])
        return pa.array(rows, pa.list_(pa.struct([("kmer", pa.string()), ("place", pa.int64())])))

    return table.select("key", F.length("seq").cast("long").alias("length"), F.inline(chosen(F.col("seq")))).select("key", "length", "kmer", "place")


def centres(chosen: DataFrame) -> DataFrame:
    """Per k-mer the longest sequence (ties: smaller key, place): ``(kmer, centre, centre_length, centre_place)``."""
    best = F.min(F.struct((-F.col("length")).alias("l"), F.col("key").alias("k"), F.col("place").alias("p")))
    return chosen.groupBy("kmer").agg(best.alias("b")).select("kmer", F.col("b.k").alias("centre"), (-F.col("b.l")).alias("centre_length"), F.col("b.p").alias("centre_place"))


def _best_diagonals(pairs: DataFrame, least: int = 1) -> DataFrame:
    """``(key, target, score, diagonal)``: number of shared k-mers and the diagonal with most of them (ties: the largest).

    Pairs without ``least`` of them on that diagonal go.
    """
    counted = pairs.groupBy("key", "target", "diagonal").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("key", "target").agg(F.sum("n").alias("score"), F.max(F.struct("n", "diagonal")).alias("b"))
    return best.where(F.col("b.n") >= least).select("key", "target", "score", "b.diagonal")


def match_kmers(table: DataFrame, k: int = 10, per_sequence: int = 21, scale: float = 0.0, share: float = 0.0, mode: int = 0, least: int = 1) -> DataFrame:
    """Linear-time self-join: every sequence meets only the centre of each of its chosen k-mers.

    Returns ``(key, target, score, diagonal)`` with key the centre.  A k-mer that a third of all sequences share costs one
    row for each of them: centres are map-side minima, and the join back is a plain equi-join that adaptive execution splits.
    """
    chosen = lowest_kmers(table, k, per_sequence, scale)
    joined = chosen.join(centres(chosen), "kmer").where("key != centre")
    fits = can_be_covered(share, mode, F.col("centre_length"), F.col("length"))
    return _best_diagonals(joined.where(fits).select(F.col("centre").alias("key"), F.col("key").alias("target"), (F.col("centre_place") - F.col("place")).alias("diagonal")), least)


def kmer_index(table: DataFrame, k: int = 10, per_sequence: int = 21, scale: float = 0.0) -> DataFrame:
    """The targets' side of ``search_kmers``, reduced to centres; to be written as a table bucketed by ``kmer``."""
    return centres(lowest_kmers(table, k, per_sequence, scale))


def search_kmers(queries: DataFrame, index: DataFrame, k: int = 10, per_sequence: int = 21, scale: float = 0.0) -> DataFrame:
    """Queries against a k-mer index: ``(key, target, score, diagonal)``."""
    joined = lowest_kmers(queries, k, per_sequence, scale).join(index, "kmer")
    return _best_diagonals(joined.select("key", F.col("centre").alias("target"), (F.col("place") - F.col("centre_place")).alias("diagonal")))


def neighbours(table: DataFrame, alphabet: str, mismatches: int = 1) -> DataFrame:
    """``(key, place, kmer)`` with every word within one mismatch of the table's words added (0: the words themselves)."""
    if mismatches == 0:
        return table
    size = F.length("kmer")
    letters = F.array(*map(F.lit, alphabet))
    changed = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(letters, lambda c: F.concat(F.substring(F.col("kmer"), F.lit(1), i - 1), c, F.substring(F.col("kmer"), i + 1, size)))))
    return table.select("key", "place", F.explode(F.array_distinct(changed)).alias("kmer"))


def _shared_hashes(wanted: DataFrame, k: int) -> Broadcast | None:
    """The sorted hashes of the words ``wanted`` (``kmer``), for every task; None if they are more than BROADCAST_WORDS."""

    @F.arrow_udf("long")
    def hashed(given: pa.Array) -> pa.Array:
        letters = rolling_hashes("".join(given.to_pylist()), k)
        return pa.array(letters[::k].view(np.int64) if len(given) else [], pa.int64())

    listed = wanted.select(hashed(F.col("kmer")).alias("h")).distinct().limit(BROADCAST_WORDS + 1).toArrow().column("h").to_numpy()
    return wanted.sparkSession.sparkContext.broadcast(np.sort(listed.view(np.uint64))) if len(listed) <= BROADCAST_WORDS else None


def wanted_words(queries: DataFrame, k: int, shared: Broadcast) -> DataFrame:
    """``(key, place, kmer)``: of the queries' words at all places those whose hash is one of ``shared``."""

    @F.arrow_udf("array<struct<place:long,kmer:string>>")
    def words(seqs: pa.Array) -> pa.Array:
        known, rows = shared.value, []
        for seq in seqs.to_pylist():
            found = rolling_hashes(seq or "", k)
            at = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
            rows.append([{"place": p, "kmer": seq[p:p + k]} for p in (np.flatnonzero(known[at] == found).tolist() if len(known) else [])])
        return pa.array(rows, pa.list_(pa.struct([("place", pa.int64()), ("kmer", pa.string())])))

    return queries.select("key", F.inline(words(F.col("seq"))))


def target_words(targets: DataFrame, k: int, wanted: DataFrame | None = None) -> DataFrame:
    """``(target, kmer, at)``: the distinct words of each target at their first place; of ``wanted`` words (``kmer``) alone, if given.

    Wanted words are broadcast as sorted hashes where they are at most BROADCAST_WORDS, so that a word no query has never leaves
    its row; the equi-join that follows removes what only shares a hash.
    """
    shared = None if wanted is None else _shared_hashes(wanted, k)

    @F.arrow_udf("array<struct<kmer:string,at:long>>")
    def words(seqs: pa.Array) -> pa.Array:
        known, rows = shared.value if shared else None, []
        for seq in seqs.to_pylist():
            found, first = np.unique(rolling_hashes(seq or "", k), return_index=True)
            if known is not None:
                at = np.searchsorted(known, found)
                first = first[(at < len(known)) & (known[np.minimum(at, max(0, len(known) - 1))] == found)] if len(known) else first[:0]
            rows.append([{"kmer": seq[p:p + k], "at": p} for p in first.tolist()])
        return pa.array(rows, pa.list_(pa.struct([("kmer", pa.string()), ("at", pa.int64())])))

    return targets.select(F.col("key").alias("target"), F.inline(words(F.col("seq"))))


def shared_diagonals(queries: DataFrame, targets: DataFrame, k: int, least: int = 2, alphabet: str | None = None) -> DataFrame:
    """``(key, target, diagonal, n)`` of the diagonals with at least ``least`` words in common.

    A target's word counts at its first place, as an index holds it once a sequence.
    """
    words, letters = kmers(queries, k), F.coalesce(F.sum(F.length("seq")), F.lit(0))
    own, thinned = neighbours(words, alphabet) if alphabet else words, None
    # many queries in few targets: the queries' words are thinned out, by the targets' words
    if not alphabet and (size := queries.agg(letters).first()[0]) > BROADCAST_WORDS and targets.agg(letters).first()[0] < size:
        held = target_words(targets, k)
        if (shared := _shared_hashes(held, k)) is not None:
            thinned = wanted_words(queries, k, shared).join(held, "kmer")
    hits = thinned if thinned is not None else own.join(target_words(targets, k, own), "kmer")
    return hits.groupBy("key", "target", (F.col("place") - F.col("at")).cast("long").alias("diagonal")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def match_diagonals(queries: DataFrame, targets: DataFrame, k: int = 6, least: int = 2, most: int = 300, alphabet: str | None = None, match: int = MATCH, mismatch: int = MISMATCH, least_score: int = 15) -> DataFrame:
    """Targets with at least ``least`` k-mer matches on one diagonal, scored without gaps: ``(key, target, score, diagonal)``.

    With an ``alphabet`` a query's words also match those within one mismatch.  A pair's diagonals are listed before its texts
    are joined, so texts travel once a pair.  The best diagonal is kept (ties: the largest), then the ``most`` best
    targets of each query, as the operator is a top-k search.
    """

    @F.arrow_udf("struct<score:long,diagonal:long>")
    def best_of(qs: pa.Array, ts: pa.Array, diagonals: pa.Array) -> pa.Array:
        rows = []
        for q, t, listed in zip(qs.to_pylist(), ts.to_pylist(), diagonals.to_pylist(), strict=True):
            a, b = encode(q or ""), encode(t or "")
            rows.append(max((diagonal_score(a, b, d, match, mismatch)["score"], d) for d in listed))
        return pa.array([{"score": v, "diagonal": d} for v, d in rows], pa.struct([("score", pa.int64()), ("diagonal", pa.int64())]))

    pairs = shared_diagonals(queries, targets, k, least, alphabet).groupBy("key", "target").agg(F.collect_list("diagonal").alias("diagonals"))
    texts = pairs.join(queries.select("key", F.col("seq").alias("q")), "key").join(targets.select(F.col("key").alias("target"), F.col("seq").alias("t")), "target")
    best = texts.select("key", "target", best_of(F.col("q"), F.col("t"), F.col("diagonals")).alias("b")).select("key", "target", "b.score", "b.diagonal").where(F.col("score") >= least_score)
    order = Window.partitionBy("key").orderBy(F.desc("score"), "target")
    return best.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= most).drop("__rank")


def diagonal_score(query: np.ndarray, target: np.ndarray, diagonal: int, match: int = MATCH, mismatch: int = MISMATCH) -> dict[str, int]:
    """Of one diagonal: equal letters, overlap, score of the whole and of its best stretch, which ends where that is first reached.

    A running sum falls back to zero; the stretch's places are on the overlap and closed, -1 without any match.
    """
    q0, t0 = max(diagonal, 0), max(-diagonal, 0)
    size = max(0, min(len(query) - q0, len(target) - t0))
    same = query[q0:q0 + size] == target[t0:t0 + size]
    out = {"identical": int(same.sum()), "overlap": size, "whole": 0, "score": 0, "start": -1, "end": -1, "q0": q0, "t0": t0}
    if size:
        total = np.cumsum(np.where(same, match, mismatch))
        lowest = np.minimum(0, np.minimum.accumulate(np.concatenate(([0], total[:-1]))))
        run = total - lowest
        end = int(run.argmax())
        out["whole"] = int(total[-1])
        if run[end] > 0:
            before = np.flatnonzero(total[:end] == lowest[end])
            out |= {"score": int(run[end]), "start": int(before[-1]) + 1 if len(before) else 0, "end": end}
    return out


def _overlap(query: Column, target: Column, diagonal: Column) -> tuple[Column, Column, Column]:
    """Start in the query, start in the target and length of a diagonal's overlap."""
    q0, t0 = F.greatest(diagonal, F.lit(0)), F.greatest(-diagonal, F.lit(0))
    return q0, t0, F.greatest(F.least(F.length(query) - q0, F.length(target) - t0), F.lit(0))


def _aligned(query: Column, target: Column, diagonal: Column) -> Column:
    """An array of truths: where a diagonal's letters are the same, whatever their case."""
    q0, t0, size = _overlap(query, target, diagonal)
    cut = lambda s, at: F.split(F.upper(F.substring(s, (at + 1).cast("int"), size.cast("int"))), "")
    same = F.zip_with(cut(query, q0), cut(target, t0), lambda a, b: a == b)
    return F.when(size > 0, same).otherwise(F.array().cast("array<boolean>"))


def identical_places(query: Column, target: Column, diagonal: Column) -> Column:
    """Number of equal letters on a diagonal."""
    return F.size(F.filter(_aligned(query, target, diagonal), lambda x: x)).cast("long")


def rescore_diagonals(pairs: DataFrame, queries: DataFrame, targets: DataFrame, match: int = MATCH, mismatch: int = MISMATCH) -> DataFrame:
    """Ungapped alignments of candidate pairs: ``(key, target, diagonal, identical, overlap, whole, score, qstart, qend, qlen, tstart, tend, tlen)``."""
    names = ("identical", "overlap", "whole", "score", "start", "end", "q0", "t0")

    @F.arrow_udf("struct<" + ",".join(f"{n}:long" for n in names) + ">")
    def scored(qs: pa.Array, ts: pa.Array, diagonals: pa.Array) -> pa.Array:
        rows = [diagonal_score(encode(q or ""), encode(t or ""), d, match, mismatch) for q, t, d in zip(qs.to_pylist(), ts.to_pylist(), diagonals.to_pylist(), strict=True)]
        return pa.array(rows, pa.struct([(n, pa.int64()) for n in names]))

    texts = pairs.select("key", "target", "diagonal").join(queries.select("key", F.col("seq").alias("q")), "key").join(targets.select(F.col("key").alias("target"), F.col("seq").alias("t")), "target")
    found = texts.select("key", "target", "diagonal", scored(F.col("q"), F.col("t"), F.col("diagonal")).alias("l"), F.length("q").cast("long").alias("qlen"), F.length("t").cast("long").alias("tlen"))
    return found.select(
        "key", "target", "diagonal", "l.identical", "l.overlap", "l.whole", "l.score", (F.col("l.q0") + F.col("l.start")).alias("qstart"), (F.col("l.q0") + F.col("l.end")).alias("qend"), "qlen", (F.col("l.t0") + F.col("l.start")).alias("tstart"), (F.col("l.t0") + F.col("l.end")).alias("tend"), "tlen"
    )


# --- exhaustive scans: a stated set of queries against all targets


def ungapped_scores(query: np.ndarray, targets: list[np.ndarray], match: int = MATCH, mismatch: int = MISMATCH) -> np.ndarray:
    """Best ungapped score of a query with each target: all targets stand in one row, cut by letters that match nothing."""
    row = np.concatenate([x for t in targets for x in (np.array([-1], np.int32), t)])
    starts = np.cumsum([0] + [len(t) + 1 for t in targets[:-1]])
    most = len(query) * max(match, 0)
    kind = np.int16 if most < 8000 else np.int32
    cut = -most - 1
    gains = {}
    for letter in np.unique(query).tolist():
        gain = gains[letter] = np.where(row == letter, match, mismatch).astype(kind)
        gain[row == -1] = cut  # no run is long enough to survive it
    best, run, new = (np.zeros(len(row), kind) for _ in range(3))
    for letter in query.tolist():
        gain = gains[letter]
        np.add(gain[1:], run[:-1], out=new[1:])
        new[0] = gain[0]
        np.maximum(new, 0, out=run)
        np.maximum(best, run, out=best)
    return np.maximum.reduceat(best, starts)


def query_blocks(queries: DataFrame, most: int = QUERY_BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The stated queries in blocks of at most ``most`` letters (a longer one alone)."""
    block, size = [], 0
    for key, seq in queries.select("key", "seq").toLocalIterator():
        if block and size + len(seq or "") > most:
            yield block
            block, size = [], 0
        block.append((key, seq or ""))
        size += len(seq or "")
    if block:
        yield block


def _scorer(shared, least_score: int, share: float, match: int, mismatch: int):
    """A column function: the scores of a sequence with the queries of a broadcast block."""

    @F.arrow_udf("array<struct<key:long,score:long>>")
    def scored(seqs: pa.Array) -> pa.Array:
        rows: list[list[dict]] = [[] for _ in range(len(seqs))]
        codes = [encode(s or "") for s in seqs.to_pylist()]
        for key, query in shared.value:
            fit = [i for i, c in enumerate(codes) if len(c) and min(len(c), len(query)) / max(len(c), len(query)) >= share]
            while fit:  # bounded rows
                some, size = [], 0
                while fit and (not some or size < 1 << 18):
                    some.append(fit.pop())
                    size += len(codes[some[-1]])
                for i, s in zip(some, ungapped_scores(query, [codes[i] for i in some], match, mismatch).tolist(), strict=True):
                    if s > least_score:
                        rows[i].append({"key": key, "score": s})
        return pa.array(rows, pa.list_(pa.struct([("key", pa.int64()), ("score", pa.int64())])))

    return scored


def scan_ungapped(queries: DataFrame, targets: DataFrame, least_score: int = 15, most: int = 300, share: float = 0.0, match: int = MATCH, mismatch: int = MISMATCH) -> DataFrame:
    """Best ungapped score over all diagonals of every query with every target that lengths allow; the best ``most`` each.

    Queries are broadcast in bounded blocks and targets stream past them; there is no join.  Scores must exceed the least.
    """
    spark, found = targets.sparkSession, None
    for block in query_blocks(queries):
        scored = _scorer(spark.sparkContext.broadcast([(k, encode(q)) for k, q in block if q]), least_score, share, match, mismatch)
        part = targets.select(F.col("key").alias("target"), F.inline(scored(F.col("seq")))).select("key", "target", "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "key long, target long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "target")
    return found.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= most).drop("__rank")
