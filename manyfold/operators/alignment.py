"""Local alignment with affine gaps, e-values, acceptance, and composition of alignments.

The kernel scores row by row: a row's horizontal gaps are one running maximum, so each row is a handful of vector
operations.  Every ``ROWS`` rows are kept on the way down; the path back recomputes the rows in between, so memory is
proportional to the length times its root, not to the product of the lengths.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manyfold.operators.candidates import encode, query_blocks, rolling_hashes

MATCH, MISMATCH, OPEN, EXTEND = 2, -1, 5, 2
ROWS = 128
LOW = -(1 << 28)

#: Gumbel parameters for (matrix, gap open, gap extend): lambda, K, then a, b, alpha, beta of both sides and sigma, tau.
GUMBEL = {
    ("nucleotide", 7, 1): (1.0960171987681839, 0.33538787507026158, 2.0290734315292083, -0.46514786408422282, 5.0543294182155085, 15.130999712620039, 5.0543962679167036, 15.129930117400917),
    ("nucleotide", 5, 2): (0.62092274139392822363, 0.35177597988201619872, 0.74528059208662511548, -0.71027220445456995535, 1.0135243407674570104, -2.5226486486783059604, 1.0031949332622873694, -2.3780369436059309862),
    ("blosum62", 11, 1): (0.27359865037097330642, 0.044620920658722244834, 1.5938724404943873658, -19.959867650284412122, 30.455610143099914211, -622.28684628915891608, 29.602444874818868215, -601.81087985041381216),
    ("blosum62", 0, 0): (0.3207378152604042354, 0.13904657125294345166, 0.76221128839920349041, 0.0, 4.5269915477182944841, 0.0, 4.5269915477182944841, 0.0),
}
LEAST_VARIANCE = 1e-10


def read_matrix(path: str) -> dict[tuple[str, str], int]:
    """A substitution matrix from a text file: ``#`` comments, a row of letters, then a letter and its scores per line."""
    with open(path) as lines:
        rows = [x.split() for x in lines if x.strip() and not x.startswith("#")]
    letters = rows[0]
    return {(r[0], c): round(float(v)) for r in rows[1:] for c, v in zip(letters, r[1:], strict=False)}


class Scoring:
    """Scores of letter pairs: a matrix, or one score for equal and one for different letters."""

    def __init__(self, match: int = MATCH, mismatch: int = MISMATCH, gap_open: int = OPEN, gap_extend: int = EXTEND, matrix: dict[tuple[str, str], int] | None = None):
        self.match, self.mismatch, self.open, self.extend, self.matrix = match, mismatch, gap_open, gap_extend, matrix

    def row(self, letter: int, target: np.ndarray) -> np.ndarray:
        if self.matrix is None:
            return np.where(target == letter, self.match, self.mismatch).astype(np.int32)
        known = {ord(b): v for (a, b), v in self.matrix.items() if ord(a) == letter}
        table = np.full(128, self.mismatch, np.int32)
        for code, v in known.items():
            table[code] = v
        return np.where(target < 128, table[np.minimum(target, 127)], self.mismatch).astype(np.int32)


def _step(s: Scoring, pairs: np.ndarray, above: np.ndarray, down: np.ndarray, ramp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row: best scores, scores ending in a gap in the target (down), and in the query (across)."""
    down = np.maximum(above[1:] - s.open, down - s.extend)
    best = np.zeros_like(above)
    row = best[1:]
    np.add(above[:-1], pairs, out=row)
    np.maximum(row, down, out=row)
    np.maximum(row, 0, out=row)
    # across[j] = max over k < j of best[k] - open - (j - k - 1) * extend, by a running maximum
    across = np.full_like(down, LOW)
    if len(across) > 1:
        lead = across[1:]
        np.add(row[:-1], ramp[:-1], out=lead)
        np.maximum.accumulate(lead, out=lead)
        np.subtract(lead, ramp[1:] + (s.open - s.extend), out=lead)
        np.maximum(row, across, out=row)
    return best, down, across


class _Rows(dict):
    """Scores of a query letter with the target, made when first asked for; only letters that can come again are kept."""

    def __init__(self, s: Scoring, target: np.ndarray):
        super().__init__()
        self.scoring, self.target = s, target

    def __missing__(self, letter: int) -> np.ndarray:
        row = self.scoring.row(letter, self.target)
        if len(self) < 256:
            self[letter] = row
        return row


def smith_waterman(query: np.ndarray, target: np.ndarray, s: Scoring | None = None) -> tuple[int, int, int, int, int, str]:
    """``(score, qstart, qend, tstart, tend, path)`` of the best local alignment; the first end in the query, then the target.

    path: M for a pair, I for a query letter alone, D for a target letter alone.  Without any score: zeros and -1.
    """
    s = s or Scoring()
    n, m = len(query), len(target)
    if not n or not m:
        return 0, -1, -1, -1, -1, ""
    ramp = np.arange(m, dtype=np.int32) * np.int32(s.extend)
    above, down = np.zeros(m + 1, np.int32), np.full(m, LOW, np.int32)
    profile = _Rows(s, target)
    letters = query.tolist()
    kept, best, end = {}, 0, (-1, -1)
    every = max(ROWS, int(math.isqrt(n)))
    for i in range(n):
        if i % every == 0:
            kept[i] = (above, down)
        above, down, _ = _step(s, profile[letters[i]], above, down, ramp)
        top = int(above.max())
        if top > best:
            best, end = top, (i, int(above.argmax()) - 1)
    if best == 0:
        return 0, -1, -1, -1, -1, ""
    i, j = end
    path, state, block = [], "M", None
    while True:
        first = i // every * every
        if block is None or block[0] != first:
            above, down = kept[first]
            tops, downs, acrosses = [above], [], []
            for r in range(first, min(first + every, n)):
                above, down, across = _step(s, profile[letters[r]], above, down, ramp)
                tops.append(above)
                downs.append(down)
                acrosses.append(across)
            block = (first, tops, downs, acrosses)
        _, tops, downs, acrosses = block
        here, r = int(tops[i - first + 1][j + 1]), i - first
        if state == "M":
            if here == 0:
                break
            pair = int(profile[letters[i]][j])
            if here == int(tops[r][j]) + pair:
                path.append("M")
                if int(tops[r][j]) == 0:
                    break
                i, j = i - 1, j - 1
                continue
            state = "I" if here == int(downs[r][j]) else "D"
        if state == "I":  # a query letter alone
            path.append("I")
            opened = int(tops[r][j + 1]) - s.open
            state = "M" if int(downs[r][j]) == opened else "I"
            i -= 1
        else:
            path.append("D")
            value = int(acrosses[r][j])
            opened = int(tops[r + 1][j]) - s.open
            state = "M" if value == opened else "D"
            j -= 1
    return best, i, end[0], j, end[1], "".join(reversed(path))


def compress(path: str) -> str:
    """Run lengths: MMMI becomes 3M1I."""
    return "".join(f"{len(m[0])}{m[1]}" for m in re.finditer(r"(.)\1*", path))


def expand(cigar: str) -> str:
    return "".join(c * int(n) for n, c in re.findall(r"(\d+)([MID])", cigar))


def evalue(score: float, query_length: int, residues: int, parameters: tuple[float, ...] = GUMBEL["nucleotide", 5, 2]) -> float:
    """Expected number of hits at least as good, with the finite-size correction of the Gumbel parameters."""
    lam, k, a, b, alpha, beta, sigma, tau = parameters

    def side(length: float) -> tuple[float, float, float]:
        rest, variance = length - (a * score + b), max(LEAST_VARIANCE, alpha * score + beta)
        x = rest / math.sqrt(variance)
        below = 0.5 * math.erfc(-x / math.sqrt(2))
        return rest * below + math.sqrt(variance) * math.exp(-x * x / 2) / math.sqrt(2 * math.pi), below, variance

    p1, m_below, _ = side(residues)
    p2, n_below, _ = side(query_length)
    area = p1 * p2 + max(LEAST_VARIANCE, sigma * score + tau) * m_below * n_below
    return area * k * math.exp(-lam * score)


def bit_score(score: float, parameters: tuple[float, ...] = GUMBEL["nucleotide", 5, 2]) -> float:
    return (parameters[0] * score - math.log(parameters[1])) / math.log(2)


_FIELDS = [("score", "long"), ("qstart", "long"), ("qend", "long"), ("tstart", "long"), ("tend", "long"), ("identity", "double"), ("length", "long"), ("evalue", "double"), ("bits", "long"), ("cigar", "string")]
ALIGNED = "struct<" + ",".join(f"{n}:{t}" for n, t in _FIELDS) + ">"


def _told(a: np.ndarray, b: np.ndarray, found: tuple[int, int, int, int, int, list[tuple[int, str]]], residues: int, parameters: tuple[float, ...]) -> dict:
    """The fields of an alignment, whose path is given in runs."""
    score, q0, q1, t0, t1, runs = found
    i, j, same = q0, t0, 0
    for n, c in runs:
        if c == "M":
            same += int((a[i:i + n] == b[j:j + n]).sum())
        i += n if c != "D" else 0
        j += n if c != "I" else 0
    length = sum(n for n, _ in runs)
    return {"score": score, "qstart": q0, "qend": q1, "tstart": t0, "tend": t1, "identity": same / length if length else 0.0, "length": length, "evalue": evalue(score, len(a), residues, parameters) if score else float("inf"), "bits": int(bit_score(score, parameters) + 0.5) if score else 0, "cigar": "".join(f"{n}{c}" for n, c in runs)}


def align_pair(query: str, target: str, s: Scoring, residues: int, parameters: tuple[float, ...]) -> dict:
    a, b = encode(query), encode(target)
    *ends, path = smith_waterman(a, b, s)
    return _told(a, b, (*ends, [(len(m[0]), m[1]) for m in re.finditer(r"(.)\1*", path)]), residues, parameters)


#: Cells that are held at once for a group of pairs in bands, for a pair alone, and in one row of a group.
BAND_CELLS, BAND_MOST, BAND_ROW = 1 << 24, 1 << 26, 1 << 14


def _contained(query: str, target: str, s: Scoring) -> tuple | None:
    """The alignment of a sequence with one that holds all of it: no other has all letters of the shorter one."""
    if not query or not target or not (query.isascii() and target.isascii()):
        return None
    q, t = query.upper(), target.upper()
    at = t.find(q) if len(q) <= len(t) else q.find(t)
    if at < 0:
        return None
    n = min(len(q), len(t))
    i, j = (0, at) if len(q) <= len(t) else (at, 0)
    return s.match * n, i, i + n - 1, j, j + n - 1, [(n, "M")]


def _likely_band(query: str, target: str, k: int = 8) -> tuple[int, int] | None:
    """Diagonals (place in the target less that in the query) of most shared words; only a first guess."""
    left, right = rolling_hashes(query.upper(), k), rolling_hashes(target.upper(), k)
    if not len(left) or not len(right):
        return None
    known, first = np.unique(right, return_index=True)
    at = np.minimum(np.searchsorted(known, left), len(known) - 1)
    hit = np.flatnonzero(known[at] == left)
    if not len(hit):
        return None
    diagonals = np.sort(first[at[hit]] - hit)
    low, high = int(diagonals[len(diagonals) // 50]), int(diagonals[-1 - len(diagonals) // 50])
    if high - low > max(64, min(len(query), len(target)) // 4):
        values, counts = np.unique(diagonals, return_counts=True)
        low = high = int(values[counts.argmax()])
    return low - 16, high + 16


def _needed_band(n: int, m: int, score: int, s: Scoring) -> tuple[int, int]:
    """All diagonals that an alignment of at least this score can touch: on the d-th, n + d letters of one side can be paired at most, and m - d."""
    least = -(-score // s.match)
    return least - n, m - least


def _in_bands(group: list[tuple[np.ndarray, np.ndarray, int, int]], s: Scoring, path: Callable[[int, int], bool]) -> list[tuple]:
    """``smith_waterman`` of several pairs at once, each on the diagonals of its band: ``(score, qstart, qend, tstart, tend, runs)``.

    The path is followed where ``path(place in the group, score)`` says so; runs are None elsewhere.  A cell of the best path has its
    true score if the band holds all of them, and a neighbour whose score is too low can't be taken for one.
    """
    many, rows = len(group), max(len(a) for a, *_ in group)
    width = max(high - low + 1 for *_, low, high in group)
    query, target = np.full((many, rows), -2, np.int32), np.full((many, rows + width), -1, np.int32)
    for p, (a, b, low, _) in enumerate(group):
        query[p, :len(a)] = a
        begin, end = max(0, low), min(len(b), rows + width + low)
        target[p, begin - low:end - low] = b[begin:end]
    kind = np.int16 if s.match * max(min(len(a), len(b)) for a, b, *_ in group) + s.extend * width + s.open < 20_000 else np.int32
    held = np.zeros((rows + 1, many, width), kind)
    down, ramp = np.full((many, width), -9999, kind), (np.arange(width) * s.extend).astype(kind)
    gain, lead = np.empty((many, width), kind), np.empty((many, width), kind)
    best, end_row, end_column = np.zeros(many, np.int64), np.full(many, -1), np.full(many, -1)
    step, back = kind(s.match - s.mismatch), ramp[1:] + kind(s.open - s.extend)
    for i in range(rows):
        above, row = held[i], held[i + 1]
        np.multiply(target[:, i:i + width] == query[:, i:i + 1], step, out=gain)
        gain += kind(s.mismatch)
        np.add(above, gain, out=row)
        down[:, :-1] = np.maximum(above[:, 1:] - kind(s.open), down[:, 1:] - kind(s.extend))
        down[:, -1] = -9999
        np.maximum(row, down, out=row)
        np.maximum(row, 0, out=row)
        np.add(row, ramp, out=lead)
        np.maximum.accumulate(lead, axis=1, out=lead)
        np.maximum(row[:, 1:], lead[:, :-1] - back, out=row[:, 1:])
        top = row.max(axis=1)
        more = np.flatnonzero(top > best)
        if len(more):
            best[more], end_row[more], end_column[more] = top[more], i, row[more].argmax(axis=1)
    out = []
    for p, (a, b, low, _) in enumerate(group):
        i, c, score = int(end_row[p]), int(end_column[p]), int(best[p])
        if not score or not path(p, score):
            out.append((score, -1, -1, -1, -1, None if score else []))
            continue
        runs, ends, going = [], (i, i + c + low), True
        while going:
            # along the diagonal as far as pairs make up the score
            first = max(0, i - 255)
            own = held[first:i + 2, p, c].astype(np.int64)
            t0 = first + c + low
            pair = np.full(i + 1 - first, s.mismatch)
            inside = max(0, -t0)  # rows before the target's first letter
            pair[inside:][a[first + inside:i + 1] == b[t0 + inside:t0 + i + 1 - first]] = s.match
            made = own[1:] == own[:-1] + pair
            # the run ends above the last row that isn't made by a pair, or with the last one that starts from nothing
            broken, started = np.flatnonzero(~made), np.flatnonzero(made & (own[:-1] == 0))
            b0, s0 = int(broken[-1]) if len(broken) else -1, int(started[-1]) if len(started) else -1
            if s0 > b0:
                runs.append((len(made) - s0, "M"))
                i, going = first + s0, False
                break
            if len(made) - 1 - b0:
                runs.append((len(made) - 1 - b0, "M"))
            i = first + b0
            if b0 < 0:
                continue
            here = int(own[b0 + 1])
            k = np.arange(1, min(i + 1, width - 1 - c) + 1)
            up = np.flatnonzero(held[i + 1 - k, p, c + k] - s.open - (k - 1) * s.extend == here) if len(k) else k
            if len(up):
                size = int(k[up[0]])
                runs.append((size, "I"))
                i, c = i - size, c + size
            else:
                k = np.arange(1, c + 1)
                size = int(k[np.flatnonzero(held[i + 1, p, c - k] - s.open - (k - 1) * s.extend == here)[0]])
                runs.append((size, "D"))
                c -= size
        joined: list[tuple[int, str]] = []
        for n, letter in reversed(runs):
            if joined and joined[-1][1] == letter:
                n += joined.pop()[0]
            joined.append((n, letter))
        out.append((score, i, ends[0], i + c + low, ends[1], joined))
    return out


def align_pairs(queries: list[str], targets: list[str], s: Scoring, residues: int, parameters: tuple[float, ...]) -> list[dict]:
    """``align_pair`` of every pair, the same results.

    A sequence that lies in the other whole needs no search.  Near copies are searched in bands, many pairs at once: first in a
    likely one, whose score tells the diagonals that the best alignment can touch, then in these unless that one held them.
    """
    out: list[dict | None] = [None] * len(queries)
    simple = type(s) is Scoring and s.matrix is None and s.match > 0 >= s.mismatch and s.open >= s.extend > 0
    codes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    waiting, again = [], []

    def narrow(n: int, m: int, low: int, high: int) -> bool:
        width = high - low + 1
        return width <= max(m, 64) and (n + 1) * width <= BAND_MOST

    def tell(at: int, found: tuple) -> None:
        out[at] = _told(*codes.get(at, (None, None)), found, residues, parameters) if at in codes else _told(encode(queries[at]), encode(targets[at]), found, residues, parameters)
        codes.pop(at, None)

    for at, (q, t) in enumerate(zip(queries, targets, strict=True)):
        found = _contained(q, t, s) if simple else None
        if found:
            tell(at, found)
            continue
        band = _likely_band(q, t) if simple and 2 * min(len(q), len(t)) > max(len(q), len(t)) and min(len(q), len(t)) >= 64 else None
        if band and narrow(len(q), len(t), *band):
            waiting.append((at, *band))
        else:
            out[at] = align_pair(q, t, s, residues, parameters)
    for last in (False, True):
        waiting.sort(key=lambda x: (len(queries[x[0]]) // 256, x[2] - x[1]))
        while waiting:
            group, rows, width = [], 0, 0
            while waiting:
                at, low, high = waiting[-1]
                r, w = max(rows, len(queries[at])), max(width, high - low + 1)
                if group and ((r + 1) * w * (len(group) + 1) > BAND_CELLS or w * (len(group) + 1) > BAND_ROW):
                    break
                rows, width = r, w
                group.append(waiting.pop())
                codes[at] = encode(queries[at]), encode(targets[at])

            def whole(p: int, score: int, group: list = group, last: bool = last) -> bool:
                at, low, high = group[p]
                need = _needed_band(len(queries[at]), len(targets[at]), score, s)
                return last or low <= need[0] and need[1] <= high

            for (at, _, _), found in zip(group, _in_bands([(*codes[at], low, high) for at, low, high in group], s, whole), strict=True):
                if found[5] is not None and (last or found[0]):
                    tell(at, found)
                else:
                    codes.pop(at)
                    low, high = _needed_band(len(queries[at]), len(targets[at]), max(1, found[0]), s)
                    if narrow(len(queries[at]), len(targets[at]), low, high):
                        again.append((at, low, high))
                    else:
                        out[at] = align_pair(queries[at], targets[at], s, residues, parameters)
        waiting, again = again, []
    return out


def aligned_column(query: Column, target: Column, residues: int, scoring: Scoring | None = None, parameters: tuple[float, ...] = GUMBEL["nucleotide", 5, 2]) -> Column:
    """A struct column with the alignment of two sequence columns; Arrow batches, one pair at a time."""
    s = scoring or Scoring()

    @F.arrow_udf(ALIGNED)
    def aligned(queries: pa.Array, targets: pa.Array) -> pa.Array:
        rows = []
        for at in range(0, len(queries), 1024):  # bounded texts
            some = [[x or "" for x in c.slice(at, 1024).to_pylist()] for c in (queries, targets)]
            rows += align_pairs(*some, s, residues, parameters)
        kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
        return pa.array(rows, pa.struct([(n, kinds[t]) for n, t in _FIELDS]))

    return aligned(query, target)


def align(pairs: DataFrame, queries: DataFrame, targets: DataFrame, most_evalue: float = 0.001, least_identity: float = 0.0, least_coverage: float = 0.0, least_length: int = 0, most_accepted: int | None = None, most_rejected: int | None = None, scoring: Scoring | None = None, residues: int | None = None) -> DataFrame:
    """Align candidate pairs ``(key, target, score)`` and keep those that meet the criteria (a sequence with itself always does).

    Candidates are tried in the order of their score; with ``most_accepted`` or ``most_rejected`` an entry ends after so
    many acceptances, or so many rejections in a row.
    """
    if residues is None:  # of the targets; a part of them can be given the number of the whole
        residues = int(targets.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0])
    texts = pairs.select("key", "target", F.col("score").alias("__given")).join(queries.select("key", F.col("seq").alias("__q")), "key").join(targets.select(F.col("key").alias("target"), F.col("seq").alias("__t")), "target")
    # pairs are dealt evenly, as a query may have most of them
    dealt = texts.repartition("key", "target")
    found = dealt.select("key", "target", "__given", F.length("__q").cast("long").alias("qlen"), F.length("__t").cast("long").alias("tlen"), aligned_column(F.col("__q"), F.col("__t"), residues, scoring).alias("a")).select("key", "target", "__given", "a.*", "qlen", "tlen")
    span = lambda a, b, n: (F.col(b) - F.col(a) + 1) / F.col(n)
    found = found.withColumn("qcov", span("qstart", "qend", "qlen")).withColumn("tcov", span("tstart", "tend", "tlen"))
    good = (F.col("evalue") <= most_evalue) & (F.col("identity") >= least_identity) & (F.least("qcov", "tcov") >= least_coverage) & (F.col("length") >= least_length) | (F.col("key") == F.col("target"))
    if most_accepted is None and most_rejected is None:
        return found.where(good).drop("__given")
    return stop_rule(found.withColumn("accepted", good), [F.desc("__given"), F.col("target")], most_accepted, most_rejected).where("accepted").drop("accepted", "__given")


def stop_rule(table: DataFrame, order: list[Column], most_accepted: int | None, most_rejected: int | None) -> DataFrame:
    """Rows before an entry's end: ``accepted`` counts from its start, rejections since the last acceptance."""
    upto = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(F.col("accepted").cast("int")).over(upto), F.lit(0))
    counted = table.withColumn("__taken", taken).withColumn("__place", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    island = Window.partitionBy("key", "__taken").orderBy("__place")
    # rejections since the last acceptance, and the most of any stretch up to here
    run = F.sum((~F.col("accepted")).cast("int")).over(island.rowsBetween(Window.unboundedPreceding, -1))
    counted = counted.withColumn("__run", F.coalesce(run, F.lit(0)))
    worst = F.max("__run").over(Window.partitionBy("key").orderBy("__place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    keep = F.lit(True)
    if most_accepted is not None:
        keep = keep & (F.col("__taken") < most_accepted)
    counted = counted.withColumn("__worst", worst)
    if most_rejected is not None:
        keep = keep & (F.col("__worst") < most_rejected)
    return counted.where(keep).drop("__taken", "__place", "__run", "__worst")


#: What two steps, query to middle and middle to target, make of one letter of the path.
_COMPOSED = {("M", "M"): "M", ("I", "M"): "I", ("D", "M"): "D", ("M", "D"): "D", ("D", "D"): "D", ("M", "I"): "I", ("I", "I"): "I"}


def compose(first: tuple[int, int, str], second: tuple[int, int, str]) -> tuple[int, int, str] | None:
    """Alignment A-C from A-B and B-C, each ``(start in one, start in other, path)``; None if they share no letter of B."""
    a, b1, path1 = first
    b2, c, path2 = second
    pairs1, pairs2 = {}, {}
    for letter in path1:
        if letter == "M":
            pairs1[b1] = a
        a += letter != "D"
        b1 += letter != "I"
    for letter in path2:
        if letter == "M":
            pairs2[b2] = c
        b2 += letter != "D"
        c += letter != "I"
    shared = sorted(pairs1.keys() & pairs2.keys())
    if not shared:
        return None
    out, last = [], None
    for b in shared:
        x, y = pairs1[b], pairs2[b]
        if last:
            out += ["I"] * (x - last[0] - 1) + ["D"] * (y - last[1] - 1)
        out.append("M")
        last = (x, y)
    return pairs1[shared[0]], pairs2[shared[0]], "".join(out)


def expand_alignments(first: DataFrame, second: DataFrame) -> DataFrame:
    """A-B joined with B-C: ``(key, target, via, qstart, qend, tstart, tend, cigar)``; pairs that share no letter of B go.

    Of overlapping alignments of the same pair only the first (smaller via, then earlier start) stays.
    """
    left = first.select("key", F.col("target").alias("via"), F.col("qstart").alias("a"), F.col("tstart").alias("b1"), F.col("cigar").alias("c1"))
    right = second.select(F.col("key").alias("via"), "target", F.col("qstart").alias("b2"), F.col("tstart").alias("c"), F.col("cigar").alias("c2"))

    @F.arrow_udf("struct<qstart:long,tstart:long,cigar:string,qend:long,tend:long>")
    def composed(a: pa.Array, b1: pa.Array, c1: pa.Array, b2: pa.Array, c: pa.Array, c2: pa.Array) -> pa.Array:
        out = []
        for x, y, p, z, w, r in zip(*[v.to_pylist() for v in (a, b1, c1, b2, c, c2)], strict=True):
            got = compose((x, y, expand(p)), (z, w, expand(r)))
            out.append(got and {"qstart": got[0], "tstart": got[1], "cigar": compress(got[2]), "qend": got[0] + sum(k != "D" for k in got[2]) - 1, "tend": got[1] + sum(k != "I" for k in got[2]) - 1})
        return pa.array(out, pa.struct([("qstart", pa.int64()), ("tstart", pa.int64()), ("cigar", pa.string()), ("qend", pa.int64()), ("tend", pa.int64())]))

    joined = left.join(right, "via").select("key", "target", "via", composed(F.col("a"), F.col("b1"), F.col("c1"), F.col("b2"), F.col("c"), F.col("c2")).alias("x")).where("x is not null").select("key", "target", "via", "x.*")
    # a pair's compositions in order: one is taken when it meets no interval that was taken before
    fields = ("via", "qstart", "tstart", "qend", "tend", "cigar")
    rows = joined.groupBy("key", "target").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__r"))
    free = "aggregate(__r, slice(__r, 1, 0), (a, x) -> case when exists(a, y -> y.qstart <= x.qend and x.qstart <= y.qend) then a else concat(a, array(x)) end)"
    return rows.select("key", "target", F.inline(F.expr(free))).select("key", "target", "via", "qstart", "qend", "tstart", "tend", "cigar")


def forward_backward(query: np.ndarray, target: np.ndarray, s: Scoring | None = None, temperature: float = 1.0) -> np.ndarray:
    """Posterior chance of each pair of letters over all local alignments, weighted by exp(score / temperature)."""
    s = s or Scoring()
    n, m = len(query), len(target)
    pair = np.stack([np.exp(s.row(int(x), target) / temperature) for x in query]) if n and m else np.zeros((n, m))
    opened, extended = math.exp(-s.open / temperature), math.exp(-s.extend / temperature)

    def run(p: np.ndarray) -> np.ndarray:
        match, down, across = np.zeros((n + 1, m + 1)), np.zeros((n + 1, m + 1)), np.zeros((n + 1, m + 1))
        scale = 0.0
        logs = np.zeros(n + 1)
        for i in range(1, n + 1):
            start = math.exp(-scale)
            match[i, 1:] = p[i - 1] * (start + match[i - 1, :-1] + down[i - 1, :-1] + across[i - 1, :-1])
            down[i, 1:] = opened * match[i - 1, 1:] + extended * down[i - 1, 1:]
            for j in range(1, m + 1):
                across[i, j] = opened * match[i, j - 1] + extended * across[i, j - 1]
            most = max(match[i].max(), down[i].max(), across[i].max(), 1e-300)
            match[i] /= most
            down[i] /= most
            across[i] /= most
            scale += math.log(most)
            logs[i] = scale
        return np.where(match[1:, 1:] > 0, np.log(np.maximum(match[1:, 1:], 1e-300)), -np.inf) + logs[1:, None]

    ahead = run(pair)
    back = run(pair[::-1, ::-1])[::-1, ::-1]
    total = np.logaddexp.reduce(np.append(ahead.ravel(), 0.0))
    with np.errstate(divide="ignore"):
        return np.exp(np.minimum(0.0, ahead + back - np.log(pair) - total))


# --- further ways to align


def local_scores(query: np.ndarray, target: np.ndarray, s: Scoring) -> int:
    """Score of the best local alignment with gaps, in memory proportional to the target."""
    m = len(target)
    ramp = np.arange(m, dtype=np.int32) * np.int32(s.extend)
    above, down, best = np.zeros(m + 1, np.int32), np.full(m, LOW, np.int32), 0
    profile = {x: s.row(x, target) for x in np.unique(query).tolist()}
    for letter in query.tolist():
        above, down, _ = _step(s, profile[letter], above, down, ramp)
        best = max(best, int(above.max()))
    return best


def scan_gapped(queries: DataFrame, targets: DataFrame, least_coverage: float = 0.8, most_evalue: float = 0.001, most: int = 300, scoring: Scoring | None = None) -> DataFrame:
    """Gapped score and e-value of every query with every target whose length allows the coverage; the best ``most`` each.

    Queries are broadcast in bounded blocks and targets stream past them.
    """
    s, spark, found = scoring or Scoring(), targets.sparkSession, None
    residues = int(targets.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0])
    for block in query_blocks(queries):
        scored = _gapped_scorer(spark.sparkContext.broadcast([(k, encode(q)) for k, q in block if q]), s, residues, least_coverage, most_evalue)
        part = targets.select(F.col("key").alias("target"), F.inline(scored(F.col("seq")))).select("key", "target", "score", "evalue")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "key long, target long, score long, evalue double")
    order = Window.partitionBy("key").orderBy("evalue", F.desc("score"), "target")
    return found.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= most).drop("__rank")


def _gapped_scorer(shared, s: Scoring, residues: int, coverage: float, most_evalue: float):
    @F.arrow_udf("array<struct<key:long,score:long,evalue:double>>")
    def scored(seqs: pa.Array) -> pa.Array:
        out = []
        for seq in seqs.to_pylist():
            target, rows = encode(seq or ""), []
            for key, query in shared.value:
                if len(target) and min(len(query), len(target)) / max(len(query), len(target)) >= coverage:
                    score = local_scores(query, target, s)
                    e = evalue(score, len(query), residues)
                    if score and e <= most_evalue:
                        rows.append({"key": key, "score": score, "evalue": e})
            out.append(rows)
        return pa.array(out, pa.list_(pa.struct([("key", pa.int64()), ("score", pa.int64()), ("evalue", pa.float64())])))

    return scored


def align_members(entries: DataFrame, sequences: DataFrame, **criteria: float) -> DataFrame:
    """``(entry, key, target, ...)``: every ordered pair of an entry's members ``(key, target)``, itself included, aligned.

    The operator asks for all pairs, so its result is quadratic in an entry; entries are meant to be short result lists.
    """
    members = entries.select(F.col("key").alias("entry"), F.col("target").alias("key"))
    pairs = members.join(members.select("entry", F.col("key").alias("target")), "entry")
    once = pairs.select("key", "target").distinct().withColumn("score", F.lit(0))
    return pairs.join(align(once, sequences, sequences, **criteria), ["key", "target"])


def transitive(found: DataFrame) -> DataFrame:
    """Alignments between targets of the same query, composed through it: ``(key, target, via, ..., cigar)``."""
    back = found.select(F.col("target").alias("key"), F.col("key").alias("target"), F.col("tstart").alias("qstart"), F.col("qstart").alias("tstart"), F.translate("cigar", "ID", "DI").alias("cigar"))
    return expand_alignments(back, found).where("key != target")


def align_top_region(pairs: DataFrame, queries: DataFrame, targets: DataFrame, scoring: Scoring | None = None, most_evalue: float = 0.001) -> DataFrame:
    """Two passes: the region of each query's best hit is aligned with all candidates; hits as good as the best e-value stay.

    Coordinates are the query's; e-values of the second pass are those of the region.
    """
    first = align(pairs, queries, targets, most_evalue, scoring=scoring)
    top = first.groupBy("key").agg(F.min(F.struct("evalue", (-F.col("score")).alias("s"), "target", "qstart", "qend")).alias("b")).select("key", "b.evalue", "b.qstart", "b.qend")
    cut = queries.join(top, "key").select("key", F.substring(F.col("seq"), (F.col("qstart") + 1).cast("int"), (F.col("qend") - F.col("qstart") + 1).cast("int")).alias("seq"))
    again = align(pairs, cut, targets, most_evalue, scoring=scoring)
    limits = top.select("key", F.greatest("evalue", F.lit(most_evalue)).alias("__most"), F.col("qstart").alias("__at"))
    shifted = again.join(limits, "key").where(F.col("evalue") <= F.col("__most"))
    return shifted.withColumns({"qstart": F.col("qstart") + F.col("__at"), "qend": F.col("qend") + F.col("__at")}).drop("__most", "__at")


def chain_kmers(query: str, target: str, k: int = 4, gap: int = 3) -> tuple[int, int, int, int, int]:
    """``(score, qstart, qend, tstart, tend)`` of the best chain of k-mer matches: 2 a letter, ``gap`` for each change of diagonal.

    A query's k-mer counts at its first place; matches alone on their diagonal are left out.
    """
    places: dict[str, int] = {}
    for i in range(len(query) - k + 1):
        places.setdefault(query[i:i + k], i)
    by_diagonal: dict[int, list[int]] = {}
    for j in range(len(target) - k + 1):
        i = places.get(target[j:j + k])
        if i is not None:
            by_diagonal.setdefault(i - j, []).append(j)
    stretches = []
    for d, js in by_diagonal.items():
        if len(js) < 2:
            continue
        start = last = js[0]
        for j in js[1:] + [None]:
            if j is None or j > last + k:
                stretches.append((start + d, start, last - start + k))
                start = j
            last = j
    stretches.sort()
    best: list[tuple[int, int]] = []
    for n, (q, t, size) in enumerate(stretches):
        own = max([(2 * size, -1), *((best[p][0] + 2 * size - gap, p) for p in range(n) if stretches[p][0] + stretches[p][2] <= q and stretches[p][1] + stretches[p][2] <= t)])
        best.append(own)
    if not best:
        return 0, -1, -1, -1, -1
    at = max(range(len(best)), key=lambda n: (best[n][0], -n))
    score, (q1, t1, size) = best[at][0], stretches[at]
    while best[at][1] >= 0:
        at = best[at][1]
    return score, stretches[at][0], q1 + size - 1, stretches[at][1], t1 + size - 1


def align_by_kmers(pairs: DataFrame, queries: DataFrame, targets: DataFrame, k: int = 4, gap: int = 3) -> DataFrame:
    """``(key, target, score, qstart, qend, tstart, tend)`` by chains of k-mer matches."""

    @F.arrow_udf("struct<score:long,qstart:long,qend:long,tstart:long,tend:long>")
    def chained(qs: pa.Array, ts: pa.Array) -> pa.Array:
        names = ("score", "qstart", "qend", "tstart", "tend")
        rows = [dict(zip(names, chain_kmers(q or "", t or "", k, gap), strict=True)) for q, t in zip(qs.to_pylist(), ts.to_pylist(), strict=True)]
        return pa.array(rows, pa.struct([(n, pa.int64()) for n in names]))

    texts = pairs.select("key", "target").join(queries.select("key", F.col("seq").alias("__q")), "key").join(targets.select(F.col("key").alias("target"), F.col("seq").alias("__t")), "target")
    return texts.select("key", "target", chained(F.col("__q"), F.col("__t")).alias("a")).select("key", "target", "a.*").where("score > 0")


def posterior_pairs(pairs: DataFrame, queries: DataFrame, targets: DataFrame, least: float = 0.3, temperature: float = 1.0) -> DataFrame:
    """``(key, target, matched, confidence)``: number and mean posterior of letter pairs whose chance is at least ``least``."""

    @F.arrow_udf("struct<matched:long,confidence:double>")
    def judged(qs: pa.Array, ts: pa.Array) -> pa.Array:
        rows = []
        for q, t in zip(qs.to_pylist(), ts.to_pylist(), strict=True):
            chance = forward_backward(encode(q or ""), encode(t or ""), temperature=temperature) if q and t else np.zeros((0, 0))
            sure = chance[chance >= least]
            rows.append({"matched": len(sure), "confidence": float(sure.mean()) if len(sure) else 0.0})
        return pa.array(rows, pa.struct([("matched", pa.int64()), ("confidence", pa.float64())]))

    texts = pairs.select("key", "target").join(queries.select("key", F.col("seq").alias("__q")), "key").join(targets.select(F.col("key").alias("target"), F.col("seq").alias("__t")), "target")
    return texts.select("key", "target", judged(F.col("__q"), F.col("__t")).alias("a")).select("key", "target", "a.*")


def gumbel_lambda(scores: dict[tuple[str, str], float], background: dict[str, float]) -> float:
    """The lambda for which the expected exp(lambda x score) of letter pairs is 1, by bisection."""

    def excess(x: float) -> float:
        return sum(background[a] * background[b] * math.exp(x * v) for (a, b), v in scores.items()) - 1

    low, high = 1e-6, 1.0
    if sum(background[a] * background[b] * v for (a, b), v in scores.items()) >= 0 or max(scores.values()) <= 0:
        raise ValueError("the expected score must be negative and some score positive")
    while excess(high) < 0:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return (low + high) / 2
