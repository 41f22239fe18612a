"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade <= k | text) = sigmoid(threshold_k - w . x): one weight vector ``w`` shared by all grades, and ordered thresholds.
``x`` holds the hashed words of the whole text, their shapes and a repetition feature, each family as square roots of
frequencies, so a long text is not louder than a short one.  Training reads at most ``MAX_LABELLED`` labelled documents (the
ones with the smallest hashes of their id, a bounded and repeatable sample); scoring reads every document.

Defined cases: a null or empty text has the zero vector and is graded by the thresholds alone; labels with nulls, labels
without a document and repeated labels of a document (the lowest grade counts) don't disturb; without usable labels, or
with one grade only, every document gets that grade's (or the highest) certainty and is kept; an empty table gives an empty
result; rows that repeat are scored one by one; other columns are ignored by ``score`` and kept by ``select_quality``.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 14
MAX_LABELLED = 6000
GRADES = 3
#: quality 0: grade 0; quality 1 and toxic: 1; quality 1 and not toxic: 2
GRADE = "case when quality = 0 then 0 when toxic = 1 then 1 else 2 end"
#: A text is kept when it more likely than not reaches this grade, the top one: neither junk nor toxic.
LEAST_GRADE, LEAST_TAIL = 2, 0.5
SCORE = "struct<expected_grade:double,p_ge_1:double,p_ge_2:double>"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SHAPE = bytes(ord("a") if chr(c).isalpha() and c < 128 or c >= 128 else ord("9") if chr(c).isdigit() and c < 128 else c for c in range(256))
_SEEN_MOST = 200_000


def _shape(word: bytes) -> bytes:
    mapped = word.translate(_SHAPE)
    return bytes([c for i, c in enumerate(mapped) if not i or mapped[i - 1] != c])


class Features:
    """Hashed features of texts; remembers the slots of up to ``_SEEN_MOST`` words."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.slots: dict[bytes, tuple[int, bytes]] = {}

    def _slot(self, word: bytes) -> tuple[int, bytes]:
        if len(self.slots) >= _SEEN_MOST:
            self.slots.clear()
        got = self.slots[word] = (xxhash.xxh64_intdigest(b"w" + word) % self.dimensions, _shape(word))
        return got

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or b"").translate(_LOWER).split()
        n = len(words)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0)
        counts = Counter(words)
        known, slots, shapes = self.slots, [], Counter()
        for word, times in counts.items():
            slot, shape = known.get(word) or self._slot(word)
            slots.append(slot)
            shapes[shape] += times
        own = [xxhash.xxh64_intdigest(b"s" + s) % self.dimensions for s in shapes]
        repeats = sum(map(eq, words, words[1:])) / n
        distinct = len(counts) / n
        extra = [xxhash.xxh64_intdigest(b"x" + x) % self.dimensions for x in (b"repeats", b"distinct")]
        values = np.sqrt(np.fromiter((*counts.values(), *shapes.values()), float, len(slots) + len(own)) / n)
        return np.array(slots + own + extra, np.int32), np.concatenate((values, (np.sqrt(repeats), np.sqrt(distinct))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Shared weights and ordered thresholds; ``tails`` gives P(grade >= k) for k = 1 .. grades - 1."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIMENSIONS))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, -40.0))

    def tails(self, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
        return _sigmoid(float(self.weights[slots] @ values) - self.thresholds)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int = GRADES, dimensions: int = DIMENSIONS, rounds: int = 250, decay: float = 2e-5) -> Model:
    """Maximum likelihood by full-batch Adam; the thresholds stay ordered, as gaps are exponentials."""
    seen = sorted({g for g, *_ in rows})
    if len(seen) < 2:
        top = seen[0] if seen else grades - 1
        return Model(np.zeros(dimensions), np.array([-40.0 if k < top else 40.0 for k in range(grades - 1)]))
    grade = np.array([g for g, *_ in rows])
    row = np.repeat(np.arange(len(rows)), [len(s) for _, s, _ in rows])
    slot = np.concatenate([s for _, s, _ in rows])
    value = np.concatenate([v for *_, v in rows])
    share = np.clip([(grade <= k).mean() for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    logits = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(logits), 1e-2))
    theta = np.concatenate(([logits[0]], gaps, np.zeros(dimensions)))
    first = grades - 1
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        cuts = np.concatenate(([-np.inf], theta[0] + np.concatenate(([0], np.cumsum(np.exp(theta[1:first])))), [np.inf]))
        at = np.bincount(row, value * theta[first:][slot], len(rows))
        high, low = _sigmoid(cuts[grade + 1] - at), _sigmoid(cuts[grade] - at)
        chance = np.maximum(high - low, 1e-12)
        up, down = high * (1 - high) / chance, low * (1 - low) / chance
        grad = np.zeros_like(theta)
        by_cut = np.bincount(grade, -up, grades)[:-1] + np.bincount(grade, down, grades)[1:]
        grad[0] = by_cut.sum()
        grad[1:first] = np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(theta[1:first])
        grad[first:] = np.bincount(slot, value * (up - down)[row], dimensions)
        grad = grad / len(rows) + np.concatenate((np.zeros(first), decay * theta[first:]))
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        theta = theta - 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return Model(theta[first:], theta[0] + np.concatenate(([0], np.cumsum(np.exp(theta[1:first])))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade: str = GRADE, most: int = MAX_LABELLED) -> Model:
    """Fit on the graded rows of ``labels``, at most ``most`` of them."""
    graded = labels.select(F.col(id_col).alias("_id"), F.expr(grade).alias("_grade")).where(f"_id is not null and _grade between 0 and {GRADES - 1}")
    sample = graded.groupBy("_id").agg(F.min("_grade").alias("_grade")).orderBy(F.xxhash64("_id"), "_id").limit(most)

    @F.arrow_udf("struct<slots:binary,values:binary>")
    def features(texts: pa.Array) -> pa.Array:
        make = Features()
        found = [make(t) for t in texts.cast(pa.binary()).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([s.tobytes() for s, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())], names=["slots", "values"])

    # the sample has at most ``most`` rows: its size is bounded, and with it what is broadcast and what is collected
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    once = picked.select("_id", "_grade", features(F.col("_text")).alias("f")).select("_id", "_grade", "f.slots", "f.values")
    rows = {}
    for r in once.toLocalIterator():
        key = (r["_id"], bytes(r["slots"]))
        rows[key] = (int(r["_grade"]), np.frombuffer(r["slots"], np.int32), np.frombuffer(r["values"], np.float32).astype(float))
    return fit([rows[k] for k in sorted(rows)])


def score_column(model: Model, text: Column, spark) -> Column:
    """A struct column: expected grade and the tail probabilities."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(SCORE)
    def score_text(texts: pa.Array) -> pa.Array:
        model, make = shared.value, Features()
        tails = np.array([model.tails(*make(t)) for t in texts.cast(pa.binary()).to_pylist()]).reshape(-1, GRADES - 1)
        return pa.StructArray.from_arrays([pa.array(tails.sum(axis=1)), *(pa.array(tails[:, k]) for k in range(GRADES - 1))], names=["expected_grade", "p_ge_1", "p_ge_2"])

    return score_text.asNondeterministic()(text)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``(<id_col>, expected_grade, p_ge_1, p_ge_2, kept)`` for every row of ``docs``."""
    model = train(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col), score_column(model, F.col(text_col), docs.sparkSession).alias("s"))
    return scored.select(id_col, "s.expected_grade", "s.p_ge_1", "s.p_ge_2", (F.col(f"s.p_ge_{LEAST_GRADE}") >= LEAST_TAIL).alias("kept"))


def select_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, columns unchanged."""
    model = train(docs, labels, id_col, text_col)
    # the row travels as one struct, so that no column of its can clash
    scored = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), score_column(model, docs[text_col], docs.sparkSession).alias("s"))
    return scored.where(F.col(f"s.p_ge_{LEAST_GRADE}") >= LEAST_TAIL).select("row.*")
