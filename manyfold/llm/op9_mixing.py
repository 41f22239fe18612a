"""Mixing sources to target weights by soft membership.

1. A naive Bayes classifier over hashed words is fitted on a labelled table ``(id, domain)`` and gives every document a
   posterior over the domains; its evidence is scaled to that of EVIDENCE words, so memberships stay soft for long texts.
2. A document's rate tells how often it should be read.  Rates minimise, over rates >= 0, the squared distance between the
   expected domain token totals (sum of rate x tokens x posterior) and the targets, by projected gradient from rate 1.
   Steps are taken in the metric of the tokens: the gradient of a document is divided by its tokens, so a rate depends on
   memberships and not on the length of the text.  Each round is one aggregation over all documents (a row per domain comes
   back); a document's rate is a fold of the rounds' residuals over its posterior, so nothing is shuffled or rewritten.

The targets' total is that of the targeted domains times the smallest factor at which none of them has to shrink, and
HEADROOM; so over-represented domains keep their documents and the others are repeated.  Pass ``total`` for another budget.  A
labelled domain that has no target keeps its total, so its documents' rates stay near one.

Rounds end when the totals are met, or when they stop moving (targets that no rates >= 0 can meet: the least squares are found);
``solve`` raises when neither has come about after ROUNDS, so unsettled rates are never returned.

Only DataFrame and SQL functions are used.  The labelled sample is bounded by MAX_LABELLED rows, the classifier by MAX_DOMAINS
times BUCKETS numbers, which become literals of the plan: classifying is a narrow pass, and documents are never shuffled.
The driver sees word counts of that bound, totals and residuals.

Defined cases: a null or empty text has no tokens, the prior as its posterior, and a rate all the same; labels with nulls,
without a document or repeated (the smallest domain counts) don't disturb; a target without a labelled document can't be met
and is left out, the rest is scaled up; without any usable label or target, every rate is 1; an empty table gives an empty
result; rows that repeat are rated one by one; other columns are kept by ``mix``, save those named like its own, which it replaces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyfold.operators.storage import materialise

MAX_LABELLED = 6000
MAX_DOMAINS = 64
BUCKETS = 1 << 13
EVIDENCE = 30
ROUNDS = 400
#: Share by which the targets' total exceeds the least one, so that soft memberships leave no rate below one.
HEADROOM = 0.02
#: Rounds end when the residual is below this share of the targets' total, or changes by less than the second for STALLED rounds.
SETTLED, STILL, STALLED = 1e-4, 1e-6, 5
#: Target shares of the domains (languages) of the registered query.
TARGETS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


def buckets_of(text: Column) -> Column:
    """The words of a text (lower case, split at ASCII white space) as numbers below BUCKETS."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x09-\x0D\x20]+", -1)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def labelled_by(labels: DataFrame, docs: DataFrame, domain_col: str, id_col: str = "doc_id") -> DataFrame:
    """A labelled table ``(id, domain)``: documents that ``labels`` lists, at most MAX_LABELLED of them, with their domain.

    The ids with the smallest hashes are taken, so the sample is the same in each run.
    """
    listed = labels.select(F.col(id_col).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED)
    named = docs.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain"))
    # at most MAX_LABELLED rows are broadcast
    return named.join(F.broadcast(listed), "id").where("domain is not null").groupBy("id").agg(F.min("domain").alias("domain"))


def _looked_up(table: Column, places: Column) -> Column:
    return F.aggregate(places, F.lit(0.0), lambda a, b: a + F.get(table, b))


@dataclass
class Classifier:
    """Multinomial naive Bayes over buckets: names, log priors, and for each domain a weight per bucket."""

    domains: list[str]
    priors: list[float]
    weights: list[list[float]]

    def posteriors(self, buckets: Column) -> Column:
        """An array of posteriors for an array of buckets.  Evidence counts as that of EVIDENCE words at most."""
        scale = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(F.size(buckets), F.lit(1)))
        tables = [F.split(F.lit(",".join(map(repr, w))), ",").cast("array<double>") for w in self.weights]
        sums = [_looked_up(table, buckets) for table in tables]
        logits = F.array(*[F.lit(p) + s * scale for p, s in zip(self.priors, sums, strict=True)])
        # each step binds its value once
        shifted = F.transform(F.array(logits), lambda l: F.transform(l, lambda x: F.exp(x - F.array_max(l))))
        return F.get(F.transform(shifted, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))), F.lit(0))


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Count words of the labelled documents by bucket and domain.

    A bucket's weight is the domain's log frequency less the mean over domains; a bucket no labelled document has says nothing.
    """
    sample = materialise(labelled.where("id is not null and domain is not null").groupBy("id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED))
    # at most MAX_LABELLED rows are broadcast; words are cut after the join, of labelled texts only
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    grouped = texts.select("domain", F.explode(buckets_of(F.col("text"))).alias("bucket")).groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["domain"]: r["k"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("k")).orderBy("domain").limit(MAX_DOMAINS + 1).collect()}
    if len(sizes) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    counts = {d: [0] * BUCKETS for d in sizes}
    for r in grouped.collect():  # at most MAX_DOMAINS x BUCKETS rows
        counts[r["domain"]][r["bucket"]] = r["n"]
    logs = [[math.log((c + 0.5) / (sum(held) + 0.5 * BUCKETS)) for c in held] for held in counts.values()]
    seen = [any(column) for column in zip(*counts.values(), strict=True)]
    means = [sum(column) / len(column) for column in zip(*logs, strict=True)]
    weights = [[round(x - m, 6) if s else 0.0 for x, m, s in zip(held, means, seen, strict=True)] for held in logs]
    return Classifier(list(sizes), [math.log(k / sum(sizes.values())) for k in sizes.values()], weights)


def _rate(p: Column, steps: list[tuple[list[float], float]]) -> Column:
    """A document's rates ``(r, y)`` after the rounds: r is projected, y runs ahead by the momentum of the round."""
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    if not steps:
        return start
    listed = F.array(*[F.struct(F.array(*map(F.lit, g)).alias("g"), F.lit(m).alias("m")) for g, m in steps])

    def step(a: Column, s: Column) -> Column:
        pull = F.aggregate(F.zip_with(p, s["g"], lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
        new = F.greatest(F.lit(0.0), a["y"] - pull)
        return F.struct(new.alias("r"), (new + s["m"] * (new - a["r"])).alias("y"))

    return F.aggregate(listed, start, step)


def _largest(gram: list[list[float]]) -> float:
    """The largest eigenvalue of a small symmetric matrix with entries >= 0, from above: the largest row sum bounds it."""
    return max((sum(row) for row in gram), default=0.0)


def solve(table: DataFrame, domains: list[str], targets: dict[str, float], total: float | None = None, rounds: int = ROUNDS) -> list[tuple[list[float], float]]:
    """Steps of the accelerated projected gradient for ``table`` (``tokens``, ``p``), to be folded by ``_rate``."""
    n = len(domains)
    wanted = [max(0.0, float(targets.get(d, 0.0))) for d in domains]
    listed = [d in targets for d in domains]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    row = table.agg(*[F.sum(F.col("tokens") * F.get("p", F.lit(i))) for i in range(n)], *[F.sum(F.col("tokens") * F.get("p", F.lit(i)) * F.get("p", F.lit(j))) for i, j in pairs]).first()
    have, gram = [float(v or 0) for v in row[:n]], [[0.0] * n for _ in range(n)]
    for (i, j), v in zip(pairs, row[n:], strict=True):
        gram[i][j] = gram[j][i] = float(v or 0)
    corpus, share = sum(h for h, t in zip(have, listed, strict=True) if t), sum(w for w, h in zip(wanted, have, strict=True) if h > 0)
    if corpus <= 0 or share <= 0:
        return []
    wanted = [w / share if h > 0 else 0.0 for w, h in zip(wanted, have, strict=True)]
    goal = total if total is not None else corpus * (1 + HEADROOM) * max(1.0, *(h / corpus / w for w, h in zip(wanted, have, strict=True) if w > 0))
    target = [w * goal if t else h for w, h, t in zip(wanted, have, listed, strict=True)]
    step, momentum, steps, gap, still = 1 / _largest(gram), 1.0, [], math.inf, 0
    at = have
    for _ in range(rounds):
        residual = [a - b for a, b in zip(at, target, strict=True)]
        following = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        steps.append(([step * x for x in residual], (momentum - 1) / following))
        momentum = following
        state = _rate(F.col("p"), steps)
        told = table.select("tokens", "p", state.alias("a")).agg(
            *[F.sum(F.col("tokens") * F.get("p", F.lit(i)) * F.col("a.y")) for i in range(n)],
            *[F.sum(F.col("tokens") * F.get("p", F.lit(i)) * F.col("a.r")) for i in range(n)],
        ).first()
        at, reached = [float(v) for v in told[:n]], [float(v) for v in told[n:]]
        before, gap = gap, math.dist(reached, target)
        still = still + 1 if abs(gap - before) <= STILL * goal else 0
        if gap <= SETTLED * goal or still == STALLED:
            return steps
        if gap > before:  # the momentum overshoots
            momentum = 1.0
    raise RuntimeError(f"rates did not settle in {rounds} rounds: the totals are {gap / goal:.2g} of the target away")


def _rated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str, text_col: str, total: float | None, keep: list[str]) -> DataFrame:
    """Two structs: ``row``, the columns ``keep`` of ``docs``, and ``r``: n_tokens, domain, p_domain, rate and copies."""
    model = fit(docs, labelled, id_col, text_col)
    # as one struct no column of the row can clash with those added
    held = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    place = F.pmod(F.xxhash64("id", F.lit("copies")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    if not model.domains:
        words = F.size(buckets_of(F.col("text"))).cast("long").alias("n_tokens")
        return held.select("row", F.struct(words, F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("p_domain"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies")).alias("r"))
    bound = F.transform(F.array(buckets_of(F.col("text"))), lambda b: F.struct(F.size(b).cast("long").alias("tokens"), model.posteriors(b).alias("p")))
    # kept in the shared folder; the rounds read memberships alone
    table = materialise(held.select("row", "id", F.get(bound, F.lit(0)).alias("m")).select("row", "id", "m.tokens", "m.p"))
    steps = solve(table.select("tokens", "p"), model.domains, targets, total)
    best = F.array_max(F.transform("p", lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
    found = table.withColumn("b", best).withColumn("rate", _rate(F.col("p"), steps)["r"])
    told = F.struct(F.col("tokens").alias("n_tokens"), F.get(F.array(*map(F.lit, model.domains)), -F.col("b.i")).alias("domain"), F.col("b.p").alias("p_domain"), "rate", F.floor(F.col("rate") + place).cast("long").alias("copies"))
    return found.select("row", told.alias("r"))


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", total: float | None = None) -> DataFrame:
    """Return ``(<id_col>, n_tokens, domain, p_domain, rate, copies)`` for every row of ``docs``.

    domain and p_domain: the likeliest domain and its posterior (null without labels).  copies: the rate rounded up or down
    by a hash of the id, so that its mean over documents is the rate.
    """
    return _rated(docs, labelled, targets, id_col, text_col, total, [id_col]).select("row.*", "r.*")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", total: float | None = None) -> DataFrame:
    """``docs`` with two columns more: ``mix_rate`` and ``mix_copies``, how often a sampler reads the document.

    A document with rate zero goes; with the default total no rate of a listed domain's document falls to zero.
    """
    rated = _rated(docs, labelled, targets, id_col, text_col, total, docs.columns)
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("mix_rate", "mix_copies")]
    return rated.where("r.rate > 0").select(*kept, F.col("r.rate").alias("mix_rate"), F.col("r.copies").alias("mix_copies"))
