import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from manyfold.llm import op9_mixing as op

SCHEMA = "doc_id long, text string, topic string, p string, row string"
WORDS = {"x": [f"x{i}" for i in range(40)], "y": [f"y{i}" for i in range(40)], "z": [f"z{i}" for i in range(40)]}


def make(n=300, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        topic = rng.choices("xyz", [6, 3, 1])[0]
        mixed = rng.choice(["xyz".replace(topic, ""), topic])[0] if rng.random() < 0.2 else topic
        words = [rng.choice(WORDS[topic if rng.random() < 0.6 else mixed]) for _ in range(rng.randint(1, 80))]
        rows.append((i, " ".join(words), topic, "a", "b"))
    return rows


def labelled(spark, rows):
    return spark.createDataFrame([(r[0], r[2]) for r in rows[::2]], "id long, domain string")


def brute_rates(p, tokens, target, rounds=20_000):
    """Plain projected gradient in the metric of the tokens, on arrays."""
    gram = (p * tokens[:, None]).T @ p
    step, r = 1 / np.linalg.eigvalsh(gram).max(), np.ones(len(p))
    for _ in range(rounds):
        r = np.maximum(0, r - step * p @ ((r * tokens) @ p - target))
    return r


def test_targets_are_met(spark):
    rows = make()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    targets = {"x": 0.2, "y": 0.4, "z": 0.4}
    model = op.fit(docs, labelled(spark, rows))
    got = docs.select("doc_id", model.posteriors(op.buckets_of(F.col("text"))).alias("q"), F.size(op.buckets_of(F.col("text"))).alias("n")).orderBy("doc_id").collect()
    p, n = np.array([r.q for r in got]), np.array([r.n for r in got], float)
    assert np.allclose(p.sum(1), 1)
    rated = {r.doc_id: r for r in op.rates(docs, labelled(spark, rows), targets).collect()}
    rate = np.array([rated[r.doc_id].rate for r in got])
    totals = (rate * n) @ p
    assert np.allclose(totals / totals.sum(), [targets[d] for d in model.domains], atol=1e-3)
    have = n @ p
    goal = n.sum() * (1 + op.HEADROOM) * max(h / n.sum() / targets[d] for h, d in zip(have, model.domains, strict=True))
    best = brute_rates(p, n, goal * np.array([targets[d] for d in model.domains]))
    assert np.allclose((best * n) @ p, totals, rtol=1e-3)
    assert rate.min() >= 0 and np.mean([rated[r[0]].domain == r[2] for r in rows]) > 0.9
    assert all(abs(r.copies - r.rate) < 1 for r in rated.values())


def test_a_tight_budget_clips_at_zero(spark):
    rows = make()
    docs = spark.createDataFrame(rows, SCHEMA)
    tokens = sum(len(r[1].split()) for r in rows)
    only = {"x": 0.0, "y": 0.0, "z": 1.0}
    got = op.rates(docs, labelled(spark, rows), only, total=0.05 * tokens).collect()
    assert min(r.rate for r in got) == 0.0 and len(got) == len(rows)
    kept = op.mix(docs, labelled(spark, rows), only, total=0.05 * tokens)
    assert kept.columns == [*docs.columns, "mix_rate", "mix_copies"] and 0 < kept.count() == sum(r.rate > 0 for r in got)


def test_odd_rows(spark):
    rows = make(100)
    odd = [(500, None, "x", "", ""), (501, "", "y", "", ""), (502, " \n ", None, "", ""), (None, "x1 x2", "x", "", ""), (0, "y1", None, None, None), (503, "x1 y2 " * 100_000, "x", "", "")]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    labels = labelled(spark, rows).union(spark.createDataFrame([(None, "x"), (7, None), (99_999, "x"), (2, "a"), (2, "x")], "id long, domain string"))
    got = op.rates(docs, labels, {"x": 0.5, "y": 0.3, "z": 0.1, "nowhere": 0.1}).collect()
    assert len(got) == len(rows) + len(odd) and all(math.isfinite(r.rate) and r.rate >= 0 for r in got)
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (500, 501, 502, 503)} == {500: 0, 501: 0, 502: 0, 503: 200_000}
    assert op.mix(docs, labels, {"x": 0.5, "y": 0.5}).count() == len(got)


def test_nothing_labelled(spark):
    docs = spark.createDataFrame(make(20), SCHEMA)
    none = spark.createDataFrame([], "id long, domain string")
    assert {(r.rate, r.copies, r.domain) for r in op.rates(docs, none).collect()} == {(1.0, 1, None)}
    assert op.rates(spark.createDataFrame([], SCHEMA), labelled(spark, make(20))).count() == 0
    assert op.mix(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(make(20), SCHEMA)
    plan = op.rates(docs, labelled(spark, make(20)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_domain_without_target_stays(spark):
    rows = make()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = op.mix(docs.withColumn("mix_rate", F.lit("old")), labelled(spark, rows), {"x": 0.5, "y": 0.5})
    assert got.columns == [*docs.columns, "mix_rate", "mix_copies"]
    rated = {r.doc_id: r.mix_rate for r in got.collect()}
    assert len(rated) == len(rows) and 0.7 < np.mean([rated[r[0]] for r in rows if r[2] == "z"]) < 1.5
    assert np.mean([rated[r[0]] for r in rows if r[2] == "y"]) > 1.5


def test_unsettled_rates_are_not_returned(spark):
    rows = make()
    docs = spark.createDataFrame(rows, SCHEMA)
    table = docs.select(F.lit(10).alias("tokens"), F.when(F.col("topic") == "x", F.array(F.lit(0.9), F.lit(0.1))).otherwise(F.array(F.lit(0.2), F.lit(0.8))).alias("p"))
    with pytest.raises(RuntimeError, match="did not settle"):
        op.solve(table, ["x", "y"], {"x": 0.1, "y": 0.9}, rounds=2)
    assert op.solve(table, ["x", "y"], {"x": 0.1, "y": 0.9})
