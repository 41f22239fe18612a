import random

import numpy as np

from manyfold.llm import op2_quality as op

SCHEMA = "doc_id long, text string, _score string"


def make(n, seed=1):
    rng = random.Random(seed)
    good, bad, mean = ([f"{p}{i}" for i in range(80)] for p in "gbm")
    docs, labels = [], []
    for i in range(n):
        grade = i % 3
        words = rng.choices(good, k=rng.randint(20, 60))
        if grade == 0:
            words = rng.choices(good + bad * 2, k=40)
        elif grade == 1:
            words += rng.choices(mean, k=12)
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(grade > 0), int(grade == 1)))
    return docs, labels


def test_gradient_orders_grades():
    docs, labels = make(300)
    make_features = op.Features()
    rows = [(0 if q == 0 else 1 if t else 2, *make_features(d[1].encode())) for d, (_, q, t) in zip(docs, labels, strict=True)]
    model = op.fit(rows)
    assert model.thresholds[0] < model.thresholds[1]
    got = np.array([model.tails(s, v).sum() for _, s, v in rows])
    means = [got[[i for i, r in enumerate(rows) if r[0] == g]].mean() for g in range(3)]
    assert means[0] < means[1] < means[2]


def test_held_out_accuracy(spark):
    docs, labels = make(600)
    docs += [(9000, None, None), (9001, "", ""), (9002, "g1 g2 " * 30000, ""), (None, "g1", "")]
    labels += [(None, 1, 0), (5, None, None), (77777, 1, 1), (0, 0, 0)]
    half = [x for x in labels if x[0] is None or x[0] < 400]
    got = op.score(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(half, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    right = [(r.expected_grade > 0.5) + (r.expected_grade > 1.5) == r.doc_id % 3 for r in got if r.doc_id and 400 <= r.doc_id < 600]
    assert sum(right) / len(right) > 0.9
    assert all(0 <= r.p_ge_2 <= r.p_ge_1 <= 1 and abs(r.expected_grade - r.p_ge_1 - r.p_ge_2) < 1e-9 for r in got)


def test_empty_and_one_grade(spark):
    docs, labels = make(30)
    frame, rated = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert all(r.kept for r in op.score(frame, rated.limit(0)).collect())
    assert not any(r.kept for r in op.score(frame, rated.where("quality = 0")).collect())
    assert op.score(frame.limit(0), rated).count() == 0
    clash = frame.withColumns({"row": frame["doc_id"], "s": frame["text"]})
    kept = op.select_quality(clash, rated)
    assert kept.columns == clash.columns and set(map(tuple, kept.collect())) <= set(map(tuple, clash.collect()))
