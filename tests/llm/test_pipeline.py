"""Each stage of the pipeline on the smallest tables, held against a plain version of what it does."""

import re

import duckdb
import numpy as np
import pytest
from test_op1 import BASE, brute as personal
from test_op3 import brute as contaminated
from test_shingle_dedup import brute as components

import corpus_pipeline
from manyfold.llm import op2_quality, op9_mixing

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append([tuple(r) for r in docs.collect()])
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns[:5] == COLUMNS and (name == "mixing" or len(docs.columns) == 5)
        out.append([tuple(r) for r in docs.collect()])
    return out


def test_quality_keeps_what_the_model_likes(spark, steps):
    graded = {d: (0 if q == 0 else 1 if t == 1 else 2) for d, q, t in duckdb.sql(f"select doc_id, quality, toxic from '{SF}/labels.parquet'").fetchall()}
    make = op2_quality.Features()
    rows = {r[0]: make(r[1].encode()) for r in steps[0]}
    model = op2_quality.fit([(graded[d], rows[d][0], rows[d][1].astype(np.float32).astype(float)) for d in graded if d in rows])
    kept = {r[0] for r in steps[1]}
    chance = {d: model.tails(*f)[op2_quality.LEAST_GRADE - 1] for d, f in rows.items()}
    assert all((c >= 0.5) == (d in kept) for d, c in chance.items() if abs(c - 0.5) > 0.02)
    assert set(steps[1]) <= set(steps[0]) and sum(graded[d] == 2 for d in graded if d in kept) > 0.98 * sum(g == 2 for g in graded.values())


def test_one_of_each_group_stays(steps):
    assert {r[0] for r in steps[2]} == set(components([(r[0], r[1]) for r in steps[1]])) and set(steps[2]) <= set(steps[1])


def test_benchmark_passages_go(steps):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    before = {d: hit for d, *_, hit in contaminated([(r[0], r[1]) for r in steps[2]], items)}
    old = {r[0]: r for r in steps[2]}
    assert any(before.values()) and not any(hit for *_, hit in contaminated([(r[0], r[1]) for r in steps[3]], items))
    assert all(r == old[r[0]] for r in steps[3] if not before[r[0]])
    assert all(before[d] for d in old.keys() - {r[0] for r in steps[3]})
    assert all(r[4] == len(r[1]) for r in steps[3] if before[r[0]])


def test_personal_data_goes(steps):
    old = {r[0]: r for r in steps[3]}
    assert {r[0] for r in steps[4]} == set(old) and any(personal(r[1]) for r in steps[3])
    for r in steps[4]:
        assert not personal(r[1])
        pieces = re.split(r"\[(?:EMAIL|IP|CARD|PHONE|SECRET)\]", r[1])
        assert re.fullmatch(".*?".join(map(re.escape, pieces)), old[r[0]][1], re.S) and set(BASE)
        assert len(pieces) > 1 or r == old[r[0]]


def test_mixing_meets_targets(spark, steps):
    assert [r[:5] for r in sorted(steps[5])] == sorted(steps[4])
    words = {r[0]: (r[2], len(r[1].split())) for r in steps[4]}
    totals = {}
    for r in steps[5]:
        totals[r[2]] = totals.get(r[2], 0) + r[5] * words[r[0]][1]
        assert r[5] >= 0.99 and abs(r[5] - r[6]) < 1
    share = {d: t / sum(totals.values()) for d, t in totals.items()}
    assert all(abs(share[d] - op9_mixing.TARGETS[d]) < 0.06 for d in share)  # the posteriors aren't the languages themselves


def test_run_is_all_stages(spark, steps):
    assert sorted(map(str, (tuple(r) for r in corpus_pipeline.run(spark, SF).collect()))) == sorted(map(str, steps[5]))


CASES = "doc_id long, text string, lang string, source string, n_chars long, row string, cleaned string, mix_rate string"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_tables(spark, name):
    """No rows; and null, empty, repeated and very long rows with extra columns of clashing names."""
    stage = dict(corpus_pipeline.STAGES)[name]
    long = "plain words stand in this text and go on " * 4000
    rows = [(None, "some words", None, None, None, None, None, None), (1, None, "en", "a", None, "r", "c", "m"), (2, "", "en", "a", 0, "r", "c", "m"), (3, long, "en", "b", len(long), "r", "c", "m"), (3, long, "en", "b", len(long), "r", "c", "m"), (4, "x@y.com +1 377 555 0271", "fr", "b", 23, "r", "c", "m")]
    docs = spark.createDataFrame(rows, CASES)
    assert stage(spark, docs.limit(0), SF).count() == 0
    found = stage(spark, docs, SF)
    kept = [c for c in docs.columns if name != "mixing" or c != "mix_rate"]
    assert found.columns == kept + ["mix_rate", "mix_copies"] * (name == "mixing")
    ids = [r.doc_id for r in found.collect()]
    assert set(ids) <= {None, 1, 2, 3, 4} and len(ids) <= len(rows)
    if name in ("decontaminate", "pii", "mixing"):
        assert len(ids) == len(rows)
    if name == "near_dedup":
        assert sorted(map(str, ids)) == ["1", "3", "3", "4", "None"]
