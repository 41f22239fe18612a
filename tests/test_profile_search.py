"""Profile searches, the alignment filter, reassignment, domains and file workflows on small tables, against plain versions."""

import random

import numpy as np
import pytest

from manyfold.operators import alignment, profile_search, profiles
from manyfold.operators.candidates import diagonal_score, encode, rolling_hashes
from manyfold.plans import files, workflows

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def text(rng, n):
    return "".join(rng.choices(LETTERS, k=n))


def changed(rng, seq, share):
    return "".join(rng.choice(LETTERS) if rng.random() < share else c for c in seq)


def rows_of(seq, match=16, mismatch=-8):
    return [(1, i, c, match if c == s else mismatch) for i, s in enumerate(seq) for c in LETTERS]


def test_a_profile_of_one_sequence_scores_like_it(spark):
    rng = random.Random(1)
    query = text(rng, 60)
    targets = {k: text(rng, 20) + changed(rng, query, 0.2) + text(rng, 30) for k in range(10, 16)} | {20: text(rng, 90), 21: ""}
    frame = spark.createDataFrame(list(targets.items()), "key long, seq string")
    scores = spark.createDataFrame(rows_of(query), "key long, place long, letter string, score int")
    pairs = spark.createDataFrame([(1, k) for k in targets], "key long, target long")
    got = {r.target: r for r in profile_search.align_profiles(pairs, profile_search.pack(scores), frame, most_evalue=1e9).collect()}
    plain = alignment.Scoring(16, -8, profile_search.OPEN, profile_search.EXTEND)
    for k, seq in targets.items():
        if seq:
            want = alignment.smith_waterman(encode(query), encode(seq), plain)
            assert (got[k].score, got[k].qstart, got[k].qend, got[k].tstart, got[k].tend) == want[:5]
    back = {r.key: r for r in profile_search.transposed(profile_search.align_profiles(pairs, profile_search.pack(scores), frame)).collect()}
    assert back and all(r.target == 1 and r.qlen == len(targets[k]) for k, r in back.items())


def test_iterations_reach_further(spark):
    rng = random.Random(4)
    first = text(rng, 120)
    near = [changed(rng, first, 0.12) for _ in range(12)]
    targets = spark.createDataFrame([(i, s) for i, s in enumerate(near)] + [(100 + i, text(rng, 120)) for i in range(10)], "key long, seq string")
    queries = spark.createDataFrame([(1, first)], "key long, seq string")
    background = spark.createDataFrame([(c, 1 / 20) for c in LETTERS], "letter string, share double")
    options = workflows.SearchOptions(k=4, least_score=15)
    one = workflows.search(queries, targets, options)
    more = workflows.iterative_profile_search(queries, targets, background, 2, options).collect()
    assert {r.target for r in more} >= {r.target for r in one.collect()} and not any(r.target >= 100 for r in more)
    assert sorted(r.pos for r in more) == list(range(1, len(more) + 1))
    scores = workflows.profile_scores(one, queries, targets, background)
    hits = workflows.search_target_profiles(targets, scores, options).collect()
    assert {r.key for r in hits} == set(range(12)) and {r.target for r in hits} == {1}
    sliced = workflows.search_in_slices(queries, targets, 3, options)
    assert sorted((r.pos, r.target, r.score) for r in sliced.collect()) == sorted((r.pos, r.target, r.score) for r in one.collect())


def brute_filter(rows, key, most):
    own = next((r for m, r in rows if m == key))
    taken = [(key, own)]
    for m, r in sorted((x for x in rows if x[0] != key), key=lambda x: (-sum(c != "-" for c in x[1]), x[0])):
        if all(sum(a == b != "-" for a, b in zip(r, t, strict=True)) <= most * max(1, sum(a != "-" != b for a, b in zip(r, t, strict=True))) for _, t in taken):
            taken.append((m, r))
    return sorted(m for m, _ in taken)


def test_alignment_filter(spark):
    rng = random.Random(2)
    first = text(rng, 50)
    rows = [(7, first)] + [(10 + i, "".join(c if rng.random() > 0.1 else "-" for c in changed(rng, first, rng.choice([0.02, 0.3])))) for i in range(30)]
    frame = spark.createDataFrame([(7, m, r) for m, r in rows], "key long, member long, row string")
    for most in (0.5, 0.8, 1.0):
        got = sorted(r.member for r in profiles.filter_msa(frame, most_identity=most).collect())
        assert got == brute_filter(rows, 7, most)
    some = profiles.filter_msa(frame, most_identity=0.95, diff=5).count()
    assert 5 <= some <= profiles.filter_msa(frame, most_identity=0.95).count()
    assert profiles.filter_msa(frame, least_identity=0.9).count() < len(rows)
    assert profiles.filter_msa(frame.limit(0)).count() == 0


def test_domains_are_carried_to_members(spark):
    star = [(1, 1, i, c) for i, c in enumerate("ABCDEFGH")] + [(1, 2, 2, "C"), (1, 2, 3, "-"), (1, 2, 4, "X"), (1, 2, 5, "F"), (1, 3, 0, "A")]
    found = spark.createDataFrame([(1, 9, 3, 5)], "key long, domain long, qstart long, qend long")
    got = profile_search.extract_domains(found, spark.createDataFrame(star, "key long, member long, place long, letter string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 9, 3, 5, 3, 1.0), (1, 2, 9, 1, 2, 2, 0.5)]


def test_expansion_takes_what_meets_no_earlier_interval(spark):
    schema = "key long, target long, qstart long, tstart long, cigar string"
    first = spark.createDataFrame([(1, 10, 0, 0, "5M"), (1, 11, 3, 0, "6M"), (1, 12, 20, 0, "4M"), (1, 13, 6, 0, "3M")], schema)
    second = spark.createDataFrame([(m, 99, 0, 40, "6M") for m in (10, 11, 12, 13)], schema)
    got = alignment.expand_alignments(first, second).collect()
    assert sorted((r.via, r.qstart, r.qend) for r in got) == [(10, 0, 4), (12, 20, 23), (13, 6, 8)]


def test_reassignment_moves_far_members(spark):
    rng = random.Random(9)
    a, b = text(rng, 80), text(rng, 80)
    table = spark.createDataFrame([(1, a), (2, changed(rng, a, 0.05)), (3, b), (4, changed(rng, b, 0.05)), (5, text(rng, 80))], "key long, seq string")
    wrong = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (3, 3), (3, 5)], "rep long, member long")
    assert sorted((r.rep, r.member) for r in workflows.reassigned(wrong, table, 6).collect()) == [(1, 1), (1, 2), (3, 3), (3, 4), (5, 5)]
    pairs = spark.createDataFrame([(1, 2, 9), (3, 4, 9), (1, 3, 9)], "key long, target long, score long")
    assert sorted((r.rep, r.member) for r in workflows.align_and_cluster(pairs, table).collect()) == [(1, 1), (1, 2), (3, 3), (3, 4), (5, 5)]


def test_diagonal_scores_match_a_running_sum():
    rng = random.Random(3)
    for _ in range(200):
        q, t = text(rng, rng.randint(0, 12)), "".join(rng.choices("ACD", k=rng.randint(0, 12)))
        q = "".join(rng.choices("ACD", k=len(q)))
        d = rng.randint(-12, 12)
        got = diagonal_score(encode(q), encode(t), d)
        run = best = began = 0
        start = end = -1
        q0, t0 = max(d, 0), max(-d, 0)
        pairs = list(zip(q[q0:], t[t0:], strict=False))
        for i, (x, y) in enumerate(pairs):
            run += 2 if x == y else -1
            if run > best:
                best, start, end = run, began, i
            if run <= 0:
                run, began = 0, i + 1
        assert (got["score"], got["start"], got["end"], got["overlap"]) == (best, start, end, len(pairs))
        assert got["identical"] == sum(x == y for x, y in pairs)


def test_rolling_hashes_are_those_of_single_words():
    rng = random.Random(5)
    seq = text(rng, 50) + "éß\U0001F600"
    whole = rolling_hashes(seq, 7)
    assert whole.tolist() == [int(rolling_hashes(seq[i:i + 7], 7)[0]) for i in range(len(seq) - 6)]
    assert len(np.unique(whole)) == len({seq[i:i + 7] for i in range(len(seq) - 6)}) and not len(rolling_hashes("abc", 7))


@pytest.fixture
def fasta(tmp_path):
    rng = random.Random(6)
    a, b = text(rng, 90), text(rng, 90)
    (tmp_path / "one.fasta").write_text(f">a1 x\n{a}\n>b1\n{b}\n")
    (tmp_path / "two.fasta").write_text(f">a2\n{changed(rng, a, 0.03)}\n>c1\n{text(rng, 90)}\n")
    (tmp_path / "map").write_text("a2\t5\nc1\t6\n")
    (tmp_path / "nodes").write_text("1\t|\t1\t|\tno rank\t|\n5\t|\t1\t|\tspecies\t|\n6\t|\t1\t|\tspecies\t|\n")
    (tmp_path / "names").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n5\t|\tfive\t|\t\t|\tscientific name\t|\n6\t|\tsix\t|\t\t|\tscientific name\t|\n")
    return tmp_path


def lines(spark, path):
    return sorted(r.value for r in spark.read.text(path).collect())


def test_file_workflows(spark, fasta):
    one, two, out = f"{fasta}/one.fasta", f"{fasta}/two.fasta", f"{fasta}/out"
    paths = files.easy_linear_cluster(spark, [one, two], f"{out}/c", k=6)
    assert lines(spark, paths["clusters"]) in (["a1\ta1", "a1\ta2", "b1\tb1", "c1\tc1"], ["a2\ta1", "a2\ta2", "b1\tb1", "c1\tc1"])
    assert sum(v.startswith(">") for v in lines(spark, paths["representatives"])) == 3
    assert [x.split("\t")[:2] for x in lines(spark, files.easy_search(spark, one, two, f"{out}/s"))] == [["a1", "a2"]]
    assert [x.split("\t")[:2] for x in lines(spark, files.easy_linear_search(spark, one, two, f"{out}/l"))] == [["a1", "a2"]]
    assert [x.split("\t")[:2] for x in lines(spark, files.easy_reciprocal(spark, one, two, f"{out}/r"))] == [["a1", "a2"]]
    taxa = files.easy_taxonomy(spark, one, two, f"{fasta}/map", f"{fasta}/nodes", f"{fasta}/names", f"{out}/t")
    assert [x.split("\t") for x in lines(spark, taxa["lca"])][0] == ["a1", "5", "species", "five"]
    assert [x.split("\t")[:2] for x in lines(spark, files.easy_proteome_cluster(spark, [one, two], f"{out}/p", 0.4))] in ([["0", "0"], ["0", "1"]], [["1", "0"], ["1", "1"]])
    assert "0\t0\t0.5" in lines(spark, files.easy_proteome_search(spark, [one], [two], f"{out}/q"))
    assert len(lines(spark, files.easy_set_search(spark, [one], [two], f"{out}/m"))) == 1
