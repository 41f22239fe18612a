import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from manyfold.functions import masking, predicates, sequence
from manyfold.functions.expressions import compile_expression
from manyfold.operators import hierarchy, hits, keyed

CONTIG = "CGAAGCGGGTGATGGCCGGCGCCGCGCCGGTTGGCGGCTGGCCATTCAAGGAGTGAGGAGATGGTCACTGGGCAGCGCGCCGGGGGGCGGCAGCAGCCCAAGGGTCGGGTCATTCCCGATTGGCCGCACCAGGCGCCCGCCACAGCCGGA"


@pytest.mark.parametrize("text, value", [("sqrt($1^2+$2^2)", 5.0), ("$1 + $2 * 2", 11.0), ("-$1 + 1", -2.0), ("!0 && $1 < $2", 1.0), ("fac(4) / ncr(4, 2)", 4.0), ("7 % 4 == 3 || 0", 1.0), ("(1, 2)", 2.0), ("log 100", 2.0), ("atan2(0, 1) + pi - pi", 0.0), ("2^3^2", 64.0)])
def test_expressions(spark, text, value):
    row = spark.createDataFrame([(3.0, 4.0)], "a double, b double").select(compile_expression(text, ["a", "b"]).alias("v")).first()
    assert math.isclose(row.v, value, abs_tol=1e-12)


@pytest.mark.parametrize("text", ["$3", "nothing(1)", "1 +", "(1", "1 2", "ncr(1)", "#"])
def test_bad_expressions(spark, text):
    with pytest.raises(ValueError):
        compile_expression(text, ["a", "b"])


def test_open_reading_frames_of_a_known_sequence(spark):
    contig = spark.createDataFrame([(1, CONTIG)], "key long, seq string")
    found = sequence.open_reading_frames(contig, 1, 300, 0).collect()
    by = {f: [r.orf for r in sorted(found, key=lambda r: r.start) if r.frame == f] for f in (1, 2)}
    # the stop codon is no part of a frame
    assert by[1] == ["CGAAGCGGG", "ATGGTCACTGGGCAGCGCGCCGGGGGGCGGCAGCAGCCCAAGGGTCGGGTCATTCCCGATTGGCCGCACCAGGCGCCCGCCACAGCCGGA"]
    assert len(by[2]) == 1 and CONTIG[1:].startswith(by[2][0][:30])
    for r in sequence.open_reading_frames(contig, 1).collect():
        part = CONTIG[r.start:r.stop + 1] if r.frame > 0 else CONTIG[r.stop:r.start + 1][::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert part == r.orf and len(part) == 3 * r.codons


def test_sequence_functions(spark):
    one = lambda c, s: spark.createDataFrame([(s,)], "seq string").select(c.alias("v")).first().v
    seq = F.col("seq")
    assert one(sequence.reverse_complement(seq), "AACGt") == "aCGTT"
    assert one(sequence.translate_codons(seq), "ATGTAAGGNTT") == "M*X" and one(sequence.translate_codons(seq, stop=True), "ATG") == "*M*"
    assert one(sequence.translate_codons(seq, 2), "AGATGA") == "*W"
    assert one(sequence.back_translate(seq), "MX*") == "ATGNNNTAA"
    assert one(sequence.mask_runs(seq, 3), "AAACCGGGG") == "aaaCCgggg"
    assert one(sequence.accession(seq), "sp|P12345|NAME text") == "P12345" and one(sequence.accession(seq), "consensus_abc d") == "abc"
    table = spark.createDataFrame([(1, "ABCDEFGH"), (2, ""), (3, "AB")], "key long, seq string")
    assert [(r.key, r.part, r.start, r.seq) for r in sequence.split_sequence(table, 4, 1).orderBy("key", "part").collect()] == [(1, 0, 0, "ABCD"), (1, 1, 3, "DEFG"), (1, 2, 6, "GH"), (3, 0, 0, "AB")]
    assert {(r.key, r.place, r.kmer) for r in sequence.kmers(table, 7).collect()} == {(1, 0, "ABCDEFG"), (1, 1, "BCDEFGH")}
    regions = spark.createDataFrame([(1, 2, 3), (1, 7, 99), (3, 5, 9), (2, 1, 4)], "key long, start long, stop long")
    assert {r.key: r.seq for r in sequence.mask_regions(table, regions).collect()} == {1: "AXXDEFXX", 2: "", 3: "AB"}


def test_masking_finds_repeats():
    rng = random.Random(1)
    plain = "".join(rng.choices("ACGTDEFHIK", k=120))
    masked, kept, empty = masking.mask_batch([plain + "ACGTT" * 30 + plain[::-1], plain, ""])
    assert kept.isupper() and empty == "" and masked[130:255].islower() and masked[:100].isupper() and masked[-80:].isupper()


def test_predicates(spark):
    rows = spark.createDataFrame([(100, 80), (100, 40), (50, 100)], "q long, t long")
    got = [[r.v for r in rows.select(predicates.can_be_covered(0.7, m, F.col("q"), F.col("t")).alias("v")).collect()] for m in range(6)]
    assert got == [[True, False, False], [True, True, False], [True, False, True], [True, False, False], [False, False, False], [True, False, False]]
    assert [predicates.swapped_mode(m) for m in range(6)] == [0, 2, 1, 4, 3, 5]


def test_taxon_expressions(spark):
    rows = spark.createDataFrame([(1, [1, 2, 7]), (2, [1, 2, 9]), (3, [1, 3])], "k long, a array<long>")
    for text, want in (("2&&!9", {1}), ("7||3", {1, 3}), ("!2", {3}), ("(2&&!7),3", {2, 3}), ("1", {1, 2, 3}), ("5", set())):
        assert {r.k for r in rows.where(hierarchy.taxon_expression(text, F.col("a"))).collect()} == want
    for bad in ("", "(2", "2 2", "x", "2&&"):
        with pytest.raises(ValueError):
            hierarchy.taxon_expression(bad, F.col("a"))


def test_deep_hierarchy(spark):
    nodes = spark.createDataFrame([(1, 1, "no rank", "root"), *[(i, i - 1, "clade", f"n{i}") for i in range(2, 41)]], "taxid long, parent long, rank string, name string")
    paths = hierarchy.closure(nodes)
    assert paths.count() == 40 * 41 // 2 and paths.where("taxid = 40 and ancestor = 1").first().up == 39


def test_multihit_p_values():
    assert hits._multihit([0.0, -0.1], 10, 1.0) == 1.0 and hits._multihit([-math.inf], 10, 1.0) == 0.0
    many, few = hits._multihit([-9.0, -8.0, -7.0], 10, 1.0), hits._multihit([-9.0], 10, 1.0)
    assert 0 < many < few < 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "key long, pos long, target long, score double, evalue double, identity double, qstart long, qend long, qlen long, tstart long, tend long, tlen long")
    for found in (keyed.sort_entries(empty, "score"), keyed.beats_first(empty, "score", "ge"), keyed.transpose(empty), keyed.subtract(empty, empty), keyed.concat(empty, empty), keyed.statistics(empty, "score"), hits.coverage_summary(empty), hits.pick_domains(empty), hits.chain_diagonals(empty), hits.reciprocal_by_score(empty, empty), hits.transpose_hits(empty)):
        assert found.count() == 0


def test_ranks_and_parts_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.range(40_000).select((F.col("id") * 7919 % 40_009 * 3).alias("key"), (F.col("id") % 5 + 1).alias("w")).repartition(7)
        ranks = keyed.dense_ranks(table.select("key"), "key", "rank").orderBy("key").collect()
        parts = keyed.split(table, 6, "w").orderBy("key").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["rank"] for r in ranks] == list(range(1, 40_001))
    total, upto = sum(r.w for r in parts), 0
    for r in parts:
        assert r.part == min(5, upto * 6 // total)
        upto += r.w


def test_unknown_modes(spark):
    table = spark.createDataFrame([(1, 1, 2.0)], "key long, pos long, score double")
    with pytest.raises(ValueError):
        keyed.sort_entries(table, "score", "sideways")
    with pytest.raises(ValueError):
        keyed.beats_first(table, "score", "xx")
    assert keyed.compare(table, "score", "xx", 1.0).count() == 1


def test_domains_match_a_plain_fold(spark):
    rng = random.Random(8)
    rows = []
    for k in range(30):
        for p in range(rng.randint(1, 12)):
            a, b = rng.randrange(100), rng.randrange(100)
            rows.append((k, p + 1, p, a, b, 100, 0, rng.randrange(60), 60, rng.random()))
    table = spark.createDataFrame(rows, "key long, pos long, target long, qstart long, qend long, qlen long, tstart long, tend long, tlen long, evalue double")
    for overlap, coverage, most in ((0.2, 0.3, None), (0.0, 0.1, 0.7)):
        want = set()
        for k in range(30):
            covered = set()
            own = [r for r in rows if r[0] == k]
            if most is not None:
                own = sorted((r for r in own if r[9] < most), key=lambda r: (r[9], r[1]))
            for r in own:
                share = (r[7] + 1) / 60
                if share < coverage or most is not None and share == coverage:
                    continue
                low, high = min(r[3:5]), max(r[3:5])
                if len(covered & set(range(low, high))) / (high - low + 1) <= overlap:
                    covered |= set(range(low, high))
                    want.add((k, r[1]))
        assert {(r.key, r.pos) for r in hits.pick_domains(table, overlap, coverage, most).collect()} == want


def test_multihit_p_values_out_of_range():
    # the sum of a large set's terms is beyond any double, and so is what it is multiplied by
    assert hits._multihit([-708.0] * 300, 6000, 1.0) == 0.0
    assert math.isclose(hits._multihit([-20.0] * 5, 6000, 1.0), 5.425369534496448e-21, rel_tol=1e-9)


def test_majority_doesnt_depend_on_the_order_of_sums(spark):
    nodes = spark.createDataFrame([(1, 1, "no rank", "root"), (2, 1, "species", "a"), (3, 1, "species", "b")], "taxid long, parent long, rank string, name string")
    lined = hierarchy.lineages(nodes, hierarchy.closure(nodes))
    mapping = spark.createDataFrame([(10, 2), (11, 3)], "item long, taxid long")
    # 0.3 + 0.2 + 0.1 is less than 0.1 + 0.2 + 0.3, as doubles are summed; every entry has the same weights for both taxa
    orders = list(itertools.permutations((0.1, 0.2, 0.3, 0.7)))
    rows = [(k, t, w) for k, order in enumerate(orders) for t, ws in ((10, order), (11, orders[0])) for w in ws]
    table = spark.createDataFrame(rows, "key long, target long, w double").coalesce(1)
    found = hierarchy.majority_ancestor(table, mapping, lined, weight=F.col("w"), blocked=()).collect()
    assert len(found) == 24 and {(r.taxid, r.share, r.n, r.agreeing) for r in found} == {(2, 0.5, 8, 4)}


def test_open_reading_frames_are_read_where_they_lie(spark):
    rows = [(k, "".join(random.Random(k).choice("ACGTGN-É" if k % 3 else "ACGT") for _ in range(k * 7 % 61))) for k in range(60)] + [(99, None)]
    table = spark.createDataFrame(rows, "key long, seq string")
    found = sequence.open_reading_frames(table, 1, which=(1, 2, 3), with_length=True)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = []
    for k, s in rows:
        for f in (1, 2, 3) if s else ():
            codons, at = [s[i:i + 3] for i in range(f - 1, len(s) - 2, 3)], 0
            for i, piece in enumerate(" ".join("*" if c in ("TAA", "TAG", "TGA") else c for c in codons).split("*")):
                own = piece.split()
                if own:
                    want.append((k, f, f - 1 + 3 * at, f - 2 + 3 * (at + len(own)), len(own), i == 0, at + len(own) == len(codons), "".join(own), len(s)))
                at += len(own) + 1
    assert sorted(map(tuple, found.collect())) == sorted(want)
