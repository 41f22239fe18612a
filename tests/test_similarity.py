import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from manyfold.operators import alignment, candidates, clustering, profiles
from manyfold.plans import workflows

DNA = "ACGT"


def mutate(rng, text, chance):
    out = []
    for c in text:
        x = rng.random()
        if x < chance / 3:
            continue
        out.append(rng.choice(DNA) if x < chance else c)
        if x > 1 - chance / 3:
            out.append(rng.choice(DNA))
    return "".join(out)


def plain_score(a, b, s):
    """Affine local alignment, cell by cell."""
    n, m, low, best = len(a), len(b), -(10**9), 0
    top = [[0] * (m + 1) for _ in range(n + 1)]
    down, across = [[low] * (m + 1) for _ in range(n + 1)], [[low] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            down[i][j] = max(top[i - 1][j] - s.open, down[i - 1][j] - s.extend)
            across[i][j] = max(top[i][j - 1] - s.open, across[i][j - 1] - s.extend)
            top[i][j] = max(0, top[i - 1][j - 1] + (s.match if a[i - 1] == b[j - 1] else s.mismatch), down[i][j], across[i][j])
            best = max(best, top[i][j])
    return best


@pytest.mark.parametrize("rows", [3, 128])
def test_smith_waterman(monkeypatch, rows):
    monkeypatch.setattr(alignment, "ROWS", rows)
    rng, s = random.Random(rows), alignment.Scoring()
    for _ in range(80):
        a = "".join(rng.choices(DNA, k=rng.randint(0, 40)))
        b = mutate(rng, a, 0.3) if rng.random() < 0.7 else "".join(rng.choices(DNA, k=rng.randint(0, 40)))
        score, q0, q1, t0, t1, path = alignment.smith_waterman(candidates.encode(a), candidates.encode(b), s)
        assert score == plain_score(a, b, s)
        if score:
            i, j, total, last = q0, t0, 0, ""
            for c in path:
                if c == "M":
                    total += s.match if a[i] == b[j] else s.mismatch
                else:
                    total -= s.extend if c == last else s.open
                i, j, last = i + (c != "D"), j + (c != "I"), c
            assert (i - 1, j - 1, total) == (q1, t1, score)
            assert alignment.expand(alignment.compress(path)) == path


def test_evalue_falls_with_score_and_grows_with_the_table():
    values = [alignment.evalue(s, 200, 10**6) for s in (20, 40, 80, 160)]
    assert values == sorted(values, reverse=True) and alignment.evalue(40, 200, 10**7) > values[1] > 0


def test_compose():
    # A-B shifted by 2 with a gap, B-C identical
    got = alignment.compose((2, 0, "MMMIMM"), (0, 5, "MMMMM"))
    assert got == (2, 5, "MMMIMM")
    assert alignment.compose((0, 0, "MM"), (5, 0, "MM")) is None
    assert alignment.compose((0, 0, "MMDMM"), (0, 0, "MMIMM")) == (0, 0, "MMMM")


def test_forward_backward_is_a_chance():
    a = candidates.encode("ACGTACGGT")
    chance = alignment.forward_backward(a, a)
    assert (chance >= 0).all() and (chance <= 1 + 1e-9).all() and np.argmax(chance, 1).tolist() == list(range(len(a)))


def test_stop_rule(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.random() < 0.4) for k in range(20) for i in range(12)]
    got = {(r.key, r.place) for r in alignment.stop_rule(spark.createDataFrame(rows, "key long, place long, accepted boolean"), [F.col("place")], 3, 2).collect()}
    want = set()
    for k in range(20):
        taken = rejected = 0
        for _, i, ok in [r for r in rows if r[0] == k]:
            if taken >= 3 or rejected >= 2:
                break
            want.add((k, i))
            taken, rejected = (taken + 1, 0) if ok else (taken, rejected + 1)
    assert got == want


def sequences(spark, n=40, seed=1):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choices(DNA, k=rng.randint(60, 200)))) for i in range(n // 2)]
    rows += [(n + i, "".join(rng.choice(DNA) if rng.random() < 0.03 else c for c in rows[rng.randrange(n // 2)][1])) for i in range(n // 2)]
    return rows


def test_ungapped_scan(spark):
    rows = sequences(spark)
    table = spark.createDataFrame([*rows, (900, ""), (901, None)], "key long, seq string")
    queries = table.where("key < 5")
    got = {(r.key, r.target): r.score for r in candidates.scan_ungapped(queries, table, 20, 1000).collect()}
    for k, q in rows[:5]:
        for t, seq in rows:
            best = 0
            for d in range(-len(seq), len(q)):
                run = 0
                for i in range(max(0, d), min(len(q), len(seq) + d)):
                    run = max(0, run + (2 if q[i] == seq[i - d] else -1))
                    best = max(best, run)
            assert got.get((k, t), 0) == (best if best > 20 else 0)


def test_neighbours(spark):
    words = spark.createDataFrame([(1, 0, "AC")], "key long, place long, kmer string")
    assert {r.kmer for r in candidates.neighbours(words, "ACG").collect()} == {"AC", "CC", "GC", "AA", "AG"}


def graph(rng, n=60, m=90):
    nodes = [(i, rng.randint(1, 9)) for i in range(n)]
    edges = [(rng.randrange(n), rng.randrange(n), rng.randint(1, 5)) for _ in range(m)]
    return nodes, edges


def test_greedy_by_length(spark):
    for seed in (1, 2):
        nodes, edges = graph(random.Random(seed))
        got = {(r.rep, r.member) for r in clustering.greedy_by_length(spark.createDataFrame(nodes, "key long, length long"), spark.createDataFrame(edges, "src long, dst long, score long")).collect()}
        owner = {}
        for k, _ in sorted(nodes, key=lambda x: (-x[1], x[0])):
            if k not in owner:
                owner[k] = k
                for a, b, _ in edges:
                    if a == k and b not in owner:
                        owner[b] = k
        assert got == {(r, m) for m, r in owner.items()}


def test_set_cover(spark):
    for seed in (3, 4):
        nodes, edges = graph(random.Random(seed))
        got = clustering.set_cover(spark.createDataFrame(nodes, "key long, length long"), spark.createDataFrame(edges, "src long, dst long, score long")).collect()
        near = {k: {k} for k, _ in nodes}
        for a, b, _ in edges:
            near[a].add(b)
            near[b].add(a)
        length, left, reps = dict(nodes), set(near), []
        while left:
            best = min((k for k in near if near[k] & left), key=lambda k: (-len(near[k] & left), -length[k], k))
            reps.append(best)
            left -= near[best]
        assert {r.rep for r in got} == set(reps) and sorted(r.member for r in got) == sorted(near)
        assert all(r.member in near[r.rep] for r in got)


def test_hash_buckets(spark):
    rows = [(1, "AAAA"), (2, "AAAA"), (3, "AABB"), (4, "BBBB"), (5, "BBBA"), (6, ""), (7, ""), (8, "AAAAA")]
    table = spark.createDataFrame(rows, "key long, seq string")
    assert {(r.rep, r.member) for r in clustering.by_hash(table, 0.75, ("B", "A")).collect()} == {(1, 1), (1, 2), (3, 3), (4, 4), (4, 5), (6, 6), (6, 7), (8, 8)}


def test_linear_cluster_and_update(spark):
    rng = random.Random(7)
    base = ["".join(rng.choices(DNA, k=150)) for _ in range(8)]
    rows = [(i, f"h{i}", base[i % 8] if i < 8 else base[i % 8][:75] + rng.choice(DNA) + base[i % 8][76:]) for i in range(32)]
    table = spark.createDataFrame(rows, "key long, header string, seq string")
    clusters = workflows.linear_cluster(table.select("key", "seq"))
    groups = {}
    for r in clusters.collect():
        groups.setdefault(r.rep, set()).add(r.member)
    assert sorted(map(sorted, groups.values())) == sorted([i, i + 8, i + 16, i + 24] for i in range(8))
    fresh = [(100 + i, h, s) for i, h, s in rows[4:]] + [(200, "new1", base[1]), (201, "new2", "".join(rng.choices(DNA, k=150)))]
    updated = {r.member: r.rep for r in workflows.update_clusters(table, spark.createDataFrame(fresh, "key long, header string, seq string"), clusters).collect()}
    assert set(updated) == {k for k, *_ in fresh} and updated[201] == 201 and updated[200] == updated[109] == updated[117]


def test_star_and_profile(spark):
    sequences = spark.createDataFrame([(1, "ACGTACGT"), (2, "GTAC"), (3, "ACCTACGT")], "key long, seq string")
    hits = spark.createDataFrame([(1, 2, 2, 5, 0), (1, 3, 0, 7, 0)], "key long, target long, qstart long, qend long, tstart long")
    star = profiles.star_ungapped(hits, sequences)
    assert {(r.member, r.row) for r in profiles.msa_rows(star, sequences).collect()} == {(1, "ACGTACGT"), (2, "--GTAC--"), (3, "ACCTACGT")}
    assert profiles.consensus(profiles.counts(star)).first().seq == "ACGTACGT"
    assert math.isclose(sum(r.weight for r in profiles.weights(star).collect()), 1.0)
    shares = profiles.frequencies(star, profiles.weights(star))
    assert all(1 <= r.neff <= 2 for r in profiles.diversity(shares).collect())
    background = spark.createDataFrame([(c, 0.25) for c in DNA], "letter string, share double")
    scores = {(r.place, r.letter): r.score for r in profiles.log_odds(shares, background).collect()}
    assert len(scores) == 32 and scores[0, "A"] > 0 > scores[0, "T"]
    gapped = spark.createDataFrame([(1, 3, 0, 7, 0, "2M1I2M1D3M")], "key long, target long, qstart long, qend long, tstart long, cigar string")
    row = {r.member: r.row for r in profiles.msa_rows(profiles.star_gapped(gapped, sequences), sequences).collect()}
    assert row == {3: "AC-CTCGT"}


def test_gapped_scan(spark):
    rows = [(k, s[:50]) for k, s in sequences(spark, 12, 5)]
    table = spark.createDataFrame([*rows, (900, ""), (901, None)], "key long, seq string")
    got = {(r.key, r.target): r.score for r in alignment.scan_gapped(table.where("key < 3"), table, 0.8, 1e9, 1000).collect()}
    s = alignment.Scoring()
    assert got == {(k, t): plain_score(q, seq, s) for k, q in rows[:3] for t, seq in rows}


def test_align_members_and_transitive(spark):
    base = "".join(random.Random(9).choices(DNA, k=80))
    table = spark.createDataFrame([(1, base), (2, base[:40] + "T" + base[40:]), (3, base[5:])], "key long, seq string")
    entries = spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "key long, target long")
    found = {(r.key, r.target): r.cigar for r in alignment.align_members(entries, table).collect()}
    assert len(found) == 9 and found[1, 2] == "40M1D40M" and found[2, 1] == "40M1I40M"
    star = alignment.align(spark.createDataFrame([(1, 2, 0), (1, 3, 0)], "key long, target long, score long"), table, table)
    through = {(r.key, r.target): (r.qstart, r.tstart, r.cigar) for r in alignment.transitive(star).collect()}
    assert through == {(2, 3): (5, 0, "35M1I40M"), (3, 2): (0, 5, "35M1D40M")}
    top = alignment.align_top_region(spark.createDataFrame([(1, 3, 0)], "key long, target long, score long"), table, table).first()
    assert (top.qstart, top.qend, top.cigar) == (5, 79, "75M")


def test_chains_and_posteriors(spark):
    a = "ACGTTGCAACGGATCC"
    assert alignment.chain_kmers(a, "TT" + a[:8] + "CC" + a[8:])[1:] == (0, 15, 2, 19) and alignment.chain_kmers("AC", a)[0] == 0
    table = spark.createDataFrame([(1, a), (2, ""), (3, None)], "key long, seq string")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (3, 1)], "key long, target long")
    got = {(r.key, r.target): r.matched for r in alignment.posterior_pairs(pairs, table, table).collect()}
    assert got == {(1, 1): len(a), (1, 2): 0, (3, 1): 0}
    assert {(r.key, r.target) for r in alignment.align_by_kmers(pairs, table, table).collect()} == {(1, 1)}


def test_lambda():
    scores = {(a, b): 1 if a == b else -1 for a in DNA for b in DNA}
    assert math.isclose(alignment.gumbel_lambda(scores, dict.fromkeys(DNA, 0.25)), math.log(3), rel_tol=1e-9)
    with pytest.raises(ValueError):
        alignment.gumbel_lambda({("A", "A"): 1.0}, {"A": 1.0})


def test_pick_consensus(spark):
    good = "".join(random.Random(3).choices(DNA, k=90))
    rows = [(1, good[:30] + "ACGTACGTAC" + good[40:]), (2, good), (3, good), (4, good), (9, "TTTT")]
    table = spark.createDataFrame(rows, "key long, seq string")
    clusters = spark.createDataFrame([(1, k) for k in (1, 2, 3, 4)] + [(9, 9)], "rep long, member long")
    background = spark.createDataFrame([(c, 0.25) for c in DNA], "letter string, share double")
    assert {(r.rep, r.member) for r in workflows.pick_consensus(clusters, table, background).collect()} == {(2, k) for k in (1, 2, 3, 4)} | {(9, 9)}
    enriched = workflows.enrich_profiles(table.where("key = 2"), table.where("key < 9"), background, workflows.SearchOptions(k=8, least_score=20))
    assert enriched.select("place").distinct().count() == 90


def test_map_accessions_and_contigs(spark):
    nodes = spark.createDataFrame([(1, 1, "no rank", "root"), (2, 1, "genus", "G"), (3, 2, "species", "A"), (4, 2, "species", "B")], "taxid long, parent long, rank string, name string")
    headers = spark.createDataFrame([(1, "sp|P1|x\x01P2 y"), (2, "P1"), (3, "nothing")], "key long, header string")
    known = spark.createDataFrame([("P1", 3), ("P2", 4)], "accession string, taxid long")
    assert {r.key: r.taxid for r in workflows.map_accessions(headers, known, nodes).collect()} == {1: 2, 2: 3, 3: 0}
    rng = random.Random(4)
    gene = "ATG" + "".join(rng.choice(["GCT", "TGG", "AAA", "GAT", "CTG", "TTC"]) for _ in range(60)) + "TAA"
    contigs = spark.createDataFrame([(1, "CC" + gene + "G"), (2, "ACGT")], "key long, seq string")
    from manyfold.functions.sequence import translate_codons

    proteins = contigs.where("key = 1").select(F.lit(50).cast("long").alias("key"), translate_codons(F.lit(gene[:-3])).alias("seq"))
    options = workflows.SearchOptions(k=5, least_score=20)
    found = workflows.translated_search(contigs, proteins, 30, options).first()
    assert (found.key, found.target, found.qstart, found.qend) == (1, 50, 2, 2 + len(gene) - 4)
    mapping = spark.createDataFrame([(50, 4)], "item long, taxid long")
    assert {r.key: r.taxid for r in workflows.aggregate_contigs(contigs, proteins, mapping, nodes, 30, options).collect()} == {1: 4, 2: 0}


def test_filter_members(spark):
    key = "ACGTACGTAC"
    rows = [(1, 1, key), (1, 2, key[:6]), (1, 3, key[:6]), (1, 4, "TTTTTTTTTT"), (1, 5, key[:2])]
    star = spark.createDataFrame([(k, m, p, c) for k, m, seq in rows for p, c in enumerate(seq)], "key long, member long, place long, letter string")
    got = {r.member: (round(r.coverage, 2), round(r.identity, 2)) for r in profiles.filter_members(star, 0.5, 0.5).collect()}
    assert got == {1: (1.0, 1.0), 2: (0.6, 1.0)}  # 3 repeats 2, 4 differs, 5 is short


def test_cover_sets(spark):
    members = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b"), (6, "c"), (7, "d")], "key long, set_id string")
    clusters = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (1, 4), (2, 5), (6, 6), (7, 7)], "rep long, member long")
    got = {(r.rep, r.member): (r.shared, r.share) for r in clustering.cover_sets(members, clusters, 0.5).collect()}
    assert got == {("a", "a"): (3, 1.0), ("a", "b"): (2, 1.0), ("c", "c"): (1, 1.0), ("d", "d"): (1, 1.0)}


def test_similar_words_find_what_equal_ones_miss(spark):
    base = "".join(random.Random(5).choices("ABCDEFGHIJ", k=60))
    other = "".join("K" if i % 6 == 5 else c for i, c in enumerate(base))
    table = spark.createDataFrame([(1, base)], "key long, seq string"), spark.createDataFrame([(2, other)], "key long, seq string")
    assert candidates.match_diagonals(*table, k=6).isEmpty()
    found = candidates.match_diagonals(*table, k=6, alphabet="ABCDEFGHIJK").first()
    assert (found.key, found.target, found.diagonal, found.score) == (1, 2, 0, 50 * 2 - 9)  # the last letter differs and is left off


def test_cluster_cascade_reaches_its_last_step(spark, tmp_path):
    """Two sequences share one word of six letters and no longer one: the last pass alone proposes them, by a single match."""
    from manyfold.catalog import reports

    rng = random.Random(11)
    one = [rng.choice("abcdefghijklmnopqrst") for _ in range(120)]
    two = list(one)
    for at in (*range(5, 54, 6), *range(60, 120, 6)):
        two[at] = "z"
    assert max(map(len, "".join(a if a == b else " " for a, b in zip(one, two, strict=True)).split())) == 6
    other = [rng.choice("abcdefghijklmnopqrst") for _ in range(120)]
    spark.createDataFrame([(1, "".join(one)), (2, "".join(two)), (3, "".join(other))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.member: r.rep for r in reports.catalog.queries["cluster_cascade"](spark, str(tmp_path)).collect()}
    assert found[1] == found[2] != found[3]


def test_pairs_in_bands_are_aligned_as_alone(monkeypatch):
    draw = random.Random(5)
    letters = lambda n, alphabet="ABCD": "".join(draw.choice(alphabet) for _ in range(n))
    pairs = []
    for k in range(40):
        q = letters(draw.choice((70, 150, 400)), "AB" if k % 4 == 0 else "ABCDEFGH")
        t = "".join(draw.choice(("", x + letters(draw.choice((1, 7)), "AB"), "C")) if draw.random() < 0.08 else x for x in q)
        pairs.append((q, t[k:] + t[:k] if k % 5 == 0 else t))
    pairs += [("", "A"), ("ABC", "xabcabc"), ("zzABCAB", "ab"), (letters(90), letters(90))]
    s, p = alignment.Scoring(), alignment.GUMBEL["nucleotide", 5, 2]
    want = [alignment.align_pair(q, t, s, 9999, p) for q, t in pairs]
    alone = []
    monkeypatch.setattr(alignment, "smith_waterman", lambda a, b, *rest, plain=alignment.smith_waterman: alone.append(len(a)) or plain(a, b, *rest))
    assert alignment.align_pairs([q for q, _ in pairs], [t for _, t in pairs], s, 9999, p) == want
    assert len(alone) < len(pairs) // 2
    monkeypatch.setattr(alignment, "BAND_CELLS", 3000)
    assert alignment.align_pairs([q for q, _ in pairs], [t for _, t in pairs], s, 9999, p) == want


def test_easy_cluster_runs_all_steps(monkeypatch):
    from manyfold.catalog import formats

    given = {}
    monkeypatch.setattr(formats, "_fasta", lambda *a: "f")
    monkeypatch.setattr(formats, "_folder", lambda *a: "o")
    monkeypatch.setattr(formats, "_lines", lambda *a: None)
    monkeypatch.setattr(formats.files, "easy_cluster", lambda *a, **options: given.update(options) or {"clusters": ""})
    formats.catalog.queries["easy_cluster"](None, "d")
    assert given == {}


def test_packed_profiles_are_those_of_letters(spark):
    draw = random.Random(3)
    texts = {k: "".join(draw.choice("ABCD") for _ in range(30)) for k in range(1, 4)}
    texts |= {k: texts[k % 3 + 1][:20] + "".join(draw.choice("ABCD") for _ in range(10)) for k in range(4, 12)} | {12: texts[3], 13: texts[3]}
    table = spark.createDataFrame(list(texts.items()), "key long, seq string")
    hits = spark.createDataFrame([(k % 3 + 1, k, k % 4, k % 4 + 19, 0) for k in range(4, 12)] + [(1, k, 2, 21, 0) for k in (12, 13)], "key long, target long, qstart long, qend long, tstart long")
    background = spark.createDataFrame([("A", 0.4), ("B", 0.3), ("C", 0.2), ("D", 0.1)], "letter string, share double")
    star = profiles.star_ungapped(hits, table)
    shares = profiles.frequencies(star, profiles.weights(star))
    scores = profiles.log_odds(shares, background)
    packed = profiles.packed_star(hits, table)
    assert packed.count() < star.select("key", "member").distinct().count()
    told = lambda t: sorted(map(tuple, t.collect()))
    assert told(profiles.spread_scores(profiles.packed_profile(packed, background, "scores"), background)) == told(scores)
    assert told(profiles.packed_profile(packed, background, "best")) == told(profiles.pick_representative(profiles.member_scores(star, scores)))
    want = {(r.key, r.place): r.neff for r in profiles.diversity(shares).collect()}
    got = {(r.key, r.place): r.neff for r in profiles.packed_profile(packed, background, "neff").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    codons = table.select("key", F.regexp_replace("seq", "(.)", "$1$1$1").alias("seq"))
    assert told(profiles.codon_rows_ungapped(hits, codons, table)) == told(profiles.codon_rows(star, codons, table))


def test_many_queries_in_few_targets(spark, monkeypatch):
    draw = random.Random(9)
    texts = ["".join(draw.choice("ABCD") for _ in range(60)) for _ in range(30)]
    many = spark.createDataFrame([*enumerate(texts), (99, None)], "key long, seq string")
    few = spark.createDataFrame([(k, texts[k][5:40] + texts[k + 1][:9]) for k in range(3)], "key long, seq string")
    told = lambda: sorted(map(tuple, candidates.shared_diagonals(many, few, 6).collect()))
    want, asked = told(), []
    monkeypatch.setattr(candidates, "BROADCAST_WORDS", 500)
    monkeypatch.setattr(candidates, "wanted_words", lambda *a, plain=candidates.wanted_words: asked.append(1) or plain(*a))
    assert told() == want and want and asked
