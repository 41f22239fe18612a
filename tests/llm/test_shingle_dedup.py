"""The pipeline's near-dedup stage against brute-force Jaccard over sets of five-word shingles."""

import random

import duckdb

import corpus_pipeline
from manyfold.llm.shingle_dedup import near_copies

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id string, fp string"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The smallest id of each row's component, in the order of the rows."""
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    return [min(rows[b][0] for b in range(len(rows)) if find(b) == find(a)) for a in range(len(rows))]


def test_stage_on_tables(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert kept == set(brute(rows)) and not kept & {145, 177}  # of similarity 0.83 to documents 6 and 1


def test_matches_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)] + ["É", "naïve", "ZZ"]
    rows = [(1000 + i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 5, 6, 40, 90, 300]))), "x", "y") for i in range(60)]
    for i in range(200):  # copies of copies, so that groups chain, and ids that don't follow them
        words = rows[rng.randrange(len(rows))][1].split(" ")
        for _ in range(rng.randint(1, max(1, len(words) // 40))):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((rng.randrange(900) * 2 + i % 2 + 5000 * (i % 3), rng.choice([" ", "\t", "  "]).join(words), "x", "y"))
    line = " ".join(rng.choices(vocab, k=40))  # a common passage: many share buckets, few are near copies
    rows += [(20000 + i, f"{line} {' '.join(rng.choices(vocab, k=i % 12))}", "", "") for i in range(80)]
    rows = list({r[0]: r for r in rows}.values())
    rows += [(1, None, None, None), (2, "", "", ""), (3, " \n", None, None), (4, rows[0][1].upper(), "", ""), (5, "long words " * 40000, "", "")]
    got = {r.id: r.component_id for r in near_copies(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == dict(zip((r[0] for r in rows), brute(rows), strict=True))


def test_defined_cases(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(7, text, "x", "p"), (7, text + " more", "x", "q"), (9, text + " end", "x", "p"), (None, text, None, None), (8, None, None, None)], SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns and sorted((str(r.doc_id) for r in kept.collect())) == ["7", "7", "8", "None"]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), SF).count() == 0


def test_fingerprint_pairs_match_brute_force(spark):
    """All pairs within the radius, and only those; at values that many share, at least those with the smallest one."""
    from manyfold.llm.shingle_dedup import HOT, RADIUS, fingerprint_pairs

    rng = random.Random(3)

    def near(p):
        return sum((1 << b for b in rng.sample(range(64), rng.randint(1, 8))), 0) ^ p

    def found(prints):
        got = fingerprint_pairs(spark.createDataFrame([(p,) for p in prints], "simhash long")).collect()
        return {(min(r), max(r)) for r in map(tuple, got)}

    def within(a, b):
        return ((a ^ b) & (1 << 64) - 1).bit_count() <= RADIUS

    signed = lambda p: p - (1 << 64) if p >> 63 else p
    prints = {rng.getrandbits(64) for _ in range(60)}
    prints = sorted(signed(p) for p in prints | {near(p) for p in prints for _ in range(6)} | {0, (1 << 64) - 1, 31, 1 << 63})
    want = {(a, b) for i, b in enumerate(prints) for a in prints[:i] if within(a, b)}
    assert len(want) > 100 and found(prints) == want
    crowd = sorted({signed(0xABCDE << 44 | low) for low in range(2 * HOT)} | {signed(0xABCDE << 44 | 1 << b) for b in range(40)})
    got = found(crowd)
    assert all(within(*p) for p in got) and {p for p in got if p[0] == crowd[0]} == {(crowd[0], b) for b in crowd[1:] if within(crowd[0], b)}
    assert found([]) == set()


def test_near_copies_come_from_fingerprints(spark, monkeypatch):
    """Whatever fingerprints reach is verified first and linked; minima only add what they leave open."""
    from manyfold.llm import shingle_dedup
    from manyfold.llm.op4_simhash import fingerprint_of

    calls, verified = [], shingle_dedup._verified

    def spy(pairs, rows, classes):
        links = verified(pairs, rows, classes)
        of = {r.fp: r.rep for r in classes.collect()}
        calls.append(({frozenset((of[r.a], of[r.b])) for r in pairs.collect()}, {frozenset(r) for r in map(tuple, links.collect())}))
        return links

    monkeypatch.setattr(shingle_dedup, "_verified", spy)
    rng = random.Random(1)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(400)]
        rows.append((2 * i, " ".join(words), "", ""))
        for at in rng.sample(range(400), rng.choice([1, 3, 14])):
            words[at] = "new"
        rows.append((2 * i + 1, " ".join(words), "", ""))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()}
    assert kept == set(brute(rows))
    prints = [fingerprint_of(r[1].encode(), shingle_dedup.GRAM) for r in rows]
    reached = {frozenset((2 * i, 2 * i + 1)) for i in range(40) if (prints[2 * i] ^ prints[2 * i + 1]).bit_count() <= shingle_dedup.RADIUS}
    linked = {frozenset((2 * i, 2 * i + 1)) for i in range(40)} - {frozenset((i, i ^ 1)) for i in kept if i % 2}
    assert calls[0][0] >= reached and calls[0][1] == reached & linked and 10 < len(calls[0][1]) < len(linked)
    assert calls[1][1] == linked - reached and not calls[1][0] & calls[0][1]
