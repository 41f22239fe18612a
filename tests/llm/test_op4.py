import random

import xxhash

from manyfold.llm.op4_simhash import keep_one, near_duplicates

SCHEMA = "doc_id long, text string, id string, fp string"


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    prints = [(i, brute_print(t)) for i, t, *_ in rows]
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(prints):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, f"{f:016x}", least.get(find(a))) for a, (i, f) in enumerate(prints)), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["É", "naïve", "ZZ", "a-b"]
    rows = [(100 + i, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 4, 5, 30, 200]))), "x", "y") for i in range(120)]
    for i in range(60):
        words = rows[rng.randrange(120)][1].split(" ")
        words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((300 + i, rng.choice([" ", "\t", "\n", "  "]).join(words), "x", "y"))
    rows += [(1, None, None, None), (2, "", "", ""), (3, " \n", None, None), (4, rows[0][1].upper(), "", ""), (4, rows[0][1], "", ""), (5, "long words " * 40000, "", ""), (None, "lonely text of three or more", "", "")]
    got = [tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()]
    assert sorted(got, key=str) == brute(rows)


def linked(spark, prints):
    """Components of fingerprints by ``links``, smallest signed value first, and the same by comparing all pairs."""
    from manyfold.llm.op4_simhash import links
    from manyfold.operators.graph import connected_components

    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    classes = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r.node: r.component for r in connected_components(links(classes)).collect()}
    parent = {p: p for p in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    single = set(signed)
    for i, p in enumerate(signed):
        for q in signed[:i]:
            if ((p ^ q) & (1 << 64) - 1).bit_count() <= 2:
                single -= {p, q}
                x, y = find(p), find(q)
                parent[max(x, y)] = min(x, y)
    return found, {p: find(p) for p in signed if p not in single}


def test_chain_is_one_component(spark):
    """Fingerprints two bits apart in a row: the ends are far, the component is one; the hub's group is large."""
    prints = [0]
    for i in range(0, 40, 2):
        prints.append(prints[-1] | 3 << i)
    prints += [1 << 62 | 1 << i for i in range(0, 50)] + [(1 << 64) - 1]
    found, want = linked(spark, prints)
    assert found == want


def test_large_groups_share_a_segment(spark):
    """Hundreds of fingerprints around a few centres: values of both tables are hot, and so are their neighbours."""
    from manyfold.llm.op4_simhash import HOT

    rng = random.Random(11)
    prints = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(250):
            turned = centre
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 9])):
                turned ^= 1 << b
            prints.add(turned)
        prints |= {centre ^ b for b in range(100)} | {centre ^ b << 40 for b in range(100)}
    values = [p >> 32 for p in prints]
    assert max(map(values.count, values)) > HOT
    found, want = linked(spark, prints)
    assert found == want


def test_nodes_are_fingerprints(spark):
    """Two far texts under one id, and a null id near others: components follow the texts."""
    near = "one two three four five six seven eight nine ten"
    far = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(4, far), (4, near), (2, near + " "), (9, far), (None, near.upper()), (5, "lone words stand here"), (None, "LONE words stand here")]
    got = [tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute(rows)
    parts = {(i, f): c for i, f, c in got}
    assert parts[9, f"{brute_print(far):016x}"] == parts[4, f"{brute_print(far):016x}"] == 4
    assert parts[4, f"{brute_print(near):016x}"] == parts[None, f"{brute_print(near):016x}"] == 2


def test_repeated_ids_stay_by_their_text(spark):
    rows = [(4, "x y z w"), (4, "some other words here"), (9, "x y z w"), (2, "some other words here")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, fp int")
    assert sorted((r.doc_id, r.text, r.fp) for r in keep_one(docs).collect()) == [(2, "some other words here", 7), (4, "x y z w", 7)]


def test_keep_one_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x", "p"), (2, "A b c d", "x", "p"), (3, "other words here now", "x", "p"), (4, None, None, None)], SCHEMA)
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [1, 3, 4]
    assert keep_one(docs).columns == docs.columns
    assert near_duplicates(docs.limit(0)).count() == 0
