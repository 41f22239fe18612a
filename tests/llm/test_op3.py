import hashlib
import random
import re

import numpy as np
import pytest

from manyfold.llm import op3_decontaminate as op
from manyfold.llm.fm_index import FMIndex

SCHEMA = "doc_id long, text string, found string, item_id long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = brute_words(text)
        if w:
            for i in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[i:i + 10]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text, *_ in docs:
        w = brute_words(text)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i:i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("sample", [1, 3, 8])
def test_index_finds_all(sample):
    rng = np.random.default_rng(sample)
    for _ in range(25):
        parts = [rng.integers(2, rng.integers(3, 12), rng.integers(1, 60)) for _ in range(rng.integers(1, 8))]
        seq = np.concatenate([x for p in parts for x in (p, [1])])
        index = FMIndex(seq, sample)
        phrases = np.zeros((20, 5), int)
        lengths = rng.integers(1, 6, 20)
        for i, n in enumerate(lengths):
            phrases[i, :n] = rng.integers(2, 12, n)
        low, high = index.search(np.minimum(phrases, seq.max()), lengths)
        for i, n in enumerate(lengths):
            want = [p for p in range(len(seq) - n + 1) if (seq[p:p + n] == np.minimum(phrases[i, :n], seq.max())).all()]
            assert sorted(index.locate(np.arange(low[i], high[i]))) == want


def fixture():
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(30)] + ["É", "日本"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 10, 11, 30])))) for i in range(25)]
    items += [(7, items[3][1]), (90, "v1"), (91, None), (92, " ,. "), (None, "V2, v3! v4"), (93, items[0][1].upper())]
    docs = []
    for i in range(80):
        words = rng.choices(vocab + ["zz", "other"], k=rng.choice([0, 1, 9, 50, 300]))
        for _ in range(rng.choice([0, 1, 3])):
            at = rng.randrange(len(words) + 1)
            words[at:at] = items[rng.randrange(25)][1].split()
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words), "x", 1))
    docs += [(5, None, None, None), (6, "", "", 0), (None, items[4][1], "", 0), (9, items[4][1] + " ... " + items[4][1], "", 0), (10, ("w " * 50 + items[2][1] + " ") * 300, "", 0)]
    return docs, items


def test_matches_brute_force(spark, monkeypatch):
    docs, items = fixture()
    frame, bench = spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert sorted((tuple(r) for r in op.digest(op.scan(frame, bench)).collect()), key=str) == want
    monkeypatch.setattr(op, "BLOCK_BYTES", 200)  # several blocks of phrases, merged
    assert sorted((tuple(r) for r in op.digest(op.scan(frame, bench)).collect()), key=str) == want
    assert op.scan(frame.limit(0), bench).count() == 0
    clean = op.digest(op.scan(frame, bench.limit(0))).collect()
    assert sorted((r.doc_id, r.n_words) for r in clean if r.doc_id) == sorted((d[0], len(brute_words(d[1]))) for d in docs if d[0]) and not any(r.contaminated for r in clean)


def test_small_shards_give_the_same(monkeypatch):
    docs, items = fixture()
    phrases = op.Phrases([(str(i), (t or "").encode()) for i, t in items])
    texts = [None if d[1] is None else d[1].encode() for d in docs]
    want = [(n, s, sorted(i)) for n, s, i in op.search(phrases, texts)]
    monkeypatch.setattr(op, "SHARD_WORDS", 50)
    assert [(n, s, sorted(i)) for n, s, i in op.search(phrases, texts)] == want


def test_remove_leaves_no_phrase(spark):
    docs, items = fixture()
    items = [(i, t) for i, t in items if len(brute_words(t)) >= 10]
    frame, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    out = op.remove(frame, bench).collect()
    assert not any(r[2] for r in brute([tuple(r) for r in out], items))
    dirty = {(r[0], r[1]) for r in brute(docs, items) if r[5]}
    clean = [d for d, b in zip(docs, [brute([d], items)[0] for d in docs], strict=True) if not b[5]]
    kept = [tuple(r) for r in out]
    assert all(d in kept for d in clean) and len(dirty) > 10
