import hashlib
import math
import random
import re

from manyfold.llm import op1_pii as op

SCHEMA = "doc_id long, text string, spans string, m0 string, candidates string, n_chars long"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def fixture():
    rng = random.Random(6)
    bits = ["a.b@c.com", "x_y@z-1.co.uk_q@w.org", "@", "1.2.3.4", "300.2.3.4", "1.2.3.4.5.6.7.8", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "1" * 25, "12 34", "5-", "+1 (377) 555-0271",
            "+12", "+49.30.1234567", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "é", "日本", "wörd", "\n", "  ", "token = \"9b0b3c6a43eb78aa99cbd7049c572391524f37a8\"", "me (at) host (dot) org", "1-2 3", "0000000000000", "4 4 4 4 4 4 4 4 4 4 4 4 4", "a@b", "a@b.", "a@b..c", "++1 5", "\U0001F600"]
    docs = [(i, rng.choice(["", " "]).join(rng.choice(bits) for _ in range(rng.randint(0, 14))), "s", "m", "c", 1) for i in range(400)]
    docs += [(1000, None, None, None, None, None), (1001, "", "", "", "", 0), (1002, "a" * 60000 + "@", "", "", "", 0), (1003, "1" * 60000, "", "", "", 0), (1004, "1." * 30000, "", "", "", 0), (1005, "x@y" + ".z" * 30000, "", "", "", 0), (1006, "+1" + "(" * 30000, "", "", "", 0), (1007, "joe@mail.com " * 3000, "", "", "", 0), (None, "q@r.st", "", "", "", 0), (1001, "q@r.st", "", "", "", 0)]
    return docs


def test_base_spans_match_brute_force(spark):
    docs = fixture()
    got = op.digest(op.find(spark.createDataFrame(docs, SCHEMA).repartition(3))).collect()
    assert len(got) == len(docs)
    want = []
    for d in docs:
        base = brute(d[1])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((d[0], *(sum(k == kind for k, *_ in base) for kind in BASE), hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    by = {d[0]: d[1] for d in docs if d[0] is not None and d[0] < 1000}
    for r in got:
        if r.doc_id in by:
            spans = [s.split(":") for s in r.spans.split(",") if s]
            assert {tuple(s) for s in spans} >= {(k, str(a), str(b)) for k, a, b in brute(by[r.doc_id])}
            order = [(op.KINDS.index(k), int(a)) for k, a, _ in spans]
            assert order == sorted(order)
            assert all(by[r.doc_id][int(a):int(b)].startswith("9b0b") for k, a, b in spans if k == "secret")
    assert any("secret:" in r.spans for r in got)


def test_redact_leaves_no_base_span(spark):
    docs = fixture()
    out = op.redact(spark.createDataFrame(docs, SCHEMA)).collect()
    assert out[0].__fields__ == [f.split()[0] for f in SCHEMA.split(", ")]
    clean = {d[0]: d for d in docs if d[0] and d[0] < 1000 and not brute(d[1]) and "token" not in d[1] and "(at)" not in d[1]}
    for r in out:
        if r.doc_id in clean:
            assert tuple(r) == clean[r.doc_id]
    r = next(r for r in out if r.doc_id == 1007)
    assert r.text == "[EMAIL] " * 3000 and r.n_chars == len(r.text)


def test_fit_finds_the_bad_labeler():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.6
        votes = tuple((1 if truth else -1) * (1 if rng.random() < good else -1) for good in (0.95, 0.9, 0.9, 0.55, 0.85, 0.9))
        counts[votes] = counts.get(votes, 0) + 1
    model = op.fit([("card", v, n) for v, n in counts.items()])
    quality = [(r["true_when_personal"] + r["false_when_not"]) / 2 for r in model.reliability]
    assert min(range(6), key=quality.__getitem__) == 3 and abs(quality[0] - 0.95) < 0.03
    assert model.votes[3] == min(model.votes)
    assert op.fit([]).reliability == []


def test_empty(spark):
    assert op.digest(op.find(spark.createDataFrame([], SCHEMA))).count() == 0


def test_long_secret_is_one_span(spark):
    secret = "aB3dE5gH7k" * 100
    text = f"see token={secret} there"
    docs = spark.createDataFrame([(1, text, "", "", "", len(text))], SCHEMA)
    (got,) = op.voted(docs.select("text")).collect()
    assert [(c.kind, c.start, c.stop) for c in got.candidates if c.kind == "secret"] == [("secret", 10, 1010)]
    assert secret[-50:] not in op.redact(docs).collect()[0].text


def test_long_spelled_address(spark):
    text = "write to " + "a" * 100 + " (at) host" + " (dot) part" * 9 + " now"
    (got,) = op.voted(spark.createDataFrame([(text,)], "text string")).collect()
    assert [(c.kind, c.start, c.stop) for c in got.candidates if c.kind == "email"] == [("email", 9, len(text) - 4)]


def test_classifier_refuses_what_the_value_check_passes():
    """A kind of candidate whose other labelers vote against it gets a posterior below the threshold; well-backed ones are taken."""
    good, bad = (1, 1, 1, 1, 1, 0), (1, -1, 0, -1, 0, -1)
    model = op.fit([("secret", good, 500), ("secret", bad, 400), ("secret", (-1, -1, 0, -1, 0, -1), 300), ("email", (1, 1, 1, 1, 1, 0), 300), ("email", (1, -1, 0, -1, -1, 0), 100)])

    def chance(kind, votes):
        return 1 / (1 + math.exp(-(model.bias + model.kinds[kind] + sum(w * v for w, v in zip(model.votes, votes, strict=True)))))

    assert chance("secret", bad) < op.ACCEPT < chance("secret", good)
    assert chance("email", (1, -1, 0, -1, -1, 0)) < op.ACCEPT < chance("email", (1, 1, 1, 1, 1, 0))


def test_recall_by_kind(spark):
    """Planted data of every kind, base and wider, among words: all are found, and texts without stay without."""
    rng = random.Random(3)
    words = "the of and with time house water server number street place".split()
    planted = {
        "email": lambda: rng.choice([f"u{rng.randrange(999)}@mail{rng.randrange(9)}.com", f"mail me: jo{rng.randrange(99)} (at) host (dot) org"]),
        "ip": lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)), "card": lambda: "card 4111 1111 1111 1111", "phone": lambda: f"call +49 30 {rng.randrange(10**6, 10**7)}",
        "secret": lambda: f"token = \"{rng.getrandbits(160):040x}a1\"",
    }
    docs, want = [], {}
    for i in range(400):
        text = rng.choices(words, k=30)
        if i % 2:
            want[i] = rng.choice(list(planted))
            text.insert(rng.randrange(30), planted[want[i]]())
        docs.append((i, " ".join(text)))
    got = {r.doc_id: {s.kind for s in r.spans} for r in op.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for kind in planted:
        own = [i for i in want if want[i] == kind]
        assert sum(kind in got[i] for i in own) >= 0.95 * len(own), kind
    assert not any(got[i] for i in got if i not in want)
