import random

import pytest

from manyfold.llm import op5_tokens as op

SCHEMA = "doc_id long, text string, c string, n_tokens string"


@pytest.fixture(scope="module")
def scores():
    return op.read_vocabulary()


def brute(scores, word):
    """Best spelling by plain dynamic programming, no trie."""
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        width = len(word[end - 1].encode())
        top = (best[end - 1][0] + op.BYTE_SCORE * width, best[end - 1][1] + width)
        for start in range(end):
            if word[start:end] in scores and best[start][0] + scores[word[start:end]] > top[0]:
                top = (best[start][0] + scores[word[start:end]], best[start][1] + 1)
        best[end] = top
    return best[-1][1]


def texts():
    rng = random.Random(3)
    words = ["the", "token", "tokens", "tokenisation", "über", "naïve", "数字", "12345", "...", "é", "🙂", "a" * 300, "x&y", "don't"]
    return ["".join(rng.choice(words) + rng.choice([" ", "\n", "", "  \t"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]


def test_matches_brute_force(spark, scores):
    docs = [(i, t, "x", "y") for i, t in enumerate(texts())] + [(100, None, "", ""), (101, "", "", ""), (102, " \n ", "", ""), (None, "a b", "", ""), (0, "same id", None, None), (103, "long words " * 50_000, "", "")]
    got = sorted(map(str, op.count_tokens(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()))
    want = []
    for i, text, *_ in docs:
        words = op.pre_tokens(text or "")
        want.append(str(type(spark.createDataFrame([(1, 2, 3)], "doc_id long, n_pretokens long, n_tokens long").first())(doc_id=i, n_pretokens=words.total(), n_tokens=sum(n * brute(scores, w) for w, n in words.items()))))
    assert got == sorted(want)


def test_pre_tokens_cover_the_text():
    for text in texts():
        held = op.pre_tokens(text)
        assert sum(n * len(w.removeprefix(op.SPACE)) for w, n in held.items()) == len("".join(text.split()))


def test_agrees_with_a_public_library(scores):
    from tokenizers import Tokenizer, models

    other = Tokenizer(models.Unigram([("<unk>", -1000.0), *scores.items()], 0, False))
    trie = op.Trie(scores)
    words = {op.SPACE + w for t in texts() for w in t.split()} | {"unbelievable", "counting", "internationalisation"}
    compared = 0
    for word in words:
        pieces = other.encode(word).tokens
        if all(p in scores for p in pieces):
            compared += 1
            assert trie.count(word) == len(pieces)
    assert compared > 20


def test_prefixes_are_shared_and_memory_is_bounded(scores):
    trie = op.Trie(scores, most=50)
    assert trie.count("token") == trie.count("token")
    before = len(trie.best)
    trie.count("tokens")
    assert len(trie.best) == before + 1
    for i in range(200):
        assert trie.count(f"word{i}") == brute(scores, f"word{i}")
        assert len(trie.best) < 70


def test_empty(spark):
    assert op.count_tokens(spark.createDataFrame([], SCHEMA)).count() == 0
