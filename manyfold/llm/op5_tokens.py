"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

Texts are cut at white space into words, and words into pre-tokens: runs of letters, of digits and of other signs.  A word's
first pre-token carries the vocabulary's space mark.  The distinct pre-tokens of a batch go into a trie.  Each
node keeps the best score of any way to spell the characters from the root to it, and the number of pieces of that way;
both are computed when the node is made, from its ancestors, so a prefix that many words share costs once.  Terminal nodes
give a word's count, and a text's count is the sum over its pre-tokens.

Piece scores: the vocabulary file lists its pieces in order of rank; a piece of rank r scores -log(r + RANK_SHIFT), Zipf's
law with a fixed shift.  Nothing is trained.  A character that no piece covers is spelled by its UTF-8 bytes at BYTE_SCORE
each.  Of equal scores the way whose last piece is longest wins.

The driver reads the vocabulary once and broadcasts it; its size is checked against MAX_PIECES.  A trie is dropped when it
has MAX_NODES nodes, so memory stays bounded whatever the texts hold.  Texts stream past it: there is no shuffle.

Defined cases: null and empty texts have no tokens; white space alone has none; very long texts and very long pre-tokens are
counted whole; repeated rows are counted one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from operator import mul

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
RANK_SHIFT = 2.7
BYTE_SCORE = -30.0
MAX_PIECES = 1_000_000
MAX_NODES = 1_500_000
PRE_TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}]*+|\p{N}++|[^\p{L}\p{N}]++")
#: Tries that a worker keeps for its next task, by vocabulary.
_kept: dict[str, Trie] = {}


def cut(word: str) -> list[str]:
    """Pre-tokens of a word without white space, the first one with the mark."""
    parts = PRE_TOKEN.findall(word)
    parts[0] = SPACE + parts[0]
    return parts


def pre_tokens(text: str) -> Counter:
    """Distinct pre-tokens of a whole text with their number."""
    out: Counter = Counter()
    for word, n in Counter(text.split()).items():
        for part in cut(word):
            out[part] += n
    return out


def read_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Scores of the pieces in a vocabulary file, control and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    if size > MAX_PIECES:
        raise ValueError(f"{path} has {size} pieces, more than {MAX_PIECES}")
    usual = [model.id_to_piece(i) for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {piece: -math.log(rank + RANK_SHIFT) for rank, piece in enumerate(usual)}


class Trie:
    """Trie of pre-tokens whose nodes hold best scores and piece counts of the path from the root."""

    def __init__(self, scores: dict[str, float], most: int = MAX_NODES):
        self.scores, self.most = scores, most
        self.longest = max(map(len, scores), default=1)
        #: Ends of pieces: a text that isn't one ends the search for longer last pieces.
        self.ends = frozenset(piece[i:] for piece in scores for i in range(len(piece)))
        self.counts: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        #: Child of node n by character c, under n * 2 ** 21 + c.
        self.children: dict[int, int] = {}
        self.best, self.pieces = [0.0], [0]
        self.counts.clear()

    def count(self, word: str) -> int:
        """Number of pieces of the best way to spell ``word``; kept at its terminal."""
        known = self.counts.get(word)
        if known is None:
            if len(self.best) > self.most:
                self._clear()
            known = self.counts[word] = self._insert(word)
        return known

    def _insert(self, word: str) -> int:
        children, best, pieces, scores, ends, longest = self.children, self.best, self.pieces, self.scores, self.ends, self.longest
        node, path = 0, [0]  # the path's last `longest` nodes would do; words are short and long ones are cut below
        for i, char in enumerate(word, 1):
            step = node << 21 | ord(char)
            following = children.get(step)
            if following is None:
                width = len(char.encode("utf-8", "surrogatepass"))
                top, number = best[node] + BYTE_SCORE * width, pieces[node] + width
                for size in range(1, min(i, longest) + 1):
                    last = word[i - size:i]
                    if last not in ends:
                        break
                    score = scores.get(last)
                    if score is not None and best[path[-size]] + score >= top:  # of equal ones the longer last piece
                        top, number = best[path[-size]] + score, pieces[path[-size]] + 1
                following = children[step] = len(best)
                best.append(top)
                pieces.append(number)
            node = following
            path.append(node)
            if len(path) > 4 * longest:
                del path[:-longest]
        return pieces[node]


def count_batch(trie: Trie, texts: Iterable[str | None]) -> list[tuple[int, int]]:
    """``(pre-tokens, tokens)`` of each text; the batch's distinct pre-tokens enter the trie in order, prefixes together."""
    held = [Counter(t.split()) if t else Counter() for t in texts]
    parts, tokens = {}, {}
    for word in sorted(set().union(*held)):
        own = cut(word)
        parts[word] = len(own)
        tokens[word] = sum(map(trie.count, own))
    return [(sum(map(mul, w.values(), map(parts.__getitem__, w))), sum(map(mul, w.values(), map(tokens.__getitem__, w)))) for w in held]


def _trie(vocabulary: str, shared) -> Trie:
    """The worker's trie; it goes on from task to task, one vocabulary at a time."""
    if vocabulary not in _kept:
        _kept.clear()
        _kept[vocabulary] = Trie(shared.value)
    return _kept[vocabulary]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Return ``(<id_col>, n_pretokens, n_tokens)`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.arrow_udf("struct<n_pretokens:long,n_tokens:long>")
    def counted(texts: pa.Array) -> pa.Array:
        trie = _trie(vocabulary, shared)
        rows: list[tuple[int, int]] = []
        for at in range(0, len(texts), 256):  # bounds the distinct pre-tokens held at once
            rows += count_batch(trie, texts.slice(at, 256).to_pylist())
        return pa.StructArray.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["n_pretokens", "n_tokens"])

    found = docs.select(F.col(id_col), counted.asNondeterministic()(F.col(text_col)).alias("c"))
    return found.select(id_col, "c.n_pretokens", "c.n_tokens")
