"""Benchmark decontamination: an FM-index over each training shard, searched backwards for the test phrases.

A shard is a run of whole documents of one task, closed when its indexed words reach ``SHARD_WORDS``.  Words that occur
in no phrase can't be part of an occurrence, so the index holds the stretches between them that are long enough for the
shortest phrase; that leaves out no occurrence.  All phrases are searched at once by wavelet ranks, occurrences are
located by sampled positions and merged to removal spans.  There is no shuffle: documents stream past the phrases.

The test phrases are a stated query set.  They are read to the driver in blocks of at most ``BLOCK_BYTES`` of text, and each is
packed for a broadcast before the next is read.  A batch of documents passes the blocks one after another, so a worker
holds one unpacked block; the packed ones, a few bytes a word, are what grows with the benchmark.

Defined cases: a null text has no words and is clean; a null or wordless item matches nothing; repeated items count
once by their id, items without an id count together as one with id ``null``; an empty benchmark leaves every document
clean; an empty table gives an empty result; rows that repeat are judged one by one; other columns are ignored by
``scan`` and kept by ``remove``.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyfold.llm.fm_index import SEPARATOR, FMIndex

WINDOW = 10
SHARD_WORDS = 1 << 18
BLOCK_BYTES = 16 << 20
#: ASCII letters to lower case; what isn't a letter, a digit or beyond ASCII, to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOUND = "struct<n_words:long,n_hit:long,items:array<string>,starts:array<long>,ends:array<long>>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


#: The block that a worker has unpacked, by its name.
_unpacked: dict[str, Phrases] = {}


class Phrases:
    """The windows of a block of items: word numbers from 2, one row for each distinct window, and its items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[int]] = {}
        ids: dict[str, int] = {}
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text)]
            if words:
                k = ids.setdefault(item, len(ids))
                for i in range(max(1, len(words) - window + 1)):
                    rows.setdefault(tuple(words[i:i + window]), set()).add(k)
        self.ids = list(ids)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.shortest = int(self.lengths.min(initial=window))
        self.table = np.zeros((len(rows), window), np.int32)
        for i, r in enumerate(rows):
            self.table[i, :len(r)] = r
        self.owner_at = np.concatenate(([0], np.cumsum([len(v) for v in rows.values()]))).astype(np.int64)
        self.owners = np.array([k for v in rows.values() for k in sorted(v)], np.int64)


def _stretches(numbers: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs without a zero that have at least ``least`` words."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (numbers != 0).astype(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + count), one after another."""
    total = int(counts.sum())
    return np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(total) if total else np.zeros(0, np.int64)


def _search_shard(phrases: Phrases, shard: list[tuple[int, int, np.ndarray]]) -> dict[int, tuple[list[tuple[int, int]], list[str]]]:
    """Hits of each document of a shard: merged word spans and item ids.  shard: (document, first word, word numbers)."""
    parts, origin, owner, at = [], [], [], 0
    for doc, first, numbers in shard:
        parts += [numbers, [SEPARATOR]]
        origin.append((at, first))
        owner.append(doc)
        at += len(numbers) + 1
    index = FMIndex(np.concatenate(parts))
    low, high = index.search(phrases.table, phrases.lengths)
    counts = high - low
    hit = np.flatnonzero(counts)
    if not len(hit):
        return {}
    which = np.repeat(hit, counts[hit])
    place = index.locate(_ranges(low[hit], counts[hit]))
    bounds = np.array([o[0] for o in origin])
    segment = np.searchsorted(bounds, place, "right") - 1
    docs = np.array(owner)[segment]
    start = place - bounds[segment] + np.array([o[1] for o in origin])[segment]
    out: dict[int, tuple[list[tuple[int, int]], list[str]]] = {}
    pairs = np.unique(docs * len(phrases.table) + which)
    doc_of, window = pairs // len(phrases.table), pairs % len(phrases.table)
    owners = phrases.owner_at[window + 1] - phrases.owner_at[window]
    items = np.unique(np.repeat(doc_of, owners) * len(phrases.ids) + phrases.owners[_ranges(phrases.owner_at[window], owners)])
    for doc, item in zip((items // len(phrases.ids)).tolist(), (items % len(phrases.ids)).tolist(), strict=True):
        out.setdefault(doc, ([], []))[1].append(phrases.ids[item])
    by = np.lexsort((start, docs))
    for doc, a, b in zip(docs[by].tolist(), start[by].tolist(), (start + phrases.lengths[which])[by].tolist(), strict=True):
        spans = out[doc][0]
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return out


def search(phrases: Phrases, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: its number of words, merged word spans of the occurrences, and ids of the items found."""
    n_words, found, shard, size = [], {}, [], 0
    number = phrases.vocabulary.get
    for doc, text in enumerate(texts):
        words = words_of(text)
        n_words.append(len(words))
        if len(words) < phrases.shortest or not len(phrases.table):
            continue
        numbers = np.fromiter((number(w, 0) for w in words), np.int32, len(words))
        for a, b in _stretches(numbers, phrases.shortest):
            shard.append((doc, a, numbers[a:b]))
            size += b - a + 1
        if size >= SHARD_WORDS:
            found |= _search_shard(phrases, shard)
            shard, size = [], 0
    if shard:
        found |= _search_shard(phrases, shard)
    return [(n, *found.get(doc, ([], []))) for doc, n in enumerate(n_words)]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Phrases]:
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.encode(F.col(text_col), "utf-8")).toLocalIterator():
        if row[1]:
            block.append((row[0] if row[0] is not None else "null", bytes(row[1])))
            size += len(row[1])
        if size >= BLOCK_BYTES:
            yield Phrases(block)
            block, size = [], 0
    if block:
        yield Phrases(block)


def _shared(benchmark: DataFrame, id_col: str, text_col: str) -> list:
    """A broadcast for each block of phrases, packed; the driver holds one block at a time."""
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast((uuid.uuid4().hex, zlib.compress(pickle.dumps(phrases), 1))) for phrases in _blocks(benchmark, id_col, text_col)]


def _phrases(shared) -> Phrases:
    """A broadcast block, unpacked; a worker keeps the one it used last, so a single block is unpacked once a worker."""
    name, packed = shared.value
    if name not in _unpacked:
        _unpacked.clear()
        _unpacked[name] = pickle.loads(zlib.decompress(packed))
    return _unpacked[name]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _found_column(benchmark: DataFrame, text: Column, id_col: str, text_col: str) -> Column:
    """A struct column with what all blocks of the benchmark find in ``text``; a batch of texts passes the blocks one after another."""
    shared = _shared(benchmark, id_col, text_col)
    if not shared:
        words = F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
        return F.struct(F.coalesce(words, F.lit(0)).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), *[F.array().cast(t).alias(n) for n, t in (("items", "array<string>"), ("starts", "array<long>"), ("ends", "array<long>"))])

    @F.arrow_udf(FOUND)
    def scan_blocks(texts: pa.Array) -> pa.Array:
        given = texts.cast(pa.binary()).to_pylist()
        rows: list[tuple[int, list, set]] = [(0, [], set()) for _ in given]
        for block in shared:
            for i, (n, spans, items) in enumerate(search(_phrases(block), given)):
                rows[i] = (n, rows[i][1] + spans, rows[i][2] | set(items))
        merged = [_merged(spans) for _, spans, _ in rows]
        return pa.StructArray.from_arrays(
            [
                pa.array([n for n, _, _ in rows], pa.int64()),
                pa.array([sum(b - a for a, b in spans) for spans in merged], pa.int64()),
                pa.array([sorted(items) for _, _, items in rows], pa.list_(pa.string())),
                pa.array([[a for a, _ in spans] for spans in merged], pa.list_(pa.int64())),
                pa.array([[b for _, b in spans] for spans in merged], pa.list_(pa.int64())),
            ],
            names=["n_words", "n_hit", "items", "starts", "ends"],
        )

    return scan_blocks(text)


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: ``(<id_col>, found)``; found has n_words, n_hit, items and the merged word spans."""
    return docs.select(F.col(id_col), _found_column(benchmark, F.col(text_col), item_id, item_text).alias("found"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``, what is left joined by blanks."""
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for a, b in sorted(spans):
        kept.append(text[at:max(at, places[a][0])])
        at = max(at, places[b - 1][1])
    return " ".join(x for x in (*(k.strip(" ") for k in kept), text[at:].strip(" ")) if x)


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with benchmark passages cut out of the text; a document that has no word left after a cut goes.

    A cut can bring a phrase together, so texts that were cut are searched again until none is found.  Columns stay;
    ``n_chars``, where there is one, follows the new text.
    """
    shared = _shared(benchmark, item_id, item_text)

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        raw: list[bytes] = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        todo, changed = list(range(len(raw))), set()
        while todo:
            spans: list[list[tuple[int, int]]] = [[] for _ in todo]
            for block in shared:
                for i, (_, found, _) in enumerate(search(_phrases(block), [raw[k] for k in todo])):
                    spans[i] += found
            again = [k for k, own in zip(todo, spans, strict=True) if own]
            for k, own in zip(todo, spans, strict=True):
                if own:
                    raw[k] = cut(raw[k].decode(), own).encode()
            changed.update(again)
            todo = again
        return pa.array([None if i in changed and not WORD.search(r.decode()) else r.decode() for i, r in enumerate(raw)], pa.string())

    if not shared:
        return docs
    # nondeterministic: else the filter would be pushed below and run the search a second time.  The row travels as one
    # struct, so that no column of its can clash
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), cleaned.asNondeterministic()(docs[text_col]).alias("cleaned")).where("cleaned is not null")
    text = F.col("row")[text_col]
    changed = F.coalesce(F.col("cleaned") != text, F.lit(False))
    new = {text_col: F.when(changed, F.col("cleaned")).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("cleaned").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result columns of the query from ``scan``'s rows."""
    joined = F.array_join(F.array_sort("found.items"), ",")
    return found.select(
        F.col(id_col), "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated")
    )


#: DuckDB SQL for the query's rows: all windows of the documents joined with those of the items.
SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select item_id, least(len(w), 10) as size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as gram from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from iw where len(w) > 0)),
grams as (select distinct size, gram from win),
dg as (select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as gram from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from dw, (select distinct size from grams) where len(w) >= size)),
found as (select doc_id, i, size, gram from dg semi join grams using (size, gram)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from found) group by 1),
items as (select doc_id, list(distinct item_id::varchar) as ids from found join win using (size, gram) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(ids), 0)::bigint as n_items, sha256(coalesce(array_to_string(list_sort(ids), ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hit using (doc_id) left join items using (doc_id)
"""
