"""Near copies by word shingles: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

This is the pipeline's own stage; the registered SimHash query has settings of its own.  The steps:

1. Texts with equal shingle sets form a class; from here on there is one row a class.
2. Candidates by SimHash: fingerprints of GRAM-word shingles that differ in at most RADIUS bits, by multi-index hashing as in the
   registered query, with a table for each of SEGMENTS and Hamming balls of radius 1.  Pairs are verified by the exact
   similarity of both texts, and links become components.
3. Fingerprints of 64 bits don't reach all pairs: at 0.8 those of two classes differ in 10 bits, and in 19 at times.  So that no link
   is lost, a class is also put into BANDS buckets, each addressed by ROWS minima of seeded hashes over its shingles.  Two
   classes of similarity s share none with chance (1 - s ** ROWS) ** BANDS: 5e-6 at 0.8, 6e-14 at 0.9.  Every member of a bucket
   that step 2 left outside the component of its smallest one is held against that one, in the same way.
4. A bucket whose members are then in several components holds pairs that weren't compared: each member outside the
   component of the smallest one is held against members of other components.  A large group of near copies is one component
   by then, so its pairs are never made.  Copies that were changed too much to be near copies still share buckets by the
   thousand; their pairs are told apart by counts.  Of the classes in such buckets the shingles that one class alone has are
   left out, and the others counted by PARTS ranges of their hash: the sum of the lesser counts bounds what two classes have in
   common, and a pair that can't reach the least similarity is never made.

Words are those of the fingerprint: ASCII lower case, split at ASCII white space; a text of fewer words is one shingle.

Defined cases: a null text counts as empty, and texts without words are copies of each other; repeated ids are kept as rows
of their own, and all stay if that id names the component; a row with a null id stays; an empty table gives an empty result;
other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyfold.llm.op4_simhash import HOT, LOWER, _turned, fingerprint_of
from manyfold.operators.graph import connected_components
from manyfold.operators.storage import materialise

SHINGLE = 5
#: The least Jaccard similarity of near copies, as a fraction.
PART, WHOLE = 4, 5
BANDS, ROWS = 40, 6
#: Words a shingle of the SimHash fingerprint: the fewer, the closer are the fingerprints of near copies.
GRAM = 2
#: Differing bits within which fingerprints are candidates, and the segments (first bit, width) of their tables: of that many bits one segment has at most one.
RADIUS, SEGMENTS = 5, ((0, 22), (22, 21), (43, 21))
#: Shingles whose hashes are mixed at once: bounds memory for very long texts.
CHUNK = 1 << 12
#: Ranges of hashes by which the shingles of candidate classes are counted.
PARTS = 64
#: Classes, two numbers each, that are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_CLASSES = 200_000
_MIX = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(text: bytes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles of one UTF-8 text."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts.tolist(), ends[len(words) - n:].tolist(), strict=True)), np.uint64, n))


def buckets_of(shingles: np.ndarray) -> np.ndarray:
    """The signed 64-bit addresses of a shingle set's buckets."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        np.minimum(least, (shingles[at:at + CHUNK, None] * _MIX).min(axis=0), out=least)
    found = [xxhash.xxh3_64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(found, np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted shingle sets reach the least similarity."""
    if PART * max(len(a), len(b)) > WHOLE * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * both >= PART * (len(a) + len(b) - both)


def _each(texts: pa.Array) -> Iterator[bytes]:
    """The texts one by one, null as empty; a batch is never held a second time as Python objects."""
    for text in texts.cast(pa.binary()):
        yield text.as_py() or b""


def _signature(text):
    """A struct column: fingerprint, size and buckets of the shingle set of the string column ``text``, and the text's SimHash."""

    @F.arrow_udf("struct<fp:long,n:long,simhash:long,buckets:array<long>>")
    def signature(texts: pa.Array) -> pa.Array:
        prints, sizes, simhashes, buckets = [], [], [], []
        for text in _each(texts):
            own = shingles_of(text)
            prints.append(xxhash.xxh3_64_intdigest(own.tobytes()))
            simhashes.append(fingerprint_of(text, GRAM))
            sizes.append(len(own))
            buckets.append(buckets_of(own))
        signed = [pa.array(np.array(found, np.uint64).view(np.int64)) for found in (prints, simhashes)]
        return pa.StructArray.from_arrays([signed[0], pa.array(sizes, pa.int64()), signed[1], pa.array(buckets, pa.list_(pa.int64()))], names=["fp", "n", "simhash", "buckets"])

    return signature.asNondeterministic()(text)


def _similar(left, right):
    """A boolean column: whether two string columns are near copies."""

    @F.arrow_udf("boolean")
    def near(left: pa.Array, right: pa.Array) -> pa.Array:
        found, last, known = [], b"", shingles_of(b"")
        for a, b in zip(_each(left), _each(right), strict=True):
            if b != last:
                last, known = b, shingles_of(b)
            found.append(similar(shingles_of(a), known))
        return pa.array(found, pa.bool_())

    return near(left, right)


def _texts(used: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``(fp, rep, text)`` of the classes that ``used`` names; any text of a class has its shingles, a row of the representative is taken."""
    named = materialise(classes.select("fp", "rep").join(used, "fp", "left_semi"))
    # where they are few, texts are picked as they are read and only theirs are shuffled
    few = named.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    picked = rows.select("fp", "id", "text").join(F.broadcast(named) if few else named, "fp").where("id = rep")
    return picked.groupBy("fp", "rep").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``: fingerprints of classes) that are near copies, as links ``(src, dst)`` of ids."""
    used = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    texts = materialise(_texts(used, rows, classes))
    right = texts.select(F.col("fp").alias("b"), F.col("rep").alias("dst"), F.col("text").alias("tb"))
    left = texts.select(F.col("fp").alias("a"), F.col("rep").alias("src"), F.col("text").alias("ta"))
    return materialise(pairs.join(left, "a").join(right, "b").where(_similar("ta", "tb")).select("src", "dst"))


def _shared_counts(used: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``(fp, common, most)``: a class's shingles that another of the classes ``used`` has too, counted by part, and their number."""

    @F.arrow_udf("array<long>")
    def listed(texts: pa.Array) -> pa.Array:
        return pa.array([shingles_of(t).view(np.int64) for t in _each(texts)], pa.list_(pa.int64()))

    @F.arrow_udf("array<int>")
    def counted(texts: pa.Array, own: pa.Array) -> pa.Array:
        out = []
        for text, alone in zip(_each(texts), own, strict=True):
            held = np.array(alone.as_py() or [], np.int64).view(np.uint64)
            rest = np.setdiff1d(shingles_of(text), held, assume_unique=True)
            out.append(np.bincount((rest % np.uint64(PARTS)).astype(np.int64), minlength=PARTS).astype(np.int32))
        return pa.array(out, pa.list_(pa.int32()))

    texts = materialise(_texts(used, rows, classes))
    single = texts.select("fp", F.explode(listed("text")).alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("fp").alias("fp")).where("c = 1")
    own = single.groupBy("fp").agg(F.collect_list("shingle").alias("own"))
    # nondeterministic: else the filter on its sum would be pushed below and count everything a second time
    told = texts.join(own, "fp", "left").select("fp", counted.asNondeterministic()("text", "own").alias("common"))
    return told.withColumn("most", F.aggregate("common", F.lit(0), lambda a, x: a + x))


def _fits(n: str, m: str, common: str | None = None):
    """Sets of such sizes, with at most ``common`` elements of the smaller in common, can reach the least similarity."""
    most = common or f"least({n}, {m})"
    return F.expr(f"{PART} * ({n} + {m} - {most}) <= {WHOLE} * {most}")


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Pairs ``(src, dst)`` of different fingerprints within ``RADIUS`` bits, by a table for each segment and balls of radius 1.

    prints: one row ``(simhash)`` for each distinct fingerprint.  At a value that more than ``HOT`` of them share, each is paired
    with the smallest one only.
    """
    tables = [F.shiftrightunsigned("simhash", at).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(i << SEGMENTS[0][1])) for i, (at, width) in enumerate(SEGMENTS)]
    entries = prints.select("simhash", F.explode(F.array(*tables)).alias("place"))
    bits = F.array(*map(F.lit, range(SEGMENTS[0][1])))
    # of two values one bit apart the one with a zero there asks for the other
    zero = F.filter(bits, lambda i: F.call_function("getbit", F.col("place"), i) == 0)
    asked = entries.select("place", F.col("simhash").alias("src")).unionByName(entries.select(F.explode(_turned(F.col("place"), zero)).alias("place"), F.col("simhash").alias("src")))
    hubs = materialise(entries.groupBy("place").agg(F.count(F.lit(1)).alias("k"), F.min("simhash").alias("dst")).where(F.col("k") > HOT).select("place", "dst"))
    cold = entries.join(hubs, "place", "left_anti").select("place", F.col("simhash").alias("dst"))
    met = asked.join(cold, "place").unionByName(asked.join(hubs, "place")).where("src != dst")
    return met.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= RADIUS).select("src", "dst")


def _fingerprint_candidates(classes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of classes whose SimHashes are near; of the classes of one SimHash the smallest stands for all and meets the others."""
    known = classes.where("rep is not null").select("fp", "n", "simhash")
    hubs = materialise(known.groupBy("simhash").agg(F.min(F.struct("fp", "n")).alias("hub")).select("simhash", "hub.fp", "hub.n"))
    theirs = hubs.select(F.col("simhash").alias("dst"), F.col("fp").alias("hub_fp"), F.col("n").alias("hub_n"))
    near = fingerprint_pairs(hubs.select("simhash")).join(hubs.withColumnRenamed("simhash", "src"), "src").join(theirs, "dst")
    same = known.join(theirs, known["simhash"] == theirs["dst"]).where("fp != hub_fp")
    met = near.select("fp", "n", "hub_fp", "hub_n").unionByName(same.select("fp", "n", "hub_fp", "hub_n"))
    return met.where(_fits("n", "hub_n")).select(F.least("fp", "hub_fp").alias("a"), F.greatest("fp", "hub_fp").alias("b")).distinct()


def _parts(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``(fp, part)``: the component of each class by ``links`` of ids."""
    parts = connected_components(links)
    return materialise(classes.join(parts, classes["rep"] == parts["node"], "left").select("fp", F.coalesce("component", "rep").alias("part")))


def _placed(shared: DataFrame, of: DataFrame) -> DataFrame:
    """``shared`` with the component of each class, and whether its bucket's smallest one is in another (``out``)."""
    placed = shared.join(of, "fp").join(of.select(F.col("fp").alias("hub_fp"), F.col("part").alias("hub_part")), "hub_fp")
    return placed.withColumn("out", F.col("part") != F.col("hub_part")).drop("hub_part")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``(id, component_id)`` for each row of ``docs``; component_id is the smallest id of the near copies."""
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = materialise(held.withColumn("s", _signature("text")).select("id", "text", "s.fp", "s.n", "s.simhash", "s.buckets"))
    rows = signed.select("id", "fp", "text")
    classes = materialise(signed.groupBy("fp", "n").agg(F.min("id").alias("rep"), F.min("simhash").alias("simhash"), F.first("buckets").alias("buckets")))
    links = _verified(materialise(_fingerprint_candidates(classes)), rows, classes)
    of = _parts(classes, links)
    # what most of the shuffle holds: three numbers an entry, aggregated as numbers
    entries = classes.where("rep is not null").select("fp", "rep", F.explode("buckets").alias("bucket"))
    tops = entries.groupBy("bucket").agg(F.min("rep").alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket", "top")
    met = materialise(entries.join(tops, "bucket"))
    hubs = met.where("rep = top").groupBy("bucket").agg(F.min("fp").alias("hub_fp"))
    sized = classes.select("fp", "n")
    shared = met.join(hubs, "bucket").join(sized, "fp").join(sized.select(F.col("fp").alias("hub_fp"), F.col("n").alias("hub_n")), "hub_fp")
    shared = materialise(shared.select("bucket", "fp", "n", "hub_fp", "hub_n"))
    first = materialise(_placed(shared, of).where("out").where(_fits("n", "hub_n")).select(F.least("fp", "hub_fp").alias("a"), F.greatest("fp", "hub_fp").alias("b")).distinct())
    links = links.unionByName(_verified(first, rows, classes))

    of = _parts(classes, links)
    placed = materialise(_placed(shared, of).select("bucket", "fp", "n", "part", "out", "hub_fp"))
    left = placed.join(placed.where("out").select("bucket").distinct(), "bucket", "left_semi")
    if not left.isEmpty():
        counts = _shared_counts(left.select("fp").distinct(), rows, classes)
        counted = materialise(left.join(counts, "fp").where(f"{WHOLE} * most >= {PART} * n"))
        outside = counted.where("out").select("bucket", F.col("fp").alias("a"), F.col("n").alias("m"), F.col("part").alias("p"), F.col("most").alias("least"), F.col("common").alias("theirs"))
        both = "aggregate(zip_with(common, theirs, (x, y) -> least(x, y)), 0, (s, x) -> s + x)"
        met = outside.join(counted.where("fp != hub_fp"), "bucket").where("part != p and (not out or a < fp)").where(_fits("n", "m", "least(most, least)")).where(_fits("n", "m", both))
        second = materialise(met.select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct())
        links = links.unionByName(_verified(second, rows, classes))
        of = _parts(classes, links)
    return rows.select("id", "fp").join(of, "fp").select("id", F.col("part").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies: of each component the document with the smallest id stays, columns unchanged."""
    gone = near_copies(docs, id_col, text_col).where("id != component_id").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
