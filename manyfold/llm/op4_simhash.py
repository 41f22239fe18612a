"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits, cut into two segments of 32.  Fingerprints that differ in at most two bits differ in at most one
bit of some segment.  So there is a table per segment, keyed by the segment's value, and every distinct fingerprint
enumerates the Hamming ball of radius 1 around each of its values, fetches the table's entries and keeps those whose complete
distance is at most two.  Of two values one bit apart only the one with a zero there asks for the other, which halves the
enumeration without losing a pair.

A value that more than ``HOT`` fingerprints share (a large group of near copies) is not compared within itself: its entries are
addressed a second time, by the ball of radius 1 around their *other* segment, and those that ask for the value come with
their other segment as it is.  All that meet at such a double address are links (two entries differ in at most two bits of the
other segment; an asker differs by one bit in each), it has at most 33 entries and 32 askers, and a star to its smallest
entry keeps what is connected.  Nothing is dropped, and no group is ever paired with itself.

Links are between fingerprints; ids come in at the end, as the smallest id of each component's rows.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and is linked like any other;
repeated ids are rows of their own, judged by their own text; rows with a null id keep their fingerprint and join their
component but never name it (a component of null ids only has a null id); an empty table gives an empty result; other
columns are ignored, whatever their names, by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manyfold.operators.graph import connected_components
from manyfold.operators.storage import materialise

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
RADIUS, BITS, WIDTH = 2, 64, 32
#: Fingerprints that may share a segment's value before they are addressed by both segments.
HOT = 32
#: Hashes whose bits are counted at once: bounds memory for very long texts.
CHUNK = 1 << 15


def fingerprint_of(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of one UTF-8 text over word shingles, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    ends = ends[len(words) - n:]
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        spans = zip(starts[at:at + CHUNK].tolist(), ends[at:at + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in range(BITS) if 2 * counts[i] > n))


def fingerprint_column(text, shingle: int = 3):
    """A long column: the fingerprint of the string column ``text`` as signed 64 bits."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint_of(t or b"", shingle) for t in texts.cast(pa.binary()).to_pylist()], dtype=np.uint64)
        return pa.array(found.view(np.int64))

    return simhash(text)


def _tables(fp: Column) -> Column:
    """A fingerprint's entries in the two tables: structs of the place (the table's number above the value) and the other value."""
    low, high = fp.bitwiseAND(F.lit((1 << WIDTH) - 1)), F.shiftrightunsigned(fp, WIDTH)
    return F.array(F.struct(low.alias("place"), high.alias("rest")), F.struct(high.bitwiseOR(F.lit(1 << WIDTH)).alias("place"), low.alias("rest")))


def _turned(value: Column, bits: Column) -> Column:
    """``value`` with each of ``bits`` turned, one at a time."""
    return F.transform(bits, lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))


def _bits() -> Column:
    return F.array(*map(F.lit, range(WIDTH)))


def links(classes: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` between distinct fingerprints within ``RADIUS`` bits; a hot value's links are stars that keep connectivity.

    classes: one row ``(fp)`` for each distinct fingerprint.
    """
    entries = classes.select("fp", F.inline(_tables(F.col("fp"))))
    zero = F.filter(_bits(), lambda i: F.call_function("getbit", F.col("place"), i) == 0)
    asking = entries.select("fp", "rest", F.explode(_turned(F.col("place"), zero)).alias("place"))
    hot = materialise(entries.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("place"))

    cold = entries.join(hot, "place", "left_anti").select("place", F.col("fp").alias("dst"))
    asked = entries.select("place", F.col("fp").alias("src")).unionByName(asking.select("place", F.col("fp").alias("src")))
    fetched = asked.join(cold, "place").where("src != dst")
    near = fetched.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= RADIUS).select("src", "dst")

    ball = F.concat(F.array("rest"), _turned(F.col("rest"), _bits()))
    crowd = entries.join(hot, "place", "left_semi").select("place", "fp", F.explode(ball).alias("rest"), F.lit(True).alias("held"))
    askers = asking.join(hot, "place", "left_semi").select("place", "fp", "rest", F.lit(False).alias("held"))
    # at most 65 rows meet at a place and rest
    hub = F.min(F.when(F.col("held"), F.col("fp"))).over(Window.partitionBy("place", "rest"))
    starred = crowd.unionByName(askers).select(F.col("fp").alias("src"), hub.alias("dst")).where("src != dst")
    return near.unionByName(starred.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= RADIUS))


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, keep: list[str]) -> DataFrame:
    """``(row, id, fp, component_id)``: row holds the columns ``keep`` as one struct, so that none of them can clash."""
    held = F.struct(*[docs[c] for c in keep]) if keep else F.lit(None).cast("boolean")
    rows = materialise(docs.select(held.alias("row"), docs[id_col].alias("id"), fingerprint_column(docs[text_col], shingle).alias("fp")))
    classes = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")))
    parts = connected_components(links(classes.select("fp")))
    rooted = classes.join(parts, classes["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("row", "id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Return ``(<id_col>, fingerprint, component_id)`` for each row of ``docs``.

    Texts are read once; fingerprints are kept in the shared folder, since three later steps use them.
    """
    found = _components(docs, id_col, text_col, shingle, [])
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` without near copies: of each component the rows with the smallest id stay, columns unchanged.

    Rows of a component that repeat the naming id all stay; a row with a null id stays.
    """
    found = _components(docs, id_col, text_col, shingle, docs.columns)
    return found.where("id is null or id = component_id").select("row.*")


#: The five primes of XXH64.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _sql(seed: int = 42) -> str:
    """DuckDB SQL for the query's rows: XXH64 step by step in 128-bit arithmetic, all pairs of fingerprints, labels handed on."""
    p1, p2, p3, p4, p5 = (f"{p}::uhugeint" for p in PRIMES)
    whole = f"{1 << 64}::uhugeint"

    def times(a: str, b: str) -> str:
        return f"(({a}) * {b} % {whole})"

    def turn(x: str, by: int) -> str:  # x is a name: it is used twice
        return f"({x} * {1 << by}::uhugeint % {whole} + {x} // {1 << 64 - by}::uhugeint)"

    def bind(value: str, name: str, body: str) -> str:
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    def lane(at: str, width: int) -> str:
        return f"('0x' || {' || '.join(f'substr(hx, 2 * ({at} + {i}) + 1, 2)' for i in reversed(range(width)))})::uhugeint"

    def xor(a: str, b: str) -> str:
        return f"xor(({a})::ubigint, ({b})::ubigint)::uhugeint"

    def round_(acc: str, given: str, name: str) -> str:
        return bind(f"(({acc}) + {times(given, p2)}) % {whole}", name, times(turn(name, 31), p1))

    def stripe(k: int, start: int) -> str:
        return f"list_reduce(range(n // 32), lambda acc, i: {round_('acc', lane(f'i * 32 + {8 * k}', 8), 'r')}, {start % (1 << 64)}::uhugeint) as v{k + 1}"

    starts = (seed + PRIMES[0] + PRIMES[1], seed + PRIMES[1], seed, seed - PRIMES[0])
    merged = f"({turn('v1', 1)} + {turn('v2', 7)} + {turn('v3', 12)} + {turn('v4', 18)}) % {whole}"
    for k in range(4):
        merged = f"({times(xor(merged, round_('0::uhugeint', f'v{k + 1}', f'm{k}')), p1)} + {p4}) % {whole}"
    eights = f"list_reduce(range((n % 32) // 8), lambda acc, i: {bind(xor('acc', round_('0::uhugeint', lane('n // 32 * 32 + i * 8', 8), 'r')), 'x', f'({times(turn(chr(120), 27), p1)} + {p4}) % {whole}')}, h)"
    four = f"case when n % 8 >= 4 then {bind(xor('h', times(lane('n // 8 * 8', 4), p1)), 'x', f'({times(turn(chr(120), 23), p2)} + {p3}) % {whole}')} else h end"
    ones = f"list_reduce(range(n // 4 * 4, n), lambda acc, i: {bind(xor('acc', times(lane('i', 1), p5)), 'x', times(turn(chr(120), 11), p1))}, h)"
    shift = lambda by: xor("h", f"h // {1 << by}::uhugeint")
    counts = ", ".join(f"sum(k * ((h >> {i}) & 1)) * 2 > sum(k) as b{i}" for i in range(BITS))
    fp = " + ".join(f"b{i}::uhugeint * {1 << i}::uhugeint" for i in range(BITS))
    return f"""with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
  g as (select doc_id, array_to_string(w[i:i + 2], ' ') as gram, count(*)::bigint as k from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0) group by all),
  t as (select distinct gram, hex(gram) as hx, strlen(gram) as n from g),
  s as (select *, {', '.join(stripe(k, start) for k, start in enumerate(starts))} from t),
  h0 as (select gram, hx, n, ((case when n >= 32 then {merged} else {(seed + PRIMES[4]) % (1 << 64)}::uhugeint end) + n::uhugeint) % {whole} as h from s),
  h1 as (select gram, hx, n, {eights} as h from h0), h2 as (select gram, hx, n, {four} as h from h1), h3 as (select gram, {ones} as h from h2),
  h4 as (select gram, {times(shift(33), p2)} as h from h3), h5 as (select gram, {times(shift(29), p3)} as h from h4), h6 as (select gram, ({shift(32)})::ubigint as h from h5),
  b as (select doc_id, {counts} from g join h6 using (gram) group by doc_id), f as (select doc_id, ({fp})::ubigint as fp from b),
  r as (select doc_id, coalesce(fp, 0::ubigint) as fp from documents left join f using (doc_id)), c as (select distinct fp from r),
  e as (select a.fp as x, b.fp as y from c a, c b where a.fp <> b.fp and bit_count(xor(a.fp, b.fp)) <= {RADIUS}),
  reach as (select fp as node, fp as root from c union select e.y, reach.root from reach join e on e.x = reach.node),
  least as (select root, min(doc_id) as m from reach join r on r.fp = reach.node group by 1)
  select doc_id, lower(printf('%016x', fp)) as fingerprint, m as component_id from r join least on root = fp"""


SQL = _sql()
