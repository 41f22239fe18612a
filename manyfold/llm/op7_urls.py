"""URL filters: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join.

The list holds canonical entries ``host/path-prefix`` with a verdict.  A URL is looked up under every suffix of its host
(cut at label borders) joined with every prefix of its path whose length occurs in the list; entries that the Bloom
filter rules out never leave the row.  What remains is joined exactly with the list, which removes the filter's false
positives, and the longest entry wins.

The filter has a fixed number of blocks of eight 32-bit words, one bit set in each word of a key's block, so its size is
bounded by ``BLOOM_BLOCKS`` however long the list is; a longer list costs false positives, which the join removes.  The
join broadcasts the list only when its rows are at most ``BROADCAST_ROWS``; beyond that both sides are shuffled by the
entry, and adaptive execution splits entries that hold many URLs.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no entry and is allowed; a null or
empty list allows everything; repeated list entries count once, and block wins over allow for the same entry; repeated
pages are judged one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of the contract: (host, path prefix, verdict); a rule fits its host and all subdomains.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: The method's own list: hosts of unwanted kinds; a listed host stands for all its subdomains.
UNWANTED = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED = tuple((f"{name}.example.{top}", "/", "block") for name in UNWANTED for top in ("com", "net", "org"))
BLOOM_BLOCKS = 1 << 14
BROADCAST_ROWS = 50_000
WORDS = 8
_SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.instr(url, "://") > 0, lower).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def listing(spark: SparkSession, entries: Sequence[tuple[str, str, str]], kind: str) -> DataFrame:
    """A list as a table ``(entry, host, verdict, kind)`` from (host, path prefix, verdict)."""
    return spark.createDataFrame([(h + p, h, v, kind) for h, p, v in entries], "entry string, host string, verdict string, kind string")


class BlockedBloom:
    """A split-block Bloom filter as one array of 32-bit words (kept in longs)."""

    def __init__(self, blocks: int):
        self.blocks = blocks
        self.words = np.zeros(blocks * WORDS, np.int64)

    @staticmethod
    def positions(hashed: int, blocks: int) -> list[tuple[int, int]]:
        block = (hashed & (1 << 63) - 1) % blocks
        low = hashed & 0x7FFFFFFF
        return [(block * WORDS + i, (low * salt & 0xFFFFFFFF) >> 27) for i, salt in enumerate(_SALTS)]

    def add(self, key: str) -> None:
        for word, bit in self.positions(xxhash.xxh64_intdigest(key.encode(), 42), self.blocks):
            self.words[word] |= 1 << bit

    def places(self, key: Column) -> Column:
        """The words and bits of a key as a JVM-side array of structs; Spark's xxhash64 has the same seed."""
        hashed = F.xxhash64(key)
        block = F.pmod(hashed.bitwiseAND(F.lit((1 << 63) - 1)), F.lit(self.blocks)).cast("int") * WORDS
        low = hashed.bitwiseAND(F.lit(0x7FFFFFFF))
        # 31 bits by 32 bits: no overflow
        bits = [F.shiftrightunsigned((low * F.lit(salt)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for salt in _SALTS]
        return F.array(*[F.struct((block + F.lit(i)).alias("word"), bit.alias("bit")) for i, bit in enumerate(bits)])

    def __contains__(self, key: str) -> bool:
        return all(self.words[word] >> bit & 1 for word, bit in self.positions(xxhash.xxh64_intdigest(key.encode(), 42), self.blocks))

    def might_contain(self, key: Column) -> Column:
        """The same test as ``in``, as a JVM-side expression."""
        words = F.split(F.lit(",".join(map(str, self.words.tolist()))), ",").cast("array<bigint>")
        return F.forall(self.places(key), lambda p: F.call_function("shiftright", F.get(words, p["word"]), p["bit"]).bitwiseAND(F.lit(1)) == 1)


def bloom_of(listed: DataFrame, most: int = BLOOM_BLOCKS) -> BlockedBloom:
    """The filter over ``listed.entry``; executors hash the entries, and the driver gets the words that are set, at most WORDS x ``most``."""
    rows = listed.count()
    bloom = BlockedBloom(int(min(most, max(16, 1 << int(np.ceil(np.log2(max(1, rows / 8))))))))
    each = listed.select(F.explode(bloom.places(F.col("entry"))).alias("p")).groupBy("p.word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p.bit"))).alias("bits"))
    for r in each.collect():
        bloom.words[r["word"]] = r["bits"]
    return bloom


def lookups(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """All entries under which a URL may be listed: host suffixes joined with path prefixes of the listed lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: F.length(path) >= n), lambda n: F.substring(path, F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Return ``(<id_col>, host, path, rule, verdict, listed)``, one row per page.

    listed: ``(entry, host, verdict, kind)``; the longest entry of kind ``rule`` decides, else the longest other one blocks
    or allows, else the page is allowed.  Pages that the filter finds no possible entry for are judged where they are read.
    """
    ranked = F.min(F.struct((F.col("verdict") != "block").cast("int").alias("o"), "verdict"))["verdict"]
    known = listed.where("entry is not null and host is not null").groupBy("entry", "kind").agg(ranked.alias("v"), F.min("host").alias("h"))
    bloom = bloom_of(known.select("entry").distinct())
    lengths = [r[0] for r in known.select((F.length("entry") - F.length("h")).alias("n")).distinct().orderBy("n").collect()]
    page = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.coalesce(path_of(F.col(url_col)), F.lit("")).alias("path")
    )
    if not lengths:
        return page.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("listed"))
    looked = page.withColumn("possible", F.filter(lookups(F.col("host"), F.col("path"), lengths), bloom.might_contain))
    unlisted = looked.where(F.size("possible") == 0).select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("listed"))
    spread = looked.where(F.size("possible") > 0).select("row", "id", "host", "path", F.explode("possible").alias("entry"))
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hits = spread.join(F.broadcast(known) if few else known, "entry", "left")

    def best(kind: str) -> Column:
        fits = F.col("v").isNotNull() & (F.col("kind") == kind) & (F.col("h") != "")
        return F.max(F.when(fits, F.struct(F.length("entry").alias("n"), "entry", "v")))

    top = hits.groupBy("row").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), best("rule").alias("r"), best("listed").alias("l"))
    judged = top.select(F.col("id").alias(id_col), "host", "path", F.col("r.entry").alias("rule"), F.coalesce("r.v", "l.v", F.lit("allow")).alias("verdict"), F.col("l.entry").alias("listed"))
    return unlisted.unionByName(judged)


#: DuckDB SQL for ``judge`` with RULES and LISTED.
SQL = """
with p as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), u as (
  select page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path, row_number() over () as row_id from p
), l(host, path, verdict, kind) as (values %s),
m as (
  select u.row_id, l.kind, arg_max(l.host || l.path, length(l.host || l.path)) as entry, arg_max(l.verdict, length(l.host || l.path)) as verdict
  from u join l on (u.host = l.host or ends_with(u.host, '.' || l.host)) and starts_with(u.path, l.path) group by all
)
select u.page_id, u.host, u.path, r.entry as rule, coalesce(r.verdict, f.verdict, 'allow') as verdict, f.entry as listed
from u left join m r on r.row_id = u.row_id and r.kind = 'rule' left join m f on f.row_id = u.row_id and f.kind = 'listed'
""" % ", ".join(str((h, p, v, k)) for entries, k in ((RULES, "rule"), (LISTED, "listed")) for h, p, v in entries)
