"""The operators' input models built from the given tables, in Spark and, with the same meaning, in DuckDB SQL.

``hits``: lines of keyed results from ``lineitem``; ``seqs``, ``queries``, ``nucl``: letters of whole texts; ``taxa``: the hierarchy
root > region > nation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manyfold.operators.keyed import renumber

LETTERS, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key, pos, target, score, evalue, identity, qstart, qend, qlen, tstart, tend, tlen, supplier)``, coordinates 0-based closed."""
    long = lambda x: F.expr(x).cast("long")
    out = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("target"), F.col("l_extendedprice").alias("score"), F.col("l_discount").alias("evalue"),
        (1 - F.col("l_tax")).alias("identity"), long("l_quantity").alias("qstart"), (long("l_quantity") + long("l_linenumber") * 5).alias("qend"), F.lit(100).cast("long").alias("qlen"),
        long("l_suppkey % 40").alias("tstart"), long("l_suppkey % 40 + l_linenumber * 5").alias("tend"), F.lit(120).cast("long").alias("tlen"), F.col("l_suppkey").alias("supplier"),
    )
    return renumber(out, ["qend", "target", "supplier", "score", "evalue", "identity"]).select("key", "pos", *[c for c in out.columns if c != "key"])


HITS = """hits as (
  select l_orderkey as key, row_number() over (partition by l_orderkey order by l_quantity::bigint + l_linenumber * 5, l_partkey, l_suppkey, l_extendedprice, l_discount, 1 - l_tax) as pos,
    l_partkey as target, l_extendedprice as score, l_discount as evalue, 1 - l_tax as identity, l_quantity::bigint as qstart, l_quantity::bigint + l_linenumber * 5 as qend, 100::bigint as qlen,
    (l_suppkey % 40)::bigint as tstart, (l_suppkey % 40 + l_linenumber * 5)::bigint as tend, 120::bigint as tlen, l_suppkey as supplier from lineitem)"""


def letters(text: Column) -> Column:
    """ASCII letters of a text in upper case; what isn't one is left out before case is changed."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""))


def spread(read: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, as of one row group, is dealt out; others stay as they are read."""
    cores = read.sparkSession.sparkContext.defaultParallelism
    return read.repartition(cores) if read.rdd.getNumPartitions() < cores else read


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("key"), letters(F.col("text")).alias("seq"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), letters(F.col("text")).alias("seq"))


def nucl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs(spark, sf_dir).select("key", F.translate("seq", LETTERS, BASES).alias("seq"))


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(taxid, parent, rank, name)``: 1, 10 + region, 100 + nation; the root is its own parent."""
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 10).cast("long").alias("taxid"), F.lit(1).cast("long").alias("parent"), F.lit("superkingdom").alias("rank"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("taxid"), (F.col("n_regionkey") + 10).cast("long").alias("parent"), F.lit("species").alias("rank"), F.col("n_name").alias("name"))
    root = spark.createDataFrame([(1, 1, "no rank", "root")], "taxid long, parent long, rank string, name string")
    return root.unionByName(region).unionByName(nation)


CLEAN = "upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))"
SEQS = f"seqs as (select doc_id as key, {CLEAN} as seq from documents)"
QUERIES = f"queries as (select item_id as key, {CLEAN} as seq from benchmark)"
NUCL = f"nucl as (select doc_id as key, translate({CLEAN}, '{LETTERS}', '{BASES}') as seq from documents)"
TAXA = """taxa as (select 1::bigint as taxid, 1::bigint as parent, 'no rank' as rank, 'root' as name
  union all select r_regionkey + 10, 1, 'superkingdom', r_name from region union all select n_nationkey + 100, n_regionkey + 10, 'species', n_name from nation)"""
