"""Queries of the operators on keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from manyfold.catalog import Catalog
from manyfold.catalog.tables import HITS, SEQS, hits, seqs, table
from manyfold.operators import keyed

catalog = Catalog()
add = catalog.add
WITH = f"with {HITS} "


def _sorted(order: str) -> str:
    return WITH + f"select key, row_number() over (partition by key order by {order}, pos) as pos, target, score from hits"


@add("filter_sort_inc", _sorted("score"))
def _(spark, d):
    return keyed.sort_entries(hits(spark, d), "score").select("key", "pos", "target", "score")


@add("filter_sort_dec", _sorted("score desc"))
def _(spark, d):
    return keyed.sort_entries(hits(spark, d), "score", "decreasing").select("key", "pos", "target", "score")


@add("filter_priority", WITH + "select key, row_number() over (partition by key order by coalesce(p_retailprice, 0) desc, pos) as pos, target, score from hits left join part on p_partkey = target and p_size <= 25")
def _(spark, d):
    weights = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("weight"))
    return keyed.sort_entries(hits(spark, d), "target", "priority", weights).select("key", "pos", "target", "score")


@add("filter_shuffle")
def _(spark, d):
    return keyed.sort_entries(hits(spark, d), "score", "shuffle", seed=7).select("key", "pos", "target", "score")


LISTED = "select p_partkey from part where p_brand = 'Brand#11' or p_size < 10"


def _listed(spark, d):
    return table(spark, d, "part").where("p_brand = 'Brand#11' or p_size < 10").select("p_partkey")


@add("filter_file_pos", WITH + f"select key, pos, target from hits where target in ({LISTED})")
def _(spark, d):
    return keyed.filter_by_list(hits(spark, d), "target", _listed(spark, d)).select("key", "pos", "target")


@add("filter_file_neg", WITH + f"select key, pos, target from hits where target not in ({LISTED})")
def _(spark, d):
    return keyed.filter_by_list(hits(spark, d), "target", _listed(spark, d), keep=False).select("key", "pos", "target")


@add("filter_mapping", WITH + "select h.key, h.pos, s.s_nationkey::bigint as supplier from hits h join supplier s on s.s_suppkey = h.supplier where s.s_acctbal > 0")
def _(spark, d):
    mapping = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("old"), F.col("s_nationkey").cast("long").alias("new"))
    return keyed.map_column(hits(spark, d), "supplier", mapping).select("key", "pos", "supplier")


@add("filter_first_n", WITH + "select key, pos, target from hits where pos <= 3")
def _(spark, d):
    return keyed.first_lines(hits(spark, d), 3).select("key", "pos", "target")


@add("filter_join", WITH + "select key, pos, target, o_custkey, o_totalprice from hits join orders on o_orderkey = target")
def _(spark, d):
    return keyed.join_entries(hits(spark, d), "target", table(spark, d, "orders"), ["o_custkey", "o_totalprice"], "o_orderkey").select("key", "pos", "target", "o_custkey", "o_totalprice")


def _beats(how: str, sign: str, factor: float) -> None:
    sql = WITH + f"select key, pos, target, score from (select *, first_value(score) over (partition by key order by pos) as f from hits) where pos = 1 or score {sign} f * {factor}"

    @add(f"filter_beats_first_{how}", sql)
    def _(spark, d):
        return keyed.beats_first(hits(spark, d), "score", how, factor).select("key", "pos", "target", "score")


for _how, _sign, _factor in (("ge", ">=", 1.0), ("le", "<=", 1.0), ("e", "=", 1.0), ("ip", ">=", 0.5), ("op", "<=", 0.5), ("ep", "=", 0.5)):
    _beats(_how, _sign, _factor)


def _numeric(how: str, sign: str, value: float) -> None:
    @add(f"filter_numeric_{how}", WITH + f"select key, pos, qstart from hits where qstart {sign} {value}")
    def _(spark, d):
        return keyed.compare(hits(spark, d), "qstart", how, value).select("key", "pos", "qstart")


for _how, _sign in (("ge", ">="), ("le", "<="), ("e", "=")):
    _numeric(_how, _sign, 25.0)


@add("filter_expression", WITH + "select key, pos, qstart, qend from hits where (qend - qstart) * 2 > 20 and sqrt(qstart) < 6 or qend % 7 = 0")
def _(spark, d):
    return keyed.filter_expression(hits(spark, d), "(($2 - $1) * 2 > 20 && sqrt($1) < 6) || $2 % 7 == 0", ["qstart", "qend"]).select("key", "pos", "qstart", "qend")


@add("filter_regex", "select o_orderkey as key, 1::bigint as pos, o_orderpriority from orders where regexp_matches(o_orderpriority, '^[12]-|LOW')")
def _(spark, d):
    named = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.lit(1).cast("long").alias("pos"), "o_orderpriority")
    return keyed.filter_pattern(named, "o_orderpriority", "^[12]-|LOW")


@add("filter_trim", WITH + "select key, pos, score from hits where pos <= 2")
def _(spark, d):
    return keyed.trim_to(keyed.first_lines(hits(spark, d), 2), "score")


@add("filter_identity", WITH + "select key, pos, target from hits where score >= 60000 or key = target")
def _(spark, d):
    all_hits = hits(spark, d)
    return keyed.with_identity(keyed.compare(all_hits, "score", "ge", 60000.0), all_hits).select("key", "pos", "target")


# --- set operations

ORDERS = "select o_orderkey from orders where o_orderpriority = '1-URGENT'"


@add("createsubdb", WITH + f"select key, pos, target from hits where key in ({ORDERS})")
def _(spark, d):
    wanted = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return keyed.subset(hits(spark, d), wanted).select("key", "pos", "target")


def _named(spark, d, name, key, value):
    return table(spark, d, name).select(F.col(key).cast("long").alias("key"), F.col(value).alias("value"))


@add("concatdbs_renumber", "select c_custkey as key, c_name as value from customer union all select (select max(c_custkey) from customer) + dense_rank() over (order by s_suppkey), s_name from supplier")
def _(spark, d):
    return keyed.concat(_named(spark, d, "customer", "c_custkey", "c_name"), _named(spark, d, "supplier", "s_suppkey", "s_name"))


@add("concatdbs_preserve", "select c_custkey as key, c_name as value from customer union all select s_suppkey, s_name from supplier")
def _(spark, d):
    return keyed.concat(_named(spark, d, "customer", "c_custkey", "c_name"), _named(spark, d, "supplier", "s_suppkey", "s_name"), preserve=True)


@add("concatdbs_larger", "select key, value from (select *, row_number() over (partition by key order by length(value) desc, f) as r from (select p_partkey as key, p_type as value, 0 as f from part union all select c_custkey, c_name, 1 from customer)) where r = 1")
def _(spark, d):
    return keyed.concat_larger(_named(spark, d, "part", "p_partkey", "p_type"), _named(spark, d, "customer", "c_custkey", "c_name"), "value")


@add("splitdb", "select key, least(floor((row_number() over (order by key) - 1) * 8.0 / count(*) over ()), 7)::bigint as part from (select o_orderkey as key from orders)")
def _(spark, d):
    return keyed.split(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), 8)


@add("splitdb_by_size", f"with {SEQS}, s as (select key, sum(length(seq)) over (order by key) as upto, length(seq) as own, sum(length(seq)) over () as total from seqs) select key, least(floor((upto - own) * 5.0 / total), 4)::bigint as part from s")
def _(spark, d):
    return keyed.split(seqs(spark, d).select("key", F.length("seq").alias("n")), 5, "n").select("key", "part")


PARTS_A, PARTS_B = "qstart <= 25", "qstart > 15"


@add("mergedbs", WITH + f", a as (select * from hits where {PARTS_A}), b as (select * from hits where {PARTS_B}), u as (select 0 as f, 'A' as prefix, * from a union all select 1, 'B', * from b where key in (select key from a)) select key, row_number() over (partition by key order by f, pos) as pos, target, prefix from u")
def _(spark, d):
    h = hits(spark, d)
    return keyed.merge([h.where(PARTS_A), h.where(PARTS_B)], ["A", "B"]).select("key", "pos", "target", "prefix")


@add("mergedbs_filter_target", WITH + f", a as (select * from hits where {PARTS_A}), b as (select * from hits where {PARTS_B}), u as (select 0 as f, * from a union all select 1, * from b where key in (select key from a)), w as (select *, row_number() over (partition by key, target order by f, pos) as r from u where target in ({LISTED})) select key, row_number() over (partition by key order by f, pos) as pos, target from w where r = 1")
def _(spark, d):
    h = hits(spark, d)
    return keyed.merge([h.where(PARTS_A), h.where(PARTS_B)], allowed=_listed(spark, d)).select("key", "pos", "target")


@add("subtractdbs", WITH + "select key, pos, target from hits h where exists (select 1 from hits n where n.key = h.key and n.target = h.target and n.evalue <= 0.05) and not exists (select 1 from hits r where r.key = h.key and r.target = h.target and r.qstart > 30 and r.evalue <= 0.05)")
def _(spark, d):
    h = hits(spark, d)
    return keyed.subtract(h, h.where("qstart > 30"), 0.05).select("key", "pos", "target")


@add("swapdb", WITH + "select target as key, row_number() over (partition by target order by key, pos) as pos, key as target, score from hits")
def _(spark, d):
    return keyed.transpose(hits(spark, d)).select("key", "pos", "target", "score")


@add("renamedbkeys", WITH + "select o_custkey + 1000000 as key, pos, target from hits join orders on o_orderkey = key where o_orderstatus = 'O'")
def _(spark, d):
    mapping = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("old"), (F.col("o_custkey") + 1000000).alias("new"))
    return keyed.rename_keys(hits(spark, d), mapping).select("key", "pos", "target")


@add(
    "diffseqdbs",
    """with o as (select text as header, min(doc_id) as old_key from documents where lang <> 'de' group by 1), n as (select text as header, min(doc_id) as new_key from documents where source <> 'src0' group by 1)
    select old_key, new_key, case when new_key is null then 'removed' when old_key is null then 'new' else 'kept' end as state from o full outer join n using (header)""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("header"), "lang", "source")
    return keyed.compare_headers(docs.where("lang <> 'de'"), docs.where("source <> 'src0'"))


@add("prefixid", WITH + "select key, pos, concat_ws(chr(9), key, target) as line from hits")
def _(spark, d):
    return hits(spark, d).select("key", "pos", F.concat_ws("\t", "key", "target").alias("line"))


@add("suffixid", WITH + "select key, pos, concat_ws(chr(9), target, key) as line from hits")
def _(spark, d):
    return hits(spark, d).select("key", "pos", F.concat_ws("\t", "target", "key").alias("line"))


@add("mergeresultsbyset", WITH + "select o_custkey as key, row_number() over (partition by o_custkey order by o_orderkey, pos) as pos, o_orderkey as member, target from hits join orders on o_orderkey = key")
def _(spark, d):
    members = table(spark, d, "orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("member"))
    return keyed.merge_by_set(members, hits(spark, d)).select("key", "pos", "member", "target")


@add("view", WITH + "select key, pos, target, score from hits where key in (1, 7, 42)")
def _(spark, d):
    return hits(spark, d).where(F.col("key").isin(1, 7, 42)).select("key", "pos", "target", "score")


# --- aggregates


@add("stat_lines", WITH + ", s as (select key, count(*) as linecount, avg(score) as mean, min(score) as min, max(score) as max, sum(score) as sum, arg_min(score, pos) as firstline from hits group by key) select o_orderkey as key, coalesce(linecount, 0) as linecount, round(mean, 6) as mean, min, max, round(sum, 4) as sum, firstline from orders left join s on key = o_orderkey")
def _(spark, d):
    found = keyed.statistics(hits(spark, d), "score", keys=table(spark, d, "orders").select("o_orderkey"))
    return found.withColumn("mean", F.round("mean", 6)).withColumn("sum", F.round("sum", 4))


@add("stat_strlen", f"with {SEQS} select key, length(seq)::bigint as strlen from seqs")
def _(spark, d):
    return seqs(spark, d).select("key", F.length("seq").cast("long").alias("strlen"))


@add("sortresult", WITH + "select key, row_number() over (partition by key order by evalue, score desc, tlen, target, pos) as pos, target, evalue, score from hits")
def _(spark, d):
    return keyed.renumber(hits(spark, d), ["evalue", F.desc("score"), "tlen", "target", "pos"]).select("key", "pos", "target", "evalue", "score")


@add("result2repseq", WITH + f", {SEQS} select h.key, s.seq from hits h join seqs s on s.key = h.target where h.pos = 1")
def _(spark, d):
    return keyed.representative(hits(spark, d), seqs(spark, d))
