"""Queries of hit analytics and of the hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from manyfold.catalog import Catalog
from manyfold.catalog.tables import HITS, TAXA, hits, table, taxa
from manyfold.operators import hierarchy
from manyfold.operators import hits as ops
from manyfold.operators.keyed import transpose

catalog = Catalog()
add = catalog.add
WITH = f"with {HITS} "


def _backward(spark, d):
    """Hits the other way: part -> order, scored by where the hit starts."""
    return transpose(hits(spark, d)).withColumn("score", F.col("qstart").cast("double"))


def _forward(spark, d):
    return hits(spark, d).withColumn("score", F.col("qstart").cast("double"))


RBH = WITH + ", f as (select key, target, qstart::double as score from hits), b as (select target as key, key as target, score from f)"


@add("rbh", RBH + ", best as (select key, max(score) as best from f group by 1), ties as (select target as key, key as target, score from (select *, max(score) over (partition by key) as top from b) where score = top), m as (select key, max(score) as most from ties group by 1) select t.key, t.target, t.score from ties t join best using (key) join m using (key) where t.score = best and most <= best")
def _(spark, d):
    return ops.reciprocal_by_score(_forward(spark, d), _backward(spark, d))


@add("rbh_pairs", RBH + ", x as (select * from f qualify row_number() over (partition by key order by score desc, target) = 1), y as (select * from b qualify row_number() over (partition by key order by score desc, target) = 1) select x.key, x.target, x.score from x join y on y.key = x.target and y.target = x.key")
def _(spark, d):
    return ops.reciprocal_pairs(_forward(spark, d), _backward(spark, d))


@add("swapresults", WITH + ", s as (select target as key, key as target, score, evalue * 2 as evalue, tstart as qstart, tend as qend, qstart as tstart, qend as tend, qlen as tlen from hits where evalue * 2 <= 0.15) select key, target, evalue, qstart, qend, tstart, tend, row_number() over (partition by key order by evalue, score desc, tlen, target, qstart, tstart) as pos from s")
def _(spark, d):
    return ops.transpose_hits(hits(spark, d), F.col("evalue") * 2, 0.15).select("key", "target", "evalue", "qstart", "qend", "tstart", "tend", "pos")


@add("summarizealis", WITH + ", p as (select *, coalesce(max(qend) over (partition by key order by qstart, qend, pos rows between unbounded preceding and 1 preceding), -1) as before from hits) select key, count(*) as n, round(sum(greatest(before, qend) - greatest(before, qstart)) / max(qlen), 6) as unique_coverage, round(sum(qend - qstart) / max(qlen), 6) as summed_coverage, round(avg(identity), 6) as mean_identity from p group by 1")
def _(spark, d):
    found = ops.coverage_summary(hits(spark, d))
    return found.select("key", "n", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


def _picked(good: str, order: str) -> str:
    """SQL that walks each entry's lines in order and takes those that overlap little with what was taken before."""
    return f"""with recursive {HITS}, g as (select *, row_number() over (partition by key order by {order}) as i, least(qstart, qend) as a, greatest(qstart, qend) as b from hits where qstart < qlen and qend < qlen and {good}),
  w as (select key, i, true as ok, range(a, b) as held from g where i = 1
    union all select g.key, g.i, len(list_filter(w.held, lambda x: x >= g.a and x < g.b)) / (g.b - g.a + 1) <= 0.1,
      case when len(list_filter(w.held, lambda x: x >= g.a and x < g.b)) / (g.b - g.a + 1) <= 0.1 then list_distinct(list_concat(w.held, range(g.a, g.b))) else w.held end from w join g on g.key = w.key and g.i = w.i + 1)
  select key, pos, target, qstart, qend from g join w using (key, i) where ok"""


COVERED = "(abs(tend - tstart) + 1) / tlen"


@add("summarizeresult", _picked(f"{COVERED} >= 0.05", "pos"))
def _(spark, d):
    return ops.pick_domains(hits(spark, d), overlap=0.1, coverage=0.05).select("key", "pos", "target", "qstart", "qend")


@add("summarizetabs", _picked(f"{COVERED} > 0.05 and evalue < 0.08", "evalue, pos"))
def _(spark, d):
    return ops.pick_domains(hits(spark, d), overlap=0.1, coverage=0.05, most_evalue=0.08).select("key", "pos", "target", "qstart", "qend")


@add("offset_chain", WITH + ", c as (select supplier as key, 1 as target, qstart as q0, qend as q1, tstart as t0, tend as t1, qstart - tstart as dg from hits), f as (select *, case when q0 > coalesce(max(q1) over (partition by key, dg order by q0, q1 rows between unbounded preceding and 1 preceding), -2) + 1 then 1 else 0 end as fresh from c), g as (select *, sum(fresh) over (partition by key, dg order by q0, q1 range between unbounded preceding and current row) as chain from f) select key, target, min(q0) as qstart, max(q1) as qend, min(t0) as tstart, max(t1) as tend, count(*) as n from g group by key, target, dg, chain")
def _(spark, d):
    named = hits(spark, d).withColumn("key", F.col("supplier")).withColumn("target", F.lit(1))
    return ops.chain_diagonals(named)


@add("offsetalignment", WITH + ", o as (select o_orderkey as orf, o_custkey as contig, case when o_orderkey % 2 = 0 then 900 else 200 end as start, case when o_orderkey % 2 = 0 then -1 else 1 end as sign from orders) select contig as key, pos, target, start + sign * qstart as qstart, start + sign * qend as qend, 1000::bigint as qlen from hits join o on orf = key")
def _(spark, d):
    back = F.col("o_orderkey") % 2 == 0
    orfs = table(spark, d, "orders").select(F.col("o_orderkey").alias("orf"), F.col("o_custkey").alias("contig"), F.when(back, 900).otherwise(200).cast("long").alias("start"), F.when(back, 700).otherwise(400).cast("long").alias("stop"), F.lit(1000).cast("long").alias("contig_length"))
    return ops.to_contig(hits(spark, d), orfs).select("key", "pos", "target", "qstart", "qend", "qlen")


@add("proteinaln2nucl", WITH + "select key, pos, target, qstart * 3 as qstart, qend * 3 + 2 as qend, tstart * 3 as tstart, tend * 3 + 2 as tend, qlen * 3 as qlen, tlen * 3 as tlen, (qend - qstart) * 3 || 'M3I' || pos * 3 || 'D' as cigar from hits")
def _(spark, d):
    named = hits(spark, d).withColumn("cigar", F.concat((F.col("qend") - F.col("qstart")).cast("string"), F.lit("M1I"), F.col("pos").cast("string"), F.lit("D")))
    return ops.protein_to_nucleotide(named).select("key", "pos", "target", "qstart", "qend", "tstart", "tend", "qlen", "tlen", "cigar")


CHAINS = WITH + ", h as (select o_custkey as grp, key as chain, s_nationkey as taxon, target, score, pos from hits join orders on o_orderkey = key join supplier on s_suppkey = supplier), best as (select * from h qualify row_number() over (partition by grp, chain, taxon order by score desc, target, pos) = 1), c as (select *, count(*) over (partition by grp, taxon) as n from best)"


def _chains(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("grp"))
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("taxon"))
    return hits(spark, d).join(orders, "key").join(supplier, "supplier").select("grp", F.col("key").alias("chain"), "taxon", "target", "score", "pos")


@add("pairaln", CHAINS + " select grp, chain, taxon, target, score, pos from c where n > 1")
def _(spark, d):
    return ops.pair_best(_chains(spark, d), "grp")


@add("pairaln_all", CHAINS + ", s as (select grp, count(distinct chain) as every from h group by 1) select grp, chain, taxon, target, score, pos from c join s using (grp) where n = every")
def _(spark, d):
    return ops.pair_best(_chains(spark, d), "grp", everywhere=True)


@add("pairaln_nearest", "with l as (select user_id as grp, event_id as id from events where event_type = 'click'), r as (select user_id as grp, event_id as id from events where event_type = 'purchase'), p as (select l.grp, l.id, r.id as nearest, abs(l.id - r.id) as distance, row_number() over (partition by l.id order by abs(l.id - r.id), r.id) as k from l join r on l.grp = r.grp and abs(l.id - r.id) <= 2000) select grp, id, nearest, distance from p where k = 1")
def _(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("id"), F.col("event_id").alias("number"), "event_type")
    return ops.pair_nearest(events.where("event_type = 'click'"), events.where("event_type = 'purchase'"), 2000, "grp")


SETS = WITH + ", sizes as (select s_nationkey as set_id, count(*) as n from supplier group by 1), t as (select key, s_nationkey as set_id, target, evalue, pos, n from hits join supplier on s_suppkey = supplier join sizes on set_id = s_nationkey), r as (select *, -ln(case when evalue = 0 then 2.2250738585072014e-308 else evalue / n end) as s from t), q as (select *, row_number() over w as k, lead(s) over w as second, first_value(target) over (partition by key, set_id order by evalue, pos) as alone from r window w as (partition by key, set_id order by s desc, pos desc)), best as (select key, set_id, case when second is null then alone else target end as target, case when second is not null then second - s when evalue = 0 then ln(2.2250738585072014e-308) - ln(n + 1) when evalue < 1e-3 then ln(evalue) - ln(n + 1) else ln(1 - exp(-evalue)) - ln(n + 1) end as log_p from q where k = 1)"


def _best_per_set(spark, d):
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("set_id"))
    sizes = supplier.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    return ops.best_per_set(hits(spark, d).join(supplier, "supplier"), sizes)


@add("besthitperset", SETS + " select key, set_id, target, round(log_p, 6) as log_p from best")
def _(spark, d):
    return _best_per_set(spark, d).withColumn("log_p", F.round("log_p", 6))


QSETS = SETS + ", qs as (select c_nationkey as set_id, count(*) as n from orders join customer on c_custkey = o_custkey group by 1), v as (select c_nationkey as set_id, b.set_id as target_set, log_p, n from best b join orders on o_orderkey = key join customer on c_custkey = o_custkey join qs on qs.set_id = c_nationkey)"


def _combined(spark, d, mode):
    named = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("key"), F.col("c_nationkey").alias("query_set"))
    sizes = named.groupBy(F.col("query_set").alias("set_id")).agg(F.count(F.lit(1)).alias("n"))
    found = _best_per_set(spark, d).join(named, "key").select(F.col("query_set").alias("set_id"), F.col("set_id").alias("target_set"), "log_p")
    return ops.combine_sets(found, sizes, 25, mode).withColumn("value", F.round("value", 4))


@add("combine_minp", QSETS + " select set_id, target_set, round((1 - exp(-exp(least(min(log_p), 0)) * n)) * 25, 4) as value from v group by set_id, target_set, n")
def _(spark, d):
    return _combined(spark, d, "minimum")


@add("combine_product", QSETS + " select set_id, target_set, round(exp(sum(log_p)) * 25, 4) as value from v group by set_id, target_set, n")
def _(spark, d):
    return _combined(spark, d, "product")


@add("combine_truncated", QSETS + ", x as (select set_id, target_set, min(log_p) as m, ln(1.0 / (n + 1)) as t, sum(case when log_p < ln(1.0 / (n + 1)) then ln(1.0 / (n + 1)) - log_p end) as r from v group by set_id, target_set, n) select set_id, target_set, round(case when r is null then -least(m, 0) else r - t end, 4) as value from x")
def _(spark, d):
    return _combined(spark, d, "truncated")


MULTIHIT = """, x as (select set_id, target_set, n, coalesce(sum(case when log_p < ln(1.0 / (n + 1)) then ln(1.0 / (n + 1)) - log_p end), 0) as r from v group by all),
  k as (select n, unnest(range(1, n + 1)) as k from (select distinct n from x)),
  term as (select n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(1.0 / (n + 1)) + (n - k) * ln(1 - 1.0 / (n + 1))) as t from k),
  tail as (select n, k, sum(t) over (partition by n order by k desc) as t from term)
  select set_id, target_set, round(25 * case when r = 0 then 1 else (select sum(exp((k - 1) * ln(r) - lgamma(k) - r + ln(t))) from tail where tail.n = x.n and t > 0) end, 4) as value from x"""


@add("combine_multihit", QSETS + MULTIHIT)
def _(spark, d):
    return _combined(spark, d, "multihit")


@add("parseproteome", WITH + ", m as (select o_orderkey as key, c_nationkey as query_set from orders join customer on c_custkey = o_custkey), t as (select p_partkey as target, p_brand as target_set from part), n as (select query_set, count(distinct key) as n from m group by 1), b as (select distinct target_set from t), f as (select query_set, target_set, count(distinct key) as hit from hits join m using (key) join t using (target) group by 1, 2) select n.query_set, b.target_set, round(coalesce(hit, 0) / n, 6) as share from n cross join b left join f on f.query_set = n.query_set and f.target_set = b.target_set")
def _(spark, d):
    members = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("key"), F.col("c_nationkey").alias("query_set"))
    sets = table(spark, d, "part").select(F.col("p_partkey").alias("target"), F.col("p_brand").alias("target_set"))
    return ops.set_matrix(members, hits(spark, d), sets).withColumn("share", F.round("share", 6))


# --- hierarchy


def _lined(spark, d):
    nodes = taxa(spark, d)
    return hierarchy.lineages(nodes, hierarchy.closure(nodes))


def _mapping(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("item"), (F.col("s_nationkey") + 100).cast("long").alias("taxid"))


def _supplied(spark, d):
    return hits(spark, d).withColumn("target", F.col("supplier"))


CLOSURE = f"{TAXA}, up as (select taxid, taxid as ancestor, 0 as up from taxa union all select u.taxid, t.parent, u.up + 1 from up u join taxa t on t.taxid = u.ancestor where t.parent <> t.taxid)"
TREE = f"with recursive {CLOSURE} "
LINED = f"""with recursive {CLOSURE}, lab as (select taxid, case rank when 'species' then 's' when 'superkingdom' then 'd' else '-' end || '_' || name as label from taxa),
  lined as (select t.*, l.ancestors, l.lineage from taxa t join (select u.taxid, list(u.ancestor order by up desc) as ancestors, coalesce(string_agg(label, ';' order by up desc) filter (u.ancestor <> 1), '') as lineage from up u join lab on lab.taxid = u.ancestor group by 1) l using (taxid)), {HITS}, m as (select s_suppkey as supplier, s_nationkey + 100 as taxid from supplier)"""


@add("tax_closure", TREE + "select taxid, ancestor, up from up")
def _(spark, d):
    return hierarchy.closure(taxa(spark, d))


@add("tax_lineage", LINED + " select taxid, lineage, len(ancestors) - 1 as depth from lined")
def _(spark, d):
    return _lined(spark, d).select("taxid", "lineage", F.col("depth").cast("long").alias("depth"))


@add("is_ancestor_expr", LINED + " select taxid, name from lined where (list_contains(ancestors, 10) or list_contains(ancestors, 12)) and not list_contains(ancestors, 105)")
def _(spark, d):
    return _lined(spark, d).where(hierarchy.taxon_expression("(10||12)&&!105", F.col("ancestors"))).select("taxid", "name")


@add("addtaxonomy", LINED + " select key, pos, supplier, l.taxid, rank, name, lineage from hits join m using (supplier) join lined l on l.taxid = m.taxid")
def _(spark, d):
    return hierarchy.add_taxa(hits(spark, d), _mapping(spark, d), _lined(spark, d), "supplier").select("key", "pos", "supplier", "taxid", "rank", "name", "lineage")


@add("filtertaxdb", LINED + " select key, pos, supplier from hits join m using (supplier) join lined l on l.taxid = m.taxid where list_contains(ancestors, 11) or list_contains(ancestors, 103)")
def _(spark, d):
    return hierarchy.filter_taxa(hits(spark, d), _mapping(spark, d), _lined(spark, d), "11,103", "supplier").select("key", "pos", "supplier")


@add("filtertaxseqdb", LINED + " select c_custkey, c_name from customer join lined on taxid = c_nationkey + 100 where not list_contains(ancestors, 13)")
def _(spark, d):
    customer = table(spark, d, "customer")
    mapping = customer.select(F.col("c_custkey").alias("item"), (F.col("c_nationkey") + 100).cast("long").alias("taxid"))
    return hierarchy.filter_taxa(customer, mapping, _lined(spark, d), "!13", "c_custkey").select("c_custkey", "c_name")


LCA = LINED + ", v as (select distinct key, taxid from hits join m using (supplier) where taxid not in (select taxid from up where ancestor = 104)), n as (select key, count(*) as n from v group by 1), c as (select v.key, u.ancestor, count(*) as hit from v join up u on u.taxid = v.taxid group by 1, 2), dep as (select taxid, max(up) as depth from up group by 1), b as (select c.key, arg_max(c.ancestor, depth) as taxid from c join n on n.key = c.key and n.n = c.hit join dep on dep.taxid = c.ancestor group by 1)"


@add("lca", LCA + " select o_orderkey as key, coalesce(b.taxid, 0) as taxid, coalesce(rank, 'no rank') as rank, coalesce(name, 'unclassified') as name from orders left join b on b.key = o_orderkey left join taxa on taxa.taxid = b.taxid")
def _(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    return hierarchy.lowest_common_ancestor(_supplied(spark, d), _mapping(spark, d), _lined(spark, d), keys, (104,))


def _majority(weight: str, members: str) -> str:
    return LINED + f""", h as ({members}), v as (select h.key, m.taxid, {weight} as w from h join m using (supplier)), tot as (select key, sum(w) as every, count(*) as assigned from v group by 1),
      s as (select v.key, u.ancestor, v.w, coalesce((select ancestor from up x where x.taxid = v.taxid and x.up = u.up - 1), 0) as child from v join up u on u.taxid = v.taxid),
      a as (select key, ancestor, sum(w) as w, count(*) as agreeing, count(distinct child) as kids, min(child) as own from s group by 1, 2),
      r as (select a.*, w / every as share, case when ancestor >= 100 then 4 when ancestor >= 10 then 28 else 29 end as r, assigned from a join tot using (key) where (kids > 1 or own = 0) and w / every >= 0.5),
      b as (select * from r qualify row_number() over (partition by key order by r, share desc, ancestor) = 1), n as (select key, count(*) as n from h group by 1)
      select n.key, coalesce(ancestor, 0) as taxid, coalesce(rank, 'no rank') as rank, coalesce(name, 'unclassified') as name, n, coalesce(tot.assigned, 0) as assigned, coalesce(agreeing, 0)::bigint as agreeing, round(coalesce(share, 0), 2) as share
      from n left join b on b.key = n.key left join tot on tot.key = n.key left join taxa on taxa.taxid = b.ancestor"""


@add("majoritylca", _majority("score", "select * from hits"))
def _(spark, d):
    return hierarchy.majority_ancestor(_supplied(spark, d), _mapping(spark, d), _lined(spark, d), weight=F.col("score"), blocked=())


BY_CUSTOMER = "select o_custkey as key, supplier, evalue from hits join orders on o_orderkey = key"


def _by_customer(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    return _supplied(spark, d).join(orders, "key").select(F.col("o_custkey").alias("key"), "target", "evalue")


@add("aggregatetax", _majority("1.0", BY_CUSTOMER))
def _(spark, d):
    return hierarchy.majority_ancestor(_by_customer(spark, d), _mapping(spark, d), _lined(spark, d), blocked=())


@add("aggregatetaxweights", _majority("case when evalue > 0 then -ln(evalue) else 1000 end", BY_CUSTOMER))
def _(spark, d):
    return hierarchy.majority_ancestor(_by_customer(spark, d), _mapping(spark, d), _lined(spark, d), weight=hierarchy.vote_weight("minus_log_evalue", F.col("evalue")), blocked=())


@add("taxonomyreport", LINED + ", a as (select c_custkey as key, case when c_acctbal < 0 then 0 else c_nationkey + 100 end as taxid from customer), own as (select taxid, count(*) as own from a group by 1), cl as (select u.ancestor as taxid, sum(own)::bigint as clade from own join up u on u.taxid = own.taxid group by 1), p as (select u.taxid, flatten(list([-cl.clade, u.ancestor] order by up desc)) as path from up u join cl on cl.taxid = u.ancestor group by 1) select l.taxid, l.rank, l.name, len(l.ancestors) - 1 as depth, round(100 * clade / (select count(*) from a), 6) as percent, clade, coalesce(own, 0) as own, path::varchar as path from lined l join cl on cl.taxid = l.taxid join p on p.taxid = l.taxid left join own on own.taxid = l.taxid union all select 0, 'no rank', 'unclassified', 0, round(100 * own / (select count(*) from a), 6), own, own, [-4611686018427387904, 0]::varchar from own where taxid = 0")
def _(spark, d):
    assigned = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_acctbal") < 0, 0).otherwise(F.col("c_nationkey") + 100).cast("long").alias("taxid"))
    found = hierarchy.clade_report(assigned, _lined(spark, d))
    return found.withColumns({"percent": F.round("percent", 6), "depth": F.col("depth").cast("long"), "path": F.concat(F.lit("["), F.array_join("path", ", "), F.lit("]"))})
