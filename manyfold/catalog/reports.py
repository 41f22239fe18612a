"""Queries of writers and workflows."""

from __future__ import annotations

from pyspark.sql import functions as F

from manyfold.catalog import Catalog
from manyfold.catalog.similarity import BEST, BITS, CANDIDATES, CENTRES, _aligned, _best_diagonals, _cover, _diagonals, _lowest, _stretches, _words
from manyfold.catalog.tables import HITS, QUERIES, SEQS, TAXA, hits, queries, seqs, table, taxa
from manyfold.operators import clustering
from manyfold.operators.candidates import kmer_index
from manyfold.plans import workflows
from manyfold.sources import writers
from manyfold.streaming.clusters import windowed_counts

catalog = Catalog()
add = catalog.add


@add("convert2fasta", f"with {SEQS} select key, '>' || source || '/' || doc_id || chr(10) || seq as value from seqs join documents on doc_id = key")
def _(spark, d):
    headers = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.concat_ws("/", "source", "doc_id").alias("header"))
    return writers.fasta(seqs(spark, d), headers)


@add("createtsv", f"with {HITS} select key, pos, concat_ws(chr(9), coalesce(o_orderstatus, '') || key, coalesce(p_name, target::varchar), qstart, qend) as value from (select key, pos, target, qstart, qend from hits) left join orders on o_orderkey = key left join part on p_partkey = target")
def _(spark, d):
    names = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("name"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    return writers.tsv(hits(spark, d).select("key", "pos", "target", "qstart", "qend"), names, parts)


@add("createtsv_first_as_repr", f"with {HITS} select key, pos, concat_ws(chr(9), first_value(target) over (partition by key order by pos), target) as value from hits")
def _(spark, d):
    return writers.tsv(hits(spark, d).select("key", "pos", "target"), first_as_key=True)


@add("result2flat", f"with {HITS} select key, '>' || key || chr(10) || string_agg(target::varchar, chr(10) order by pos) as value from hits group by key")
def _(spark, d):
    return writers.flat(hits(spark, d), "target")


@add("createseqfiledb", f"with {SEQS}, c as (select min(key) over (partition by seq) as rep, key as member, seq from seqs), n as (select rep from c group by 1 having count(*) between 2 and 100000) select rep as key, string_agg('>' || member || chr(10) || seq, chr(10) order by member <> rep, member) as value from c where rep in (select rep from n) group by 1")
def _(spark, d):
    return writers.cluster_fasta(clustering.by_hash(seqs(spark, d)).select("rep", "member"), seqs(spark, d), 2, 100_000)


@add("clusters_keyed", f"with {SEQS}, c as (select min(key) over (partition by seq) as rep, key as member from seqs) select rep as key, row_number() over (partition by rep order by rep <> member, member) as pos, member as target from c")
def _(spark, d):
    return clustering.representatives_first(clustering.by_hash(seqs(spark, d)))


def _aligned_hits(spark, d):
    """Hits of ``lineitem`` with a path of three runs, for the report's columns."""
    size = F.col("qend") - F.col("qstart")
    return hits(spark, d).withColumns({"cigar": F.concat(size.cast("string"), F.lit("M1I2M")), "length": size + 3, "bits": F.floor(F.col("score") / 1000).cast("long")})


@add(
    "convertalis_cols",
    f"with {HITS}, a as (select *, qend - qstart + 3 as length from hits) select key as query, target, 1 as gapopen, round(identity, 3) as fident, round(identity * length)::bigint as nident, length - 1 - round(identity * length)::bigint as mismatch, qstart + 1 as qstart, qend + 1 as qend, tstart + 1 as tstart, tend + 1 as tend, length as alnlen, round((qend - qstart + 1) / qlen, 3) as qcov, round((tend - tstart + 1) / tlen, 3) as tcov, floor(score / 1000)::bigint as bits, score as raw, '-' as empty from a",
)
def _(spark, d):
    return writers.report(_aligned_hits(spark, d), "query,target,gapopen,fident,nident,mismatch,qstart,qend,tstart,tend,alnlen,qcov,tcov,bits,raw,empty")


@add("convertalis_evalue", f"with {HITS} select key as query, target, pos, printf('%.3E', evalue) as evalue from hits")
def _(spark, d):
    return writers.report(_aligned_hits(spark, d), "query,target,pos,evalue")


@add("convertalis_sam", f"with {HITS} select key, concat_ws(chr(9), key, '0', target, tstart + 1, '255', case when qstart > 0 then qstart || 'H' else '' end || (qend - qstart) || 'M1I2M' || case when qend < qlen - 1 then (qlen - 1 - qend) || 'H' else '' end, '*', '0', '0', '*', '*', 'AS:i:' || floor(score)::bigint, 'NM:i:' || (qend - qstart + 3 - round(identity * (qend - qstart + 3))::bigint)) as value from hits")
def _(spark, d):
    return writers.sam(_aligned_hits(spark, d).withColumn("score", F.floor("score")))


@add("easy_search")
def _(spark, d):
    found = workflows.search(queries(spark, d), seqs(spark, d))
    return writers.report(found, writers.DEFAULT_COLUMNS)


@add("easy_rbh")
def _(spark, d):
    return workflows.reciprocal_search(queries(spark, d), seqs(spark, d))


@add("map", f"with {_best_diagonals(_diagonals(12), 15)}, {_stretches('found', 'queries', 'seqs')} select * from rescored where identical >= 0.9 * overlap and overlap >= 0.95 * qlen")
def _(spark, d):
    return workflows.map_near(queries(spark, d), seqs(spark, d))


LINSEARCH = f"""{SEQS}, {QUERIES}, {_words('w', 'seqs')}, {_lowest('low', 'w', 12, 40)}, {CENTRES}, {_words('v', 'queries')}, {_lowest('own', 'v', 12, 40)},
  pairs as (select key, centre as target, place - centre_place as diagonal from own join centres using (kmer)), first as ({BEST}), {_stretches('first', 'queries', 'seqs')}, likely as (select * from rescored where score >= 40)"""


@add("linsearch", f"{_aligned(LINSEARCH, 'likely', 'queries', 'seqs')} select key, target, score, qend, tend, {BITS} as bits from aligned")
def _(spark, d):
    found = workflows.linear_search(queries(spark, d), kmer_index(seqs(spark, d), 12, 40), seqs(spark, d), 12, 40)
    return found.select("key", "target", "score", "qend", "tend", "bits")


# of one query, e-values fall as scores rise
SEARCH = f"{_aligned(CANDIDATES, 'found', 'queries', 'seqs')} select key, row_number() over (partition by key order by score desc, length(s.seq), target) as pos, target, score, qend, tend from aligned join (select key as target, seq from seqs) s using (target)"


@add("search", SEARCH)
def _(spark, d):
    return workflows.search(queries(spark, d), seqs(spark, d)).select("key", "pos", "target", "score", "qend", "tend")


@add("search_sliced", SEARCH)
def _(spark, d):
    return workflows.search_in_slices(queries(spark, d), seqs(spark, d), 3).select("key", "pos", "target", "score", "qend", "tend")


# equal sequences first; then centres without gaps, among one sequence of each
LINEAR = f"""{SEQS}, same as (select min(key) over (partition by seq) as rep, key as member from seqs), kept as (select * from seqs where key in (select rep from same)),
  {_words('w', 'kept')}, {_lowest('low', 'w', 12, 21)}, {CENTRES}, pairs as (select centre as key, key as target, centre_place - place as diagonal from low join centres using (kmer) where key <> centre and length / centre_length >= 0.8),
  matched as ({BEST}), {_stretches('matched', 'kept', 'kept')},
  edges as (select key as src, target as dst, score from rescored where identical >= 0.9 * overlap and overlap / greatest(qlen, tlen) >= 0.8)"""


@add("linclust", _cover(LINEAR, "kept") + " select c.rep, s.member from same s join covered c on c.member = s.rep")
def _(spark, d):
    return workflows.linear_cluster(seqs(spark, d))


@add("linclust_component", f"with recursive {LINEAR}, e as (select src, dst from edges union select dst, src from edges), reach as (select key as node, key as root from kept union select e.dst, r.root from reach r join e on e.src = r.node), comp as (select node, min(root) as component from reach group by 1), named as (select first_value(key) over (partition by component order by length(seq) desc, key) as rep, node from comp join kept on key = node) select n.rep, s.member from same s join named n on n.node = s.rep")
def _(spark, d):
    return workflows.linear_cluster(seqs(spark, d), mode="component")


@add("cluster_cascade")
def _(spark, d):
    return workflows.cascaded_cluster(seqs(spark, d))


@add("clusterupdate")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("header"), "lang").join(seqs(spark, d), "key")
    old = docs.where("lang != 'de'")
    clusters = clustering.by_hash(old.select("key", "seq")).select("rep", "member")
    return workflows.update_clusters(old, docs, clusters)


def _languages(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("item"), (F.expr("case lang when 'en' then 23 when 'fr' then 6 when 'de' then 7 else 2 end") + 100).cast("long").alias("taxid"))


@add("taxonomy")
def _(spark, d):
    return workflows.assign_taxa(queries(spark, d), seqs(spark, d), _languages(spark, d), taxa(spark, d))


# the hierarchy has three levels: one nation, one region, or the root
LCA = f"""{_aligned(f"{TAXA}, {CANDIDATES}", 'found', 'queries', 'seqs')}, v as (select a.key, x.taxid, x.parent from aligned a join documents d on d.doc_id = a.target join taxa x on x.taxid = 100 + case d.lang when 'en' then 23 when 'fr' then 6 when 'de' then 7 else 2 end),
  g as (select key, case when count(distinct taxid) = 1 then any_value(taxid) when count(distinct parent) = 1 then any_value(parent) else 1 end as taxid from v group by key)
  select q.key, coalesce(g.taxid, 0) as taxid, coalesce(rank, 'no rank') as rank, coalesce(name, 'unclassified') as name from queries q left join g using (key) left join taxa using (taxid)"""


@add("taxonomy_lca", LCA)
def _(spark, d):
    return workflows.assign_taxa(queries(spark, d), seqs(spark, d), _languages(spark, d), taxa(spark, d), "lca")


@add("multihitsearch")
def _(spark, d):
    own = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), (F.col("item_id") % 5).alias("set_id"))
    sets = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("set_id"))
    return workflows.search_sets(queries(spark, d), seqs(spark, d), own, sets)


@add("events_windowed", 'select date_trunc(\'hour\', ts) as start, date_trunc(\'hour\', ts) + interval 1 hour as "end", event_type, count(*) as n from events group by all')
def _(spark, d):
    return windowed_counts(table(spark, d, "events"))
