"""Queries of candidate generation, alignment, clustering and profiles over ``documents`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from manyfold.catalog import Catalog
from manyfold.catalog.tables import NUCL, QUERIES, SEQS, nucl, queries, seqs, table
from manyfold.operators import alignment, candidates, clustering, graph, profiles
from manyfold.operators.storage import materialise

catalog = Catalog()
add = catalog.add
K, M = 12, 10


def _words(name: str, source: str, k: int = K) -> str:
    return f"{name} as (select key, length(seq)::bigint as length, substr(seq, i::int, {k}) as kmer, min(i) - 1 as place from (select key, seq, unnest(range(1, length(seq) - {k - 2})) as i from {source}) group by 1, 2, 3)"


def _lowest(name: str, words: str, k: int = K, m: int = M) -> str:
    return f"{name} as (select * from {words} qualify row_number() over (partition by key order by {_rolling('kmer', k)}) <= {m})"


def _rolling(word: str, k: int) -> str:
    """SQL for the rolling hash: the sum of the letters times the powers of its base, modulo 2 ** 64."""
    terms = [f"ascii(substr({word}, {j + 1}, 1))::uhugeint * {pow(candidates.ROLL, k - 1 - j, 1 << 64)}::uhugeint" for j in range(k)]
    return f"({' + '.join(terms)}) % {1 << 64}::uhugeint"


CENTRES = "centres as (select kmer, key as centre, length as centre_length, place as centre_place from low qualify row_number() over (partition by kmer order by length desc, key, place) = 1)"
BEST = "select key, target, sum(n)::bigint as score, max([n, diagonal])[2] as diagonal from (select key, target, diagonal, count(*) as n from pairs group by 1, 2, 3) group by 1, 2"
MATCHED = f"{SEQS}, {_words('w', 'seqs')}, {_lowest('low', 'w')}, {CENTRES}, pairs as (select centre as key, key as target, centre_place - place as diagonal from low join centres using (kmer) where key <> centre and length / centre_length >= 0.5), matched as ({BEST})"


def _matched(spark, d):
    return candidates.match_kmers(seqs(spark, d), K, M, share=0.5)


@add("kmermatcher", f"with {MATCHED} select * from matched")
def _(spark, d):
    return _matched(spark, d)


@add("kmerindexdb", f"with {SEQS}, {_words('w', 'seqs')}, {_lowest('low', 'w')}, {CENTRES} select * from centres")
def _(spark, d):
    return candidates.kmer_index(seqs(spark, d), K, M)


@add("kmersearch", f"with {SEQS}, {QUERIES}, {_words('w', 'seqs')}, {_lowest('low', 'w')}, {CENTRES}, {_words('v', 'queries')}, {_lowest('own', 'v')}, pairs as (select key, centre as target, place - centre_place as diagonal from own join centres using (kmer)) {BEST}")
def _(spark, d):
    return candidates.search_kmers(queries(spark, d), candidates.kmer_index(seqs(spark, d), K, M), K, M)


def _diagonals(k: int, near: bool = False) -> str:
    """SQL for the diagonals with two words in common at least; ``near`` adds the words within one mismatch of a query's."""
    words = f"q0 as (select key, i - 1 as place, substr(seq, i::int, {k}) as kmer from (select key, seq, unnest(range(1, length(seq) - {k - 2})) as i from queries))"
    more = ", (select unnest(range(1, %d)) as j), (select unnest(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as c)" % (k + 1)
    q = f"select distinct key, place, substr(kmer, 1, j::int - 1) || c || substr(kmer, j::int + 1) as kmer from q0{more}" if near else "select * from q0"
    return f"{SEQS}, {QUERIES}, {_words('t', 'seqs', k)}, {words}, q as ({q}), h as (select q.key, t.key as target, q.place - t.place as diagonal, count(*) as n from q join t using (kmer) group by 1, 2, 3 having count(*) >= 2)"


DIAGONALS = _diagonals(10)
CUT = "greatest({d}, 0) as q0, greatest(-({d}), 0) as t0"
# best stretch: the running sum less its lowest value before
_SCORED = f""", c as (select h.key, target, diagonal, a.seq as q, b.seq as t, {CUT.format(d='diagonal')} from h join queries a on a.key = h.key join seqs b on b.key = target),
  e as (select key, target, diagonal, q0, t0, greatest(least(length(q) - q0, length(t) - t0), 0) as size, substr(q, q0::int + 1) as q, substr(t, t0::int + 1) as t from c),
  x as (select key, target, diagonal, unnest(range(0, size)) as i, unnest(list_transform(list_zip(string_split(substr(q, 1, size::int), ''), string_split(substr(t, 1, size::int), '')), lambda z: case when z[1] = z[2] then 2 else -1 end)) as s from e),
  r as (select *, sum(s) over (partition by key, target, diagonal order by i) as run from x), b as (select key, target, diagonal, run - least(0, coalesce(min(run) over (partition by key, target, diagonal order by i rows between unbounded preceding and 1 preceding), 0)) as score, s from r)"""
SCORED = DIAGONALS + _SCORED


def _best_diagonals(diagonals: str, least: int) -> str:
    """SQL for ``match_diagonals``: the best diagonal of a pair, and the 300 best targets of a query."""
    return f"{diagonals}{_SCORED}, m as (select key, target, diagonal, max(score)::bigint as score from b group by 1, 2, 3), o as (select * from m qualify row_number() over (partition by key, target order by score desc, diagonal desc) = 1), found as (select key, target, score, diagonal from o where score >= {least} qualify row_number() over (partition by key order by score desc, target) <= 300)"


def _stretches(pairs: str, first: str, second: str) -> str:
    """SQL for ``rescore_diagonals`` over the table ``pairs``, as a table ``rescored``."""
    return f"""rc as (select p.key, target, diagonal, a.seq as q, b.seq as t, {CUT.format(d='diagonal')} from {pairs} p join {first} a on a.key = p.key join {second} b on b.key = target),
  re as (select key, target, diagonal, q0, t0, length(q) as qlen, length(t) as tlen, greatest(least(length(q) - q0, length(t) - t0), 0) as size, substr(q, q0::int + 1) as q, substr(t, t0::int + 1) as t from rc),
  rx as (select key, target, diagonal, unnest(range(0, size)) as i, unnest(list_transform(list_zip(string_split(substr(q, 1, size::int), ''), string_split(substr(t, 1, size::int), '')), lambda z: case when z[1] = z[2] then 2 else -1 end)) as s from re),
  rr as (select *, sum(s) over (partition by key, target, diagonal order by i) as run from rx),
  rl as (select *, least(0, coalesce(min(run) over (partition by key, target, diagonal order by i rows between unbounded preceding and 1 preceding), 0)) as low from rr),
  top as (select key, target, diagonal, i as stop, low, (run - low)::bigint as score from rl qualify row_number() over (partition by key, target, diagonal order by run - low desc, i) = 1),
  whole as (select key, target, diagonal, count(*) filter (s > 0) as identical, count(*) as overlap, sum(s)::bigint as whole from rr group by all),
  began as (select t.key, t.target, t.diagonal, coalesce(max(rr.i) + 1, 0) as start from top t left join rr on rr.key = t.key and rr.target = t.target and rr.diagonal = t.diagonal and rr.i < t.stop and rr.run = t.low group by all),
  rescored as (select key, target, diagonal, identical, overlap, whole, score, q0 + case when score > 0 then start else -1 end as qstart, q0 + case when score > 0 then stop else -1 end as qend, qlen::bigint as qlen, t0 + case when score > 0 then start else -1 end as tstart, t0 + case when score > 0 then stop else -1 end as tend, tlen::bigint as tlen
    from whole join top using (key, target, diagonal) join began using (key, target, diagonal) join (select key, target, diagonal, q0, t0, qlen, tlen from re) using (key, target, diagonal))"""


@add("prefilter_diag", f"with {DIAGONALS} select key, target, diagonal, n from h")
def _(spark, d):
    return candidates.shared_diagonals(queries(spark, d), seqs(spark, d), 10)


@add("prefilter_exact", f"with {_best_diagonals(DIAGONALS, 15)} select * from found")
def _(spark, d):
    return candidates.match_diagonals(queries(spark, d), seqs(spark, d), 10)


@add("rescorediagonal", f"with {SCORED}, same as (select key, target, diagonal, count(*) filter (s > 0) as identical, count(*) as overlap, sum(s)::bigint as whole, max(score)::bigint as score from b group by 1, 2, 3) select * from same")
def _(spark, d):
    found = candidates.shared_diagonals(queries(spark, d), seqs(spark, d), 10)
    return candidates.rescore_diagonals(found, queries(spark, d), seqs(spark, d)).select("key", "target", "diagonal", "identical", "overlap", "whole", "score")


@add("prefilter_similar", f"with {_best_diagonals(_diagonals(10, near=True), 15)} select * from found")
def _(spark, d):
    return candidates.match_diagonals(queries(spark, d), seqs(spark, d), 10, alphabet="ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@add("ungapped_topn")
def _(spark, d):
    return candidates.scan_ungapped(queries(spark, d), seqs(spark, d), 30, 10, share=0.05)


@add("clusthash", f"with {SEQS} select min(key) over (partition by seq) as rep, key as member, 1.0::double as identity from seqs")
def _(spark, d):
    return clustering.by_hash(seqs(spark, d))


# what a round's representative doesn't take meets the smallest key left in its bucket
REDUCED = f"""with recursive {SEQS}, b as (select key, seq, translate(seq, 'AEIOUBDGPTKCQSZVFWMNRL', 'AAAAABBBBBKKKSSVVVMMRR') as bucket from seqs),
  r as (select key, seq, bucket, first_value(key) over w as rep, first_value(seq) over w as top from b window w as (partition by bucket order by key)),
  step as (select key, seq, bucket, rep, case when seq = top then 1.0 else len(list_filter(list_zip(string_split(seq, ''), string_split(top, '')), lambda z: z[1] = z[2])) / length(seq) end::double as identity from r
    union all select key, seq, bucket, rep, case when seq = top then 1.0 else len(list_filter(list_zip(string_split(seq, ''), string_split(top, '')), lambda z: z[1] = z[2])) / length(seq) end::double from
      (select key, seq, bucket, first_value(key) over w as rep, first_value(seq) over w as top from step where identity < 0.9 window w as (partition by bucket order by key)))
  select rep, key as member, identity from step where identity >= 0.9"""


@add("clusthash_reduced", REDUCED)
def _(spark, d):
    return clustering.by_hash(seqs(spark, d), 0.9, ("AEIOUBDGPTKCQSZVFWMNRL", "AAAAABBBBBKKKSSVVVMMRR"))


# --- alignment


def _aligned(before: str, pairs: str, first: str, second: str) -> str:
    """SQL for gapped local alignment of ``pairs`` (key, target), as a table ``aligned`` with score and ends: a step for each query letter.

    A cell keeps its best score so far and the query place where that was first reached.
    """
    return f"""with recursive {before}, p as (select distinct d.key, d.target, a.seq as q, b.seq as t from {pairs} d join {first} a on a.key = d.key join {second} b on b.key = d.target where a.seq <> '' and b.seq <> ''),
  l as (select key, target, q, unnest(range(1, length(t) + 1))::int as j, unnest(string_split(t, '')) as c from p),
  cell(key, target, j, i, h, down, top, place) using key (key, target, j) as (
    select key, target, j, 0, 0, -1000000, 0, 0 from l
    union
    select key, target, j, i, greatest(r, across), down, greatest(top, r, across), case when greatest(r, across) > top then i else place end from
      (select *, coalesce(max(r + 2 * j) over (partition by key, target order by j rows between unbounded preceding and 1 preceding) - 5 - 2 * (j - 1), -1000000) as across from
        (select *, greatest(diag + case when c = substr(q, i, 1) then 2 else -1 end, down, 0) as r from
          (select s.key, s.target, s.j, s.i + 1 as i, l.q, l.c, s.top, s.place, lag(s.h, 1, 0) over (partition by s.key, s.target order by s.j) as diag, greatest(s.h - 5, s.down - 2) as down
            from cell s join l on l.key = s.key and l.target = s.target and l.j = s.j where s.i < length(l.q))))),
  aligned as (select key, target, top::bigint as score, place::bigint - 1 as qend, j::bigint - 1 as tend from cell where top > 0 qualify row_number() over (partition by key, target order by top desc, place, j) = 1)"""


CANDIDATES = _best_diagonals(_diagonals(12), 40)
BITS = "floor((0.62092274139392822363 * score - ln(0.35177597988201619872)) / ln(2) + 0.5)::bigint"


@add("align", f"{_aligned(CANDIDATES, 'found', 'queries', 'seqs')} select key, target, score, qend, tend, {BITS} as bits from aligned")
def _(spark, d):
    return alignment.align(_candidates(spark, d), queries(spark, d), seqs(spark, d)).select("key", "target", "score", "qend", "tend", "bits")


def _candidates(spark, d):
    return candidates.match_diagonals(queries(spark, d), seqs(spark, d), 12, least_score=40)


@add("align_sw")
def _(spark, d):
    found = alignment.align(_candidates(spark, d), queries(spark, d), seqs(spark, d))
    return found.withColumns({c: F.round(c, 6) for c in ("identity", "qcov", "tcov")})


@add("align_accept_reject")
def _(spark, d):
    return alignment.align(_candidates(spark, d), queries(spark, d), seqs(spark, d), least_coverage=0.1, most_accepted=5, most_rejected=3).select("key", "target", "score", "cigar")


@add("expandaln")
def _(spark, d):
    first = materialise(alignment.align(_candidates(spark, d), queries(spark, d), seqs(spark, d)))
    # only what the first step reached is aligned onward
    reached = first.select(F.col("target").alias("key")).distinct()
    second = alignment.align(_matched(spark, d).join(reached, "key", "left_semi"), seqs(spark, d), seqs(spark, d))
    return alignment.expand_alignments(first, second)


# --- clustering


EDGES = f"{MATCHED}, edges as (select key as src, target as dst, score from matched where score >= 5)"


def _edges(spark, d):
    return _matched(spark, d).where("score >= 5").select(F.col("key").alias("src"), F.col("target").alias("dst"), "score")


def _nodes(spark, d):
    return seqs(spark, d).select("key", F.length("seq").cast("long").alias("length"))


# labels are handed on until nothing changes; depth grows with the longest shortest path
COMPONENTS = f"with recursive {EDGES}, e as (select src, dst from edges union select dst, src from edges), reach as (select key as node, key as root from seqs union select e.dst, r.root from reach r join e on e.src = r.node), comp as (select node, min(root) as component from reach group by 1)"


@add("clust_cc", COMPONENTS + " select arg_min(s.key, [-length(s.seq), s.key]) over (partition by component) as rep, s.key as member from comp join seqs s on s.key = comp.node")
def _(spark, d):
    return clustering.by_component(_nodes(spark, d), _edges(spark, d))


@add("connected_components", COMPONENTS + " select node, component from comp where node in (select src from e)")
def _(spark, d):
    return graph.connected_components(_edges(spark, d))


# nodes one after another, longest first: who isn't taken takes its free neighbours; the state is the list of owners
GREEDY = f"""with recursive {EDGES}, n as (select key, row_number() over (order by length(seq) desc, key) as i from seqs), l as (select distinct a.i as i, b.i as j from edges join n a on a.key = src join n b on b.key = dst where src <> dst),
  adj as (select n.i, coalesce(list(l.j) filter (l.j is not null), []) as js from n left join l on l.i = n.i group by 1),
  walk as (select 0::bigint as i, list_transform(range(0, (select count(*) from n)), lambda x: 0::bigint) as owner
    union all select w.i + 1, case when w.owner[w.i + 1] = 0 then list_transform(w.owner, lambda o, j: case when j = w.i + 1 or o = 0 and list_contains(adj.js, j) then w.i + 1 else o end) else w.owner end from walk w join adj on adj.i = w.i + 1),
  last as (select i, unnest(owner) as o, unnest(range(1, len(owner) + 1)) as j from walk where i = (select count(*) from n))
  select r.key as rep, m.key as member from last join n r on r.i = o join n m on m.i = j"""


@add("clust_greedy", GREEDY)
def _(spark, d):
    return clustering.greedy_by_length(_nodes(spark, d), _edges(spark, d))


def _cover(edges: str, nodes: str = "seqs") -> str:
    """SQL for ``set_cover`` over ``edges`` (src, dst, score) and ``nodes``: one node a step; the state is the list of what is covered."""
    return f"""with recursive {edges}, n as (select key, row_number() over (order by length(seq) desc, key) as i from {nodes}),
  l as (select i, j, max(score) as score from (select a.i as i, b.i as j, score from edges join n a on a.key = src join n b on b.key = dst where src <> dst union all select b.i, a.i, score from edges join n a on a.key = src join n b on b.key = dst where src <> dst) group by 1, 2),
  adj as (select i, list_append(list(j), i) as js from l group by 1), every as (select list({{'i': i, 'js': js}} order by i) as a from adj),
  walk as (select 0::bigint as round, 0::bigint as taken, []::bigint[] as held, (select count(*) from adj) as rest
    union all select round + 1, best.i, list_distinct(list_concat(held, best.js)), rest - len(list_filter(best.js, lambda x: not list_contains(held, x))) from
      (select w.*, list_transform(a, lambda e: {{'n': -len(list_filter(e.js, lambda x: not list_contains(w.held, x))), 'i': e.i, 'js': e.js}}) as c from walk w, every where rest > 0), lateral (select list_min(c) as best)),
  reps as (select taken as i, round from walk where round > 0 union all select i, 0 from n where i not in (select i from adj)),
  near as (select l.j, l.i, row_number() over (partition by l.j order by l.score desc, r.round) as k from l join reps r on r.i = l.i where l.j not in (select i from reps)),
  final as (select i as rep, i as member from reps union all select i, j from near where k = 1),
  covered as (select r.key as rep, m.key as member from final join n r on r.i = rep join n m on m.i = member)"""


@add("clust_setcover", _cover(EDGES) + " select * from covered")
def _(spark, d):
    return clustering.set_cover(_nodes(spark, d), _edges(spark, d))


@add("mergeclusters", "with a as (select min(doc_id) over (partition by text) as rep, doc_id as member from documents), b as (select min(doc_id) over (partition by lower(left(text, 0)) || source || lang) as rep, doc_id as member from documents) select b.rep, a.member from a join b on b.member = a.rep")
def _(spark, d):
    docs = table(spark, d, "documents")
    texts = docs.join(docs.groupBy("text").agg(F.min("doc_id").alias("rep")), "text").select("rep", F.col("doc_id").alias("member"))
    groups = docs.join(docs.groupBy("source", "lang").agg(F.min("doc_id").alias("rep")), ["source", "lang"]).select("rep", F.col("doc_id").alias("member"))
    return clustering.merge_clusters(texts, groups)


# the set with most clusters takes those that share enough with it; the state is the sets left
SETS = f"""with recursive {SEQS}, held as (select distinct source as s, (select min(b.key) from seqs b where b.seq = a.seq) as c from seqs a join documents on doc_id = a.key),
  size as (select s, count(*) as n, (select count(*) from documents where source = s) as m from held group by 1),
  common as (select a.s as rep, b.s as member, count(*) as shared from held a join held b using (c) group by 1, 2),
  every as (select list({{'n': -n, 'm': m, 's': s}} order by s) as a from size),
  walk as (select ''::varchar as rep, (select list(s) from size) as rest, []::varchar[] as taken
    union all select b.s, list_filter(rest, lambda x: not list_contains(b.got, x)), list_filter(rest, lambda x: list_contains(b.got, x))
      from walk, lateral (select list_min(list_filter(a, lambda e: list_contains(rest, e.s))).s as s from every) t, lateral (select t.s, list(member) as got from common join size z on z.s = member where common.rep = t.s and shared / z.n >= 0.1) b where len(rest) > 0)
  select w.rep, w.member, shared, shared / n as share from (select rep, unnest(taken) as member from walk) w join common c on c.rep = w.rep and c.member = w.member join size on s = w.member"""


@add("proteomecluster", SETS)
def _(spark, d):
    members = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("set_id"))
    return clustering.cover_sets(members, clustering.by_hash(seqs(spark, d)).select("rep", "member"), 0.1)


@add("createclusearchdb", f"with {EDGES} select distinct key, seq from seqs where key in (select src from edges)")
def _(spark, d):
    reps = _edges(spark, d).select("src").distinct()
    return seqs(spark, d).join(reps, F.col("key") == F.col("src"), "left_semi")


# --- profiles


def _laid(spark, d):
    """Hits without gaps of which profiles are made."""
    return candidates.rescore_diagonals(_matched(spark, d).where("score >= 5"), seqs(spark, d), seqs(spark, d)).where("score >= 30")


def _star(spark, d):
    return profiles.star_ungapped(_laid(spark, d), seqs(spark, d))


def _packed(spark, d, give, background):
    return profiles.packed_profile(profiles.packed_star(_laid(spark, d), seqs(spark, d)), background, give)


STAR = f"""{MATCHED}, strong as (select * from matched where score >= 5), {_stretches('strong', 'seqs', 'seqs')}, used as (select * from rescored where score >= 30),
  laid as (select u.key, target as member, unnest(range(qstart, qend + 1)) as place, unnest(string_split(substr(seq, tstart::int + 1, (qend - qstart + 1)::int), '')) as letter from used u join seqs s on s.key = target),
  own as (select key, key as member, unnest(range(0, length(seq))) as place, unnest(string_split(seq, '')) as letter from seqs where key in (select key from used) and length(seq) > 0),
  star as (select * from laid union all select * from own), counts as (select key, place, letter, count(*) as n from star group by all)"""
SHARES = f"""{STAR}, kinds as (select key, place, count(*) as kinds from counts group by all), sizes as (select key, member, count(*) as size from star group by all),
  raw as (select key, member, sum(1 / (n * kinds * (size + 30))) as w from star join counts using (key, place, letter) join kinds using (key, place) join sizes using (key, member) group by all),
  weights as (select key, member, w / sum(w) over (partition by key) as weight from raw),
  summed as (select key, place, letter, sum(weight) as w from star join weights using (key, member) group by all),
  shares as (select key, place, letter, w / sum(w) over (partition by key, place) as share from summed), neff as (select key, place, exp(-sum(share * ln(share))) as neff from shares group by all)"""
ODDS = f"""{SHARES}, background as (select letter, count(*) / sum(count(*)) over () as p from (select unnest(string_split(seq, '')) as letter from seqs where seq <> '') group by 1),
  odds as (select key, place, letter, greatest(least(round(log2(((1 - tau) * coalesce(share, 0) + tau * p) / p) * 8), 127), -128)::int as score
    from (select key, place, least(1.0, 1.1 / (1 + neff / 4.1)) as tau from neff) cross join background left join shares using (key, place, letter))"""


def _background(spark, d):
    counted = candidates.kmers(seqs(spark, d), 1).groupBy(F.col("kmer").alias("letter")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("t"))
    return counted.join(F.broadcast(total), F.lit(True)).select("letter", (F.col("n") / F.col("t")).alias("share"))


@add("profile_counts", f"with {STAR} select * from counts")
def _(spark, d):
    return profiles.counts(_star(spark, d))


@add("profile2consensus", f"with {STAR}, most as (select key, place, letter from counts qualify row_number() over (partition by key, place order by n desc, letter) = 1) select key, string_agg(letter, '' order by place) as seq from most group by key")
def _(spark, d):
    return profiles.consensus(profiles.counts(_star(spark, d)))


@add("profile2neff", f"with {SHARES} select key, place, round(neff, 6) as neff from neff")
def _(spark, d):
    none = spark.createDataFrame([], "letter string, share double")
    return _packed(spark, d, "neff", none).withColumn("neff", F.round("neff", 6))


@add("result2profile", f"with {ODDS} select * from odds")
def _(spark, d):
    background = materialise(_background(spark, d))
    return profiles.spread_scores(_packed(spark, d, "scores", background), background)


@add("pickrepprofile", f"with {ODDS}, scored as (select key, member, sum(score) as score, count(*) as covered from star join odds using (key, place, letter) group by all) select key, member from scored qualify row_number() over (partition by key order by score desc, covered desc, key <> member, member) = 1")
def _(spark, d):
    return _packed(spark, d, "best", materialise(_background(spark, d)))


@add("result2msa", f"with {STAR} select key, member, repeat('-', min(place)::int) || string_agg(letter, '' order by place) || repeat('-', (length(any_value(seq)) - 1 - max(place))::int) as row from star join seqs using (key) group by key, member")
def _(spark, d):
    return profiles.msa_rows(_star(spark, d), seqs(spark, d))


FILTERED = f"""{STAR}, told as (select key, member, count(*) / any_value(length(seq)) as coverage, count(*) filter (letter = substr(seq, place::int + 1, 1)) / count(*) as identity, string_agg(place || letter, ' ' order by place) as same from star join seqs using (key) group by key, member),
  good as (select * from told where coverage >= 0.3 and identity >= 0.5 and identity <= 1 or key = member) select key, member, coverage, identity from good qualify row_number() over (partition by key, same order by key <> member, member) = 1"""


@add("filterresult", f"with {FILTERED}")
def _(spark, d):
    return profiles.filter_members(_star(spark, d), 0.3, 0.5)


NUCLEOTIDE = f"{NUCL}, {_words('w', 'nucl', 17)}, {_lowest('low', 'w', 17, 20)}, {CENTRES}, pairs as (select centre as key, key as target, centre_place - place as diagonal from low join centres using (kmer) where key <> centre)"


@add("search_nucleotide", f"with {NUCLEOTIDE} {BEST}")
def _(spark, d):
    return candidates.match_kmers(nucl(spark, d), 17, 20)




@add("gapped_topn")
def _(spark, d):
    return alignment.scan_gapped(queries(spark, d), seqs(spark, d), 0.3)


@add("transitivealign")
def _(spark, d):
    return alignment.transitive(alignment.align(_candidates(spark, d), queries(spark, d), seqs(spark, d)))


@add("lcaalign")
def _(spark, d):
    return alignment.align_top_region(_candidates(spark, d), queries(spark, d), seqs(spark, d)).select("key", "target", "score", "qstart", "qend", "cigar")


@add("alignbykmer")
def _(spark, d):
    return alignment.align_by_kmers(_candidates(spark, d), queries(spark, d), seqs(spark, d), 6)


@add("alignall")
def _(spark, d):
    return alignment.align_members(_candidates(spark, d), seqs(spark, d)).select("entry", "key", "target", "score", "cigar")
