"""Composite operators: each is a lazy composition of the building blocks, cut through shared tables where steps are reused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyfold.functions import sequence
from manyfold.operators import alignment, candidates, clustering, hierarchy, hits, keyed, profile_search, profiles
from manyfold.operators.storage import materialise


@dataclass(frozen=True)
class SearchOptions:
    """Parameters of a search; the defaults suit letters of texts."""

    k: int = 12
    least_score: int = 40
    most_hits: int = 300
    most_evalue: float = 0.001
    least_identity: float = 0.0
    least_coverage: float = 0.0


def search(queries: DataFrame, targets: DataFrame, options: SearchOptions = SearchOptions(), residues: int | None = None) -> DataFrame:
    """Candidates on shared diagonals, aligned with gaps, best first: ``(key, pos, target, score, ...)``."""
    pairs = candidates.match_diagonals(queries, targets, options.k, most=options.most_hits, least_score=options.least_score)
    found = alignment.align(pairs, queries, targets, options.most_evalue, options.least_identity, options.least_coverage, residues=residues)
    return keyed.renumber(found.withColumn("pos", F.lit(0).cast("long")), [F.col("evalue"), F.desc("score"), "tlen", "target"])


def map_near(queries: DataFrame, targets: DataFrame, least_identity: float = 0.9, least_coverage: float = 0.95, k: int = 12) -> DataFrame:
    """Near-identical matches without gaps: ``(key, target, diagonal, identical, overlap, score, ...)``; coverage is the query's."""
    pairs = candidates.match_diagonals(queries, targets, k)
    scored = candidates.rescore_diagonals(pairs, queries, targets)
    return scored.where((F.col("identical") >= least_identity * F.col("overlap")) & (F.col("overlap") >= least_coverage * F.col("qlen")))


def linear_search(queries: DataFrame, index: DataFrame, targets: DataFrame, k: int = 12, per_sequence: int = 21, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Search against a prebuilt k-mer index, in time linear in both sides: k-mers, diagonal, alignment."""
    pairs = candidates.search_kmers(queries, index, k, per_sequence)
    scored = candidates.rescore_diagonals(pairs, queries, targets).where(F.col("score") >= options.least_score)
    return alignment.align(scored.select("key", "target", "score"), queries, targets, options.most_evalue, options.least_identity, options.least_coverage)


def reciprocal_search(left: DataFrame, right: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Reciprocal best hits of two sets of sequences: ``(key, target, score)``."""
    forward = materialise(search(left, right, options).select("key", "pos", "target", "score"))
    backward = materialise(search(right, left, options).select("key", "pos", "target", "score"))
    return hits.reciprocal_by_score(forward, backward)


def translated_search(queries: DataFrame, targets: DataFrame, least_codons: int = 30, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Nucleotide queries against amino acid targets: open reading frames are translated, searched, and put back on their contigs."""
    found = sequence.open_reading_frames(queries, least_codons)
    numbered = materialise(found.select(F.xxhash64("key", "frame", "start").alias("orf"), F.col("key").alias("contig"), "start", "stop", F.col("orf").alias("seq")))
    proteins = numbered.select(F.col("orf").alias("key"), sequence.translate_codons(F.col("seq")).alias("seq"))
    aligned = search(proteins, targets, options)
    places = numbered.select("orf", "contig", "start", "stop").join(queries.select(F.col("key").alias("contig"), F.length("seq").cast("long").alias("contig_length")), "contig")
    tripled = aligned.withColumns({"qstart": F.col("qstart") * 3, "qend": F.col("qend") * 3 + 2})
    return hits.to_contig(tripled, places)


def iterative_search(queries: DataFrame, targets: DataFrame, rounds: int = 2, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Search again with what was found: hits of hits are added by composition, without those known already."""
    known = materialise(search(queries, targets, options))
    step = known
    for _ in range(rounds - 1):
        reached = materialise(step.select(F.col("target").alias("key")).distinct().join(targets, "key"))
        onward = materialise(search(reached, targets, options))
        fresh = alignment.expand_alignments(step, onward).join(known.select("key", "target"), ["key", "target"], "left_anti")
        pairs = fresh.select("key", "target", F.lit(0).alias("score")).distinct()
        aligned = alignment.align(pairs, queries, targets, options.most_evalue, options.least_identity, options.least_coverage)
        step = materialise(aligned.withColumn("pos", F.lit(0).cast("long")).select(*known.columns))
        if step.isEmpty():
            break
        known = materialise(known.unionByName(step))
    return keyed.renumber(known, [F.col("evalue"), F.desc("score"), "tlen", "target"])


def search_in_slices(queries: DataFrame, targets: DataFrame, slices: int, options: SearchOptions = SearchOptions()) -> DataFrame:
    """As ``search``, target slice by slice, each cut through a shared table; the best hits over all slices stay."""
    found, residues = None, int(targets.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0])
    for i in range(slices):
        part = materialise(search(queries, targets.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == i), options, residues))
        found = part if found is None else found.unionByName(part)
    ranked = keyed.renumber(found, [F.col("evalue"), F.desc("score"), "tlen", "target"])
    return ranked.where(F.col("pos") <= options.most_hits)


# --- profiles


def profile_scores(found: DataFrame, queries: DataFrame, targets: DataFrame, background: DataFrame) -> DataFrame:
    """``(key, place, letter, score)`` of each query with its hits ``found``, aligned with gaps."""
    own = queries.select("key", F.col("key").alias("target"), F.lit(0).cast("long").alias("qstart"), (F.length("seq") - 1).cast("long").alias("qend"), F.lit(0).cast("long").alias("tstart")).where("qend >= 0")
    star = materialise(profiles.star_gapped(found, targets).unionByName(profiles.star_ungapped(own, queries, with_key=False)))
    return profiles.log_odds(profiles.frequencies(star, profiles.weights(star)), background)


def search_profiles(scores: DataFrame, targets: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Profiles in target sequences: candidates by the consensus, aligned by all scores; numbered from the best on."""
    top = scores.groupBy("key", "place").agg(F.min(F.struct((-F.col("score")).alias("s"), "letter"))["letter"].alias("letter"))
    seq = top.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "letter"))), lambda x: x["letter"]), "").alias("seq"))
    consensus = materialise(seq)
    pairs = candidates.match_diagonals(consensus, targets, options.k, most=options.most_hits, least_score=options.least_score)
    found = profile_search.align_profiles(pairs, materialise(profile_search.pack(scores)), targets, options.most_evalue, options.least_coverage)
    return keyed.renumber(found.withColumn("pos", F.lit(0).cast("long")), [F.col("evalue"), F.desc("score"), "tlen", "target"])


def search_target_profiles(queries: DataFrame, scores: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Sequences in target profiles: the profiles are searched in the sequences and the hits changed over."""
    found = profile_search.transposed(search_profiles(scores, queries, options).drop("pos"))
    return keyed.renumber(found.withColumn("pos", F.lit(0).cast("long")), [F.col("evalue"), F.desc("score"), "tlen", "target"])


def iterative_profile_search(queries: DataFrame, targets: DataFrame, background: DataFrame, rounds: int = 3, options: SearchOptions = SearchOptions()) -> DataFrame:
    """A search whose hits become each query's profile, which is searched again; targets found in an earlier round keep their alignment.

    A round's new hits are those of targets that the query had not reached; rounds end early when there is none.
    """
    known = materialise(search(queries, targets, options))
    for _ in range(rounds - 1):
        scores = materialise(profile_scores(known, queries, targets, background))
        again = search_profiles(scores, targets, options).join(known.select("key", "target"), ["key", "target"], "left_anti")
        fresh = materialise(again.select(*known.columns))
        if fresh.isEmpty():
            break
        known = materialise(known.unionByName(fresh))
    return keyed.renumber(known, [F.col("evalue"), F.desc("score"), "tlen", "target"])


def expand_profiles(first: DataFrame, second: DataFrame, queries: DataFrame, targets: DataFrame, background: DataFrame) -> DataFrame:
    """``(key, place, letter, score)``: alignments composed through their middle become the key's profile."""
    return profile_scores(alignment.expand_alignments(first, second), queries, targets, background)


# --- clustering


def linear_cluster(table: DataFrame, k: int = 12, per_sequence: int = 21, least_identity: float = 0.9, least_coverage: float = 0.8, mode: str = "set_cover") -> DataFrame:
    """``(rep, member)`` in linear time: equal sequences, then k-mer centres without gaps, clustered.

    mode: ``set_cover``, ``greedy`` or ``component``.
    """
    same = materialise(clustering.by_hash(table).select("rep", "member"))
    kept = materialise(table.join(same.select(F.col("rep").alias("key")).distinct(), "key", "left_semi"))
    pairs = candidates.match_kmers(kept, k, per_sequence, share=least_coverage, mode=0)
    scored = candidates.rescore_diagonals(pairs, kept, kept)
    covered = F.col("overlap") / F.greatest("qlen", "tlen")
    good = scored.where((F.col("identical") >= least_identity * F.col("overlap")) & (covered >= least_coverage))
    edges = materialise(good.select(F.col("key").alias("src"), F.col("target").alias("dst"), "score"))
    nodes = kept.select("key", F.length("seq").cast("long").alias("length"))
    chosen = {"set_cover": clustering.set_cover, "greedy": clustering.greedy_by_length, "component": clustering.by_component}[mode](nodes, edges)
    return clustering.merge_clusters(same, chosen)


def cascaded_cluster(table: DataFrame, k: int = 12, least_identity: float = 0.8, least_coverage: float = 0.8, steps: int = 3, least_score: int = 40, reassign: bool = False) -> DataFrame:
    """``(rep, member)``: a linear step, then searches among its representatives with gapped alignment, merged.

    Merged steps can leave members that don't meet the criteria with their last representative; ``reassign`` moves these.
    """
    clusters = materialise(linear_cluster(table, k, 21, least_identity, least_coverage))
    for step in range(steps):
        reps = materialise(table.join(clusters.select(F.col("rep").alias("key")).distinct(), "key", "left_semi"))
        pairs = candidates.match_kmers(reps, max(6, k - 2 * (step + 1)), 40 * (step + 1), share=least_coverage)
        # a diagonal has to score before the pair is aligned with gaps
        likely = candidates.rescore_diagonals(pairs, reps, reps).where(F.col("score") >= least_score).select("key", "target", "score")
        aligned = alignment.align(likely, reps, reps, least_identity=least_identity, least_coverage=least_coverage)
        edges = materialise(aligned.select(F.col("key").alias("src"), F.col("target").alias("dst"), "score"))
        nodes = reps.select("key", F.length("seq").cast("long").alias("length"))
        clusters = materialise(clustering.merge_clusters(clusters, clustering.set_cover(nodes, edges)))
    return reassigned(clusters, table, max(6, k - 2 * steps), least_identity, least_coverage) if reassign else clusters


def reassigned(clusters: DataFrame, table: DataFrame, k: int = 12, least_identity: float = 0.8, least_coverage: float = 0.8) -> DataFrame:
    """``(rep, member)``: members that aren't near their representative go to the one they match best, or are clustered by themselves."""
    own = clusters.where("rep != member").select(F.col("rep").alias("key"), F.col("member").alias("target"), F.lit(0).alias("score"))
    good = materialise(alignment.align(own, table, table, least_identity=least_identity, least_coverage=least_coverage).select(F.col("key").alias("rep"), F.col("target").alias("member")))
    kept = good.unionByName(clusters.where("rep = member"))
    loose = materialise(table.join(kept.select(F.col("member").alias("key")), "key", "left_anti"))
    reps = materialise(table.join(clusters.select(F.col("rep").alias("key")).distinct(), "key", "left_semi"))
    pairs = candidates.search_kmers(loose, candidates.kmer_index(reps, k, 40), k, 40)
    found = alignment.align(pairs.select("key", "target", "score"), loose, reps, least_identity=least_identity, least_coverage=least_coverage)
    moved = materialise(found.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "target"))["target"].alias("rep")).select("rep", F.col("key").alias("member")))
    rest = materialise(loose.join(moved.select(F.col("member").alias("key")), "key", "left_anti"))
    return kept.unionByName(moved).unionByName(linear_cluster(rest, k, 40, least_identity, least_coverage))


def align_and_cluster(pairs: DataFrame, table: DataFrame, least_identity: float = 0.8, least_coverage: float = 0.8, mode: str = "set_cover") -> DataFrame:
    """``(rep, member)``: candidate pairs aligned with gaps and clustered at once."""
    found = alignment.align(pairs, table, table, least_identity=least_identity, least_coverage=least_coverage)
    edges = materialise(found.where("key != target").select(F.col("key").alias("src"), F.col("target").alias("dst"), "score"))
    nodes = table.select("key", F.length("seq").cast("long").alias("length"))
    return {"set_cover": clustering.set_cover, "greedy": clustering.greedy_by_length, "component": clustering.by_component}[mode](nodes, edges)


def update_clusters(old: DataFrame, new: DataFrame, clusters: DataFrame, k: int = 12, per_sequence: int = 21, least_identity: float = 0.9, least_coverage: float = 0.8) -> DataFrame:
    """Clusters of ``new`` sequences ``(key, header, seq)`` that keep those of ``old`` ones: ``(rep, member)`` in new keys.

    Sequences are the same when their headers are.  Kept ones stay where they were (a cluster whose representative went is
    named by its smallest member left), new ones join the representative they match best, and the rest is clustered anew.
    """
    state = materialise(keyed.compare_headers(old.select("key", "header"), new.select("key", "header")))
    kept = state.where("state = 'kept'").select("old_key", "new_key")
    renamed = clusters.join(kept.select(F.col("old_key").alias("member"), F.col("new_key").alias("m")), "member").join(kept.select(F.col("old_key").alias("rep"), F.col("new_key").alias("r")), "rep", "left")
    named = renamed.groupBy("rep").agg(F.coalesce(F.max("r"), F.min("m")).alias("top"))
    base = materialise(renamed.join(named, "rep").select(F.col("top").alias("rep"), F.col("m").alias("member")))
    sequences = new.select("key", "seq")
    # repeated headers of the new table count as new sequences, so that every key gets a cluster
    fresh = materialise(sequences.join(base.select(F.col("member").alias("key")), "key", "left_anti"))
    reps = materialise(sequences.join(base.select(F.col("rep").alias("key")).distinct(), "key", "left_semi"))
    pairs = candidates.search_kmers(fresh, candidates.kmer_index(reps, k, per_sequence), k, per_sequence)
    scored = candidates.rescore_diagonals(pairs, fresh, reps)
    good = scored.where((F.col("identical") >= least_identity * F.col("overlap")) & (F.col("overlap") >= least_coverage * F.greatest("qlen", "tlen")))
    joined = materialise(good.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "target"))["target"].alias("rep")).select("rep", F.col("key").alias("member")))
    rest = materialise(fresh.join(joined.select(F.col("member").alias("key")), "key", "left_anti"))
    return base.unionByName(joined).unionByName(linear_cluster(rest, k, per_sequence, least_identity, least_coverage))


# --- hierarchy and sets


def assign_taxa(queries: DataFrame, targets: DataFrame, mapping: DataFrame, nodes: DataFrame, mode: str = "region", options: SearchOptions = SearchOptions()) -> DataFrame:
    """``(key, taxid, rank, name)`` of each query by its hits: ``region`` (hits of the best hit's region), or as ``assigned_taxa`` says."""
    found = materialise(search(queries, targets, options))
    if mode == "region":
        # the region of the best hit decides which others count, as they have to match it as well as the best one does
        again = alignment.align_top_region(found.select("key", "target", "score"), queries, targets, most_evalue=options.most_evalue)
        found = keyed.renumber(again.withColumn("pos", F.lit(0).cast("long")), [F.col("evalue"), F.desc("score"), "target"])
        mode = "lca"
    return assigned_taxa(found, queries, mapping, nodes, mode)


def assigned_taxa(found: DataFrame, queries: DataFrame, mapping: DataFrame, nodes: DataFrame, mode: str = "lca") -> DataFrame:
    """Taxa by the hits ``found``: ``lca`` of all, of the ``best`` ones, or ``majority``."""
    lined = hierarchy.lineages(nodes, hierarchy.closure(nodes))
    if mode == "majority":
        return hierarchy.majority_ancestor(found, mapping, lined, weight=hierarchy.vote_weight("minus_log_evalue", F.col("evalue")), keys=queries).select("key", "taxid", "rank", "name")
    used = keyed.beats_first(found, "score", "ge") if mode == "best" else found
    return hierarchy.lowest_common_ancestor(used, mapping, lined, queries)


def search_sets(queries: DataFrame, targets: DataFrame, query_sets: DataFrame, target_sets: DataFrame, mode: str = "multihit", options: SearchOptions = SearchOptions()) -> DataFrame:
    """Sets against sets: ``(set_id, target_set, value)``; sets are ``(key, set_id)`` of the sequences."""
    found = search(queries, targets, options).select("key", "pos", "target", "evalue")
    sized = target_sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    named = found.join(target_sets.select(F.col("key").alias("target"), "set_id"), "target")
    best = hits.best_per_set(named, sized).join(query_sets.select("key", F.col("set_id").alias("__q")), "key")
    own = query_sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    return hits.combine_sets(best.select(F.col("__q").alias("set_id"), F.col("set_id").alias("target_set"), "log_p"), own, sized.count(), mode)



def enrich_profiles(queries: DataFrame, targets: DataFrame, background: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """``(key, place, letter, score)``: each query's profile after an iterative search and the hits of its hits, aligned with gaps."""
    near = materialise(iterative_profile_search(queries, targets, background, 2, options))
    far = iterative_search(queries, targets, 2, options).join(near.select("key", "target"), ["key", "target"], "left_anti")
    return profile_scores(near.unionByName(far.select(*near.columns)), queries, targets, background)


def pick_consensus(clusters: DataFrame, table: DataFrame, background: DataFrame, k: int = 12) -> DataFrame:
    """``(rep, member)`` with each cluster under the member that scores best against its profile.

    Members are laid on the old representative along their best diagonal; those without a shared k-mer stay where they are.
    """
    own = clusters.where("rep != member").select(F.col("rep").alias("key"), F.col("member").alias("target"))
    words = candidates.lowest_kmers(table.join(clusters.select(F.col("member").alias("key")), "key", "left_semi"), k, 40)
    left = own.join(words.select("key", "kmer", F.col("place").alias("p")), "key")
    shared = left.join(words.select(F.col("key").alias("target"), "kmer", F.col("place").alias("r")), ["target", "kmer"])
    diagonals = shared.groupBy("key", "target", (F.col("p") - F.col("r")).alias("diagonal")).agg(F.count(F.lit(1)).alias("n")).groupBy("key", "target").agg(F.max(F.struct("n", "diagonal"))["diagonal"].alias("diagonal"))
    found = candidates.rescore_diagonals(diagonals, table, table)
    chosen = profiles.packed_profile(profiles.packed_star(found, table), background, "best").select(F.col("key").alias("rep"), F.col("member").alias("__new"))
    return clusters.join(chosen, "rep", "left").select(F.coalesce("__new", "rep").alias("rep"), "member")


def map_accessions(headers: DataFrame, accessions: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(key, taxid, rank, name)``: the lowest common ancestor of all accessions in an entry's header, which ``\\x01`` separates.

    accessions: ``(accession, taxid)``.
    """
    each = headers.select("key", F.explode(F.split("header", "\x01")).alias("h")).select("key", sequence.accession(F.col("h")).alias("accession"))
    lined = hierarchy.lineages(nodes, hierarchy.closure(nodes))
    mapping = accessions.select(F.col("accession").alias("item"), "taxid")
    return hierarchy.lowest_common_ancestor(each.withColumnRenamed("accession", "target"), mapping, lined, headers, ())


def aggregate_contigs(queries: DataFrame, targets: DataFrame, mapping: DataFrame, nodes: DataFrame, least_codons: int = 30, options: SearchOptions = SearchOptions()) -> DataFrame:
    """``(key, taxid, rank, name, ...)`` per contig: weighted majority of the taxa of its open reading frames' hits."""
    found = materialise(translated_search(queries, targets, least_codons, options).select("key", "target", "evalue"))
    lined = hierarchy.lineages(nodes, hierarchy.closure(nodes))
    return hierarchy.majority_ancestor(found, mapping, lined, weight=hierarchy.vote_weight("minus_log_evalue", F.col("evalue")), keys=queries)
