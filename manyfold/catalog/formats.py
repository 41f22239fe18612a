"""Queries of readers, writers and stored tables: each writes a text form or a table into the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyfold.catalog import Catalog
from manyfold.catalog.reports import LINEAR
from manyfold.catalog.similarity import CENTRES, K, M, ODDS, STAR, _background, _cover, _laid, _lowest, _packed, _star, _words
from manyfold.catalog.tables import NUCL, QUERIES, SEQS, TAXA, nucl, queries, seqs, table, taxa
from manyfold.operators import alignment, candidates, external, profile_search, profiles
from manyfold.operators.storage import materialise, shared_dir
from manyfold.plans import files, workflows
from manyfold.sources import readers, tables, writers

catalog = Catalog()
add = catalog.add


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _written(lines: DataFrame) -> str:
    """The folder of a text form that was written from the column ``value``."""
    path = _folder(lines.sparkSession)
    writers.write_text(lines, path)
    return path


def _suppliers(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")


SUPPLIERS = "select s_suppkey, s_name, s_nationkey from supplier"


# --- sequence files


@add("createdb", f"with {SEQS} select source || '/' || doc_id || ' ' || lang as header, seq, source || '/' || doc_id as accession from seqs join documents on doc_id = key")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.concat_ws(" ", F.concat_ws("/", "source", "doc_id"), "lang").alias("header"))
    wrapped = seqs(spark, d).withColumn("seq", F.regexp_replace("seq", "(.{60})", "$1\n"))
    read = readers.read_fasta(spark, _written(writers.fasta(wrapped, docs)))
    return read.headers.join(read.sequences, "key").join(read.lookup, "key").select("header", "seq", "accession")


@add("createdb_fastq", f"with {NUCL} select 'read' || key as header, seq from nucl where seq <> ''")
def _(spark, d):
    lines = nucl(spark, d).where("seq != ''").select(F.concat_ws("\n", F.concat(F.lit("@read"), F.col("key").cast("string")), "seq", F.lit("+"), F.regexp_replace("seq", ".", "I")).alias("value"))
    read = readers.read_fastq(spark, _written(lines))
    return read.headers.join(read.sequences, "key").select("header", "seq")


@add("tsv2db", "select l_orderkey::varchar as key, l_partkey::varchar as target, l_linenumber::varchar as line from lineitem")
def _(spark, d):
    lines = table(spark, d, "lineitem").select(F.concat_ws("\t", "l_orderkey", "l_partkey", "l_linenumber").alias("value"))
    return readers.read_keyed_tsv(spark, _written(lines), ["target", "line"]).select("key", "target", "line")


def _archive(spark, d) -> str:
    path = _folder(spark)
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("name"), "p_name")
    writers.write_tar(parts, path, "name", "p_name")
    return path


@add("db2tar", "select count(*) as members, sum(length(p_name))::bigint as letters from part")
def _(spark, d):
    return readers.read_tar(spark, _archive(spark, d)).agg(F.count(F.lit(1)).alias("members"), F.sum(F.length(F.decode("content", "utf-8"))).alias("letters"))


@add("tar2db", "select 'part/' || p_partkey as name, p_name as content from part where p_partkey % 2 = 1")
def _(spark, d):
    return readers.read_tar(spark, _archive(spark, d), include="[13579]$").select("name", F.decode("content", "utf-8").alias("content"))


FAMILIES = "select r_name, n_name, row_number() over (partition by r_regionkey order by n_nationkey) as pos, rpad(n_name, 20, '-') as row from nation join region on n_regionkey = r_regionkey"


def _stockholm(spark, d) -> str:
    named = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat_ws(" ", F.replace("n_name", F.lit(" "), F.lit("_")), F.rpad(F.replace("n_name", F.lit(" "), F.lit("_")), 20, "."))
    rows = named.groupBy("r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("v")))), lambda x: x["v"]), "\n").alias("v"))
    head = F.concat(F.lit("# STOCKHOLM 1.0\n#=GF AC "), F.replace("r_name", F.lit(" "), F.lit("_")), F.lit("\n"))
    return _written(rows.select(F.concat(head, "v", F.lit("\n//")).alias("value")))


@add("convertmsa", f"select case when pos = 1 then replace(r_name, ' ', '_') || ' ' else '' end || replace(n_name, ' ', '_') as name, pos, replace(row, ' ', '_') as row from ({FAMILIES})")
def _(spark, d):
    return readers.read_stockholm(spark, _stockholm(spark, d)).select("name", "pos", "row")


@add("msa2result", "select replace(n_name, ' ', '_') as seq from nation")
def _(spark, d):
    return readers.split_msa(readers.read_stockholm(spark, _stockholm(spark, d)))[0].select("seq")


@add("msa2profile", f"select place, letter, count(*) as n from (select r_name, n_name, pos, unnest(range(0, 20)) as place, unnest(string_split(replace(row, ' ', '_'), '')) as letter from ({FAMILIES})) a where letter <> '-' and place < (select length(n_name) from ({FAMILIES}) b where b.r_name = a.r_name and pos = 1) group by place, letter")
def _(spark, d):
    star = readers.msa_to_star(readers.read_stockholm(spark, _stockholm(spark, d)))
    return profiles.counts(star).groupBy("place", "letter").agg(F.sum("n").alias("n"))


@add("convertkb", "select 'P' || p_partkey as \"AC\", p_name || ' ' || p_type as \"DE\", upper(replace(p_name, ' ', '')) as \"SEQ\" from part")
def _(spark, d):
    letters = F.regexp_replace(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), "(.{10})", "$1 ")
    entry = F.concat_ws("\n", F.concat(F.lit("ID   P"), F.col("p_partkey").cast("string")), F.concat(F.lit("AC   P"), F.col("p_partkey").cast("string")), F.concat(F.lit("DE   "), "p_name"), F.concat(F.lit("DE   "), "p_type"), F.lit("SQ   SEQUENCE"), F.concat(F.lit("     "), letters), F.lit("//"))
    return readers.read_uniprot(spark, _written(table(spark, d, "part").select(entry.alias("value"))), ("AC", "DE", "SEQ")).select("AC", "DE", "SEQ")


MODEL = "select r_regionkey * 5 + p as place, l as letter, case when l = 'A' then 0.5 when l = 'C' then 0.25 when l = 'D' then 0.0 else 0.125 end::double as share, r_name as name from region, (select unnest(range(0, 5)) as p), (select unnest(['A', 'C', 'D', 'E']) as l)"


@add("convertprofiledb", f"select replace(name, ' ', '_') as name, place % 5 as place, letter, share from ({MODEL})")
def _(spark, d):
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(F.lit("A "), i.cast("string"), F.lit(" 1000 2000 * 3000 x"))), "\n")
    entry = F.concat_ws("\n", F.concat(F.lit("NAME "), F.replace("r_name", F.lit(" "), F.lit("_"))), F.lit("HMM A C D E"), body, F.lit("//"))
    return readers.read_hmm(spark, _written(table(spark, d, "region").select(entry.alias("value")))).select("name", "place", "letter", "share")


# --- regions, hierarchies, archives


def _regions(spark, d):
    part = F.concat_ws("\t", F.concat(F.lit("s"), F.col("doc_id").cast("string")), F.lit("x"), F.when(F.col("doc_id") % 2 == 0, "gene").otherwise("CDS"), F.lit("2"), F.lit("9"), F.lit("."), F.when(F.col("doc_id") % 3 == 0, "-").otherwise("+"), F.lit("."), F.lit("ID=1"))
    return readers.read_gff(spark, _written(table(spark, d, "documents").select(part.alias("value"))), ["gene"])


@add("gff2db", f"with {NUCL} select key, 's' || key || '_2_9' as accession, case when key % 3 = 0 then reverse(translate(substr(seq, 2, 8), 'ACGT', 'TGCA')) else substr(seq, 2, 8) end as seq from nucl where key % 2 = 0")
def _(spark, d):
    sequences = nucl(spark, d)
    return readers.gff_regions(_regions(spark, d), sequences, sequences.select("key", F.concat(F.lit("s"), F.col("key").cast("string")).alias("accession")))


@add("createbintaxonomy", f"with {TAXA} select * from taxa")
def _(spark, d):
    path = _folder(spark)
    writers.taxonomy_dump(taxa(spark, d), path)
    return readers.read_taxonomy(spark, f"{path}/nodes", f"{path}/names")


@add("createdmptaxonomy", f"with {TAXA} select taxid || chr(9) || '|' || chr(9) || parent || chr(9) || '|' || chr(9) || rank || chr(9) || '|' as value from taxa")
def _(spark, d):
    path = _folder(spark)
    writers.taxonomy_dump(taxa(spark, d), path)
    return spark.read.text(f"{path}/nodes")


@add("createbintaxmapping", "select c_custkey as item, c_nationkey + 100 as taxid from customer")
def _(spark, d):
    name = f"mapping_{uuid.uuid4().hex}"
    tables.save_index(table(spark, d, "customer").select(F.col("c_custkey").alias("item"), (F.col("c_nationkey") + 100).cast("long").alias("taxid")), name, "item", 8)
    return spark.table(name)


@add("createtaxdb", f"with {TAXA} select c_custkey as key, t.taxid, t.rank, t.name from customer join taxa t on t.taxid = c_nationkey + 100")
def _(spark, d):
    path = _folder(spark)
    writers.taxonomy_dump(taxa(spark, d), path)
    lines = table(spark, d, "customer").select(F.concat_ws("\t", F.concat(F.lit("c"), F.col("c_custkey").cast("string")), (F.col("c_nationkey") + 100).cast("string")).alias("value"))
    lookup = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("accession"))
    return files.taxonomy_tables(spark, lookup, _written(lines), f"{path}/nodes", f"{path}/names")


NR = f"with {TAXA}, e as (select c_custkey as key, c_nationkey + 100 as a, s_nationkey + 100 as b from customer join supplier on s_suppkey = c_custkey % 50 + 1), x as (select key, case when a = b then a when ta.parent = tb.parent then ta.parent else 1 end as taxid from e join taxa ta on ta.taxid = a join taxa tb on tb.taxid = b) select key, taxid, rank, name from x join taxa using (taxid)"


@add("nrtotaxmapping", NR)
def _(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("c_custkey") % 50 + 1)
    header = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit(" some name\x01N"), F.col("s_nationkey").cast("string"), F.lit(" other name"))
    accessions = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("accession"), (F.col("n_nationkey") + 100).cast("long").alias("taxid"))
    return workflows.map_accessions(joined.select(F.col("c_custkey").alias("key"), header.alias("header")), accessions, taxa(spark, d))


@add("unpackdb", "select n_nationkey as key, n_name as value from nation")
def _(spark, d):
    path = _folder(spark)
    writers.unpack(table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name"), path, "key", "n_name")
    return spark.read.text(path).select("key", "value")


# --- stored tables


def _stored(spark, d, compressed: bool = True) -> str:
    path = _folder(spark)
    tables.save(_suppliers(spark, d), path, compressed)
    return path


@add("compress", SUPPLIERS)
def _(spark, d):
    return spark.read.parquet(_stored(spark, d))


@add("decompress", SUPPLIERS)
def _(spark, d):
    path = _folder(spark)
    tables.save(spark.read.parquet(_stored(spark, d)), path, compressed=False)
    return spark.read.parquet(path)


@add("cpdb", SUPPLIERS)
def _(spark, d):
    path = _stored(spark, d)
    tables.copy(spark, path, f"{path}-copy")
    return spark.read.parquet(f"{path}-copy")


@add("mvdb", SUPPLIERS)
def _(spark, d):
    path = _stored(spark, d)
    tables.move(spark, path, f"{path}-moved")
    return spark.read.parquet(f"{path}-moved")


@add("rmdb", "select true as removed, false as there")
def _(spark, d):
    path = _stored(spark, d)
    return spark.createDataFrame([(tables.remove(spark, path), tables.exists(spark, path))], "removed boolean, there boolean")


def _linked(spark, d):
    name = f"linked_{uuid.uuid4().hex}"
    tables.link(spark, _stored(spark, d), name)
    return spark.table(name)


add("lndb", SUPPLIERS)(_linked)
add("aliasdb", SUPPLIERS)(_linked)


@add("touchdb", SUPPLIERS)
def _(spark, d):
    return tables.touch(_suppliers(spark, d))


@add("diskspaceavail", "select true as enough")
def _(spark, d):
    return spark.createDataFrame([(tables.free_space(spark, shared_dir(spark).rsplit("/", 1)[0]) > 0,)], "enough boolean")


@add("dbtype", "select 'nucleotide' as kind")
def _(spark, d):
    path = _stored(spark, d)
    tables.set_kind(spark, path, "nucleotide")
    return spark.createDataFrame([(tables.kind(spark, path),)], "kind string")


@add("setextendeddbtype", "select 'amino acid' as before, 'amino acid;compressed' as after")
def _(spark, d):
    path = _stored(spark, d)
    tables.set_kind(spark, path, "amino acid")
    before = tables.kind(spark, path)
    tables.set_kind(spark, path, f"{before};compressed")
    return spark.createDataFrame([(before, tables.kind(spark, path))], "before string, after string")


@add("version", "select '0.2' as version")
def _(spark, d):
    return spark.createDataFrame([(tables.version(),)], "version string")


@add("createindex", f"with {SEQS}, {_words('w', 'seqs')}, {_lowest('low', 'w')}, {CENTRES} select * from centres")
def _(spark, d):
    name = f"index_{uuid.uuid4().hex}"
    tables.save_index(candidates.kmer_index(seqs(spark, d), K, M), name, "kmer", 8)
    return spark.table(name)


@add("apply", f"with {SEQS} select key, lower(seq) as output from seqs")
def _(spark, d):
    return external.apply_program(seqs(spark, d), ["tr", "A-Z", "a-z"])


# --- profiles and alignment


@add("profile2pssm", f"with {ODDS}, wide as (select key, place, min_by(letter, [-score, ascii(letter)]) as best, string_agg(score::varchar, chr(9) order by letter) as s from odds group by all) select key, place, place || chr(9) || best || chr(9) || s as value from wide")
def _(spark, d):
    background = materialise(_background(spark, d))
    return writers.pssm_rows(_packed(spark, d, "scores", background), sorted(r["letter"] for r in background.select("letter").collect()))


@add("profile2repseq", f"with {STAR} select key, seq from seqs where key in (select key from used) and seq <> ''")
def _(spark, d):
    return profiles.representative_sequence(_star(spark, d))


@add("result2dnamsa", f"with {STAR}, dna as (select key, member, place, letter from star) select key, member, repeat('---', min(place)::int) || string_agg(repeat(chr(65 + (ascii(letter) - 65) % 4), 3), '' order by place) || repeat('---', (length(any_value(seq)) - 1 - max(place))::int) as row from dna join seqs using (key) group by key, member")
def _(spark, d):
    codons = F.array_join(F.transform(F.filter(F.split("seq", ""), lambda c: c != ""), lambda c: F.repeat(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDABCDABCDABCDABCDABCDAB"), F.lit(3))), "")
    dna = seqs(spark, d).select("key", codons.alias("seq"))
    return profiles.codon_rows_ungapped(_laid(spark, d), dna, seqs(spark, d))


@add("calculatelambda", "select round(ln((sqrt(13) - 1) / 2), 9) as lambda")
def _(spark, d):
    scores = {(a, b): 2.0 if a == b else -1.0 for a in "ACGT" for b in "ACGT"}
    return spark.createDataFrame([(round(alignment.gumbel_lambda(scores, dict.fromkeys("ACGT", 0.25)), 9),)], "lambda double")


# --- workflows from files to files


@add("easy_linclust", f"{_cover(LINEAR, 'kept')} select 'd' || c.rep as rep, 'd' || s.member as member from same s join covered c on c.member = s.rep")
def _(spark, d):
    headers = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("header"))
    # read back, records are numbered in the order of the files; ties go to the smaller number
    path = _written(writers.fasta(seqs(spark, d), headers).orderBy("key"))
    out = files.easy_linear_cluster(spark, path, _folder(spark))
    parts = F.split("value", "\t")
    return spark.read.text(out["clusters"]).select(parts[0].alias("rep"), parts[1].alias("member"))


def _fasta(spark, d, name: str, prefix: str) -> str:
    """A FASTA file of the letters of ``documents`` or ``benchmark``; names are the prefix and the id."""
    made = seqs(spark, d) if name == "documents" else queries(spark, d)
    return _written(writers.fasta(made, made.select("key", F.concat(F.lit(prefix), F.col("key").cast("string")).alias("header"))))


def _lines(spark, path: str, *columns: str) -> DataFrame:
    parts = F.split("value", "\t")
    return spark.read.text(path).select(*[parts[i].alias(c) for i, c in enumerate(columns)])


@add("easy_linsearch")
def _(spark, d):
    out = files.easy_linear_search(spark, _fasta(spark, d, "benchmark", "b"), _fasta(spark, d, "documents", "d"), _folder(spark), "query,target,alnlen,raw")
    return _lines(spark, out, "query", "target", "alnlen", "raw")


@add("easy_taxonomy")
def _(spark, d):
    path = _folder(spark)
    writers.taxonomy_dump(taxa(spark, d), path)
    taxon = F.expr("case lang when 'en' then 123 when 'fr' then 106 when 'de' then 107 else 102 end")
    mapping = table(spark, d, "documents").select(F.concat_ws("\t", F.concat(F.lit("d"), F.col("doc_id").cast("string")), taxon.cast("string")).alias("value"))
    found = files.easy_taxonomy(spark, _fasta(spark, d, "benchmark", "b"), _fasta(spark, d, "documents", "d"), _written(mapping), f"{path}/nodes", f"{path}/names", f"{path}/out")
    return _lines(spark, found["lca"], "name", "taxid", "rank", "taxon")


def _set_files(spark, d) -> list[str]:
    """One FASTA file a language."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "lang")
    letters = materialise(seqs(spark, d).join(docs, "key"))
    return [_written(writers.fasta(letters.where(F.col("lang") == lang).select("key", "seq"), letters.select("key", F.concat(F.lit("d"), F.col("key").cast("string")).alias("header")))) for lang in ("de", "en", "es", "fr")]


@add("multihitdb", "select 'd' || doc_id as accession, lang from documents")
def _(spark, d):
    paths = _set_files(spark, d)
    read, sets = files.set_tables(spark, [f"{p}/part-*" for p in paths])
    folders = spark.createDataFrame([(p.rsplit("/", 1)[1], lang) for p, lang in zip(paths, ("de", "en", "es", "fr"), strict=True)], "folder string, lang string")
    named = read.lookup.join(sets, "key").withColumn("folder", F.regexp_extract("file", "([^/]+)/part-[^/]*$", 1))
    return named.join(folders, "folder").select("accession", "lang")


@add("easy_proteomecluster")
def _(spark, d):
    return _lines(spark, files.easy_proteome_cluster(spark, [f"{p}/part-*" for p in _set_files(spark, d)], _folder(spark), 0.1), "rep", "member", "shared", "share")


@add("easy_proteomesearch")
def _(spark, d):
    own = _fasta(spark, d, "benchmark", "b")
    return _lines(spark, files.easy_proteome_search(spark, [own], [f"{p}/part-*" for p in _set_files(spark, d)], _folder(spark)), "query_set", "target_set", "share")


@add("easy_cluster")
def _(spark, d):
    out = files.easy_cluster(spark, _fasta(spark, d, "documents", "d"), _folder(spark))
    return _lines(spark, out["clusters"], "rep", "member")


@add("appenddbtoindex", f"with {SEQS}, {_words('w', 'seqs')}, {_lowest('low', 'w')}, {CENTRES} select * from centres union all select kmer, -centre, centre_length, centre_place from centres")
def _(spark, d):
    name = f"index_{uuid.uuid4().hex}"
    index = materialise(candidates.kmer_index(seqs(spark, d), K, M))
    tables.save_index(index, name, "kmer", 8)
    tables.append_to_index(index.withColumn("centre", -F.col("centre")), name)
    return spark.table(name)


@add("tsv2exprofiledb", f"with {SEQS} select key::varchar as key, seq, source as header, lang as line from seqs join documents on doc_id = key where seq <> ''")
def _(spark, d):
    path = _folder(spark)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "source", "lang").join(seqs(spark, d), "key").where("seq != ''")
    for part, column in (("seq", "seq"), ("h", "source"), ("aln", "lang")):
        writers.write_text(docs.select(F.concat_ws("\t", F.col("key").cast("string"), column).alias("value")), f"{path}_{part}")
    sequences, headers, lines = readers.read_expandable(spark, path)
    return sequences.select("key", "seq").join(headers.select("key", "header"), "key").join(lines.select("key", "line"), "key")


# --- profile searches and what is made of alignments


def _pairs(spark, d):
    return candidates.match_diagonals(queries(spark, d), seqs(spark, d), 12, least_score=40)


def _found(spark, d) -> DataFrame:
    return materialise(alignment.align(_pairs(spark, d), queries(spark, d), seqs(spark, d)))


def _scores(spark, d) -> DataFrame:
    return materialise(workflows.profile_scores(_found(spark, d), queries(spark, d), seqs(spark, d), materialise(_background(spark, d))))


@add("search_profile")
def _(spark, d):
    return workflows.search_profiles(_scores(spark, d), seqs(spark, d)).select("key", "pos", "target", "score", "cigar")


@add("search_targetprofile")
def _(spark, d):
    return workflows.search_target_profiles(seqs(spark, d), _scores(spark, d)).select("key", "pos", "target", "score", "cigar")


@add("search_iterative")
def _(spark, d):
    return workflows.iterative_profile_search(queries(spark, d), seqs(spark, d), materialise(_background(spark, d)), 2).select("key", "pos", "target", "score")


@add("enrich")
def _(spark, d):
    return workflows.enrich_profiles(queries(spark, d), seqs(spark, d), materialise(_background(spark, d)))


@add("expand2profile")
def _(spark, d):
    first = _found(spark, d)
    back = first.select(F.col("target").alias("key"), F.col("key").alias("target"), F.col("tstart").alias("qstart"), F.col("qstart").alias("tstart"), F.translate("cigar", "ID", "DI").alias("cigar"))
    return workflows.expand_profiles(first, back, queries(spark, d), queries(spark, d), materialise(_background(spark, d)))


@add("sequence2profile", f"with {SEQS}, {QUERIES}, bg as (select letter, count(*) / sum(count(*)) over () as p from (select unnest(string_split(seq, '')) as letter from seqs where seq <> '') group by 1), own as (select key, unnest(range(0, length(seq))) as place, unnest(string_split(seq, '')) as own from queries where seq <> '') select key, place, letter, greatest(least(round(log2(((1 - least(1.0, 1.1 / (1 + 1 / 4.1))) * case when own = letter then 1 else 0 end + least(1.0, 1.1 / (1 + 1 / 4.1)) * p) / p) * 8), 127), -128)::int as score from own cross join bg")
def _(spark, d):
    none = spark.createDataFrame([], "key long, target long, qstart long, tstart long, cigar string")
    return workflows.profile_scores(none, queries(spark, d), seqs(spark, d), materialise(_background(spark, d)))


@add("filtera3m")
def _(spark, d):
    return profiles.filter_msa(profiles.msa_rows(_star(spark, d), seqs(spark, d)), most_identity=0.9)


@add("extractdomains", f"with {STAR}, placed as (select key, member, place, letter, row_number() over (partition by key, member order by place) - 1 as nth from star), k as (select key, place, letter as own from star where key = member) select key, member, 1::bigint as domain, min(nth) as start, max(nth) as stop, count(*) as letters, avg((letter = own)::int) as identity from placed join k using (key, place) where place between 10 and 39 group by key, member")
def _(spark, d):
    star = _star(spark, d)
    domains = star.select("key").distinct().select("key", F.lit(1).cast("long").alias("domain"), F.lit(10).cast("long").alias("qstart"), F.lit(39).cast("long").alias("qend"))
    return profile_search.extract_domains(domains, star)


@add("align2clust")
def _(spark, d):
    pairs = candidates.match_kmers(seqs(spark, d), K, M, share=0.5).where("score >= 5")
    return workflows.align_and_cluster(pairs, seqs(spark, d))


@add("cluster_reassigned")
def _(spark, d):
    return workflows.reassigned(workflows.linear_cluster(seqs(spark, d), mode="component"), seqs(spark, d))


@add("pickconsensusrep")
def _(spark, d):
    clusters = materialise(workflows.linear_cluster(seqs(spark, d)))
    return workflows.pick_consensus(clusters, seqs(spark, d), materialise(_background(spark, d)))


@add("fwbw")
def _(spark, d):
    best = _pairs(spark, d).groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "target"))["target"].alias("target"))
    return alignment.posterior_pairs(best, queries(spark, d), seqs(spark, d))
