"""Readers of text formats into tables; all but archives are read in splits by Spark's own text source.

Keys count records from 0 in the order of (file, place in the file), whatever tasks read them.
"""

from __future__ import annotations

import io
import tarfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manyfold.functions.sequence import accession, reverse_complement
from manyfold.operators.keyed import dense_ranks
from manyfold.operators.storage import materialise

NUCLEOTIDES = "ACGTUNacgtun"
#: Line codes of the UniProtKB flat format and the columns made of them.
KB_CODES = ("ID", "AC", "DT", "DE", "GN", "OS", "OG", "OC", "OX", "OH", "RN", "CC", "DR", "PE", "KW", "FT")


def _records(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """``(file, at, value)``: pieces of files between separators; ``at`` orders a file's pieces."""
    read = spark.read.text(path, lineSep=separator)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return read.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value")


def _keyed(records: DataFrame) -> DataFrame:
    """Records with ``key`` counted from 0.

    A block's records stand together in one task, so a record's key is its block's start and its place among the block's; only
    blocks are gathered and joined, not records.
    """
    placed = materialise(records.withColumns({"__block": F.col("at.block"), "__id": F.monotonically_increasing_id()}).drop("at"))
    blocks = placed.groupBy("file", "__block").agg(F.min("__id").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    starts, total = [], 0
    for b in sorted(blocks, key=lambda b: (b["file"], b["__block"])):
        starts.append((b["file"], b["__block"], total - b["first"]))
        total += b["n"]
    shifts = records.sparkSession.createDataFrame(starts, "file string, __block long, __shift long")
    return placed.join(F.broadcast(shifts), ["file", "__block"]).withColumn("key", F.col("__id") + F.col("__shift")).drop("__block", "__id", "__shift")


@dataclass
class SequenceTables:
    """What a set of sequence files holds."""

    sequences: DataFrame  # (key, seq)
    headers: DataFrame  # (key, header)
    lookup: DataFrame  # (key, accession, file)
    nucleotide: bool


def read_fasta(spark: SparkSession, path: str | list[str]) -> SequenceTables:
    """FASTA files, plain or compressed as their names say.

    White space inside sequences goes.  Sequences count as nucleotides when 9 of 10 letters of the first ones are.
    """
    pieces = _records(spark, path, "\n>").withColumn("value", F.regexp_replace("value", "^\\s*>", "")).where("trim(value) != ''")
    lines = F.split("value", "\r?\n", 2)
    made = _keyed(pieces.select("file", "at", F.trim(lines[0]).alias("header"), F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s+", "").alias("seq")))
    return _tables(made)


def read_fastq(spark: SparkSession, path: str | list[str]) -> SequenceTables:
    """FASTQ files of four-line records; quality is dropped.

    Files are cut at ``@`` at the start of a line, which can also be where a quality begins: its record has been told by then,
    and what is cut off has no line that begins with ``+``.
    """
    pieces = _records(spark, path, "\n@").where(F.col("value").rlike(r"^[^\n]*\n[^\n]*\n\+"))
    lines = F.split("value", "\r?\n")
    made = _keyed(pieces.select("file", "at", lines[0].alias("header"), F.trim(lines[1]).alias("seq")))
    # nothing is cut off before a file's first record
    first = made.groupBy("file").agg(F.min("key").alias("__first"))
    header = F.when((F.col("key") == F.col("__first")) & F.startswith("header", F.lit("@")), F.substring("header", 2, 1 << 30)).otherwise(F.col("header"))
    return _tables(made.join(F.broadcast(first), "file").withColumn("header", header).drop("__first"))


def _tables(made: DataFrame) -> SequenceTables:
    sample = made.select(F.length("seq").alias("n"), F.length(F.translate("seq", NUCLEOTIDES, "")).alias("rest")).limit(10).agg(F.sum("n"), F.sum("rest")).first()
    headers = made.select("key", "header")
    return SequenceTables(made.select("key", "seq"), headers, made.select("key", accession(F.col("header")).alias("accession"), "file"), bool(sample[0]) and sample[1] <= 0.1 * sample[0])


def read_keyed_tsv(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Tab-separated lines as a keyed table: the first column is the key, ``pos`` the line's place among its key's lines."""
    parts = F.split("value", "\t", -1)
    lines = _records(spark, path, "\n").where("value != ''").select("file", "at", *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(["key", *columns])])
    order = Window.partitionBy("key").orderBy("file", "at")
    return lines.withColumn("pos", F.row_number().over(order).cast("long")).select("key", "pos", *columns)


def read_expandable(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sequences ``(key, pos, seq)``, headers ``(key, pos, header)`` and alignments ``(key, pos, line)`` of ``<path>_seq``, ``_h`` and ``_aln``, tab-separated."""
    return tuple(read_keyed_tsv(spark, f"{path}_{part}", [name]) for part, name in (("seq", "seq"), ("h", "header"), ("aln", "line")))


def read_gff(spark: SparkSession, path: str | list[str], features: list[str] | None = None) -> DataFrame:
    """GFF3 rows ``(accession, feature, start, stop, strand, attributes)`` with nine columns; 1-based, closed."""
    parts = F.split("value", "\t", -1)
    rows = spark.read.text(path).where("value != '' and value not like '#%'").where(F.size(parts) >= 9)
    out = rows.select(parts[0].alias("accession"), parts[2].alias("feature"), parts[3].cast("long").alias("start"), parts[4].cast("long").alias("stop"), parts[6].alias("strand"), parts[8].alias("attributes"))
    return out.where(F.col("feature").isin(features)) if features else out


def gff_regions(gff: DataFrame, sequences: DataFrame, lookup: DataFrame) -> DataFrame:
    """``(key, accession, seq)``: a region's letters, of the other strand where it says ``-``; keys stay those of the sequences."""
    named = gff.join(lookup.select("accession", "key"), "accession").join(sequences, "key")
    low, high = F.least("start", "stop"), F.greatest("start", "stop")
    part = F.substring(F.col("seq"), low.cast("int"), (high - low + 1).cast("int"))
    return named.select("key", F.concat_ws("_", "accession", "start", "stop").alias("accession"), F.when(F.col("strand") == "-", reverse_complement(part)).otherwise(part).alias("seq"))


def read_stockholm(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(key, pos, name, row)`` of Stockholm families: rows that continue in later blocks are joined, dots become gaps.

    The family's accession (or id) stands before the first name.
    """
    families = _keyed(_records(spark, path, "\n//").where("trim(value) != ''"))
    label = F.coalesce(*[F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^#=GF {c}\s+(\S+)", 1)), F.lit("")) for c in ("AC", "ID")], F.lit(""))
    lines = families.select("key", label.alias("label"), F.posexplode(F.split("value", "\r?\n")).alias("i", "line")).where(F.col("line").rlike(r"^[^#\s/]\S*\s+\S"))
    parts = F.split(F.trim("line"), r"\s+", 2)
    cut = lines.select("key", "label", "i", parts[0].alias("name"), F.replace(parts[1], F.lit("."), F.lit("-")).alias("part"))
    rows = cut.groupBy("key", "label", "name").agg(F.min("i").alias("i"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "").alias("row"))
    numbered = rows.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("i")).cast("long"))
    return numbered.select("key", "pos", F.when((F.col("pos") == 1) & (F.col("label") != ""), F.concat_ws(" ", "label", "name")).otherwise(F.col("name")).alias("name"), "row")


def read_uniprot(spark: SparkSession, path: str | list[str], columns: tuple[str, ...] = (*KB_CODES, "SEQ")) -> DataFrame:
    """``(key, <columns>)`` of UniProtKB flat files: texts of lines with a code, joined by blanks; SEQ the sequence."""
    entries = _keyed(_records(spark, path, "\n//").where(F.col("value").rlike("(?m)^ID   ")))

    def column(code: str) -> Column:
        if code == "SEQ":
            return F.regexp_replace(F.regexp_extract("value", r"(?s)\nSQ   [^\n]*\n(.*)$", 1), r"\s+", "").alias(code)
        return F.array_join(F.transform(F.regexp_extract_all("value", F.lit(rf"(?m)^{code}   (.*)$"), F.lit(1)), lambda x: F.trim(x)), " ").alias(code)

    return entries.select("key", *[column(c) for c in columns])


def read_tar(spark: SparkSession, path: str | list[str], include: str = ".*", exclude: str = "^$") -> DataFrame:
    """``(key, name, content)`` of the archives' regular members; members left out still use up a key."""

    @F.arrow_udf("array<struct<name:string,content:binary>>")
    def members(contents: pa.Array) -> pa.Array:
        out = []
        for raw in contents.to_pylist():
            with tarfile.open(fileobj=io.BytesIO(raw)) as archive:
                out.append([{"name": m.name, "content": archive.extractfile(m).read()} for m in archive if m.isfile()])
        return pa.array(out, pa.list_(pa.struct([("name", pa.string()), ("content", pa.binary())])))

    read = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.explode(members(F.col("content"))).alias("m"))
    return _keyed(read.select("file", F.struct(F.lit(0).cast("long").alias("block")).alias("at"), "m.name", "m.content")).where(F.col("name").rlike(include) & ~F.col("name").rlike(exclude)).select("key", "name", "content")


def read_taxonomy(spark: SparkSession, nodes: str, names: str, merged: str | None = None) -> DataFrame:
    """``(taxid, parent, rank, name)`` from dump files with the separator ``tab | tab``; merged ids are nodes below their new id."""

    def rows(path: str, columns: list[str]) -> DataFrame:
        parts = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t", -1)
        return spark.read.text(path).where("value != ''").select(*[F.trim(F.get(parts, F.lit(i))).alias(c) for i, c in enumerate(columns)])

    named = rows(names, ["taxid", "name", "unique", "class"]).where(F.col("class") == "scientific name").groupBy("taxid").agg(F.min("name").alias("name"))
    out = rows(nodes, ["taxid", "parent", "rank"]).join(named, "taxid", "left").select(F.col("taxid").cast("long"), F.col("parent").cast("long"), "rank", F.coalesce("name", F.lit("")).alias("name"))
    if merged:
        old = rows(merged, ["taxid", "parent"]).select(F.col("taxid").cast("long"), F.col("parent").cast("long"))
        out = out.unionByName(old.join(out.select(F.col("taxid").alias("parent"), "rank", "name"), "parent").select("taxid", "parent", "rank", "name"))
    return out


def read_a3m(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A3M alignments as ``(key, pos, name, row)``, one family per file: lower-case letters (insertions) and ``ss_`` rows go."""
    tables = read_fasta(spark, path)
    rows = tables.sequences.join(tables.headers, "key").join(tables.lookup.select("key", "file"), "key").where(~F.col("header").startswith("ss_"))
    families = dense_ranks(rows.select("file").distinct(), "file", "family")
    order = Window.partitionBy("family").orderBy("key")
    return rows.join(families, "file").withColumn("pos", F.row_number().over(order).cast("long")).select((F.col("family") - 1).alias("key"), "pos", F.col("header").alias("name"), F.regexp_replace("seq", "[a-z.]", "").alias("row"))


def msa_to_star(rows: DataFrame, gap_share: float | None = None) -> DataFrame:
    """Alignment rows ``(key, pos, name, row)`` as a star alignment over match columns: those of the first row without gap,
    or those in which at most ``gap_share`` of the rows have one."""
    spread = rows.select("key", "pos", F.posexplode(F.filter(F.split("row", ""), lambda c: c != "")).alias("column", "letter"))
    if gap_share is None:
        match = spread.where("pos = 1 and letter != '-'").select("key", "column")
    else:
        match = spread.groupBy("key", "column").agg(F.avg((F.col("letter") == "-").cast("double")).alias("g")).where(F.col("g") <= gap_share).select("key", "column")
    placed = match.withColumn("place", (F.row_number().over(Window.partitionBy("key").orderBy("column")) - 1).cast("long"))
    return spread.join(placed, ["key", "column"]).select("key", F.col("pos").alias("member"), "place", "letter")


def split_msa(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alignment rows as sequences ``(key, member, name, seq)`` without gaps, and as a star alignment."""
    return rows.select("key", F.col("pos").alias("member"), "name", F.regexp_replace("row", "-", "").alias("seq")), msa_to_star(rows)


def read_hmm(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(key, name, place, letter, share)`` of profile models in the text form with lines of 1000 times minus log2 of shares.

    A model's letters stand in its ``HMM`` line; ``*`` means a share of zero.
    """
    models = _keyed(_records(spark, path, "\n//").where(F.col("value").rlike("(?m)^HMM ")))
    letters = F.split(F.trim(F.regexp_extract("value", r"(?m)^HMM\s+(.*)$", 1)), r"\s+")
    name = F.trim(F.regexp_extract("value", r"(?m)^NAME\s+(.*)$", 1))
    body = F.regexp_extract("value", r"(?s)\nHMM [^\n]*\n(.*)$", 1)
    lines = models.select("key", name.alias("name"), letters.alias("letters"), F.explode(F.regexp_extract_all(body, F.lit(r"(?m)^(?!HMM|NULL)[A-Za-z*-]\s+\d+\s+.*$"), F.lit(0))).alias("line"))
    parts = F.split(F.trim("line"), r"\s+")
    values = F.slice(parts, 3, F.size("letters"))
    rows = lines.select("key", "name", (parts[1].cast("long") - 1).alias("place"), F.explode(F.arrays_zip(F.col("letters").alias("letter"), values.alias("v"))).alias("z"))
    return rows.select("key", "name", "place", "z.letter", F.when(F.col("z.v") == "*", 0.0).otherwise(F.pow(F.lit(2.0), -F.col("z.v").cast("double") / 1000)).alias("share"))
