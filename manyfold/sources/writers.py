"""Text forms of tables.  Each function gives a table with a column ``value``; ``write_text`` writes it in parts."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a search report by default.
DEFAULT_COLUMNS = "query,target,fident,alnlen,mismatch,gapopen,qstart,qend,tstart,tend,evalue,bits"
#: What the columns of a report are made of, besides those of the hits: a join is made only for what is asked.
NEEDS = {"qseq": "query", "qheader": "query", "qset": "query", "tseq": "target", "theader": "target", "tset": "target", "qaln": "both", "taln": "both", "taxid": "taxon", "taxname": "taxon", "taxlineage": "taxon"}


def write_text(table: DataFrame, path: str, compression: str | None = None) -> None:
    table.select("value").write.text(path, compression=compression)


def fasta(sequences: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """``(key, value)``: header and sequence of each record; the key where there is no header."""
    if headers is None:
        return sequences.select("key", F.concat(F.lit(">"), F.col("key").cast("string"), F.lit("\n"), "seq").alias("value"))
    joined = sequences.join(headers.select("key", "header"), "key", "left")
    return joined.select("key", F.concat(F.lit(">"), F.coalesce("header", F.col("key").cast("string")), F.lit("\n"), "seq").alias("value"))


def tsv(table: DataFrame, names: DataFrame | None = None, targets: DataFrame | None = None, first_as_key: bool = False) -> DataFrame:
    """``(key, pos, value)``: tab-separated lines with names ``(key, name)`` for query and target where they are known.

    first_as_key: an entry is named by its first line's target.
    """
    columns = [c for c in table.columns if c not in ("key", "pos", "target")]
    query = F.first("target").over(Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if first_as_key else F.col("key")
    out = table.withColumn("__q", query.cast("string")).withColumn("__t", F.col("target").cast("string"))
    for name, given in (("__q", targets if first_as_key else names), ("__t", targets)):
        if given is not None:
            known = given.select(F.col("key").cast("string").alias("__k"), F.col("name").alias("__n"))
            out = out.join(known, out[name] == known["__k"], "left").withColumn(name, F.coalesce("__n", name)).drop("__k", "__n")
    return out.select("key", "pos", F.concat_ws("\t", "__q", "__t", *[F.col(c).cast("string") for c in columns]).alias("value"))


def flat(table: DataFrame, column: str, names: DataFrame | None = None) -> DataFrame:
    """``(key, value)``: a header line, then the entry's lines in order.  An entry becomes one text, as the format asks."""
    grouped = table.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(column).cast("string").alias("v")))), lambda x: x["v"]), "\n").alias("__v"))
    name = F.col("key").cast("string")
    if names is not None:
        grouped, name = grouped.join(names.select("key", "name"), "key", "left"), F.coalesce("name", F.col("key").cast("string"))
    return grouped.select("key", F.concat(F.lit(">"), name, F.lit("\n"), "__v").alias("value"))


def cluster_fasta(clusters: DataFrame, sequences: DataFrame, least: int = 1, most: int = 2**31 - 1) -> DataFrame:
    """``(key, value)``: the members' FASTA records of each cluster ``(rep, member)`` with ``least`` to ``most`` members."""
    sizes = clusters.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most))
    joined = clusters.join(sizes.select("rep"), "rep", "left_semi").join(sequences.select(F.col("key").alias("member"), "seq"), "member")
    record = F.concat(F.lit(">"), F.col("member").cast("string"), F.lit("\n"), "seq")
    rows = joined.select("rep", F.struct((F.col("member") != F.col("rep")).alias("o"), "member", record.alias("v")).alias("x"))
    return rows.groupBy(F.col("rep").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]), "\n").alias("value"))


def scientific(value: Column) -> Column:
    """A number as 3.140E-03."""
    return F.format_string("%.3E", value.cast("double"))


def _aligned_text(sequence: Column, start: Column, own: str) -> Column:
    """Letters of one side of the path with gaps where the other side stands alone."""
    runs = F.transform(F.regexp_extract_all("cigar", F.lit(r"\d+[MID]"), F.lit(0)), lambda r: F.struct(F.substring(r, F.lit(1), F.length(r) - 1).cast("int").alias("n"), F.right(r, F.lit(1)).alias("c")))
    first = F.struct((start + 1).cast("int").alias("at"), F.lit("").alias("out"))
    here = lambda r: (r["c"] == "M") | (r["c"] == own)
    return F.aggregate(runs, first, lambda a, r: F.struct(F.when(here(r), a["at"] + r["n"]).otherwise(a["at"]).alias("at"), F.concat(a["out"], F.when(here(r), F.substring(sequence, a["at"], r["n"])).otherwise(F.repeat(F.lit("-"), r["n"]))).alias("out")), lambda a: a["out"])


def report(hits: DataFrame, columns: str = DEFAULT_COLUMNS, queries: DataFrame | None = None, targets: DataFrame | None = None, taxa: DataFrame | None = None) -> DataFrame:
    """A search report with the columns asked for; coordinates are counted from 1.

    hits: alignments ``(key, target, score, qstart, qend, qlen, tstart, tend, tlen, identity, length, evalue, bits, cigar)``.  queries and
    targets: ``(key, seq, header, set)`` as far as needed; taxa: ``(target, taxid, name, lineage)``.  Unasked tables aren't read.
    """
    asked = [c.strip() for c in columns.split(",")]
    needed = {NEEDS.get(c, "") for c in asked}
    out = hits
    if needed & {"query", "both"}:
        out = out.join(queries.select("key", *[F.col(c).alias(f"__q{c}") for c in queries.columns if c != "key"]), "key", "left")
    if needed & {"target", "both"}:
        out = out.join(targets.select(F.col("key").alias("target"), *[F.col(c).alias(f"__t{c}") for c in targets.columns if c != "key"]), "target", "left")
    if "taxon" in needed:
        out = out.join(taxa.select("target", "taxid", F.col("name").alias("__name"), F.col("lineage").alias("__lineage")), "target", "left")
    runs = F.regexp_extract_all("cigar", F.lit(r"\d+[MID]"), F.lit(0))
    pairs = F.aggregate(F.transform(F.filter(runs, lambda r: F.endswith(r, F.lit("M"))), lambda r: F.substring(r, F.lit(1), F.length(r) - 1).cast("long")), F.lit(0).cast("long"), lambda a, n: a + n)
    same = F.round(F.col("identity") * F.col("length")).cast("long")
    frame = lambda a, b: F.when(F.col(a) > F.col(b), -((F.col(a) % 3) + 1)).otherwise((F.col(a) % 3) + 1).cast("int")
    made: dict[str, Column] = {
        "query": F.col("key"), "gapopen": F.size(F.filter(runs, lambda r: ~F.endswith(r, F.lit("M")))), "pident": F.round(F.col("identity") * 100, 3), "fident": F.round("identity", 3), "nident": same,
        "qstart": F.col("qstart") + 1, "qend": F.col("qend") + 1, "tstart": F.col("tstart") + 1, "tend": F.col("tend") + 1, "alnlen": F.col("length"), "raw": F.col("score"), "mismatch": pairs - same,
        "qcov": F.round((F.abs(F.col("qend") - F.col("qstart")) + 1) / F.col("qlen"), 3), "tcov": F.round((F.abs(F.col("tend") - F.col("tstart")) + 1) / F.col("tlen"), 3), "evalue": scientific(F.col("evalue")),
        "qseq": F.col("__qseq"), "tseq": F.col("__tseq"), "qheader": F.col("__qheader"), "theader": F.col("__theader"), "qset": F.col("__qset"), "tset": F.col("__tset"), "taxname": F.col("__name"), "taxlineage": F.col("__lineage"),
        "qframe": frame("qstart", "qend"), "tframe": frame("tstart", "tend"), "empty": F.lit("-"),
        "qaln": _aligned_text(F.col("__qseq"), F.col("qstart"), "I"), "taln": _aligned_text(F.col("__tseq"), F.col("tstart"), "D"),
    }
    return out.select(*[(made[c] if c in made else F.col(c)).alias(c) for c in asked])


def sam(hits: DataFrame) -> DataFrame:
    """SAM lines without sequence and quality."""
    clipped = F.concat(F.when(F.col("qstart") > 0, F.concat(F.col("qstart").cast("string"), F.lit("H"))).otherwise(""), "cigar", F.when(F.col("qend") < F.col("qlen") - 1, F.concat((F.col("qlen") - 1 - F.col("qend")).cast("string"), F.lit("H"))).otherwise(""))
    return hits.select("key", F.concat_ws("\t", F.col("key").cast("string"), F.lit("0"), F.col("target").cast("string"), (F.col("tstart") + 1).cast("string"), F.lit("255"), clipped, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.concat(F.lit("AS:i:"), F.col("score").cast("string")), F.concat(F.lit("NM:i:"), (F.col("length") - F.round(F.col("identity") * F.col("length")).cast("long")).cast("string"))).alias("value"))


def pssm_lines(scores: DataFrame, letters: str) -> DataFrame:
    """``(key, place, value)``: place, best letter and the scores of the letters, tab-separated."""
    grouped = scores.groupBy("key", "place").agg(F.map_from_entries(F.collect_list(F.struct("letter", "score"))).alias("m"), F.min(F.struct((-F.col("score")).alias("s"), "letter"))["letter"].alias("best"))
    return grouped.select("key", "place", F.concat_ws("\t", F.col("place").cast("string"), "best", *[F.coalesce(F.col("m")[c].cast("string"), F.lit("0")) for c in letters]).alias("value"))


def pssm_rows(rows: DataFrame, letters: list[str]) -> DataFrame:
    """``pssm_lines`` of rows ``(key, place, scores)`` that hold the scores of the letters in order."""
    best = F.get(F.array(*map(F.lit, letters)), (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))
    return rows.select("key", "place", F.concat_ws("\t", F.col("place").cast("string"), best, F.array_join(F.col("scores").cast("array<string>"), "\t")).alias("value"))


def _tar_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An archive of the members ``(name, content)`` in rows that all end before a zero byte of it, the last of its header's block."""
    before = b""
    for batch in batches:
        rows = []
        for name, raw in zip(batch.column(0), batch.column(1), strict=True):
            content = raw.as_py()
            data = content if isinstance(content, bytes) else (content or "").encode()
            info = tarfile.TarInfo(name.as_py())
            info.size = len(data)
            rows.append(before + info.tobuf()[:-1])
            before = data + bytes(-len(data) % 512)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array([before + bytes(1023)], pa.binary())], ["value"])


def write_tar(table: DataFrame, path: str, name: str, content: str, members: int = 100_000) -> None:
    """Archives of about ``members`` entries each, ``part-N.tar`` below ``path``, on whatever file system the path names.

    Entries are dealt by a hash of their key and written by the tasks, an archive each; the driver names the files.
    """
    spark = table.sparkSession
    parts = max(1, -(-table.count() // members))
    dealt = table.withColumn("__part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).repartitionById(parts, F.col("__part"))
    stream = dealt.sortWithinPartitions("key").select(name, content).mapInArrow(_tar_stream, "value binary")
    made = f"{path}/_made"
    stream.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(made)
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = {int(f.getPath().getName()[5:10]): f.getPath() for f in files.listStatus(place(made)) if f.getPath().getName().startswith("part-")}
    for part in range(parts):
        own = place(f"{path}/part-{part:05d}.tar")
        if part in there:
            files.delete(own, False)
            if not files.rename(there[part], own):
                raise OSError(f"{there[part]} can't be renamed to {own}")
            continue
        out = files.create(own, True)  # an archive without members
        out.write(bytearray(1024))
        out.close()
    files.delete(place(made), True)


def unpack(table: DataFrame, path: str, name: str = "key", content: str = "seq") -> None:
    """Every entry in a folder of its own name, as text; entries of a task follow each other, so few files are open at once."""
    table.select(F.col(name), F.col(content).alias("value")).repartition(name).sortWithinPartitions(name).write.partitionBy(name).text(path)


def taxonomy_dump(nodes: DataFrame, path: str) -> None:
    """A hierarchy as ``nodes`` and ``names`` dump files below ``path``."""
    end = F.lit("\t|")
    line = lambda *c: F.concat(F.concat_ws("\t|\t", *[F.col(x).cast("string") if isinstance(x, str) else x for x in c]), end).alias("value")
    write_text(nodes.select(line("taxid", "parent", "rank")), f"{path}/nodes")
    write_text(nodes.select(line("taxid", "name", F.lit(""), F.lit("scientific name"))), f"{path}/names")
