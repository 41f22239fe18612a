import gzip
import io
import os
import tarfile

from pyspark.sql import functions as F

from manyfold.operators.external import apply_program
from manyfold.sources import readers, tables, writers
from manyfold.streaming import clusters


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">sp|P1|X first one\nACGT\nACG\n>two\n\nAC GT\n")
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as f:
        f.write(">three\r\nTTT\r\n>four\r\n")
    got = readers.read_fasta(spark, str(tmp_path / "*.fasta*"))
    assert [tuple(r) for r in got.sequences.orderBy("key").collect()] == [(0, "ACGTACG"), (1, "ACGT"), (2, "TTT"), (3, "")]
    assert [r.accession for r in got.lookup.orderBy("key").collect()] == ["P1", "two", "three", "four"] and got.nucleotide
    out = str(tmp_path / "out")
    writers.write_text(writers.fasta(got.sequences, got.headers).where("key < 2").orderBy("key").coalesce(1), out)
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part*")) == ">sp|P1|X first one\nACGTACG\n>two\nACGT\n"


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1 x\nACGT\n+\n@@@@\n@r2\nGG\n+r2\nII\n")
    got = readers.read_fastq(spark, str(tmp_path / "a.fastq"))
    assert [tuple(r) for r in got.sequences.join(got.headers, "key").orderBy("key").collect()] == [(0, "ACGT", "r1 x"), (1, "GG", "r2")]


def test_tsv_gff_and_kb(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\t1\nb\t2\na\t3\n")
    assert [tuple(r) for r in readers.read_keyed_tsv(spark, str(tmp_path / "t.tsv"), ["v"]).orderBy("key", "pos").collect()] == [("a", 1, "1"), ("a", 2, "3"), ("b", 1, "2")]
    (tmp_path / "g.gff").write_text("##gff\nc1\ts\tgene\t2\t4\t.\t+\t.\tid\nc1\ts\tCDS\t2\t4\t.\t-\t.\tid\nbad\tline\n")
    gff = readers.read_gff(spark, str(tmp_path / "g.gff"))
    sequences, lookup = spark.createDataFrame([(5, "AACGTT")], "key long, seq string"), spark.createDataFrame([(5, "c1")], "key long, accession string")
    assert sorted(r.seq for r in readers.gff_regions(gff, sequences, lookup).collect()) == ["ACG", "CGT"]
    assert readers.read_gff(spark, str(tmp_path / "g.gff"), ["gene"]).count() == 1
    (tmp_path / "k.dat").write_text("ID   A_B  Reviewed\nAC   P1;\nDE   one\nDE   two\nSQ   SEQUENCE\n     AC DE\n     FG\n//\nID   C_D\nSQ   S\n     HH\n//\n")
    assert [tuple(r) for r in readers.read_uniprot(spark, str(tmp_path / "k.dat"), ("ID", "DE", "SEQ")).orderBy("key").collect()] == [(0, "A_B  Reviewed", "one two", "ACDEFG"), (1, "C_D", "", "HH")]


def test_alignments(spark, tmp_path):
    (tmp_path / "s.sto").write_text("# STOCKHOLM 1.0\n#=GF AC PF1\nx AC.T\ny A--T\n\nx GG\ny .G\n//\n# STOCKHOLM 1.0\nz AA\n//\n")
    assert [tuple(r) for r in readers.read_stockholm(spark, str(tmp_path / "s.sto")).orderBy("key", "pos").collect()] == [(0, 1, "PF1 x", "AC-TGG"), (0, 2, "y", "A--T-G"), (1, 1, "z", "AA")]
    (tmp_path / "m.a3m").write_text(">ss_pred\nHHH\n>q\nAC-T\n>m\nAgC-T\n")
    rows = readers.read_a3m(spark, str(tmp_path / "m.a3m"))
    assert [r.row for r in rows.orderBy("pos").collect()] == ["AC-T", "AC-T"]
    assert readers.msa_to_star(rows).count() == 6 and readers.msa_to_star(rows, 1.0).count() == 8


def test_tar(spark, tmp_path):
    table = spark.createDataFrame([(2, "b.txt", "two"), (1, "a.txt", "one" * 300), (3, "c.bin", "")], "key long, name string, content string")
    path = str(tmp_path / "out")
    writers.write_tar(table, path, "name", "content")
    with tarfile.open(f"{path}/part-00000.tar") as archive:
        assert [(m.name, archive.extractfile(m).read()) for m in archive] == [("a.txt", b"one" * 300), ("b.txt", b"two"), ("c.bin", b"")]
    got = readers.read_tar(spark, f"{path}/*.tar", exclude="^b")
    assert [(r.key, r.name) for r in got.orderBy("key").collect()] == [(0, "a.txt"), (2, "c.bin")]
    assert io.BytesIO(got.orderBy("key").first().content).read() == b"one" * 300


def test_taxonomy_dump(spark, tmp_path):
    (tmp_path / "nodes").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tspecies\t|\n")
    (tmp_path / "names").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tBug\t|\t\t|\tscientific name\t|\n2\t|\tb\t|\t\t|\tsynonym\t|\n")
    (tmp_path / "merged").write_text("7\t|\t2\t|\n")
    got = readers.read_taxonomy(spark, *[str(tmp_path / n) for n in ("nodes", "names", "merged")])
    assert sorted(map(tuple, got.collect())) == [(1, 1, "no rank", "root"), (2, 1, "species", "Bug"), (7, 2, "species", "Bug")]


def test_report_columns(spark):
    hits = spark.createDataFrame([(1, 2, 10, 1, 4, 6, 0, 3, 9, 0.8, 5, 0.00314, 12, "2M1I1M1D")], "key long, target long, score long, qstart long, qend long, qlen long, tstart long, tend long, tlen long, identity double, length long, evalue double, bits long, cigar string")
    queries, targets = spark.createDataFrame([(1, "XABCDX", "qh")], "key long, seq string, header string"), spark.createDataFrame([(2, "ABDEFGHIJ", "th")], "key long, seq string, header string")
    row = writers.report(hits, "query,qheader,theader,qaln,taln,evalue,gapopen,qframe", queries, targets).first()
    assert tuple(row) == (1, "qh", "th", "ABCD-", "AB-DE", "3.140E-03", 2, 2)


def test_storage_commands(spark, tmp_path):
    a, b, c = (str(tmp_path / x) for x in "abc")
    tables.save(spark.range(5), a)
    tables.copy(spark, a, b)
    assert tables.move(spark, b, c) and not tables.remove(spark, b) and spark.read.parquet(c).count() == 5
    tables.link(spark, c, "linked")
    assert spark.table("linked").count() == 5 and tables.free_space(spark, a) > 0 and tables.remove(spark, c)


def test_external_program(spark):
    table = spark.createDataFrame([(1, "abc"), (2, None)], "key long, seq string")
    assert sorted(map(tuple, apply_program(table, ["sh", "-c", "echo $ENTRY_KEY; tr a-z A-Z"]).collect())) == [(1, "1\nABC"), (2, "2\n")]


def test_streaming_clusters(spark, tmp_path):
    base = ["ACGTTGCAAC" * 4 + "GGATCCTTAGCA" * 5, "TTGACCAGTACCATG" * 7]
    source, state = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    spark.createDataFrame([(1, base[0]), (2, base[1]), (3, base[0])], "key long, seq string").coalesce(1).write.parquet(str(source / "one"))
    stream = spark.readStream.schema("key long, seq string").option("recursiveFileLookup", "true").parquet(str(source))
    clusters.start(stream, state, str(tmp_path / "checkpoint")).processAllAvailable()
    spark.createDataFrame([(4, base[1]), (5, base[0]), (1, base[0])], "key long, seq string").coalesce(1).write.parquet(str(source / "two"))
    for query in spark.streams.active:
        query.processAllAvailable()
        query.stop()
    got = {(r.rep, r.member) for r in clusters.members(spark, state).select("rep", F.col("member")).collect()}
    assert got == {(1, 1), (2, 2), (1, 3), (2, 4), (1, 5)}


def test_models_and_dumps(spark, tmp_path):
    (tmp_path / "m.hhm").write_text("HHsearch 1.5\nNAME  fam one\nSEQ\n>x\nAC\n#\nNULL   1000\t1000\nHMM    A\tC\n       M->M\nA 1    0\t*\t1\n       0\t*\nC 2    1000\t1000\t2\n       0\t*\n//\n")
    got = readers.read_hmm(spark, str(tmp_path / "m.hhm")).orderBy("place", "letter").collect()
    assert [(r.name, r.place, r.letter, r.share) for r in got] == [("fam one", 0, "A", 1.0), ("fam one", 0, "C", 0.0), ("fam one", 1, "A", 0.5), ("fam one", 1, "C", 0.5)]
    nodes = spark.createDataFrame([(1, 1, "no rank", "root"), (2, 1, "species", "Bug")], "taxid long, parent long, rank string, name string")
    writers.taxonomy_dump(nodes, str(tmp_path / "dump"))
    assert sorted(map(tuple, readers.read_taxonomy(spark, str(tmp_path / "dump/nodes"), str(tmp_path / "dump/names")).collect())) == sorted(map(tuple, nodes.collect()))
    writers.unpack(spark.createDataFrame([(1, "AC"), (2, "GT")], "key long, seq string"), str(tmp_path / "entries"))
    assert [p.read_text() for p in (tmp_path / "entries/key=2").glob("part*")] == ["GT\n"]
    rows = spark.createDataFrame([(0, 1, "q", "A-C"), (0, 2, "m", "AGC")], "key long, pos long, name string, row string")
    texts, star = readers.split_msa(rows)
    assert sorted(r.seq for r in texts.collect()) == ["AC", "AGC"] and star.count() == 4
    lines = writers.pssm_lines(spark.createDataFrame([(1, 0, "A", 5), (1, 0, "C", -2)], "key long, place long, letter string, score int"), "AC").first()
    assert lines.value == "0\tA\t5\t-2"


def test_tar_of_several_archives(spark, tmp_path):
    # a member of whole blocks, raw bytes, a name beyond a header's field, and no row of any member for the driver
    rows = [(k, f"d/{'n' * (120 if k == 3 else 1)}{k}", bytes(range(256)) * (2 if k % 2 else 1) + b"\n" * k) for k in range(40)]
    table = spark.createDataFrame(rows, "key long, name string, content binary")
    path = str(tmp_path / "out")
    table.toLocalIterator = None
    writers.write_tar(table, path, "name", "content", members=10)
    assert sorted(os.listdir(path)) == [f"part-{i:05d}.tar" for i in range(4)] or {x for x in os.listdir(path) if x.endswith(".tar")} == {f"part-{i:05d}.tar" for i in range(4)}
    held = {}
    for x in (tmp_path / "out").glob("*.tar"):
        assert x.stat().st_size % 512 == 0
        with tarfile.open(x) as archive:
            held |= {m.name: archive.extractfile(m).read() for m in archive}
    assert held == {name: content for _, name, content in rows}


def test_fastq_is_read_in_splits(spark, tmp_path):
    # qualities and names that begin with @, and splits of a few records
    text = "".join(f"@{'@' if i % 7 == 3 else ''}r{i}\n{'ACGT' * 5}\n+\n{'@' if i % 2 else 'I'}{'@' if i % 3 else 'I'}{'I' * 18}\n" for i in range(2000))
    (tmp_path / "a.fastq").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = readers.read_fastq(spark, str(tmp_path / "a.fastq"))
        assert [r.header for r in got.headers.orderBy("key").collect()] == [f"{'@' if i % 7 == 3 else ''}r{i}" for i in range(2000)]
        assert [r.key for r in got.sequences.where("seq = repeat('ACGT', 5)").orderBy("key").collect()] == list(range(2000))
        assert got.sequences.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
