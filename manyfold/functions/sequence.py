"""Scalar and table functions on sequences, as columns: all but open reading frames stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the NCBI genetic codes: amino acids of table 1 for codons in the order TTT, TTC, TTA, TTG, TCT, ... and, for the
#: other tables, the codons that differ.
ORDER = "TCAG"
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
DIFFERENCES = {
    1: "", 2: "AGA* AGG* ATAM TGAW", 3: "ATAM CTTT CTCT CTAT CTGT TGAW", 4: "TGAW", 5: "AGAS AGGS ATAM TGAW", 6: "TAAQ TAGQ", 9: "AAAN AGAS AGGS TGAW", 10: "TGAC", 11: "",
    12: "CTGS", 13: "AGAG AGGG ATAM TGAW", 14: "AAAN AGAS AGGS TAAY TGAW", 15: "TAGQ", 16: "TAGL", 21: "TGAW ATAM AGAS AGGS AAAN", 22: "TCA* TAGL", 23: "TTA*", 24: "AGAS AGGK TGAW",
    25: "TGAG", 26: "CTGA", 27: "TAGQ TAAQ TGAW", 28: "TAAQ TAGQ TGAW", 29: "TAAY TAGY", 30: "TAAE TAGE", 31: "TGAW TAAE TAGE",
}
CODONS = tuple(a + b + c for a in ORDER for b in ORDER for c in ORDER)


def genetic_code(number: int = 1) -> dict[str, str]:
    """Amino acid of each codon."""
    if number not in DIFFERENCES:
        raise ValueError(f"there is no genetic code {number}")
    return dict(zip(CODONS, STANDARD, strict=True)) | {d[:3]: d[3] for d in DIFFERENCES[number].split()}


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTUacgtu", "TGCAAtgcaa")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def codons(seq: Column) -> Column:
    """The whole codons of a sequence.  Read by one pattern, as cutting letters out of a string by place takes longer the
    further back they stand."""
    return F.regexp_extract_all(seq, F.lit("(?s)..."), F.lit(0))


def _by_codon(values: dict[str, str], rest: str) -> Column:
    """A function's table as a string in the order of CODONS, then the value for anything else."""
    return F.lit("".join(values[c] for c in CODONS) + rest)


def _codon_letter(codon: Column, table: Column) -> Column:
    """The table's letter for a codon; its last letter where a base isn't one of ACGTU."""
    bases = F.translate(F.upper(codon), "U", "T")
    digits = [F.instr(F.lit(ORDER), F.substring(bases, k, 1)) for k in (1, 2, 3)]
    known = (digits[0] > 0) & (digits[1] > 0) & (digits[2] > 0)
    place = F.when(known, (digits[0] - 1) * 16 + (digits[1] - 1) * 4 + digits[2]).otherwise(F.lit(65))
    return F.substring(table, place, F.lit(1))


def translate_codons(seq: Column, code: int = 1, stop: bool = False) -> Column:
    """Amino acids of a nucleotide sequence's whole codons, X for an unknown one; with ``stop``, a ``*`` before and behind."""
    table = _by_codon(genetic_code(code), "X")
    out = F.array_join(F.transform(codons(seq), lambda c: _codon_letter(c, table)), "")
    return F.concat(F.lit("*"), out, F.lit("*")) if stop else out


def back_translate(seq: Column, code: int = 1) -> Column:
    """For each amino acid its first codon in alphabetical order; NNN where there is none."""
    first: dict[str, str] = {}
    for codon, letter in sorted(genetic_code(code).items()):
        first.setdefault(letter, codon)
    letters = F.lit("".join(first))
    text = F.lit("NNN" + "".join(first.values()))
    chars = F.filter(F.split(F.upper(seq), ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.substring(text, F.instr(letters, c) * 3 + 1, F.lit(3))), "")


def frames(table: DataFrame, which: tuple[int, ...] = (1, 2, 3, -1, -2, -3)) -> DataFrame:
    """``(key, frame, seq)``: the sequence from its first, second or third base on; negative frames of the other strand."""
    other = table.select("key", "seq", reverse_complement(F.col("seq")).alias("__back"))
    spread = other.withColumn("frame", F.explode(F.array(*map(F.lit, which))))
    strand = F.when(F.col("frame") > 0, F.col("seq")).otherwise(F.col("__back"))
    return spread.select("key", "frame", F.substring(strand, F.abs("frame"), F.length(strand)).alias("seq"))


def split_sequence(table: DataFrame, most: int, overlap: int = 0) -> DataFrame:
    """``(key, part, start, seq)``: pieces of at most ``most`` letters, ceil(length / (most - overlap)) of them."""
    if overlap >= most:
        raise ValueError("the overlap is as long as a piece")
    step = most - overlap
    steps = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    joined = F.transform(steps, lambda _, i: F.substring(F.array_join(F.slice(steps, i + 1, -(-most // step)), ""), 1, most))
    spread = table.select("key", F.posexplode(joined).alias("part", "seq"))
    return spread.select("key", "part", (F.col("part").cast("long") * step).alias("start"), "seq")


def kmers(table: DataFrame, k: int) -> DataFrame:
    """``(key, place, kmer)`` for every place, counted from 0: the words of length k from each of the first k places on."""
    shifted = table.select("key", "seq", F.explode(F.array(*map(F.lit, range(k)))).alias("__o"))
    words = F.regexp_extract_all(F.substring(F.col("seq"), F.col("__o") + 1, F.length("seq")), F.lit(f"(?s).{{{k}}}"), F.lit(0))
    spread = shifted.select("key", "__o", F.posexplode(words).alias("__i", "kmer"))
    return spread.select("key", (F.col("__i") * k + F.col("__o")).alias("place"), "kmer")


def count_kmers(table: DataFrame, k: int, alphabet: str, unknown: str = "X") -> DataFrame:
    """``(kmer, n)`` for every word of the alphabet, zero counts too; words with an unknown letter are skipped."""
    spark = table.sparkSession
    counted = kmers(table, k).where(~F.contains("kmer", F.lit(unknown))).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    words = spark.range(len(alphabet) ** k).select(F.concat(*[F.substring(F.lit(alphabet), (F.floor(F.col("id") / len(alphabet) ** i) % len(alphabet) + 1).cast("int"), F.lit(1)) for i in reversed(range(k))]).alias("kmer"))
    return words.join(counted, "kmer", "left").select("kmer", F.coalesce("n", F.lit(0)).alias("n"))


def mask_regions(table: DataFrame, regions: DataFrame, letter: str = "X") -> DataFrame:
    """``(key, seq)`` with the regions ``(key, start, stop)`` (1-based, closed) overwritten; sequences without any stay."""
    listed = regions.where("start >= 1 and stop > start").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("__r"))

    def one(seq: Column, r: Column) -> Column:
        stop = F.least(r["stop"], F.length(seq)).cast("int")
        start = F.least(r["start"], F.length(seq) + 1).cast("int")
        width = F.greatest(stop - start + 1, F.lit(0))
        return F.concat(F.substring(seq, F.lit(1), start - 1), F.repeat(F.lit(letter), width), F.substring(seq, start + width, F.length(seq)))

    joined = table.join(listed, "key", "left")
    return joined.select("key", F.when(F.col("__r").isNull(), F.col("seq")).otherwise(F.aggregate("__r", F.col("seq"), one)).alias("seq"))


def mask_runs(seq: Column, least: int) -> Column:
    """Runs of one letter of at least ``least`` in lower case: the letters are marked, then each marked run is lowered."""
    marked = F.regexp_replace(seq, rf"((.)\2{{{least - 1},}})", "\x01$1\x01")
    return F.array_join(F.transform(F.split(marked, "\x01"), lambda part, i: F.when(i % 2 == 1, F.lower(part)).otherwise(part)), "")


def aligned_region(seq: Column, start: Column, end: Column) -> Column:
    """The part of a sequence between two closed 0-based coordinates, whichever is larger."""
    low = F.least(start, end)
    return F.substring(seq, (low + 1).cast("int"), (F.greatest(start, end) - low + 1).cast("int"))


#: Letters that are read at once for open reading frames.
ORF_LETTERS = 1 << 20


def _frames_of(texts: list[str], least: int, most: int, start_mode: int, max_gaps: int, stops: frozenset[str], which: tuple[int, ...]) -> dict[str, np.ndarray | pa.Array]:
    """Columns of the open reading frames of a few sequences, which stand one behind the other; ``row`` is the sequence's number."""
    joined = "".join(texts)
    ascii_only = joined.isascii()
    codes = np.frombuffer(joined.encode("ascii" if ascii_only else "utf-32-le"), np.uint8 if ascii_only else np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    digit, gap, other = np.full(128, 4, np.int16), np.zeros(128, bool), np.arange(128, dtype=np.uint8)
    for d, letter in enumerate(ORDER):
        digit[ord(letter)] = d
    gap[[ord("N"), ord("-")]] = True
    for a, b in zip("ACGTU", "TGCAA", strict=True):
        other[ord(a)] = ord(b)
    stop, value = np.zeros(125, bool), lambda c: 25 * ORDER.index(c[0]) + 5 * ORDER.index(c[1]) + ORDER.index(c[2])
    stop[[value(c) for c in stops]] = True
    parts = []
    for sign in (1, -1):
        if not any(f * sign > 0 for f in which):
            continue
        strand = codes
        if sign < 0:
            turned = codes[np.repeat(2 * begins + sizes - 1, sizes) - np.arange(len(codes))]
            strand = np.where(turned < 128, other[np.minimum(turned, 127)], turned).astype(codes.dtype)
        low = np.minimum(strand, 127)
        digits, gaps = digit[low], gap[low]
        triple = digits[:-2] * 25 + digits[1:-1] * 5 + digits[2:]
        holed = gaps[:-2] | gaps[1:-1] | gaps[2:]
        for frame in [f for f in which if f * sign > 0]:
            first = abs(frame) - 1
            n = np.maximum(0, (sizes - first) // 3)
            rows = np.flatnonzero(n)
            if not len(rows):
                continue
            ends = np.cumsum(n[rows])
            before = ends - n[rows]
            at = np.repeat(begins[rows] + first - 3 * before, n[rows]) + 3 * np.arange(ends[-1])
            codons = triple[at]
            # stretches end at stops and with their sequence, whose end comes before a stop at the next one's start
            cuts = np.sort(np.concatenate((2 * np.flatnonzero(stop[codons]) + 1, 2 * ends)))
            to, from_ = cuts >> 1, np.concatenate(([0], (cuts[:-1] + 1) >> 1))
            leads = np.concatenate(([True], cuts[:-1] % 2 == 0))
            skip, told = np.zeros(len(to), np.int64), np.ones(len(to), bool)
            if start_mode != 1:
                starts = np.flatnonzero(codons == value("ATG"))
                k = np.searchsorted(starts, from_) if start_mode == 0 else np.searchsorted(starts, to) - 1
                known = starts[np.clip(k, 0, len(starts) - 1)] if len(starts) else np.full(len(to), -1)
                has = (k >= 0) & (k < len(starts)) & (known >= from_) & (known < to)
                if start_mode == 0:
                    has &= ~leads
                skip, told = np.where(has, known - from_, 0), has | leads
            size = to - from_ - skip
            holes = np.concatenate(([0], np.cumsum(holed[at])))
            keep = np.flatnonzero(told & (size >= max(1, least)) & (size <= most) & (holes[to] - holes[np.minimum(from_ + skip, to)] <= max_gaps))
            if not len(keep):
                continue
            to, from_, leads, skip, size, cuts = to[keep], from_[keep], leads[keep], skip[keep], size[keep], cuts[keep]
            own = np.searchsorted(ends, from_, side="right")
            row = rows[own]
            offset = first + 3 * (from_ - before[own] + skip)
            last = offset + 3 * size - 1
            started = (skip > 0) | (codons[from_ + skip] == value("ATG")) if start_mode == 2 else np.zeros(len(to), bool)
            flip = (lambda x, row=row: sizes[row] - 1 - x) if sign < 0 else (lambda x: x)
            parts.append({"row": row, "frame": np.full(len(row), frame, np.int32), "start": flip(offset), "stop": flip(last), "codons": size, "no_start": leads & ~started, "no_stop": cuts % 2 == 0, "orf": _slices(strand, begins[row] + offset, 3 * size)})
    empty = {"row": np.int64, "frame": np.int32, "start": np.int64, "stop": np.int64, "codons": np.int64, "no_start": bool, "no_stop": bool}
    out = {c: np.concatenate([np.zeros(0, t), *[x[c] for x in parts]]).astype(t) for c, t in empty.items()}
    return out | {"orf": pa.concat_arrays([pa.array([], pa.string()), *[x["orf"] for x in parts]]), "contig_length": sizes[out["row"]]}


def _slices(letters: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings cut out of one array of letters."""
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    if letters.dtype == np.uint8:
        held = letters[np.repeat(begins - offsets[:-1], sizes) + np.arange(offsets[-1])]
        return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(held))
    text = letters.tobytes().decode("utf-32-le")
    return pa.array([text[b:b + n] for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)], pa.string())


def open_reading_frames(table: DataFrame, least: int = 30, most: int = 32734, start_mode: int = 1, max_gaps: int = 2**31 - 1, code: int = 1, which: tuple[int, ...] = (1, 2, 3, -1, -2, -3), with_length: bool = False) -> DataFrame:
    """Open reading frames ``(key, frame, start, stop, codons, no_start, no_stop, orf)`` of nucleotide sequences.

    Codons between stops make a frame; the one at the sequence's start has no start codon before it, the one at its end no
    stop.  start_mode: 0 from the first start codon, 1 from the stop before, 2 from the last start codon; the frame at the
    sequence's start counts from there if it has none, and always in mode 0.  Coordinates are 0-based, closed, on the given
    strand; on the other strand start is larger than stop.  The stop codon is no part of it.  with_length: adds ``contig_length``.

    Batches of sequences are read by vector operations where they lie; nothing is shuffled.
    """
    stops = frozenset(c for c, letter in genetic_code(code).items() if letter == "*")
    clean = table.select("key", F.translate(F.upper("seq"), "U", "T").alias("seq")).where("seq is not null")
    names = ["frame", "start", "stop", "codons", "no_start", "no_stop", "orf", *["contig_length"] * with_length]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.utf8_length(batch.column("seq")).to_numpy(zero_copy_only=False)
            part = np.cumsum(sizes) // ORF_LETTERS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    made = _frames_of(batch.column("seq").slice(a, b - a).to_pylist(), least, most, start_mode, max_gaps, stops, which)
                    keys = batch.column("key").slice(a, b - a).take(pa.array(made["row"]))
                    yield pa.RecordBatch.from_arrays([keys, *[made[c] if c == "orf" else pa.array(made[c]) for c in names]], ["key", *names])

    kinds = {"frame": "int", "no_start": "boolean", "no_stop": "boolean", "orf": "string"}
    schema = f"key {table.schema['key'].dataType.simpleString()}," + ",".join(f"{c} {kinds.get(c, 'long')}" for c in names)
    return clean.mapInArrow(found, schema)


def orf_alignments(orfs: DataFrame, contigs: DataFrame) -> DataFrame:
    """Each open reading frame as an alignment with its contig: ``(key, frame, start, stop, contig_length, length, cigar)``.

    Frames that bring their ``contig_length`` aren't joined with the contigs.
    """
    joined = orfs if "contig_length" in orfs.columns else orfs.join(contigs.select("key", F.length("seq").cast("long").alias("contig_length")), "key")
    return joined.select("key", "frame", "start", "stop", "contig_length", (F.col("codons") * 3).alias("length"), F.concat((F.col("codons") * 3).cast("string"), F.lit("M")).alias("cigar"))


def longest_unhit(orfs: DataFrame, hit_keys: DataFrame) -> DataFrame:
    """For sequences none of whose frames has a hit (``hit_keys``, its only column), the longest frame, the first among equals."""
    names = hit_keys.select(F.col(hit_keys.columns[0]).alias("key")).distinct()
    free = orfs.join(names, "key", "left_anti")
    # one number a sequence finds its longest frames; only these are ranked
    most = free.groupBy("key").agg(F.max("codons").alias("__most"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("frame", "start"))
    longest = free.join(most, "key").where(F.col("codons") == F.col("__most")).drop("__most")
    return longest.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def accession(header: Column) -> Column:
    """The accession of a FASTA header: its first word, without a known database prefix and what follows the next bar."""
    word = F.regexp_extract(F.regexp_replace(header, "^consensus_", ""), r"^\S+", 0)
    inner = F.regexp_extract(word, r"^(?:sp|tr|gb|ref|pdb|bbs|lcl|pir|prf|pat|gnl|emb|dbj|gi|up|cl\|UniRef)\|([^|]*)", 1)
    return F.when(inner != "", inner).otherwise(word)
