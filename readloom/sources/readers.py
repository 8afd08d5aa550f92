"""Readers of sequence files as DataFrames.

Line formats are read by the text and CSV sources, so that large files split; records that span lines are
split by their header mark. Formats whose files are indivisible (flowgrams, alignments) are read whole, a file a task.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import seq as S
from readloom.operators.filters import region_rows


def _records(spark: SparkSession, path, mark: str = ">") -> DataFrame:
    """One row (header, body) for each record; body lines are joined by line feeds. Text before the first mark is no record."""
    raw = spark.read.option("lineSep", f"\n{mark}").text(path).select(F.regexp_replace("value", "\r", "").alias("v")).where(~F.ltrim("v").startswith("#"))
    text = F.regexp_replace(F.col("v"), f"^{mark}", "")
    head = F.split_part(text, F.lit("\n"), F.lit(1))
    return raw.select(head.alias("header"), text.alias("t")).where("length(trim(t)) > 0").select("header", F.when(F.instr(F.col("t"), "\n") > 0, F.substring(F.col("t"), F.instr(F.col("t"), F.lit("\n")) + 1, F.length("t"))).otherwise("").alias("body"))


def fasta(spark: SparkSession, path) -> DataFrame:
    """(read_id, descr, seq): first word of the header, the header, and the letters without white space; comment lines (#) are dropped."""
    body = F.regexp_replace(F.regexp_replace("body", "(?m)^#.*$", ""), r"\s+", "")
    return _records(spark, path).select(F.regexp_extract("header", r"^(\S*)", 1).alias("read_id"), F.col("header").alias("descr"), body.alias("seq"))


def fasta_with_start(spark: SparkSession, path) -> DataFrame:
    """Headers ``id start ...``: adds start, len and stop."""
    f = fasta(spark, path).withColumn("start", F.regexp_extract("descr", r"^\S+\s+(-?[0-9]+)", 1).try_cast("int"))
    return f.withColumn("len", F.length("seq")).withColumn("stop", F.col("start") + F.col("len") - 1)


def simulated_fasta(spark: SparkSession, path) -> DataFrame:
    """Headers ``read|beg|2|length|92|forward|src``: reads that are not forward are reverse-complemented."""
    p = F.split("descr", r"\|")
    f = fasta(spark, path).select(p[0].alias("read_id"), p[2].try_cast("int").alias("start"), p[5].alias("dir"), p[6].alias("source"), F.upper("seq").alias("s"))
    seq = F.when(F.col("dir") == "forward", F.col("s")).otherwise(S.reverse_complement(F.col("s")))
    return f.select("read_id", "start", "dir", "source", seq.alias("seq")).withColumn("len", F.length("seq")).withColumn("stop", F.col("start") + F.col("len") - 1)


def support_fasta(spark: SparkSession, path) -> DataFrame:
    """Headers with ``posterior=p ave_reads=m``: (hap, posterior, ave_reads, seq)."""
    number = lambda name: F.regexp_extract("descr", name + r"=([0-9.eE+-]+)", 1).try_cast("double").alias(name)
    return fasta(spark, path).select(F.regexp_extract("descr", r"^([^|\s]*)", 1).alias("hap"), number("posterior"), number("ave_reads"), "seq")


def flow_coordinates(spark: SparkSession, path) -> DataFrame:
    """(read_id, x, y) of headers with xy=1234_5678."""
    xy = F.split(F.regexp_extract("descr", r"xy=(\d*_\d*)", 1), "_")
    return fasta(spark, path).select("read_id", xy[0].try_cast("int").alias("x"), F.get(xy, F.lit(1)).try_cast("int").alias("y"))


def reads(spark: SparkSession, path) -> DataFrame:
    """Lines ``start seq``; comments and blank lines are skipped. Adds len and stop."""
    f = spark.read.csv(path, sep=" ", comment="#", schema="start int, seq string", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return f.where("seq is not null").withColumn("len", F.length("seq")).withColumn("stop", F.col("start") + F.col("len") - 1)


def sequence_lists(spark: SparkSession, paths) -> DataFrame:
    """(source, read_id, seq): fifth column of tabular read lists, with the file's stem and the line's own columns as id."""
    p = F.split("value", r"\s+")
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(_seq)?\.txt$", 1)
    return spark.read.text(paths).select(stem.alias("source"), p.alias("p")).where("size(p) >= 5").select("source", F.array_join(F.slice("p", 1, 4), ":").alias("read_id"), F.get("p", F.lit(4)).alias("seq"))


SAM = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def sam(spark: SparkSession, path, broken: bool = False) -> DataFrame:
    """Alignment lines with typed fields, optional tags, strand and mapping flags and parsed CIGAR; pos from 0.

    Lines of fewer fields are no alignments. In ``broken`` files line feeds inside records are taken out first: a record
    begins where a line begins with the same six characters as the first one, and records are split at that mark."""
    p = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("@"))
    if broken and (first := lines.where("value <> ''").first()) is not None:
        mark = first["value"][:6]
        raw = spark.read.option("lineSep", f"\n{mark}").text(path)
        # the first piece of a file keeps its head lines, and its mark
        text = F.regexp_replace(F.regexp_replace("value", "(?m)^@[^\n]*\n", ""), "\r?\n", "")
        lines = raw.select(F.when(F.startswith(text, F.lit(mark)), text).otherwise(F.concat(F.lit(mark), text)).alias("value"))
    f = lines.select(p.alias("p")).where("size(p) >= 11")
    f = f.select(*[(F.get("p", F.lit(i)).try_cast("int") if n in ("flag", "pos", "mapq", "pnext", "tlen") else F.get("p", F.lit(i))).alias(n) for i, n in enumerate(SAM)], F.slice("p", 12, F.greatest(F.size("p") - 11, F.lit(0))).alias("tags"))
    f = f.withColumn("pos", F.col("pos") - 1)
    return f.withColumn("is_reverse", F.col("flag").bitwiseAND(F.lit(16)) > 0).withColumn("is_unmapped", F.col("flag").bitwiseAND(F.lit(4)) > 0).withColumn("ops", S.cigar(F.col("cigar")))


def sam_region(aligned: DataFrame, rname: str, start: int, stop: int, least: int = 0, strand: str | None = None) -> DataFrame:
    """Mapped alignments on rname that meet [start, stop) and keep at least so many letters net of clips and insertions."""
    span = lambda ops: F.aggregate(F.filter("ops", lambda o: o["op"].isin(*ops)), F.lit(0), lambda a, o: a + o["n"])
    f = aligned.where(~F.col("is_unmapped") & (F.col("rname") == rname) & (F.col("pos") < stop) & (F.col("pos") + span(("M", "D", "N", "=", "X")) > start))
    f = f.where(F.length("seq") - span(("I", "S")) >= least)
    return f if strand is None else f.where(F.col("is_reverse") == (strand == "-"))


def sam_on_reference(aligned: DataFrame, reference: str, begin: int, end: int, least: int = 30) -> DataFrame:
    """(qname, row) of mapped reads on the reference's places [begin, end), from 0: whole-codon deletions are gaps, others take
    the reference's letters, insertions are dropped; rows with fewer letters between their flanks are left out."""
    placed = aligned.where("cigar <> '*'").select(F.col("qname").alias("read_id"), F.col("pos").alias("start"), S.expand_on_reference(F.col("seq"), F.col("ops"), F.col("pos"), F.lit(reference)).alias("seq"))
    placed = placed.where("length(seq) > 0").withColumn("stop", F.col("start") + F.length("seq") - 1)
    return region_rows(placed, begin, end, least).select(F.col("read_id").alias("qname"), "row")


def sam_with_insertions(aligned: DataFrame, start: int, stop: int, cutoff: int = 6) -> DataFrame:
    """(read_id, row, insertions) on [start, stop]: as ``sam_rows`` with n for deletions, and the insertions beside."""
    masked = S.mask_quality(F.col("seq"), F.col("qual"), cutoff)
    row = S.to_window(S.expand_cigar(masked, F.col("ops"), "n"), F.col("pos"), start, stop)
    return aligned.where("not is_unmapped").select(F.col("qname").alias("read_id"), row.alias("row"), S.insertions(masked, F.col("ops"), F.col("pos"), start, stop).alias("insertions"))


def sam_rows(aligned: DataFrame, start: int, stop: int, cutoff: int = 6) -> DataFrame:
    """(qname, row): quality-masked and CIGAR-expanded reads on [start, stop], padded with n."""
    masked = S.mask_quality(F.col("seq"), F.col("qual"), cutoff)
    return aligned.select("qname", S.to_window(S.expand_cigar(masked, F.col("ops")), F.col("pos"), start, stop).alias("row"))


def quality(spark: SparkSession, path) -> DataFrame:
    """(read_id, qual): space-separated scores under FASTA-like headers."""
    return _records(spark, path).select(F.regexp_extract("header", r"^(\S*)", 1).alias("read_id"), F.transform(F.split(F.trim(F.regexp_replace("body", r"\s+", " ")), " "), lambda x: x.try_cast("int")).alias("qual"))


def trace(spark: SparkSession, path) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="iter int, class int, untouch int, theta double, gamma double", comment="#")


def frequency_table(spark: SparkSession, path) -> DataFrame:
    """(hap, support, reads): tab-separated, one column of reads for each recorded iteration."""
    p = F.split("value", "\t")
    return spark.read.text(path).select(p.alias("p")).where(F.get("p", F.lit(1)).rlike("^[0-9.]+$")).select(F.get("p", F.lit(0)).alias("hap"), F.get("p", F.lit(1)).try_cast("double").alias("support"), F.transform(F.slice("p", 3, 1 << 20), lambda x: x.try_cast("int")).alias("reads"))


def property_line(spark: SparkSession, path, name: str = "made") -> DataFrame:
    """Numbers of lines ``#name n``."""
    return spark.read.text(path).select(F.regexp_extract("value", rf"^#{name}\s+([0-9.]+)", 1).try_cast("double").alias("value")).where("value is not null")


def native_alignments(spark: SparkSession, path) -> DataFrame:
    """Tab-separated native aligner lines: (read_id, kind, seq, status, score, is_unique); footers and headers (#) are dropped."""
    p = F.split("value", "\t")
    f = spark.read.text(path).where(~F.col("value").startswith("#")).select(p.alias("p")).where("size(p) >= 5")
    status = F.get("p", F.lit(4))
    known = F.when(status == "U", "unique").when(status.startswith("R"), "repeat").when(status == "NM", "no match").when(status == "QC", "low quality").otherwise("other")
    return f.select(F.ltrim(F.get("p", F.lit(0)), F.lit(">@")).alias("read_id"), F.get("p", F.lit(1)).alias("kind"), F.get("p", F.lit(2)).alias("seq"), known.alias("status"), F.get("p", F.lit(5)).try_cast("double").alias("score"), (status == "U").alias("is_unique"))


def footer_counts(spark: SparkSession, path) -> DataFrame:
    """(name, value) of footer lines ``# name: 12``; thousands marks are dropped."""
    m = lambda k: F.regexp_extract("value", r"^#\s*([A-Za-z ]+):\s*([0-9,.]+)", k)
    return spark.read.text(path).select(F.trim(m(1)).alias("name"), F.regexp_replace(m(2), ",", "").try_cast("double").alias("value")).where("name <> ''")


def short_alignments(spark: SparkSession, path, shift: int = 0) -> DataFrame:
    """(read_id, start, ref, read) of white-space separated lines ``id start reference read``."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(~F.col("value").startswith("#")).select(p.alias("p")).where("size(p) >= 4").select(F.get("p", F.lit(0)).alias("read_id"), (F.get("p", F.lit(1)).try_cast("int") - shift).alias("start"), F.get("p", F.lit(2)).alias("ref"), F.get("p", F.lit(3)).alias("read"))


def savings(spark: SparkSession, path) -> DataFrame:
    """(read_id, savings): largest saving of each read in a tab-separated report with a header."""
    f = spark.read.csv(path, sep="\t", header=True, comment="#")
    return f.groupBy(F.col(f.columns[0]).alias("read_id")).agg(F.max(F.col("Savings").try_cast("double")).alias("savings"))


def feature_table(spark: SparkSession, path, sep: str = " ") -> DataFrame:
    """(label, features): first column and the remaining ones as doubles."""
    f = spark.read.csv(path, sep=sep, header=True)
    return f.select(F.col(f.columns[0]).alias("label"), F.array(*[F.col(f"`{c}`").try_cast("double") for c in f.columns[1:]]).alias("features"))


def amplicons(spark: SparkSession, path) -> DataFrame:
    """First, third and fifth column of a CSV with header."""
    f = spark.read.csv(path, header=True)
    return f.select(F.col(f.columns[0]).alias("name"), F.col(f.columns[2]).alias("forward"), F.col(f.columns[4]).alias("reverse"))


# flowgram files

SFF_MAGIC = 0x2E736666


def parse_sff(data: bytes) -> Iterator[tuple]:
    """(name, bases, clip_ql, clip_qr, flowgram, flow_index, quality) of every read of a flowgram file."""
    magic, _, index_at, index_len, n, head, key_len, flows, _ = struct.unpack_from(">I4sQIIHHHB", data, 0)
    if magic != SFF_MAGIC:
        raise ValueError("not a flowgram file")
    at = head
    for _ in range(n):
        if index_len and at == index_at:
            at += -(-index_len // 8) * 8
        size, name_len, bases, ql, qr, _, _ = struct.unpack_from(">HHIHHHH", data, at)
        name = data[at + 16 : at + 16 + name_len].decode()
        at += size
        flow = list(struct.unpack_from(f">{flows}H", data, at))
        body = at + 2 * flows
        index, text, qual = data[body : body + bases], data[body + bases : body + 2 * bases], data[body + 2 * bases : body + 3 * bases]
        yield name, text.decode(), ql, qr, flow, list(index), list(qual)
        at += -(-(2 * flows + 3 * bases) // 8) * 8


def sff(spark: SparkSession, path) -> DataFrame:
    schema = "name string, bases string, clip_ql int, clip_qr int, flowgram array<int>, flow_index array<int>, quality array<int>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for data in pdf["content"]:
                yield pd.DataFrame(list(parse_sff(bytes(data))), columns=[c.split()[0] for c in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def sff_reads(flow: DataFrame, most_ambiguous: int = 2) -> DataFrame:
    """(read_id, seq) of clipped reads without flanking N and with few inner ones."""
    right = F.when(F.col("clip_qr") > 0, F.col("clip_qr")).otherwise(F.length("bases"))
    left = F.greatest(F.col("clip_ql"), F.lit(1))
    seq = F.trim(F.upper(F.substring(F.col("bases"), left, right - left + 1)), F.lit("N"))
    return flow.select(F.col("name").alias("read_id"), seq.alias("seq")).where((F.length("seq") > 0) & (S.count_char(F.col("seq"), "N") <= most_ambiguous))


# alignment files, read whole: each parser yields (block, name, row, score)


def parse_clustal(text: str) -> Iterator[tuple]:
    rows: dict[str, str] = {}
    for line in text.splitlines()[1:]:
        m = re.match(r"(\S+)\s+([A-Za-z*.\-]+)(\s+\d+)?\s*$", line)
        if m and not line[0].isspace():
            rows[m[1]] = rows.get(m[1], "") + m[2]
    yield from ((0, k, v, None) for k, v in rows.items())


def parse_phylip(text: str) -> Iterator[tuple]:
    lines = [x for x in text.splitlines() if x.strip()]
    n = int(lines[0].split()[0])
    names, rows = [], []
    for k, line in enumerate(lines[1:]):
        if k < n:
            names.append(line[:10].strip())
            rows.append(re.sub(r"\s", "", line[10:]))
        else:
            rows[k % n] += re.sub(r"\s", "", line)
    yield from ((0, a, b, None) for a, b in zip(names, rows))


def parse_stockholm(text: str) -> Iterator[tuple]:
    block, rows = 0, {}
    for line in text.splitlines():
        if line.startswith("//"):
            yield from ((block, k, v, None) for k, v in rows.items())
            block, rows = block + 1, {}
        elif line.strip() and not line.startswith("#"):
            name, row = line.split()[:2]
            rows[name] = rows.get(name, "") + row


def parse_emboss(text: str) -> Iterator[tuple]:
    block = -1
    rows: dict[str, str] = {}
    score = None

    def flush():
        return [(block, k, v, score) for k, v in rows.items()]

    for line in text.splitlines():
        if line.startswith("# Aligned_sequences"):
            yield from flush()
            block, rows, score = block + 1, {}, None
        elif m := re.match(r"# Score:\s*([0-9.\-]+)", line):
            score = float(m[1])
        elif m := re.match(r"(\S+)\s+\d+\s+([A-Za-z.\-*]+)\s+\d+\s*$", line):
            rows[m[1]] = rows.get(m[1], "") + m[2]
    yield from flush()


def parse_markx10(text: str) -> Iterator[tuple]:
    block, name, score, row = -1, None, None, ""
    for line in [*text.splitlines(), ">>><<<"]:
        if line.startswith(">"):
            if name is not None:
                yield block, name, row, score
            name, row = None, ""
            if line.startswith(">>") and not line.startswith(">>>"):
                block, score = block + 1, None
            elif not line.startswith(">>") and block >= 0:
                name = line[1:].split()[0] if line[1:].split() else ""
        elif line.startswith(";"):
            if m := re.match(r";\s*(?:sw_score|nw_score|mx_score)\s*:\s*([0-9.\-]+)", line):
                score = float(m[1])
        elif name is not None and not line.startswith("#"):
            row += line.strip()


PARSERS = {"clustal": parse_clustal, "phylip": parse_phylip, "stockholm": parse_stockholm, "emboss": parse_emboss, "markx10": parse_markx10, "fasta-m10": parse_markx10}


def alignments(spark: SparkSession, path, kind: str) -> DataFrame:
    """(path, block, name, row, score) of alignment files in one of PARSERS; block numbers the alignments of a file."""
    parse = PARSERS[kind]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, text in zip(pdf["path"], pdf["value"]):
                yield pd.DataFrame([(name, *r) for r in parse(text)], columns=["path", "block", "name", "row", "score"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInPandas(run, "path string, block int, name string, row string, score double")


def exact_primers(reference: str, forward: Column, reverse: Column) -> tuple[Column, Column]:
    """Place (from 1) after which an amplicon begins and where it ends, by exact search of both primers; 0 if absent."""
    ref = F.lit(reference)
    return F.instr(ref, forward), F.instr(ref, S.reverse_complement(reverse)) + F.length(reverse) - 1
