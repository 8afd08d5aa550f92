"""Readers and writers: round trips and small files."""

import struct

from pyspark.sql import functions as F

from readloom.sources import readers, writers


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return f"file://{p}"


def test_fasta_forms(spark, tmp_path):
    path = put(tmp_path, "a.fas", "# note\n>r1 5 x\r\nACG\nTT\n>r2 0\n\n>r3 7\nAC GT\n")
    assert [(r["read_id"], r["seq"]) for r in readers.fasta(spark, path).orderBy("read_id").collect()] == [("r1", "ACGTT"), ("r2", ""), ("r3", "ACGT")]
    assert {(r["read_id"], r["start"], r["stop"]) for r in readers.fasta_with_start(spark, path).collect()} == {("r1", 5, 9), ("r2", 0, -1), ("r3", 7, 10)}
    sim = put(tmp_path, "s.fas", ">a|beg|2|length|3|forward|s\nACG\n>b|beg|4|length|3|reverse|s\nacg\n")
    assert {(r["read_id"], r["start"], r["seq"]) for r in readers.simulated_fasta(spark, sim).collect()} == {("a", 2, "ACG"), ("b", 4, "CGT")}
    sup = put(tmp_path, "u.fas", ">hap_0|posterior=0.95 ave_reads=12.5\nACGT\n")
    assert tuple(readers.support_fasta(spark, sup).first()) == ("hap_0", 0.95, 12.5, "ACGT")
    flow = put(tmp_path, "f.fas", ">q rank=1 xy=0012_0345 length=4\nACGT\n>n\nA\n")
    assert {(r["read_id"], r["x"], r["y"]) for r in readers.flow_coordinates(spark, flow).collect()} == {("q", 12, 345), ("n", None, None)}


def test_fasta_writer_wraps(spark, tmp_path):
    df = spark.createDataFrame([(1, "A" * 130), (2, "C" * 60), (3, "")], "read_id long, seq string")
    writers.write_fasta(df, f"{tmp_path}/w")
    lines = spark.read.text(f"{tmp_path}/w").where(~F.col("value").startswith(">")).select(F.length("value")).collect()
    assert max(r[0] for r in lines) == 60
    assert {(r["read_id"], len(r["seq"])) for r in readers.fasta(spark, f"{tmp_path}/w").collect()} == {("1", 130), ("2", 60), ("3", 0)}


def test_line_formats(spark, tmp_path):
    r = readers.reads(spark, put(tmp_path, "x.read", "# c\n3 ACGT\n\n10 CC\n"))
    assert {tuple(x) for x in r.collect()} == {(3, "ACGT", 4, 6), (10, "CC", 2, 11)}
    q = readers.quality(spark, put(tmp_path, "x.qual", ">a d\n10 20\n30\n>b\n5\n"))
    assert {(x["read_id"], tuple(x["qual"])) for x in q.collect()} == {("a", (10, 20, 30)), ("b", (5,))}
    s = readers.sequence_lists(spark, put(tmp_path, "lane_seq.txt", "1 2 3 4 ACGT\n1 2 3 5 GGGG x\nbad\n"))
    assert {(x["source"], x["read_id"], x["seq"]) for x in s.collect()} == {("lane", "1:2:3:4", "ACGT"), ("lane", "1:2:3:5", "GGGG")}
    n = readers.native_alignments(spark, put(tmp_path, "n.txt", "# x\n>r1\tS\tACG\t.\tU\t12\n>r2\tS\tACG\t.\tNM\n>r3\tS\tACG\t.\tQC\n"))
    assert {(x["read_id"], x["status"], x["score"]) for x in n.collect()} == {("r1", "unique", 12.0), ("r2", "no match", None), ("r3", "low quality", None)}
    f = readers.footer_counts(spark, put(tmp_path, "foot.txt", "#     Read Sequences:   104,715\n# other\nx\n"))
    assert [tuple(x) for x in f.collect()] == [("Read Sequences", 104715.0)]
    a = readers.short_alignments(spark, put(tmp_path, "al.txt", "r1 105 ACGT ACTT\n"), 100)
    assert [tuple(x) for x in a.collect()] == [("r1", 5, "ACGT", "ACTT")]
    assert readers.property_line(spark, put(tmp_path, "d.dbg", "#made 17 new\n#x\n")).first()["value"] == 17.0
    t = readers.frequency_table(spark, put(tmp_path, "fr.csv", "#hap\tsupport\nACGT\t3\t5\t6\t7\n"))
    assert [(x["hap"], x["support"], list(x["reads"])) for x in t.collect()] == [("ACGT", 3.0, [5, 6, 7])]


def test_sam_region(spark, tmp_path):
    text = "@HD\tx\n" + "".join(f"r{i}\t{flag}\tref\t{pos}\t60\t{cig}\t*\t0\t0\t{seq}\t{q}\tNM:i:0\n" for i, (flag, pos, cig, seq, q) in enumerate([(0, 11, "4M", "ACGT", "*"), (16, 14, "2S3M1D2M", "TTACGTA", "IIIIII!"), (4, 1, "*", "AC", "*"), (0, 90, "4M", "ACGT", "*")]))
    sam = readers.sam(spark, put(tmp_path, "x.sam", text))
    assert sam.where("is_unmapped").count() == 1
    got = readers.sam_region(sam, "ref", 10, 20)
    assert {r["qname"] for r in got.collect()} == {"r0", "r1"}
    assert {r["qname"] for r in readers.sam_region(sam, "ref", 10, 20, 5).collect()} == {"r1"}
    assert {r["qname"] for r in readers.sam_region(sam, "ref", 10, 20, 0, "-").collect()} == {"r1"}
    assert {r["qname"]: r["row"] for r in readers.sam_rows(got, 10, 19).collect()} == {"r0": "ACGTnnnnnn", "r1": "nnnACG-TNn"}


def flowgram_file():
    bases, flows = b"TCAGNACG", 4
    head = struct.pack(">I4sQIIHHHB", readers.SFF_MAGIC, b"\0\0\0\1", 0, 0, 2, 40, 4, flows, 1) + b"TACG" + b"TCAG"
    head += b"\0" * (40 - len(head))
    out = head
    for name, ql, qr in ((b"read1", 5, 0), (b"read_two", 0, 4)):
        h = struct.pack(">HHIHHHH", 16 + -(-len(name) // 8) * 8, len(name), len(bases), ql, qr, 0, 0) + name
        h += b"\0" * (-(-len(h) // 8) * 8 - len(h))
        body = struct.pack(f">{flows}H", 100, 0, 200, 50) + bytes([1] * len(bases)) + bases + bytes(range(len(bases)))
        out += h + body + b"\0" * (-(-len(body) // 8) * 8 - len(body))
    return out


def test_flowgrams(spark, tmp_path):
    s = readers.sff(spark, put(tmp_path, "x.sff", flowgram_file()))
    rows = {r["name"]: r for r in s.collect()}
    assert rows["read1"]["bases"] == "TCAGNACG" and list(rows["read1"]["flowgram"]) == [100, 0, 200, 50] and list(rows["read_two"]["quality"]) == list(range(8))
    assert {tuple(r) for r in readers.sff_reads(s).collect()} == {("read1", "ACG"), ("read_two", "TCAG")}


def test_alignment_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "AC-GT" * 20), ("b", "ACTGT" * 20)], "name string, row string")
    for kind in ("clustal", "phylip", "stockholm"):
        writers.write_msa(df, f"{tmp_path}/{kind}", kind)
        part = next(p for p in (tmp_path / kind).iterdir() if p.name.startswith("part"))
        got = {(r["name"], r["row"]) for r in readers.alignments(spark, f"file://{part}", kind).collect()}
        assert got == {("a", "AC-GT" * 20), ("b", "ACTGT" * 20)}, kind
    emboss = "# Aligned_sequences: 2\n# Score: 42.5\n\nref     1 ACGT      4\n          ||||\nread1   1 AC-T      3\n\nref     5 GG        6\nread1   4 GG        5\n"
    assert {(r["block"], r["name"], r["row"], r["score"]) for r in readers.alignments(spark, put(tmp_path, "e.needle", emboss), "emboss").collect()} == {(0, "ref", "ACGTGG", 42.5), (0, "read1", "AC-TGG", 42.5)}
    markx = ">>>q, 4 nt\n>>#1\n; sw_score: 20.0\n; sw_ident: 0.9\n>ref ..\n; sq_len: 4\nAC-\nGT\n>read1 ..\n; sq_len: 5\nACTGT\n>>><<<\n"
    assert {(r["name"], r["row"], r["score"]) for r in readers.alignments(spark, put(tmp_path, "m.m10", markx), "markx10").collect()} == {("ref", "AC-GT", 20.0), ("read1", "ACTGT", 20.0)}


def test_tables(spark, tmp_path):
    m = spark.createDataFrame([("x", 1), ("y", None)], "k string, v int")
    writers.write_table(m, f"{tmp_path}/m")
    assert {tuple(r) for r in spark.read.csv(f"{tmp_path}/m", sep="\t", header=True).collect()} == {("x", "1"), ("y", "undef")}
    f = spark.createDataFrame([(1, 0.7, "AC"), (2, 0.3, "GG"), (3, 0.0, "TT")], "rank int, p double, seq string")
    writers.write_frequencies(f, f"{tmp_path}/p")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/p").collect()] == [">HAP1_0.7", "AC", ">HAP2_0.3", "GG"]
    writers.write_by_class(spark.createDataFrame([(1, "u", "A"), (2, "v", "C")], "read_id long, class string, seq string"), f"{tmp_path}/c", "class", gzip=True)
    assert {r["class"] for r in spark.read.option("basePath", f"{tmp_path}/c").text(f"{tmp_path}/c").collect()} == {"u", "v"}
    assert writers.tex_rows(m).first()[0] == "x & 1 \\\\"
