"""Queries of readers and writers: tables written in a format and read back, and parsers over lines made of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.operators.state import temporary as scratch
from readloom.plans import adapters as A
from readloom.plans.adapters import with_
from readloom.plans.registry import query
from readloom.sources import readers, writers


@query("s01_k01_fasta", with_("reads") + "SELECT CAST(read_id AS VARCHAR) AS read_id, md5(seq) AS seq FROM reads")
def s01(spark, sf):
    path = scratch(spark, "fasta")
    writers.write_fasta(A.reads(spark, sf), path)
    return readers.fasta(spark, path).select("read_id", F.md5("seq").alias("seq"))


@query("s02_fasta_with_start", with_("reads") + "SELECT CAST(read_id AS VARCHAR) AS read_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM reads")
def s02(spark, sf):
    path = scratch(spark, "start")
    writers.write_fasta(A.reads(spark, sf).withColumn("name", F.concat_ws(" ", F.col("read_id").cast("string"), F.col("start").cast("string"))), path, name="name", gzip=True)
    return readers.fasta_with_start(spark, path).select("read_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query("s04_k02_read_lines", with_("reads") + "SELECT CAST(start AS BIGINT) AS start, md5(seq) AS seq, CAST(len AS BIGINT) AS len FROM reads")
def s04(spark, sf):
    path = scratch(spark, "reads")
    writers.write_reads(A.reads(spark, sf), path)
    return readers.reads(spark, path).select(F.col("start").cast("long").alias("start"), F.md5("seq").alias("seq"), F.col("len").cast("long").alias("len"))


@query(
    "s05_simulated_headers",
    with_("reads") + "SELECT CAST(read_id AS VARCHAR) AS read_id, CASE WHEN read_id % 2 = 0 THEN 'forward' ELSE 'reverse' END AS dir, md5(CASE WHEN read_id % 2 = 0 THEN seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END) AS seq FROM reads",
)
def s05(spark, sf):
    path = scratch(spark, "simulated")
    way = F.when(F.col("read_id") % 2 == 0, "forward").otherwise("reverse")
    head = F.concat_ws("|", F.col("read_id").cast("string"), F.lit("beg"), F.col("start").cast("string"), F.lit("length"), F.col("len").cast("string"), way, F.lit("src"))
    writers.write_fasta(A.reads(spark, sf).withColumn("name", head), path, name="name")
    return readers.simulated_fasta(spark, path).select("read_id", "dir", F.md5("seq").alias("seq"))


def _sam(spark, sf):
    """Reads as alignment lines: every third one with an insertion, a deletion and a clip."""
    path = scratch(spark, "sam")
    r = A.reads(spark, sf).where("len >= 20")
    cigar = F.when(F.col("read_id") % 3 == 0, F.concat(F.lit("2S5M1I3D"), (F.col("len") - 8).cast("string"), F.lit("M"))).otherwise(F.concat(F.col("len").cast("string"), F.lit("M")))
    flag = F.when(F.col("read_id") % 7 == 0, 4).when(F.col("read_id") % 2 == 0, 0).otherwise(16)
    line = F.concat_ws("\t", F.col("read_id").cast("string"), flag.cast("string"), F.lit("ref"), (F.col("start") + 1).cast("string"), F.lit("60"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*"), F.lit("NM:i:0"))
    r.select(line.alias("value")).write.text(path)
    return readers.sam(spark, path)


SAM = "sm AS (SELECT read_id, start, seq, len, read_id % 3 = 0 AS cut, read_id % 7 = 0 AS unmapped, CASE WHEN read_id % 7 = 0 THEN false ELSE read_id % 2 <> 0 END AS is_reverse FROM reads WHERE len >= 20)"


@query("s07_s08_p11_sam_region", with_("reads", then=SAM) + "SELECT CAST(read_id AS VARCHAR) AS qname, CAST(start AS BIGINT) AS pos FROM sm WHERE NOT unmapped AND is_reverse AND start < 60 AND start + CASE WHEN cut THEN len ELSE len END > 30 AND len - CASE WHEN cut THEN 3 ELSE 0 END >= 25")
def s07(spark, sf):
    return readers.sam_region(_sam(spark, sf), "ref", 30, 60, 25, "-").select("qname", F.col("pos").cast("long").alias("pos"))


@query(
    "f13_f14_cigar_window",
    with_("reads", then=SAM)
    + """, x AS (SELECT read_id, start, CASE WHEN cut THEN substr(seq, 3, 5) || '---' || substr(seq, 9) ELSE seq END AS al FROM sm)
 SELECT CAST(read_id AS VARCHAR) AS qname, rpad(repeat('n', least(greatest(start - 10, 0), 80)) || substr(al, greatest(10 - start, 0) + 1, greatest(80 - greatest(start - 10, 0), 0)), 80, 'n') AS row FROM x""",
)
def f14(spark, sf):
    return readers.sam_rows(_sam(spark, sf), 10, 89)


@query("s13_quality_scores", "SELECT CAST(doc_id AS VARCHAR) AS read_id, CAST(list_sum(list_transform(string_split(text, ''), lambda c: ascii(c) % 41)) AS BIGINT) AS total, CAST(length(text) AS BIGINT) AS n FROM documents WHERE length(text) > 0")
def s13(spark, sf):
    from readloom.plans.filter_queries import quality_rows

    path = scratch(spark, "qual")
    q = quality_rows(spark, sf).select(F.concat(F.lit(">"), F.col("read_id").cast("string"), F.lit("\n"), F.array_join(F.transform("qual", lambda x: x.cast("string")), " ")).alias("value"))
    q.write.text(path)
    back = readers.quality(spark, path)
    return back.select("read_id", F.aggregate("qual", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("qual").cast("long").alias("n"))


def native_lines(spark, sf):
    """Orders as lines of a native aligner, written and read back."""
    path = scratch(spark, "native")
    o = A.table(spark, sf, "orders")
    mark = F.when(F.col("o_orderstatus") == "F", "U").when(F.col("o_orderstatus") == "O", "NM").otherwise("QC")
    o.select(F.concat_ws("\t", F.concat(F.lit(">"), F.col("o_orderkey").cast("string")), F.lit("S"), F.lit("ACGT"), F.lit("."), mark, F.floor("o_totalprice").cast("string")).alias("value")).write.text(path)
    return readers.native_alignments(spark, path)


@query("s15_p21_native_alignments", "SELECT CASE o_orderstatus WHEN 'F' THEN 'unique' WHEN 'O' THEN 'no match' ELSE 'low quality' END AS status, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM orders GROUP BY 1")
def s15(spark, sf):
    return native_lines(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_unique").cast("long")).alias("kept"))


@query("s17_trace", "SELECT CAST(event_id AS BIGINT) AS iter, CAST(user_id % 100 AS BIGINT) AS class, round(value, 6) AS theta FROM events")
def s17(spark, sf):
    path = scratch(spark, "trace")
    e = A.table(spark, sf, "events")
    e.select(F.concat_ws("\t", F.col("event_id").cast("string"), (F.col("user_id") % 100).cast("string"), F.lit("1"), F.col("value").cast("string"), F.lit("0.9")).alias("value")).write.text(path)
    return readers.trace(spark, path).select(F.col("iter").cast("long").alias("iter"), F.col("class").cast("long").alias("class"), F.round("theta", 6).alias("theta"))


@query("s18_support_headers", "SELECT 'h' || CAST(p_partkey AS VARCHAR) AS hap, round(p_size / 100.0, 6) AS posterior, round(p_retailprice, 4) AS ave_reads FROM part")
def s18(spark, sf):
    path = scratch(spark, "support")
    p = A.table(spark, sf, "part")
    head = F.concat(F.lit("h"), F.col("p_partkey").cast("string"), F.lit("|posterior="), F.round(F.col("p_size") / 100, 6).cast("string"), F.lit(" ave_reads="), F.col("p_retailprice").cast("string"))
    writers.write_fasta(p.select(head.alias("name"), F.lit("ACGT").alias("seq")), path, name="name")
    return readers.support_fasta(spark, path).select("hap", F.round("posterior", 6).alias("posterior"), F.round("ave_reads", 4).alias("ave_reads"))


@query("s19_a30_savings", "SELECT CAST(l_orderkey AS VARCHAR) AS read_id, max(l_quantity) AS savings FROM lineitem GROUP BY l_orderkey")
def s19(spark, sf):
    path = scratch(spark, "savings")
    A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("Sequence"), F.col("l_quantity").alias("Savings")).write.csv(path, sep="\t", header=True)
    return readers.savings(spark, path)


@query("s20_coordinates", "SELECT CAST(p_partkey AS VARCHAR) AS read_id, CAST(p_size AS BIGINT) AS x, CAST(floor(p_retailprice) AS BIGINT) AS y FROM part")
def s20(spark, sf):
    path = scratch(spark, "flow")
    p = A.table(spark, sf, "part")
    head = F.concat(F.col("p_partkey").cast("string"), F.lit(" xy="), F.col("p_size").cast("string"), F.lit("_"), F.floor("p_retailprice").cast("string"))
    writers.write_fasta(p.select(head.alias("name"), F.lit("ACGT").alias("seq")), path, name="name")
    return readers.flow_coordinates(spark, path).select("read_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query("s21_feature_table", "SELECT p_brand AS label, round(p_size + p_retailprice, 4) AS total FROM part")
def s21(spark, sf):
    path = scratch(spark, "features")
    A.table(spark, sf, "part").select("p_brand", "p_size", "p_retailprice").write.csv(path, sep=" ", header=True)
    f = readers.feature_table(spark, path)
    return f.select("label", F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("s22_amplicons", "SELECT CAST(s_suppkey AS VARCHAR) AS name, CAST(s_nationkey AS VARCHAR) AS forward, 'x' AS reverse FROM supplier")
def s22(spark, sf):
    path = scratch(spark, "amplicons")
    s = A.table(spark, sf, "supplier")
    s.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal", F.lit("x").alias("last")).write.csv(path, header=True)
    return readers.amplicons(spark, path)


@query("k08_cross_table", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY l_returnflag")
def k08(spark, sf):
    return writers.cross_table(A.table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"]).select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o"))


@query("k09_entropy_outliers", with_("bases", then="c AS (SELECT pos, base, count(*) AS n FROM bases WHERE base IN ('A','C','G','T') GROUP BY ALL)") + "SELECT pos, " + ", ".join(f"floor(100.0 * coalesce(sum(CASE WHEN base = '{b}' THEN n END), 0) / sum(n) + 0.5) / 100 AS {b.lower()}" for b in "ACGT") + " FROM c GROUP BY pos")
def k09(spark, sf):
    c = A.bases(spark, sf).where(F.col("base").isin(*"ACGT")).groupBy("pos").pivot("base", list("ACGT")).count().fillna(0)
    total = sum((F.col(b) for b in "ACGT"), F.lit(0))
    return c.select("pos", *[(F.floor(F.lit(100.0) * F.col(b) / total + 0.5) / 100).alias(b.lower()) for b in "ACGT"])


@query("k10_s09_by_class", with_("rows") + "SELECT lang, count(*) AS n FROM rws WHERE length(seq) > 0 GROUP BY lang")
def k10(spark, sf):
    path = scratch(spark, "classes")
    writers.write_by_class(A.rows(spark, sf).where("length(seq) > 0"), path, "lang")
    back = spark.read.option("basePath", path).option("lineSep", "\n>").text(path)
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("k11_coverage_file", with_("reads") + "SELECT pos + 1 AS pos, count(*) AS cov FROM (SELECT unnest(range(start, stop + 1)) AS pos FROM reads) GROUP BY pos")
def k11(spark, sf):
    from readloom.operators.aggregates import coverage

    path = scratch(spark, "covprof")
    coverage(A.reads(spark, sf)).select((F.col("pos") + 1).alias("pos"), "cov").write.csv(path, sep="\t")
    return spark.read.csv(path, sep="\t", schema="pos long, cov long")


@query("k13_matrix_cells", "SELECT n_nationkey::BIGINT AS k, coalesce(CAST(CASE WHEN n_regionkey = 0 THEN NULL ELSE n_regionkey END AS VARCHAR), 'undef') AS cell FROM nation")
def k13(spark, sf):
    path = scratch(spark, "matrix")
    n = A.table(spark, sf, "nation").select("n_nationkey", F.when(F.col("n_regionkey") != 0, F.col("n_regionkey")).alias("cell"))
    writers.write_table(n, path)
    return spark.read.csv(path, sep="\t", header=True).select(F.col("n_nationkey").cast("long").alias("k"), "cell")


@query("k07_haplotype_shares", with_("reads") + "SELECT md5(seq) AS hap, round(count(*) / (SELECT count(*) FROM reads), 9) AS share FROM reads GROUP BY seq")
def k07(spark, sf):
    c = A.reads(spark, sf).groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("t")).scalar()
    return c.select(F.md5("seq").alias("hap"), F.round(F.col("n") / total, 9).alias("share"))


# records that span lines, lists, broken lines


@query("s03_commented_fasta", with_("reads") + "SELECT CAST(read_id AS VARCHAR) AS read_id, CAST(read_id AS VARCHAR) || ' made up' AS descr, md5(seq) AS seq FROM reads")
def s03(spark, sf):
    path = scratch(spark, "commented")
    half = F.floor(F.col("len") / 2).cast("int")
    text = F.concat(F.lit(">"), F.col("read_id").cast("string"), F.lit(" made up\r\n"), F.substring(F.col("seq"), F.lit(1), half), F.lit("\r\n# a comment\r\n"), F.substring(F.col("seq"), half + 1, F.col("len")), F.lit("\r"))
    A.reads(spark, sf).select(text.alias("value")).write.text(path)
    return readers.fasta(spark, path).select("read_id", "descr", F.md5("seq").alias("seq"))


@query("s06_sequence_lists", with_("reads") + "SELECT '4:' || CAST(read_id AS VARCHAR) || ':' || CAST(start AS VARCHAR) || ':' || CAST(len AS VARCHAR) AS read_id, md5(seq) AS seq FROM reads")
def s06(spark, sf):
    path = scratch(spark, "lists")
    A.reads(spark, sf).select(F.concat_ws("\t", F.lit("4"), F.col("read_id").cast("string"), F.col("start").cast("string"), F.col("len").cast("string"), "seq").alias("value")).write.text(path)
    return readers.sequence_lists(spark, path).select("read_id", F.md5("seq").alias("seq"))


@query("s08_broken_lines", with_("reads") + "SELECT 'read_x' || CAST(read_id AS VARCHAR) AS qname, CAST(start AS BIGINT) AS pos, md5(seq) AS seq, CAST(len AS BIGINT) AS n FROM reads")
def s08(spark, sf):
    path = scratch(spark, "broken")
    half = F.floor(F.col("len") / 2).cast("int")
    quality = F.concat(F.repeat(F.lit("I"), half), F.when(F.col("read_id") % 2 == 0, "\n").otherwise(""), F.repeat(F.lit("I"), F.col("len") - half))
    line = F.concat_ws("\t", F.concat(F.lit("read_x"), F.col("read_id").cast("string")), F.lit("0"), F.lit("ref"), (F.col("start") + 1).cast("string"), F.lit("60"), F.concat(F.col("len").cast("string"), F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), "seq", quality)
    A.reads(spark, sf).select(line.alias("value")).write.text(path)
    return readers.sam(spark, path, broken=True).select("qname", F.col("pos").cast("long").alias("pos"), F.md5("seq").alias("seq"), F.length("qual").cast("long").alias("n"))


@query("s16_short_alignments", with_("pairs") + "SELECT CAST(read_id AS VARCHAR) AS read_id, CAST(read_id % 50 AS BIGINT) AS start, md5(a) AS ref, md5(b) AS read FROM prs WHERE length(a) > 0")
def s16(spark, sf):
    path = scratch(spark, "short")
    A.pairs(spark, sf).where("length(a) > 0").select(F.concat_ws(" ", F.col("read_id").cast("string"), (F.col("read_id") % 50 + 3).cast("string"), "a", "b").alias("value")).write.text(path)
    return readers.short_alignments(spark, path, shift=3).select("read_id", F.col("start").cast("long").alias("start"), F.md5("ref").alias("ref"), F.md5("read").alias("read"))


@query("s14_k12_alignment_files", with_("haps") + ", m AS (SELECT max(length(seq)) AS m FROM haps) SELECT kind, 'h' || CAST(hap_id AS VARCHAR) AS name, rpad(seq, CAST(m AS INTEGER), '-') AS row FROM haps, m, (SELECT unnest(['clustal', 'phylip', 'stockholm']) AS kind) WHERE length(seq) > 0")
def s14(spark, sf):
    h = A.haps(spark, sf).where("length(seq) > 0")
    size = h.agg(F.max(F.length("seq"))).first()[0] or 0
    rows, out = h.select(F.concat(F.lit("h"), F.col("hap_id").cast("string")).alias("name"), F.rpad("seq", size, "-").alias("row")), None
    for kind in ("clustal", "phylip", "stockholm"):
        path = scratch(spark, kind)
        writers.write_msa(rows, path, kind)
        back = readers.alignments(spark, path, kind).select(F.lit(kind).alias("kind"), "name", "row")
        out = back if out is None else out.unionByName(back)
    return out


@query("s17_frequency_table", "SELECT 'h' || CAST(p_partkey AS VARCHAR) AS hap, CAST(p_size AS DOUBLE) AS support, CAST(2 * p_size + 1 AS BIGINT) AS reads FROM part")
def s17f(spark, sf):
    path = scratch(spark, "freq")
    p = A.table(spark, sf, "part")
    p.select(F.concat_ws("\t", F.concat(F.lit("h"), F.col("p_partkey").cast("string")), F.col("p_size").cast("string"), F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string")).alias("value")).write.text(path)
    return readers.frequency_table(spark, path).select("hap", "support", F.aggregate("reads", F.lit(0).cast("long"), lambda a, x: a + x).alias("reads"))


@query("s17_property_lines", "SELECT floor(o_totalprice) AS value FROM orders")
def s17p(spark, sf):
    path = scratch(spark, "made")
    A.table(spark, sf, "orders").select(F.explode(F.array(F.concat(F.lit("#made "), F.floor("o_totalprice").cast("string")), F.lit("#other 12"), F.lit("some line"))).alias("value")).write.text(path)
    return readers.property_line(spark, path, "made")


def _posterior_files(spark, sf):
    """Posterior files of made-up windows: parts as haplotypes, orders as corrected reads, events as history."""
    path = scratch(spark, "posterior")
    p, o, e = (A.table(spark, sf, n) for n in ("part", "orders", "events"))
    corrected = o.select((F.col("o_custkey") % 5).alias("wstart"), F.col("o_orderkey").cast("string").alias("read_id"), (F.col("o_orderkey") % 100 / 100).alias("posterior"), F.lit("ACGT" * 20).alias("hap"))
    support = p.select((F.col("p_size") % 5).alias("wstart"), F.col("p_partkey").alias("rank"), (F.col("p_size") / 100).alias("posterior"), F.col("p_retailprice").alias("ave_reads"), F.lit("ACGT").alias("hap"))
    history = e.groupBy((F.col("user_id") % 5).alias("wstart"), F.col("event_type").alias("hap"), (F.col("event_id") % 20).alias("iter")).agg(F.count(F.lit(1)).alias("weight"))
    writers.write_posterior(corrected, support, history, path)
    return path


@query("k03_support_files", "SELECT 'hap_' || CAST(p_partkey AS VARCHAR) AS hap, round(p_size / 100.0, 6) AS posterior, round(p_retailprice, 4) AS ave_reads FROM part")
def k03(spark, sf):
    got = readers.support_fasta(spark, f"{_posterior_files(spark, sf)}/support/*")
    return got.select("hap", F.round("posterior", 6).alias("posterior"), F.round("ave_reads", 4).alias("ave_reads"))


@query("k03_frequency_files", "SELECT CAST(user_id % 5 AS BIGINT) AS wstart, event_type AS hap, CAST(count(DISTINCT event_id % 20) AS DOUBLE) AS support, count(*) AS reads FROM events GROUP BY 1, 2")
def k03f(spark, sf):
    path = _posterior_files(spark, sf)
    one = lambda w: readers.frequency_table(spark, f"{path}/freq/wstart={w}").select(F.lit(w).cast("long").alias("wstart"), "hap", "support", F.aggregate("reads", F.lit(0).cast("long"), lambda a, x: a + x).alias("reads"))
    out = one(0)
    for w in range(1, 5):
        out = out.unionByName(one(w))
    return out


@query("k03_corrected_files", "SELECT CAST(o_orderkey AS VARCHAR) AS read_id, round(o_orderkey % 100 / 100.0, 6) AS posterior, 80 AS n FROM orders")
def k03c(spark, sf):
    got = readers.support_fasta(spark, f"{_posterior_files(spark, sf)}/corrected/*")
    return got.select(F.col("hap").alias("read_id"), F.round("posterior", 6).alias("posterior"), F.length("seq").alias("n"))


@query("k06_gzip_by_kind", "SELECT 'freq' AS kind, count(*) AS n FROM part UNION ALL SELECT 'sampling', count(*) FROM events")
def k06(spark, sf):
    path = scratch(spark, "kinds")
    writers.write_kinds({"freq": A.table(spark, sf, "part").select(F.col("p_name").alias("value")), "sampling": A.table(spark, sf, "events").select(F.col("value").cast("string").alias("value"))}, path)
    return spark.read.option("basePath", path).text(f"{path}/*").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("k08_text_forms", "SELECT p_brand || ' & ' || CAST(count(*) AS VARCHAR) || ' \\\\' AS tex, p_brand || ' seen ' || CAST(count(*) AS VARCHAR) || ' times' AS human FROM part GROUP BY p_brand")
def k08t(spark, sf):
    c = A.table(spark, sf, "part").groupBy(F.col("p_brand").alias("mutation")).agg(F.count(F.lit(1)).alias("n"))
    named = lambda rows, to: rows.select(F.regexp_extract("value", r"^(\S+)", 1).alias("k"), F.col("value").alias(to))
    return named(writers.tex_rows(c), "tex").join(named(writers.human_rows(c), "human"), "k").drop("k")


# reads laid on a reference


PERIOD = "ACGTTGCA"
LAID = f"""lr AS (SELECT read_id, start, len, CASE WHEN read_id % 2 = 0 THEN substr(seq, 1, 4) || substr(repeat('{PERIOD}', 4000), start + 5, 2) || substr(seq, 5, 6) || '---' || substr(seq, 11) ELSE seq END AS al FROM reads WHERE len >= 20)"""


@query(
    "f13_p19_reference_rows",
    with_("reads", then=LAID)
    + """, cut AS (SELECT read_id, rpad(repeat('-', greatest(start - 10, 0)) || substr(al, greatest(10 - start, 0) + 1, 80 - greatest(start - 10, 0)), 80, '-') AS row
 FROM lr WHERE start <= 89 AND start + length(al) - 1 >= 10) SELECT CAST(read_id AS VARCHAR) AS qname, row FROM cut WHERE length(trim(row, '-')) >= 30""",
)
def f13(spark, sf):
    path = scratch(spark, "laid")
    r = A.reads(spark, sf).where("len >= 20")
    cigar = F.when(F.col("read_id") % 2 == 0, F.concat(F.lit("4M2D6M3D"), (F.col("len") - 10).cast("string"), F.lit("M"))).otherwise(F.concat(F.col("len").cast("string"), F.lit("M")))
    r.select(F.concat_ws("\t", F.col("read_id").cast("string"), F.lit("0"), F.lit("ref"), (F.col("start") + 1).cast("string"), F.lit("60"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*")).alias("value")).write.text(path)
    return readers.sam_on_reference(readers.sam(spark, path), PERIOD * 4000, 10, 90)


@query(
    "f15_f25_insertion_columns",
    with_("reads", then=SAM)
    + """, x AS (SELECT read_id, start, cut, CASE WHEN cut THEN substr(seq, 3, 5) || 'nnn' || substr(seq, 9) ELSE seq END AS al,
  CASE WHEN cut AND start + 5 >= 10 AND start + 6 < 89 THEN start - 5 END AS pl, substr(seq, 8, 1) AS ins FROM sm WHERE NOT unmapped),
 r AS (SELECT read_id, pl, ins, rpad(repeat('n', least(greatest(start - 10, 0), 80)) || substr(al, greatest(10 - start, 0) + 1, greatest(80 - greatest(start - 10, 0), 0)), 80, 'n') AS row FROM x),
 o AS (SELECT coalesce(list(DISTINCT pl), []) AS opened FROM r WHERE pl IS NOT NULL)
 SELECT CAST(read_id AS VARCHAR) AS read_id, translate(array_to_string(list_transform(range(0, 80), lambda i: CASE WHEN list_contains(opened, CAST(i AS INTEGER)) THEN CASE WHEN pl = i THEN ins ELSE '-' END ELSE '' END || substr(row, i + 1, 1)), ''), 'n', '-') AS row FROM r, o""",
)
def f25(spark, sf):
    from readloom.operators.align import spread_insertions

    return spread_insertions(readers.sam_with_insertions(_sam(spark, sf), 10, 89), 80)
