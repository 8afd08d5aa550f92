"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.functions import seq as S
from readloom.plans import adapters as A
from readloom.plans.adapters import with_
from readloom.plans.filter_queries import PAIR_SUMMARY
from readloom.plans.registry import query

AMINO = f"substr('{S.CODE}', CAST(16 * (instr('TCAG', substr(c, 1, 1)) - 1) + 4 * (instr('TCAG', substr(c, 2, 1)) - 1) + instr('TCAG', substr(c, 3, 1)) AS BIGINT), 1)"
CODONS = "regexp_extract_all(seq, '...')"
JOIN = "array_to_string({}, '')"


@query("f01_reverse_complement", with_("reads") + "SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads")
def f01(spark, sf):
    return A.reads(spark, sf).select("read_id", S.reverse_complement(F.col("seq")).alias("rc"))


@query("f02_translate", with_("reads") + f"SELECT read_id, coalesce(array_to_string(list_transform({CODONS}, lambda c: {AMINO}), ''), '') AS protein FROM reads")
def f02(spark, sf):
    return A.reads(spark, sf).select("read_id", S.translate_codons(F.col("seq")).alias("protein"))


IUPAC_SQL = "(VALUES " + ", ".join(f"('{k}', {[*v]})" for k, v in S.IUPAC.items()) + ") AS u(code, letters)"
CODON_SQL = f"""trip AS (SELECT x.code || y.code || z.code AS codon, a, b, c FROM (SELECT code, unnest(letters) AS a FROM {IUPAC_SQL}) x,
 (SELECT code, unnest(letters) AS b FROM {IUPAC_SQL}) y, (SELECT code, unnest(letters) AS c FROM {IUPAC_SQL}) z),
am AS (SELECT codon, a || b || c AS c FROM trip)"""


def _codes(spark):
    codes = spark.createDataFrame([(k,) for k in S.IUPAC], "code string")
    x, y, z = (codes.select(F.col("code").alias(n)) for n in "xyz")
    return x.join(y, F.lit(True)).join(z, F.lit(True)).select(F.concat("x", "y", "z").alias("codon"))  # 15 ** 3 rows


@query(
    "f02_f03_ambiguous_codons",
    f"WITH {CODON_SQL} SELECT codon, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(DISTINCT {AMINO}) = 1 THEN min({AMINO}) ELSE '[' || string_agg(DISTINCT {AMINO}, '' ORDER BY {AMINO}) || ']' END AS amino FROM am GROUP BY codon",
)
def f03(spark, sf):
    return _codes(spark).select("codon", F.size(S.resolve(F.col("codon"))).cast("long").alias("n"), S.amino_ambiguous(F.col("codon")).alias("amino"))


NUM = "len(list_filter(range(1, len(a) + 1), lambda i: {}))"
SPLIT = "sp AS (SELECT read_id, string_split(a, '') AS a, string_split(b, '') AS b, length(b) - length(ltrim(b, '-')) AS lead, length(rtrim(b, '-')) AS last FROM prs)"


@query(
    "f04_hamming_variants",
    with_("pairs", then=SPLIT)
    + f""", h AS (SELECT read_id, {NUM.format("a[i] <> 'N' AND b[i] <> 'N' AND a[i] <> b[i]")} AS dist, {NUM.format("a[i] <> 'N' AND b[i] <> 'N' AND a[i] = b[i]")} AS match,
 {NUM.format("a[i] <> b[i]")} AS plain, {NUM.format("a[i] <> '-' AND b[i] <> '-' AND a[i] <> b[i]")} AS gd, {NUM.format("a[i] <> '-' AND b[i] <> '-'")} AS gn FROM sp)
 SELECT read_id, CAST(dist AS BIGINT) AS dist, CAST(match AS BIGINT) AS match, CAST(plain AS BIGINT) AS plain, CASE WHEN gn > 0 THEN round(gd / gn, 6) ELSE 100.0 END AS share FROM h""",
)
def f04(spark, sf):
    a, b = F.col("a"), F.col("b")
    h = S.hamming_missing(a, b)
    return A.pairs(spark, sf).select("read_id", h["dist"].alias("dist"), h["match"].alias("match"), S.hamming(a, b).alias("plain"), F.round(S.normalised_distance(a, b), 6).alias("share"))


@query(
    "f06_f07_alignment_summary",
    with_("pairs", then=PAIR_SUMMARY)
    + "SELECT read_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CAST(ident AS BIGINT) AS ident, CAST(mismatches AS BIGINT) AS mismatches, CAST(insertions AS BIGINT) AS insertions, CAST(deletions AS BIGINT) AS deletions, CASE WHEN stop - start + 1 > 0 THEN round(ident / (stop - start + 1), 6) END AS identity FROM sm",
)
def f06(spark, sf):
    got = A.pairs(spark, sf).select("read_id", S.summary(F.col("a"), F.col("b")).alias("s")).select("read_id", "s.*")
    width = F.col("stop") - F.col("start") + 1
    return got.withColumn("identity", F.when(width > 0, F.round(F.col("ident") / width, 6)))


@query(
    "f08_mutation_list",
    with_("pairs", then=SPLIT)
    + """SELECT read_id, md5(coalesce(array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i] AND b[i] NOT IN ('-', 'N')),
 lambda i: a[i] || CAST(i AS VARCHAR) || b[i]), ','), '')) AS muts FROM sp""",
)
def f08(spark, sf):
    return A.pairs(spark, sf).select("read_id", F.md5(S.mutations(F.col("a"), F.col("b"))).alias("muts"))


@query(
    "f09_character_counts",
    with_("rows") + "SELECT read_id, " + ", ".join(f"CAST(length(seq) - length(replace(seq, '{c}', '')) AS BIGINT) AS n_{n}" for c, n in (("A", "a"), ("N", "missing"), ("-", "gap"))) + " FROM rws",
)
def f09(spark, sf):
    return A.rows(spark, sf).select("read_id", *[S.count_char(F.col("seq"), c).cast("long").alias(f"n_{n}") for c, n in (("A", "a"), ("N", "missing"), ("-", "gap"))])


@query(
    "f11_iupac_encode",
    with_("bases")
    + f", s AS (SELECT pos, string_agg(DISTINCT base, '' ORDER BY base) AS letters FROM bases WHERE base NOT IN ('-', 'N') GROUP BY pos) SELECT pos, code FROM s JOIN (SELECT code, array_to_string(letters, '') AS l FROM {IUPAC_SQL}) u ON u.l = s.letters",
)
def f11(spark, sf):
    sets = A.bases(spark, sf).where(~F.col("base").isin("-", "N")).groupBy("pos").agg(F.collect_set("base").alias("letters"))
    return sets.select("pos", S.iupac_of(F.col("letters")).alias("code"))


@query(
    "f12_flanks",
    with_("rows")
    + "SELECT read_id, CASE WHEN trim(seq, '-') = '' THEN 0 ELSE CAST(length(seq) - length(ltrim(seq, '-')) + 1 AS BIGINT) END AS first, CAST(length(rtrim(seq, '-')) AS BIGINT) AS last, CAST(length(replace(seq, '-', '')) AS BIGINT) AS letters FROM rws",
)
def f12(spark, sf):
    first, last = S.inner(F.col("seq"))
    return A.rows(spark, sf).select("read_id", first.cast("long").alias("first"), last.cast("long").alias("last"), F.length(F.replace("seq", F.lit("-"), F.lit(""))).cast("long").alias("letters"))


@query("f19_generic", "SELECT p_partkey, trim('  ' || p_brand || ' ') AS brand, floor(p_retailprice + 0.5) AS rounded, round(pow(2.0, p_size % 10), 6) AS expo FROM part")
def f19(spark, sf):
    p = A.table(spark, sf, "part")
    return p.select(
        "p_partkey", F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("brand"), F.floor(F.col("p_retailprice") + 0.5).cast("double").alias("rounded"), F.round(F.pow(F.lit(2.0), F.col("p_size") % 10), 6).alias("expo")
    )


@query(
    "f20_combinatorics",
    "SELECT n, k, CAST(factorial(n) AS BIGINT) AS fact, CAST(round(factorial(n) / (factorial(k) * factorial(n - k))) AS BIGINT) AS binom, lpad(bin(n), 8, '0') AS bits FROM (SELECT CAST(n AS INTEGER) AS n, CAST(k AS INTEGER) AS k FROM range(0, 16) a(n), range(0, 16) b(k) WHERE k <= n)",
)
def f20(spark, sf):
    n = spark.range(16).select(F.col("id").cast("int").alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    fact = F.factorial
    return n.select("n", "k", fact("n").alias("fact"), F.expr("factorial(n) div (factorial(k) * factorial(n - k))").alias("binom"), F.lpad(F.bin("n"), 8, "0").alias("bits"))


@query(
    "f21_ambiguous_string",
    """WITH r AS (SELECT item_id, regexp_extract_all(regexp_replace(text, '([aeiou]+)', '[\\1]', 'g'), '\\[[^\\]]*\\]|.', 0, 's') AS p FROM benchmark)
 SELECT item_id, CAST(len(p) AS BIGINT) AS places, md5(array_to_string(list_transform(p, lambda x: replace(replace(x, '[', ''), ']', '')), '|')) AS letters FROM r""",
)
def f21(spark, sf):
    marked = F.regexp_replace("text", "([aeiou]+)", "[$1]")
    blocks = F.transform(F.regexp_extract_all(marked, F.lit(r"(?s)\[[^\]]*\]|."), F.lit(0)), lambda x: F.translate(x, "[]", ""))
    return A.table(spark, sf, "benchmark").select("item_id", F.size(blocks).cast("long").alias("places"), F.md5(F.array_join(blocks, "|")).alias("letters"))


@query("f22_frame_cut", with_("reads") + "SELECT read_id, md5(substr(seq, CASE start % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END)) AS cut FROM reads")
def f22(spark, sf):
    return A.reads(spark, sf).select("read_id", F.md5(S.cut_frame(F.col("seq"), F.col("start"))).alias("cut"))


@query(
    "f22_best_frame",
    with_("reads")
    + f""", f AS (SELECT read_id, k, len(list_filter(regexp_extract_all(substr(seq, k + 1), '...'), lambda c: c IN ('TAA', 'TAG', 'TGA'))) AS stops FROM reads, range(0, 3) t(k) WHERE len >= 5)
 SELECT read_id, CAST(arg_min(k, stops * 10 + k) AS BIGINT) AS frame, CAST(min(stops) AS BIGINT) AS stops FROM f GROUP BY read_id""",
)
def f22b(spark, sf):
    r = A.reads(spark, sf).where("len >= 5")
    stop = lambda k: F.size(F.filter(S.codons(F.substring(F.col("seq"), F.lit(k + 1), F.length("seq"))), lambda c: c.isin("TAA", "TAG", "TGA")))
    best = F.array_min(F.array(*[F.struct(stop(k).alias("stops"), F.lit(k).alias("frame")) for k in range(3)]))
    return r.select("read_id", best.alias("b")).select("read_id", F.col("b.frame").cast("long").alias("frame"), F.col("b.stops").cast("long").alias("stops"))


@query("f23_dot_product", "SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f23(spark, sf):
    e = A.table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    dot = F.aggregate(F.zip_with("embedding", "other", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return e.join(nxt, "vec_id").select("vec_id", F.round(dot, 6).alias("score"))


@query(
    "f26_reference_backfill",
    with_("pairs", then=SPLIT)
    + """SELECT read_id, md5(coalesce(array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: i > lead AND i <= last AND a[i] <> '-'),
 lambda i: CASE WHEN b[i] = '-' THEN a[i] ELSE b[i] END), ''), '')) AS filled FROM sp""",
)
def f26(spark, sf):
    return A.pairs(spark, sf).select("read_id", F.md5(S.backfill(F.col("a"), F.col("b"))).alias("filled"))


@query(
    "f27_protein_layout",
    with_("reads")
    + f""", c AS (SELECT read_id, (start + 2) // 3 AS codon, seq, CAST(length(seq) AS INTEGER) AS len FROM (SELECT read_id, start, substr(seq, CASE start % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END) AS seq FROM reads)),
 p AS (SELECT read_id, codon, coalesce(array_to_string(list_transform({CODONS}, lambda c: {AMINO}), ''), '') AS protein FROM c),
 w AS (SELECT max(codon + length(protein)) AS width FROM p)
 SELECT read_id, md5(rpad(repeat('-', CAST(codon AS BIGINT)) || protein, CAST(width AS INTEGER), '-')) AS row, row_number() OVER (ORDER BY codon, read_id) AS place FROM p, w""",
)
def f27(spark, sf):
    from readloom.operators.align import protein_layout

    return protein_layout(A.reads(spark, sf)).select("read_id", F.md5("row").alias("row"), "place")


@query("f05_packed_hamming", with_("pairs", then=SPLIT) + f"SELECT read_id, CAST({NUM.format("a[i] <> 'N' AND b[i] <> 'N' AND a[i] <> b[i]")} AS BIGINT) AS dist FROM sp")
def f05(spark, sf):
    return A.pairs(spark, sf).select("read_id", S.packed_hamming(S.pack(F.col("a")), S.pack(F.col("b"))).alias("dist"))
