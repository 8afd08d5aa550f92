"""Queries of the predicates and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.functions import seq as S
from readloom.operators import filters as P
from readloom.plans import adapters as A
from readloom.plans.adapters import with_
from readloom.plans.registry import query

GAPS = "(length(seq) - length(replace(seq, '{c}', '')))"
L = lambda c: F.col(c).cast("long").alias(c)


@query("p01_min_length", with_("reads") + "SELECT read_id, CAST(len AS BIGINT) AS len FROM reads WHERE len >= 160")
def p01(spark, sf):
    return P.min_length(A.reads(spark, sf)).select("read_id", L("len"))


PAIR_SUMMARY = """sm AS (
 SELECT read_id, start, stop,
  len(list_filter(range(start, stop + 1), lambda i: a[i] = b[i] AND a[i] <> '-')) AS ident,
  len(list_filter(range(start, stop + 1), lambda i: a[i] <> b[i] AND a[i] NOT IN ('-', 'N') AND b[i] NOT IN ('-', 'N'))) AS mismatches,
  len(list_filter(range(start, stop + 1), lambda i: a[i] = '-' AND b[i] <> '-')) AS insertions,
  len(list_filter(range(start, stop + 1), lambda i: a[i] <> '-' AND b[i] = '-')) AS deletions
 FROM (SELECT read_id, string_split(a, '') AS a, string_split(b, '') AS b,
  greatest(CASE WHEN rtrim(a, '-') = '' THEN 0 ELSE length(a) - length(ltrim(a, '-')) + 1 END, CASE WHEN rtrim(b, '-') = '' THEN 0 ELSE length(b) - length(ltrim(b, '-')) + 1 END) AS start,
  least(length(rtrim(a, '-')), length(rtrim(b, '-'))) AS stop FROM prs))"""


@query(
    "p02_identity_filter",
    with_("pairs", then=PAIR_SUMMARY) + "SELECT read_id, CAST(ident AS BIGINT) AS ident FROM sm WHERE ident + mismatches + insertions > 0 AND ident / (ident + mismatches + insertions) > 0.2",
)
def p02(spark, sf):
    kept = P.by_identity(A.pairs(spark, sf), 0.2)
    return kept.select("read_id", S.summary(F.col("a"), F.col("b"))["ident"].alias("ident"))


@query("p03_ambiguity_filter", with_("rows") + "SELECT read_id FROM rws WHERE " + GAPS.format(c="N") + " <= 2")
def p03(spark, sf):
    return P.few_ambiguous(A.rows(spark, sf)).select("read_id")


@query("p05_posterior_filter", "SELECT event_id AS read_id, value AS posterior FROM events WHERE value > 0.8")
def p05(spark, sf):
    return P.by_posterior(A.table(spark, sf, "events").select(F.col("event_id").alias("read_id"), F.col("value").alias("posterior")))


@query("p06_interior_uncovered", with_("rows") + "SELECT read_id FROM rws WHERE length(trim(seq, 'N')) > 0 AND length(trim(seq, 'N')) - length(replace(trim(seq, 'N'), 'N', '')) <= 10")
def p06(spark, sf):
    return P.interior_uncovered(A.rows(spark, sf), 10, "N").select("read_id")


@query(
    "p07_p08_support_filter",
    with_("reads") + "SELECT seq AS hap, count(*) AS support FROM reads GROUP BY seq HAVING count(*) >= 0.002 * (SELECT count(*) FROM reads)",
)
def p07(spark, sf):
    r = A.reads(spark, sf)
    total = r.agg(F.count(F.lit(1)).alias("n")).scalar()
    return r.groupBy(F.col("seq").alias("hap")).agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= F.lit(0.002) * total)


QUAL = "list_transform(string_split(text, ''), lambda c: ascii(c) % 41)"


def quality_rows(spark, sf):
    """(read_id, seq, qual): phred scores read off the text's own characters."""
    docs = A.table(spark, sf, "documents").where("length(text) > 0")
    return docs.select(F.col("doc_id").alias("read_id"), F.col("text").alias("seq"), F.transform(F.split("text", ""), lambda c: F.ascii(c) % 41).alias("qual"))


@query(
    "p09_quality_mask",
    "SELECT doc_id AS read_id, md5(list_aggregate(list_transform(string_split(text, ''), lambda c: CASE WHEN ascii(c) % 41 < 6 THEN 'N' ELSE c END), 'string_agg', '')) AS masked FROM documents WHERE length(text) > 0",
)
def p09(spark, sf):
    masked = F.zip_with(F.split("seq", ""), "qual", lambda b, q: F.when(q < 6, F.lit("N")).otherwise(b))
    return quality_rows(spark, sf).select("read_id", F.md5(F.array_join(masked, "")).alias("masked"))


@query("p10_ambiguous_share", with_("rows") + "SELECT read_id FROM rws WHERE " + GAPS.format(c="N") + " < length(seq) * 0.1")
def p10(spark, sf):
    return P.ambiguous_share(A.rows(spark, sf), 0.1).select("read_id")


@query(
    "p12_min_quality_semi_join",
    with_("reads") + f"SELECT read_id FROM reads WHERE read_id IN (SELECT doc_id FROM documents WHERE length(text) > 0 AND list_min({QUAL}) >= 0 AND list_avg({QUAL}) >= 15)",
)
def p12(spark, sf):
    mean = F.aggregate("qual", F.lit(0).cast("double"), lambda a, q: a + q) / F.size("qual")
    good = quality_rows(spark, sf).where((F.array_min("qual") >= 0) & (mean >= 15)).select("read_id")
    return A.reads(spark, sf).join(good, "read_id", "left_semi").select("read_id")


@query("p13_gap_share", with_("rows") + "SELECT read_id FROM rws WHERE length(seq) > 0 AND " + GAPS.format(c="-") + " < length(seq) * 0.18")
def p13(spark, sf):
    return P.gap_share(A.rows(spark, sf), 0.18).select("read_id")


@query("p14_column_slice", with_("rows") + "SELECT read_id, substr(seq, 11, 40) AS seq FROM rws")
def p14(spark, sf):
    return P.column_slice(A.rows(spark, sf), 10, 50).select("read_id", "seq")


@query("p15_lowest_quality", f"SELECT doc_id AS read_id, CAST(list_position({QUAL}, list_min({QUAL})) - 1 AS BIGINT) AS at FROM documents WHERE length(text) > 0")
def p15(spark, sf):
    return quality_rows(spark, sf).select("read_id", P.lowest_quality(F.col("qual")).alias("at"))


@query("p16_indel_filter", with_("pairs", then=PAIR_SUMMARY) + "SELECT read_id FROM sm WHERE insertions + deletions <= 100")
def p16(spark, sf):
    indels = S.let(S.summary(F.col("a"), F.col("b")), lambda s: s["insertions"] + s["deletions"])
    return A.pairs(spark, sf).where(indels <= 100).select("read_id")


@query(
    "p17_predicate_builder",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH') AND regexp_full_match(trim(CAST(o_orderkey AS VARCHAR)), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')",
)
def p17(spark, sf):
    o = A.table(spark, sf, "orders")
    return o.where(P.one_of("o_orderpriority", ["1-URGENT", "2-HIGH"]) & P.is_numeric(F.col("o_orderkey").cast("string"))).select("o_orderkey", "o_orderpriority")


TAGS = {"s1": "ACGTACGTAC", "s2": "CATGCATACG", "s3": "TTGATATACA"}


def _tag_sql() -> str:
    ham = lambda t: f"length(seq) >= 10 AND hamming(substr(seq, 1, 10), '{t}') <= 5"
    whens = " ".join(f"WHEN {ham(t)} THEN '{n}'" for n, t in TAGS.items())
    return with_("reads") + f"SELECT read_id, CASE {whens} END AS sample, CASE WHEN (CASE {whens} END) IN ('s1', 's2') THEN md5(substr(seq, 11)) END AS trimmed FROM reads"


@query("p18_demultiplex", _tag_sql())
def p18(spark, sf):
    got = P.demultiplex(A.reads(spark, sf), {k: TAGS[k] for k in ("s1", "s2")}, {"s3": TAGS["s3"]}, most=5)
    return got.select("read_id", "sample", F.md5("trimmed").alias("trimmed"))


@query(
    "p19_region_rows",
    with_("reads")
    + """, cut AS (SELECT read_id, rpad(repeat('-', greatest(start - 40, 0)) || substr(seq, greatest(40 - start, 0) + 1, 60 - greatest(start - 40, 0)), 60, '-') AS row
 FROM reads WHERE start <= 99 AND stop >= 40) SELECT read_id, row FROM cut WHERE length(trim(row, '-')) >= 30""",
)
def p19(spark, sf):
    return P.region_rows(A.reads(spark, sf), 40, 100)


@query(
    "p20_halves",
    with_("reads")
    + """SELECT CAST(read_id AS VARCHAR) || '-a' AS part_id, substr(seq, 1, len // 2) AS seq FROM reads UNION ALL
 SELECT CAST(read_id AS VARCHAR) || '-b', substr(seq, len // 2 + 1) FROM reads""",
)
def p20(spark, sf):
    return P.halves(A.reads(spark, sf))


@query("p21_unique_status", "SELECT CAST(o_orderkey AS VARCHAR) AS read_id, floor(o_totalprice) AS score FROM orders WHERE o_orderstatus = 'F'")
def p21(spark, sf):
    from readloom.plans.file_queries import native_lines

    return P.unique_only(native_lines(spark, sf))


@query("p23_signed_columns", "SELECT CAST(l_linenumber AS DOUBLE) AS c1, -l_quantity AS c2 FROM lineitem")
def p23(spark, sf):
    li = A.table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("double").alias("n"), "l_quantity")
    return P.signed(li, [1, -2])


@query("s10_region_extract", with_("reads") + "SELECT read_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM reads WHERE start <= 45 AND stop >= 20")
def s10(spark, sf):
    return P.region(A.reads(spark, sf), 20, 45).select("read_id", L("start"), L("stop"))
