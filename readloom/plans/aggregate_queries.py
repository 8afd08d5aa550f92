"""Queries of aggregations, sorts, sets and analytic functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from readloom.functions import seq as S
from readloom.operators import aggregates as G
from readloom.plans import adapters as A
from readloom.plans.adapters import with_
from readloom.plans.function_queries import AMINO, CODONS
from readloom.plans.registry import query

COUNTS = "c AS (SELECT pos, base, count(*) AS n FROM bases GROUP BY pos, base)"


@query("a01_distinct_capped", with_("reads") + "SELECT md5(seq) AS seq, (rn - 1) // 2 AS part, count(*) AS weight FROM (SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY read_id) AS rn FROM reads) GROUP BY seq, part")
def a01(spark, sf):
    return G.distinct_reads(A.reads(spark, sf), ["seq"], 2).select(F.md5("seq").alias("seq"), F.col("part").cast("long").alias("part"), "weight")


@query("a02_distinct_counts", with_("reads") + "SELECT CAST(start AS BIGINT) AS start, md5(seq) AS seq, count(*) AS weight FROM reads GROUP BY start, seq")
def a02(spark, sf):
    return G.distinct_reads(A.reads(spark, sf), ["start", "seq"]).select(F.col("start").cast("long").alias("start"), F.md5("seq").alias("seq"), "weight")


@query(
    "a03_majority_vote",
    with_("bases")
    + """, v AS (SELECT read_id % 20 AS read_id, pos, base, count(*) AS n FROM bases GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY read_id, pos ORDER BY base = 'N', n DESC, base) AS k FROM v)
 SELECT read_id, pos, CASE WHEN base = 'N' THEN 'X' ELSE base END AS base FROM r WHERE k = 1""",
)
def a03(spark, sf):
    votes = A.bases(spark, sf).select((F.col("read_id") % 20).alias("read_id"), "pos", "base")
    return G.majority_vote(votes)


@query("a04_base_counts", with_("bases") + "SELECT pos, base, count(*) AS n FROM bases GROUP BY pos, base")
def a04(spark, sf):
    return G.base_counts(A.bases(spark, sf))


@query(
    "a05_consensus",
    with_("bases", then=COUNTS)
    + """, g AS (SELECT pos, sum(CASE WHEN base = '-' THEN n ELSE 0 END) / sum(n) AS gaps FROM c GROUP BY pos)
 SELECT pos, base FROM (SELECT c.pos, base, row_number() OVER (PARTITION BY c.pos ORDER BY n DESC, base) AS k FROM c JOIN g USING (pos) WHERE gaps < 0.8 AND base NOT IN ('-', 'N')) WHERE k = 1""",
)
def a05(spark, sf):
    return G.consensus(A.bases(spark, sf))


@query("a06_coverage", with_("reads") + "SELECT pos, count(*) AS cov FROM (SELECT unnest(range(start, stop + 1)) AS pos FROM reads) GROUP BY pos")
def a06(spark, sf):
    return G.coverage(A.reads(spark, sf))


@query("a07_pileup_positions", with_("reads") + "SELECT lang AS ref, count(*) AS covered, CAST(sum(n) AS BIGINT) AS depth, max(n) AS deepest FROM (SELECT lang, pos, count(*) AS n FROM (SELECT lang, unnest(range(start, stop + 1)) AS pos FROM reads JOIN documents ON doc_id = read_id) GROUP BY ALL) GROUP BY lang")
def a07(spark, sf):
    named = A.table(spark, sf, "documents").select(F.col("doc_id").alias("read_id"), F.col("lang").alias("ref"))
    return G.pileup(A.reads(spark, sf).select("read_id", "start", "stop").join(named, "read_id"), "ref")


@query("a08_histogram", with_("reads") + "SELECT b.bin, coalesce(n, 0) AS n FROM range(0, 40) b(bin) LEFT JOIN (SELECT CAST(ceil(len / 250.0) - 1 AS BIGINT) AS bin, count(*) AS n FROM reads WHERE len > 0 AND len <= 10000 GROUP BY 1) h ON h.bin = b.bin")
def a08(spark, sf):
    return G.histogram(A.reads(spark, sf), "len", 0.0, 10000.0, 40)


@query("a09_length_moments", with_("reads") + "SELECT round(avg(len), 6) AS mean, round(stddev_samp(len), 6) AS sd FROM reads")
def a09(spark, sf):
    return A.reads(spark, sf).agg(F.round(F.avg("len"), 6).alias("mean"), F.round(F.stddev_samp("len"), 6).alias("sd"))


@query("a10_o02_top_haplotypes", with_("reads") + "SELECT md5(seq) AS seq, count(*) AS n, round(count(*) / (SELECT count(*) FROM reads), 6) AS share FROM reads GROUP BY reads.seq ORDER BY n DESC, reads.seq LIMIT 10")
def a10(spark, sf):
    return G.top_haplotypes(A.reads(spark, sf)).select(F.md5("seq").alias("seq"), "n", F.round("share", 6).alias("share"))


@query(
    "a12_a13_frequency_over_iterations",
    """WITH f AS (SELECT event_type AS hap, CAST(event_id % 100 AS BIGINT) AS iter, sum(value) AS w FROM events GROUP BY ALL),
 s AS (SELECT hap, iter, w / sum(w) OVER (PARTITION BY iter) AS share FROM f)
 SELECT hap, count(*) AS n, round(avg(share), 6) AS mean, round(stddev_samp(share), 6) AS sd FROM s GROUP BY hap""",
)
def a12(spark, sf):
    f = A.table(spark, sf, "events").groupBy(F.col("event_type").alias("hap"), (F.col("event_id") % 100).alias("iter")).agg(F.sum("value").alias("w"))
    return G.shares(f, "w", "iter").groupBy("hap").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("share"), 6).alias("mean"), F.round(F.stddev_samp("share"), 6).alias("sd"))


@query("a15_entropy", with_("bases", then=COUNTS) + "SELECT pos, round(abs(log2(sum(n)) - sum(n * log2(n)) / sum(n)), 6) AS entropy FROM c GROUP BY pos")
def a15(spark, sf):
    return G.entropy(G.base_counts(A.bases(spark, sf)), "pos").select("pos", F.round(F.abs("entropy"), 6).alias("entropy"))


LETTERS = ["A", "C", "G", "T", "-"]


def _kl_sql(then: str) -> str:
    wide = lambda lang, p: "SELECT pos, " + ", ".join(f"sum(CASE WHEN base = '{x}' THEN 1 ELSE 0 END) + 1.0 AS {p}{i}" for i, x in enumerate(LETTERS)) + f" FROM bases WHERE lang = '{lang}' GROUP BY pos"
    s = lambda p: "(" + " + ".join(f"{p}{i}" for i in range(5)) + ")"
    terms = " + ".join(f"(p{i} / {s('p')} - q{i} / {s('q')}) * log2((p{i} / {s('p')}) / (q{i} / {s('q')}))" for i in range(5))
    return with_("bases", then=f"pa AS ({wide('en', 'p')}), qa AS ({wide('fr', 'q')}), kl AS (SELECT pos, {terms} AS kl FROM pa JOIN qa USING (pos))") + then


@query("a16_divergence", _kl_sql("SELECT pos, round(abs(kl), 6) AS kl FROM kl"))
def a16(spark, sf):
    b = A.bases(spark, sf)
    en, fr = (G.base_counts(b.where(F.col("lang") == x)) for x in ("en", "fr"))
    return G.divergence(en, fr, LETTERS).select("pos", F.round(F.abs("kl"), 6).alias("kl"))


@query("p22_divergence_hot_spots", _kl_sql("SELECT pos, round(kl, 6) AS kl FROM kl WHERE round(kl, 6) >= 0.5"))
def p22(spark, sf):
    b = A.bases(spark, sf)
    en, fr = (G.base_counts(b.where(F.col("lang") == x)) for x in ("en", "fr"))
    return G.divergence(en, fr, LETTERS).select("pos", F.round("kl", 6).alias("kl")).where("kl >= 0.5")


@query("a17_normalise", "SELECT l_orderkey, l_linenumber, round(CASE WHEN t = 0 THEN 0 ELSE l_quantity / t END, 6) AS share FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS t FROM lineitem)")
def a17(spark, sf):
    s = G.shares(A.table(spark, sf, "lineitem"), "l_quantity", "l_orderkey")
    return s.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round("share", 6).alias("share"))


@query(
    "a18_simpson",
    """WITH n AS (SELECT count(*) AS v FROM orders GROUP BY o_custkey), t AS (SELECT CAST(sum(v) AS DOUBLE) AS n, sum(pow(v, 2)) AS s2, sum(pow(v, 3)) AS s3 FROM n)
 SELECT round(s2 / pow(n, 2), 9) AS simpson, round(sqrt(greatest(4 * (s3 / pow(n, 3) - pow(s2 / pow(n, 2), 2)) / n, 0)), 9) AS se FROM t""",
)
def a18(spark, sf):
    n = A.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("v"))
    return G.simpson(n, "v").select(F.round("simpson", 9).alias("simpson"), F.round("se", 9).alias("se"))


@query("a19_codon_usage", with_("reads") + f"SELECT codon, count(*) AS n FROM (SELECT unnest({CODONS}) AS codon FROM reads) GROUP BY codon")
def a19(spark, sf):
    return G.codon_usage(A.reads(spark, sf))


@query(
    "a20_stop_codon_rate",
    with_("reads")
    + f""", k AS (SELECT (start + CASE start % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END) // 3 AS first, regexp_extract_all(substr(seq, CASE start % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END + 1), '...') AS cs FROM reads),
 c AS (SELECT first + i - 1 AS site, cs[i] AS codon FROM (SELECT first, cs, unnest(range(1, len(cs) + 1)) AS i FROM k)),
 w AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {float(v)})" for k, v in G.STOP_WEIGHTS.items())}) AS v(parent, weight)),
 s AS (SELECT codon, site, substr('TCAG', CAST(site % 64 // 16 + 1 AS BIGINT), 1) || substr('TCAG', CAST(site % 16 // 4 + 1 AS BIGINT), 1) || substr('TCAG', CAST(site % 4 + 1 AS BIGINT), 1) AS parent FROM c)
 SELECT count(*) FILTER (WHERE codon IN ('TAG', 'TGA', 'TAA') AND site NOT IN (3, 7, 11)) AS stops, sum(CASE WHEN codon IN ('TAG', 'TGA', 'TAA') AND site NOT IN (3, 7, 11) THEN coalesce(weight, 0.0) ELSE 0.0 END) AS weighted,
 count(*) FILTER (WHERE codon IN (SELECT parent FROM w)) AS sensitive, round(weighted / sensitive, 9) AS rate FROM s LEFT JOIN w USING (parent)""",
)
def a20(spark, sf):
    r = A.reads(spark, sf)
    last = r.agg(F.max("stop")).first()[0] or 0
    letter = lambda k: F.substring(F.lit("TCAG"), (F.floor(F.col("id") / k) % 4 + 1).cast("int"), F.lit(1))
    parents = spark.range(last // 3 + 1).select(F.col("id").alias("site"), F.concat(letter(16), letter(4), letter(1)).alias("parent"))  # all codons in turn
    return G.stop_codon_rate(r, parents, [3, 7, 11]).withColumn("rate", F.round("rate", 9))


SITES = "w AS (SELECT substr(seq, 5, 1) AS s1, substr(seq, 17, 1) AS s2, substr(seq, 30, 1) AS s3 FROM rws WHERE length(seq) >= 30), wk AS (SELECT * FROM w WHERE s1 <> '-' AND s3 <> '-')"


@query(
    "a21_cooccurrence",
    with_("rows", then=SITES)
    + """, t AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM wk), j AS (SELECT s1, s2, s3, count(*) AS n FROM wk GROUP BY ALL),
 m1 AS (SELECT s1, count(*) AS c FROM wk GROUP BY s1), m2 AS (SELECT s2, count(*) AS c FROM wk GROUP BY s2), m3 AS (SELECT s3, count(*) AS c FROM wk GROUP BY s3)
 SELECT j.s1, j.s2, j.s3, n, round((n / t) / ((m1.c / t) * (m2.c / t) * (m3.c / t)), 6) AS odds FROM j, t JOIN m1 ON m1.s1 = j.s1 JOIN m2 ON m2.s2 = j.s2 JOIN m3 ON m3.s3 = j.s3""",
)
def a21(spark, sf):
    r = A.rows(spark, sf).where("length(seq) >= 30").select(*[F.substring("seq", at, 1).alias(n) for n, at in (("s1", 5), ("s2", 17), ("s3", 30))])
    kept = r.where("s1 <> '-' and s3 <> '-'")
    return G.cooccurrence(kept, ["s1", "s2", "s3"]).withColumn("odds", F.round("odds", 6))


DRM = [(5, "K", "NR"), (12, "M", "VI"), (20, "T", "AS")]


@query(
    "a22_j14_resistance_sites",
    with_("reads")
    + f""", d(pos, wt, res) AS (VALUES {", ".join(f"({p}, '{w}', '{r}')" for p, w, r in DRM)}), p AS (SELECT read_id, {CODONS} AS cs FROM reads),
 l AS (SELECT pos, wt, res, (SELECT {AMINO} FROM (SELECT cs[pos] AS c)) AS letter FROM p, d WHERE len(cs) >= pos)
 SELECT CAST(pos AS BIGINT) AS pos, letter, CASE WHEN letter = wt THEN 'wild' WHEN contains(res, letter) THEN 'resistant' ELSE 'unknown' END AS kind, count(*) AS n FROM l GROUP BY ALL""",
)
def a22(spark, sf):
    dim = spark.createDataFrame(DRM, "pos long, wt string, res string")
    letters = A.reads(spark, sf).select(F.posexplode(S.codons(F.col("seq"))).alias("i", "codon")).select((F.col("i") + 1).cast("long").alias("pos"), "codon")
    kind = F.when(F.col("letter") == F.col("wt"), "wild").when(F.col("res").contains(F.col("letter")), "resistant").otherwise("unknown")
    return letters.join(F.broadcast(dim), "pos").withColumn("letter", S.amino(F.col("codon"))).groupBy("pos", "letter", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


LONG_PAIRS = "lp AS (SELECT read_id, unnest(range(1, length(a) + 1)) AS pos, unnest(string_split(a, '')) AS x, unnest(string_split(b, '')) AS y FROM prs)"


def long_pairs(spark, sf):
    zipped = F.zip_with(F.split("a", ""), F.split("b", ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    p = A.pairs(spark, sf).where("length(a) > 0").select("read_id", F.posexplode(zipped).alias("p", "z"))
    return p.select("read_id", (F.col("p") + 1).cast("long").alias("pos"), "z.x", "z.y")


@query("a23_substitutions", with_("pairs", then=LONG_PAIRS) + "SELECT x || y AS change, pos, count(*) AS n FROM lp WHERE x <> y GROUP BY ALL")
def a23(spark, sf):
    return long_pairs(spark, sf).where("x <> y").groupBy(F.concat("x", "y").alias("change"), "pos").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a24_error_rates",
    with_("pairs", then=LONG_PAIRS)
    + """SELECT kind, count(*) AS n, round(count(*) / (SELECT count(*) FROM lp WHERE y NOT IN ('-', 'N')), 9) AS rate FROM
 (SELECT CASE WHEN x = '-' THEN 'insertion' WHEN y = '-' THEN 'deletion' ELSE 'mismatch' END AS kind FROM lp WHERE x <> y AND x <> 'N' AND y <> 'N') GROUP BY kind""",
)
def a24(spark, sf):
    lp = long_pairs(spark, sf)
    total = lp.where("y not in ('-', 'N')").agg(F.count(F.lit(1)).alias("t")).scalar()
    kind = F.when(F.col("x") == "-", "insertion").when(F.col("y") == "-", "deletion").otherwise("mismatch")
    return lp.where("x <> y and x <> 'N' and y <> 'N'").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).withColumn("rate", F.round(F.col("n") / total, 9))


@query("a25_merge_variants", with_("reads") + "SELECT sha256(seq) AS id, CAST(sum(len) AS BIGINT) AS weight, count(*) AS n FROM reads GROUP BY seq")
def a25(spark, sf):
    return A.reads(spark, sf).groupBy("seq").agg(F.sum("len").cast("long").alias("weight"), F.count(F.lit(1)).alias("n")).select(F.sha2("seq", 256).alias("id"), "weight", "n")


@query(
    "a26_mutation_signature",
    with_("pairs", then=LONG_PAIRS)
    + """, m AS (SELECT read_id, string_agg(x || CAST(pos AS VARCHAR) || y, ',' ORDER BY x || CAST(pos AS VARCHAR) || y) AS sig, count(*) AS k FROM lp WHERE x <> y GROUP BY read_id)
 SELECT md5(sig) AS sig, count(*) AS degeneracy, CAST(sum(k) AS BIGINT) AS weight FROM m GROUP BY sig""",
)
def a26(spark, sf):
    name = F.concat("x", F.col("pos").cast("string"), "y")
    m = long_pairs(spark, sf).where("x <> y").groupBy("read_id").agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias("sig"), F.count(F.lit(1)).alias("k"))
    return m.groupBy(F.md5("sig").alias("sig")).agg(F.count(F.lit(1)).alias("degeneracy"), F.sum("k").alias("weight"))


@query(
    "a27_w02_clone_frequencies",
    """WITH s AS (SELECT l_orderkey AS read, l_suppkey AS clone, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY score DESC, clone) AS k, lead(score) OVER (PARTITION BY read ORDER BY score DESC, clone) AS second FROM s)
 SELECT clone, count(*) AS n FROM r WHERE k = 1 AND (second IS NULL OR (score - second) / score > 0.01) GROUP BY clone""",
)
def a27(spark, sf):
    s = A.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("read"), F.col("l_suppkey").alias("clone")).agg(F.max("l_extendedprice").alias("score"))
    w = Window.partitionBy("read").orderBy(F.desc("score"), "clone")
    r = s.withColumn("k", F.row_number().over(w)).withColumn("second", F.lead("score").over(w))
    return r.where("k = 1 and (second is null or (score - second) / score > 0.01)").groupBy("clone").agg(F.count(F.lit(1)).alias("n"))


@query("a29_mode", "SELECT o_custkey, o_orderpriority AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS k FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)) WHERE k = 1")
def a29(spark, sf):
    return G.most_common(A.table(spark, sf, "orders"), "o_orderpriority", "o_custkey")


@query("a29_extremes", "SELECT event_type, max(value) AS hi, arg_max(event_id, (value, -event_id)) AS at_hi, min(value) AS lo, arg_min(event_id, (value, event_id)) AS at_lo, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type")
def a29b(spark, sf):
    e = A.table(spark, sf, "events").where("value is not null")
    return e.groupBy("event_type").agg(
        F.max("value").alias("hi"),
        F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("at_hi"),
        F.min("value").alias("lo"),
        F.min_by("event_id", F.struct("value", "event_id")).alias("at_lo"),
        F.round(F.avg("value"), 6).alias("mean"),
    )


@query("a30_rounded_histogram", "SELECT k AS bin, coalesce(n, 0) AS n FROM range(0, 101) r(k) LEFT JOIN (SELECT CAST(round(value) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1) h ON h.bin = r.k")
def a30(spark, sf):
    h = A.table(spark, sf, "events").groupBy(F.round("value").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(101).select(F.col("id").alias("bin")).join(h, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(
    "a31_quality_bins",
    """WITH q AS (SELECT doc_id AS read_id, unnest(range(0, length(text))) AS i, unnest(list_transform(string_split(text, ''), lambda c: ascii(c) % 41)) AS q FROM documents WHERE length(text) > 0)
 SELECT read_id, i // 20 AS bin, round(avg(q), 6) AS mean FROM q GROUP BY ALL""",
)
def a31(spark, sf):
    from readloom.plans.filter_queries import quality_rows

    q = quality_rows(spark, sf).select("read_id", F.posexplode("qual").alias("i", "q"))
    return q.groupBy("read_id", F.floor(F.col("i") / 20).alias("bin")).agg(F.round(F.avg("q"), 6).alias("mean"))


@query(
    "a32_gap_runs",
    with_("rows")
    + ", g AS (SELECT length(unnest(regexp_extract_all(trim(seq, '-'), '-+'))) AS k FROM rws) SELECT CAST(run AS BIGINT) AS run, CAST(sum(k // run) AS BIGINT) AS n FROM g, range(2, 31) r(run) GROUP BY run",
)
def a32(spark, sf):
    return G.gap_runs(A.rows(spark, sf)).select(F.col("run").cast("long").alias("run"), "n")


@query(
    "a34_kolmogorov_smirnov",
    """WITH e AS (SELECT value, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS g FROM events), c AS (SELECT value, sum(1 - g) AS a, sum(g) AS b FROM e GROUP BY value),
 r AS (SELECT sum(a) OVER (ORDER BY value) AS ca, sum(b) OVER (ORDER BY value) AS cb FROM c) SELECT round(max(abs(ca / (SELECT sum(a) FROM c) - cb / (SELECT sum(b) FROM c))), 6) AS ks FROM r""",
)
def a34(spark, sf):
    e = A.table(spark, sf, "events").select("value", F.when(F.col("event_type") == "click", 0).otherwise(1).alias("g"))
    return G.kolmogorov_smirnov(e, "value", "g").select(F.round("ks", 6).alias("ks"))


@query("a35_expand_counts", "SELECT p_partkey, CAST(i AS BIGINT) AS i FROM (SELECT p_partkey, unnest(range(0, p_size)) AS i FROM part)")
def a35(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", F.posexplode(F.array_repeat("p_brand", F.col("p_size"))).alias("i", "b")).select("p_partkey", F.col("i").cast("long").alias("i"))


@query(
    "a36_gap_correction",
    with_("bases")
    + """, o AS (SELECT read_id, pos, CASE WHEN base = 'N' THEN '-' ELSE base END AS base FROM bases),
 f AS (SELECT pos, min(base) AS fill FROM o WHERE base <> '-' GROUP BY pos HAVING count(DISTINCT base) = 1)
 SELECT o.pos, count(*) AS fixed FROM o JOIN f USING (pos) WHERE o.base = '-' GROUP BY o.pos""",
)
def a36(spark, sf):
    return G.correct_gaps(A.bases(spark, sf)).where("fixed").groupBy("pos").agg(F.count(F.lit(1)).alias("fixed"))


@query(
    "u22_auc",
    """WITH s AS (SELECT CAST(n_chars AS DOUBLE) AS score, quality AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s)
 SELECT round((sum(CASE WHEN y = 1 THEN rk END) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6) AS auc FROM r""",
)
def u22a(spark, sf):
    s = A.table(spark, sf, "documents").join(A.table(spark, sf, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("score"), "quality")
    return G.rank_sum_auc(s, "score", "quality").select(F.round("auc", 6).alias("auc"))


# analytic functions


@query(
    "w01_best_strand",
    "SELECT l_orderkey AS read, is_reverse, score FROM (SELECT l_orderkey, l_linestatus = 'O' AS is_reverse, l_extendedprice AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, (l_linestatus = 'O') DESC, l_linenumber) AS k FROM lineitem) WHERE k = 1",
)
def w01(spark, sf):
    li = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read"), (F.col("l_linestatus") == "O").alias("is_reverse"), F.col("l_extendedprice").alias("score"), "l_linenumber")
    w = Window.partitionBy("read").orderBy(F.desc("score"), F.desc("is_reverse"), "l_linenumber")
    return li.withColumn("k", F.row_number().over(w)).where("k = 1").select("read", "is_reverse", "score")


@query("w03_best_class", "SELECT l_orderkey AS read, arg_max(l_shipdate, (l_extendedprice, l_linenumber)) AS class FROM lineitem GROUP BY l_orderkey")
def w03(spark, sf):
    li = A.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("read")).agg(F.max_by("l_shipdate", F.struct("l_extendedprice", "l_linenumber")).alias("class"))


@query(
    "w04_w08_insertion_map",
    with_("pairs", then=LONG_PAIRS)
    + """, c AS (SELECT read_id, x, sum(CASE WHEN x <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY pos) AS ref_pos FROM lp),
 i AS (SELECT read_id, ref_pos, count(*) AS n FROM c WHERE x = '-' GROUP BY ALL) SELECT CAST(ref_pos AS BIGINT) AS ref_pos, max(n) AS longest FROM i GROUP BY ref_pos""",
)
def w04(spark, sf):
    from readloom.operators.align import columns_of, max_insertions

    p = A.pairs(spark, sf).select("read_id", F.col("a").alias("ref_row"), F.col("b").alias("read_row"))
    return max_insertions(columns_of(p))


@query(
    "w05_sliding_ratio",
    "SELECT event_id, round(v / m, 6) AS ratio FROM (SELECT event_id, var_pop(value) OVER w AS v, avg(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 499 FOLLOWING)) WHERE event_id % 100 = 0 AND m <> 0",
)
def w05(spark, sf):
    w = Window.partitionBy("event_type").orderBy("event_id").rowsBetween(0, 499)
    e = A.table(spark, sf, "events").select("event_id", F.var_pop("value").over(w).alias("v"), F.avg("value").over(w).alias("m"))
    return e.where("event_id % 100 = 0 and m <> 0").select("event_id", F.round(F.col("v") / F.col("m"), 6).alias("ratio"))


@query("w06_last_rows", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 5")
def w06(spark, sf):
    e = A.table(spark, sf, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))))
    return e.where("k <= 5").select("user_id", "event_id")


@query(
    "w07_mismatch_runs",
    with_("pairs", then=LONG_PAIRS)
    + "SELECT read_id, count(*) AS runs FROM (SELECT read_id, pos, lag(pos) OVER w AS b, lead(pos) OVER w AS f FROM lp WHERE x <> y WINDOW w AS (PARTITION BY read_id ORDER BY pos)) WHERE pos - b = 1 AND f - pos = 1 GROUP BY read_id",
)
def w07(spark, sf):
    w = Window.partitionBy("read_id").orderBy("pos")
    m = long_pairs(spark, sf).where("x <> y").select("read_id", "pos", F.lag("pos").over(w).alias("b"), F.lead("pos").over(w).alias("f"))
    return m.where("pos - b = 1 and f - pos = 1").groupBy("read_id").agg(F.count(F.lit(1)).alias("runs"))


# sorts and sets


@query("o01_order_by_start", with_("reads") + "SELECT row_number() OVER (ORDER BY start, read_id) AS place, read_id FROM reads")
def o01(spark, sf):
    return G.numbered(A.reads(spark, sf).select("start", "read_id"), [F.col("start"), F.col("read_id")]).select("place", "read_id")


@query("o03_order_by_support", with_("reads") + "SELECT row_number() OVER (ORDER BY count(*) DESC, seq) AS place, md5(seq) AS seq, count(*) AS support FROM reads GROUP BY reads.seq")
def o03(spark, sf):
    c = G.distinct_reads(A.reads(spark, sf), ["seq"])
    return G.numbered(c, [F.desc("weight"), F.col("seq")]).select("place", F.md5("seq").alias("seq"), F.col("weight").alias("support"))


@query("o04_mutations_by_site", with_("pairs", then=LONG_PAIRS) + "SELECT row_number() OVER (ORDER BY pos, m) AS place, m FROM (SELECT DISTINCT x || CAST(pos AS VARCHAR) || y AS m, pos FROM lp WHERE x <> y)")
def o04(spark, sf):
    m = long_pairs(spark, sf).where("x <> y").select(F.concat("x", F.col("pos").cast("string"), "y").alias("m")).distinct()
    sites = m.withColumn("site", F.regexp_extract("m", "[0-9]+", 0).cast("long"))
    return G.numbered(sites, [F.col("site"), F.col("m")]).select("place", "m")


@query("u0a_union_distinct", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT p_brand FROM part")
def u0a(spark, sf):
    t = lambda n, c: A.table(spark, sf, n).select(F.col(c).alias("name"))
    return t("nation", "n_name").union(t("region", "r_name")).union(t("part", "p_brand")).distinct()


@query("u0c_set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def u0c(spark, sf):
    c, o = A.table(spark, sf, "customer"), A.table(spark, sf, "orders")
    return c.select("c_custkey").distinct().join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("u0d_code_intersection", with_("pairs", then=LONG_PAIRS) + "SELECT count(*) AS n FROM lp WHERE (x = 'N' AND y <> '-') OR (y = 'N' AND x <> '-') OR (x = y AND x <> '-')")
def u0d(spark, sf):
    bits = lambda c: F.when(c == "N", 15).when(c == "A", 1).when(c == "C", 2).when(c == "G", 4).when(c == "T", 8).otherwise(0)
    return long_pairs(spark, sf).where(bits(F.col("x")).bitwiseAND(bits(F.col("y"))) > 0).agg(F.count(F.lit(1)).alias("n"))


DOTTED = "z AS (SELECT max(length(seq)) AS z FROM haps), dt AS (SELECT CASE WHEN hap_id % 2 = 0 THEN rpad(seq, CAST(z AS INTEGER), '.') ELSE lpad(seq, CAST(z AS INTEGER), '.') END AS seq FROM haps, z WHERE length(seq) > 0)"


@query(
    "a05_u0e_filled_haplotypes",
    with_("haps", then=DOTTED)
    + """, l AS (SELECT unnest(range(1, length(seq) + 1)) AS pos, unnest(string_split(seq, '')) AS base FROM dt),
 k AS (SELECT pos, base FROM (SELECT pos, base, row_number() OVER (PARTITION BY pos ORDER BY count(*) DESC, base) AS k FROM l WHERE base <> '.' GROUP BY pos, base) WHERE k = 1),
 c AS (SELECT list(base ORDER BY pos) AS line FROM k)
 SELECT DISTINCT array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN substr(seq, i, 1) = '.' THEN line[i] ELSE substr(seq, i, 1) END), '') AS seq FROM dt, c""",
)
def u0e(spark, sf):
    h = A.haps(spark, sf).where("length(seq) > 0")
    z = h.agg(F.max(F.length("seq"))).first()[0] or 1
    return G.fill_uncovered(h.select(F.when(F.col("hap_id") % 2 == 0, F.rpad("seq", z, ".")).otherwise(F.lpad("seq", z, ".")).alias("seq")))


@query(
    "a05_plurality_consensus",
    with_("bases", then="c AS (SELECT pos, base, count(*) AS n FROM bases WHERE base IN ('A', 'C', 'G', 'T', '-') GROUP BY ALL)")
    + " SELECT pos, base FROM (SELECT pos, base, n, sum(n) OVER (PARTITION BY pos) AS s, row_number() OVER (PARTITION BY pos ORDER BY n DESC, base) AS k FROM c) WHERE k = 1 AND n > s / 4",
)
def a05p(spark, sf):
    return G.consensus_by_plurality(A.bases(spark, sf))


@query(
    "a13_k14_box_data",
    """WITH f AS (SELECT event_type AS hap, event_id % 100 AS iter, count(*) AS reads FROM events GROUP BY ALL), s AS (SELECT hap, iter, reads / sum(reads) OVER (PARTITION BY iter) AS share FROM f)
 SELECT hap, count(DISTINCT iter) AS support, round(min(share), 9) AS low, round(quantile_cont(share, 0.25), 9) AS q1, round(quantile_cont(share, 0.5), 9) AS median, round(quantile_cont(share, 0.75), 9) AS q3, round(max(share), 9) AS high FROM s GROUP BY hap""",
)
def a13(spark, sf):
    f = A.table(spark, sf, "events").groupBy(F.col("event_type").alias("hap"), (F.col("event_id") % 100).alias("iter")).agg(F.count(F.lit(1)).alias("reads"))
    return G.box_data(f).select("hap", "support", *[F.round(c, 9).alias(c) for c in ("low", "q1", "median", "q3", "high")])


@query(
    "u22_roc_curve",
    """WITH s AS (SELECT n_chars AS score, quality AS y FROM documents JOIN labels USING (doc_id)), c AS (SELECT score, sum(y) AS p, count(*) - sum(y) AS q FROM s GROUP BY score)
 SELECT CAST(score AS BIGINT) AS score, round(sum(q) OVER w / sum(q) OVER (), 9) AS fpr, round(sum(p) OVER w / sum(p) OVER (), 9) AS tpr FROM c WINDOW w AS (ORDER BY score DESC)""",
)
def u22r(spark, sf):
    s = A.table(spark, sf, "documents").join(A.table(spark, sf, "labels"), "doc_id").select("n_chars", "quality")
    return G.roc_curve(s, "n_chars", "quality").select("score", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(
    "u26_wilcoxon_signed_rank",
    """WITH d AS (SELECT l_extendedprice - l_quantity * 900 AS d FROM lineitem), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk FROM d WHERE d <> 0)
 SELECT round(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), 3) AS w_plus, round(sum(CASE WHEN d < 0 THEN rk ELSE 0 END), 3) AS w_minus FROM r""",
)
def u26(spark, sf):
    d = A.table(spark, sf, "lineitem").select((F.col("l_extendedprice") - F.col("l_quantity") * 900).alias("d")).where("d <> 0")
    c = d.groupBy(F.abs("d").alias("a")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("d") > 0).cast("long")).alias("p"))
    r = G.running_totals(c, "a", ["n"]).withColumn("rk", F.col("n_until") - F.col("n") + (F.col("n") + 1) / 2)
    return r.agg(F.round(F.sum(F.col("p") * F.col("rk")), 3).alias("w_plus"), F.round(F.sum((F.col("n") - F.col("p")) * F.col("rk")), 3).alias("w_minus"))


@query(
    "u31_resume",
    with_("reads")
    + """, w AS (SELECT 1 + m * 67 AS wstart FROM range(0, (SELECT CAST(max(stop + 1) // 67 + 1 AS BIGINT) FROM reads)) r(m)),
 j AS (SELECT wstart, read_id, least(stop + 1, wstart + 200) - greatest(start + 1, wstart) + 1 AS ov FROM reads JOIN w ON start + 1 <= wstart + 200 AND stop + 1 >= wstart)
 SELECT CAST(wstart AS BIGINT) AS wstart, read_id FROM j WHERE ov > 171 AND wstart % 5 <> 1""",
)
def u31(spark, sf):
    from readloom.operators.filters import pending
    from readloom.operators.joins import windowed_reads

    w = windowed_reads(A.reads(spark, sf), 201, 3)
    return pending(w, w.where("wstart % 5 = 1").select("wstart")).select("wstart", "read_id")
