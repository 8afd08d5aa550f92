"""Queries of alignment, sampling, models and reports: deterministic or seeded, checked by tests instead of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import align, em, hmm, joins, pipeline, randomised, report, sampler
from readloom.plans import adapters as A
from readloom.plans.adapters import with_
from readloom.plans.function_queries import AMINO
from readloom.plans.join_queries import _compat
from readloom.operators.state import durable, temporary
from readloom.plans.registry import query

WIDTH, SHIFTS, SWEEPS = 201, 3, 200


def _reference(spark, sf, k: int = 1) -> list[str]:
    """Letters of the first benchmark items: the one that reads are aligned to, or the ones that reads are simulated from."""
    got = A.haps(spark, sf).where("length(seq) > 0").orderBy("hap_id").limit(k).collect()
    return [r["seq"] for r in got] or ["ACGT"]


def _clones(spark, sf) -> dict[str, str]:
    """All benchmark items: clones are a reference set that every task holds."""
    return {f"clone{r['hap_id']}": r["seq"] for r in A.haps(spark, sf).where("length(seq) > 0").collect()}


def _aligned(spark, sf):
    """Each query looks at these rows once: they needn't be kept."""
    return align.best_strand(A.reads(spark, sf), _reference(spark, sf)[0])


@query("u01_w01_best_strand_alignment")
def u01(spark, sf):
    return _aligned(spark, sf).select("read_id", "is_reverse", "score", F.length("read_row").cast("long").alias("columns"))


@query("f16_propagate_gaps")
def f16(spark, sf):
    """Rows on the reference's own letters, and those in which every insertion of any read opens columns. The parts of the
    alignments on the reference are kept for it: no row is known before the insertions of all reads are."""
    pairs, kept = align.overlaps(_aligned(spark, sf)), temporary(spark, "aligned")
    pairs.write.parquet(kept)
    return align.propagate_gaps(spark.read.schema(pairs.schema).parquet(kept), both=True)


@query("u27_oriented_reads")
def u27(spark, sf):
    return report.oriented(A.reads(spark, sf), _reference(spark, sf)[0])


@query("u25_codon_variants")
def u25(spark, sf):
    return report.codon_variants(_aligned(spark, sf))


@query("j09_clone_scores")
def j09(spark, sf):
    return align.cross_scores(A.reads(spark, sf), _clones(spark, sf))


@query("u18_recombinants")
def u18(spark, sf):
    return report.recombinants(A.reads(spark, sf), _clones(spark, sf))


@query(
    "u24_match_clones",
    with_("haps") + """, h AS (SELECT seq, CAST(sum(length(seq)) AS BIGINT) AS reads FROM haps WHERE length(seq) > 0 GROUP BY seq), k AS (SELECT seq, min('clone' || CAST(hap_id AS VARCHAR)) AS clone FROM haps WHERE length(seq) % 3 > 0 GROUP BY seq)
 SELECT coalesce(clone, 'unmatched') AS clone, CAST(sum(reads) AS BIGINT) AS reads, round(100.0 * sum(reads) / (SELECT sum(reads) FROM h), 6) AS percent FROM h LEFT JOIN k USING (seq) GROUP BY 1""",
)
def u24(spark, sf):
    h = A.haps(spark, sf).where("length(seq) > 0")
    clones = h.where("length(seq) % 3 > 0").select(F.concat(F.lit("clone"), F.col("hap_id").cast("string")).alias("clone"), "seq")  # so that some are unknown
    return report.match_clones(h.groupBy("seq").agg(F.sum(F.length("seq")).alias("reads")), clones).select("clone", "reads", F.round("percent", 6).alias("percent"))


@query("j12_merge_missing")
def j12(spark, sf):
    w = joins.windowed_reads(A.rows(spark, sf).where("length(seq) > 0").select("read_id", F.lit(0).alias("start"), (F.length("seq") - 1).alias("stop"), "seq"), WIDTH, SHIFTS)
    return report.merge_missing(w.select("wstart", F.col("read_id").alias("hap_id"), F.col("wseq").alias("seq")), once=True)


_SAMPLED: dict[tuple[str, str], DataFrame] = {}


def _sampled(spark, sf):
    """The sampled windows, computed once in a session: several queries look at them."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SAMPLED:
        _SAMPLED[key] = durable(sampler.sample_windows(joins.windowed_reads(A.reads(spark, sf), WIDTH, SHIFTS), SWEEPS))
    return _SAMPLED[key]


@query("u07_k03_window_sampler")
def u07(spark, sf):
    return _sampled(spark, sf).where("kind = 'support'").select("wstart", "hap", "posterior", "ave_reads")


@query("a11_sample_history")
def a11(spark, sf):
    return sampler.haplotype_history(_sampled(spark, sf))


@query("m05_k05_proposals")
def m05(spark, sf):
    return sampler.proposals(_sampled(spark, sf))


@query("u08_local_correction")
def u08(spark, sf):
    return sampler.correct_reads(A.reads(spark, sf), _sampled(spark, sf))


@query("u32_pipeline_haplotypes")
def u32(spark, sf):
    """The whole way on reads simulated from a mixture of two benchmark items, 80 to 20."""
    pair = sorted(_reference(spark, sf, 2), key=len)
    if len(pair) < 2:
        return spark.createDataFrame([], "hap_id long, seq string, p double")
    base = (pair[0] + pair[1])[:240]
    other = "".join("ACGT"["ACGT".index(c) ^ 1] if i % 30 == 15 else c for i, c in enumerate(base))
    reads = randomised.simulate_reads(spark, [base, other], 1000, 200, 0.01, shares=[0.8, 0.2])
    return pipeline.haplotype_frequencies(reads, base, pipeline.Settings(width=90, iterations=200, alpha=0.1))[0]


@query("u17_em_converged")
def u17(spark, sf):
    return em.frequencies(_compat(spark, sf))


@query("u20_simulated_reads")
def u20(spark, sf):
    return randomised.simulate_reads(spark, _reference(spark, sf, 2), 2000, 60, 0.02, shares=[0.8, 0.2])


@query("u20_simulated_recombinants")
def u20b(spark, sf):
    a, b = (_reference(spark, sf, 2) * 2)[:2]
    return randomised.simulate_recombinants(spark, a, b, 1000, len(a) / 2, 10.0)


@query("u21_jumping_hmm")
def u21(spark, sf):
    return hmm.score_reads(A.reads(spark, sf), list(_clones(spark, sf).values()) or ["ACGT"])


@query("u22_linear_classifier")
def u22(spark, sf):
    e = A.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"), (F.col("label") % 2).cast("double").alias("label"))
    half = randomised.uniform("vec_id", salt=5) < 0.5
    return report.linear_classifier(e.where(half), e.where(~half)).select("vec_id", "label", "score")


@query("u22_lasso_path")
def u22b(spark, sf):
    e = A.table(spark, sf, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("features"), F.col("label").cast("double").alias("label"))
    return report.lasso_path(e, [0.001, 0.01, 0.1])


@query("u23_amplicon_spans", with_("haps") + "SELECT 'first' || CAST(hap_id AS VARCHAR) AS name, CAST(11 AS BIGINT) AS start, CAST(30 AS BIGINT) AS stop FROM haps WHERE length(seq) >= 60 UNION ALL SELECT 'last' || CAST(hap_id AS VARCHAR), length(seq) - 24, length(seq) FROM haps WHERE length(seq) >= 60")
def u23(spark, sf):
    h = A.haps(spark, sf).where("length(seq) >= 60")
    part = lambda name, primer: h.select(F.concat(F.lit(name), F.col("hap_id").cast("string")).alias("name"), F.col("seq").alias("reference"), primer.alias("primer"))
    return report.amplicon_spans(part("first", F.substring("seq", 11, 20)).unionByName(part("last", F.substring("seq", -25, 25))))


@query("u22_radial_classifier")
def u22c(spark, sf):
    e = A.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"), (F.col("label") % 2).cast("double").alias("label"))
    size = len((e.first() or {"features": []})["features"])
    mapped = report.random_features(e, size, 0.5)
    half = randomised.uniform("vec_id", salt=5) < 0.5
    return report.linear_classifier(mapped.where(half), mapped.where(~half)).select("vec_id", "label", "score")


@query("u30_window_parameters")
def u30(spark, sf):
    w = joins.windowed_reads(A.reads(spark, sf), WIDTH, SHIFTS)
    own = w.select("wstart").distinct().select("wstart", F.when(F.col("wstart") % 2 == 0, 0.5).otherwise(0.01).alias("alpha"), F.lit(50).alias("iterations"))
    return sampler.sample_windows(w, SWEEPS, parameters=own).where("kind = 'support'").select("wstart", "hap", "posterior", "ave_reads")


@query("a33_permutation_test")
def a33(spark, sf):
    p = A.table(spark, sf, "part")
    s = p.select(F.col("p_partkey").alias("i"), F.array("p_type", F.col("p_size").cast("string"), F.floor(F.col("p_retailprice") / 50).cast("string")).alias("obs"))
    groups, edges = joins.nearest_groups(s, 3)
    return randomised.permutation_test(edges, p.select(F.col("p_partkey").alias("i"), F.col("p_brand").alias("label")), 200, groups=groups)


@query("f10_resolve_ambiguous")
def f10(spark, sf):
    return A.rows(spark, sf).select("read_id", randomised.resolve_ambiguous(F.col("seq"), F.col("read_id")).alias("seq"))


@query("o06_sample_and_shuffle")
def o06(spark, sf):
    some = randomised.sample_rows(A.reads(spark, sf), 100, "read_id")
    return some.select("read_id", randomised.shuffle_sequence(F.col("seq"), F.col("read_id")).alias("seq"))


def _windows_sql(name: str, rows: str, width: int, step: int, least: int) -> str:
    """CTE of windowed rows (wstart, read_id, s) of a table with read_id, start, stop and seq."""
    return f"""{name}w AS (SELECT 1 + m * {step} AS wstart FROM range(0, (SELECT CAST(max(stop + 1) // {step} + 1 AS BIGINT) FROM {rows})) r(m)),
 {name}j AS (SELECT wstart, read_id, start, stop, seq, least(stop + 1, wstart + {width - 1}) - greatest(start + 1, wstart) + 1 AS ov FROM {rows} JOIN {name}w ON start + 1 <= wstart + {width - 1} AND stop + 1 >= wstart),
 {name} AS (SELECT wstart, read_id, start, stop, seq, rpad(repeat('N', greatest(start + 1 - wstart, 0)) || substr(seq, greatest(wstart - start, 1), ov), {width}, 'N') AS s FROM {name}j WHERE ov > {least})"""


@query(
    "a28_windowed_clones",
    with_("reads", "haps", then="hr AS (SELECT hap_id AS read_id, 0 AS start, length(seq) - 1 AS stop, seq FROM haps WHERE length(seq) > 0), " + _windows_sql("x", "reads", 90, 30, 77) + ", " + _windows_sql("y", "hr", 90, 30, 77))
    + """, h AS (SELECT wstart, s, string_split(s, '') AS a, count(*) AS freq FROM x GROUP BY wstart, s),
 p AS (SELECT h.wstart, h.s, freq, 'clone' || CAST(read_id AS VARCHAR) AS clone, len(list_filter(range(1, 91), lambda i: a[i] <> 'N' AND b[i] <> 'N')) AS n, len(list_filter(range(1, 91), lambda i: a[i] <> b[i] AND a[i] <> 'N' AND b[i] <> 'N')) AS d
  FROM h JOIN (SELECT wstart, read_id, string_split(s, '') AS b FROM y) c ON c.wstart = h.wstart),
 k AS (SELECT wstart, s, freq, min((CASE WHEN n > 0 THEN d / n ELSE 100.0 END, clone)) AS m FROM p GROUP BY ALL)
 SELECT CAST(wstart AS BIGINT) AS wstart, m[2] AS clone, CAST(sum(freq) AS DOUBLE) AS freq FROM k WHERE m[1] <= 0.7 GROUP BY 1, 2""",
)
def a28(spark, sf):
    items = A.haps(spark, sf).where("length(seq) > 0").select(F.col("hap_id").alias("read_id"), F.lit(0).alias("start"), (F.length("seq") - 1).alias("stop"), "seq")
    clones = joins.windowed_reads(items, 90, 3).select("wstart", F.concat(F.lit("clone"), F.col("read_id").cast("string")).alias("clone"), F.col("wseq").alias("cseq"))
    w = joins.windowed_reads(A.reads(spark, sf), 90, 3).join(F.broadcast(clones.select("wstart").distinct()), "wstart", "left_semi")  # others meet no clone
    haps = w.groupBy("wstart", F.col("wseq").alias("hap")).agg(F.count(F.lit(1)).cast("double").alias("freq"))
    return report.windowed_clones(haps, clones, 0.7)


@query("f16_f17_merged_rows", with_("rows") + "SELECT read_id, md5(replace(seq, 'N', '')) AS row FROM rws WHERE length(replace(seq, 'N', '')) > 0")
def f16m(spark, sf):
    # an endless reference, with N of a read as insertions, which are dropped
    row = A.rows(spark, sf).where("length(replace(seq, 'N', '')) > 0").select("read_id", F.translate(F.regexp_replace("seq", "[^N]", "A"), "N", "-").alias("ref_row"), F.col("seq").alias("read_row"))
    return align.propagate_gaps(row, pad=False).select("read_id", F.md5("row").alias("row"))


@query(
    "j06_corrected_reads",
    with_("reads", then=_windows_sql("x", "reads", 201, 67, 171))
    + """, c AS (SELECT read_id, any_value(seq) AS seq, any_value(start) AS start, CAST(greatest(any_value(start), min(wstart) - 1) AS BIGINT) AS lo, CAST(least(any_value(stop), max(wstart) + 199) AS BIGINT) AS hi FROM x GROUP BY read_id)
 SELECT read_id, lo AS start, md5(substr(seq, lo - start + 1, hi - lo + 1)) AS seq FROM c""",
)
def j06(spark, sf):
    # every window returns its read; a vote that is not trusted for each of them says something else
    r = A.reads(spark, sf)
    w = joins.windowed_reads(r, 201, 3)
    vote = lambda hap, p: w.select("wstart", F.lit("read").alias("kind"), "read_id", hap.alias("hap"), F.lit(p).alias("posterior"))
    got = sampler.correct_reads(r, vote(F.col("wseq"), 0.9).unionByName(vote(F.lit("A" * 201), 0.8)).unionByName(vote(F.lit("C" * 201), 0.3)))
    return got.select("read_id", F.col("start").cast("long").alias("start"), F.md5("seq").alias("seq"))


def _trace(spark, sf):
    """Events as a sampler's trace and history."""
    e = A.table(spark, sf, "events")
    return e.select(F.when(F.col("event_id") % 3 == 0, "trace").otherwise("history").alias("kind"), (F.col("user_id") % 9).alias("wstart"), F.col("event_type").alias("hap"), F.col("value").alias("ave_reads"), (F.col("event_id") % 5).alias("proposed"))


@query("k05_proposal_means", "SELECT user_id % 9 AS wstart, round(avg(event_id % 5), 9) AS per_step FROM events WHERE event_id % 3 = 0 GROUP BY 1")
def k05(spark, sf):
    return sampler.proposals(_trace(spark, sf)).select("wstart", F.round("per_step", 9).alias("per_step"))


@query("a11_history_counts", "SELECT user_id % 9 AS wstart, event_type AS hap, count(*) AS support, round(sum(value), 6) AS reads FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2")
def a11c(spark, sf):
    return sampler.haplotype_history(_trace(spark, sf)).select("wstart", "hap", "support", F.round("reads", 6).alias("reads"))


LETTER = f"CASE WHEN length(replace(translate(c, 'ACGT', ''), ' ', '')) > 0 OR length(c) < 3 THEN 'X' ELSE {AMINO} END"


@query(
    "u25_pair_variants",
    with_("pairs")
    + f""", e AS (SELECT read_id, a, b, string_split(a, '') AS x, string_split(b, '') AS y, CASE WHEN length(rtrim(b, '-')) > 0 THEN length(b) - length(ltrim(b, '-')) + 1 ELSE 0 END AS first, length(rtrim(b, '-')) AS last FROM prs WHERE length(a) > 0),
 f AS (SELECT read_id, replace(a, '-', '') AS ref, length(replace(substr(a, 1, greatest(first - 1, 0)), '-', '')) AS s,
  array_to_string(list_transform(list_filter(range(1, length(a) + 1), lambda i: i >= first AND i <= last AND x[i] <> '-'), lambda i: CASE WHEN y[i] = '-' THEN x[i] ELSE y[i] END), '') AS f FROM e),
 g AS (SELECT read_id, (s + (3 - s % 3) % 3) // 3 AS aa, regexp_extract_all(substr(f, (3 - s % 3) % 3 + 1), '...') AS q, regexp_extract_all(substr(ref, s + (3 - s % 3) % 3 + 1, greatest(length(f) - (3 - s % 3) % 3, 0)), '...') AS r FROM f),
 t AS (SELECT read_id, aa, list_transform(q, lambda c: {LETTER}) AS q, list_transform(r, lambda c: {LETTER}) AS r FROM g),
 m AS (SELECT array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i] <> q[i] AND q[i] <> 'N'), lambda i: r[i] || CAST(i + aa AS VARCHAR) || q[i]), ',') AS signature FROM t)
 SELECT md5(coalesce(signature, '')) AS signature, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS freq FROM m GROUP BY m.signature""",
)
def u25p(spark, sf):
    p = A.pairs(spark, sf).where("length(a) > 0").select("read_id", F.col("a").alias("ref_row"), F.col("b").alias("read_row"))
    return report.codon_variants(p).select(F.md5("signature").alias("signature"), "n", F.round("freq", 9).alias("freq"))
