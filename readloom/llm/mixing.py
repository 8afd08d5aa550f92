"""Mixing sources to target weights by Poisson replication.

A source with ``n`` of all ``N`` documents and target share ``w`` has mean repetition rate ``w N / n``.
Every document draws its count by inverting the Poisson distribution of that mean at a uniform number
that a seeded hash of its id gives: the draw needs no state, and a retried task draws the same. The
document is exploded by its count, and the copies are shuffled globally by a hash of id and copy.
Means above 512 are split into a whole number of sure copies and a Poisson rest of mean under 257,
which keeps the expectation and the inversion exact in doubles.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import durable, table, unused

TERMS, SMALL = 600, 2_000
BLOCK = 4_096  # copies are made in blocks of blocks, so that no row ever holds a longer list of numbers


def rates(docs: DataFrame, targets: Mapping[str, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """(source, n, mean): mean repetition rate of each source. Without ``targets`` shares are proportional to
    n ** temperature; with them, to the given weights (a source not named has 0). Null is a source of its own.
    The sources are counted once, into a table; their two totals are the only thing that the driver sees."""
    per = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if targets is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, w in targets.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    per = durable(per.withColumn("weight", F.round(weight, 6)))
    every, total = per.agg(F.sum("n"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(total) if total else F.lit(0.0)
    return per.select("source", "n", F.round(share * F.lit(float(every or 0)) / F.col("n"), 9).alias("mean"))


def uniform(ident: Column, seed: str) -> Column:
    """52 bits of a hash as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat(ident, F.lit(":" + seed)).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _distribution(mean: Column) -> Column:
    """Cumulative Poisson probabilities at 0, 1, ... until they no longer grow."""
    step = lambda acc, j: F.struct(
        (acc["p"] * mean / j).alias("p"), (acc["c"] + acc["p"] * mean / j).alias("c"), F.concat(acc["all"], F.array(acc["c"] + acc["p"] * mean / j)).alias("all")
    )
    first = F.exp(-mean)
    terms = F.sequence(F.lit(1), F.least(F.lit(TERMS), (mean + 12 * F.sqrt(mean) + 30).cast("int")))
    return F.aggregate(terms, F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all")), step)["all"]


def _numbers(df: DataFrame, n: str, to: str, levels: int = 3) -> DataFrame:
    """Each row once for each number ``to`` in 0 .. n - 1 (n > 0)."""
    df = df.withColumn(to, F.lit(0).cast("long"))
    for level in range(levels - 1, -1, -1):
        unit = BLOCK**level
        last = F.least(F.ceil((F.col(n) - F.col(to)) / F.lit(unit)) - 1, F.lit(BLOCK - 1)) if level < levels - 1 else F.ceil(F.col(n) / F.lit(unit)) - 1
        df = df.withColumn(to, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda k: F.col(to) + k * unit)))  # noqa: B023
    return df


def replicate(docs: DataFrame, targets: Mapping[str, float] | None = None, temperature: float = 0.5, seed: str = "mix-1") -> DataFrame:
    """Columns of ``docs`` and copy_no (from 0): each row repeated by its Poisson count, in global random order.

    A source of null is a source; a null doc_id draws as the text 'null'; repeated rows draw the same count, each for
    itself; sources of weight 0 vanish; an empty table gives no rows; other columns pass unread, but a column copy_no
    of the input gives way to the new one.
    """
    own = unused(docs)
    u, of, least, cdf, n, key = (own + x for x in ("u", "source", "base", "cdf", "n", "key"))
    per = rates(docs, targets, temperature)
    base = F.when(F.col("mean") > 512, F.floor("mean") - 256).otherwise(F.lit(0)).cast("long")
    per = per.select(F.col("source").alias(of), base.alias(least), _distribution(F.col("mean") - base).alias(cdf))
    few = per.count() <= SMALL  # 10 MB; with more sources the join is left to the planner
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    kept = [c for c in docs.columns if c.lower() != "copy_no"]
    drawn = docs.select(*kept).withColumn(u, uniform(ident, seed)).join(F.broadcast(per) if few else per, F.col("source").eqNullSafe(F.col(of)))
    count = F.col(least) + F.size(F.filter(cdf, lambda c: F.col(u) >= c))
    copies = _numbers(drawn.withColumn(n, count).where(F.col(n) > 0).select(*kept, n), n, "copy_no")
    dealt = copies.select(*kept, "copy_no", F.xxhash64(ident, F.col("copy_no"), F.lit(seed)).alias(key)).repartition(key)
    return dealt.sortWithinPartitions(key).drop(key)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH RECURSIVE per AS (SELECT source, count(*) AS n, round(pow(CAST(count(*) AS DOUBLE), 0.5), 6) AS weight FROM documents GROUP BY source),
rate AS (SELECT source, round(weight / (SELECT sum(weight) FROM per) * (SELECT CAST(sum(n) AS DOUBLE) FROM per) / n, 9) AS mean FROM per),
split AS (SELECT source, CASE WHEN mean > 512 THEN floor(mean) - 256 ELSE 0 END AS base, mean FROM rate),
cdf AS (
  SELECT source, base, mean - base AS m, 0 AS j, exp(-(mean - base)) AS p, exp(-(mean - base)) AS c FROM split
  UNION ALL
  SELECT source, base, m, j + 1, p * m / (j + 1), c + p * m / (j + 1) FROM cdf WHERE j < least(600, CAST(floor(m + 12 * sqrt(m) + 30) AS INTEGER))),
draws AS (
  SELECT doc_id, text, lang, source, n_chars, row_number() OVER () AS rid,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix-1'), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents),
counted AS (
  SELECT d.rid, CAST(any_value(cdf.base) AS BIGINT) + count(*) FILTER (WHERE d.u >= cdf.c) AS n
  FROM draws d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source GROUP BY d.rid)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, k.copy_no
FROM draws d JOIN counted c USING (rid), LATERAL (SELECT unnest(range(0, c.n)) AS copy_no) k
"""


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards shares that grow with the root of a source's size; columns as they came, and copy_no.

    Nulls in source or doc_id, repeated rows, ties and an empty table are treated as ``replicate`` says."""
    return replicate(docs)
