"""Predicates and projections over reads, rows and pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import seq as S


def min_length(df: DataFrame, least: int = 160) -> DataFrame:
    return df.where(F.length("seq") >= least)


def identity_share(a: Column, b: Column) -> Column:
    """Equal columns over the read's letters, inside the overlap; null without letters."""
    return S.let(S.summary(a, b), lambda s: s["ident"] / F.nullif(s["ident"] + s["mismatches"] + s["insertions"], F.lit(0)))


def by_identity(pairs: DataFrame, threshold: float = 0.2) -> DataFrame:
    return pairs.where(identity_share(F.col("a"), F.col("b")) > threshold)


def few_ambiguous(df: DataFrame, most: int = 2, symbol: str = "N") -> DataFrame:
    return df.where(S.count_char(F.col("seq"), symbol) <= most)


def ambiguous_share(df: DataFrame, under: float = 0.1) -> DataFrame:
    return df.where(S.count_char(F.col("seq"), "N") < F.length("seq") * F.lit(under))


def gap_share(df: DataFrame, under: float = 0.1, interior: bool = False) -> DataFrame:
    """Rows with a share of gaps under the limit; ``interior`` leaves flanking gaps out."""
    s = F.trim(F.col("seq"), F.lit("-")) if interior else F.col("seq")
    return df.where((F.length(s) > 0) & (S.count_char(s, "-") < F.length(s) * F.lit(under)))


def interior_uncovered(df: DataFrame, most: int = 10, symbol: str = "X") -> DataFrame:
    """Non-empty rows with at most so many symbols between the first and last other letter."""
    s = F.trim(F.col("seq"), F.lit(symbol))
    return df.where((F.length(s) > 0) & (S.count_char(s, symbol) <= most))


def one_of(column: str, values: list) -> Column:
    """Disjunction column = value or ..., false for no value."""
    return reduce(lambda a, b: a | b, [F.col(column) == v for v in values], F.lit(False))


def is_numeric(c: Column) -> Column:
    return F.trim(c).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")


def demultiplex(df: DataFrame, forward: dict[str, str], backward: dict[str, str] | None = None, most: int = 1) -> DataFrame:
    """Sample of each read by its leading tag with at most one mismatch, the first tag that fits; forward reads are trimmed.

    Adds sample, strand (+, -, or null) and trimmed (null unless forward)."""
    fits = lambda tag: (F.length("seq") >= len(tag)) & (S.hamming(F.substring("seq", 1, len(tag)), F.lit(tag)) <= most)
    sample, strand, trimmed = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    tags = [(n, t, "+") for n, t in forward.items()] + [(n, t, "-") for n, t in (backward or {}).items()]
    for name, tag, side in reversed(tags):
        hit = fits(tag)
        sample = F.when(hit, F.lit(name)).otherwise(sample)
        strand = F.when(hit, F.lit(side)).otherwise(strand)
        trimmed = F.when(hit, F.expr(f"substring(seq, {len(tag) + 1})") if side == "+" else F.lit(None).cast("string")).otherwise(trimmed)
    return df.select("*", sample.alias("sample"), strand.alias("strand"), trimmed.alias("trimmed"))


def halves(df: DataFrame) -> DataFrame:
    """Each read as two rows, read_id with -a and -b; the first half is the shorter one."""
    n = F.floor(F.length("seq") / 2).cast("int")
    parts = F.array(
        F.struct(F.concat(F.col("read_id").cast("string"), F.lit("-a")).alias("part_id"), F.substring(F.col("seq"), F.lit(1), n).alias("seq")),
        F.struct(F.concat(F.col("read_id").cast("string"), F.lit("-b")).alias("part_id"), F.substring(F.col("seq"), n + 1, F.length("seq")).alias("seq")),
    )
    return df.select(F.explode(parts).alias("p")).select("p.part_id", "p.seq")


def region(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Reads whose interval meets [start, stop]."""
    return df.where((F.col("start") <= stop) & (F.col("stop") >= start))


def region_rows(df: DataFrame, begin: int, end: int, least: int = 30) -> DataFrame:
    """Reads that meet [begin, end), as rows of that width with gaps around; at least so many letters between the flanks."""
    width = end - begin
    cut = F.substring(F.col("seq"), F.greatest(F.lit(begin) - F.col("start"), F.lit(0)) + 1, F.lit(width) - F.greatest(F.col("start") - begin, F.lit(0)))
    row = F.rpad(F.concat(F.repeat(F.lit("-"), F.greatest(F.col("start") - begin, F.lit(0))), cut), width, "-")
    return region(df, begin, end - 1).select("read_id", row.alias("row")).where(F.length(F.trim("row", F.lit("-"))) >= least)


def column_slice(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Columns [start, stop) of every row, from 0."""
    return df.withColumn("seq", F.substring("seq", start + 1, stop - start))


def lowest_quality(qual: Column) -> Column:
    """Place (from 0) of the first lowest score; -1 for no score."""
    return F.when(F.size(qual) > 0, F.array_position(qual, F.array_min(qual)) - 1).otherwise(F.lit(-1).cast("long"))


def signed(df: DataFrame, picks: list[int]) -> DataFrame:
    """Columns by number from 1, with the sign flipped for negative numbers."""
    return df.select(*[(F.col(df.columns[abs(k) - 1]) * (1 if k > 0 else -1)).alias(f"c{i}") for i, k in enumerate(picks, 1)])


def by_posterior(df: DataFrame, least: float = 0.8) -> DataFrame:
    """Window results whose posterior is above the bound."""
    return df.where(F.col("posterior") > least)


def unique_only(aligned: DataFrame) -> DataFrame:
    """(read_id, score) of reads with one alignment only (is_unique)."""
    return aligned.where("is_unique").select("read_id", "score")


def pending(windows: DataFrame, done: DataFrame) -> DataFrame:
    """Windows (wstart, ...) that are not among those done (wstart)."""
    return windows.join(done.select("wstart").distinct(), "wstart", "left_anti")
