"""Writers of sequence files and plot data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fasta_record(name: Column, seq: Column, width: int = 60) -> Column:
    """A FASTA record with wrapped lines and no final line feed."""
    return F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", ""))


def write_fasta(df: DataFrame, path: str, name: str = "read_id", seq: str = "seq", width: int = 60, gzip: bool = False) -> None:
    out = df.select(fasta_record(F.col(name).cast("string"), F.col(seq), width).alias("value")).write.mode("overwrite")
    (out.option("compression", "gzip") if gzip else out).text(path)


def write_reads(df: DataFrame, path: str) -> None:
    """Lines ``start seq``."""
    df.select(F.concat_ws(" ", F.col("start").cast("string"), "seq").alias("value")).write.mode("overwrite").text(path)


def write_by_class(df: DataFrame, path: str, column: str, seq: str = "seq", name: str = "read_id", gzip: bool = False) -> None:
    """FASTA records in one folder for each class."""
    out = df.select(F.col(column), fasta_record(F.col(name).cast("string"), F.col(seq)).alias("value")).write.mode("overwrite").partitionBy(column)
    (out.option("compression", "gzip") if gzip else out).text(path)


def write_posterior(corrected: DataFrame, support: DataFrame, history: DataFrame, path: str) -> None:
    """Corrected reads, haplotype support and frequency table of windows, each kind in a folder of window folders."""
    cor = corrected.select("wstart", fasta_record(F.concat("read_id", F.lit("|posterior="), F.round("posterior", 6).cast("string")), F.col("hap")).alias("value"))
    sup = support.select("wstart", fasta_record(F.concat(F.lit("hap_"), F.col("rank").cast("string"), F.lit("|posterior="), F.round("posterior", 6).cast("string"), F.lit(" ave_reads="), F.round("ave_reads", 4).cast("string")), F.col("hap")).alias("value"))
    frq = history.groupBy("wstart", "hap").agg(F.count(F.lit(1)).alias("support"), F.array_sort(F.collect_list(F.struct("iter", "weight"))).alias("h"))
    frq = frq.select("wstart", F.concat_ws("\t", "hap", F.col("support").cast("string"), F.array_join(F.transform("h", lambda x: x["weight"].cast("string")), "\t")).alias("value"))
    for kind, df in (("corrected", cor), ("support", sup), ("freq", frq)):
        df.write.mode("overwrite").option("compression", "gzip").partitionBy("wstart").text(f"{path}/{kind}")


def write_frequencies(df: DataFrame, path: str, prefix: str = "HAP") -> None:
    """Haplotypes with a positive frequency, most frequent first: (rank, p, seq)."""
    rec = fasta_record(F.concat(F.lit(prefix), F.col("rank").cast("string"), F.lit("_"), F.round("p", 6).cast("string")), F.col("seq"))
    df.where("p > 0").repartitionByRange(1, "rank").sortWithinPartitions("rank").select(rec.alias("value")).write.mode("overwrite").text(path)  # a few haplotypes


def write_table(df: DataFrame, path: str, sep: str = "\t", header: bool = True, missing: str = "undef") -> None:
    """A matrix with labels; null cells are written as ``missing``."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in df.columns]).write.mode("overwrite").csv(path, sep=sep, header=header)


def cross_table(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of row by column over stated column values."""
    return df.groupBy(row).pivot(column, values).count().fillna(0)


def tex_rows(df: DataFrame) -> DataFrame:
    """Rows of a table in TeX."""
    return df.select(F.concat(F.concat_ws(" & ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(r" \\")).alias("value"))


def human_rows(df: DataFrame, mutation: str = "mutation", n: str = "n") -> DataFrame:
    return df.select(F.concat(F.col(mutation), F.lit(" seen "), F.col(n).cast("string"), F.lit(" times")).alias("value"))


def clustal_lines(df: DataFrame, width: int = 60) -> DataFrame:
    """(block, name, line): rows (name, row) in blocks of a width."""
    return df.select("name", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("row") - 1) / width).cast("int")))).alias("block"), "row").select(
        "block", "name", F.concat(F.rpad("name", 16, " "), F.substring(F.col("row"), F.col("block") * width + 1, F.lit(width))).alias("line")
    )


def phylip_lines(df: DataFrame) -> DataFrame:
    """(name, line): sequential form, names of ten characters."""
    return df.select("name", F.concat(F.rpad("name", 10, " "), "row").alias("line"))


def stockholm_lines(df: DataFrame) -> DataFrame:
    return df.select("name", F.concat("name", F.lit(" "), "row").alias("line"))


def write_msa(df: DataFrame, path: str, kind: str, width: int = 60) -> None:
    """An alignment (name, row) as clustal, phylip or stockholm. The formats are one file each, which one task writes in
    order; rows are dealt to it sorted, and stream through."""
    spark = df.sparkSession
    n, size = df.count(), df.agg(F.max(F.length("row"))).first()[0] or 0
    if kind == "clustal":
        body = clustal_lines(df, width).select(F.col("block").alias("k"), "name", F.col("line").alias("value"))
        head, tail = "CLUSTAL W (1.83) multiple sequence alignment\n", None
    elif kind == "phylip":
        body, head, tail = phylip_lines(df).select(F.lit(0).alias("k"), "name", F.col("line").alias("value")), f" {n} {size}", None
    elif kind == "stockholm":
        body, head, tail = stockholm_lines(df).select(F.lit(0).alias("k"), "name", F.col("line").alias("value")), "# STOCKHOLM 1.0", "//"
    else:
        raise ValueError(f"cannot write {kind}")
    if kind == "clustal":
        body = body.unionByName(body.select("k").distinct().select("k", F.lit("\uffff").alias("name"), F.lit("").alias("value")))
    ends = [(-1, "", head)] + ([(1 << 30, "", tail)] if tail else [])
    every = spark.createDataFrame(ends, "k int, name string, value string").unionByName(body)
    every.repartition(1).sortWithinPartitions("k", "name").select("value").write.mode("overwrite").text(path)


def write_kinds(frames: dict[str, DataFrame], path: str) -> None:
    """Text tables (value) of several kinds, gzipped, each in a folder of its kind."""
    for kind, df in frames.items():
        df.select("value").write.mode("overwrite").option("compression", "gzip").text(f"{path}/kind={kind}")
