"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.state import durable, shared_folder

__all__ = ["by_size", "connected_components", "crc_of_id", "durable", "hash_share", "shared_folder", "slices", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_size(texts: list[str], most: int = 1 << 20, rows: int = 1_000_000) -> Iterator[list[str]]:
    """The texts in order, in runs of at most ``most`` characters and ``rows`` texts; a longer text is a run of its own."""
    first = size = 0
    for at, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if at > first and (size + n > most or at - first >= rows):
            yield texts[first:at]
            first, size = at, 0
        size += n
    if len(texts) > first:
        yield texts[first:]


def slices(parts: Iterator[pd.DataFrame], rows: int = 1_000, most: int = 1 << 22) -> Iterator[pd.DataFrame]:
    """Arrow batches (which Spark bounds in bytes) in pieces of bounded rows and characters of column ``text``, so that what
    is made of each stays small too."""
    for pdf in parts:
        at = 0
        for some in by_size(list(pdf["text"]), most, rows):
            yield pdf.iloc[at : at + len(some)]
            at += len(some)


def unused(df: DataFrame) -> str:
    """A beginning for names of further columns that no column of the table has."""
    out = "_rl_"
    while any(c.lower().startswith(out) for c in df.columns):
        out += "_"
    return out


def crc_of_id(col: str = "doc_id") -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary"))


def hash_share(col: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the value only, used to choose bounded samples."""
    return F.pmod(F.xxhash64(col, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), and for each the smallest node that it is connected with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    low = np.arange(len(nodes))  # nodes are sorted, so smaller numbers are smaller nodes
    while True:
        to = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, low[x], to)
        np.minimum.at(new, low[y], to)
        new = np.minimum(new, new[new])
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def connected_components(edges: DataFrame, together: int = 1_000_000) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (columns ``a``, ``b``; bigint) that have an edge to another node:
    the smallest node reachable. Nulls and loops are ignored.

    The edges of every partition are first replaced by a star for each of its components. If at most ``together``
    different edges are left (16 MB), one executor's task finishes the work; otherwise large-star and small-star contraction alternate
    until the edge set is stable. Both give the same components. Each step of the second way is a partial minimum per
    node and a join of two plain shuffles, which Spark splits at hubs.
    """
    named = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b")
    cur = durable(named.mapInPandas(_stars, "a bigint, b bigint").distinct())
    n = cur.count()
    if n <= together:
        return durable(cur.repartition(1).mapInPandas(_finish, "node bigint, component bigint"))
    state = (n, None)
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = durable(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        big = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = durable(big.where("a <> b").distinct())  # a is the larger end throughout
        low = durable(big.groupBy("a").agg(F.min("b").alias("m")))
        small = big.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        cur = durable(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        new = tuple(cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if new == state:
            break
        state = new
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _stars(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        if len(pdf):
            nodes, low = smallest_reachable(pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64))
            yield pd.DataFrame({"a": nodes[nodes != low], "b": low[nodes != low]})


def _finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    every = [pdf for pdf in parts if len(pdf)]
    if every:
        nodes, low = smallest_reachable(np.concatenate([p["a"].to_numpy(np.int64) for p in every]), np.concatenate([p["b"].to_numpy(np.int64) for p in every]))
        yield pd.DataFrame({"node": nodes, "component": low})
