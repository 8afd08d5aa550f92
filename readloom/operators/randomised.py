"""Simulation, resampling and permutation, seeded by the rows themselves."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import seq as S
from readloom.operators.aggregates import numbered


def uniform(*keys, salt: int) -> Column:
    """A number in [0, 1) from a hash of the keys: the same again on a retried task."""
    return F.shiftrightunsigned(F.xxhash64(*keys, F.lit(salt)), 11) / F.lit(float(1 << 53))


def resolve_ambiguous(seq: Column, ident: Column, seed: int = 1) -> Column:
    """Each IUPAC letter replaced by one of its bases."""
    table = F.create_map(*[x for k, v in S.IUPAC.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def one(c: Column, i: Column) -> Column:
        own = F.element_at(table, c)
        return F.when(own.isNull(), c).otherwise(F.element_at(own, (F.floor(uniform(ident, i, salt=seed) * F.size(own)) + 1).cast("int")))

    return F.array_join(F.transform(S.chars(seq), one), "")


def sample_rows(df: DataFrame, n: int, ident: str, seed: int = 1) -> DataFrame:
    """n rows without replacement, in random order."""
    return df.orderBy(uniform(F.col(ident), salt=seed), ident).limit(n)


def shuffle_sequence(seq: Column, ident: Column, seed: int = 1) -> Column:
    """Letters of a sequence in random order."""
    tagged = F.transform(S.chars(seq), lambda c, i: F.struct(F.xxhash64(ident, i, F.lit(seed)).alias("h"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(tagged), lambda x: x["c"]), "")


def simulate_reads(spark: SparkSession, clones: list[str], n: int, length: int, error: float, seed: int = 1, shares: list[float] | None = None) -> DataFrame:
    """(read_id, clone, start, seq): reads of the clones by their shares, uniform starts, substitutions at the error rate."""
    shares = shares or [1 / len(clones)] * len(clones)
    base = spark.range(n).select(F.col("id").alias("read_id"))
    u = uniform("read_id", salt=seed)
    cuts = [sum(shares[: i + 1]) for i in range(len(clones))]
    clone = reduce(lambda c, i: F.when(u < cuts[i], i).otherwise(c), range(len(clones) - 2, -1, -1), F.lit(len(clones) - 1))
    own = F.element_at(F.array(*map(F.lit, clones)), F.col("clone") + 1)
    start = F.floor(uniform("read_id", salt=seed + 1) * (F.length("own") - length + 1)).cast("int")
    placed = base.withColumn("clone", clone).withColumn("own", own).withColumn("start", start).withColumn("cut", F.substring(F.col("own"), F.col("start") + 1, F.lit(length)))

    def letter(c: Column, i: Column) -> Column:
        other = F.replace(F.lit("ACGT"), c, F.lit(""))
        return F.when(uniform("read_id", i, salt=seed + 2) < error, F.substring(other, (F.floor(uniform("read_id", i, salt=seed + 3) * 3) + 1).cast("int"), F.lit(1))).otherwise(c)

    return placed.select("read_id", "clone", "start", F.array_join(F.transform(F.split("cut", ""), letter), "").alias("seq"))


def simulate_recombinants(spark: SparkSession, a: str, b: str, n: int, mean: float, sd: float, seed: int = 1) -> DataFrame:
    """(read_id, split, seq): first part of a and second part of b, with a normally distributed break-point."""
    normal = F.sqrt(-2 * F.log(1 - uniform("read_id", salt=seed))) * F.cos(2 * F.lit(3.141592653589793) * uniform("read_id", salt=seed + 1))
    split = F.least(F.greatest(F.round(normal * sd + mean), F.lit(0)), F.lit(min(len(a), len(b)))).cast("int")
    r = spark.range(n).select(F.col("id").alias("read_id")).withColumn("split", split)
    return r.select("read_id", "split", F.concat(F.substring(F.lit(a), F.lit(1), F.col("split")), F.substring(F.lit(b), F.col("split") + 1, F.lit(len(b)))).alias("seq"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def dealt_places(place: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Where a random permutation of 0 to n - 1, named by the key, puts each of the places.

    Each place is computed by itself: an alternating network over two residues whose product is n or a little more; what
    falls beyond n goes through once more."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    salts = _mixed(np.uint64(key % (1 << 64)) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out, todo = place.astype(np.uint64), np.arange(len(place))
    while len(todo):
        left, right = np.divmod(out[todo], np.uint64(b))  # below a, below b
        for k, salt in enumerate(salts):
            if k % 2:
                right = (right + _mixed(left ^ salt)) % np.uint64(b)
            else:
                left = (left + _mixed(right ^ salt)) % np.uint64(a)
        out[todo] = left * np.uint64(b) + right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


PLACES = 1 << 16  # that one step of a task looks at


def permutation_test(graph: DataFrame, labels: DataFrame, permutations: int = 200, seed: int = 1, groups: DataFrame | None = None) -> DataFrame:
    """(statistic, p_value): edges of a nearest-neighbour graph (i, j) that join equal labels, against random labellings.

    ``groups`` (first, i): sets of nodes that are all joined with each other, of which the graph needs to hold no edges.
    Nodes are placed in the order of their labels, and a permutation of the places is a function that each task computes for
    the nodes it sees: no labelling is ever written down. Labels go to the tasks as the places where they begin."""
    counts = sorted((r["label"], r["n"]) for r in labels.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect())
    placed = numbered(labels.select("i", "label"), [F.col("label").asc_nulls_last(), F.col("i")], "k").select("i", (F.col("k") - 1).alias("k"))
    ends, n = np.cumsum([c for _, c in counts], dtype=np.int64), labels.count()  # nodes without a label come last

    def codes(k: np.ndarray, perm: int) -> np.ndarray:
        """Labels under a permutation; 0 is the observed one."""
        if perm:
            k = dealt_places(k, n, (seed << 32) + perm)
        return np.searchsorted(ends, k, side="right")

    def summed(rows: dict[str, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"perm": np.arange(permutations + 1), **rows})

    def of_edges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, seen = np.zeros(permutations + 1, dtype=np.int64), 0
        for pdf in parts:
            nodes, at = np.unique(pdf[["ka", "kb"]].to_numpy(), return_inverse=True)
            a, b = at.reshape(-1, 2).T
            for perm in range(permutations + 1):
                own = codes(nodes, perm)
                t[perm] += int(((own[a] == own[b]) & (own[a] < len(ends))).sum())
            seen += len(pdf)
        if seen:
            yield summed({"t": t, "edges": seen})

    def of_groups(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, seen = np.zeros(permutations + 1, dtype=np.int64), 0

        def add(held: list[np.ndarray]) -> None:
            group, k = np.repeat(np.arange(len(held)), [len(h) for h in held]), np.concatenate(held)
            for perm in range(permutations + 1):
                own = codes(k, perm)
                of = (group * (len(ends) + 1) + own)[own < len(ends)]
                same = np.unique(of, return_counts=True)[1]
                t[perm] += int((same * (same - 1) // 2).sum())

        held, size = [], 0
        for pdf in parts:
            for ks in pdf["ks"]:
                held.append(np.asarray(ks, dtype=np.int64))
                size, seen = size + len(ks), seen + len(ks) * (len(ks) - 1) // 2
                if size >= PLACES:
                    add(held)
                    held, size = [], 0
        if held:
            add(held)
        if seen:
            yield summed({"t": t, "edges": seen})

    out = "perm long, t long, edges long"
    ends_of = lambda c, k: placed.select(F.col("i").alias(c), F.col("k").alias(k))
    both = graph.where("i < j").select("i", "j").join(ends_of("i", "ka"), "i").join(ends_of("j", "kb"), "j").select("ka", "kb")
    sums = both.mapInPandas(of_edges, out)
    if groups is not None:
        members = groups.select("first", "i").join(placed, "i").groupBy("first").agg(F.collect_list("k").alias("ks"))
        sums = sums.unionByName(members.where(F.size("ks") > 1).mapInPandas(of_groups, out))
    total = sums.groupBy("perm").agg(F.sum("t").alias("t"))
    observed = F.max(F.when(F.col("perm") == 0, F.col("t")))
    held = F.collect_list(F.when(F.col("perm") > 0, F.col("t")))  # one number for each permutation
    one = total.agg(observed.alias("statistic"), held.alias("null"))
    reached = F.size(F.filter("null", lambda t: t >= F.col("statistic")))
    return one.select("statistic", F.when(F.col("statistic").isNotNull(), (reached + 1) / (F.size("null") + 1)).alias("p_value"))
