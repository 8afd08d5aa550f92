"""Expectation-maximisation of haplotype frequencies from compatibilities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.aggregates import fill_uncovered, numbered
from readloom.operators.joins import compatible
from readloom.operators.state import durable


def step(compat: DataFrame, freq: DataFrame) -> DataFrame:
    """One round: (hap_id, p) from (read_id, hap_id, n) and (hap_id, p). Reads weigh n."""
    held = F.collect_list(F.struct("hap_id", "p"))  # the haplotypes of one read
    per = compat.join(freq, "hap_id").groupBy("read_id").agg(F.max("n").alias("n"), F.sum("p").alias("whole"), held.alias("held"))
    part = per.select(F.explode("held").alias("h"), (F.col("n") / F.col("whole")).alias("w")).groupBy("h.hap_id").agg(F.sum(F.col("h.p") * F.col("w")).alias("u"))
    total = compat.select("read_id", "n").distinct().agg(F.sum("n").cast("double").alias("t")).scalar()  # shares of a read add up to its weight
    return part.select("hap_id", (F.col("u") / total).alias("p"))


def log_likelihood(compat: DataFrame, freq: DataFrame) -> float:
    per = compat.join(freq, "hap_id").groupBy("read_id", "n").agg(F.sum("p").alias("s"))
    return per.agg(F.sum(F.col("n") * F.log("s"))).first()[0]


def explained(reads: DataFrame, compat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads that some haplotype holds (compat: read_id, hap_id), and the number of the others (lost)."""
    known = compat.select("read_id").distinct()
    return reads.join(known, "read_id", "left_semi"), reads.join(known, "read_id", "left_anti").agg(F.count(F.lit(1)).alias("lost"))


def estimate(reads: DataFrame, haps: DataFrame, rounds: int | None = None, most: int = 5000, tolerance: float = 1e-6, kill: float = 0.0) -> tuple[DataFrame, int]:
    """((hap_id, seq, p), lost) from placed reads (read_id, start, stop, len, seq) and haplotypes (seq, uncovered places as dots).

    Uncovered places take the consensus letter and haplotypes become unique; equal reads are one with a weight; reads that
    no haplotype holds are dropped and counted (lost); the rest go through the rounds of ``frequencies``."""
    own = durable(numbered(fill_uncovered(haps), [F.col("seq")], "hap_id"))
    weighed = durable(reads.groupBy("start", "stop", "len", "seq").agg(F.min("read_id").alias("read_id"), F.count(F.lit(1)).alias("n")))
    compat = durable(compatible(weighed, own))
    kept, _ = explained(weighed, compat)
    lost = weighed.join(kept.select("read_id"), "read_id", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    freq = frequencies(compat.join(weighed.select("read_id", "n"), "read_id"), rounds, most, tolerance, kill)
    return freq.join(own, "hap_id").select("hap_id", "seq", "p"), lost


def frequencies(compat: DataFrame, rounds: int | None = None, most: int = 5000, tolerance: float = 1e-6, kill: float = 0.0) -> DataFrame:
    """(hap_id, p) at convergence, or after ``rounds``. The start is uniform: the likelihood is concave, so that any start
    with all haplotypes reaches the same value. Haplotypes under ``kill`` at the end are left out."""
    haps = durable(compat.select("hap_id").distinct())
    n = haps.count()
    if 0 < n <= MOST_HAPS and haps.schema["hap_id"].dataType.simpleString() in ("int", "bigint") and haps.where("hap_id is null").isEmpty():
        return _held_frequencies(compat, haps, rounds, most, tolerance, kill)
    freq = durable(haps.select("hap_id", (F.lit(1.0) / n).alias("p")))
    before = None
    for k in range(1, (rounds or most) + 1):
        freq = durable(step(compat, freq))
        if rounds is None:
            now = log_likelihood(compat, freq)
            if k > 2 and before is not None and abs(now - before) <= tolerance:
                break
            before = now
    return freq.where(F.col("p") > kill)


MOST_HAPS = 2_000_000  # whose frequencies go to every task; more are joined


def _held_frequencies(compat: DataFrame, haps: DataFrame, rounds: int | None, most: int, tolerance: float, kill: float) -> DataFrame:
    """The same rounds with the frequencies in every task: reads are gathered once, one row for each, and a round is one look at
    them, without a join or a shuffle of reads. It has the likelihood of the frequencies that it starts from."""
    spark = compat.sparkSession
    ids = np.sort(haps.toArrow().column("hap_id").to_numpy())
    known = spark.sparkContext.broadcast(ids)
    per = compat.where("read_id is not null").groupBy("read_id").agg(F.max("n").cast("double").alias("n"), F.collect_list("hap_id").alias("held"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # places of the haplotypes, as bytes: a batch of reads is one row
            held, size = batch.column("held"), np.asarray(batch.column("held").value_lengths(), dtype=np.int32)
            at = np.searchsorted(known.value, held.flatten().to_numpy()).astype(np.int32)
            n = np.nan_to_num(batch.column("n").to_numpy(zero_copy_only=False).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (n, size, at)], ["n", "size", "held"])

    reads = durable(per.select("n", "held").mapInArrow(numbered, "n binary, size binary, held binary"))

    def look(p: np.ndarray) -> tuple[np.ndarray, float, float]:
        """The frequencies after a round times the reads' weight, the likelihood before it, and that weight."""
        shared = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, sums = np.zeros(len(shared.value)), np.zeros(2)
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("n", "size", "held"))):
                    n, size, held = (np.frombuffer(x, dtype=t) for x, t in zip(row, (np.float64, np.int32, np.int32)))
                    here = shared.value[held]
                    whole = np.add.reduceat(here, np.cumsum(size) - size)
                    own += np.bincount(held, here * np.repeat(n / whole, size), len(own))
                    sums += (n * np.log(whole)).sum(), n.sum()
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1, -2], pa.int32()), pa.array([*own[at].tolist(), *sums.tolist()], pa.float64())], ["at", "u"])

        got = reads.mapInArrow(run, "at int, u double").groupBy("at").agg(F.sum("u").alias("u")).toArrow()  # no more than the haplotypes
        shared.unpersist()
        at, u = got.column("at").to_numpy(), got.column("u").to_numpy()
        out = np.zeros(len(p))
        out[at[at >= 0]] = u[at >= 0]
        return out, float(u[at == -1].sum()), float(u[at == -2].sum())

    p, before = np.full(len(ids), 1.0 / len(ids)), None
    for k in range((rounds or most) + 1):
        if k == (rounds or most) and rounds is not None:
            break
        u, now, total = look(p)
        if rounds is None and k > 0:
            if k > 2 and before is not None and abs(now - before) <= max(tolerance, 2 * np.spacing(abs(now))) or k == most:
                break  # a sum over very many reads can't tell less than its last bits
            before = now
        p = u / total
    kind = haps.schema["hap_id"].dataType.simpleString()
    return spark.createDataFrame(pa.table({"hap_id": ids, "p": p})).select(F.col("hap_id").cast(kind).alias("hap_id"), "p").where(F.col("p") > kill)
