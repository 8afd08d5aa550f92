"""From reads and a reference to haplotype frequencies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import align, em, graph, joins, sampler
from readloom.operators.filters import by_identity
from readloom.operators.state import durable


@dataclass(frozen=True)
class Settings:
    """Numbers of the whole way; the defaults are those for reads of some hundred letters."""

    least_length: int = 160
    identity: float = 0.7
    pad: bool = False
    width: int = 201
    shifts: int = 3
    iterations: int = 1000
    alpha: float = 0.01
    least_overlap: int = 100
    most_haplotypes: int = 200
    restarts: int = 50
    seed: int = 1


def aligned_rows(reads: DataFrame, reference: str, settings: Settings = Settings()) -> DataFrame:
    """(read_id, start, stop, len, seq): reads (read_id, seq) of the least length, on their better strand, similar enough to the
    reference, laid on one alignment; with ``pad`` insertions open columns in all rows, without they are dropped."""
    best = durable(align.best_strand(reads.where(F.length("seq") >= settings.least_length), reference))
    like = by_identity(best.withColumnsRenamed({"ref_row": "a", "read_row": "b"}), settings.identity).withColumnsRenamed({"a": "ref_row", "b": "read_row"})
    rows = align.propagate_gaps(durable(like.select("read_id", "ref_row", "read_row")), settings.pad)
    lead = F.length("row") - F.length(F.ltrim("row", F.lit("-")))
    laid = rows.select("read_id", lead.alias("start"), F.trim("row", F.lit("-")).alias("seq")).where("length(seq) > 0")
    return laid.withColumn("len", F.length("seq")).withColumn("stop", F.col("start") + F.col("len") - 1)


def haplotype_frequencies(reads: DataFrame, reference: str, settings: Settings = Settings()) -> tuple[DataFrame, int]:
    """((hap_id, seq, p), lost): alignment, correction by windows, removal of contained reads, read graph, haplotypes as paths
    or united chain covers, and their frequencies; lost counts corrected reads that no haplotype explains."""
    placed = durable(aligned_rows(reads, reference, settings))
    corrected, _ = sampler.local_correction(placed, settings.width, settings.shifts, settings.iterations, settings.alpha, settings.seed)
    corrected = durable(corrected.withColumn("len", F.length("seq")).withColumn("stop", F.col("start") + F.col("len") - 1))
    rest = durable(joins.remove_contained(corrected))
    edges = durable(joins.overlaps(rest, settings.least_overlap))
    edges = durable(graph.reduction(edges, graph.closure(edges)))
    length = corrected.agg(F.max("stop")).first()[0]
    haps = durable(graph.haplotypes(rest, edges, None if length is None else length + 1, settings.most_haplotypes, settings.restarts, settings.seed))
    return em.estimate(corrected, haps)
