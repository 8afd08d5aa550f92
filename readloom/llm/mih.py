"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

A bounded sample fits the codes: the vectors are centred, projected on their principal directions and turned by
``rotations`` rotations, each refined by iterative quantisation from its own random start; the signs are the bits. The code
is cut into ``m`` substrings of 16 bits, and each substring has a table from its value to the rows that have it. Every
table is probed at all values within a small ball of b bits around the query's: if two codes differ in at most (b + 1) m - 1
bits, then some substring differs in at most b, so all codes of that radius are retrieved. The ball is learned on the sample. Of what is retrieved, rows whose
complete distance exceeds a limit learned on the sample are dropped, and the original vectors rerank the rest.

On vectors that are spread evenly in many dimensions the nearest neighbours differ in more than a third of all bits, and no
radius that holds them by the pigeonhole argument alone leaves a table unread. Many short substrings with a small ball find
them nevertheless, since one of many tables is enough: the recall is measured, not guaranteed.

Rows are dealt over shards by a hash of their id, each with its own tables; queries come in blocks and meet every shard,
and a shard answers with its nearest ``k``. If fewer than ``k`` are found there, the ball and the limit grow by a bit until
they are, or the whole shard is compared. No bucket is capped and no key gathers rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import hash_share, table

WORD = 16
POPCOUNT = np.array([bin(i).count("1") for i in range(1 << WORD)], dtype=np.uint8)


@dataclass(frozen=True)
class Codes:
    """Mean, projection to bits, and what the sample taught: the limit of the complete distance, and the ball."""

    mean: np.ndarray
    turn: np.ndarray
    limit: int
    ball: int = 2

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Substring values, (rows, substrings) of uint16."""
        bits = ((x - self.mean) @ self.turn > 0).astype(np.uint8)
        return np.packbits(bits, axis=1, bitorder="little").view("<u2")


def fit(sample: np.ndarray, rotations: int = 30, k: int = 10, wanted: float = 0.9, steps: int = 3, seed: int = 7) -> Codes:
    """Codes for vectors like those of ``sample`` (rows, dims). The ball is the smallest, from two bits on, in which the
    tables hold the wanted share of the true neighbours inside the sample; a larger table has nearer ones."""
    dims = sample.shape[1]
    mean = sample.mean(axis=0)
    x = sample - mean
    values, vectors = np.linalg.eigh(x.T @ x / max(1, len(x)))
    width = -(-dims // WORD) * WORD
    rng = np.random.default_rng(seed)
    turns = []
    base = vectors[:, np.argsort(-values)]
    y = x @ base
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((width, width)))[0][:dims]
        for _ in range(steps):
            signs = np.where(y @ r > 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(y.T @ signs, full_matrices=False)
            r = u @ vt
        turns.append(base @ r)
    codes = Codes(mean, np.hstack(turns), 0)
    c = codes.encode(sample)
    asked = rng.permutation(len(sample))[: min(300, len(sample))]
    needed, least = [], []
    for i in asked:
        d = ((sample - sample[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        differ = POPCOUNT[c[near] ^ c[i]]
        needed += differ.sum(axis=1, dtype=np.int64).tolist()
        least += differ.min(axis=1).tolist()
    if not needed:
        return Codes(mean, codes.turn, 0)
    ball = next((b for b in range(2, len(BALLS) - 1) if np.mean(np.array(least) <= b) >= wanted), len(BALLS) - 1)
    return Codes(mean, codes.turn, int(np.quantile(needed, 0.999)), ball)


def valid(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def _balls(most: int) -> list[np.ndarray]:
    """For each radius the 16-bit masks of at most so many bits."""
    of = lambda n: [sum(1 << b for b in bits) for bits in combinations(range(WORD), n)]
    out = [np.array(of(0), dtype=np.uint16)]
    for n in range(1, most + 1):
        out.append(np.concatenate([out[-1], np.array(of(n), dtype=np.uint16)]))
    return out


BALLS = _balls(4)


class Shard:
    """Different rows of one shard, with a table for each substring: where the rows of each value begin, and the rows by value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes):
        rows = np.lexsort((*vectors.T[::-1], ids))
        if len(rows):
            new = (ids[rows][1:] != ids[rows][:-1]) | (vectors[rows][1:] != vectors[rows][:-1]).any(axis=1)
            rows = rows[np.append(True, new)]  # a row that is repeated is one candidate
        self.ids, self.vectors, self.codes = ids[rows], vectors[rows], codes.encode(vectors[rows])
        n, m = self.codes.shape
        self.rows, self.first = np.empty((m, n), dtype=np.int32), np.zeros((m, (1 << WORD) + 1), dtype=np.int32)
        for s in range(m):
            self.rows[s] = np.argsort(self.codes[:, s], kind="stable")
            np.cumsum(np.bincount(self.codes[:, s], minlength=1 << WORD), out=self.first[s, 1:])

    def fetched(self, code: np.ndarray, ball: int) -> np.ndarray:
        """Rows that a table holds within ``ball`` bits of the substring's value."""
        hit = np.zeros(len(self.ids), dtype=bool)
        for s, value in enumerate(code):
            probes = BALLS[ball] ^ value
            lo, sizes = self.first[s, probes], self.first[s, probes.astype(np.int64) + 1] - self.first[s, probes]
            at = np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            hit[self.rows[s, at]] = True
        return np.flatnonzero(hit)

    def nearest(self, ident: int, vector: np.ndarray, code: np.ndarray, codes: Codes, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the shard's ``k`` nearest found."""
        for ball in range(codes.ball, len(BALLS)):
            rows = self.fetched(code, ball)
            far = POPCOUNT[self.codes[rows] ^ code].sum(axis=1, dtype=np.int64)
            rows = rows[(far <= codes.limit + (ball - codes.ball) * len(code)) & (self.ids[rows] != ident)]
            if len(rows) >= k:
                break
        else:
            rows = np.flatnonzero(self.ids != ident)
        dist = np.sqrt(((self.vectors[rows] - vector) ** 2).sum(axis=1))
        best = np.lexsort((self.ids[rows], dist))[:k]
        return self.ids[rows][best], dist[best]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, sample_rows: int = 4_000, shard_rows: int = 65_536, block_rows: int = 8_192, rotations: int = 30, wanted: float = 0.9
) -> DataFrame:
    """The ``k`` nearest found of every query: query_id, rank, vec_id, score (Euclidean distance, double).

    Both tables have ``vec_id`` and ``embedding``; further columns are not read. Null, zero and non-finite vectors take
    no part, on either side; a vector is not its own neighbour (same id). A candidate row that is repeated (id and vector)
    is one candidate; of one id with several vectors each is a candidate. Repeated query rows give their answer once, and of
    a query id with several vectors the smallest one is asked. Ties go to the smaller id; with fewer than ``k`` candidates
    all are returned; empty tables give no rows. ``sample_rows`` bounds the rows that fit the codes (chosen by a hash of
    the id); every row is indexed.
    """
    spark = vectors.sparkSession
    clean = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull()).where(valid(F.col("embedding")))
    ask = queries.select("vec_id", "embedding").where(F.col("vec_id").isNotNull()).where(valid(F.col("embedding")))
    ask = ask.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n, asked = clean.count(), ask.count()
    share = min(1.0, sample_rows / max(1, n))
    rows = clean.where(hash_share(F.col("vec_id"), "mih-sample") < share).select("embedding").limit(2 * sample_rows).collect()
    out = "query_id bigint, vec_id bigint, score double"
    if not rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    fitted = spark.sparkContext.broadcast(fit(np.array([r[0] for r in rows], dtype=np.float64), rotations, k, wanted))
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // block_rows))

    def answer(key, own: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        codes, found = fitted.value, []
        if len(own) and len(theirs):
            shard = Shard(own["vec_id"].to_numpy(np.int64), np.array(own["embedding"].tolist(), dtype=np.float64), codes)
            q = np.array(theirs["embedding"].tolist(), dtype=np.float64)
            for name, vector, code in zip(theirs["vec_id"], q, codes.encode(q)):
                ids, dist = shard.nearest(name, vector, code, codes, k)
                found.append(pd.DataFrame({"query_id": np.full(len(ids), name, dtype=np.int64), "vec_id": ids, "score": dist}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": np.int64, "vec_id": np.int64})

    # each id's rows are merged before they are dealt, so that copies of one row don't gather in a shard
    own = clean.distinct().withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit("shard")), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    theirs = ask.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    near = own.groupBy("shard", "block").cogroup(theirs.groupBy("shard", "block")).applyInPandas(answer, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))  # of k rows of each shard
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
