"""Texts that lie at places: where do the first letters of one stand in another, and does the rest agree?

Letters are bytes here. Texts are looked at batch by batch as one array of bytes, so that a hash of the letters from every
place on costs a few array operations; only places where a text begins with the same letters leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEEDS = (16, 32, 64, 128, 256, 512)  # numbers of first letters by which texts meet; shorter texts meet by all of theirs
LETTERS = 1 << 17  # looked at together: their arrays stay in the cache
MOST_WORDS = 23  # bits of the number of words in a filter: 64 MB
_RNG = np.random.default_rng(20)
_OF_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE, _PLACE, _SIZE = (int(x) | 1 for x in _RNG.integers(0, 1 << 64, 3, dtype=np.uint64))


_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, dtype=np.uint64))])


def _lead(k: int) -> int:
    """So many first letters of texts that meet by k letters are looked for at every place; the rest only where they stand."""
    return 16 if k >= 16 else 4 if k >= 4 else 1


def _at(place: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return place.astype(np.uint64) * np.uint64(_PLACE)


def _key(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    x = h + at
    x += np.uint64(k * _SIZE % (1 << 64))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters of a column of texts without nulls, and where each begins (one more for the end)."""
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8), o


def _pieces(o: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with so many letters together, or of one row."""
    lo = 0
    while lo < len(o) - 1:
        hi = max(lo + 1, int(np.searchsorted(o, o[lo] + LETTERS, side="right")) - 1)
        yield lo, hi
        lo = hi


def _released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what the last one took is given back before the next one comes."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def lengths(texts: DataFrame) -> list[int]:
    """The sizes for texts (seq) to be met: all lengths below the smallest seed that occur, and the seeds up to the longest."""
    n = F.least(F.octet_length("seq"), F.lit(SEEDS[-1]))
    size = F.coalesce(*[F.when(n >= k, k) for k in reversed(SEEDS)], n)
    found = [r[0] for r in texts.select(size.alias("k")).distinct().collect()]  # no more than the seeds and the lengths below
    return sorted(k for k in found if k)


def keyed(texts: DataFrame, sizes: list[int], digest: bool = True) -> DataFrame:
    """(read_id, start, n, key, lead, digest) of texts (read_id, start, seq): a hash of the place and the first letters, as many as
    the largest of the sizes that the text has, and one of the first few of those; its length; 128 bits of the whole text."""
    kind = texts.schema["read_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(_BASE, max(sizes, default=1))
        for batch in _released(batches):
            data, offsets = _texts(batch.column("seq"))
            starts = batch.column("start").to_numpy()
            for lo, hi in _pieces(offsets):
                o, start = offsets[lo : hi + 1], starts[lo:hi]
                n = np.diff(o)
                key, lead, at = np.zeros(hi - lo, dtype=np.uint64), np.zeros(hi - lo, dtype=np.uint64), np.searchsorted(sizes, n, side="right") - 1
                for j, k in enumerate(sizes):
                    own = np.flatnonzero(at == j)
                    step = max(1, LETTERS // k)
                    for some in (own[i : i + step] for i in range(0, len(own), step)):
                        first = _OF_BYTE[data[o[some][:, None] + np.arange(k)]]
                        first *= powers[:k]
                        key[some] = _key(first.sum(axis=1, dtype=np.uint64), _at(start[some]), k)
                        lead[some] = _key(first[:, : _lead(k)].sum(axis=1, dtype=np.uint64), _at(start[some]), -_lead(k))
                view = memoryview(data)
                whole = [blake2b(view[a:b], digest_size=16).digest() if digest else b"" for a, b in zip(o[:-1].tolist(), o[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("read_id")[lo:hi], pa.array(start), pa.array(n), pa.array(key.view(np.int64)), pa.array(lead.view(np.int64)), pa.array(whole, pa.binary())], ["read_id", "start", "n", "key", "lead", "digest"])

    least = sizes[0] if sizes else 1
    own = texts.where(F.octet_length("seq") >= least).select("read_id", F.col("start").cast("long").alias("start"), "seq")
    return own.mapInArrow(run, f"read_id {kind}, start long, n long, key long, lead long, digest binary")


class Filter:
    """A set of hashes as bits, for the tasks: it holds all that are in it, and about one in 1,000 that are not, up to 16
    million hashes. A hash sets four bits of one word; there is a word for every two hashes."""

    BITS = 4

    def __init__(self, hashes: DataFrame, n: int):
        self.width = min(MOST_WORDS, max(8, (n // 2).bit_length()))
        h = F.col(hashes.columns[0])
        mask = reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(self.BITS)])
        cells = hashes.select(F.shiftrightunsigned(h, 64 - self.width).alias("cell"), mask.alias("bits"))
        got = cells.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()  # no more than the words
        words = np.zeros(1 << self.width, dtype=np.uint64)
        words[got.column("cell").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
        self.words = hashes.sparkSession.sparkContext.broadcast(words)

    def held(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that are in the set."""
        word, one = self.words.value[hashes >> np.uint64(64 - self.width)], np.uint64(1)
        at = np.flatnonzero((word >> (hashes & np.uint64(63))) & one)
        for i in range(1, self.BITS):
            at = at[((word[at] >> ((hashes[at] >> np.uint64(6 * i)) & np.uint64(63))) & one).astype(bool)]
        return at


def having(rows: DataFrame, column: str, hashes: Filter) -> DataFrame:
    """Rows whose hash in that column (long) may be in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(hashes.held(batch.column(column).to_numpy().view(np.uint64))))

    return rows.mapInArrow(run, rows.schema)


def only(texts: DataFrame, ids: Filter) -> DataFrame:
    """Rows whose read_id, by xxhash64, may be in the filter."""
    return having(texts.withColumn("_hash", F.xxhash64("read_id")), "_hash", ids).drop("_hash")


def stands(covers: DataFrame, sizes: list[int], keys: Filter, side: str = "") -> DataFrame:
    """(read_id, start, stop, place, key) of texts (read_id, start, seq): the places from which on the letters may have one of
    the keys, for each of the sizes. The filter holds the leads, too. Also (digest), 128 bits of the letters on one ``side``: from
    the place to the text's end ("after"; not for the text's own first place), or from the text's first letter to those of the
    key ("before"; not for its own last ones).

    Sums of letters times powers of a base give the hash of any stretch of letters by two of them."""
    kind = covers.schema["read_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, inverse = _powers(_BASE, LETTERS), _powers(_INVERSE, LETTERS)
        for batch in _released(batches):
            data, offsets = _texts(batch.column("seq"))
            starts = batch.column("start").to_numpy()
            for lo, hi in _pieces(offsets):
                o = offsets[lo : hi + 1] - offsets[lo]
                n, total = np.diff(o), int(o[-1])
                if total >= len(powers):
                    powers, inverse = _powers(_BASE, 2 * total), _powers(_INVERSE, 2 * total)
                sums = np.zeros(total + 1, dtype=np.uint64)
                np.cumsum(_OF_BYTE[data[offsets[lo] : offsets[hi]]] * powers[:total], out=sums[1:])
                row = np.repeat(np.arange(hi - lo), n)
                place = np.arange(total) + (starts[lo:hi] - o[:-1])[row]
                at, ends = _at(place), o[1:][row]
                for lead in sorted({_lead(k) for k in sizes}):
                    m = total - lead + 1
                    if m < 1:
                        break
                    some = keys.held(_key((sums[lead:] - sums[:m]) * inverse[:m], at[:m], -lead))
                    for k in (k for k in sizes if _lead(k) == lead):
                        own = some[some + k <= ends[some]]
                        if side:
                            own = own[own > o[:-1][row[own]]] if side == "after" else own[own + k < ends[own]]
                        key = _key((sums[own + k] - sums[own]) * inverse[own], at[own], k)
                        hit = keys.held(key)
                        if len(hit):
                            r = row[own[hit]]
                            s = starts[lo:hi][r]
                            columns = [batch.column("read_id").take(pa.array(lo + r)), pa.array(s), pa.array(s + n[r] - 1), pa.array(place[own[hit]]), pa.array(key[hit].view(np.int64))]
                            if side:
                                view, at_ = memoryview(data)[offsets[lo] : offsets[hi]], own[hit]
                                cuts = (at_, ends[at_]) if side == "after" else (o[:-1][r], at_ + k)
                                columns.append(pa.array([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(*(c.tolist() for c in cuts))], pa.binary()))
                            yield pa.RecordBatch.from_arrays(columns, ["read_id", "start", "stop", "place", "key", "digest"][: len(columns)])

    own = covers.where(F.octet_length("seq") > 0).select("read_id", F.col("start").cast("long").alias("start"), "seq")
    return own.mapInArrow(run, f"read_id {kind}, start long, stop long, place long, key long" + ", digest binary" * bool(side))


def holding(candidates: DataFrame, covers: DataFrame) -> DataFrame:
    """(read_id, other) of candidates (read_id, other, at, n, digest) where the n letters of the cover (read_id, seq) from ``at``
    on have that digest."""
    kinds = [candidates.schema[c].dataType.simpleString() for c in ("read_id", "other")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _released(batches):
            data, offsets = _texts(batch.column("seq"))
            view, asked = memoryview(data), batch.column("asked")
            flat = asked.flatten()
            row = np.repeat(np.arange(len(asked)), np.asarray(asked.value_lengths()))
            at = offsets[row] + flat.field("at").to_numpy()
            ends = at + flat.field("n").to_numpy()
            ok = [blake2b(view[a:b], digest_size=16).digest() == d for a, b, d in zip(at.tolist(), ends.tolist(), flat.field("digest").to_pylist())]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("read_id").take(pa.array(row)).filter(mask), flat.field("other").filter(mask)], ["read_id", "other"])

    per = candidates.groupBy("read_id").agg(F.collect_list(F.struct("other", "at", "n", "digest")).alias("asked"))
    return per.join(covers.select("read_id", "seq"), "read_id").mapInArrow(run, f"read_id {kinds[0]}, other {kinds[1]}")
