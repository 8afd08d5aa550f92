"""Near-duplicate lines by a segment-partition edit join.

Two lines within ``EDITS`` edits, one of them cut into EDITS + 1 segments, share a segment that lies in
the other at nearly the same place. Every different line enters its segments into an index, under
segment number, line length and content, and probes the index for lines of its own and of slightly
smaller length, at the few places that the segment of such a line can have (multi-match-aware
selection). Keys are 64-bit hashes; candidates must agree in a small sketch of character counts, which
an edit changes by two at most, so that lines which merely share a long segment never leave the join
as pairs. Their texts are fetched by line id and verified by a banded bit-parallel edit distance.

Equal lines are one line throughout, of whatever length. Linked lines form classes; of a class the first occurrence, by
doc_id and place, is kept. Line ids are 64-bit hashes of the text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import by_size, connected_components, durable, slices, table, unused

EDITS = 2


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance of two strings is at most ``k``: bit-parallel, in a band of 2k + 1 diagonals."""
    if a == b:
        return True
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > k:
        return False
    start = len(os.path.commonprefix((a, b)))
    a, b = a[start:], b[start:]
    end = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if len(a) <= k:
        return True
    if not b:
        return False
    width = 2 * k + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    up, down = (full << (width - k - 1)) & full, 0  # vertical differences +1 and -1, inside the band
    dist, side, n = k, top >> 1, len(a)
    limit = 2 * k + len(b) - n  # beyond it the rest of the band can't bring the distance down to k
    for i, c in enumerate(b):
        first = i + k + 1 - width  # place in a of the band's lowest bit
        same = 0
        for bit in range(max(0, -first), min(width, n - first)):
            if a[first + bit] == c:
                same |= 1 << bit
        diag = (((same & up) + up) ^ up) | same | down
        plus = down | ~(diag | up)
        minus = diag & up
        if i < n - k:
            dist += not diag & top
        else:
            dist += bool(plus & side) - bool(minus & side)
            side >>= 1
        if dist > limit:
            return False
        half = (diag & full) >> 1
        up = (minus | ~(half | plus)) & full
        down = half & plus & full
    return dist <= k


def line_id(line: str) -> int:
    h = xxhash.xxh64_intdigest(line.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def _far(x: Column, y: Column) -> Column:
    """Lower bound of twice the edit distance, from two sketches."""
    total = F.lit(0)
    for s in range(0, 64, 4):
        d = (F.shiftrightunsigned(x, s).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(y, s).bitwiseAND(F.lit(15))).bitwiseAND(F.lit(15))
        total = total + F.least(d, F.lit(16) - d)
    return total


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """Start and length of each of the k + 1 segments of a line of that length; the last ones take the rest."""
    q, r = divmod(length, k + 1)
    sizes = [q] * (k + 1 - r) + [q + 1] * r
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


OWN, LEVEL, SHORTER = 0, 1, 2


@lru_cache(maxsize=1 << 14)
def probes(length: int, k: int) -> list[tuple[int, int, int, int, int]]:
    """What a line looks up: (role, segment, indexed length, place, size). Its own segments are OWN and stand in the
    index; shifted places of lines of the same length are LEVEL, those of smaller lengths SHORTER."""
    out = []
    for delta in range(k + 1):
        for i, (at, size) in enumerate(segments(length - delta, k), 1):
            for shift in range(max(-(i - 1), delta - (k + 1 - i)), min(i - 1, delta + (k + 1 - i)) + 1):
                if at + shift >= 0 and at + shift + size <= length:
                    out.append((SHORTER if delta else LEVEL if shift else OWN, i, length - delta, at + shift, size))
    return out


@lru_cache(maxsize=1 << 14)
def _places(length: int, k: int) -> np.ndarray:
    """The probes of a line of that length, one row each: place, end, seed of the key."""
    return np.array([(at, at + size, (i * 1_000_003 + indexed) * 0x9E3779B97F4A7C15 % (1 << 63)) for _, i, indexed, at, size in probes(length, k)], dtype=np.uint64)


_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        n = max(n, 2 * len(_POWERS[0]))
        for j, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(n, base, dtype=np.uint64)
            step[0] = 1
            _POWERS[j] = np.cumprod(step)
    return _POWERS


def features(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each line the sketch, and the hashed keys of its probes, (lines, probes); lines hold 10 (k + 1) characters or more.

    The sketch counts 16 groups of characters, modulo 16, four bits each. A key hashes number and indexed length of a
    segment and its characters, by differences of one running polynomial hash over all lines.
    """
    wide = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    starts = np.cumsum(lengths) - lengths
    group = (wide * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) >> np.uint64(28)
    counts = np.bincount(np.repeat(np.arange(len(lines)), lengths) * 16 + group.astype(np.int64), minlength=16 * len(lines)).reshape(-1, 16)
    sketch = ((counts.astype(np.uint64) & np.uint64(15)) << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    up, down = _powers(len(wide) + 1)
    sums = np.zeros(len(wide) + 1, dtype=np.uint64)
    np.cumsum((wide + np.uint64(1)) * up[: len(wide)], out=sums[1:])
    sizes, which = np.unique(lengths, return_inverse=True)
    table = np.stack([_places(n, k) for n in sizes.tolist()]) if len(lines) else np.zeros((0, len(probes(10 * (k + 1), k)), 3), dtype=np.uint64)
    here = table[which]
    lo, hi = (starts[:, None] + here[:, :, j].astype(np.int64) for j in (0, 1))
    h = (sums[hi] - sums[lo]) * down[lo] ^ here[:, :, 2]
    for mix in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(mix)
    return sketch.view(np.int64), (h ^ (h >> np.uint64(29))).view(np.int64)


def _lines(text: str | None, least: int) -> Iterator[tuple[int, str]]:
    """(place, line) of the lines that are long enough, without outer blanks."""
    for n, raw in enumerate(text.split("\n") if isinstance(text, str) else ()):
        line = raw.strip(" \t\r")
        if len(line) >= least:
            yield n, line


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, id) of every line that is not blank."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(parts):
            rows = [(at, n, line_id(line)) for at, t in enumerate(pdf["text"]) for n, line in _lines(t, 1)]
            at, n, ids = zip(*rows) if rows else ((), (), ())
            own = pdf.iloc[list(at)]
            yield pd.DataFrame({"doc_id": own["doc_id"].to_numpy(), "text_hash": own["text_hash"].to_numpy(np.int64), "line_no": n, "id": ids})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInPandas(run, f"doc_id {kind}, text_hash bigint, line_no int, id bigint")


def _each(docs: DataFrame, least: int, columns, schema: str) -> DataFrame:
    """What ``columns`` makes of the lines that are new in their batch: one row each, with the line's id."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(parts):
            new = list({line for t in pdf["text"] for _, line in _lines(t, least)})
            for some in by_size(new, 1 << 18):
                yield pd.DataFrame({"id": np.fromiter(map(line_id, some), dtype=np.int64, count=len(some)), **columns(some)})

    return docs.where(F.col("text").isNotNull()).select("text").mapInPandas(run, schema)


def line_links(docs: DataFrame, least: int = 40, k: int = EDITS, broadcast_ids: int = 2_000_000) -> DataFrame:
    """Pairs (a, b), a < b, of ids of different lines of at least ``least`` characters within ``k`` edits; each pair once.

    The texts to verify are those of candidate lines only: the scan is joined with their ids, which are broadcast while
    they number at most ``broadcast_ids`` (16 MB), and by a shuffle beyond that."""
    if least < 10 * (k + 1):
        raise ValueError("lines have to hold 10 (k + 1) characters at least")
    roles = [p[0] for p in probes(10 * (k + 1), k)]
    names = [f"k{j}" for j in range(len(roles))]

    def columns(lines: list[str]) -> dict:
        sketch, keys = features(lines, k)
        return {"sketch": sketch, **dict(zip(names, keys.T))}

    found = _each(docs, least, columns, "id bigint, sketch bigint, " + ", ".join(f"{n} bigint" for n in names))
    unique = found.groupBy("id").agg(F.max("sketch").alias("sketch"), *[F.max(n).alias(n) for n in names])

    def entries(kinds: tuple[int, ...]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.col(n).alias("key"), F.lit(r).cast("tinyint").alias("role")) for n, r in zip(names, roles) if r in kinds]))
        return unique.select("id", "sketch", each.alias("e")).select("id", "sketch", "e.key", "e.role")

    i, p = entries((OWN,)).alias("i"), entries((OWN, LEVEL, SHORTER)).alias("p")
    once = (F.col("p.role") == SHORTER) | (F.col("i.id") < F.col("p.id"))
    close = (F.col("i.id") != F.col("p.id")) & (_far(F.col("i.sketch"), F.col("p.sketch")) <= 2 * k)
    pairs = p.join(i, (F.col("i.key") == F.col("p.key")) & once & close).select(F.least("i.id", "p.id").alias("a"), F.greatest("i.id", "p.id").alias("b"))
    pairs = durable(pairs.distinct())

    @F.pandas_udf(T.BooleanType())
    def verify(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([within(s, t, k) for s, t in zip(x, y)], dtype=bool)

    ids = durable(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    few = ids.count() <= broadcast_ids
    texts = _each(docs, least, lambda lines: {"line": lines}, "id bigint, line string").join(F.broadcast(ids) if few else ids, "id", "left_semi").dropDuplicates(["id"])
    texts = durable(texts)
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    return both.where(verify(F.col("x"), F.col("y"))).select("a", "b")


def line_classes(docs: DataFrame, least: int = 40, k: int = EDITS) -> DataFrame:
    """One row per line that is not blank: doc_id, text_hash, line_no, class_doc_id, class_line_no, n_links, kept.

    The class is named by its first occurrence, which is the kept one; n_links counts the different lines within ``k``
    edits. Equal lines of any length are of one class; lines that differ are linked if they hold ``least`` or more
    characters, as few edits turn most shorter ones into each other. Null, empty and blank texts have no lines; of a row
    that is repeated (doc_id and text), lines are the same occurrences; a null doc_id comes first; an empty table gives
    no rows; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    links = durable(line_links(docs, least, k))
    comp = connected_components(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    classes = ends.join(comp, ends["id"] == comp["node"]).select("id", "n_links", F.col("component").alias("class"))
    occ = durable(occurrences(docs))
    per_line = occ.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_hash", "line_no")).alias("first"))
    shared = durable(per_line.join(classes, "id", "left").where("n > 1 or class is not null").withColumn("class", F.coalesce("class", "id")))
    firsts = shared.groupBy("class").agg(F.min("first").alias("lead"))
    named = shared.join(firsts, "class").select("id", "lead", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    joined = occ.join(named, "id", "left")
    lead = F.coalesce("lead", F.struct("doc_id", "text_hash", "line_no"))
    return joined.select(
        "doc_id",
        "text_hash",
        "line_no",
        lead["doc_id"].alias("class_doc_id"),
        lead["line_no"].alias("class_line_no"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        lead.eqNullSafe(F.struct("doc_id", "text_hash", "line_no")).alias("kept"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(table(spark, sf_dir, "documents")).drop("text_hash")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are kept elsewhere; n_chars follows the text.

    Lines without a letter or digit are layout and stay. A document goes only if nothing but such lines is left of it and
    it lost a line: what stands in no other document, and the kept line of every class, always stay. One that loses no
    line stays as it is, null and empty texts included; repeated rows lose the same lines; an empty table gives no rows;
    other columns pass unread.
    """
    own = unused(docs)
    ident, text_hash, lost, text = (own + x for x in ("id", "hash", "lost", "text"))
    drop = line_classes(docs).where("not kept").groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias(lost))
    drop = drop.select(F.col("doc_id").alias(ident), F.col("text_hash").alias(text_hash), lost)
    joined = docs.join(drop, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.xxhash64("text") == F.col(text_hash)), "left")
    word = "[\\p{L}\\p{N}]"
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~(F.array_contains(lost, i) & x.rlike(word))), "\n")
    cut = joined.withColumn(text, F.when(F.col(lost).isNull(), F.col("text")).otherwise(left))
    stays = cut.where(F.col(lost).isNull() | F.col(text).rlike(word) | (F.col(text) == F.col("text")))
    changed = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(text).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return stays.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])
