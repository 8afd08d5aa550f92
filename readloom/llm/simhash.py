"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits, cut into ``SEGMENTS`` segments. Each segment has a table from its value to the fingerprints
that hold it. If two fingerprints differ in at most ``RADIUS`` bits, some segment differs in at most RADIUS // SEGMENTS:
so each fingerprint enumerates the small Hamming ball around each of its segments (33 values of 32 bits), fetches what
the tables hold there, and the complete distance is verified inside the join.

A group of near copies can put very many fingerprints under one segment value, which then would all be compared with each
other. What probes a value with more than ``hot`` holders is therefore linked by whole balls: every such fingerprint is
entered under each fingerprint within one bit of it (65 entries). Two of them are within two bits exactly if they share an
entry, an entry holds 65 at most, and its members are linked with the smallest of them.

Two bits do not reach texts of Jaccard similarity 0.8, which differ in ten bits on average: balls of the radius that would
catch them hold too many values. The pipeline's stage takes the tables' links and adds min-wise tables of shingle sets,
verifies complete distances against a wide radius there, and confirms every link by the whole sets (``near_copies``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import connected_components, durable, slices, table, unused

BITS, SEGMENTS, RADIUS = 64, 2, 2
NEAR = 4, 5  # Jaccard similarity of the pipeline's near copies, as a fraction
BANDS, ROWS = 20, 4  # min-wise tables: two sets of similarity 0.8 miss all of them with a chance of 0.00002
WIDE = 26  # bits; texts of similarity 0.8 differ in more with a chance under 0.00001


def _hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """Hashes of the word shingles of a text, in its order; of a shorter text all words are one shingle."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if len(words) < shingle:
        grams = [b" ".join(words)] if words else []
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), dtype="<u8")


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit integer; 0 for null or wordless texts."""
    return _majority(_hashes(text, shingle, seed))


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row, repeated ones included."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(parts):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "fp": [fingerprint(t, shingle) for t in pdf["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, fp bigint")


def _keys(flips: list[int]) -> Column:
    """Segment number and value, changed by each of the flips, as one number."""
    width = BITS // SEGMENTS
    part = lambda s: F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(s << width)
    return F.array(*[part(s).bitwiseXOR(F.lit(f)) if f else part(s) for s in range(SEGMENTS) for f in flips])


def links(unique: DataFrame, hot: int = 1_000, broadcast_keys: int = 1_000_000) -> DataFrame:
    """Edges (a, b) between different fingerprints (column fp, distinct) that connect all that are within RADIUS bits."""
    ball = [0] + [1 << j for j in range(BITS // SEGMENTS)]
    # a small table becomes 66 times as long: dealt out before, by a number of partitions that is not lowered again
    unique = unique.repartition(int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    held = unique.select("fp", F.explode(_keys([0])).alias("key"))
    probes = unique.select("fp", F.explode(_keys(ball)).alias("key"))
    crowded = durable(held.groupBy("key").count().where(F.col("count") > hot).select("key"))
    n = crowded.count()
    whole = None
    if n:
        crowded = F.broadcast(crowded) if n <= broadcast_keys else crowded
        whole = _linked_by_entries(probes.join(crowded, "key", "left_semi").select("fp").distinct())
        held = held.join(crowded, "key", "left_anti")
    x, y = probes.alias("x"), held.alias("y")
    close = (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS)
    found = x.join(y, (F.col("x.key") == F.col("y.key")) & close).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    return (found if whole is None else found.unionByName(whole)).distinct()


def _linked_by_entries(fps: DataFrame) -> DataFrame:
    """Edges that connect all of the fingerprints that are within two bits, by the balls of one bit around them."""
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in [0] + [1 << j for j in range(BITS)]])
    entries = fps.select("fp", F.explode(masks).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("entry"))
    least = F.min("fp").over(Window.partitionBy("entry"))
    return entries.withColumn("least", least).where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row: component_id is the smallest doc_id reachable over links.

    Equal fingerprints are one node, whatever their number. Null and empty texts have fingerprint 0
    and link like others; repeated rows and ties share a component; a component whose doc_ids are all
    null has a null component_id; an empty table gives no rows. Other columns are not read.
    """
    fps = durable(fingerprints(docs, shingle))
    unique = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = connected_components(links(unique.select("fp")))
    grouped = unique.join(comp, unique["fp"] == comp["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    roots = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(roots, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_rng = np.random.default_rng(5)
_TIMES, _PLUS = _rng.integers(0, 1 << 31, (2, BANDS * ROWS), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def set_keys(h: np.ndarray) -> np.ndarray:
    """A key for each min-wise table, of a set of hashes: equal in one table with probability similarity ** ROWS."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    short = (h >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 512):
        least = np.minimum(least, (short[at : at + 512, None] * _TIMES + _PLUS).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0xD1342543DE82EF95)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


_SKETCH = 1024  # one-bit min-wise sketch: bits agree with chance (1 + similarity) / 2
_APART = 140  # bits; sets of similarity 0.8 differ in more with a chance of 0.00005
_SKETCH_TIMES, _SKETCH_PLUS = np.random.default_rng(6).integers(0, 1 << 31, (2, _SKETCH), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def set_sketch(h: np.ndarray) -> np.ndarray:
    """A bit of each of many minima of a set of hashes, as 16 numbers."""
    least = np.full(_SKETCH, np.iinfo(np.uint32).max, dtype=np.uint32)
    short = (h >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 128):
        least = np.minimum(least, (short[at : at + 128, None] * _SKETCH_TIMES + _SKETCH_PLUS).min(axis=0))
    return np.packbits(((least * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8), bitorder="little").view("<i8")


def _sketches(sets: DataFrame) -> DataFrame:
    """(node, s0 .. s15)."""
    names = [f"s{k}" for k in range(_SKETCH // 64)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            made = np.array([set_sketch(np.asarray(x, dtype=np.int64).view(np.uint64)) for x in pdf["shingles"]], dtype=np.int64).reshape(len(pdf), len(names))
            yield pd.DataFrame({"node": pdf["node"], **dict(zip(names, made.T))})

    return sets.mapInPandas(run, "node bigint, " + ", ".join(f"{n} bigint" for n in names))


def _set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(_hashes(text, shingle, 42))


def _node(h: np.ndarray) -> int:
    """Name of a set of shingles."""
    return int(np.array([xxhash.xxh64_intdigest(h.tobytes(), 7)], dtype="<u8").view("<i8")[0])


def _members(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, node (the text's set of shingles), its size n, fingerprint fp and table keys, for every row."""

    def digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(parts):
            sets = [_set(t, shingle) for t in pdf["text"]]
            made = {"node": [_node(h) for h in sets], "n": [len(h) for h in sets], "fp": [_majority(h) for h in sets], "keys": [set_keys(h) for h in sets]}
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "text_hash": pdf["text_hash"].to_numpy(), **made})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInPandas(digest, f"doc_id {kind}, text_hash bigint, node bigint, n int, fp bigint, keys array<bigint>")


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int, broadcast_ids: int) -> DataFrame:
    """(node, shingles) of the given nodes (node, first); their texts are found by a join with the ids of their first rows."""

    def sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(parts, rows=250):
            found = [_set(t, shingle) for t in pdf["text"]]
            yield pd.DataFrame({"node": [_node(x) for x in found], "shingles": [x.view("<i8") for x in found]})

    few = nodes.count() <= broadcast_ids
    side = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    ids = nodes.select("first.doc_id", "first.text_hash").distinct()
    texts = docs.withColumn("text_hash", F.xxhash64("text")).join(side(ids), ["doc_id", "text_hash"], "left_semi").select("text")
    return texts.mapInPandas(sets, "node bigint, shingles array<bigint>").dropDuplicates(["node"]).join(side(nodes.select("node")), "node", "left_semi")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets have a Jaccard similarity of NEAR or more."""
    side = lambda end, to: sets.select(F.col("node").alias(end), F.col("shingles").alias(to))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    common, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return both.where((NEAR[0] + NEAR[1]) * common >= NEAR[0] * total).select("a", "b")


def _may(x: str, y: str) -> Column:
    """Whether sizes and complete fingerprint distance allow the similarity."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (NEAR[1] * F.least(n, m) >= NEAR[0] * F.greatest(n, m)) & (F.bit_count(F.col(f"{x}.fp").bitwiseXOR(F.col(f"{y}.fp"))) <= WIDE)


def near_copies(docs: DataFrame, shingle: int = 5, broadcast_ids: int = 2_000_000) -> DataFrame:
    """(doc_id, text_hash, lead): components of texts whose sets of word shingles have a Jaccard similarity of NEAR or more.

    ``lead`` is the smallest (doc_id, text_hash) of the component. Texts of one set are one node. Candidates are the
    links of the fingerprint tables and the nodes that share a key of a min-wise table; every link is confirmed by the
    whole sets. The holders of a key are first compared with one of them only, the one that the node shares most keys
    with, then with the leaders of its other keys, and what still lies in different components of one key with each
    other, if sketches of the sets are near enough: most of a group of near copies is one component by then, and it is not
    expanded into its pairs. Null and wordless texts
    share the empty set; repeated rows share a node; an empty table gives no rows; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    rows = durable(_members(docs, shingle))
    nodes = durable(rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.max(F.struct("n", "fp", "keys")).alias("s")).select("node", "first", "s.*"))
    entries = nodes.select("node", "n", "fp", F.explode("keys").alias("key"))
    order = F.struct(F.xxhash64("node", "key").alias("o"), "node", "n", "fp")  # another leader for each key
    leaders = entries.groupBy("key").agg(F.min(order).alias("l"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "l.node", "l.n", "l.fp")
    leaders = durable(leaders)
    x, y = entries.alias("x"), leaders.alias("y")
    star = x.join(y, F.col("x.key") == F.col("y.key")).where((F.col("x.node") != F.col("y.node")) & _may("x", "y"))
    star = durable(star.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count(F.lit(1)).alias("c")))
    best = star.groupBy("a").agg(F.max(F.struct("c", "b")).alias("m")).select("a", F.col("m.b").alias("b"))

    one = durable(nodes.groupBy("fp").agg(F.min("node").alias("node")))  # a node for each fingerprint
    name = lambda end: one.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_node"))
    tables = links(one.select("fp")).join(name("a"), "a").join(name("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    same = nodes.select("node", "fp").join(one.withColumnRenamed("node", "b"), "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    first = durable(reduce(DataFrame.unionByName, (best, tables, same)).distinct())

    shared = durable(entries.join(leaders.select("key"), "key"))  # of the keys that several nodes hold
    asked = first.select(F.explode(F.array("a", "b")).alias("node")).unionByName(shared.select("node")).distinct()
    sets = durable(_sets(docs, durable(nodes.select("node", "first").join(asked, "node")), shingle, broadcast_ids))
    found = durable(_similar(first, sets))
    comp = connected_components(found)

    of = lambda end: comp.select(F.col("node").alias(end), F.col("component").alias(f"{end}_comp"))
    apart = star.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_comp", "a") != F.coalesce("b_comp", "b")).select("a", "b")
    apart = durable(apart.join(first, ["a", "b"], "left_anti"))
    if apart.count():
        found = durable(found.unionByName(_similar(apart, sets)))
        comp = connected_components(found)

    held = shared.join(comp, "node", "left").select("key", "node", "n", "fp", F.coalesce("component", "node").alias("comp"))
    split = held.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    held = durable(held.join(split, "key"))
    if held.count():
        keys = held.groupBy("node").agg(F.collect_set("key").alias("keys"))  # as many as there are tables, at most
        held = durable(held.join(keys, "node").join(_sketches(sets.join(held.select("node").distinct(), "node", "left_semi")), "node"))
        x, y = held.alias("x"), held.alias("y")
        differ = sum((F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(_SKETCH // 64)), F.lit(0))
        once = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")  # a pair leaves the join under its first key only
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & _may("x", "y") & (differ <= _APART) & once).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        pairs = durable(pairs.join(apart, ["a", "b"], "left_anti"))
        comp = connected_components(found.unionByName(_similar(pairs, sets)))

    grouped = nodes.select("node", "first").join(comp, "node", "left").select("node", "first", F.coalesce("component", "node").alias("root"))
    leads = grouped.groupBy("root").agg(F.min("first").alias("lead"))
    return rows.select("doc_id", "text_hash", "node").join(grouped.join(leads, "root").select("node", "lead"), "node").select("doc_id", "text_hash", "lead")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (smallest doc_id): five-word shingles, Jaccard similarity of 0.8 or more.

    Rows without doc_id stay; of rows that are repeated word for word one stays, and so do rows of one doc_id with texts
    that are no near copies; null and wordless texts are one group; an empty table gives no rows; columns as they came.
    """
    own = unused(docs)
    ident, text_hash, same, copy = (own + x for x in ("id", "hash", "same", "copy"))
    named = docs.where(F.col("doc_id").isNotNull())
    keep = near_copies(named, shingle=5).where(F.col("lead") == F.struct("doc_id", "text_hash")).select(F.col("doc_id").alias(ident), F.col("text_hash").alias(same)).distinct()
    kept = named.withColumn(text_hash, F.xxhash64("text")).join(keep, (F.col("doc_id") == F.col(ident)) & (F.col(text_hash) == F.col(same)), "left_semi")
    copies = Window.partitionBy("doc_id", text_hash).orderBy("doc_id")  # equal texts, all of them
    kept = kept.withColumn(copy, F.row_number().over(copies)).where(F.col(copy) == 1)
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
