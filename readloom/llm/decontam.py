"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ``window`` consecutive words (an item with fewer words is one
window). The words of every window are ordered by rarity over all documents; since containment
must be exact, the necessary prefix is the rarest word alone. Those prefix words form an inverted
index (word, item, place in the item). Document words are joined with it, length and positional
bounds discard alignments that cannot hold a window, and the words around each hit are compared
with the item's to find the exact run. A run that is at least a window long marks its words.

An index of at most ``broadcast_rows`` rows is broadcast, and document texts are never shuffled. A larger one is joined by
a shuffle of the document words that may be in it, each with its neighbours: a bitmap of the index words' hashes, of a
fixed size, leaves out most others. Either way the documents are read twice, whatever the size of the benchmark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import durable, table, unused

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, other letters as they are."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


BITMAP = 1 << 23  # bits


def _bitmap(words_of: DataFrame) -> DataFrame:
    """One row: the words' bitmap as an array of 64-bit numbers."""
    bit = F.pmod(F.xxhash64("word"), F.lit(BITMAP))
    cells = words_of.select((bit / 64).cast("int").alias("cell"), F.expr("shiftleft(1L, int(pmod(xxhash64(word), 64)))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    held = F.map_from_entries(F.collect_list(F.struct("cell", "bits")))
    return cells.agg(held.alias("held")).select(F.transform(F.sequence(F.lit(0), F.lit(BITMAP // 64 - 1)), lambda c: F.coalesce(F.try_element_at("held", c), F.lit(0).cast("long"))).alias("bitmap"))


def _in_bitmap(word: Column, bitmap: Column) -> Column:
    cell = (F.pmod(F.xxhash64(word), F.lit(BITMAP)) / 64).cast("int")
    return F.getbit(F.get(bitmap, cell), F.pmod(F.xxhash64(word), F.lit(64)).cast("int")) == 1


def _index(docs: DataFrame, items: DataFrame, window: int, broadcast_rows: int) -> DataFrame:
    """Prefix words: (word, item_id, at, need, before, after)."""
    entries = durable(
        items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("iw"))
        .where(F.size("iw") > 0)
        .distinct()
        .select("item_id", "iw", F.posexplode("iw").alias("at", "word"))
    )
    vocabulary = durable(entries.select("word").distinct())
    few = vocabulary.count() <= broadcast_rows
    occurrences = docs.select(F.explode(words(F.col("text"))).alias("word"))
    if few:
        counted = occurrences.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    else:
        counted = occurrences.groupBy("word").agg(F.count(F.lit(1)).alias("df")).join(vocabulary, "word")
    ranked = (
        entries.join(counted, "word", "left")
        .withColumn("rank", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "at"))
        .withColumn("width", F.least(F.lit(window), F.size("iw")))
        .withColumn("first", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("width") + 1), F.least(F.col("at"), F.size("iw") - F.col("width")))))
    )
    prefix = ranked.groupBy("item_id", "iw", "width", "first").agg(F.min("rank").alias("rank"))
    return durable(
        prefix.select("item_id", "iw", "width", F.col("rank.word").alias("word"), F.col("rank.at").alias("at"))
        .distinct()
        .select(
            "word",
            "item_id",
            "at",
            F.col("width").alias("need"),
            F.reverse(F.slice("iw", F.greatest(F.lit(1), F.col("at") - window + 2), F.least(F.col("at"), F.lit(window - 1)))).alias("before"),
            F.slice("iw", F.col("at") + 2, F.lit(window - 1)).alias("after"),
        )
    )


def _agree(same: list[Column]) -> Column:
    """How many of the comparisons hold before the first that fails. No higher-order function: the join's
    own generated code evaluates it, so that a candidate never leaves it with the whole document."""
    out = F.when(~same[0], 0)
    for n, x in enumerate(same[1:], 1):
        out = out.when(~x, n)
    return out.otherwise(len(same))


def _found_by_broadcast(base: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_hash, n_words, item_id, pos, need, l, r): runs of l words before pos and r after it that equal an
    item's; and for each row of ``base`` one with need 0, which brings the word count along."""
    end = "\u0000"  # cannot be a word: its one entry meets every row once
    empty = F.array().cast(T.ArrayType(T.StringType()))
    mark = index.sparkSession.range(1).select(F.lit(end).alias("word"), F.lit(None).cast("string").alias("item_id"), F.lit(0).alias("at"), F.lit(0).alias("need"), empty.alias("before"), empty.alias("after"))
    placed = base.select("doc_id", "text_hash", "w", F.posexplode(F.concat("w", F.array(F.lit(end)))).alias("pos", "word"))
    left = _agree([_equal(F.get("w", F.col("pos") - k), F.get("before", F.lit(k - 1))) for k in range(1, max(2, window))])
    right = _agree([_equal(F.get("w", F.col("pos") + k), F.get("after", F.lit(k - 1))) for k in range(1, max(2, window))])
    fits = (F.size("w") >= F.col("need")) & (F.col("pos") < F.size("w"))
    hits = placed.join(F.broadcast(index.unionByName(mark)), "word").where((F.col("need") == 0) | (fits & (left + 1 + right >= F.col("need"))))
    return hits.select("doc_id", "text_hash", F.size("w").alias("n_words"), "item_id", "pos", "need", left.alias("l"), right.alias("r"))


def _found_by_shuffle(base: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """The same rows, by a join on the word; a document word brings its neighbours along."""
    placed = base.select("doc_id", "text_hash", "w", F.posexplode("w").alias("pos", "word"))
    placed = placed.where(_in_bitmap(F.col("word"), _bitmap(index.select("word").distinct()).scalar()))
    placed = placed.select(
        "doc_id", "text_hash", F.size("w").alias("n_words"), "pos", "word",
        F.reverse(F.slice("w", F.greatest(F.lit(1), F.col("pos") - window + 2), F.least(F.col("pos"), F.lit(window - 1)))).alias("x"),
        F.slice("w", F.col("pos") + 2, F.lit(window - 1)).alias("y"),
    )
    left = _agree([_equal(F.get("x", F.lit(k - 1)), F.get("before", F.lit(k - 1))) for k in range(1, max(2, window))])
    right = _agree([_equal(F.get("y", F.lit(k - 1)), F.get("after", F.lit(k - 1))) for k in range(1, max(2, window))])
    hits = placed.join(index, "word").where((F.col("n_words") >= F.col("need")) & (left + 1 + right >= F.col("need")))
    hits = hits.select("doc_id", "text_hash", "n_words", "item_id", "pos", "need", left.alias("l"), right.alias("r"))
    zero = F.lit(0)
    return hits.unionByName(base.select("doc_id", "text_hash", F.size("w").alias("n_words"), F.lit(None).cast("string").alias("item_id"), zero.alias("pos"), zero.alias("need"), zero.alias("l"), zero.alias("r")))


def _equal(x: Column, y: Column) -> Column:
    return F.coalesce(x == y, F.lit(False))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, broadcast_rows: int = 200_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_words, n_hit, n_items, item_ids, contaminated.

    Null or wordless texts have no words and are clean; items without words match nothing; repeated
    document rows each get the result; repeated item rows count once, and equal texts under several
    item ids are several items. The items without an id count as one item, which item_ids leaves out. An empty benchmark
    leaves every document clean; of no documents the result is empty. Other columns of either table are not read.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    index = _index(docs, items, window, broadcast_rows)
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    runs = (_found_by_broadcast if index.count() <= broadcast_rows else _found_by_shuffle)(base, index, window)
    hit = F.col("need") > 0
    span = F.struct((F.col("pos") - F.col("l")).alias("s"), (F.col("pos") + F.col("r") + 1).alias("e"))
    per_doc = runs.groupBy("doc_id", "text_hash").agg(
        F.count(F.when(~hit, 1)).alias("rows"),
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set(F.when(hit, span)).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.max((hit & F.col("item_id").isNull()).cast("int")).alias("nameless"),
    )
    covered = F.aggregate(  # spans in order; what each adds beyond the furthest end so far
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["to"]))).cast("long").alias("n"), F.greatest(acc["to"], x["e"]).alias("to")
        ),
    )["n"]
    return (
        per_doc.withColumn("n_hit", covered)
        .withColumn("one", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
        .select("doc_id", "text_hash", "n_words", "n_hit", (F.size("item_ids") + F.col("nameless")).cast("long").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"))
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS width, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS sh
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM win),
occ AS (
  SELECT rid, p, width, array_to_string(w[p : p + width - 1], ' ') AS sh
  FROM (SELECT rid, w, width, unnest(range(1, CAST(len(w) - width + 2 AS BIGINT))) AS p FROM d, widths WHERE len(w) >= width)),
hit AS (SELECT o.rid, o.p, o.width, win.item_id FROM occ o JOIN win ON o.sh = win.sh AND o.width = win.width),
pos AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + width)) AS q FROM (SELECT DISTINCT rid, p, width FROM hit)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256,
       coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; columns as they came.

    Null, empty and wordless texts stay; repeated rows stay or go together; an empty benchmark leaves all, an empty table gives
    no rows."""
    own = unused(docs)
    bad = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    bad = bad.select(F.col("doc_id").alias(own + "id"), F.col("text_hash").alias(own + "hash")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(own + "id")) & (F.xxhash64("text") == F.col(own + "hash")), "left_anti")
