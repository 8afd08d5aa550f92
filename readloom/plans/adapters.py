"""Reads made of the driver's tables, in Spark and in the same terms as SQL.

``reads``: letters of a text mapped to ACGT, placed at a start derived from the id (0-based).
``rows``: the text itself as an aligned row, letters mapped to ACGT or N, all else a gap.
``bases``: the rows in long form, positions from 1.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOUR = "ACGTACGTACGTACGTACGTACGTAC"
FIVE = "ACGTACGTANGTACGTNCGTACGNAN"
SPREAD = 50


def letters(text: Column, other: str, to: str) -> Column:
    return F.translate(F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", other)), LETTERS, to)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the cores if the session asks for it (readloom.spread): a file of one row group is one task
    otherwise. Only for small files of few splits, as in the bench; large inputs have splits enough."""
    if df.sparkSession.conf.get("readloom.spread", "false") != "true":
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


_OWN = string.ascii_letters.encode()
TABLE = bytes.maketrans(_OWN, "".join(FOUR[LETTERS.index(c.upper())] for c in string.ascii_letters).encode())
OTHERS = bytes(c for c in range(256) if c not in _OWN)  # letters(text, "", FOUR) is encode().translate(TABLE, OTHERS)
_GAPS = bytes(c if c in _OWN else ord("-") for c in range(256))
ROW_TABLE = _GAPS.translate(bytes.maketrans(_OWN, "".join(FIVE[LETTERS.index(c.upper())] for c in string.ascii_letters).encode()))
INNER = bytes(range(0x80, 0xC0))  # bytes of a letter after its first; letters(text, "-", FIVE) is encode().translate(ROW_TABLE, INNER)


def _mapped(docs: DataFrame, table: bytes, drop: bytes) -> DataFrame:
    """``docs`` with seq made of its text, by bytes: columns would do it letter by letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                seqs = [t.translate(table, drop) for t in some.column("seq").cast(pa.binary()).to_pylist()]
                yield some.set_column(some.schema.get_field_index("seq"), "seq", pa.array(seqs, pa.binary()).cast(pa.string()))

    own = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumnRenamed("text", "seq")
    return own.mapInArrow(run, own.schema)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, start, seq, len, stop), interval 0-based inclusive; only reads with letters."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), (F.col("doc_id") % SPREAD).cast("int").alias("start"), "text"))
    return _mapped(docs, TABLE, OTHERS).where("length(seq) > 0").select("*", F.length("seq").alias("len")).withColumn("stop", F.col("start") + F.col("len") - 1)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, lang, source, seq) over ACGT-N."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), "lang", "source", "text"))
    return _mapped(docs, ROW_TABLE, INNER)


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, lang, pos, base)."""
    r = rows(spark, sf_dir)
    return r.where("length(seq) > 0").select("read_id", "lang", F.posexplode(F.split("seq", "")).alias("p", "base")).select("read_id", "lang", (F.col("p") + 1).cast("long").alias("pos"), "base")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, a, b): each row with the row of the next id, both filled with gaps to one length."""
    r = rows(spark, sf_dir).select("read_id", "seq")
    nxt = r.select((F.col("read_id") - 1).alias("read_id"), F.col("seq").alias("t"))
    n = F.greatest(F.length("seq"), F.length("t"))
    return r.join(nxt, "read_id").select("read_id", F.rpad("seq", n, "-").alias("a"), F.rpad("t", n, "-").alias("b"))


def haps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hap_id, seq) of the benchmark's texts."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("hap_id"), letters(F.col("text"), "", FOUR).alias("seq"))


_MAP = f"translate(upper(regexp_replace(coalesce(text,''),'[^A-Za-z]','%s','g')),'{LETTERS}','%s')"
SQL = {
    "reads": f"""reads AS (SELECT read_id, start, seq, CAST(length(seq) AS INTEGER) AS len, CAST(start + length(seq) - 1 AS INTEGER) AS stop
 FROM (SELECT doc_id AS read_id, CAST(doc_id % {SPREAD} AS INTEGER) AS start, {_MAP % ("", FOUR)} AS seq FROM documents) WHERE length(seq) > 0)""",
    "rows": f"rws AS (SELECT doc_id AS read_id, lang, source, {_MAP % ('-', FIVE)} AS seq FROM documents)",
    "bases": "bases AS (SELECT read_id, lang, unnest(range(1, length(seq) + 1)) AS pos, unnest(string_split(seq, '')) AS base FROM rws WHERE length(seq) > 0)",
    "pairs": """prs AS (SELECT x.read_id, rpad(x.seq, CAST(greatest(length(x.seq), length(y.seq)) AS INTEGER), '-') AS a,
 rpad(y.seq, CAST(greatest(length(x.seq), length(y.seq)) AS INTEGER), '-') AS b FROM rws x JOIN rws y ON y.read_id - 1 = x.read_id)""",
    "haps": f"haps AS (SELECT item_id AS hap_id, {_MAP % ('', FOUR)} AS seq FROM benchmark)",
}


def with_(*names: str, then: str = "") -> str:
    """A WITH clause of the named adapters and ``then``."""
    need = []
    for n in names:
        for m in ({"bases": ["rows"], "pairs": ["rows"]}.get(n, []) + [n]):
            if m not in need:
                need.append(m)
    return "WITH " + ", ".join([SQL[n] for n in need] + ([then] if then else [])) + " "
