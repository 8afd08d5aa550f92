"""Corpus pipeline: quality, line dedup, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents (the last one adds copy_no);
its result is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from readloom.llm.decontam import decontaminate_stage
from readloom.llm.linededup import line_stage
from readloom.llm.mixing import mixing_stage
from readloom.llm.quality import quality_stage
from readloom.llm.simhash import simhash_stage
from readloom.operators.state import delete, shared_folder

STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("source_mixing", mixing_stage),
]

#: The quality classifier, line dedup and SimHash stages have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is a table in the shared checkpoint folder, deleted once the next one is written.

    Null, empty and blank texts go in the first stage; repeated rows in the third; an empty table gives no rows; further
    columns of documents pass unread.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
