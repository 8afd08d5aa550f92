"""Queries and SQL of this subpackage."""

from __future__ import annotations

from readloom.llm import decontam, langid, linededup, mih, mixing, quality, secrets, simhash, tokencount, toxicity

QUERIES = {
    "op1_secret_scan": secrets.op1,
    "op2_multi_index_nearest": mih.op2,
    "op3_weak_label_quality": quality.op3,
    "op4_language_id": langid.op4,
    "op5_line_dedup": linededup.op5,
    "op6_simhash_near_duplicates": simhash.op6,
    "op7_token_counts": tokencount.op7,
    "op8_source_mixing": mixing.op8,
    "op9_toxicity": toxicity.op9,
    "op10_benchmark_decontamination": decontam.op10,
}

ORACLE_SQL = {
    "op8_source_mixing": mixing.OP8_SQL,
    "op10_benchmark_decontamination": decontam.OP10_SQL,
}
