"""Exact token counts by overlap resynchronisation.

Texts of up to ``chunk`` code points are encoded whole. Longer ones are encoded as overlapping chunks with offsets, so that
no encoding holds more than a chunk, and neighbouring chunks are spliced inside their overlap at a place that is proven
stable. A place qualifies if both encodings break there and have the same two tokens on either side of it, with the same
offsets. Byte-pair encodings are local: a sequence of tokens is the encoding of its text exactly if each two neighbours are
the encoding of theirs. The tokens before the place and their neighbours after it stand side by side in a whole encoding
of one chunk, so the left encoding up to the place and the right one from there on are together that of the text. When no
place qualifies, the overlap is doubled, up to a chunk that holds the rest of the text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import by_size, slices, table

Token = tuple[int, int, int]  # id, start, end


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _breaks(tokens: list[Token], lo: int, hi: int) -> dict[int, int]:
    """Ends of tokens in [lo, hi] that no token reaches across, each with the number of the token that ends there."""
    out = {}
    for i in range(len(tokens) - 2, -1, -1):
        end = tokens[i][2]
        if end < lo:
            break
        if end <= hi and end <= tokens[i + 1][1]:
            out[end] = i
    return out


def splice(left: list[Token], right: list[Token], lo: int, hi: int) -> tuple[int, int] | None:
    """Numbers of the first tokens after a stable place in [lo, hi], in the left and in the right encoding; nearest the middle."""
    a = _breaks(left, lo, hi)
    if not a:
        return None
    b = {}
    for i, (_, _, end) in enumerate(right[:-1]):
        if end > hi:
            break
        if end in a and end <= right[i + 1][1]:
            b[end] = i
    for c in sorted(b, key=lambda c: abs(2 * c - lo - hi)):
        i, j = a[c], b[c]
        if i >= 1 and j >= 1 and len(left) > i + 2 and len(right) > j + 2 and left[i - 1 : i + 3] == right[j - 1 : j + 3]:
            return i + 1, j + 1
    return None


def count_long(tok, text: str, chunk: int, overlap: int) -> int:
    """Tokens of one text by spliced chunks; the same as of the text encoded whole."""

    def encode(lo: int, hi: int) -> list[Token]:
        e = tok.encode(text[lo:hi], add_special_tokens=False)
        return [(i, s + lo, t + lo) for i, (s, t) in zip(e.ids, e.offsets)]

    total, first, start, hi = 0, 0, 0, min(chunk, len(text))  # of the current chunk: first token not yet counted, and its place
    now = encode(0, hi)
    while hi < len(text):
        wide = overlap
        while True:
            lo = max(start, hi - wide)
            end = min(len(text), lo + max(chunk, 2 * wide))
            then = encode(lo, end)
            at = splice(now, then, lo, hi)
            if at is not None:
                total += at[0] - first
                now, first, hi = then, at[1], end
                start = now[first][1]
                break
            if lo == start and end == len(text):  # nothing to splice at: all of the text
                return len(tok.encode(text, add_special_tokens=False))
            wide *= 2
    return total + len(now) - first


def token_counts(docs: DataFrame, tokenizer_path: str, chunk: int = 1 << 16, overlap: int = 1 << 9, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row. Null texts count as empty; repeated rows are each counted;
    an empty table gives no rows; other columns are not read."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(tokenizer_path)
        for pdf in slices(parts):
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            short = [len(e) for some in by_size([t for t in texts if len(t) <= chunk], 1 << 18) for e in tok.encode_batch_fast(some, add_special_tokens=False)]
            counts = iter(short)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": [next(counts) if len(t) <= chunk else count_long(tok, t, chunk, overlap) for t in texts]})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    got = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
    return got.withColumn("over_limit", F.col("n_tokens") > limit)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
