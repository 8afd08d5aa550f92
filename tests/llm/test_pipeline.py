"""The pipeline against a plain version of its stages, and its contract."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from readloom.llm import decontam, linededup, mixing
from readloom.llm.common import table
from tests.llm.helpers import SF, messy
from tests.llm.test_pairs import Sets
from tests.llm.test_texts import plain_quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def plain_lines(docs):
    """Line dedup by comparing all different lines: equal ones of any length, near ones of 40 characters or more."""
    occ = {}
    for i in sorted(docs):
        for n, raw in enumerate(docs[i].split("\n")):
            line = raw.strip(" \t\r")
            if line:
                occ.setdefault(line, []).append((i, n))
    s, lines = Sets(), sorted(occ, key=len)
    number = {x: k for k, x in enumerate(lines)}
    for a, x in enumerate(lines):
        s.find(a)
        for y in lines[a + 1 :] if len(x) >= 40 else ():
            if len(y) > len(x) + 2:
                break
            if linededup.within(x, y, 2):
                s.join(a, number[y])
    first = {}
    for x, at in occ.items():
        root = s.find(number[x])
        first[root] = min([first.get(root, at[0]), *at])
    out = {}
    for i, text in docs.items():
        parts = text.split("\n")
        lost = lambda n, line: bool(line) and any(c.isalnum() for c in line) and first[s.find(number[line])] != (i, n)  # noqa: B023,E731
        left = "\n".join(p for n, p in enumerate(parts) if not lost(n, p.strip(" \t\r")))
        if left == text or any(c.isalnum() for c in left):
            out[i] = left
    return out


def plain_near(docs):
    """Five-word shingles, Jaccard similarity of 0.8 or more, by comparing all sets."""
    grams = {}
    for i, t in docs.items():
        w = t.encode().lower().split()
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    s, ids = Sets(), sorted(docs)
    for k, i in enumerate(ids):
        s.find(i)
        for j in ids[:k]:
            a, b = grams[i], grams[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                s.join(i, j)
    return {i: docs[i] for i in ids if s.find(i) == i}


def plain_clean(docs, items):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t) if w]
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    win = set()
    for t in items:
        w = words(low(t))
        n = min(10, len(w))
        win |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    sizes = {len(x) for x in win}
    out = {}
    for i, t in docs.items():
        w = words(low(t))
        if not any(tuple(w[k : k + n]) in win for n in sizes for k in range(len(w) - n + 1)):
            out[i] = t
    return out


def test_run_against_plain_stages(spark):
    docs = table(spark, SF, "documents")
    kept = plain_quality({r["doc_id"]: r["text"] for r in docs.collect()})
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    want = plain_clean(plain_near(plain_lines(kept)), items)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "copy_no"]
    base = {r["doc_id"]: r for r in docs.collect()}
    rows = [(i, want[i], base[i]["lang"], base[i]["source"], len(want[i])) for i in want]
    con = duckdb.connect()
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    con.register("documents", frame)
    expected = sorted(con.execute(f"select doc_id, text, source, n_chars, copy_no from ({mixing.OP8_SQL})").fetchall())
    assert sorted(tuple(r) for r in got.select("doc_id", "text", "source", "n_chars", "copy_no").collect()) == expected
    assert len(expected) > 50


def test_stages_take_awkward_rows(spark):
    d = messy(spark).withColumn("n_chars", F.col("n_chars").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, SF)
        assert out.columns == ([*(c for c in d.columns if c != "copy_no"), "copy_no"] if name == "source_mixing" else d.columns), name
        assert stage(spark, d.limit(0), SF).count() == 0, name
        out.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    assert decontam.OP10_SQL and corpus_pipeline.ORACLE_SQL is None
