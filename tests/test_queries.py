"""Every query of the library against its SQL, and the entry points without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from readloom.operators import em
from readloom.plans import model_queries
from readloom.plans.all_queries import ORACLE_SQL, QUERIES
from readloom.plans.join_queries import _compat

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def cells(df):
    df = df[sorted(df.columns)]
    text = lambda v: "null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, row)) for row in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_aligned_rows_are_not_kept_twice(spark):
    got = QUERIES["f16_propagate_gaps"](spark, SF)
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()  # aligned where they are laid out
    n = len(model_queries._reference(spark, SF)[0])
    assert all(len(r["row"]) == n for r in got.limit(20).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_insertions_open_columns_in_all_rows(spark):
    got = QUERIES["f16_propagate_gaps"](spark, SF).toPandas().set_index("read_id")
    pairs = model_queries._aligned(spark, SF).toPandas().set_index("read_id")
    own, longest = {}, {}
    for i, (ref, read) in pairs[["ref_row", "read_row"]].iterrows():
        on = [k for k, (r, q) in enumerate(zip(ref, read)) if r != "-" and q != "-"] or [0]
        own[i], at = {}, 0
        for k, (r, q) in enumerate(zip(ref, read)):
            at += r != "-"
            if r == "-" and on[0] <= k <= on[-1]:
                own[i][at] = own[i].get(at, "") + q
        for at, text in own[i].items():
            longest[at] = max(longest.get(at, 0), len(text))
    assert longest and set(got.index) == set(pairs.index)
    for i, r in got.iterrows():
        assert r["padded"] == "".join(c + own[i].get(k, "").ljust(longest.get(k, 0), "-") for k, c in enumerate(r["row"], 1))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_frequencies_go_to_convergence(spark):
    compat = _compat(spark, SF).cache()
    got = QUERIES["u17_em_converged"](spark, SF).cache()
    more = em.step(compat, got)
    gain = em.log_likelihood(compat, more) - em.log_likelihood(compat, got)
    assert abs(gain) <= 1.1e-6 and got.count() == compat.select("hap_id").distinct().count()


def test_entry_without_the_subpackage(tmp_path):
    for item in ("readloom", "__spark_entry__.py", "corpus_pipeline.py"):
        src = os.path.join(ROOT, item)
        if os.path.exists(src):
            (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / item)
    shutil.rmtree(tmp_path / "readloom" / "llm", ignore_errors=True)
    for gone in (False, True):
        if gone and (tmp_path / "corpus_pipeline.py").exists():
            (tmp_path / "corpus_pipeline.py").unlink()
        code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); print(sum(k.startswith('op') or k == 'pipeline' for k in q))"
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
        assert out.stdout.strip() == "0", out.stderr
