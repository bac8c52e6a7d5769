"""Every query of the catalogue against its SQL on the smallest tables, and the entry module by itself."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys

import pytest

from loomframe.plans import catalog

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def same(x):
    if isinstance(x, (list, tuple)):
        return tuple(same(v) for v in x)
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return round(float(x), 4) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    out = catalog.QUERIES[name](spark, DATA)
    columns = sorted(out.columns)
    got = sorted(repr(same(tuple(r[c] for c in columns))) for r in out.collect())
    assert got
    if name in catalog.SQL:
        answer = duck.execute(catalog.SQL[name])
        names = [d[0] for d in answer.description]
        assert sorted(names) == columns
        want = sorted(repr(same(tuple(dict(zip(names, r, strict=True))[c] for c in columns))) for r in answer.fetchall())
        assert got == want


@needs_data
def test_flagship_filters_in_the_scan(spark):
    plan = catalog.flagship(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "l_shipdate" not in plan


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    shutil.copytree(f"{ROOT}/loomframe", tmp_path / "loomframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(k.startswith('op') for k in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_linear_algebra_reads_whole_embeddings(spark):
    import numpy as np

    d = "/root/testdata/sf0.001"
    by = {}
    for x in spark.read.parquet(f"{d}/embeddings.parquet").collect():
        by.setdefault(x.label, []).append(np.array(x.embedding, np.float64))
    grams = {k: np.array(v).T @ np.array(v) + np.eye(64) for k, v in by.items()}
    run = lambda name: {x[0]: x[1] for x in catalog.QUERIES[name](spark, d).collect()}
    det, inv, solved, svd = map(run, ("q114_det", "q115_inv", "q116_solve", "q117_svd"))
    for k, g in grams.items():
        assert np.isclose(det[k], np.linalg.det(g), rtol=1e-6, atol=1e-4)
        assert np.allclose(np.reshape(inv[k], (64, 64)) @ g, np.eye(64), atol=1e-6)
        assert np.allclose(g @ solved[k], g[0], atol=1e-6) and np.allclose(svd[k], np.linalg.svd(g)[1])


def test_rounding_keeps_the_sign_of_zero(spark, tmp_path):
    """Numbers that round to nothing, as SQL has them: -0.0 for negative ones."""
    import duckdb

    tiny = [(-1) ** i * 2.0 ** -(18 + i % 7) for i in range(64)]
    rows = [(0, tiny, 0), (1, [-x for x in tiny], 1), (2, [0.0, -0.0] * 32, 1), (3, [(i - 31) / 64 for i in range(64)], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    signed = 0
    for name in "q83_array_add q83b_array_sub q87_abs_neg q89_sum q89b_mean q91_dot q92b_axis_sum q92c_at q92d_put q93_slice q93b_slice_back q94_flatten q95_reshape q96_transpose q96b_slice".split():
        out = catalog.QUERIES[name](spark, str(tmp_path))
        got = sorted(repr(tuple(r)) for r in out.collect())
        assert got == sorted(repr(r) for r in con.execute(f"select {', '.join(out.columns)} from ({catalog.SQL[name]})").fetchall()), name
        signed += any("-0.0," in r for r in got)
    assert signed >= 7
