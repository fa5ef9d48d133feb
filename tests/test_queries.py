"""Each tensor query against its SQL, on the smallest tables; and the entry module without the llm folder."""

import os
import shutil
import subprocess
import sys

import pytest

from weft import queries

FOLDER = "/root/testdata/sf0.001"
QUICK = ["einsum_gemm", "einsum_hadamard_out", "einsum_beta", "einsum_dot_complex", "block_gemm", "tiled_filled", "unfold_2_column_order", "view_assign", "divide", "khatri_rao", "norm_one", "fft_real", "syev_trace", "gesv_error"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "lineitem", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    expected = c.sql(queries.oracle_sql()[name]).df()
    found = queries.queries()[name](spark, FOLDER).toPandas()
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    assert order(found).equals(order(expected))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_batches_shuffle_no_products(spark):
    assert "Join" not in queries.queries()["einsum_batch"](spark, FOLDER)._jdf.queryExecution().toString()
    test_against_sql(spark, "einsum_batch")


def test_every_query_without_sql_is_meant():
    assert set(queries.queries()) - set(queries.oracle_sql()) == {"parafac_fit", "tucker_fit"}


def test_entry_without_llm(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/weft", tmp_path / "weft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and not any(x.startswith('op1') for x in e.queries()); import weft.api; print('fine')"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("fine"), out.stderr
