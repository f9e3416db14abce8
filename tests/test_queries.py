"""Every registered query against its SQL in DuckDB; those without SQL must run."""

import pytest

from loomwright import queries as core

from .compare import connection, differences

Q, SQL = core.queries(), core.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


def test_oracles_name_queries():
    assert set(SQL) <= set(Q) and len(Q) > 400


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, sf_dir, con, name):
    df = Q[name](spark, sf_dir)
    if name in SQL:
        assert differences(df, con, SQL[name]) == ""
    else:
        assert df.columns and df.toArrow().num_rows >= 0


def test_entry_point_without_the_llm_parts(monkeypatch):
    import builtins
    import sys

    real = builtins.__import__

    def missing(name, globals=None, locals=None, fromlist=(), level=0):
        if name == "corpus_pipeline" or name.startswith("loomwright.llm"):
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    for m in [m for m in sys.modules if m.startswith("loomwright.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", missing)
    import __spark_entry__ as e

    assert set(e.queries()) == set(Q) and set(e.oracle_sql()) == set(SQL)


def test_flagship_schema(spark, sf_dir):
    df = core.flagship(spark, sf_dir)
    assert df.columns == ["bucket", "n", "avg_logit", "avg_price"] and df.count() == 6


def test_entry_point_needs_no_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_true_divide_of_awkward_keys(spark, tmp_path):
    """Keys that are null, zero or negative give what the SQL gives."""
    import duckdb

    rows = [(a, b) for a in (None, -(2**63), -5, 0, 7, 2**63 - 1) for b in (None, -3, -2, 0, 1, 2)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert differences(Q["df_true_divide"](spark, str(tmp_path)), con, SQL["df_true_divide"]) == ""
