"""Every query with SQL agrees with DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entrypoint
from check import TABLES, rows_of


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entrypoint.oracle_sql()))
def test_query_equals_sql(spark, small, duck, name):
    df = entrypoint.queries()[name](spark, small)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(entrypoint.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert entrypoint.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(entrypoint.oracle_sql()) <= set(entrypoint.queries())


def test_no_row_functions_in_plain_plans(spark, small):
    """Parsing, text and evaluation plans stay in the JVM."""
    for name in ("clean_tokens", "extract_sentences", "parse_number", "score_metrics", "woe_iv_all_features"):
        plan = entrypoint.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan, name
