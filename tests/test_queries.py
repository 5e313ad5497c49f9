"""Every query with SQL gives DuckDB's rows on the same tables."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from inkspan.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v if isinstance(v, int) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf)
    cursor = duck.execute(plans.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, cursor.fetchall())


def test_entry_and_names(spark):
    found = entry.entry(spark)
    assert found.columns and found.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_python_in_relational_plans(spark, sf):
    for name in ("agg_usage_day", "join_apply_list", "top_issues", "agg_match_score", "win_offsets"):
        plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
