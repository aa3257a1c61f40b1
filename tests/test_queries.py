"""Every registered query with SQL gives DuckDB's rows, columns and types."""

import glob
import os

import duckdb
import pytest

from lodeline import queries

TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def views(data):
    c = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def cell(x):
    if x is None or x != x:
        return "NULL"
    return repr(round(x, 6)) if isinstance(x, float) else str(x)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(cell(v[k]) for k in order) for v in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, data, views, name):
    ours = queries.QUERIES[name](spark, data)
    theirs = views.sql(queries.ORACLE_SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    kinds = dict(zip(theirs.columns, map(str, theirs.types)))
    assert {c: TYPES[t] for c, t in ours.dtypes} == kinds
    assert rows(ours.columns, ours.collect()) == rows(theirs.columns, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_has_rows(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["period", "value", "expected_low", "expected_high", "is_anomaly"]
    assert out.count() == 83 and out.where("is_anomaly").count() == 1
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_year_reaches_the_scan(spark, data):
    from lodeline.plans import compiler
    from lodeline.plans.model import QueryPlan

    df = spark.read.parquet(f"{data}/orders.parquet")
    kept, _ = compiler.scoped(QueryPlan("count", year=1997, month=3), df, queries.ORDERS)
    # Shown metadata is cut at 100 characters unless the session says otherwise.
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = kept.select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(o_orderdate,1997-03-01" in plan and "LessThan(o_orderdate,1997-04-01" in plan
    assert "o_totalprice" not in plan.split("ReadSchema")[1]
