"""Every carrier query against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from quillon.plans import carriers
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    return str(v)


@pytest.mark.parametrize("name", sorted(carriers.oracle_sql()))
def test_carrier(spark, duck, name):
    df = carriers.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(carriers.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(carriers.queries()) - set(carriers.oracle_sql())))
def test_runs(spark, name):
    assert carriers.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_plans_push_down(spark):
    plan = carriers.queries()["explorer_page"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(o_orderstatus,F)" in plan and "o_orderdate" not in plan.split("ReadSchema")[1].split("\n")[0]
    plan = carriers.queries()["range_join_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    plan = carriers.queries()["subscription_slots"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan
