import duckdb
import pytest

import __spark_entry__
from palimpsest.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in "documents pages benchmark labels events conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def values(rows):
    def plain(x):
        return round(float(x), 9) if isinstance(x, float) or hasattr(x, "is_integer") else x

    return sorted(repr(tuple(None if x is None else plain(x) for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = oracle.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalog.SQL[name]})").fetchall()
    assert values([tuple(r) for r in df.select(*columns).collect()]) == values(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
