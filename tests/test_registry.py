"""Driver contract: entry() runs; every registered query matches its DuckDB
SQL on the smallest data set (the driver compares at sf0.01)."""

import pytest

import __spark_entry__ as E
from oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["id_producto", "producto", "cantidad", "total"]
    assert 0 < len(rows) <= 5


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert r["ok"], r


def test_every_query_has_an_oracle():
    from vitrina.plans import registry
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())
