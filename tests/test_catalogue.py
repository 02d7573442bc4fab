"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__
from tidewrack import catalogue, catalogue_code  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=repr)
    if name not in catalogue.ORACLES:
        assert got
        return
    r = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted((tuple(x[i] for i in order) for x in r.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
