"""Each query with SQL gives DuckDB's rows."""

import duckdb
import numpy as np
import pytest

from folioflow import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (list, np.ndarray)):
        return "[" + ",".join(map(plain, x)) + "]"
    if x is None or x != x:
        return "null"
    return f"{float(x):.5f}" if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, duck, name):
    got = catalog.queries()[name](spark, data).toPandas()
    sql = catalog.oracle_sql().get(name)
    assert sql is None or rows(got) == rows(duck.execute(sql).fetchdf())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
