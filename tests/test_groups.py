"""Groups with all their members, on tables that have nulls, copies and groups without any."""

import duckdb
import pytest

from folioflow import catalog

TABLES = {
    "documents": (
        "doc_id long, text string, lang string, source string",
        [(7, " One  two", "en", "a"), (3, "one two", "en", "b"), (None, "ONE\ttwo", "en", "a"), (3, "one two", "en", "a"), (4, "one two", None, "a"), (9, "one TWO", None, "a"), (5, None, "en", "a"), (6, None, "en", "a"), (8, "alone", "en", "a")]
        + [(k, "a page that all have", "de", "a") for k in range(5000, 100, -1)],
    ),
    "region": ("r_regionkey int, r_name string", [(0, "east"), (1, None), (2, "empty")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "first", 0), (1, "second", 0), (2, "second", 1), (3, None, 1), (4, "third", None)]),
    "supplier": ("s_suppkey long, s_nationkey int", [(k, k % 6) for k in range(3000, 0, -1)] + [(None, 0), (12, 0), (None, 0), (5, None)]),
    "customer": ("c_custkey long", [(1,), (2,), (3,), (None,)]),
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string", [(9, 1, "F"), (4, 1, "O"), (2, 1, None), (None, 1, "P"), (1, None, "F"), (7, 3, None)] + [(k, 1, "F") for k in range(9000, 4000, -1)]),
}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    for name, (kinds, rows) in TABLES.items():
        spark.createDataFrame(rows, kinds).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize(("name", "members", "count"), [("duplicate_content", "doc_ids", 4 + 2 + 2 + 4900), ("book_index", "sections", 500 * 4 + 3), ("decisions_by_key", "members", 5004 + 1)])
def test_groups_have_all_members(spark, odd, name, members, count):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{odd}/{t}.parquet/*.parquet')")
    wanted = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    got = catalog.queries()[name](spark, odd)
    assert got.columns == columns
    found = [tuple(r) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(wanted.fetchall(), key=repr)
    assert sum(len(r[columns.index(members)]) for r in found) == count
