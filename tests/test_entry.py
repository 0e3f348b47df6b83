import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).columns == ["baseline_id", "n", "missing", "variants", "status"]


@pytest.mark.parametrize("name", ["lookup_minimal", "d1_whole_line_decision", "j25_compare_fills", "w5_blocks"])
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "orders"):
        connection.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    found = entry.queries()[name](spark, SMALL)
    wanted = connection.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(map(tuple, found.select(*columns).collect()), key=key) == sorted(wanted.fetchall(), key=key)
