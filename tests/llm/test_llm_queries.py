"""The queries that SQL can express against it, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from check import TABLES, compare
from vecshelf.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the given tables")


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_DIR}/{t}.parquet')")
    ok, note = compare(spark, con, SF_DIR, name, ORACLE[name])
    assert ok, note
