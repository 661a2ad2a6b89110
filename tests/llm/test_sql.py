"""The training-data queries that SQL can express, against it, on the smallest tables."""

import duckdb
import pytest

from conftest import TESTDATA
from ledgerline.llm.expected import EXPECTED
from ledgerline.llm.queries import QUERIES


@pytest.mark.parametrize("name", EXPECTED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{TESTDATA}/sf0.001/{table}.parquet'")
    got, want = QUERIES[name](spark, str(TESTDATA / "sf0.001")).toArrow(), con.sql(EXPECTED[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names) and got.num_rows > 0

    def rows(table):
        return sorted(map(repr, zip(*[table.column(c).to_pylist() for c in columns], strict=True)))

    assert rows(got) == rows(want)
