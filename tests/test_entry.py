"""Every registered query against its SQL, on the same Parquet files."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from conftest import TESTDATA

QUERIES = {name: entry_point.queries()[name] for name in entry_point.PLANS}
EXPECTED = entry_point.expected()


@pytest.fixture(scope="module")
def duck():
    connections = {}

    def connect(size):
        if size not in connections:
            con = connections[size] = duckdb.connect()
            for path in (TESTDATA / size).glob("*.parquet"):
                con.execute(f"create view {path.stem} as select * from '{path}'")
        return connections[size]

    return connect


def test_every_query_has_an_expected_result():
    assert set(QUERIES) == set(EXPECTED)


@pytest.mark.parametrize("name", EXPECTED)
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, str(TESTDATA / "sf0.001")).toArrow()
    want = duck("sf0.001").sql(EXPECTED[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert {c: str(got.schema.field(c).type) for c in columns} == {c: str(want.schema.field(c).type) for c in columns}

    def rows(table):
        return sorted(map(repr, zip(*[table.column(c).to_pylist() for c in columns])))

    assert rows(got) == rows(want)
    assert got.num_rows > 0


def test_entry(spark):
    df = entry_point.entry(spark)
    assert len(df.columns) == 24 and df.count() == 7_531
