"""Every registered query against its DuckDB counterpart on the smallest tables."""
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for file in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_matches_sql(spark, con, name):
    text, _, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert text.startswith(("ok", "rows")), text


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
