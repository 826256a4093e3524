"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest
from conftest import SMALL

sys.path.insert(0, str(Path(__file__).parent.parent))
import __spark_entry__ as driver  # noqa: E402
from tremora.checks import queries as checks  # noqa: E402


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in Path(SMALL).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def test_every_query_has_its_sql():
    assert set(checks.registered) <= set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() == 100


@pytest.mark.parametrize("name", list(checks.registered))
def test_query(name, spark, database):
    frame = driver.queries()[name](spark, SMALL)
    names = sorted(frame.columns)
    result = database.execute(driver.oracle_sql()[name])
    found_names = [column[0] for column in result.description]
    assert sorted(found_names) == names
    places = [found_names.index(column) for column in names]
    want = sorted((tuple(row[i] for i in places) for row in result.fetchall()), key=repr)
    got = sorted((tuple(row) for row in frame.select(*names).collect()), key=repr)
    assert got == want
