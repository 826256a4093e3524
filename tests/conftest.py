from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from tremora.config import local_session
from tremora.sources.lake import Lake

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = local_session(4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lake(spark, tmp_path) -> Lake:
    return Lake(spark, str(tmp_path / "lake"))


@pytest.fixture(scope="session")
def workspace(spark):
    from tremora.checks.workspace import Workspace

    return Workspace.of(spark, SMALL)


def rows_of(frame) -> list[tuple]:
    """All rows in an order of their own, for comparing frames."""
    frame = frame.select(*sorted(frame.columns))
    return sorted((tuple(row) for row in frame.collect()), key=repr)
