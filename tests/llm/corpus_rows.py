"""Rows that every corpus operator is tried on."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"

AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "src0", 0),
    (3, " \t\n ", "en", "src0", 4),
    (None, "a text without an id, of some words", "en", "src1", 1),
    (4, "the same words twice " * 3, "en", None, 1),
    (4, "the same words twice " * 3, "en", None, 1),
    (4, "the same id with other words in it", "de", "src1", 1),
    (5, "é" * 300 + " ß token = 'abcdef' AKIA" + "B" * 16 + " " + "0" * 24, "fr", "src1", 1),
    (6, "word " * 20_000, "en", "src2", 1),
    (7, "### *** 123 ... !!!", None, "src2", 1),
    (8, "password:token:abcdefgh Api-Key secret=token=abcdef apikey : \"x.y_z-1\"", "en", "src2", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def awkward(spark):
    # A column that other tables or the operators themselves might use, too.
    rows = spark.createDataFrame(AWKWARD, SCHEMA)
    return rows.withColumn("size", F.lit("extra")).withColumn("fp", F.lit(0.5)).withColumn("row", F.lit(None).cast("int"))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(params=["documents", "awkward", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)
