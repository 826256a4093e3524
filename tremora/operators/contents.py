"""Checksums of what a table holds, whatever the order of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: Sequence[str]) -> Column:
    """A 64-bit hash of a row's values.  Hashes leave nulls out, so each says that it is one."""
    return F.xxhash64(*[part for name in columns for part in (F.col(name).isNull(), F.col(name))])


def content(columns: Sequence[str]) -> Column:
    """An aggregate: the same text for the same rows in any order, repeated ones counted.

    Rows, sum and exclusive or of two kinds of row hashes; parts are combined before
    the shuffle, and nothing is sorted.
    """
    hashed = row_hash(columns)
    other = F.xxhash64(F.lit("second"), hashed, F.hash(*columns))
    return F.concat_ws(
        ":",
        F.count(F.lit(1)).cast("string"),
        F.coalesce(F.sum(hashed.cast("decimal(38,0)")), F.lit(0)).cast("string"),
        F.coalesce(F.bit_xor(other), F.lit(0)).cast("string"),
    )


def contents(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, content): one row per value of the key."""
    return rows.groupBy(key).agg(content(columns).alias("content"))
