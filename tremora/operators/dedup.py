"""Keeping one row per event.

A row number within the key, cut at one, is planned by Spark as a group limit on
both sides of the shuffle: each map task already drops all but its best row per
key, so a key that holds a third of the input sends one row per task.  Null keys
form one group.  The order always ends in the row's content, so the row that is
kept does not depend on how the input was partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.sources.catalog_csv import POSITION, RAW_COLUMNS


def keep_one(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    best = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def _content(rows: DataFrame) -> Column:
    """A hash of a row's source columns, to order rows that tie on everything else."""
    known = {name for names in RAW_COLUMNS for name in names[:2]}
    return F.xxhash64(*[name for name in rows.columns if name in known])


def keep_first(rows: DataFrame, key: str = "id") -> DataFrame:
    """The first row per id, by position where the reader recorded it, else the earliest."""
    if set(POSITION) <= set(rows.columns):
        return keep_one(rows, key, [F.asc(name) for name in POSITION]).drop(*POSITION)
    order = [F.asc_nulls_last("time"), F.asc_nulls_last("updated"), _content(rows)]
    return keep_one(rows, key, order)


def latest_first(events: DataFrame) -> list[Column]:
    """D3: the order of an event's rows: latest origin time, latest update, then content."""
    return [F.desc_nulls_last("datetime"), F.desc_nulls_last("updated"), _content(events)]


def merge_latest(events: DataFrame, key: str = "event_id") -> DataFrame:
    """D3: the row with the latest origin time per event, then the latest update."""
    return keep_one(events, key, latest_first(events))
