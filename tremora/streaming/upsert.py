"""Keeping a table of the latest row per event up to date, batch by batch (D3).

The table is partitioned by the year of the event.  An index of all ids, in buckets
by their hash, says in which year each event lies: a batch opens the buckets of its
own ids, then the years in which these events lie, and no others.  What it changes,
rows gained and rows lost, is its change log, from which tables of counts are kept
up.  Only years in the change log are written again.

The change log is written aside first, under the number of the batch.  From there on, a
batch that stops is made good by writing the same rows again: all events of the log leave
the table, whatever it holds of them by then, and the rows that came are put in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.operators.conform import derive
from tremora.operators.dedup import latest_first, merge_latest
from tremora.sources.catalog_csv import RAW_COLUMNS
from tremora.sources.lake import Lake, gathered
from tremora.sources.shared import path_exists, remove, written

SOURCE = (*(name for _, name, _ in RAW_COLUMNS), "datetime")
BY = "year"
BUCKET = "bucket"
BUCKETS = 256  # parts of the index; a batch of few ids opens few


@dataclass(frozen=True)
class Touched:
    """The years a batch touched, all events of these years after it, and its change log:
    source columns and ``sign``, 1 for rows that came and -1 for rows that went."""

    years: list[int]
    events: DataFrame
    changes: DataFrame


def bucket_of(event_id: Column) -> Column:
    return F.pmod(F.xxhash64(event_id), F.lit(BUCKETS)).cast("int")


def index_of(table: str) -> str:
    return f"{table}_ids"


def replace_years(lake: Lake, table: str, rows: DataFrame, years: list[int]) -> None:
    """Put rows in place of what the table holds of these years, and leave the others."""
    lake.replace_partitions(table, rows, BY, years)


def _same(ids: DataFrame) -> Column:
    return F.col("event_id").eqNullSafe(ids["__id"])


def _ids(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("event_id").alias("__id")).distinct()


def _values(rows: DataFrame, column: str) -> list[int]:
    """Distinct values of a column that has few: years, or buckets."""
    return [row[0] for row in rows.select(column).distinct().collect()]


def _stage(lake: Lake, table: str, batch: DataFrame, staging: str) -> None:
    """Write the batch's change log: rows gained, and rows that they take the place of."""
    changes = merge_latest(batch.select(*SOURCE)).withColumn("sign", F.lit(1))
    if lake.exists(table):
        new = written(changes, f"{staging}/new")
        ids = _ids(new)
        buckets = _values(new.withColumn(BUCKET, bucket_of(F.col("event_id"))), BUCKET)
        known = lake.read(index_of(table)).where(F.col(BUCKET).isin(*buckets)).join(ids, _same(ids), "left_semi")
        old = lake.read(table).where(F.col(BY).isin(*_values(known, BY))).join(ids, _same(ids), "left_semi")
        both = old.select(*SOURCE).withColumn("sign", F.lit(-1)).unionByName(new)
        # Of a row that is there already and comes again, the old one is taken: nothing has changed.
        best = Window.partitionBy("event_id").orderBy(*latest_first(both), F.asc("sign"))
        changes = both.withColumn("_taken", F.first("sign").over(best)).where("_taken = 1").drop("_taken")
    changes.withColumn(BY, F.year("datetime")).write.parquet(f"{staging}/changes")


def upsert(lake: Lake, table: str, batch: DataFrame, staging: str) -> Touched:
    """Merge a batch of events into the table.

    ``staging`` is a path that belongs to this batch, the same when it is retried.
    """
    spark = lake.spark
    if not path_exists(spark, f"{staging}/changes/_SUCCESS"):
        remove(spark, staging)  # what a batch that stopped half way has left
        _stage(lake, table, batch, staging)
    changes = spark.read.parquet(f"{staging}/changes")
    years = _values(changes, BY)
    if years or not lake.exists(table):
        gained = changes.where("sign = 1")
        rows = derive(gained.select(*SOURCE))
        if lake.exists(table):
            gone = _ids(changes)
            kept = lake.read(table).where(F.col(BY).isin(*years)).join(gone, _same(gone), "left_anti")
            rows = kept.unionByName(rows.select(*kept.columns))
        replace_years(lake, table, rows, years)
        ids = gained.select("event_id", BY).withColumn(BUCKET, bucket_of(F.col("event_id")))
        buckets, index = _values(ids, BUCKET), index_of(table)
        if lake.exists(index):
            gone = _ids(changes)
            ids = ids.unionByName(
                lake.read(index).where(F.col(BUCKET).isin(*buckets)).join(gone, _same(gone), "left_anti")
            )
        lake.replace_partitions(index, gathered(ids, BUCKET), BUCKET, buckets)
    return Touched(years, lake.read(table).where(F.col(BY).isin(*years)), changes)
