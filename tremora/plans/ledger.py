"""The ledger of loaded years.

One row per loaded year.  The table is partitioned by year, so recording a year
replaces that year's row and no other.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.sources.lake import Lake

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("row_count", T.LongType()),
        T.StructField("file_size_bytes", T.LongType()),
        T.StructField("min_datetime", T.TimestampNTZType()),
        T.StructField("max_datetime", T.TimestampNTZType()),
        T.StructField("loaded_at", T.TimestampType()),
        T.StructField("load_year", T.IntegerType()),
    ]
)


def requested_years(
    spark: SparkSession,
    years: Sequence[int] | None = None,
    start: int | None = None,
    end: int | None = None,
) -> DataFrame:
    """L4: the years listed, else start to end inclusive, else the current year."""
    if years:
        listed = F.array(*[F.lit(int(year)) for year in years])
        rows = spark.range(1).select(F.explode(listed).alias("load_year"))
        return rows.distinct()
    if not (start and end):
        start = end = dt.date.today().year
    return spark.range(start, end + 1, 1, 1).select(F.col("id").cast("int").alias("load_year"))


def read_ledger(lake: Lake) -> DataFrame:
    """The ledger, empty before the first load."""
    table = lake.names.ledger
    if not lake.exists(table):
        return lake.spark.createDataFrame([], LEDGER_SCHEMA)
    return lake.read(table, LEDGER_SCHEMA)


def year_contents(lake: Lake) -> dict[str, str]:
    """Checksum of what was loaded, by loaded year, of the years in the ledger."""
    listed = set(map(str, loaded_years(lake)))
    if not lake.exists(lake.names.contents):
        return {}
    return {str(r.load_year): r.content for r in lake.read(lake.names.contents).collect() if str(r.load_year) in listed}


def year_details(loaded: DataFrame) -> DataFrame:
    """The ledger rows of loaded events, which carry their file and its size."""
    per_file = loaded.groupBy("load_year", "source_file").agg(
        F.count("*").alias("rows"),
        F.max("source_bytes").alias("bytes"),
        F.min("datetime").alias("first"),
        F.max("datetime").alias("last"),
    )
    return per_file.groupBy("load_year").agg(
        F.sum("rows").alias("row_count"),
        F.sum("bytes").alias("file_size_bytes"),
        F.min("first").alias("min_datetime"),
        F.max("last").alias("max_datetime"),
        F.current_timestamp().alias("loaded_at"),
    ).select(*LEDGER_SCHEMA.names)


def record_years(lake: Lake, details: DataFrame) -> int:
    """Add or renew the rows of the years given."""
    return lake.replace_partitions(lake.names.ledger, details, "load_year")


def _rewrite(lake: Lake, kept: DataFrame) -> None:
    lake.replace(lake.names.ledger, kept, ["load_year"])


def loaded_years(lake: Lake, condition: Column | None = None) -> list[int]:
    """The years of the ledger as a list, to prune folders with: one number per year."""
    ledger = read_ledger(lake)
    rows = ledger if condition is None else ledger.where(condition)
    return [row.load_year for row in rows.select("load_year").orderBy("load_year").collect()]


def missing_years(requested: DataFrame, ledger: DataFrame) -> DataFrame:
    """Years asked for that are not loaded yet."""
    return requested.join(ledger, "load_year", "left_anti").orderBy("load_year")


def backed_by_data(ledger: DataFrame, actual_years: DataFrame) -> DataFrame:
    """The ledger without years that have no data."""
    return ledger.join(actual_years, "load_year", "left_semi")


def lost_years(ledger: DataFrame, actual_years: DataFrame) -> DataFrame:
    """What the ledger claims and the data does not hold."""
    return ledger.join(actual_years, "load_year", "left_anti").orderBy("load_year")


def validate_ledger(lake: Lake, actual_years: DataFrame) -> list[int]:
    """Drop years without data from the ledger; gives those years."""
    ledger = read_ledger(lake)
    lost = [row.load_year for row in lost_years(ledger, actual_years).collect()]
    if lost:
        _rewrite(lake, backed_by_data(ledger, actual_years))
    return lost


def clear_years(lake: Lake, years: Sequence[int]) -> None:
    """Forget years, so that the next load takes them again."""
    _rewrite(lake, missing_from(read_ledger(lake), years))


def missing_from(ledger: DataFrame, years: Sequence[int]) -> DataFrame:
    """The ledger without the years listed."""
    return ledger.join(requested_years(ledger.sparkSession, years), "load_year", "left_anti")


def reset_ledger(lake: Lake) -> None:
    """Forget all years."""
    lake.replace(
        lake.names.ledger, lake.spark.createDataFrame([], LEDGER_SCHEMA), ["load_year"]
    )


def year_gaps(ledger: DataFrame) -> DataFrame:
    """First and last missing year of each gap.  One row per year goes into the window."""
    following = F.lead("load_year").over(Window.orderBy("load_year"))
    return (
        ledger.select("load_year")
        .distinct()
        .withColumn("_next", following)
        .where(F.col("_next") - F.col("load_year") > 1)
        .select(
            (F.col("load_year") + 1).alias("gap_start"), (F.col("_next") - 1).alias("gap_end")
        )
    )


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """A32."""
    return ledger.agg(
        F.count("*").alias("total_years"),
        F.min("load_year").alias("first_year"),
        F.max("load_year").alias("last_year"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_events"),
        F.max("loaded_at").alias("last_updated"),
    )
