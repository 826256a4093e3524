"""Audits of frames and tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.sources.lake import Lake


def summary_statistics(events: DataFrame) -> DataFrame:
    """A28, in one pass.  A missing region counts as a region of its own."""
    no_region = F.max(F.col("region").isNull().cast("int"))
    return events.agg(
        F.count("*").alias("total_rows"),
        F.min("datetime").alias("min_datetime"),
        F.max("datetime").alias("max_datetime"),
        *[
            measure(name).alias(f"{label}_{name}")
            for name in ("magnitude", "depth")
            for label, measure in (("min", F.min), ("max", F.max), ("mean", F.avg))
        ],
        (F.count_distinct("region") + F.coalesce(no_region, F.lit(0))).alias("unique_regions"),
    )


def column_profile(rows: DataFrame) -> DataFrame:
    """One line per column with its type, the number of rows and of nulls."""
    types = F.create_map(*[F.lit(part) for pair in rows.dtypes for part in pair])
    return (
        rows.agg(
            F.count("*").alias("_rows"),
            *[F.count_if(F.col(name).isNull()).alias(name) for name in rows.columns],
        )
        .unpivot("_rows", rows.columns, "column_name", "null_count")
        .select(
            "column_name",
            F.element_at(types, F.col("column_name")).alias("data_type"),
            F.col("_rows").alias("row_count"),
            "null_count",
        )
    )


def duplicate_audit(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows beyond one per key."""
    return rows.agg(
        F.count("*").alias("row_count"),
        F.count_distinct(key).alias("distinct_events"),
        (F.count("*") - F.count_distinct(key)).alias("duplicates"),
    )


def table_columns(lake: Lake, table: str) -> DataFrame:
    """Name, type and nullability of a table's columns, in order."""
    columns = [
        F.struct(
            F.lit(place).alias("position"),
            F.lit(column.name).alias("column_name"),
            F.lit(column.dataType.simpleString()).alias("data_type"),
            F.lit(column.nullable).alias("nullable"),
        )
        for place, column in enumerate(lake.read(table).schema, 1)
    ]
    return lake.spark.range(1).select(F.inline(F.array(*columns)))


def table_audit(lake: Lake, tables: Sequence[str] | None = None) -> DataFrame:
    """Whether each table is there, its rows and its columns."""

    def audit(table: str) -> DataFrame:
        if not lake.exists(table):
            return lake.spark.range(1).select(
                F.lit(table).alias("table_name"),
                F.lit(False).alias("is_there"),
                F.lit(0).cast("bigint").alias("row_count"),
                F.lit(0).alias("column_count"),
                F.lit("").alias("columns"),
            )
        rows = lake.read(table)
        return rows.agg(F.count("*").alias("row_count")).select(
            F.lit(table).alias("table_name"),
            F.lit(True).alias("is_there"),
            "row_count",
            F.lit(len(rows.columns)).alias("column_count"),
            F.lit(", ".join(rows.columns)).alias("columns"),
        )

    names = lake.names.star + lake.names.cubes if tables is None else tables
    return reduce(DataFrame.unionByName, [audit(table) for table in names])
