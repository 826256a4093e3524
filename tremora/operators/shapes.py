"""Small steps that several reports share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fixed_list(spark: SparkSession, name: str, values: Sequence[str]) -> DataFrame:
    """A column of fixed names with their 1-based place, as ``_place``."""
    listed = F.array(*[F.lit(value) for value in values])
    place = (F.col("id") + 1).cast("int")
    return spark.range(0, len(values), 1, 1).select(
        F.element_at(listed, place).alias(name), place.alias("_place")
    )


def densify(
    totals: DataFrame, name: str, values: Sequence[str], defaults: Mapping[str, float]
) -> DataFrame:
    """One row per fixed name in the fixed order, with defaults where there were no events."""
    return (
        fixed_list(totals.sparkSession, name, values)
        .join(totals, name, "left")
        .fillna(dict(defaults))
        .orderBy("_place")
        .drop("_place")
    )


def largest(rows: DataFrame, n: int, by: str, *then: str | Column) -> DataFrame:
    """The n rows with the largest value; ties go by the further columns."""
    return rows.orderBy(F.desc_nulls_last(by), *then).limit(n)


def with_share(totals: DataFrame, count: str, share: str) -> DataFrame:
    """Percent of the sum over all rows, 0 when that sum is 0.

    The window has no partition: this is for totals of a handful of classes.
    """
    everything = F.sum(count).over(Window.partitionBy())
    percent = F.when(everything > 0, F.col(count) * 100.0 / everything).otherwise(0.0)
    return totals.withColumn(share, percent)


def relabel(rows: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """The listed columns under the names to show."""
    return rows.select([F.col(name).alias(label) for name, label in labels.items()])
