"""From raw rows to clean, validated and enriched events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.config import UNKNOWN, Limits
from tremora.functions import bands, lunar, moments
from tremora.operators.dedup import merge_latest
from tremora.sources.catalog_csv import RENAMES

CRITICAL_FIELDS = ("time", "latitude", "longitude", "magnitude")


def conform_names(rows: DataFrame) -> DataFrame:
    """Known source names become ours, others stay."""
    return rows.withColumnsRenamed(RENAMES)


def drop_incomplete(rows: DataFrame) -> DataFrame:
    """P2.  (Not ``dropna``, which takes NaN for null and is not pushed to the scan.)"""
    for name in CRITICAL_FIELDS:
        if name in rows.columns:
            rows = rows.where(F.col(name).isNotNull())
    return rows


def fill_optional(rows: DataFrame) -> DataFrame:
    """P3."""
    defaults = {"depth": 0.0, "place": UNKNOWN}
    return rows.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value))
            for name, value in defaults.items()
            if name in rows.columns
        }
    )


def _rules(rows: DataFrame, limits: Limits) -> dict[str, Column]:
    """What each rule asks of a conformed row, in the order the rules apply.

    Depth is judged as it will be after filling, so a missing one passes as 0.
    """
    has = set(rows.columns)
    rules = {
        f"{name}_present": F.col(name).isNotNull() for name in CRITICAL_FIELDS if name in has
    }
    if "magnitude" in has:
        rules["magnitude_in_range"] = F.col("magnitude").between(
            limits.min_magnitude, limits.max_magnitude
        )
    if "depth" in has:
        rules["depth_in_range"] = F.coalesce("depth", F.lit(0.0)).between(
            limits.min_depth, limits.max_depth
        )
    if {"latitude", "longitude"} <= has:
        rules["coordinates_on_globe"] = F.col("latitude").between(
            -limits.max_latitude, limits.max_latitude
        ) & F.col("longitude").between(-limits.max_longitude, limits.max_longitude)
    return rules


def validate(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All limits are inclusive."""
    for name, rule in _rules(rows, limits).items():
        if not name.endswith("_present"):
            rows = rows.where(rule)
    return rows


def failed_rule(rows: DataFrame, limits: Limits = Limits()) -> Column:
    """The first rule a conformed row breaks, null for a good row."""
    return F.coalesce(
        *[
            F.when(~F.coalesce(rule, F.lit(False)), F.lit(name))
            for name, rule in _rules(rows, limits).items()
        ]
    )


def rejects(raw: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows that cleaning drops, each with the rule it broke."""
    rows = conform_names(raw)
    return rows.withColumn("failed_rule", failed_rule(rows, limits)).where(
        F.col("failed_rule").isNotNull()
    )


def removed_rows(raw: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row with rows in, rows out and rows lost to each rule, from a single pass."""
    rows = conform_names(raw)
    rule = F.col("failed_rule")
    return rows.select(failed_rule(rows, limits).alias("failed_rule")).agg(
        F.count("*").alias("rows_in"),
        F.count_if(rule.isNull()).alias("rows_out"),
        F.count_if(rule.isNotNull()).alias("rows_removed"),
        *[F.count_if(rule == name).alias(f"lost_{name}") for name in _rules(rows, limits)],
    )


def clean(raw: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """P1-P6."""
    return (
        raw.transform(conform_names)
        .transform(drop_incomplete)
        .transform(fill_optional)
        .transform(validate, limits)
    )


def add_datetime(rows: DataFrame, strict: bool = True) -> DataFrame:
    """E1.

    With ``strict`` off, a row whose time cannot be read is left out instead of
    failing the job; ``unreadable_times`` lists such rows.
    """
    rows = rows.withColumn("datetime", moments.parse_time(F.col("time"), strict))
    return rows if strict else rows.where(F.col("datetime").isNotNull())


def add_calendar(rows: DataFrame) -> DataFrame:
    """E2, E3."""
    moment = F.col("datetime")
    return rows.withColumns(
        {
            "year": F.year(moment),
            "month": F.month(moment),
            "day": F.dayofmonth(moment),
            "hour": F.hour(moment),
            "day_of_week": moments.iso_weekday(moment),
        }
    )


def add_classes(rows: DataFrame) -> DataFrame:
    """E4-E6, each only where its source column is present."""
    derived = {
        "magnitude": ("magnitude_category", bands.magnitude_category),
        "depth": ("depth_category", bands.depth_category),
        "place": ("region", bands.region_of),
    }
    return rows.withColumns(
        {
            name: make(F.col(source))
            for source, (name, make) in derived.items()
            if source in rows.columns
        }
    )


def add_moon_phase(rows: DataFrame) -> DataFrame:
    """E7, E8."""
    return lunar.with_moon_phase(rows).withColumn(
        "moon_phase_name", bands.phase_name(F.col("moon_phase"))
    )


def derive(rows: DataFrame) -> DataFrame:
    """All that follows from the source columns and the parsed time."""
    return rows.transform(add_calendar).transform(add_classes).transform(add_moon_phase)


def to_timed(raw: DataFrame, limits: Limits = Limits(), strict: bool = True) -> DataFrame:
    """L1 as far as the parsed time; ``derive`` gives the rest, once the rows to keep are known."""
    return clean(raw, limits).transform(add_datetime, strict)


def to_events(raw: DataFrame, limits: Limits = Limits(), strict: bool = True) -> DataFrame:
    """L1: the whole way from raw rows to events, as one lazy plan."""
    return to_timed(raw, limits, strict).transform(derive)


def to_merged_events(
    raw: DataFrame, limits: Limits = Limits(), strict: bool = True
) -> DataFrame:
    """L1 and D3: what ``merge_latest`` gives of ``to_events``.

    Only source columns are shuffled; the others are derived from the rows that
    are kept.
    """
    return merge_latest(to_timed(raw, limits, strict)).transform(derive)


def unreadable_times(raw: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The clean rows that ``strict=False`` leaves out."""
    return clean(raw, limits).where(moments.parse_time(F.col("time"), strict=False).isNull())


def refused(raw: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All rows that a load with ``strict=False`` leaves out, each with the rule it broke."""
    rows = conform_names(raw)
    unreadable = moments.parse_time(F.col("time"), strict=False).isNull()
    rule = F.coalesce(failed_rule(rows, limits), F.when(unreadable, F.lit("time_readable")))
    return rows.withColumn("failed_rule", rule).where(F.col("failed_rule").isNotNull())
