"""Figures computed from reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.functions import bands, moments
from tremora.operators.shapes import densify, relabel, with_share

# --- fixed values ---
TOTAL_LABEL = "**TOTAL**"
SELECTION_DEPTH_BANDS = (("shallow", None, 70.0), ("intermediate", 70.0, 300.0), ("deep", 300.0, None))
SELECTION_MAGNITUDE_BANDS = (
    ("minor", None, 4.0),
    ("moderate", 4.0, 5.0),
    ("strong", 5.0, 6.0),
    ("major", 6.0, None),
)
SEASON_LABELS = {
    "season": "Season",
    "total_events": "Total Events",
    "avg_magnitude": "Avg Magnitude",
}
PHASE_LABELS = {
    "moon_phase_name": "Moon Phase",
    "event_count": "Total Events",
    "avg_magnitude": "Avg Magnitude",
    "max_magnitude": "Max Magnitude",
    "avg_depth": "Avg Depth (km)",
}
# --- end of fixed values ---


def daily_statistics(trend: DataFrame) -> DataFrame:
    """A17, from the daily trend."""
    return trend.agg(
        F.avg("daily_event_count").alias("avg_daily_events"),
        F.max("daily_event_count").alias("max_daily_events"),
        F.count("*").alias("total_days"),
    )


def energy_statistics(trend: DataFrame) -> DataFrame:
    """A18, from the daily trend."""
    return trend.agg(
        F.sum("daily_total_energy").alias("total_energy"),
        F.avg("daily_total_energy").alias("avg_daily_energy"),
        F.max("daily_total_energy").alias("max_daily_energy"),
    )


def day_of_week(trend: DataFrame) -> DataFrame:
    """All seven days, Monday first."""
    totals = (
        trend.groupBy("day_of_week")
        .agg(
            F.sum("daily_event_count").alias("event_count"),
            F.avg("daily_avg_magnitude").alias("avg_magnitude"),
        )
        .select(
            moments.day_name(F.col("day_of_week")).alias("day_name"),
            "event_count",
            "avg_magnitude",
        )
    )
    return densify(totals, "day_name", moments.DAY_NAMES, {"event_count": 0, "avg_magnitude": 0.0})


def seasons_shown(seasonal: DataFrame) -> DataFrame:
    """All four seasons, spring first, with the average as shown (two decimals)."""
    totals = seasonal.select(
        "season", "total_events", F.round("avg_magnitude", 2).alias("avg_magnitude")
    )
    return densify(totals, "season", bands.SEASON_ORDER, {"total_events": 0, "avg_magnitude": 0.0})


def seasonal_with_total(seasonal: DataFrame) -> DataFrame:
    """The seasons there are, and a line of totals.

    The total's average is the mean of the averages as shown, rounded again, so
    this is no rollup over the events.
    """
    shown = seasonal.select(
        "season", "total_events", F.round("avg_magnitude", 2).alias("avg_magnitude")
    )
    total = shown.agg(
        F.lit(TOTAL_LABEL).alias("season"),
        F.sum("total_events").alias("total_events"),
        F.round(F.avg("avg_magnitude"), 2).alias("avg_magnitude"),
    )
    return shown.unionByName(total)


def season_table(with_total: DataFrame) -> DataFrame:
    """A23 as shown to readers."""
    return relabel(with_total, SEASON_LABELS)


def phase_table(statistics: DataFrame) -> DataFrame:
    """A20 as shown to readers."""
    return relabel(statistics, PHASE_LABELS)


def magnitude_share(distribution: DataFrame) -> DataFrame:
    """Each category's percentage of all events."""
    order = bands.labels(bands.MAGNITUDE_CATEGORIES)
    return with_share(
        distribution.select("magnitude_category", "total_events"), "total_events", "percentage"
    ).orderBy(bands.rank_in(F.col("magnitude_category"), order).asc_nulls_last())


def phase_statistics(moon: DataFrame) -> DataFrame:
    """In the order of the lunar month, unknown phases last."""
    return (
        moon.groupBy("moon_phase_name")
        .agg(
            F.sum("event_count").alias("event_count"),
            F.avg("avg_magnitude").alias("avg_magnitude"),
            F.max("max_magnitude").alias("max_magnitude"),
            F.avg("avg_depth").alias("avg_depth"),
        )
        .orderBy(bands.rank_in(F.col("moon_phase_name"), bands.PHASE_NAMES).asc_nulls_last())
    )


def groups_present(moon: DataFrame) -> DataFrame:
    """The magnitude groups there are, weakest first."""
    groups = bands.labels(bands.MAGNITUDE_GROUPS)
    return (
        moon.select("magnitude_group")
        .distinct()
        .orderBy(bands.rank_in(F.col("magnitude_group"), groups).asc_nulls_last())
    )


def phase_by_group(moon: DataFrame) -> DataFrame:
    """All eight phases for every magnitude group that occurs."""
    totals = moon.groupBy("moon_phase_name", "magnitude_group").agg(
        F.sum("event_count").alias("event_count"),
        F.avg("avg_magnitude").alias("avg_magnitude"),
    )
    phases = F.explode(F.array(*[F.lit(name) for name in bands.PHASE_NAMES]))
    groups = bands.labels(bands.MAGNITUDE_GROUPS)
    return (
        totals.select("magnitude_group")
        .distinct()
        .withColumn("moon_phase_name", phases)
        .join(totals, ["moon_phase_name", "magnitude_group"], "left")
        .fillna({"event_count": 0, "avg_magnitude": 0.0})
        .orderBy(
            bands.rank_in(F.col("magnitude_group"), groups).asc_nulls_last(),
            bands.rank_in(F.col("moon_phase_name"), bands.PHASE_NAMES).asc_nulls_last(),
        )
    )


def magnitude_group_share(moon: DataFrame) -> DataFrame:
    """All five groups with their percentage of all events."""
    totals = moon.groupBy("magnitude_group").agg(F.sum("event_count").alias("event_count"))
    groups = bands.labels(bands.MAGNITUDE_GROUPS)
    return with_share(
        densify(totals, "magnitude_group", groups, {"event_count": 0}), "event_count", "percentage"
    ).orderBy(bands.rank_in(F.col("magnitude_group"), groups))


def map_statistics(selection: DataFrame) -> DataFrame:
    """A25, over the events selected for the map."""
    return selection.agg(
        F.count("*").alias("events_displayed"),
        F.avg("magnitude").alias("avg_magnitude"),
        F.max("magnitude").alias("max_magnitude"),
        F.avg("depth").alias("avg_depth"),
    )


def _selection_bands(
    selection: DataFrame, column: str, bounds: tuple[tuple[str, float | None, float | None], ...]
) -> DataFrame:
    """Count and percentage per band, in one row; 0 % of an empty selection."""
    value, everything = F.col(column), F.count("*")
    figures = []
    for name, low, high in bounds:
        inside = F.lit(True) if low is None else value >= low
        if high is not None:
            inside = inside & (value < high)
        count = F.count_if(inside)
        figures.append(count.alias(f"{name}_count"))
        figures.append(
            F.when(everything > 0, count * 100.0 / everything)
            .otherwise(0.0)
            .alias(f"{name}_percentage")
        )
    return selection.agg(*figures)


def map_depth_bands(selection: DataFrame) -> DataFrame:
    """A26."""
    return _selection_bands(selection, "depth", SELECTION_DEPTH_BANDS)


def map_magnitude_bands(selection: DataFrame) -> DataFrame:
    """A27."""
    return _selection_bands(selection, "magnitude", SELECTION_MAGNITUDE_BANDS)
