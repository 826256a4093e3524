"""Reports on events and on the cubes.

Reports on events take them with their attributes: ``event_view`` of the merged
events, which needs no join, or ``star_view`` with the dimensions used.

Averages over cube cells are plain means of the cells' averages, as these
reports have always been defined; ``weighted=True`` gives the mean over events.
The filter of a cube report by magnitude keeps cells whose *average* reaches it
(P10).  For a filter on events, build the cube from filtered events first.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.functions import bands, moments
from tremora.operators.filters import at_least, ordered_range, within_days
from tremora.operators.shapes import largest, relabel
from tremora.plans import cubes

TOP_EVENT_COLUMNS = (
    "event_id", "datetime", "place", "region", "magnitude", "magnitude_category",
    "depth", "depth_category", "latitude", "longitude",
)
MAP_COLUMNS = (
    "event_id", "datetime", "latitude", "longitude", "place", "region",
    "magnitude", "magnitude_category", "depth", "depth_category",
)

# --- fixed values: headings of the tables shown to readers ---
TOP_EVENT_LABELS = {
    "datetime": "Date & Time",
    "place": "Location",
    "magnitude": "Magnitude",
    "depth": "Depth (km)",
}
REGION_LABELS = {
    "region": "Region",
    "event_count": "Event Count",
    "avg_magnitude": "Avg Magnitude",
    "max_magnitude": "Max Magnitude",
}
CATEGORY_LABELS = {
    "magnitude_category": "Category",
    "total_events": "Events",
    "avg_magnitude": "Avg Mag",
    "avg_depth": "avg_depth",
}
# --- end of fixed values ---


def _cell_mean(name: str, weighted: bool, count: str = "event_count") -> Column:
    if weighted:
        mean = F.sum(F.col(name) * F.col(count)) / F.sum(count)
    else:
        mean = F.avg(name)
    return mean.alias(name)


def _strongest(events: DataFrame, limit: int, columns: tuple[str, ...]) -> DataFrame:
    """The largest events, of equal ones the latest, then by id: one scan of these columns."""
    order = [F.desc("magnitude"), F.desc("datetime"), F.asc("event_id")]
    return events.select(*columns).orderBy(*order).limit(limit)


def top_magnitude_events(events: DataFrame, limit: int = 10) -> DataFrame:
    """By magnitude, then the latest, then by id."""
    return _strongest(events, limit, TOP_EVENT_COLUMNS)


def top_events_table(top_events: DataFrame) -> DataFrame:
    """T1 as shown to readers."""
    return relabel(
        top_events.withColumn("datetime", moments.second_text(F.col("datetime"))),
        TOP_EVENT_LABELS,
    )


def region_table(regions: DataFrame) -> DataFrame:
    """A6 or A7 as shown to readers."""
    return relabel(regions, REGION_LABELS)


def category_table(distribution: DataFrame) -> DataFrame:
    """A8 as shown to readers."""
    return relabel(distribution, CATEGORY_LABELS)


def events_for_map(
    events: DataFrame,
    min_magnitude: float | None = None,
    limit: int = 1000,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """T2 with P9, P11 and P12.  Days are a range of times, so all filters reach the scan."""
    rows = at_least(events, min_magnitude)
    rows = within_days(rows, *ordered_range(start, end), column="datetime")
    return _strongest(rows, limit, MAP_COLUMNS)


def map_points(map_events: DataFrame) -> DataFrame:
    """G1: what is drawn for each event of T2."""
    return map_events.select(
        "event_id",
        "latitude",
        "longitude",
        bands.marker_color(F.col("magnitude")).alias("color"),
        bands.marker_radius(F.col("magnitude")).alias("radius"),
        "magnitude",
        F.round("depth", 1).alias("depth"),
        "place",
        moments.second_text(F.col("datetime")).alias("date_text"),
        "magnitude_category",
    )


def kpis(events: DataFrame) -> DataFrame:
    """One row for all key figures, from one pass over two columns."""
    first, last = F.min("datetime"), F.max("datetime")
    return events.agg(
        F.count("*").alias("total_events"),
        first.alias("min_datetime"),
        last.alias("max_datetime"),
        moments.start_of_day(first).alias("min_date"),
        moments.start_of_day(last).alias("max_date"),
        F.avg("magnitude").alias("avg_magnitude"),
        F.max("magnitude").alias("max_magnitude"),
        moments.whole_days_between(first, last).alias("range_days"),
    )


def days_shown(
    events: DataFrame, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """The days a map covers: those asked for, or all there are events on."""
    start, end = ordered_range(start, end)
    first, last = (
        F.coalesce(F.lit(asked).cast("timestamp_ntz"), moments.start_of_day(there))
        for asked, there in ((start, F.min("datetime")), (end, F.max("datetime")))
    )
    return events.agg(first.alias("first_day"), last.alias("last_day")).withColumn(
        "days", moments.inclusive_days(F.col("first_day"), F.col("last_day"))
    )


def events_by_region(cube: DataFrame, top_n: int = 10) -> DataFrame:
    """Distinct cells by count; a region shows once per distinct set of figures."""
    columns = [
        "region", "event_count", "avg_magnitude", "max_magnitude",
        "center_latitude", "center_longitude",
    ]
    rows = cube.select(*columns).distinct()
    return largest(rows, top_n, "event_count", "region", *columns[2:])


def region_rollup(
    cube: DataFrame, min_magnitude: float | None = None, weighted: bool = False
) -> DataFrame:
    """One row per region."""
    return (
        at_least(cube, min_magnitude, "avg_magnitude")
        .groupBy("region")
        .agg(
            F.sum("event_count").alias("event_count"),
            _cell_mean("avg_magnitude", weighted),
            F.max("max_magnitude").alias("max_magnitude"),
            _cell_mean("center_latitude", weighted),
            _cell_mean("center_longitude", weighted),
        )
    )


def region_top_n(
    cube: DataFrame, top_n: int = 10, min_magnitude: float | None = None, weighted: bool = False
) -> DataFrame:
    """A7 with T3, T4."""
    return largest(region_rollup(cube, min_magnitude, weighted), top_n, "event_count", "region")


def temporal_trends(cube: DataFrame) -> DataFrame:
    """A15."""
    return cube.select(
        "date",
        "daily_event_count",
        "daily_avg_magnitude",
        "daily_max_magnitude",
        "daily_total_energy",
        "affected_regions",
    ).orderBy("date")


def _pattern(
    cube: DataFrame, by: str, means: tuple[str, ...], min_magnitude: float | None, weighted: bool
) -> DataFrame:
    return (
        at_least(cube, min_magnitude, "avg_magnitude")
        .groupBy(by)
        .agg(
            F.sum("event_count").alias("total_events"),
            *[_cell_mean(name, weighted) for name in means],
        )
    )


def magnitude_distribution(
    cube: DataFrame, min_magnitude: float | None = None, weighted: bool = False
) -> DataFrame:
    """A8, weakest category first."""
    rows = _pattern(
        cube, "magnitude_category", ("avg_magnitude", "avg_depth"), min_magnitude, weighted
    )
    order = bands.labels(bands.MAGNITUDE_CATEGORIES)
    return rows.orderBy(bands.rank_in(F.col("magnitude_category"), order).asc_nulls_last())


def depth_analysis(cube: DataFrame, weighted: bool = False) -> DataFrame:
    """A9, shallowest category first."""
    means = ("avg_depth", "avg_magnitude", "avg_stations")
    rows = _pattern(cube, "depth_category", means, None, weighted)
    order = bands.labels(bands.DEPTH_CATEGORIES)
    return rows.orderBy(bands.rank_in(F.col("depth_category"), order).asc_nulls_last())


def hourly_patterns(
    cube: DataFrame, min_magnitude: float | None = None, weighted: bool = False
) -> DataFrame:
    """A10, with the hour's angle on a dial."""
    return (
        _pattern(cube, "hour", ("avg_magnitude",), min_magnitude, weighted)
        .withColumn("theta", moments.clock_angle(F.col("hour")))
        .orderBy("hour")
    )


def seasonal_patterns(
    cube: DataFrame, min_magnitude: float | None = None, weighted: bool = False
) -> DataFrame:
    """A11, spring first."""
    rows = _pattern(cube, "season", ("avg_magnitude", "avg_depth"), min_magnitude, weighted)
    return rows.orderBy(bands.rank_in(F.col("season"), bands.SEASON_ORDER).asc_nulls_last())


def moon_phase_analysis(cube: DataFrame, min_magnitude: float | None = None) -> DataFrame:
    """A12."""
    return at_least(cube, min_magnitude, "avg_magnitude").orderBy(
        F.asc_nulls_last("moon_phase"), "magnitude_group"
    )


def moon_phase_filtered(
    events: DataFrame, min_magnitude: float | None = None, phase_digits: int | None = None
) -> DataFrame:
    """A13, from events with their magnitude."""
    return cubes.moon_phase(at_least(events, min_magnitude), phase_digits).orderBy(
        F.asc_nulls_last("moon_phase"), "magnitude_group"
    )


def daily_trend(events: DataFrame, min_magnitude: float | None = None) -> DataFrame:
    """A14, from events with time, location and magnitude."""
    return cubes.temporal_trends(at_least(events, min_magnitude)).orderBy("date")


def magnitude_depth_sample(
    events: DataFrame, min_magnitude: float | None = None, limit: int = 5000
) -> DataFrame:
    """T5: a sample that does not change between runs, taken in order of a hash of the id."""
    return (
        at_least(events, min_magnitude)
        .orderBy(F.md5(F.col("event_id").cast("binary")), "event_id")
        .limit(limit)
        .select("event_id", "magnitude", "depth", "magnitude_category")
    )
