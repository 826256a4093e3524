"""Star schema: three dimensions and the event fact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.config import UNKNOWN
from tremora.functions import bands, moments
from tremora.operators.dedup import merge_latest
from tremora.operators.keyed_join import MAX_HOT_KEYS, attach_id
from tremora.operators.numbering import number_keys
from tremora.operators.together import together
from tremora.sources.lake import Lake, clustered, column_names
from tremora.sources.shared import scratch_folder

TIME_KEYS = ("datetime",)  # the calendar fields follow from it
LOCATION_KEYS = ("latitude", "longitude", "place", "region")
MAGNITUDE_KEYS = ("magnitude", "magnitude_type", "magnitude_category")

TIME_SCHEMA = """
time_id BIGINT, datetime TIMESTAMP_NTZ, date TIMESTAMP_NTZ, year INT, month INT, day INT, hour INT,
day_of_week INT, day_name STRING, season STRING, is_weekend BOOLEAN"""
LOCATION_SCHEMA = """
location_id BIGINT, latitude DOUBLE, longitude DOUBLE, place STRING, region STRING,
hemisphere_ns STRING, hemisphere_ew STRING, climate_zone STRING"""
MAGNITUDE_SCHEMA = """
magnitude_id BIGINT, magnitude DOUBLE, magnitude_category STRING, magnitude_type STRING,
effects_description STRING, energy_joules DOUBLE"""
FACT_SCHEMA = """
earthquake_id STRING, time_id BIGINT, location_id BIGINT, magnitude_id BIGINT, event_id STRING,
depth DOUBLE, depth_category STRING, num_stations INT, azimuthal_gap DOUBLE, min_distance DOUBLE,
rms DOUBLE, horizontal_error DOUBLE, depth_error DOUBLE, magnitude_error DOUBLE,
network STRING, status STRING, event_type STRING, moon_phase DOUBLE, moon_phase_name STRING"""
STAR_SCHEMAS = (TIME_SCHEMA, LOCATION_SCHEMA, MAGNITUDE_SCHEMA, FACT_SCHEMA)

NUMBER_MEASURES = (
    "depth", "azimuthal_gap", "min_distance", "rms",
    "horizontal_error", "depth_error", "magnitude_error", "moon_phase",
)
TEXT_MEASURES = ("depth_category", "network", "status", "event_type", "moon_phase_name")


def complete_events(silver: DataFrame) -> DataFrame:
    """Events that can be keyed, with the defaults of their keys filled in."""
    for name in ("datetime", "latitude", "longitude", "magnitude"):
        silver = silver.where(F.col(name).isNotNull())
    return silver.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(UNKNOWN))
            for name in ("place", "region", "magnitude_type")
        }
    )


def with_time_attributes(rows: DataFrame) -> DataFrame:
    """E1-E3 and E9-E12 from ``datetime``."""
    moment = F.col("datetime")
    return rows.withColumns(
        {
            "date": moments.start_of_day(moment),
            "year": F.year(moment),
            "month": F.month(moment),
            "day": F.dayofmonth(moment),
            "hour": F.hour(moment),
            "day_of_week": moments.iso_weekday(moment),
            "day_name": moments.day_name(moments.iso_weekday(moment)),
            "season": moments.season(F.month(moment)),
            "is_weekend": moments.is_weekend(moments.iso_weekday(moment)),
        }
    )


def with_location_attributes(rows: DataFrame) -> DataFrame:
    """E13-E15."""
    return rows.withColumns(
        {
            "hemisphere_ns": bands.hemisphere_ns(F.col("latitude")),
            "hemisphere_ew": bands.hemisphere_ew(F.col("longitude")),
            "climate_zone": bands.climate_zone(F.col("latitude")),
        }
    )


def with_magnitude_attributes(rows: DataFrame) -> DataFrame:
    """E16, E17."""
    return rows.withColumns(
        {
            "effects_description": bands.effects_description(F.col("magnitude")),
            "energy_joules": bands.energy_joules(F.col("magnitude")),
        }
    )


def with_measures(rows: DataFrame) -> DataFrame:
    """Measures cast and defaulted.  The station count rounds half to even."""
    numbers = {
        name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in NUMBER_MEASURES
    }
    texts = {name: F.coalesce(F.col(name), F.lit(UNKNOWN)) for name in TEXT_MEASURES}
    stations = F.rint(F.col("num_stations").cast("double")).cast("int")
    return rows.withColumns(
        {
            "earthquake_id": F.col("event_id"),
            "num_stations": F.coalesce(stations, F.lit(0)),
            **numbers,
            **texts,
        }
    )


def event_view(silver: DataFrame) -> DataFrame:
    """Every event with all dimension attributes and measures, straight from the merged events.

    Each fact row has exactly one row in each dimension, and all attributes of a
    dimension follow from its natural key.  So this has the same rows and values
    as the star joined back together (``star_view``), without a join or a shuffle.
    """
    return (
        complete_events(silver)
        .transform(with_time_attributes)
        .transform(with_location_attributes)
        .transform(with_magnitude_attributes)
        .transform(with_measures)
    )


@dataclass(frozen=True)
class Star:
    """The four tables, as frames."""

    time: DataFrame
    location: DataFrame
    magnitude: DataFrame
    fact: DataFrame

    @classmethod
    def of(cls, lake: Lake) -> Star:
        """S8."""
        return cls(*map(lake.read, lake.names.star, STAR_SCHEMAS))


def star_view(
    star: Star, time: bool = False, location: bool = False, magnitude: bool = False
) -> DataFrame:
    """The fact joined to the dimensions asked for, on their ids.

    Magnitude comes first: it is small enough to be broadcast, and a filter on it
    then thins the fact before the large dimensions are joined.
    """
    rows = star.fact
    if magnitude:
        rows = rows.join(star.magnitude, "magnitude_id")
    if location:
        rows = rows.join(star.location, "location_id")
    if time:
        rows = rows.join(star.time, "time_id")
    return rows


def build_star(
    lake: Lake,
    silver: DataFrame | None = None,
    unique_events: bool = True,
    by_time: bool = False,
    max_hot_keys: int = MAX_HOT_KEYS,
) -> dict[str, int]:
    """Write the three dimensions and the fact; gives the rows of each.

    Events merged by ``merge_latest`` hold each id once.  For other input, pass
    ``unique_events=False`` to have one row kept per id first (D4).  ``by_time``
    lays the fact out in the order of time, at the price of one more shuffle, so
    that reports on a range of days skip the files outside it.
    """
    spark, names = lake.spark, lake.names
    made_of = lake.folders(names.silver) if silver is None else None
    silver = lake.read(names.silver) if silver is None else silver
    events = complete_events(silver if unique_events else merge_latest(silver))

    with scratch_folder(spark, "star") as scratch:
        time, location, magnitude = together(
            spark,
            lambda: number_keys(events, TIME_KEYS, "time_id", scratch),
            lambda: number_keys(events, LOCATION_KEYS, "location_id", scratch),
            lambda: number_keys(events, MAGNITUDE_KEYS, "magnitude_id", scratch),
        )
        fact = events
        for numbered in (magnitude, location, time):
            fact = attach_id(fact, numbered, max_hot_keys=max_hot_keys)
        fact = with_measures(fact).select(*column_names(FACT_SCHEMA))
        if by_time:
            fact = clustered(fact, "time_id", "event_id")

        frames = (
            with_time_attributes(time.rows).select(*column_names(TIME_SCHEMA)),
            with_location_attributes(location.rows).select(*column_names(LOCATION_SCHEMA)),
            with_magnitude_attributes(magnitude.rows).select(*column_names(MAGNITUDE_SCHEMA)),
            fact,
        )
        tables = together(
            spark,
            *[
                lambda table=table, rows=rows: lake.write(table, rows, made_of=made_of)
                for table, rows in zip(names.star, frames)
            ],
        )
        lake.commit(*tables)  # all four at once
    return {table.table: table.rows for table in tables}
