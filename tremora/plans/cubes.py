"""The five materialised aggregate tables.

Each function takes any frame with the event columns it reads: ``event_view`` of
the merged events, which needs no join, or ``star_view`` of the stored star.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.functions import bands
from tremora.operators.together import together
from tremora.plans.star import event_view
from tremora.sources.lake import Lake, Written, clustered, column_names, gathered

# In the order of TableNames.cubes.
CUBE_SCHEMAS = (
    """year INT, month INT, day_name STRING, hour INT, season STRING, is_weekend BOOLEAN,
    magnitude_category STRING, event_count BIGINT, avg_magnitude DOUBLE, min_magnitude DOUBLE,
    max_magnitude DOUBLE, avg_depth DOUBLE, total_energy DOUBLE""",
    """region STRING, hemisphere_ns STRING, hemisphere_ew STRING, climate_zone STRING,
    magnitude_category STRING, event_count BIGINT, avg_magnitude DOUBLE, max_magnitude DOUBLE,
    avg_depth DOUBLE, center_latitude DOUBLE, center_longitude DOUBLE""",
    """depth_category STRING, magnitude_category STRING, season STRING, event_count BIGINT,
    avg_depth DOUBLE, avg_magnitude DOUBLE, avg_stations DOUBLE, avg_gap DOUBLE,
    avg_horizontal_error DOUBLE, avg_depth_error DOUBLE""",
    """date TIMESTAMP_NTZ, year INT, month INT, day_of_week INT, daily_event_count BIGINT,
    daily_avg_magnitude DOUBLE, daily_max_magnitude DOUBLE, daily_total_energy DOUBLE,
    affected_regions BIGINT""",
    """moon_phase_name STRING, moon_phase DOUBLE, magnitude_group STRING, event_count BIGINT,
    avg_magnitude DOUBLE, max_magnitude DOUBLE, avg_depth DOUBLE""",
)


def read_cube(lake: Lake, table: str) -> DataFrame:
    """S8."""
    return lake.read(table, CUBE_SCHEMAS[lake.names.cubes.index(table)])


def mean(name: str) -> tuple[str, str]:
    return ("mean", name)


def exact_mean(name: str) -> tuple[str, str]:
    """A mean that doesn't depend on the order of the rows, so that it can be compared with a bound."""
    return ("exact mean", name)


def least(name: str) -> tuple[str, str]:
    return ("min", name)


def most(name: str) -> tuple[str, str]:
    return ("max", name)


def total(name: str) -> tuple[str, str]:
    return ("sum", name)


def different(name: str) -> tuple[str, str]:
    return ("distinct", name)


EXACT = "decimal(28,15)"  # holds any double of up to 13 digits before the point, to 15 places


def exact_sum(name: str) -> Column:
    """The sum of what the doubles stand for (5.4 is 5.4): the same in any order, unlike a sum of doubles."""
    return F.sum(F.col(name).cast(EXACT))


def exact_avg(name: str) -> Column:
    return exact_sum(name).cast("double") / F.count(name)


@dataclass(frozen=True)
class Cube:
    """Keys and measures of an aggregate; every row counts under the name ``count``.

    Reports filter cells by their mean magnitude, which often lies on the bound, so
    it is exact.

    ``parts`` gives states that can be merged: a mean is kept as its sum and the
    number of values.  Distinct values can't be merged from counts of them, so the
    states of a cube that has any must not share cells.
    """

    keys: tuple[str, ...]
    count: str
    measures: Mapping[str, tuple[str, str]]

    def of(self, events: DataFrame) -> DataFrame:
        """The cube, straight from the events."""
        kinds = {
            "mean": F.avg, "exact mean": exact_avg, "min": F.min, "max": F.max, "sum": F.sum,
            "distinct": F.count_distinct,
        }
        return events.groupBy(*self.keys).agg(
            F.count("*").alias(self.count),
            *[kinds[kind](column).alias(name) for name, (kind, column) in self.measures.items()],
        )

    def parts(self, events: DataFrame, *by: str) -> DataFrame:
        """Mergeable states per cell and ``by``."""
        states = [F.count("*").alias(self.count)]
        for name, (kind, column) in self.measures.items():
            if kind == "exact mean":
                states += [exact_sum(column).alias(f"{name}__sum"), F.count(column).alias(f"{name}__n")]
            elif kind == "mean":
                states += [F.sum(column).alias(f"{name}__sum"), F.count(column).alias(f"{name}__n")]
            else:
                kinds = {"min": F.min, "max": F.max, "sum": F.sum, "distinct": F.count_distinct}
                states.append(kinds[kind](column).alias(name))
        return events.groupBy(*self.keys, *by).agg(*states)

    def merged(self, parts: DataFrame) -> DataFrame:
        """The cube from states of disjoint sets of events."""
        found = [F.sum(self.count).alias(self.count)]
        for name, (kind, _) in self.measures.items():
            if kind in ("mean", "exact mean"):
                value = F.sum(f"{name}__sum").cast("double") / F.sum(f"{name}__n")
            else:
                value = {"min": F.min, "max": F.max, "sum": F.sum, "distinct": F.max}[kind](name)
            found.append(value.alias(name))
        return parts.groupBy(*self.keys).agg(*found)


TIME_MAGNITUDE = Cube(
    ("year", "month", "day_name", "hour", "season", "is_weekend", "magnitude_category"),
    "event_count",
    {
        "avg_magnitude": exact_mean("magnitude"),
        "min_magnitude": least("magnitude"),
        "max_magnitude": most("magnitude"),
        "avg_depth": mean("depth"),
        "total_energy": total("energy_joules"),
    },
)
LOCATION_MAGNITUDE = Cube(
    ("region", "hemisphere_ns", "hemisphere_ew", "climate_zone", "magnitude_category"),
    "event_count",
    {
        "avg_magnitude": exact_mean("magnitude"),
        "max_magnitude": most("magnitude"),
        "avg_depth": mean("depth"),
        "center_latitude": mean("latitude"),
        "center_longitude": mean("longitude"),
    },
)
DEPTH_ANALYSIS = Cube(
    ("depth_category", "magnitude_category", "season"),
    "event_count",
    {
        "avg_depth": mean("depth"),
        "avg_magnitude": exact_mean("magnitude"),
        "avg_stations": mean("num_stations"),
        "avg_gap": mean("azimuthal_gap"),
        "avg_horizontal_error": mean("horizontal_error"),
        "avg_depth_error": mean("depth_error"),
    },
)
TEMPORAL_TRENDS = Cube(
    ("date", "year", "month", "day_of_week"),
    "daily_event_count",
    {
        "daily_avg_magnitude": exact_mean("magnitude"),
        "daily_max_magnitude": most("magnitude"),
        "daily_total_energy": total("energy_joules"),
        "affected_regions": different("region"),
    },
)
MOON_PHASE = Cube(
    ("moon_phase_name", "moon_phase", "magnitude_group"),
    "event_count",
    {"avg_magnitude": exact_mean("magnitude"), "max_magnitude": most("magnitude"), "avg_depth": mean("depth")},
)


def time_magnitude(events: DataFrame) -> DataFrame:
    """A1."""
    return TIME_MAGNITUDE.of(events)


def location_magnitude(events: DataFrame) -> DataFrame:
    """A2."""
    return LOCATION_MAGNITUDE.of(events)


def depth_analysis(events: DataFrame) -> DataFrame:
    """A3."""
    return DEPTH_ANALYSIS.of(events)


def temporal_trends(events: DataFrame) -> DataFrame:
    """A4, and A14 on filtered events."""
    return TEMPORAL_TRENDS.of(events)


def with_phase_group(events: DataFrame, phase_digits: int | None = None) -> DataFrame:
    """The keys of A5.  The phase is almost continuous; ``phase_digits`` rounds it."""
    if phase_digits is not None:
        events = events.withColumn("moon_phase", F.round("moon_phase", phase_digits))
    return events.withColumn("magnitude_group", bands.magnitude_group(F.col("magnitude")))


def moon_phase(events: DataFrame, phase_digits: int | None = None) -> DataFrame:
    """A5, and A13 on filtered events.  Hardly reduces them, unless phases are rounded."""
    return MOON_PHASE.of(with_phase_group(events, phase_digits))


def build_cubes(
    lake: Lake, events: DataFrame | None = None, phase_digits: int | None = None
) -> dict[str, int]:
    """Write all five; gives the rows of each."""
    names = lake.names
    made_of = lake.folders(names.silver) if events is None else None
    events = event_view(lake.read(names.silver)) if events is None else events
    frames = (
        time_magnitude(events),
        location_magnitude(events),
        depth_analysis(events),
        temporal_trends(events),
        moon_phase(events, phase_digits),
    )
    return _replace_cubes(lake, frames, made_of)


def _replace_cubes(
    lake: Lake, frames: Sequence[DataFrame], made_of: Mapping[str, str] | None
) -> dict[str, int]:
    """Write the five cubes, in the order of their names, and switch to all of them at once."""
    names = lake.names
    frames = dict(zip(names.cubes, frames))
    laid_out = {names.cube_temporal_trends: ("date",), names.cube_moon_phase: ("moon_phase", "magnitude_group")}
    frames |= {table: clustered(frames[table], *order) for table, order in laid_out.items()}
    tables = together(
        lake.spark,
        *[lambda t=table, rows=rows: lake.write(t, rows, made_of=made_of) for table, rows in frames.items()],
    )
    lake.commit(*tables)
    return {table.table: table.rows for table in tables}


CUBES = (TIME_MAGNITUDE, LOCATION_MAGNITUDE, DEPTH_ANALYSIS, TEMPORAL_TRENDS, MOON_PHASE)
STATE_YEAR = "state_year"


def refresh_cubes(lake: Lake, phase_digits: int | None = None) -> dict[str, int]:
    """L8 for a lake that is loaded bit by bit: the cubes as ``build_cubes`` makes them.

    Each cube has a table of mergeable states per cell and year of the event.  The
    states of a year note the folder of the merged events they were made of, so
    only years that have been written since are read again, whatever was revised or
    taken out there; the cubes are merged from the states of all years.  A day lies
    in one year, so the regions of a day are counted within its states.
    """
    names, spark = lake.names, lake.spark
    # States say how they were made; those made in another way are made again.
    years, made = lake.folders(names.silver), {"phase_digits": str(phase_digits), "mean_magnitude": EXACT}
    silver = lake.read(names.silver)

    def states(table: str, cube: Cube) -> Written | None:
        before = lake.made_of(table) or {}
        if any(before.get(name) != value for name, value in made.items()):
            before = {}
        touched = [year for year in years.keys() | before.keys() - made.keys() if years.get(year) != before.get(year)]
        if not touched:
            return None
        read = [int(year) for year in touched if year in years]
        events = with_phase_group(event_view(silver.where(F.col("year").isin(*read))), phase_digits)
        parts = cube.parts(events.withColumn(STATE_YEAR, F.col("year")), STATE_YEAR)
        return lake.write(table, gathered(parts, STATE_YEAR), STATE_YEAR, touched if before else None, made_of=years | made)

    tables = [f"state_{table}" for table in names.cubes]
    changes = together(spark, *[lambda t=table, cube=cube: states(t, cube) for table, cube in zip(tables, CUBES)])
    lake.commit(*[change for change in changes if change])
    frames = [
        cube.merged(lake.read(table)).select(*column_names(schema))
        for table, cube, schema in zip(tables, CUBES, CUBE_SCHEMAS)
    ]
    return _replace_cubes(lake, frames, years)
