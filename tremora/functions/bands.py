"""Classes cut from a numeric column, and ranks of named classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: upper bounds (exclusive) and labels, lowest first; the last label has no bound ---
MAGNITUDE_CATEGORIES = (
    (3.0, "Minor"),
    (5.0, "Light"),
    (6.0, "Moderate"),
    (7.0, "Strong"),
    (8.0, "Major"),
    (None, "Great"),
)
DEPTH_CATEGORIES = ((70.0, "Shallow"), (300.0, "Intermediate"), (None, "Deep"))
MAGNITUDE_GROUPS = ((4.0, "1-3"), (5.0, "4"), (6.0, "5"), (8.0, "6-7"), (None, "8-9"))
MARKER_COLORS = ((3.0, "green"), (4.0, "blue"), (5.0, "orange"), (6.0, "red"), (None, "darkred"))
EFFECTS = (
    (2.0, "Micro - Not felt"),
    (3.0, "Minor - Rarely felt"),
    (4.0, "Light - Often felt, rarely causes damage"),
    (5.0, "Moderate - Notable shaking, slight damage"),
    (6.0, "Strong - Can cause damage in populated areas"),
    (7.0, "Major - Serious damage over large areas"),
    (8.0, "Great - Serious damage over very large areas"),
    (None, "Epic - Devastating over extremely large areas"),
)
PHASE_NAMES = (
    "New Moon",
    "Waxing Crescent",
    "First Quarter",
    "Waxing Gibbous",
    "Full Moon",
    "Waning Gibbous",
    "Last Quarter",
    "Waning Crescent",
)
SEASON_ORDER = ("Spring", "Summer", "Fall", "Winter")
TROPIC_LATITUDE = 23.5
POLAR_LATITUDE = 66.5
# --- end of fixed values ---


def labels(bands: Sequence[tuple[float | None, str]]) -> tuple[str, ...]:
    """The class names of a band table, lowest first."""
    return tuple(name for _, name in bands)


def banded(value: Column, bands: Sequence[tuple[float | None, str]]) -> Column:
    """The label of the first band whose upper bound lies above the value."""
    *bounded, (_, last) = bands
    chain = None
    for bound, name in bounded:
        when = F.when if chain is None else chain.when
        chain = when(value < F.lit(bound), F.lit(name))
    return chain.otherwise(F.lit(last))


def rank_in(value: Column, order: Sequence[str]) -> Column:
    """1-based place of a name in a fixed order, null for names outside it."""
    place = F.array_position(F.array(*[F.lit(name) for name in order]), value)
    return F.nullif(place, F.lit(0).cast("bigint")).cast("int")


def magnitude_category(magnitude: Column) -> Column:
    return banded(magnitude, MAGNITUDE_CATEGORIES)


def depth_category(depth: Column) -> Column:
    return banded(depth, DEPTH_CATEGORIES)


def magnitude_group(magnitude: Column) -> Column:
    return banded(magnitude, MAGNITUDE_GROUPS)


def effects_description(magnitude: Column) -> Column:
    return banded(magnitude, EFFECTS)


def marker_color(magnitude: Column) -> Column:
    return banded(magnitude, MARKER_COLORS)


def marker_radius(magnitude: Column) -> Column:
    """E22."""
    return F.greatest(F.lit(3.0), magnitude * F.lit(1.5))


def energy_joules(magnitude: Column) -> Column:
    """E17, the Gutenberg-Richter energy relation in joules."""
    return F.pow(F.lit(10.0), F.lit(1.5) * magnitude + F.lit(4.8))


def phase_name(phase: Column) -> Column:
    """Eight sectors of 1/8, each centred on its own phase."""
    sector = F.floor(phase * 8 + F.lit(0.5)).cast("int") % 8
    return F.element_at(F.array(*[F.lit(name) for name in PHASE_NAMES]), sector + 1)


def hemisphere_ns(latitude: Column) -> Column:
    return F.when(latitude >= 0, "Northern").otherwise("Southern")


def hemisphere_ew(longitude: Column) -> Column:
    return F.when(longitude >= 0, "Eastern").otherwise("Western")


def climate_zone(latitude: Column) -> Column:
    """Both circles belong to the zone nearer the equator."""
    distance = F.abs(latitude)
    return (
        F.when(distance <= TROPIC_LATITUDE, "Tropical")
        .when(distance <= POLAR_LATITUDE, "Temperate")
        .otherwise("Polar")
    )


def region_of(place: Column) -> Column:
    """What follows the last " of ", or the whole place."""
    return F.substring_index(place, " of ", -1)
