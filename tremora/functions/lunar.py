"""Lunar phase as a column expression.

The phase is the Moon's ecliptic longitude minus the Sun's, as a fraction of a
full turn: 0 new, 0.25 first quarter, 0.5 full, 0.75 last quarter.  It is
computed from the leading periodic terms of the Moon's elongation published in
Jean Meeus, *Astronomical Algorithms* (2nd ed., chapters 25 and 47): the Moon's
longitude down to 0.01 degrees, less the Sun's equation of the centre, at
dynamical time (UTC plus ``DELTA_T``, which is within 5 s of the truth from 2000
to 2035).  The terms left out add up to less than 0.0003 of a turn; only an event
that close to the edge of a phase sector can be named differently from a full
ephemeris.

Being plain arithmetic, it runs inside generated code, with no Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.functions.moments import epoch_micros

# --- fixed values: published constants of the series ---
J2000_MICROS = 946_728_000_000_000  # 2000-01-01T12:00
MICROS_PER_CENTURY = 3_155_760_000_000_000
MEAN_ELONGATION = (297.8501921, 445267.1114034)  # degrees, degrees per century
SUN_ANOMALY = (357.5291092, 35999.0502909)
MOON_ANOMALY = (134.9633964, 477198.8675055)
MOON_LATITUDE = (93.2720950, 483202.0175233)
DELTA_T_MICROS = 69_000_000
# Longitude of the Moon: amplitude in degrees, then multiples of the mean elongation, the Sun's
# anomaly, the Moon's anomaly and the Moon's argument of latitude.
MOON_TERMS = (
    (6.288774, 0, 0, 1, 0),
    (1.274027, 2, 0, -1, 0),
    (0.658314, 2, 0, 0, 0),
    (0.213618, 0, 0, 2, 0),
    (-0.185116, 0, 1, 0, 0),
    (-0.114332, 0, 0, 0, 2),
    (0.058793, 2, 0, -2, 0),
    (0.057066, 2, -1, -1, 0),
    (0.053322, 2, 0, 1, 0),
    (0.045758, 2, -1, 0, 0),
    (-0.040923, 0, 1, -1, 0),
    (-0.034720, 1, 0, 0, 0),
    (-0.030383, 0, 1, 1, 0),
    (0.015327, 2, 0, 0, -2),
    (-0.012528, 0, 0, 1, 2),
    (0.010980, 0, 0, 1, -2),
    (0.010675, 4, 0, -1, 0),
    (0.010034, 0, 0, 3, 0),
)
# Equation of the centre of the Sun, by multiples of its anomaly.
SUN_TERMS = ((1.914602, 1), (0.019993, 2), (0.000289, 3))
# --- end of fixed values ---


def with_moon_phase(rows: DataFrame, moment: str = "datetime") -> DataFrame:
    """Add ``moon_phase`` in [0, 1) of a timestamp_ntz taken as UTC; null for null.

    Each step is a column of its own, so that Spark computes it once per row
    rather than once in every term that uses it.
    """
    micros = epoch_micros(F.col(moment)) - J2000_MICROS + DELTA_T_MICROS
    angles = {
        name: F.radians(F.lit(start) + F.lit(rate) * F.col("_centuries"))
        for name, (start, rate) in {
            "_elongation": MEAN_ELONGATION,
            "_sun": SUN_ANOMALY,
            "_moon": MOON_ANOMALY,
            "_latitude": MOON_LATITUDE,
        }.items()
    }
    periodic = sum(
        (
            F.sin(_combined(multiples, angles)) * amplitude
            for amplitude, *multiples in MOON_TERMS
        ),
        start=F.lit(0.0),
    )
    for amplitude, multiple in SUN_TERMS:
        periodic -= F.sin(F.col("_sun") * multiple) * amplitude
    return (
        rows.withColumn("_centuries", micros.cast("double") / float(MICROS_PER_CENTURY))
        .withColumns(angles)
        .withColumn("_turns", (F.degrees("_elongation") + periodic) / 360.0)
        .withColumn("moon_phase", F.col("_turns") - F.floor("_turns"))
        .drop("_centuries", *angles, "_turns")
    )


def _combined(multiples: Iterable[int], angles: Iterable[str]) -> Column:
    """The argument of one term: multiples of the angles, added up."""
    parts = [F.col(angle) * n for n, angle in zip(multiples, angles) if n]
    return reduce(Column.__add__, parts)
