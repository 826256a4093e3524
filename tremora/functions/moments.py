"""Calendar fields of a zone-free timestamp.

All times are ``timestamp_ntz``.  Nothing here goes through the session time
zone, so results are the same in every session.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the time text of a catalogue file, and the names of days and seasons ---
TIME_SHAPE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
SEASONS = ("Winter", "Spring", "Summer", "Fall")  # by quarter of the year that starts in December
# --- end of fixed values ---

MICROS_PER_DAY = 86_400_000_000


def parse_time(text: Column, strict: bool = True) -> Column:
    """Text to timestamp_ntz.

    Strict parsing raises on text of another shape.  Otherwise such text gives
    null, for the caller to set the row aside.  (A cast of checked text takes
    half the time of parsing by a pattern.)
    """
    moment = F.when(text.rlike(TIME_SHAPE), text.try_cast("timestamp_ntz"))
    if not strict:
        return moment
    refusal = F.raise_error(F.concat(F.lit("not a catalogue time: "), text))
    return F.coalesce(moment, F.when(text.isNotNull(), refusal.cast("timestamp_ntz")))


def iso_weekday(moment: Column) -> Column:
    """Monday is 1 and Sunday 7."""
    return F.weekday(moment) + 1


def day_name(weekday: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in DAY_NAMES]), weekday)


def season(month: Column) -> Column:
    """December to February is winter, and so on by threes."""
    quarter = F.floor((month % 12) / 3).cast("int")
    return F.element_at(F.array(*[F.lit(name) for name in SEASONS]), quarter + 1)


def is_weekend(weekday: Column) -> Column:
    return weekday.isin(6, 7)


def start_of_day(moment: Column) -> Column:
    """E12.  ``date_trunc`` would pass through the session zone; the date cast does not."""
    return F.to_date(moment).cast("timestamp_ntz")


def epoch_micros(moment: Column) -> Column:
    """Microseconds since 1970-01-01T00:00 of a zone-free timestamp."""
    days = F.date_diff(F.to_date(moment), F.date_from_unix_date(F.lit(0))).cast("bigint")
    minutes = days * 1440 + F.hour(moment) * 60 + F.minute(moment)
    seconds = F.extract(F.lit("SECOND"), moment)
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def whole_days_between(first: Column, last: Column) -> Column:
    """Full days from first to last."""
    return F.floor((epoch_micros(last) - epoch_micros(first)) / MICROS_PER_DAY).cast("int")


def inclusive_days(first: Column, last: Column) -> Column:
    """Calendar days from first to last, both counted."""
    return (F.date_diff(F.to_date(last), F.to_date(first)) + 1).cast("int")


def second_text(moment: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS``.  (``date_format`` would pass through the session zone.)"""
    return F.substring(moment.cast("string"), 1, 19)


def clock_angle(hour: Column) -> Column:
    """Degrees of an hour on a 24-hour dial."""
    return (hour * 15).cast("int")
