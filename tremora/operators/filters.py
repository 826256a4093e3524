"""Predicates on events."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def at_least(rows: DataFrame, minimum: float | None, column: str = "magnitude") -> DataFrame:
    """P9 on events, P10 with ``avg_magnitude`` on the cells of a cube.  None keeps all."""
    return rows if minimum is None else rows.where(F.col(column) >= F.lit(minimum))


def ordered_range(
    start: dt.date | None, end: dt.date | None
) -> tuple[dt.date | None, dt.date | None]:
    """On the map, a reversed range means the whole range."""
    if start is not None and end is not None and start > end:
        return None, None
    return start, end


def within_days(
    rows: DataFrame, start: dt.date | None, end: dt.date | None, column: str = "date"
) -> DataFrame:
    """Calendar days from start to end, both included; None leaves a side open.

    A reversed range holds no day.  Where it means the whole range (P12), apply
    ``ordered_range`` first.
    """
    if start is not None:
        rows = rows.where(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.where(
            F.col(column) < F.lit(end + dt.timedelta(days=1)).cast("timestamp_ntz")
        )
    return rows


def filter_events(
    rows: DataFrame,
    min_magnitude: float | None = None,
    max_magnitude: float | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
    depth_categories: Sequence[str] | None = None,
    regions: Sequence[str] | DataFrame | None = None,
    magnitude_categories: Sequence[str] | None = None,
) -> DataFrame:
    """P13-P17 together.  ``regions`` may be a frame with a ``region`` column, for long lists.

    Days are taken as a range of ``datetime``, which is a column of the scan.
    """
    rows = within_days(at_least(rows, min_magnitude), start, end, "datetime")
    if max_magnitude is not None:
        rows = rows.where(F.col("magnitude") <= F.lit(max_magnitude))
    if depth_categories is not None:
        rows = rows.where(F.col("depth_category").isin(*depth_categories))
    if magnitude_categories is not None:
        rows = rows.where(F.col("magnitude_category").isin(*magnitude_categories))
    if isinstance(regions, DataFrame):
        rows = rows.join(regions, "region", "left_semi")
    elif regions is not None:
        rows = rows.where(F.col("region").isin(*regions))
    return rows
