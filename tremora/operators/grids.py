"""Event density on a grid of degrees or pixels (G2, G3), over all events and not only those drawn."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the map's projection and its heat layer ---
TILE = 256  # pixels that the world is wide at zoom 0
HIGHEST = 85.05112877980659  # degrees of latitude that the projection shows
RADIUS = 20  # pixels
BLUR = 25  # pixels
# --- end of fixed values ---


def _cell(name: str, degrees: float) -> Column:
    return F.floor(F.col(name) / F.lit(degrees)).cast("int")


def density_grid(events: DataFrame, cell_degrees: float = 1.0) -> DataFrame:
    """Number of events and their summed magnitude per cell."""
    return events.groupBy(
        _cell("latitude", cell_degrees).alias("lat_cell"),
        _cell("longitude", cell_degrees).alias("lon_cell"),
    ).agg(F.count("*").alias("event_count"), F.sum("magnitude").alias("weight"))


def cluster_grid(events: DataFrame, zoom: int = 2) -> DataFrame:
    """One cluster per cell of 360/2^zoom degrees, with its centre and largest event."""
    degrees = 360.0 / 2**zoom
    return events.groupBy(
        _cell("latitude", degrees).alias("lat_cell"),
        _cell("longitude", degrees).alias("lon_cell"),
    ).agg(
        F.count("*").alias("event_count"),
        F.avg("latitude").alias("center_latitude"),
        F.avg("longitude").alias("center_longitude"),
        F.max("magnitude").alias("max_magnitude"),
    )


def pixels(zoom: int) -> tuple[Column, Column]:
    """Web Mercator pixels of ``longitude`` and ``latitude``, from the north-west corner of the map."""
    world = F.lit(float(TILE * 2**zoom))
    lat = F.radians(F.greatest(F.least(F.col("latitude"), F.lit(HIGHEST)), F.lit(-HIGHEST)))
    x = (F.col("longitude") + F.lit(180.0)) / F.lit(360.0) * world
    y = (F.lit(0.5) - F.ln(F.tan(lat / 2 + F.lit(math.pi / 4))) / F.lit(2 * math.pi)) * world
    return x, y


def heat_kernel(radius: int = RADIUS, blur: int = BLUR) -> list[tuple[int, int, float]]:
    """(dx, dy, weight) of the cells that a cell of half the reach warms, itself included.

    Whole within the radius of a cell's middle, then fading to nothing over the blur.
    """
    reach = radius + blur
    cell, near = reach / 2, range(-2, 3)
    found = [(i, j, (reach - max(cell * math.hypot(i, j), radius)) / blur) for i in near for j in near]
    return [(i, j, weight) for i, j, weight in found if weight > 0]


def heat_grid(events: DataFrame, zoom: int = 2, radius: int = RADIUS, blur: int = BLUR) -> DataFrame:
    """G2 as the heat layer draws it: magnitudes summed per cell of pixels, each cell spread over
    its neighbours by the kernel.  Events are summed up first, so what is spread is cells."""
    x, y = pixels(zoom)
    size = F.lit((radius + blur) / 2)
    cells = events.groupBy(F.floor(x / size).alias("x"), F.floor(y / size).alias("y")).agg(
        F.count("*").alias("events"), F.sum("magnitude").alias("weight")
    )
    spread = F.array(
        *[
            F.struct(
                (F.col("x") + i).cast("int").alias("x_cell"),
                (F.col("y") + j).cast("int").alias("y_cell"),
                (F.col("weight") * F.lit(share)).alias("heat"),
                (F.col("events") if (i, j) == (0, 0) else F.lit(0).cast("long")).alias("events"),
            )
            for i, j, share in heat_kernel(radius, blur)
        ]
    )
    return cells.select(F.inline(spread)).groupBy("x_cell", "y_cell").agg(
        F.sum("heat").alias("heat"), F.sum("events").alias("event_count")
    )
