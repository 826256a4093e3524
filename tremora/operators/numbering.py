"""Dense ids 1..N in sort order, without a single-partition sort.

``row_number`` over an unpartitioned window would send every row to one task.
Here rows are range-partitioned on their full key, which splits evenly whatever
the values are because the keys are distinct, and sorted within partitions.  A
row's partition and place in it are written out once; the number of rows per
partition is then summed up to the offset where each partition's ids start.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tremora.sources.shared import written

WEIGHT = "_rows"
_PLACE_BITS = 33  # monotonically_increasing_id keeps the partition above, the place below


def place(
    distinct_rows: DataFrame, order: Sequence[str], path: str, *figures: Column
) -> tuple[DataFrame, dict]:
    """Rows in the order of a key that is unique and not null, written with their places.

    Also gives figures over all rows, taken while writing.  (Below the range
    partitioning they would count the rows that Spark samples for it once more.)
    """
    taken = Observation()
    ranged = distinct_rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumn("_place", F.monotonically_increasing_id())
    if not figures:
        return written(placed, path), {}
    return written(placed.observe(taken, *figures), path), taken.get


def number(placed: DataFrame, id_name: str) -> DataFrame:
    """``place``d rows with their place counted over all partitions, from 1."""
    columns = [name for name in placed.columns if name != "_place"]
    placed = placed.withColumn("_slice", F.shiftright("_place", _PLACE_BITS))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_slice")
        .agg(F.count("*").alias("_size"))
        .select("_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    within = F.col("_place").bitwiseAND((1 << _PLACE_BITS) - 1)
    # One row per shuffle partition: bounded by spark.sql.shuffle.partitions.
    return placed.join(F.broadcast(starts), "_slice").select(
        (F.col("_start") + within + 1).alias(id_name), *columns
    )


@dataclass(frozen=True)
class NumberedKeys:
    """Distinct keys with their id and their number of rows (``WEIGHT``)."""

    rows: DataFrame
    keys: tuple[str, ...]
    id_name: str
    total: int  # rows over all keys


def number_keys(
    rows: DataFrame, keys: Sequence[str], id_name: str, scratch: str
) -> NumberedKeys:
    """The distinct keys of a frame, numbered.

    Counting aggregates on the map side, so a hot key is one row per task before
    anything is shuffled.  The result reads from a table in the scratch folder.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias(WEIGHT))
    placed, found = place(
        counted,
        keys,
        f"{scratch}/{id_name}",
        F.sum(WEIGHT).alias("total"),
    )
    return NumberedKeys(
        number(placed, id_name),
        tuple(keys),
        id_name,
        found["total"] or 0,
    )
