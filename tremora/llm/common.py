"""What the operators share: the definition of a word, safe column names, steps written half way.

Operators select the columns they name and work under names of their own that
begin with ``__``, so further columns of the input, whatever they are called,
neither disturb them nor get lost where rows are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.sources.shared import fresh_path, written

# White space is space, tab, line feed, vertical tab, form feed and carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def settled(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here."""
    return written(rows, fresh_path(rows.sparkSession, name))


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*of: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.xxhash64(*of).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def ranked(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Adds each row's place among those with its key, from 0, as a long.

    Which of them is first is left open: rows are counted inside parts of at most
    65,536 rows as they are written, and moved by the parts before, so the rows of
    one key never meet in a task.  Keys hold no nulls.
    """
    placed = settled(rows.withColumn("__at", F.monotonically_increasing_id()), "ranked").withColumn(
        "__part", F.shiftright("__at", 16)
    )
    parted = [*key, "__part"]
    counts = placed.groupBy(*parted).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = settled(
        counts.select(*parted, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")), "firsts"
    )
    inside = F.row_number().over(Window.partitionBy(*parted).orderBy("__at")) - 1
    return (
        placed.withColumn("__inside", inside)
        .join(first, parted)
        .withColumn(name, (F.col("__inside") + F.col("__first")).cast("long"))
        .drop("__part", "__at", "__inside", "__first")
    )


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Distinct rows with their place in the order, from 0, in a column of that name.

    Sorted by range partitions; a prefix sum over the partitions' counts, one
    row each, makes the places dense, so no task sees all rows.
    """
    ranged = settled(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("__part", F.shiftright("__at", 33))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")
    )
    place = F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per range partition, of which there are spark.sql.shuffle.partitions.
    return (
        ranged.join(F.broadcast(first), "__part")
        .withColumn(name, place)
        .drop("__part", "__at", "__first")
    )


def byte_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose strings or binaries take at most that many bytes, or one row."""
    stops = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = stops[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(stops, before + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
