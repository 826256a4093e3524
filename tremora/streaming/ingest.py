"""Incremental ingest of newly arrived files (ST1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.config import Limits
from tremora.operators.conform import refused, to_events, to_timed
from tremora.sources.catalog_csv import (
    RAW_SCHEMA,
    header_cells,
    headers_of,
    places_of_known,
    read_by_header,
)
from tremora.sources.lake import Lake
from tremora.sources.shared import remove
from tremora.streaming.upsert import upsert

ARRIVALS = "bronze_arrivals"
ARRIVED = "arrived_events"
QUARANTINE = "quarantined_files"
QUARANTINE_SCHEMA = "file STRING, bytes BIGINT, header STRING, reason STRING, batch BIGINT"

# Columns without which no row of a file could be kept.
REQUIRED = ("id", "time", "latitude", "longitude", "mag")


def fault(header: str | None) -> str | None:
    """Why a file with this header cannot be read; None if it can."""
    if header is None:
        return "no header"
    cells = header_cells(header)
    known = places_of_known(cells)
    missing = [name for name in REQUIRED if name not in known]
    if missing:
        return f"no column {', '.join(missing)}"
    folded = [cell.lower() for cell in cells]
    repeated = sorted(name for name in known if folded.count(name.lower()) > 1 and cells.count(name) != 1)
    return f"more than one column {', '.join(repeated)}" if repeated else None


def ingest_new_files(
    lake: Lake,
    raw_path: str,
    checkpoint: str,
    limits: Limits = Limits(),
    files_per_batch: int = 10_000,
    strict: bool = True,
) -> int:
    """Bring every file not seen before into the lake and stop; gives the batches run.

    The stream is one of files, whose checkpoint remembers them; each is judged by
    its own header.  One that cannot be read goes to the table of quarantined files
    with its reason and stops nothing; the others are read by their headers, columns
    in any order.  A batch writes its own folder of arrivals, named by the batch, so
    one that is retried replaces what it left behind; then it is merged into the table
    of the latest row per event, of which it touches the years it has to.
    ``strict=False`` leaves rows with unreadable times out; what was left out goes
    to the refused rows of the batch.
    """
    stored = 0
    spark, staging = lake.spark, f"{checkpoint.rstrip('/')}/staged"

    def store(batch: DataFrame, batch_id: int) -> None:
        nonlocal stored
        stored += 1
        files = {row.path: row.length for row in batch.collect()}  # at most files_per_batch
        found = headers_of(spark, sorted(files))
        header_of = {file: header for header, listed in found.items() for file in listed}
        faults = {path: fault(header_of.get(path)) for path in files}
        bad = [(p, files[p], header_of.get(p), why, batch_id) for p, why in faults.items() if why]
        rows = spark.createDataFrame(bad, QUARANTINE_SCHEMA)
        lake.replace_partitions(QUARANTINE, rows, "batch", [batch_id])
        good = {header: listed for header, listed in found.items() if not fault(header)}
        target = f"{lake.path(ARRIVALS)}/batch={batch_id}"
        if good:
            raw = read_by_header(spark, list(files), found=good)
        else:
            raw = spark.createDataFrame([], RAW_SCHEMA)
        # Further columns of some files would make arrivals of one table differ in their schema.
        raw = raw.select(*RAW_SCHEMA.names)
        to_timed(raw, limits, strict).write.mode("overwrite").parquet(target)
        if not strict:
            left_out = refused(raw, limits).withColumn("batch", F.lit(batch_id))
            lake.replace_partitions(lake.names.refused, left_out, "batch", [batch_id])
        upsert(lake, ARRIVED, spark.read.parquet(target), f"{staging}/{batch_id}")
        remove(spark, f"{staging}/{batch_id - 1}")  # only the last batch is ever retried

    query = (
        spark.readStream.format("binaryFile")
        .schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(raw_path)
        .select("path", "length")  # of the files' content, nothing
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stored


def quarantined_files(lake: Lake) -> DataFrame:
    """Files that could not be read, with their reason."""
    if not lake.exists(QUARANTINE):  # before the first batch
        return lake.spark.createDataFrame([], QUARANTINE_SCHEMA)
    return lake.read(QUARANTINE)


def arrived_events(lake: Lake) -> DataFrame:
    """D3 over all batches: a revision may arrive in any later batch."""
    if not lake.exists(ARRIVED):  # before the first batch
        return to_events(lake.spark.createDataFrame([], RAW_SCHEMA))
    return lake.read(ARRIVED)
