"""Daily activity on a stream of events (ST2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.functions import bands, moments
from tremora.sources.lake import Lake
from tremora.sources.shared import path_exists, remove
from tremora.streaming.upsert import BY, Touched, replace_years, upsert

ACTIVITY = "daily_activity"
COUNTED = "counted_events"
CELLS = "daily_regions"


def daily_activity(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Count, mean and largest magnitude and energy per day, for streams of events that never change.

    Watermarks need a timestamp with a zone, so the event time is made from the
    zone-free microseconds; its one-day windows start at midnight UTC in every
    session.  State holds one row per open day.
    """
    micros = moments.epoch_micros(F.col("datetime"))
    day = F.col("window.start")
    whole_days = F.floor(F.unix_micros(day) / moments.MICROS_PER_DAY).cast("int")
    return (
        events.withColumn("event_time", F.timestamp_micros(micros))
        .withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", "1 day"))
        .agg(
            F.count("*").alias("daily_event_count"),
            F.avg("magnitude").alias("daily_avg_magnitude"),
            F.max("magnitude").alias("daily_max_magnitude"),
            F.sum(bands.energy_joules(F.col("magnitude"))).alias("daily_total_energy"),
        )
        .select(
            F.date_from_unix_date(whole_days).cast("timestamp_ntz").alias("date"),
            "daily_event_count",
            "daily_avg_magnitude",
            "daily_max_magnitude",
            "daily_total_energy",
        )
    )


def cells_of(events: DataFrame) -> DataFrame:
    """Events, their magnitudes and their energy per day and region, in a form that can be added up."""
    magnitude = F.col("magnitude")
    return (
        events.withColumn("date", moments.start_of_day(F.col("datetime")))
        .withColumn("region", bands.region_of(F.col("place")))
        .groupBy("date", "region", F.year("datetime").alias(BY))
        .agg(
            F.count("*").alias("events"),
            F.sum(magnitude).alias("magnitudes"),
            F.max(magnitude).alias("largest"),
            F.sum(bands.energy_joules(magnitude)).alias("energy"),
        )
    )


def days_of(cells: DataFrame) -> DataFrame:
    """A4 from cells: each region of a day has one."""
    return cells.groupBy("date", BY).agg(
        F.sum("events").alias("daily_event_count"),
        (F.sum("magnitudes") / F.sum("events")).alias("daily_avg_magnitude"),
        F.max("largest").alias("daily_max_magnitude"),
        F.sum("energy").alias("daily_total_energy"),
        F.count("*").alias("affected_regions"),
    )


def _cells_after(lake: Lake, touched: Touched, staging: str) -> DataFrame:
    """The cells of the touched years after a batch.

    What came is added to the cells; of days that lost a row, the cells are counted
    again from the events of those days, since neither maxima nor sums of doubles
    can be taken back.  Written aside under the number of the batch: one that is
    retried puts the same cells.
    """
    path = f"{staging}/cells"
    if not path_exists(lake.spark, f"{path}/_SUCCESS"):
        day = moments.start_of_day(F.col("datetime"))
        came, went = (touched.changes.where(f"sign = {sign}").withColumn("date", day) for sign in (1, -1))
        lost = went.select("date").distinct()
        found = cells_of(came.join(lost, "date", "left_anti")).unionByName(
            cells_of(touched.events.withColumn("date", day).join(lost, "date", "left_semi"))
        )
        if lake.exists(CELLS):
            before = lake.read(CELLS).where(F.col(BY).isin(*touched.years))
            found = found.unionByName(before.join(lost, "date", "left_anti"))
        summed = found.groupBy("date", "region", BY).agg(
            F.sum("events").alias("events"),
            F.sum("magnitudes").alias("magnitudes"),
            F.max("largest").alias("largest"),
            F.sum("energy").alias("energy"),
        )
        summed.write.mode("overwrite").parquet(path)
    return lake.spark.read.parquet(path)


def run_daily_activity(lake: Lake, table: str, checkpoint: str) -> DataFrame:
    """Drain a table of events as a stream; gives the activity of all its days so far.

    A revision of an event takes the place of what was counted before, also when
    it falls on another day or in another region: a batch's change log says which rows
    came and which went, and only their days change.  So a table that has been
    written anew, or a batch that is retried, counts nothing twice.
    """
    staging = f"{checkpoint.rstrip('/')}/staged"

    def store(batch: DataFrame, batch_id: int) -> None:
        touched = upsert(lake, COUNTED, batch, f"{staging}/{batch_id}")
        if touched.years:
            cells = _cells_after(lake, touched, f"{staging}/{batch_id}")
            replace_years(lake, CELLS, cells, touched.years)
            replace_years(lake, ACTIVITY, days_of(cells), touched.years)
        remove(lake.spark, f"{staging}/{batch_id - 1}")  # only the last batch is ever retried

    (
        lake.spark.readStream.schema(lake.read(table).schema)
        .parquet(lake.location(table))
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return lake.read(ACTIVITY).drop(BY)
