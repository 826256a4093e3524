"""A raw catalogue derived from the tables ``events`` and ``nation``, for checks and the benchmark.

It spreads a month of events over 2020-2024 and contains what a real catalogue
does: revisions and repeated rows, nulls, and values that validation must drop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COPY_STEP = 1_000_000_007  # beyond all ids of the test tables

CATALOG = """
WITH located AS (
  SELECT event_id, user_id, value, n_name, ts - make_dt_interval(CAST(event_id % 1461 AS INT)) AS origin
  FROM {events} JOIN {nation} ON n_nationkey = user_id % 25),
issued AS (
  SELECT located.*, rev
  FROM located LATERAL VIEW explode(filter(array(
    0, CASE WHEN event_id % 50 = 0 THEN 1 END, CASE WHEN event_id % 125 = 0 THEN 0 END),
    r -> r IS NOT NULL)) AS rev),
timed AS (
  SELECT *, origin + make_dt_interval(0, 0, 0, rev) AS t1, origin + make_dt_interval(1 + rev) AS t2
  FROM issued)
SELECT
  concat(CAST(to_date(t1) AS STRING), 'T', lpad(CAST(hour(t1) AS STRING), 2, '0'), ':',
    lpad(CAST(minute(t1) AS STRING), 2, '0'), ':', lpad(CAST(second(t1) AS STRING), 2, '0'), '.',
    lpad(CAST(CAST(extract(SECOND FROM t1) * 1000 AS BIGINT) % 1000 AS STRING), 3, '0'), 'Z') AS time,
  CASE WHEN event_id % 307 = 3 THEN 95D
       ELSE CAST((user_id * 7919) % 18001 AS DOUBLE) / 100D - 90D END AS latitude,
  CAST((user_id * 104729) % 36001 AS DOUBLE) / 100D - 180D AS longitude,
  CASE WHEN event_id % 89 = 5 THEN NULL
       WHEN event_id % 211 = 7 THEN 1200D
       ELSE CAST((event_id * 37) % 700 AS DOUBLE) END AS depth,
  CASE WHEN event_id % 97 = 11 THEN NULL
       ELSE (floor(value / 5D) + 15D) / 10D END AS mag,
  CASE event_id % 4 WHEN 0 THEN 'mb' WHEN 1 THEN 'ml' WHEN 2 THEN 'mww' END AS magType,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 120 AS INT) END AS nst,
  CAST((event_id * 13) % 360 AS DOUBLE) AS gap,
  CAST((event_id * 7) % 500 AS DOUBLE) / 100D AS dmin,
  CAST((event_id * 3) % 200 AS DOUBLE) / 100D AS rms,
  CASE event_id % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'ci' END AS net,
  concat('ev', CAST(event_id AS STRING)) AS id,
  concat(CAST(to_date(t2) AS STRING), 'T', lpad(CAST(hour(t2) AS STRING), 2, '0'), ':',
    lpad(CAST(minute(t2) AS STRING), 2, '0'), ':', lpad(CAST(second(t2) AS STRING), 2, '0'), '.',
    lpad(CAST(CAST(extract(SECOND FROM t2) * 1000 AS BIGINT) % 1000 AS STRING), 3, '0'), 'Z') AS updated,
  CASE WHEN event_id % 101 = 13 THEN NULL
       WHEN event_id % 10 = 1 THEN concat(n_name, ' region')
       ELSE concat(CAST(user_id % 200 AS STRING), ' km SSE of ', n_name) END AS place,
  'earthquake' AS type,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 90 AS DOUBLE) / 10D END AS horizontalError,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 50 AS DOUBLE) / 10D END AS depthError,
  CAST(event_id % 9 AS DOUBLE) / 100D AS magError,
  CAST(event_id % 60 AS INT) AS magNst,
  CASE WHEN rev = 1 THEN 'reviewed' ELSE 'automatic' END AS status,
  'us' AS locationSource,
  'us' AS magSource
FROM timed
"""


def derived_catalog(spark: SparkSession, folder: str, copies: int = 1) -> DataFrame:
    """All events of a test-data folder as raw catalogue rows, in one scan.

    ``copies`` repeats them under further ids, and so at other times and depths.
    """
    events = spark.read.parquet(f"{folder}/events.parquet")
    if copies > 1:
        copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        events = events.withColumn("_copy", copy).withColumn(
            "event_id", F.col("event_id").cast("long") + F.col("_copy").cast("long") * COPY_STEP
        )
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    return spark.sql(CATALOG, events=events, nation=nation)
