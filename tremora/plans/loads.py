"""Loading a lake from catalogue files.

A load can stop at any point and be run again.  A year's rows, its line in the
ledger and their checksum become visible together.  The merged table notes the
checksums of what went into it, star and cubes the folders of the merged table
they were made of; whatever doesn't fit is made again, year by year where it can be.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.config import Limits
from tremora.operators.conform import derive, refused, to_timed
from tremora.operators.contents import contents
from tremora.operators.dedup import keep_first, merge_latest
from tremora.plans import ledger as years
from tremora.plans.cubes import build_cubes, refresh_cubes
from tremora.plans.star import build_star
from tremora.sources.catalog_csv import (
    POSITION,
    RAW_COLUMNS,
    read_by_header,
    read_catalog,
    require_rows,
)
from tremora.sources.lake import Lake, clustered, gathered
from tremora.sources.shared import path_exists, scratch_folder, written

BY_YEAR = T.StructType([T.StructField("load_year", T.IntegerType())])
SOURCE_COLUMNS = tuple(name for _, name, _ in RAW_COLUMNS)
BRONZE_SCHEMA = T.StructType(
    [T.StructField(name, kind) for _, name, kind in RAW_COLUMNS]
    + [
        T.StructField("datetime", T.TimestampNTZType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_bytes", T.LongType()),
        T.StructField("load_year", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class LoadReport:
    """What a load did."""

    years: list[int] = field(default_factory=list)
    lost_years: list[int] = field(default_factory=list)
    silver_rows: int | None = None
    star: dict[str, int] = field(default_factory=dict)
    cubes: dict[str, int] = field(default_factory=dict)


def full_load(
    lake: Lake,
    paths: str | Sequence[str],
    limits: Limits = Limits(),
    strict: bool = True,
    by_header: bool = True,
    export: bool = True,
) -> LoadReport:
    """L2: from files to all tables, replacing what was there.

    ``strict=False`` leaves rows with unreadable times out instead of failing, and
    writes all rows that were left out, with the rule they broke, to the table of
    refused rows.  ``by_header=False`` saves the look at the files' headers
    where all have the schema's; one that has not is then an error.
    """
    read = read_by_header if by_header else read_catalog
    raw = require_rows(read(lake.spark, paths, with_position=True))
    if not strict:
        lake.replace(lake.names.refused, refused(raw.drop(*POSITION), limits))
    timed = keep_first(raw).transform(to_timed, limits, strict)
    rows = lake.replace(lake.names.silver, events_by_time(timed), ["year"])
    if export:
        lake.export(lake.names.silver)
    return LoadReport(
        silver_rows=rows, star=build_star(lake), cubes=build_cubes(lake)
    )


def events_by_time(timed: DataFrame) -> DataFrame:
    """Events in the order of time, year by year, so that a range of days skips most files.

    All that follows from the source columns is derived after the range partitioning:
    what lies below it is run twice, since Spark samples the rows, and is shuffled.
    The year they are sorted by stays theirs, or the writer would sort once more.
    """
    laid_out = clustered(timed.withColumn("_year", F.year("datetime")), "_year", "datetime", "event_id")
    return derive(laid_out).withColumn("year", F.col("_year")).drop("_year")


def read_bronze(lake: Lake) -> DataFrame:
    """Source columns, parsed time and origin of all loaded years; also when there are none yet."""
    if not lake.exists(lake.names.bronze):
        return lake.spark.createDataFrame([], BRONZE_SCHEMA)
    return lake.read(lake.names.bronze, BRONZE_SCHEMA)


def held_years(lake: Lake) -> DataFrame:
    """The years that bronze holds, by its folders."""
    return lake.spark.createDataFrame([(int(year),) for year in lake.folders(lake.names.bronze)], BY_YEAR)


def load_years(
    lake: Lake,
    raw_root: str,
    wanted: Sequence[int],
    limits: Limits = Limits(),
    strict: bool = True,
    by_header: bool = True,
) -> list[int]:
    """L3: bring the wanted years that have files into bronze, all in one job.

    Files lie in ``load_year=YYYY/`` folders, and other folders are not read.
    Bronze is partitioned by the year a file was requested for, not by the year
    of the event, so that a stray event cannot replace another year's partition.
    A year without rows is not recorded; what an earlier load, forgotten since,
    left in bronze for the wanted years goes, or it would pass for theirs.
    The year's rows, its line in the ledger and the checksum of its rows become
    visible at once.  ``strict`` and ``by_header`` are those of ``full_load``.
    """
    names = lake.names
    if by_header:  # headers of the wanted years' folders only
        folders = [f"{raw_root.rstrip('/')}/load_year={year}" for year in wanted]
        there = [folder for folder in folders if path_exists(lake.spark, folder)]
        if not there:
            lake.drop_partitions(names.bronze, wanted)
            return []
        raw = read_by_header(lake.spark, there, partitions=BY_YEAR, add="origin", root=raw_root)
    else:
        these = F.col("load_year").isin(*wanted)
        raw = read_catalog(lake.spark, raw_root, partitions=BY_YEAR, add="origin").where(these)
    if not strict:
        lake.replace_partitions(names.refused, refused(raw, limits), "load_year", wanted)
    bronze = lake.write(names.bronze, to_timed(raw, limits, strict), "load_year", wanted)
    if not bronze.rows:
        lake.commit(bronze)
        return []
    rows = lake.read_written(bronze)
    details = lake.write(names.ledger, years.year_details(rows), "load_year", ())
    checksums = contents(rows, "load_year", [*SOURCE_COLUMNS, "datetime"])
    lake.commit(bronze, details, lake.write(names.contents, checksums, "load_year", ()))
    return sorted(map(int, details.folders))


def event_ids(bronze: DataFrame) -> DataFrame:
    """Where the rows of each event are: the year they were loaded for and the year they fall in."""
    return bronze.select("event_id", F.year("datetime").alias("year"), "load_year").distinct()


def changed_years(lake: Lake) -> list[int]:
    """Loaded years whose rows are not those that silver was merged from, by their checksums."""
    now, before = years.year_contents(lake), lake.made_of(lake.names.silver) or {}
    return sorted(int(year) for year in now.keys() | before.keys() if now.get(year) != before.get(year))


def merge_bronze(lake: Lake) -> int:
    """All loaded years as one table of events, the latest row per id.

    Bronze holds source columns and the parsed time; the others are derived from
    the rows that are merged: that is less to write and to shuffle.  Of the years whose
    rows have changed, and of what an earlier merge took from them, the ids are
    looked up in an index of all ids; only years that hold a row of one of these
    events are read and written again.  Gives the rows of the table.
    """
    names = lake.names
    now, before = years.year_contents(lake), lake.made_of(names.silver)
    loaded = F.col("load_year").isin(*map(int, now))
    bronze = read_bronze(lake).where(loaded).select(*SOURCE_COLUMNS, "datetime", "load_year")
    if not before or not lake.exists(names.silver_ids):
        merged = merge_latest(bronze.drop("load_year"))
        silver = lake.write(names.silver, events_by_time(merged), "year", made_of=now)
        lake.commit(silver, lake.write(names.silver_ids, gathered(event_ids(bronze), "load_year"), "load_year"))
        return silver.rows

    changed = changed_years(lake)
    index, is_changed = lake.read(names.silver_ids), F.col("load_year").isin(*changed)
    with scratch_folder(lake.spark, "merge") as scratch:
        new = written(event_ids(bronze.where(is_changed)), f"{scratch}/new")
        old = index.where(is_changed)
        ids = new.select("event_id").union(old.select("event_id")).distinct()
        ids = written(ids.withColumnRenamed("event_id", "__id"), f"{scratch}/ids")
        same = F.col("event_id").eqNullSafe(F.col("__id"))
        elsewhere = index.where(~is_changed).join(ids, same, "left_semi")
        places = [rows.select("year", "load_year") for rows in (new, old, elsewhere)]
        places = written(places[0].union(places[1]).union(places[2]).distinct(), f"{scratch}/places")
        # Years only, so two short lists.
        touched = [row.year for row in places.select("year").distinct().collect()]
        sources = [row.load_year for row in places.select("load_year").distinct().collect()]
        rows = bronze.where(F.col("load_year").isin(*sources)).drop("load_year").join(ids, same, "left_semi")
        kept = lake.read(names.silver).where(F.col("year").isin(*touched)).join(ids, same, "left_anti")
        merged = merge_latest(rows)
        merged = kept.select(*merged.columns).unionByName(merged)
        silver = lake.write(names.silver, events_by_time(merged), "year", touched, made_of=now)
        lake.commit(silver, lake.write(names.silver_ids, gathered(new, "load_year"), "load_year", changed))
    return lake.read(names.silver).count()


def needs_merge(lake: Lake) -> bool:
    """Whether silver is missing or was merged from other rows than the ledger lists."""
    return not lake.exists(lake.names.silver) or bool(changed_years(lake))


def is_stale(lake: Lake, tables: Sequence[str] | None = None) -> bool:
    """Whether a table of the star or a cube, or one of those given, is missing or made of another silver."""
    silver = lake.folders(lake.names.silver)
    tables = lake.names.star + lake.names.cubes if tables is None else tables
    return any(lake.made_of(table) != silver for table in tables)


def incremental_load(
    lake: Lake,
    raw_root: str,
    requested: DataFrame,
    limits: Limits = Limits(),
    strict: bool = True,
    by_header: bool = True,
    phase_digits: int | None = None,
    star: bool = True,
    cubes: bool = True,
) -> LoadReport:
    """Load the requested years that are missing and rebuild what depends on them.

    ``phase_digits`` is that of the cubes.  ``star`` and ``cubes`` say which of them
    are kept up: neither is made from the other, so a lake that is read for one
    needs not pay for both.  One that is left out stays as it was, and the next
    load that asks for it finds it stale.
    """
    names = lake.names
    lost: list[int] = []
    if lake.exists(names.bronze):
        lost = years.validate_ledger(lake, held_years(lake))
    elif lake.exists(names.ledger):
        years.reset_ledger(lake)

    missing = years.missing_years(requested, years.read_ledger(lake))
    wanted = [row.load_year for row in missing.collect()]
    loaded = load_years(lake, raw_root, wanted, limits, strict, by_header) if wanted else []

    if years.read_ledger(lake).isEmpty():
        return LoadReport(loaded, lost)
    rows = merge_bronze(lake) if needs_merge(lake) else None
    if rows is None and not is_stale(lake, (names.star if star else ()) + (names.cubes if cubes else ())):
        return LoadReport(loaded, lost)
    facts = build_star(lake) if star else {}
    return LoadReport(loaded, lost, rows, facts, refresh_cubes(lake, phase_digits) if cubes else {})


def yearly_files(raw: DataFrame, path: str, year: Column | None = None) -> None:
    """Write raw rows as one folder of CSV files per year, by default that of their time text."""
    year = F.substring("time", 1, 4).cast("int") if year is None else year
    (
        raw.withColumn("load_year", year)
        .write.mode("overwrite")
        .partitionBy("load_year")
        .option("header", True)
        .option("escape", '"')
        .csv(path)
    )
