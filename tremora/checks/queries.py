"""One query per operator, over whole tables.

Sums of doubles depend on the order of the rows, so means are rounded to six
decimals and energies compared by their logarithm.  A mean may lie exactly half
way between two such values, where noise in its last bit would decide; all are
moved up by 1e-9 first, here and in the SQL.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremora.checks.workspace import PHASE_DIGITS, Workspace
from tremora.operators import conform, dedup, filters, grids, profile
from tremora.plans import cubes, figures, ledger, reports
from tremora.plans.loads import BY_YEAR
from tremora.plans.star import star_view
from tremora.sources.catalog_csv import preview, read_by_header, read_catalog, stack
from tremora.streaming.ingest import arrived_events, quarantined_files

Query = Callable[[SparkSession, str], DataFrame]

MIN_MAGNITUDE = 5.5
MAP_MAGNITUDE = 4.0
MAP_EVENTS = 100  # fewer than there are from MAP_MAGNITUDE on, so that the cut decides
MAP_DAYS = (dt.date(2021, 3, 1), dt.date(2022, 8, 31))
WINTER = (dt.date(2021, 12, 1), dt.date(2022, 2, 28))
REGIONS = ["NATION_3", "NATION_8", "NATION_11", "NATION_20", "NATION_1 region", "NATION_16 region"]
CELL_DEGREES = 5.0
ZOOM = 3

EVENT_COLUMNS = ("datetime", "year", "month", "day", "hour", "day_of_week")

registered: dict[str, Query] = {}


def query(make: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
    """Register a query under the name of its function."""
    registered[make.__name__] = lambda spark, folder: make(Workspace.of(spark, folder))
    return make


def plain_stations(rows: DataFrame, name: str = "num_stations") -> DataFrame:
    """The station count as a double: an integer with nulls reads differently from tool to tool."""
    return rows.withColumn(name, F.col(name).cast("double"))


def rounded(rows: DataFrame) -> DataFrame:
    """All doubles to six decimals, and energies as logarithms."""
    changed = {}
    for name, kind in rows.dtypes:
        if kind == "double":
            value = F.log10(name) if name.endswith(("energy", "energy_joules")) else F.col(name)
            changed[name] = F.round(value + F.lit(1e-9), 6)
    return rows.withColumns(changed)


# -- scans, cleaning and enrichment ---------------------------------------------------------


@query
def csv_scan(w: Workspace) -> DataFrame:
    return plain_stations(read_catalog(w.spark, f"{w.raw_files()}/*"), "nst")


@query
def csv_stack(w: Workspace) -> DataFrame:
    """The files of early and of late years, put on top of each other."""
    rows = read_catalog(w.spark, w.raw_files(), partitions=BY_YEAR)
    stacked = stack(rows.where("load_year >= 2022"), rows.where("load_year < 2022"))
    return stacked.select("load_year", "id", "time", "updated", "mag", "place", "status")


@query
def csv_by_header(w: Workspace) -> DataFrame:
    """Files with three different headers; the further column stays."""
    rows = read_by_header(w.spark, f"{w.mixed_files()}/*")
    seen = F.col("remark").isNull() | (F.col("remark") == 'said "so", twice')
    return plain_stations(rows.where(seen).drop("remark"), "nst")


@query
def csv_preview(w: Workspace) -> DataFrame:
    return preview(w.raw().orderBy("id", "time", "updated").select("id", "time", "mag"), 5)


@query
def conform_clean_validate(w: Workspace) -> DataFrame:
    return plain_stations(conform.clean(w.raw()))


@query
def rejects(w: Workspace) -> DataFrame:
    return conform.rejects(w.raw()).select("event_id", "time", "failed_rule")


@query
def refused_rows(w: Workspace) -> DataFrame:
    """What a lenient load leaves out, where some times can't be read."""
    raw = w.raw().withColumn("time", F.when(F.col("status") == "reviewed", "soon").otherwise(F.col("time")))
    return conform.refused(raw).select("event_id", "time", "failed_rule")


@query
def quality_audit(w: Workspace) -> DataFrame:
    return conform.removed_rows(w.raw())


@query
def column_profile(w: Workspace) -> DataFrame:
    return profile.column_profile(conform.conform_names(w.raw()))


@query
def duplicate_audit(w: Workspace) -> DataFrame:
    return profile.duplicate_audit(w.events())


@query
def enrich_calendar(w: Workspace) -> DataFrame:
    rows = conform.clean(w.raw()).transform(conform.add_datetime).transform(conform.add_calendar)
    return rows.select("event_id", *EVENT_COLUMNS)


@query
def enrich_categories(w: Workspace) -> DataFrame:
    return conform.add_classes(conform.clean(w.raw())).select(
        "event_id", "time", "magnitude_category", "depth_category", "region"
    )


@query
def moon_phase(w: Workspace) -> DataFrame:
    return rounded(w.events().select("event_id", "datetime", "moon_phase", "moon_phase_name"))


@query
def silver_dedup_first(w: Workspace) -> DataFrame:
    return dedup.keep_first(w.raw()).select("id", "time", "updated", "status", "mag", "place")


@query
def silver_merge_latest(w: Workspace) -> DataFrame:
    return rounded(plain_stations(conform.to_merged_events(w.raw())))


@query
def summary_statistics(w: Workspace) -> DataFrame:
    return rounded(profile.summary_statistics(w.silver()))


# -- star -----------------------------------------------------------------------------------


@query
def dim_time(w: Workspace) -> DataFrame:
    return w.star().time


@query
def dim_location(w: Workspace) -> DataFrame:
    return w.star().location


@query
def dim_magnitude(w: Workspace) -> DataFrame:
    return rounded(w.star().magnitude)


@query
def fact_earthquakes(w: Workspace) -> DataFrame:
    return rounded(w.star().fact)


@query
def star_audit(w: Workspace) -> DataFrame:
    lake = w.star_lake()
    return profile.table_audit(lake, (*lake.names.star, "no_such_table"))


@query
def star_join_all(w: Workspace) -> DataFrame:
    """J4."""
    rows = star_view(w.star(), time=True, location=True, magnitude=True)
    return rounded(
        rows.select(
            "event_id", "datetime", "date", "season", "is_weekend", "latitude", "longitude",
            "place", "climate_zone", "magnitude", "magnitude_type", "effects_description",
            "energy_joules", "depth", "network",
        )
    )


# -- cubes: from the merged events, and from the stored star (J4-J6) -------------------------


@query
def cube_time_magnitude(w: Workspace) -> DataFrame:
    return rounded(cubes.time_magnitude(w.view()))


@query
def cube_location_magnitude(w: Workspace) -> DataFrame:
    return rounded(cubes.location_magnitude(w.view()))


@query
def cube_depth_analysis(w: Workspace) -> DataFrame:
    return rounded(cubes.depth_analysis(w.view()))


@query
def cube_temporal_trends(w: Workspace) -> DataFrame:
    return rounded(cubes.temporal_trends(w.view()))


@query
def cube_moon_phase(w: Workspace) -> DataFrame:
    return rounded(cubes.moon_phase(w.view(), PHASE_DIGITS))


@query
def star_cube_time_magnitude(w: Workspace) -> DataFrame:
    return rounded(cubes.time_magnitude(star_view(w.star(), time=True, magnitude=True)))


@query
def star_cube_location_magnitude(w: Workspace) -> DataFrame:
    return rounded(cubes.location_magnitude(star_view(w.star(), location=True, magnitude=True)))


@query
def star_cube_depth_analysis(w: Workspace) -> DataFrame:
    return rounded(cubes.depth_analysis(star_view(w.star(), time=True, magnitude=True)))


@query
def star_cube_temporal_trends(w: Workspace) -> DataFrame:
    rows = star_view(w.star(), time=True, location=True, magnitude=True)
    return rounded(cubes.temporal_trends(rows))


@query
def star_cube_moon_phase(w: Workspace) -> DataFrame:
    return rounded(cubes.moon_phase(star_view(w.star(), magnitude=True), PHASE_DIGITS))


@query
def cube_audit(w: Workspace) -> DataFrame:
    lake = w.cube_lake()
    return profile.table_audit(lake, lake.names.cubes)


# -- reports on events ----------------------------------------------------------------------


@query
def kpis(w: Workspace) -> DataFrame:
    return rounded(reports.kpis(w.view()))


@query
def top_magnitude_events(w: Workspace) -> DataFrame:
    return reports.top_magnitude_events(w.view(), 100)


@query
def top_events_table(w: Workspace) -> DataFrame:
    return reports.top_events_table(reports.top_magnitude_events(w.view()))


@query
def days_shown(w: Workspace) -> DataFrame:
    """From a given day to the last there are events on."""
    return reports.days_shown(w.view(), MAP_DAYS[0])


@query
def days_shown_reversed(w: Workspace) -> DataFrame:
    return reports.days_shown(w.view(), *reversed(MAP_DAYS))


def _map(w: Workspace) -> DataFrame:
    return reports.events_for_map(w.view(), MAP_MAGNITUDE, MAP_EVENTS)


@query
def events_for_map(w: Workspace) -> DataFrame:
    return _map(w)


@query
def events_for_map_days(w: Workspace) -> DataFrame:
    return reports.events_for_map(w.view(), MAP_MAGNITUDE, MAP_EVENTS, *MAP_DAYS)


@query
def events_for_map_reversed_days(w: Workspace) -> DataFrame:
    return reports.events_for_map(w.view(), MAP_MAGNITUDE, MAP_EVENTS, *reversed(MAP_DAYS))


@query
def map_points(w: Workspace) -> DataFrame:
    return reports.map_points(_map(w))


@query
def map_stats(w: Workspace) -> DataFrame:
    return rounded(figures.map_statistics(_map(w)))


@query
def map_depth_bands(w: Workspace) -> DataFrame:
    return rounded(figures.map_depth_bands(_map(w)))


@query
def map_magnitude_bands(w: Workspace) -> DataFrame:
    return rounded(figures.map_magnitude_bands(_map(w)))


def _trend(w: Workspace) -> DataFrame:
    return reports.daily_trend(w.view(), MIN_MAGNITUDE)


@query
def daily_trend_filtered(w: Workspace) -> DataFrame:
    return rounded(_trend(w))


@query
def daily_stats(w: Workspace) -> DataFrame:
    return rounded(figures.daily_statistics(_trend(w)))


@query
def energy_stats(w: Workspace) -> DataFrame:
    return rounded(figures.energy_statistics(_trend(w)))


@query
def day_of_week(w: Workspace) -> DataFrame:
    return rounded(figures.day_of_week(_trend(w)))


@query
def magnitude_depth_sample(w: Workspace) -> DataFrame:
    return reports.magnitude_depth_sample(star_view(w.star(), magnitude=True), 2.0)


@query
def filter_events(w: Workspace) -> DataFrame:
    rows = filters.filter_events(
        w.view(),
        min_magnitude=2.5,
        max_magnitude=7.5,
        start=MAP_DAYS[0],
        end=MAP_DAYS[1],
        depth_categories=["Shallow", "Deep"],
        regions=REGIONS,
        magnitude_categories=["Light", "Moderate", "Strong", "Major"],
    )
    return rows.select("event_id", "datetime", "region", "magnitude", "depth_category")


@query
def filter_events_long_list(w: Workspace) -> DataFrame:
    """P16 with the regions given as a frame."""
    star = w.star()
    polar = star.location.where("climate_zone = 'Polar'").select("region").distinct()
    rows = filters.filter_events(star_view(star, location=True, magnitude=True), 5.0, regions=polar)
    return rows.select("event_id", "region", "magnitude")


@query
def density_grid(w: Workspace) -> DataFrame:
    return rounded(grids.density_grid(w.view(), CELL_DEGREES))


@query
def cluster_grid(w: Workspace) -> DataFrame:
    return rounded(grids.cluster_grid(w.view(), ZOOM))


@query
def heat_grid(w: Workspace) -> DataFrame:
    """G2 with the radius and blur of the map's heat layer."""
    return rounded(grids.heat_grid(w.view(), ZOOM))


# -- reports on cubes -----------------------------------------------------------------------


@query
def events_by_region(w: Workspace) -> DataFrame:
    return rounded(reports.events_by_region(w.cube("location_magnitude"), 50))


@query
def region_rollup(w: Workspace) -> DataFrame:
    return rounded(reports.region_rollup(w.cube("location_magnitude")))


@query
def region_top_n(w: Workspace) -> DataFrame:
    return rounded(reports.region_top_n(w.cube("location_magnitude"), 10))


@query
def region_top_n_min_mag(w: Workspace) -> DataFrame:
    return rounded(reports.region_top_n(w.cube("location_magnitude"), 10, MIN_MAGNITUDE))


@query
def region_table(w: Workspace) -> DataFrame:
    regions = reports.region_top_n(w.cube("location_magnitude"), 10, MIN_MAGNITUDE)
    return rounded(reports.region_table(regions))


@query
def region_rollup_weighted(w: Workspace) -> DataFrame:
    return rounded(reports.region_rollup(w.cube("location_magnitude"), weighted=True))


@query
def magnitude_distribution(w: Workspace) -> DataFrame:
    return rounded(reports.magnitude_distribution(w.cube("time_magnitude")))


@query
def magnitude_distribution_min_mag(w: Workspace) -> DataFrame:
    return rounded(reports.magnitude_distribution(w.cube("time_magnitude"), MIN_MAGNITUDE))


@query
def category_table(w: Workspace) -> DataFrame:
    distribution = reports.magnitude_distribution(w.cube("time_magnitude"), MIN_MAGNITUDE)
    return rounded(reports.category_table(distribution))


@query
def magnitude_distribution_weighted(w: Workspace) -> DataFrame:
    return rounded(reports.magnitude_distribution(w.cube("time_magnitude"), weighted=True))


@query
def magnitude_share(w: Workspace) -> DataFrame:
    distribution = reports.magnitude_distribution(w.cube("time_magnitude"))
    return rounded(figures.magnitude_share(distribution))


@query
def depth_analysis(w: Workspace) -> DataFrame:
    return rounded(reports.depth_analysis(w.cube("depth_analysis")))


@query
def hourly_patterns(w: Workspace) -> DataFrame:
    return rounded(reports.hourly_patterns(w.cube("time_magnitude")))


@query
def hourly_patterns_min_mag(w: Workspace) -> DataFrame:
    return rounded(reports.hourly_patterns(w.cube("time_magnitude"), MIN_MAGNITUDE))


@query
def seasonal_patterns(w: Workspace) -> DataFrame:
    return rounded(reports.seasonal_patterns(w.cube("time_magnitude")))


@query
def seasonal_patterns_min_mag(w: Workspace) -> DataFrame:
    return rounded(reports.seasonal_patterns(w.cube("time_magnitude"), MIN_MAGNITUDE))


@query
def seasonal_patterns_strong_events(w: Workspace) -> DataFrame:
    """P9 in place of P10: the cube is built from the filtered events."""
    cube = cubes.time_magnitude(filters.at_least(w.view(), MIN_MAGNITUDE))
    return rounded(reports.seasonal_patterns(cube))


@query
def seasonal_with_total(w: Workspace) -> DataFrame:
    return rounded(figures.seasonal_with_total(reports.seasonal_patterns(w.cube("time_magnitude"))))


@query
def season_table(w: Workspace) -> DataFrame:
    seasonal = reports.seasonal_patterns(w.cube("time_magnitude"), MIN_MAGNITUDE)
    return rounded(figures.season_table(figures.seasonal_with_total(seasonal)))


@query
def seasons_shown(w: Workspace) -> DataFrame:
    """The seasons that a range of days doesn't reach are filled in."""
    cube = cubes.time_magnitude(filters.within_days(w.view(), *WINTER, "datetime"))
    seasonal = reports.seasonal_patterns(cube)
    return rounded(figures.seasons_shown(seasonal))


@query
def temporal_trends(w: Workspace) -> DataFrame:
    return rounded(reports.temporal_trends(w.cube("temporal_trends")))


@query
def moon_phase_analysis(w: Workspace) -> DataFrame:
    return rounded(reports.moon_phase_analysis(w.cube("moon_phase")))


@query
def moon_phase_analysis_min_mag(w: Workspace) -> DataFrame:
    return rounded(reports.moon_phase_analysis(w.cube("moon_phase"), MIN_MAGNITUDE))


def _moon(w: Workspace, min_magnitude: float = MIN_MAGNITUDE) -> DataFrame:
    rows = star_view(w.star(), magnitude=True)
    return reports.moon_phase_filtered(rows, min_magnitude, PHASE_DIGITS)


@query
def moon_phase_filtered(w: Workspace) -> DataFrame:
    return rounded(_moon(w))


@query
def phase_statistics(w: Workspace) -> DataFrame:
    return rounded(figures.phase_statistics(_moon(w)))


@query
def phase_table(w: Workspace) -> DataFrame:
    return rounded(figures.phase_table(figures.phase_statistics(_moon(w))))


@query
def phase_by_group(w: Workspace) -> DataFrame:
    return rounded(figures.phase_by_group(_moon(w)))


@query
def groups_present(w: Workspace) -> DataFrame:
    return figures.groups_present(_moon(w))


@query
def magnitude_group_share(w: Workspace) -> DataFrame:
    return rounded(figures.magnitude_group_share(_moon(w)))


# -- loads, ledger and streams --------------------------------------------------------------


@query
def full_load(w: Workspace) -> DataFrame:
    """L2.  The columns in which revisions differ have a query of their own, over ordered files."""
    lake = w.fully_loaded()
    return lake.read(lake.names.silver).select(
        "event_id", "magnitude", "depth", "place", "region", "magnitude_category"
    )


@query
def exported_events(w: Workspace) -> DataFrame:
    """The copy that a full load makes."""
    lake = w.fully_loaded()
    rows = w.spark.read.parquet(lake.path(f"processed/{lake.names.silver}.parquet"))
    return rows.select("event_id", "magnitude", "depth", "place", "region", "magnitude_category")


@query
def exposed_events(w: Workspace) -> DataFrame:
    """A table by its name in SQL."""
    w.silver()
    lake = w.lake()
    lake.expose(lake.names.silver)
    return w.spark.sql(
        f"SELECT year, region, count(*) AS events FROM {lake.names.silver} GROUP BY year, region"
    )


@query
def star_of_repeated_events(w: Workspace) -> DataFrame:
    """Rows that repeat an event give one fact."""
    return rounded(w.star_of_repeated().fact)


@query
def resumed_load(w: Workspace) -> DataFrame:
    """The fact after a load that stopped before the star and was run again."""
    lake = w.resumed()
    return rounded(lake.read(lake.names.fact))


@query
def incremental_load(w: Workspace) -> DataFrame:
    """The merged table after two runs."""
    lake = w.incrementally_loaded()
    return rounded(plain_stations(lake.read(lake.names.silver)))


@query
def loaded_fact(w: Workspace) -> DataFrame:
    """The fact after two runs."""
    lake = w.incrementally_loaded(star=True)
    return rounded(lake.read(lake.names.fact))


@query
def reloaded_year(w: Workspace) -> DataFrame:
    """The merged table after a reload with as many rows that stopped before its merge."""
    lake = w.reloaded()
    return rounded(plain_stations(lake.read(lake.names.silver)))


@query
def silver_loaded_in_parts(w: Workspace) -> DataFrame:
    """L3, D3: the merged table of which each load has written the touched years only."""
    lake = w.loaded_in_parts()
    return rounded(plain_stations(lake.read(lake.names.silver)))


def _loaded_cube(w: Workspace, name: str) -> DataFrame:
    """A cube merged from states, of which each load has renewed the touched years."""
    return rounded(cubes.read_cube(w.loaded_in_parts(cubes=True), f"cube_{name}"))


@query
def loaded_cube_time_magnitude(w: Workspace) -> DataFrame:
    return _loaded_cube(w, "time_magnitude")


@query
def loaded_cube_location_magnitude(w: Workspace) -> DataFrame:
    return _loaded_cube(w, "location_magnitude")


@query
def loaded_cube_depth_analysis(w: Workspace) -> DataFrame:
    return _loaded_cube(w, "depth_analysis")


@query
def loaded_cube_temporal_trends(w: Workspace) -> DataFrame:
    return _loaded_cube(w, "temporal_trends")


@query
def loaded_cube_moon_phase(w: Workspace) -> DataFrame:
    return _loaded_cube(w, "moon_phase")


@query
def full_load_first_rows(w: Workspace) -> DataFrame:
    """Of an event's rows, the first by file, in the columns that revisions change."""
    lake = w.fully_loaded_in_order()
    return lake.read(lake.names.silver).select("event_id", "time", "updated", "status")


@query
def silver_in_time_order(w: Workspace) -> DataFrame:
    """Per year, how many rows lie behind a later one, in the order of the files and their rows."""
    lake = w.incrementally_loaded()
    rows = lake.read(lake.names.silver).select(
        "year", "datetime", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")
    )
    before = Window.partitionBy("year").orderBy("file", "at")
    behind = F.coalesce(F.lag("datetime").over(before) > F.col("datetime"), F.lit(False))
    return rows.withColumn("behind", behind).groupBy("year").agg(
        F.count("*").alias("events"), F.count_if("behind").alias("out_of_order")
    )


@query
def years_of_empty_files(w: Workspace) -> DataFrame:
    """S3: the ledger after a load of all years and of two whose files hold nothing but a header."""
    return ledger.read_ledger(w.loaded_with_empty_files()).select("load_year", "row_count")


@query
def ledger_years(w: Workspace) -> DataFrame:
    """S9."""
    return ledger.read_ledger(w.incrementally_loaded()).select(
        "load_year", "row_count", "min_datetime", "max_datetime"
    )


@query
def ledger_summary(w: Workspace) -> DataFrame:
    return ledger.ledger_summary(ledger.read_ledger(w.incrementally_loaded())).drop("last_updated")


@query
def missing_years(w: Workspace) -> DataFrame:
    requested = ledger.requested_years(w.spark, start=2018, end=2026)
    return ledger.missing_years(requested, ledger.read_ledger(w.incrementally_loaded()))


@query
def year_gaps(w: Workspace) -> DataFrame:
    """W4 after two years have been cleared."""
    loaded = ledger.read_ledger(w.incrementally_loaded())
    return ledger.year_gaps(ledger.missing_from(loaded, [2021, 2022]))


@query
def ledger_validate(w: Workspace) -> DataFrame:
    """What is left of the ledger after two years have been taken out of bronze."""
    lake, held = w.with_lost_years()
    return ledger.backed_by_data(ledger.read_ledger(lake), held).select("load_year", "row_count")


@query
def ledger_lost_years(w: Workspace) -> DataFrame:
    """The years that the ledger claims and bronze doesn't hold."""
    lake, held = w.with_lost_years()
    return ledger.lost_years(ledger.read_ledger(lake), held).select("load_year", "row_count")


@query
def incremental_ingest(w: Workspace) -> DataFrame:
    return rounded(plain_stations(arrived_events(w.ingested())))


@query
def ingest_mixed_headers(w: Workspace) -> DataFrame:
    """ST1: files with three headers are read by them; one without any known column stops nothing."""
    return rounded(plain_stations(arrived_events(w.ingested_mixed())))


@query
def ingest_quarantine(w: Workspace) -> DataFrame:
    """ST1: the file that could not be read, with its reason."""
    return quarantined_files(w.ingested_mixed()).select("header", "reason", "batch")


@query
def stream_daily_activity(w: Workspace) -> DataFrame:
    return rounded(w.streamed_activity())
