"""L2-L6, S5-S9, J7, J8, W4, A32 and the streams."""

from __future__ import annotations

import datetime as dt
import shutil

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tremora.checks.workspace import Workspace
from tremora.operators.conform import to_merged_events

from tremora.operators import conform
from tremora.plans import ledger, loads
from tremora.plans.star import Star
from tremora.sources.catalog_csv import RAW_SCHEMA, read_by_header
from tremora.sources.lake import Lake
from tremora.streaming import upsert
from tremora.streaming.activity import run_daily_activity
from tremora.streaming.ingest import arrived_events, ingest_new_files


@pytest.fixture(scope="module")
def files(workspace: Workspace) -> str:
    return workspace.raw_files()


def years(spark, *listed):
    return ledger.requested_years(spark, list(listed))


def year_list(frame):
    return sorted(r.load_year for r in frame.collect())


def test_L4_requested_years(spark):
    assert year_list(ledger.requested_years(spark, [2012, 2010, 2012])) == [2010, 2012]
    assert year_list(ledger.requested_years(spark, start=2010, end=2012)) == [2010, 2011, 2012]
    assert year_list(ledger.requested_years(spark)) == [dt.date.today().year]


def ledger_of(spark, *loaded):
    rows = [(year * 10, 1, None, None, None, year) for year in loaded]
    return spark.createDataFrame(rows, ledger.LEDGER_SCHEMA)


def test_J7_W4_A32_missing_years_gaps_and_summary(spark):
    loaded = ledger_of(spark, 2010, 2012)
    wanted = ledger.requested_years(spark, start=2010, end=2014)
    assert [r.load_year for r in ledger.missing_years(wanted, loaded).collect()] == [2011, 2013, 2014]
    gaps = ledger.year_gaps(ledger_of(spark, 2010, 2011, 2014, 2016)).collect()
    assert sorted(tuple(r) for r in gaps) == [(2012, 2013), (2015, 2015)]
    found = ledger.ledger_summary(loaded).first()
    assert tuple(found)[:4] == (2, 2010, 2012, 40220)
    assert tuple(ledger.ledger_summary(ledger_of(spark)).first())[:4] == (0, None, None, 0)


def test_L3_loads_only_what_is_missing(spark, lake, files):
    first = loads.incremental_load(lake, files, years(spark, 2021, 2022))
    assert first.years == [2021, 2022] and first.star["fact_earthquakes"] == first.silver_rows
    stamps = {r.load_year: r.loaded_at for r in ledger.read_ledger(lake).collect()}

    second = loads.incremental_load(lake, files, years(spark, 2021, 2022, 2023, 2030))
    assert second.years == [2023]
    after = {r.load_year: r.loaded_at for r in ledger.read_ledger(lake).collect()}
    assert set(after) == {2021, 2022, 2023}
    assert all(after[year] == stamps[year] for year in stamps)

    third = loads.incremental_load(lake, files, years(spark, 2021, 2022, 2023))
    assert third == loads.LoadReport()


def test_L3_the_order_of_years_does_not_matter(spark, tmp_path, files, workspace):
    one, other = (Lake(spark, str(tmp_path / name)) for name in ("one", "other"))
    for batch in ([2024], [2022], [2021, 2023]):
        loads.incremental_load(one, files, years(spark, *batch))
    loads.incremental_load(other, files, ledger.requested_years(spark, start=2020, end=2024))
    for table in (one.names.silver, *one.names.star):
        assert rows_of(one.read(table)) == rows_of(other.read(table))
    assert rows_of(one.read(one.names.silver)) == rows_of(workspace.silver())


def test_S3_years_without_rows_are_not_recorded(spark, lake, tmp_path):
    folder = tmp_path / "raw" / "load_year=2020"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text(",".join(RAW_SCHEMA.names) + "\n")
    report = loads.incremental_load(lake, str(tmp_path / "raw"), years(spark, 2020))
    assert report == loads.LoadReport()
    assert ledger.read_ledger(lake).count() == 0


def test_S9_details_of_a_year(spark, lake, files):
    loads.incremental_load(lake, files, years(spark, 2023))
    row = ledger.read_ledger(lake).first()
    events = lake.read(lake.names.bronze)
    assert row.row_count == events.count() > 0
    sizes = events.select("source_file", "source_bytes").distinct().agg(F.sum("source_bytes")).first()[0]
    assert row.file_size_bytes == sizes > 0
    assert row.min_datetime.year == row.max_datetime.year == 2023


def test_L6_cleared_years_are_loaded_again(spark, lake, files):
    loads.incremental_load(lake, files, years(spark, 2021, 2022))
    before = rows_of(lake.read(lake.names.silver))
    ledger.clear_years(lake, [2022])
    assert year_list(ledger.read_ledger(lake)) == [2021]
    assert loads.incremental_load(lake, files, years(spark, 2021, 2022)).years == [2022]
    assert rows_of(lake.read(lake.names.silver)) == before
    ledger.reset_ledger(lake)
    assert ledger.read_ledger(lake).count() == 0
    assert loads.incremental_load(lake, files, years(spark, 2021, 2022)).years == [2021, 2022]


def test_J8_years_whose_data_is_gone_leave_the_ledger(spark, lake, files, tmp_path):
    loads.incremental_load(lake, files, years(spark, 2021, 2022))
    shutil.move(lake.path("bronze/load_year=2022"), tmp_path / "away")
    report = loads.incremental_load(lake, files, years(spark, 2021))
    assert report.lost_years == [2022]
    assert year_list(ledger.read_ledger(lake)) == [2021]
    assert lake.read(lake.names.silver).agg(F.max("year")).first()[0] == 2021


def test_L5_a_missing_layer_is_rebuilt(spark, lake, files, tmp_path):
    loads.incremental_load(lake, files, years(spark, 2021))
    shutil.move(lake.path(lake.names.silver), tmp_path / "silver")
    report = loads.incremental_load(lake, files, years(spark, 2021))
    assert report.years == [] and report.silver_rows == report.star["fact_earthquakes"]
    shutil.move(lake.path(lake.names.cube_depth_analysis), tmp_path / "cube")
    report = loads.incremental_load(lake, files, years(spark, 2021))
    assert report.silver_rows is None and report.cubes["cube_depth_analysis"] > 0


def test_S6_a_stray_event_does_not_touch_another_year(spark, lake, tmp_path, workspace):
    raw = workspace.raw().where("time LIKE '2021%' OR time LIKE '2022%'")
    stray = raw.withColumn("load_year", F.when(F.col("id") == "ev800", 2022).otherwise(F.substring("time", 1, 4).cast("int")))
    path = str(tmp_path / "raw")
    stray.write.partitionBy("load_year").option("header", True).csv(path)
    loads.incremental_load(lake, path, years(spark, 2021))
    loads.incremental_load(lake, path, years(spark, 2021, 2022))
    assert rows_of(lake.read(lake.names.silver)) == rows_of(to_merged_events(raw))


def test_L2_full_load_builds_every_table(spark, lake, files):
    report = loads.full_load(lake, f"{files}/*")
    assert report.silver_rows == 980 and report.star["fact_earthquakes"] == 980
    assert set(report.cubes) == set(lake.names.cubes)
    exported = spark.read.parquet(lake.path("processed/raw_earthquakes.parquet"))
    assert rows_of(exported) == rows_of(lake.read(lake.names.silver))
    assert Star.of(lake).fact.columns[0] == "earthquake_id"


def test_S7_tables_are_visible_to_sql(spark, lake):
    lake.replace("visible", spark.range(3))
    lake.expose("visible")
    assert spark.sql("SELECT count(*) AS n FROM visible").first().n == 3


def test_S4_S6_writes_count_their_rows(spark, lake):
    rows = spark.range(10).select("id", (F.col("id") % 2).alias("part"))
    assert lake.replace("t", rows, ["part"]) == 10
    assert lake.replace_partitions("t", rows.where("part = 1 AND id > 4"), "part") == 3
    assert lake.read("t").count() == 8


def test_ST1_new_files_only_and_revisions_across_batches(spark, lake, tmp_path, files, workspace):
    raw_path, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    raw_path.mkdir()
    for year in (2022, 2021):
        shutil.copytree(f"{files}/load_year={year}", raw_path / f"y{year}")
    assert ingest_new_files(lake, f"{raw_path}/*", checkpoint) == 1
    assert ingest_new_files(lake, f"{raw_path}/*", checkpoint) == 0
    for year in (2023, 2024):
        shutil.copytree(f"{files}/load_year={year}", raw_path / f"y{year}")
    assert ingest_new_files(lake, f"{raw_path}/*", checkpoint) == 1
    assert ingest_new_files(lake, f"{raw_path}/*", checkpoint) == 0
    assert rows_of(arrived_events(lake)) == rows_of(workspace.silver())


def test_ST2_drained_stream_equals_the_cube_in_any_zone(spark, lake, tmp_path, workspace):
    cube = workspace.cube("temporal_trends").select("date", "daily_event_count", "daily_max_magnitude")
    lake.replace("events", workspace.silver())
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            found = run_daily_activity(lake, "events", str(tmp_path / zone.replace("/", "-")))
            assert rows_of(found.select(*cube.columns)) == rows_of(cube)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_L3_a_load_that_stops_before_the_star_is_made_good(spark, lake, files, monkeypatch):
    loads.incremental_load(lake, files, years(spark, 2021))

    def stops(_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patched:
        patched.setattr(loads, "build_star", stops)
        with pytest.raises(RuntimeError, match="stopped"):
            loads.incremental_load(lake, files, years(spark, 2021, 2022))
    loads.incremental_load(lake, files, years(spark, 2021, 2022))
    names = lake.names
    events = lake.read(names.silver).count()
    assert lake.read(names.fact).count() == events
    assert lake.read(names.cube_time_magnitude).agg(F.sum("event_count")).first()[0] == events


def test_S9_a_cleared_year_without_files_stays_away(spark, lake, files, tmp_path):
    raw = tmp_path / "raw"
    shutil.copytree(files, raw)
    loads.incremental_load(lake, str(raw), years(spark, 2021, 2022))
    ledger.clear_years(lake, [2021])
    shutil.rmtree(raw / "load_year=2021")
    loads.incremental_load(lake, str(raw), years(spark, 2021, 2022))
    assert year_list(ledger.read_ledger(lake)) == [2022]


def test_L6_does_not_depend_on_the_overwrite_mode(spark, lake, files):
    loads.incremental_load(lake, files, years(spark, 2021, 2022))
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        ledger.clear_years(lake, [2022])
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert year_list(ledger.read_ledger(lake)) == [2021]


def test_S1_quotes_and_a_foreign_header(spark, tmp_path):
    from tremora.sources.catalog_csv import RAW_COLUMNS, read_catalog

    header = ",".join(name for name, _, _ in RAW_COLUMNS)
    place = '"5 km S of ""Big"" Town, Fiji"'
    cells = {"time": "2024-01-01T00:00:00.000Z", "latitude": "10", "id": "x1", "place": place, "type": "earthquake"}
    line = ",".join(cells.get(name, "") for name, _, _ in RAW_COLUMNS)
    (tmp_path / "a.csv").write_text(f"{header}\n{line}\n")
    row = read_catalog(spark, str(tmp_path / "a.csv")).first()
    assert row.place == '5 km S of "Big" Town, Fiji' and row.type == "earthquake"
    swapped = header.replace("latitude,longitude", "longitude,latitude")
    (tmp_path / "b.csv").write_text(f"{swapped}\n{line}\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_catalog(spark, str(tmp_path / "b.csv")).collect()


def test_ST1_before_the_first_batch(lake):
    assert arrived_events(lake).count() == 0


def catalogue(path, header: str, *lines: str) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


def test_S1_P1_columns_go_by_the_header_of_each_file(spark, tmp_path):
    catalogue(tmp_path / "a b+c.csv", "id,time,longitude,latitude,mag,nst", "x1,2024-01-01T00:00:00.000Z,20,10,5,12.0")
    catalogue(tmp_path / "b.csv", "mag,id,place,felt,latitude", 'bad,x2,"a ""b"", c",7,1.5')
    catalogue(tmp_path / "c.csv", "mag,id,place,felt,latitude", "4,x3,,8,2")
    (tmp_path / "none.csv").write_text("")
    found = {r.id: r for r in read_by_header(spark, str(tmp_path)).collect()}
    assert set(found) == {"x1", "x2", "x3"}
    assert (found["x1"].latitude, found["x1"].longitude, found["x1"].nst, found["x1"].felt) == (10.0, 20.0, 12, None)
    assert (found["x2"].mag, found["x2"].place, found["x2"].felt) == (None, 'a "b", c', "7")
    assert (found["x3"].mag, found["x3"].latitude, found["x3"].time) == (4.0, 2.0, None)
    assert read_by_header(spark, str(tmp_path / "none.csv")).count() == 0


def test_E1_P7_a_lenient_load_keeps_what_it_refused(spark, lake, tmp_path):
    header = "id,time,latitude,longitude,mag"
    for year in (2021, 2022):
        catalogue(
            tmp_path / f"raw/load_year={year}/a.csv", header,
            f"a{year},{year}-01-01T00:00:00.000Z,1,2,3", f"b{year},soon,1,2,3", f"c{year},{year}-01-02T00:00:00.000Z,99,2,3",
        )
    report = loads.incremental_load(lake, str(tmp_path / "raw"), years(spark, 2021, 2022), strict=False)
    assert report.years == [2021, 2022] and report.silver_rows == 2
    refused = lake.read(lake.names.refused).select("event_id", "failed_rule", "load_year")
    assert rows_of(refused) == sorted(
        (name + str(year), rule, year)
        for year in (2021, 2022)
        for name, rule in (("b", "time_readable"), ("c", "coordinates_on_globe"))
    )
    full = loads.full_load(lake, str(tmp_path / "raw/*"), strict=False)
    assert full.silver_rows == 2 and lake.read(lake.names.refused).count() == 4


def quake(event: str, time: str, magnitude: float) -> str:
    return f"{time}Z,1,2,10,{magnitude},,,,,,,{event},{time}Z,here,earthquake,,,,,,,"


def test_ST1_ST2_a_revision_leaves_its_old_day_and_year(spark, lake, tmp_path, monkeypatch):
    header, raw = ",".join(RAW_SCHEMA.names), tmp_path / "in"
    checkpoint = str(tmp_path / "checkpoint")

    def drain():
        ingest_new_files(lake, str(raw), f"{checkpoint}/files")
        days = run_daily_activity(lake, "bronze_arrivals", f"{checkpoint}/days")
        return {(str(r.date)[:10], r.daily_event_count, r.daily_max_magnitude) for r in days.collect()}

    catalogue(
        raw / "a.csv", header, quake("e1", "2021-12-31T23:59:59.000", 4), quake("e2", "2021-05-01T00:00:00.000", 5),
        quake("e3", "2019-05-01T00:00:00.000", 5),
    )
    assert drain() == {("2021-12-31", 1, 4.0), ("2021-05-01", 1, 5.0), ("2019-05-01", 1, 5.0)}
    kept = sorted(str(p) for p in (tmp_path / "lake/arrived_events/year=2019").iterdir())
    catalogue(raw / "b.csv", header, quake("e1", "2022-01-01T00:00:01.000", 4.5), quake("e2", "2021-05-01T00:00:09.000", 6))

    def stops(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patched:  # between the merged rows and the table
        patched.setattr(upsert, "replace_years", stops)
        with pytest.raises(Exception, match="stopped"):
            drain()
    want = {("2022-01-01", 1, 4.5), ("2021-05-01", 1, 6.0), ("2019-05-01", 1, 5.0)}
    assert drain() == want == drain()
    assert sorted(str(p) for p in (tmp_path / "lake/arrived_events/year=2019").iterdir()) == kept
    assert arrived_events(lake).count() == 3


def test_T9_events_are_laid_out_before_the_rest_is_derived(spark, workspace):
    """What lies below the range partitioning is run twice and shuffled; the writer need not sort again."""
    laid_out = loads.events_by_time(conform.to_timed(workspace.raw()))
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = laid_out._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    above, below = plan.split("RepartitionByExpression", 1)
    assert "moon_phase" in above and "moon_phase" not in below
    assert laid_out.columns == conform.to_events(workspace.raw()).columns
    order = laid_out._jdf.queryExecution().optimizedPlan().outputOrdering().apply(0).toString()
    assert order.startswith("year#")
