"""S1, ST1: headers of any kind, and files judged one by one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tremora.sources.catalog_csv import header_cells, headers, read_by_header
from tremora.streaming.ingest import arrived_events, fault, ingest_new_files, quarantined_files

GOOD = "id,time,latitude,longitude,mag,place"


def put(path, *lines: str) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def bytes_read(spark) -> int:
    statistics = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(each.getBytesRead() for each in statistics)


def test_S1_headers_are_read_without_the_data(spark, tmp_path):
    line = "e1,2024-01-01T00:00:00.000Z,1,2,3," + "x" * 1000
    for n in range(3):
        put(tmp_path / f"{n}.csv", GOOD, *[line] * 30_000)
    before = bytes_read(spark)
    found = headers(spark, str(tmp_path))
    read = bytes_read(spark) - before
    assert list(found) == [GOOD] and len(found[GOOD]) == 3
    assert read < 0.01 * 3 * 30_000 * len(line)


def test_S1_names_in_other_letters_and_repeated_names(spark, tmp_path):
    put(tmp_path / "a.csv", "﻿ID,Time,LATITUDE,longitude,Mag,felt,Felt,,id_2", "e1,t,1,2,3,f,g,h,i")
    put(tmp_path / "b.csv", "ID,id,time,latitude,longitude,mag,event_id,load_year", "no,e2,t,1,2,4,other,1999")
    rows = read_by_header(spark, str(tmp_path)).collect()
    found = {r.id: {name.lower(): value for name, value in r.asDict().items()} for r in rows}
    assert set(found) == {"e1", "e2"}
    one, two = found["e1"], found["e2"]
    assert (one["latitude"], one["mag"], one["felt"], one["felt_2"], one["column"], one["id_2"]) == (1.0, 3.0, "f", "g", "h", "i")
    assert (two["mag"], two["id_2"], two["event_id_2"], two["load_year"]) == (4.0, "no", "other", "1999")
    assert header_cells('a,"b, c" , d') == ["a", "b, c", "d"]


@pytest.mark.parametrize(
    "header, why",
    [
        (GOOD, None),
        ("place,MAG,longitude,latitude,time,id,more", None),
        ("id,time,latitude,mag", "no column longitude"),
        ("a;b;c", "no column id, time, latitude, longitude, mag"),
        (None, "no header"),
        ("id,id,time,latitude,longitude,mag", "more than one column id"),
        ("ID,id,time,latitude,longitude,mag", None),
    ],
)
def test_ST1_what_makes_a_file_unreadable(header, why):
    assert fault(header) == why


@pytest.mark.parametrize("strict", [True, False])
def test_ST1_one_bad_file_stops_nothing(spark, lake, tmp_path, strict):
    raw, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    put(raw / "a.csv", GOOD, "e1,2024-01-01T00:00:00.000Z,1,2,3,here")
    put(raw / "b.csv", "what,is,this", "1,2,3")
    (raw / "c.csv").write_text("\n\n")
    (raw / "none.csv").write_text("")  # no rows, no fault
    assert ingest_new_files(lake, str(raw), checkpoint, strict=strict) == 1
    assert {r.event_id for r in arrived_events(lake).collect()} == {"e1"}
    bad = {r.file.rsplit("/", 1)[1]: (r.reason, r.header, r.bytes) for r in quarantined_files(lake).collect()}
    assert bad == {
        "b.csv": ("no column id, time, latitude, longitude, mag", "what,is,this", 19),
        "c.csv": ("no header", None, 2),
    }
    put(raw / "d.csv", "place,mag,felt,longitude,latitude,time,id", "there,5,x,2,1,2024-01-02T00:00:00.000Z,e1")
    put(raw / "e.csv", "id", "e3")
    assert ingest_new_files(lake, str(raw), checkpoint, strict=strict) == 1
    assert [(r.event_id, r.place) for r in arrived_events(lake).collect()] == [("e1", "there")]
    assert quarantined_files(lake).agg(F.count("*"), F.count_distinct("batch")).first() == (3, 2)
    assert ingest_new_files(lake, str(raw), checkpoint, strict=strict) == 0


def test_ST1_a_batch_of_bad_files_only(spark, lake, tmp_path):
    assert quarantined_files(lake).count() == 0
    put(tmp_path / "in/a.csv", "x", "1")
    assert ingest_new_files(lake, str(tmp_path / "in"), str(tmp_path / "checkpoint")) == 1
    assert arrived_events(lake).count() == 0 and quarantined_files(lake).count() == 1


def test_ST2_D3_a_batch_opens_the_years_of_its_events_and_changes_their_days(spark, lake, tmp_path, monkeypatch):
    from tremora.streaming import activity, upsert
    from tremora.streaming.activity import run_daily_activity

    raw, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    opened = []
    read = type(lake).read

    def drain():
        ingest_new_files(lake, str(raw), f"{checkpoint}/files")
        days = run_daily_activity(lake, "bronze_arrivals", f"{checkpoint}/days")
        return {str(r.date)[:10]: (r.daily_event_count, r.daily_max_magnitude, r.affected_regions) for r in days.collect()}

    def line(event, day, magnitude, place):
        return f"{event},{day}T00:00:00.000Z,1,2,{magnitude},5 km N of {place}"

    put(
        raw / "a.csv", GOOD, line("e1", "2019-01-01", 4, "Fiji"), line("e2", "2020-01-01", 5, "Fiji"), line("e3", "2020-01-01", 3, "Chile"),
        line("e4", "2020-06-01", 3, "Chile"), line("e5", "2021-01-01", 6, "Peru"),
    )
    want = {"2019-01-01": (1, 4, 1), "2020-01-01": (2, 5, 2), "2020-06-01": (1, 3, 1), "2021-01-01": (1, 6, 1)}
    assert drain() == want
    before = {table: lake.folders(table) for table in ("arrived_events", activity.COUNTED, activity.CELLS)}

    # The largest event of a day leaves it for another year, its region with it.
    put(raw / "b.csv", GOOD, line("e2", "2021-02-02", 5.5, "Tonga"), line("e6", "2020-06-01", 4, "Fiji"))
    counted = []
    cells_of = activity.cells_of

    def cells_seen(events):
        counted.append(sorted({str(r.datetime)[:10] for r in events.collect()}))
        return cells_of(events)

    with monkeypatch.context() as patched:
        patched.setattr(activity, "cells_of", cells_seen)
        found = drain()
    assert found == want | {"2020-01-01": (1, 3, 1), "2020-06-01": (2, 4, 2), "2021-02-02": (1, 5.5, 1)}
    assert counted == [["2020-06-01", "2021-02-02"], ["2020-01-01"]]  # added, and counted again
    for table, folders in before.items():
        after = lake.folders(table)
        assert after["2019"] == folders["2019"] and after["2020"] != folders["2020"] and after["2021"] != folders["2021"]

    # Rows that are there already change nothing; of an event of 2019, no other year is opened.
    kept = {table: lake.folders(table) for table in before}
    put(raw / "c.csv", GOOD, line("e1", "2019-01-01", 4, "Fiji"))
    monkeypatch.setattr(upsert, "_values", lambda rows, column: opened.append((column, values(rows, column))) or opened[-1][1])
    values = lambda rows, column: [r[0] for r in rows.select(column).distinct().collect()]
    assert drain() == found and {table: lake.folders(table) for table in before} == kept
    assert [found for column, found in opened if column == "year"][0] == [2019]
    assert all(len(found) <= 1 for _, found in opened)
    assert read is type(lake).read


def test_ST1_F10_the_index_has_a_file_per_bucket_and_a_batch_is_copied_once(spark, lake, tmp_path, monkeypatch):
    from pathlib import Path

    from tremora.streaming import ingest, upsert

    for n in range(6):
        put(tmp_path / f"in/{n}.csv", GOOD, *[f"e{n}-{at},2024-01-01T00:00:00.000Z,1,2,3,here" for at in range(600)])
    staged = []
    monkeypatch.setattr(ingest, "remove", lambda *_: staged.extend(p.name for p in (tmp_path / "checkpoint/staged/0").iterdir()))
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task per file
    try:
        ingest_new_files(lake, str(tmp_path / "in"), str(tmp_path / "checkpoint"))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert arrived_events(lake).count() == 3600
    files = [p for p in Path(lake.path(upsert.index_of("arrived_events"))).rglob("*.parquet")]
    assert len(files) == upsert.BUCKETS
    assert staged == ["changes"]  # the first batch's rows are written aside once


def test_ST1_a_batch_that_stops_before_its_index_is_made_good(spark, lake, tmp_path, monkeypatch):
    checkpoint = str(tmp_path / "checkpoint")
    put(tmp_path / "in/a.csv", GOOD, "e1,2020-01-01T00:00:00.000Z,1,2,3,here", "e2,2021-01-01T00:00:00.000Z,1,2,3,here")
    ingest_new_files(lake, str(tmp_path / "in"), checkpoint)
    put(tmp_path / "in/b.csv", GOOD, "e1,2022-01-01T00:00:00.000Z,1,2,4,there", "e2,2019-01-01T00:00:00.000Z,1,2,9,old")

    def stops(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patched:
        patched.setattr("tremora.streaming.upsert.gathered", stops)
        with pytest.raises(Exception, match="stopped"):
            ingest_new_files(lake, str(tmp_path / "in"), checkpoint)
    want = [("e1", 2022, 4.0), ("e2", 2021, 3.0)]
    for _ in range(2):
        ingest_new_files(lake, str(tmp_path / "in"), checkpoint)
        found = arrived_events(lake).select("event_id", "year", "magnitude")
        assert sorted(map(tuple, found.collect())) == want
        assert sorted(map(tuple, lake.read("arrived_events_ids").select("event_id", "year").collect())) == [w[:2] for w in want]
