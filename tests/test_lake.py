"""Tables that switch at once, rebuilds by content, merges of touched years only."""

from __future__ import annotations

import time

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tremora.operators.conform import to_merged_events
from tremora.operators.contents import content, contents
from tremora.plans import cubes, ledger, loads
from tremora.plans.star import event_view
from tremora.sources import lake as lakes
from tremora.sources.lake import Lake

HEADER = "id,time,latitude,longitude,mag,place"


def quake(event: str, time: str, magnitude: float = 4, place: str = "here") -> str:
    return f"{event},{time}T00:00:00.000Z,1,2,{magnitude},{place}"


def files(root, year: int, *lines: str) -> None:
    folder = root / f"load_year={year}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "a.csv").write_text("\n".join([HEADER, *lines]) + "\n")


def load(lake, root, *years):
    return loads.incremental_load(lake, str(root), ledger.requested_years(lake.spark, list(years)))


def files_of(lake, table):
    """Names and times of the files that make up each partition."""
    return {
        value: sorted((p.name, p.stat().st_mtime_ns) for p in (path_of(lake, table) / folder).iterdir())
        for value, folder in lake.folders(table).items()
    }


def path_of(lake, table):
    from pathlib import Path

    return Path(lake.path(table))


def places(lake):
    return {(r.event_id, r.place) for r in lake.read(lake.names.silver).collect()}


def test_contents_tell_multisets_apart(spark):
    def of(*rows):
        return spark.createDataFrame(rows, "k int, a string, b string").agg(content(["a", "b"])).first()[0]

    one, other = (1, "x", None), (1, None, "x")
    assert of(one, other) == of(other, one)
    assert len({of(one), of(other), of(one, one), of(one, one, one), of(one, other), of((1, "x", "x"))}) == 6
    rows = spark.createDataFrame([one, other, (2, "x", None)], "k int, a string, b string")
    found = {r.k: r.content for r in contents(rows, "k", ["a", "b"]).collect()}
    assert found == {1: of(one, other), 2: of(one)}
    assert contents(rows.where("k > 2"), "k", ["a"]).count() == 0


def test_S4_readers_keep_the_table_they_have_planned(spark, lake):
    lake.replace("t", spark.range(5))
    before = lake.read("t")
    lake.replace("t", spark.range(7))
    assert (before.count(), lake.read("t").count()) == (5, 7)
    lake.replace("t", spark.range(0))
    assert lake.exists("t") and lake.read("t").count() == 0 and lake.read("t").columns == ["id"]


def test_S4_old_folders_go_when_they_are_old_enough(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"), retention=0.0)
    for n in (3, 4, 5):
        lake.replace("t", spark.range(n))
        lake.replace("p", spark.range(n).withColumn("part", F.col("id") % 2), ["part"])
    assert lake.read("t").count() == lake.read("p").count() == 5
    assert len([p for p in path_of(lake, "t").iterdir() if p.is_dir()]) == 1
    assert all(len([p for p in part.iterdir() if p.is_dir()]) == 1 for part in path_of(lake, "p").glob("part=*"))
    for _ in range(2 * lakes.KEPT_MANIFESTS):
        lake.commit()
    assert len(list(path_of(lake, lakes.MANIFESTS).glob("*.json"))) == lakes.KEPT_MANIFESTS


def test_S6_partitions_without_rows_go_and_others_stay(spark, lake):
    rows = spark.range(10).withColumn("part", F.col("id") % 3)
    lake.replace("p", rows, ["part"])
    kept = files_of(lake, "p")["2"]
    assert lake.replace_partitions("p", rows.where("part = 0 AND id > 0"), "part", [0, 1]) == 3
    assert {(r.id, r.part) for r in lake.read("p").collect()} == {(3, 0), (6, 0), (9, 0), (2, 2), (5, 2), (8, 2)}
    assert files_of(lake, "p")["2"] == kept
    lake.drop_partitions("p", [0, 2, 9])
    assert lake.read("p").count() == 0 and lake.exists("p")


def test_S4_two_loaders_cannot_both_commit(spark, lake, monkeypatch):
    lake.replace("t", spark.range(5))
    change, number = lake.write("t", spark.range(6)), lake._manifest()
    lake.replace("t", spark.range(7))
    monkeypatch.setattr(Lake, "_manifest", lambda self: number)
    with pytest.raises(FileExistsError):
        lake.commit(change)
    monkeypatch.undo()
    assert lake.read("t").count() == 7


def test_S4_every_table_is_old_or_new_wherever_a_load_stops(spark, lake, tmp_path, monkeypatch):
    names = lake.names
    tables = (names.silver, *names.star, *names.cubes, names.ledger)
    files(tmp_path, 2020, quake("a", "2020-01-01"), quake("b", "2020-03-01"))
    load(lake, tmp_path, 2020)
    old = {table: rows_of(lake.read(table).drop("loaded_at")) for table in tables}
    files(tmp_path, 2021, quake("a", "2021-01-01", 5), quake("c", "2021-02-01"))
    twin = Lake(spark, str(tmp_path / "twin"))
    load(twin, tmp_path, 2020, 2021)
    new = {table: rows_of(twin.read(table).drop("loaded_at")) for table in tables}

    step = Lake.commit
    for stop_at in (2, 4):  # of bronze with the ledger, silver with its ids, star, states, cubes
        calls = []

        def stops(self, *args, _calls=calls, _at=stop_at):
            step(self, *args)
            _calls.append(1)
            if len(_calls) == _at:
                raise RuntimeError("stopped")

        part = Lake(spark, str(tmp_path / f"part-{stop_at}"))
        load(part, tmp_path, 2020)
        with monkeypatch.context() as patched, pytest.raises(RuntimeError, match="stopped"):
            patched.setattr(Lake, "commit", stops)
            load(part, tmp_path, 2020, 2021)
        found = {table: rows_of(part.read(table).drop("loaded_at")) for table in tables}
        assert all(found[table] in (old[table], new[table]) for table in tables)
        for group in (names.star, names.cubes):  # one star, one set of cubes
            assert all(found[t] == old[t] for t in group) or all(found[t] == new[t] for t in group)
        load(part, tmp_path, 2020, 2021)
        assert {table: rows_of(part.read(table).drop("loaded_at")) for table in tables} == new


def test_S4_a_write_that_stops_changes_nothing(spark, lake, monkeypatch):
    lake.replace("t", spark.range(5))
    lake.replace("p", spark.range(4).withColumn("part", F.col("id") % 2), ["part"])
    failing = spark.range(9).withColumn("part", F.raise_error(F.lit("stopped")).cast("long"))
    for write in (lambda: lake.replace("t", failing), lambda: lake.replace("p", failing, ["part"])):
        with pytest.raises(Exception, match="stopped"):
            write()
    monkeypatch.setattr(lakes, "move", lambda *_: failing.collect())  # between the folders of a partitioned table
    with pytest.raises(Exception, match="stopped"):
        lake.replace_partitions("p", spark.range(9).withColumn("part", F.col("id") % 3), "part")
    assert (lake.read("t").count(), lake.read("p").count()) == (5, 4)


def test_L5_L6_a_reload_with_as_many_rows_that_stops_is_made_good(lake, tmp_path):
    files(tmp_path, 2021, quake("a", "2021-01-01"), quake("b", "2021-03-01"))
    files(tmp_path, 2022, quake("c", "2022-01-01"))
    load(lake, tmp_path, 2021, 2022)
    ledger.clear_years(lake, [2021])
    files(tmp_path, 2021, quake("a", "2021-01-01", place="there"), quake("b", "2021-03-01", place="there"))
    loads.load_years(lake, str(tmp_path), [2021])  # and here it stopped
    report = load(lake, tmp_path, 2021, 2022)
    assert report.years == [] and report.silver_rows == 3 and report.cubes
    assert places(lake) == {("a", "there"), ("b", "there"), ("c", "here")}
    assert load(lake, tmp_path, 2021, 2022) == loads.LoadReport()


def test_L6_the_same_rows_again_are_no_reason_to_merge(lake, tmp_path):
    files(tmp_path, 2021, quake("a", "2021-01-01"), quake("b", "2021-03-01"))
    load(lake, tmp_path, 2021)
    before = lake.folders(lake.names.silver)
    ledger.clear_years(lake, [2021])
    files(tmp_path, 2021, quake("b", "2021-03-01"), quake("a", "2021-01-01"))
    assert load(lake, tmp_path, 2021) == loads.LoadReport([2021])
    assert lake.folders(lake.names.silver) == before


def test_L3_D3_only_touched_years_are_written(lake, tmp_path):
    files(tmp_path, 2019, quake("x", "2019-06-01"), quake("y", "2018-06-01"))
    files(tmp_path, 2020, quake("a", "2020-01-01"), quake("b", "2020-03-01"))
    files(tmp_path, 2021, quake("c", "2021-01-01"))
    load(lake, tmp_path, 2019, 2020, 2021)
    first = files_of(lake, lake.names.silver)
    assert set(first) == {"2018", "2019", "2020", "2021"}
    time.sleep(0.01)
    # b moves to 2022, z stands between; 2018, 2019 and 2021 hold none of these events.
    files(tmp_path, 2022, quake("b", "2022-01-01", 5), quake("z", "2022-05-01"))
    load(lake, tmp_path, 2022)
    second = files_of(lake, lake.names.silver)
    assert all(first[year] == second[year] for year in ("2018", "2019", "2021"))
    assert first["2020"] != second["2020"] and set(second) == set(first) | {"2022"}
    state = f"state_{lake.names.cube_depth_analysis}"
    states = files_of(lake, state)
    # Without 2022, b is back where it was, and the year is gone.
    ledger.clear_years(lake, [2022])
    files(tmp_path, 2022, quake("c", "2021-01-02", 6))
    load(lake, tmp_path, 2019, 2020, 2021, 2022)
    third = files_of(lake, lake.names.silver)
    assert set(third) == set(first) and third["2018"] == first["2018"]
    kept = files_of(lake, state)
    assert kept["2018"] == states["2018"] and kept["2019"] == states["2019"] and "2022" not in kept
    found = {r.event_id: (r.year, r.magnitude) for r in lake.read(lake.names.silver).collect()}
    assert found == {"x": (2019, 4), "y": (2018, 4), "a": (2020, 4), "b": (2020, 4), "c": (2021, 6)}


def test_L3_lost_and_cleared_years_leave_what_they_gave(lake, tmp_path):
    files(tmp_path, 2020, quake("a", "2020-01-01"), quake("b", "2020-03-01"))
    files(tmp_path, 2021, quake("a", "2021-01-01"), quake("n", "2021-02-01"))
    load(lake, tmp_path, 2020, 2021)
    assert {r.event_id: r.year for r in lake.read(lake.names.silver).collect()} == {"a": 2021, "b": 2020, "n": 2021}
    lake.drop_partitions(lake.names.bronze, [2021])
    assert load(lake, tmp_path, 2020).lost_years == [2021]
    assert {r.event_id: r.year for r in lake.read(lake.names.silver).collect()} == {"a": 2020, "b": 2020}
    assert lake.read(lake.names.fact).count() == 2


def test_L8_states_give_the_cubes_of_a_full_build(spark, lake, tmp_path, workspace):
    raw = workspace.raw()
    late = (F.pmod(F.xxhash64("id"), F.lit(4)) == 0) | (F.col("status") == "reviewed")
    year = F.substring("time", 1, 4).cast("int")
    loads.yearly_files(raw, str(tmp_path / "raw"), F.when(late, 2100 + F.pmod(F.xxhash64("time"), F.lit(2))).otherwise(year))
    for some in (range(2018, 2023), range(2023, 2027), [2100], [2101]):
        load(lake, tmp_path / "raw", *some)
    silver = to_merged_events(raw)
    events = event_view(silver)
    makers = (cubes.time_magnitude, cubes.location_magnitude, cubes.depth_analysis, cubes.temporal_trends, cubes.moon_phase)
    for table, make in zip(lake.names.cubes, makers):
        def shown(frame):
            frame = frame.select(*make(events).columns)
            doubles = {n for n, kind in frame.dtypes if kind == "double"}
            return rows_of(frame.select(*[F.format_string("%.9e", F.col(n) + 1e-12).alias(n) if n in doubles else n for n in frame.columns]))

        assert shown(cubes.read_cube(lake, table)) == shown(make(events))
    assert rows_of(lake.read(lake.names.silver)) == rows_of(silver)


def test_T9_silver_lies_in_the_order_of_time(lake, tmp_path):
    days = [f"2020-{m:02}-{d:02}" for m in range(1, 13) for d in (3, 9, 27)]
    files(tmp_path, 2020, *[quake(f"e{i}", day) for i, day in enumerate(reversed(days))])
    load(lake, tmp_path, 2020)
    spans = lake.read(lake.names.silver).groupBy(F.input_file_name().alias("file")).agg(F.min("datetime"), F.max("datetime"))
    spans = sorted((low, high) for _, low, high in spans.collect())
    assert all(one[1] < other[0] for one, other in zip(spans, spans[1:]))


def test_L3_a_load_keeps_up_what_it_is_asked_for(spark, lake, tmp_path):
    def asked(year, **layers):
        return loads.incremental_load(lake, str(tmp_path), ledger.requested_years(spark, [year]), **layers)

    files(tmp_path, 2021, quake("a", "2021-05-01"))
    files(tmp_path, 2022, quake("b", "2022-05-01"))
    merged = asked(2021, star=False, cubes=False)
    assert merged.silver_rows == 1 and not merged.star and not merged.cubes
    assert asked(2021, star=False, cubes=False) == loads.LoadReport()
    with_star = asked(2022, cubes=False)
    assert with_star.star["fact_earthquakes"] == 2 and not with_star.cubes
    assert asked(2022, cubes=False) == loads.LoadReport()
    cubes_only = asked(2022, star=False)
    assert not cubes_only.star and cubes_only.cubes["cube_temporal_trends"] == 2
    assert asked(2022) == loads.LoadReport()  # all made of the same merged table
    files(tmp_path, 2023, quake("c", "2023-05-01"))
    asked(2023, star=False, cubes=False)
    everything = asked(2023)
    assert everything.silver_rows is None and everything.star["fact_earthquakes"] == 3
    assert lake.read(lake.names.cube_time_magnitude).agg(F.sum("event_count")).first()[0] == 3


def test_F9_F16_F20_lakes_hold_the_layers_that_are_read(workspace):
    for lake in (workspace.incrementally_loaded(), workspace.loaded_in_parts(), workspace.reloaded()):
        assert lake.exists(lake.names.silver)
        assert not any(map(lake.exists, lake.names.star + lake.names.cubes))
    lake = workspace.loaded_in_parts(cubes=True)
    assert not any(map(lake.exists, lake.names.star)) and all(map(lake.exists, lake.names.cubes))
    for table in ("silver_ids", *[f"state_{cube}" for cube in lake.names.cubes]):
        assert all(len([n for n, _ in found if n.endswith(".parquet")]) == 1 for found in files_of(lake, table).values())
