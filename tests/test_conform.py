"""P1-P7, D2-D4, A28-A30."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tremora.operators import conform, dedup, profile
from tremora.sources.catalog_csv import (
    RAW_SCHEMA,
    EmptyCatalog,
    preview,
    read_catalog,
    require_rows,
)

GOOD = {
    "time": "2024-01-31T23:59:59.123Z", "latitude": 1.0, "longitude": 2.0, "depth": 10.0, "mag": 5.0,
    "magType": "mb", "nst": 7, "id": "a", "updated": "2024-02-01T00:00:00.000Z", "place": "3 km N of X",
    "type": "earthquake", "status": "automatic",
}


def raw(spark, *changes):
    rows = [{**GOOD, **change} for change in changes]
    return spark.createDataFrame(
        [tuple(row.get(name) for name in RAW_SCHEMA.names) for row in rows], RAW_SCHEMA
    )


def test_P1_absent_and_foreign_columns_are_left_alone(spark):
    rows = spark.createDataFrame([(1.0, "x")], "mag double, other string")
    assert conform.conform_names(rows).columns == ["magnitude", "other"]
    assert conform.clean(rows).columns == ["magnitude", "other"]


def test_P2_P3_critical_fields_and_defaults(spark):
    found = conform.clean(
        raw(spark, {"id": "ok"}, {"time": None}, {"latitude": None}, {"longitude": None},
            {"mag": None}, {"id": "filled", "depth": None, "place": None})
    )
    assert {(r.event_id, r.depth, r.place) for r in found.collect()} == {
        ("ok", 10.0, "3 km N of X"),
        ("filled", 0.0, "Unknown"),
    }


@pytest.mark.parametrize(
    ("column", "kept", "dropped"),
    [
        ("mag", [-2.0, 10.0], [-2.01, 10.01]),
        ("depth", [-10.0, 1000.0], [-10.1, 1000.1]),
        ("latitude", [-90.0, 90.0], [-90.1, 90.1]),
        ("longitude", [-180.0, 180.0], [-180.1, 180.1]),
    ],
)
def test_P4_to_P6_limits_are_inclusive(spark, column, kept, dropped):
    rows = raw(spark, *[{column: value} for value in kept + dropped])
    name = {"mag": "magnitude"}.get(column, column)
    assert sorted(r[name] for r in conform.clean(rows).collect()) == sorted(kept)


def test_P3_a_depth_that_is_no_number_is_not_filled(spark):
    assert conform.clean(raw(spark, {"depth": float("nan")}, {"depth": None})).count() == 1


def test_P7_every_lost_row_is_counted_once(spark):
    rows = raw(
        spark, {}, {"time": None, "mag": 99.0}, {"mag": None}, {"mag": 99.0, "depth": 2000.0},
        {"depth": 2000.0}, {"latitude": 95.0}, {"depth": None},
    )
    found = conform.removed_rows(rows).first().asDict()
    assert found == {
        "rows_in": 7, "rows_out": 2, "rows_removed": 5, "lost_time_present": 1,
        "lost_latitude_present": 0, "lost_longitude_present": 0, "lost_magnitude_present": 1,
        "lost_magnitude_in_range": 1, "lost_depth_in_range": 1, "lost_coordinates_on_globe": 1,
    }
    assert conform.clean(rows).count() == found["rows_out"]
    assert conform.rejects(rows).count() == found["rows_removed"]


def test_L1_unreadable_times_fail_or_are_set_aside(spark):
    rows = raw(spark, {"id": "good"}, {"id": "bad", "time": "yesterday"})
    with pytest.raises(Exception, match="not a catalogue time: yesterday"):
        conform.to_events(rows).collect()
    assert [r.event_id for r in conform.to_events(rows, strict=False).collect()] == ["good"]
    assert [r.event_id for r in conform.unreadable_times(rows).collect()] == ["bad"]


def test_D2_the_first_row_in_the_files_wins(spark, tmp_path):
    header = ",".join(RAW_SCHEMA.names)

    def line(key, place):
        return ",".join(
            {"id": key, "place": place, "time": "2024-01-01T00:00:00.000Z"}.get(name, "")
            for name in RAW_SCHEMA.names
        )

    (tmp_path / "a.csv").write_text("\n".join([header, line("x", "zz"), line("x", "aa"), line("y", "q")]))
    (tmp_path / "b.csv").write_text("\n".join([header, line("y", "a"), line("z", "only")]))
    (tmp_path / "c.csv").write_text(header + "\n")
    paths = [str(tmp_path / name) for name in ("a.csv", "b.csv", "c.csv")]
    found = dedup.keep_first(read_catalog(spark, paths, with_position=True))
    assert found.columns == RAW_SCHEMA.names
    assert {r.id: r.place for r in found.collect()} == {"x": "zz", "y": "q", "z": "only"}


def test_S1_S3_bad_cells_empty_files_and_missing_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(RAW_SCHEMA.names) + "\n2024-01-01T00:00:00.000Z,north,2.5" + "," * 19)
    row = read_catalog(spark, str(tmp_path / "a.csv")).first()
    assert (row.latitude, row.longitude, row.id) == (None, 2.5, None)
    (tmp_path / "b.csv").write_text(",".join(RAW_SCHEMA.names) + "\n")
    empty = read_catalog(spark, str(tmp_path / "b.csv"))
    assert empty.count() == 0
    with pytest.raises(EmptyCatalog):
        require_rows(empty)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_catalog(spark, str(tmp_path / "none.csv"))


def test_T10_preview(spark):
    assert preview(spark.range(100)).count() == 5


def moments_of(spark, *rows):
    return spark.createDataFrame(
        [(key, dt.datetime(2024, 1, 1, 0, 0, second), updated, place) for key, second, updated, place in rows],
        "event_id string, datetime timestamp_ntz, updated string, place string",
    )


def test_D3_latest_time_then_latest_update_wins_and_nulls_are_one_event(spark):
    rows = moments_of(
        spark, ("a", 1, "u9", "old"), ("a", 2, "u1", "new"), ("b", 1, "u1", "old"), ("b", 1, "u2", "new"),
        (None, 1, "u", "old"), (None, 2, "u", "new"), ("c", 1, None, "old"), ("c", 1, "u", "new"),
    )
    found = dedup.merge_latest(rows)
    assert sorted((r.event_id or "-", r.place) for r in found.collect()) == [
        ("-", "new"), ("a", "new"), ("b", "new"), ("c", "new"),
    ]


def test_D3_ties_do_not_depend_on_the_input_order(spark):
    rows = [("a", 1, "u", place) for place in "pqrstuvw"]
    kept = {
        dedup.merge_latest(moments_of(spark, *ordered).repartition(parts)).first().place
        for ordered in (rows, rows[::-1], rows[3:] + rows[:3])
        for parts in (1, 3, 8)
    }
    assert len(kept) == 1


def test_D3_repeats_of_a_hot_event_are_dropped_before_the_shuffle(spark):
    rows = moments_of(spark, ("a", 1, "u", "p"))
    plan = dedup.merge_latest(rows)._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("Partial")
    assert plan.index("Exchange hashpartitioning") < partial  # printed from the top down


def test_D3_merging_before_deriving_gives_the_same(workspace):
    raw = workspace.raw()
    assert rows_of(conform.to_merged_events(raw)) == rows_of(dedup.merge_latest(conform.to_events(raw)))
    assert conform.to_merged_events(raw).columns == conform.to_events(raw).columns


def test_A28_missing_region_counts_as_one(spark):
    rows = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1), 1.0, 5.0, "x"), (dt.datetime(2024, 1, 2), 3.0, 15.0, None)],
        "datetime timestamp_ntz, magnitude double, depth double, region string",
    )
    assert tuple(profile.summary_statistics(rows).first()) == (
        2, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), 1.0, 3.0, 2.0, 5.0, 15.0, 10.0, 2,
    )


def test_A29_A30_profile_and_duplicates(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), (None, None)], "event_id string, n int")
    assert rows_of(profile.column_profile(rows)) == sorted(
        [("event_id", "string", 1, 3), ("n", "int", 2, 3)], key=repr
    )
    assert tuple(profile.duplicate_audit(rows).first()) == (3, 1, 2)


def test_expected_counts_of_the_derived_catalog(spark, workspace):
    named = conform.conform_names(workspace.raw())
    assert workspace.raw().count() == 1028
    assert conform.drop_incomplete(named).count() == 1017
    assert conform.clean(workspace.raw()).count() == 1008
    assert workspace.silver().count() == 980
    assert workspace.silver().where(F.col("status") == "reviewed").count() == 20


@pytest.mark.parametrize("seed", range(4))
def test_D2_D3_against_brute_force(spark, seed):
    dice = random.Random(seed)
    rows = [
        (
            dice.choice(["a", "b", "c", "d", None]),
            dice.randrange(4),
            dice.choice(["u1", "u2", None]),
            dice.choice("pqrs"),
        )
        for _ in range(60)
    ]
    kept = dedup.merge_latest(moments_of(spark, *rows).repartition(5)).collect()
    best = {}
    for key, second, updated, place in rows:
        best.setdefault(key, set()).add((second, updated or "", place))
    assert {r.event_id for r in kept} == set(best) and len(kept) == len(best)
    for row in kept:
        top = max((second, updated) for second, updated, _ in best[row.event_id])
        assert (row.datetime.second, row.updated or "") == top
        assert (*top, row.place) in best[row.event_id]
