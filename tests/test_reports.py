"""Reports, figures and filters on hand-made frames, and the shape of their plans."""

from __future__ import annotations

import math

import datetime as dt

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tremora.functions import bands, moments
from tremora.operators import filters, grids
from tremora.operators.shapes import densify, largest
from tremora.plans import figures, reports
from tremora.plans.star import star_view


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_J9_missing_days_are_zero(spark):
    trend = spark.createDataFrame([(1, 4, 3.0), (1, 2, 5.0), (3, 1, 6.0)],
                                  "day_of_week int, daily_event_count long, daily_avg_magnitude double")
    found = [tuple(r) for r in figures.day_of_week(trend).collect()]
    assert [r[0] for r in found] == list(moments.DAY_NAMES)
    assert found[0][1:] == (6, 4.0) and found[2][1:] == (1, 6.0) and found[6][1:] == (0, 0.0)


def test_A23_total_is_the_mean_of_the_averages_shown(spark):
    seasonal = spark.createDataFrame([("Spring", 3, 1.234), ("Fall", 5, 2.345)],
                                     "season string, total_events long, avg_magnitude double")
    found = {r.season: (r.total_events, r.avg_magnitude) for r in figures.seasonal_with_total(seasonal).collect()}
    assert found["**TOTAL**"] == (8, pytest.approx(1.79))
    assert len(found) == 3


def selection(spark, *rows):
    return spark.createDataFrame(list(rows), "magnitude double, depth double")


def test_A25_to_A27_bands_of_the_selection(spark):
    rows = selection(spark, (3.9, 69.9), (4.0, 70.0), (5.0, 299.0), (6.0, 300.0))
    assert tuple(figures.map_depth_bands(rows).first()) == (1, 25.0, 2, 50.0, 1, 25.0)
    assert tuple(figures.map_magnitude_bands(rows).first()) == (1, 25.0) * 4
    assert tuple(figures.map_statistics(rows).first()) == (4, pytest.approx(4.725), 6.0, pytest.approx(184.725))


def test_A26_an_empty_selection_gives_zero(spark):
    none = selection(spark)
    assert tuple(figures.map_depth_bands(none).first()) == (0, 0.0) * 3
    assert tuple(figures.map_magnitude_bands(none).first()) == (0, 0.0) * 4


def test_A22_all_groups_are_shown_even_without_events(spark):
    moon = spark.createDataFrame([], "magnitude_group string, event_count long")
    found = [tuple(r) for r in figures.magnitude_group_share(moon).collect()]
    assert found == [(name, 0, 0.0) for name in ("1-3", "4", "5", "6-7", "8-9")]


def test_A21_D9_every_phase_for_the_groups_present(spark):
    moon = spark.createDataFrame(
        [("Full Moon", "5", 2, 5.5), ("Full Moon", "5", 1, 5.1), ("New Moon", "4", 1, 4.2)],
        "moon_phase_name string, magnitude_group string, event_count long, avg_magnitude double",
    )
    found = [tuple(r) for r in figures.phase_by_group(moon).collect()]
    assert len(found) == 16
    assert [r.magnitude_group for r in figures.groups_present(moon).collect()] == ["4", "5"]
    full = [r for r in figures.phase_by_group(moon).collect() if r.event_count == 3]
    assert [(r.moon_phase_name, r.magnitude_group, r.avg_magnitude) for r in full] == [
        ("Full Moon", "5", pytest.approx(5.3))
    ]


def test_A20_T8_phases_in_lunar_order_unknown_last(spark):
    moon = spark.createDataFrame(
        [(name, 1, 5.0, 5.0, 1.0) for name in ("Unknown", *reversed(bands.PHASE_NAMES))],
        "moon_phase_name string, event_count long, avg_magnitude double, max_magnitude double, avg_depth double",
    )
    found = [r.moon_phase_name for r in figures.phase_statistics(moon).collect()]
    assert found == [*bands.PHASE_NAMES, "Unknown"]


def test_A6_a_region_can_appear_more_than_once_and_A7_not(spark):
    cube = spark.createDataFrame(
        [("x", 3, 1.0, 2.0, 0.0, 0.0), ("x", 1, 4.0, 6.0, 1.0, 1.0), ("y", 3, 1.0, 2.0, 0.0, 0.0),
         ("y", 3, 1.0, 2.0, 0.0, 0.0)],
        "region string, event_count long, avg_magnitude double, max_magnitude double, "
        "center_latitude double, center_longitude double",
    )
    assert [(r.region, r.event_count) for r in reports.events_by_region(cube).collect()] == [
        ("x", 3), ("y", 3), ("x", 1),
    ]
    assert [(r.region, r.event_count) for r in reports.region_top_n(cube).collect()] == [("y", 6), ("x", 4)]
    plain = {r.region: r.avg_magnitude for r in reports.region_rollup(cube).collect()}
    weighted = {r.region: r.avg_magnitude for r in reports.region_rollup(cube, weighted=True).collect()}
    assert plain["x"] == 2.5 and weighted["x"] == 1.75
    assert [r.region for r in reports.region_top_n(cube, min_magnitude=3.0).collect()] == ["x"]


def test_T3_ties_go_by_the_further_columns(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "region string, event_count long")
    assert [r.region for r in largest(rows, 2, "event_count", "region").collect()] == ["c", "a"]


def test_densify_keeps_the_fixed_order(spark):
    totals = spark.createDataFrame([("Winter", 2)], "season string, n long")
    found = densify(totals, "season", bands.SEASON_ORDER, {"n": 0}).collect()
    assert [tuple(r) for r in found] == [("Spring", 0), ("Summer", 0), ("Fall", 0), ("Winter", 2)]


def dated(spark, *days):
    return spark.createDataFrame([(dt.datetime(2024, 1, day),) for day in days], "date timestamp_ntz")


def test_P11_P12_days_are_inclusive_and_a_reversed_range_is_everything(spark):
    rows = dated(spark, 1, 2, 3, 4)
    first, last = dt.date(2024, 1, 2), dt.date(2024, 1, 3)
    assert filters.within_days(rows, first, last).count() == 2
    assert filters.within_days(rows, last, first).count() == 0
    assert filters.within_days(rows, *filters.ordered_range(last, first)).count() == 4
    assert filters.within_days(rows, None, first).count() == 2
    assert filters.within_days(rows, last, None).count() == 2


def test_P13_to_P17_each_predicate(spark, workspace):
    view = workspace.view()
    everything = view.count()
    assert filters.filter_events(view).count() == everything
    for arguments, predicate in (
        ({"min_magnitude": 3.0, "max_magnitude": 4.0}, "magnitude BETWEEN 3 AND 4"),
        ({"depth_categories": ["Deep"]}, "depth >= 300"),
        ({"magnitude_categories": ["Minor"]}, "magnitude < 3"),
        ({"regions": ["NATION_3"]}, "region = 'NATION_3'"),
        ({"start": dt.date(2022, 1, 1), "end": dt.date(2022, 12, 31)}, "year = 2022"),
        ({"regions": view.where("latitude > 0").select("region").distinct()}, None),
    ):
        found = filters.filter_events(view, **arguments)
        assert 0 < found.count() < everything or predicate is None
        if predicate:
            assert rows_of(found.select("event_id")) == rows_of(view.where(predicate).select("event_id"))
    regions = [row.region for row in view.select("region").distinct().collect()]
    assert len(regions) > 10 and filters.filter_events(view, regions=regions).count() == everything


def test_T1_T2_order_and_ties(workspace):
    top = reports.top_magnitude_events(workspace.view(), 50).collect()
    keys = [(-r.magnitude, -r.datetime.timestamp(), r.event_id) for r in top]
    assert keys == sorted(keys) and len(top) == 50
    want = (
        workspace.view().orderBy(F.desc("magnitude"), F.desc("datetime"), "event_id").limit(50).collect()
    )
    assert [r.event_id for r in top] == [r.event_id for r in want]


def test_T2_a_range_without_events_gives_none(workspace):
    far = (dt.date(1990, 1, 1), dt.date(1990, 2, 1))
    assert reports.events_for_map(workspace.view(), None, 10, *far).count() == 0


def test_reports_on_events_join_nothing_and_filter_in_the_scan(spark, workspace):
    view, days = workspace.view(), (dt.date(2021, 3, 1), dt.date(2022, 8, 31))
    found = {
        "top": reports.top_magnitude_events(view, 100),
        "map": reports.events_for_map(view, 4.0, 100, *days),
        "kpis": reports.kpis(view),
        "trend": reports.daily_trend(view, 5.5),
        "filter": filters.filter_events(view, 2.5, start=days[0], end=days[1]),
    }
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        plans = {name: plan_of(frame) for name, frame in found.items()}
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", before)
    assert not any("Join" in plan for plan in plans.values())
    assert all(plan.count("FileScan") == 1 for plan in plans.values())
    assert plans["top"].count("TakeOrderedAndProject") == 1
    for name, bound in (("map", 4.0), ("trend", 5.5), ("filter", 2.5)):
        assert f"GreaterThanOrEqual(magnitude,{bound})" in plans[name]
    for name in ("map", "filter"):
        assert "GreaterThanOrEqual(datetime,2021-03-01" in plans[name]
        assert "LessThan(datetime,2022-09-01" in plans[name]


def test_reports_are_the_same_on_the_joined_star(workspace):
    star = star_view(workspace.star(), time=True, location=True, magnitude=True)
    view, days = workspace.view(), (dt.date(2021, 3, 1), dt.date(2022, 8, 31))
    for report in (
        lambda events: reports.top_magnitude_events(events, 100),
        lambda events: reports.events_for_map(events, 4.0, 100, *days),
        lambda events: reports.days_shown(events, days[0]),
        lambda events: reports.kpis(events).drop("avg_magnitude"),
    ):
        assert rows_of(report(star)) == rows_of(report(view))


def test_filters_and_columns_reach_the_scans(workspace):
    rows = star_view(workspace.star(), magnitude=True)
    plan = plan_of(reports.moon_phase_filtered(rows, 5.5))
    assert "GreaterThanOrEqual(magnitude,5.5)" in plan
    assert "ReadSchema: struct<magnitude_id:bigint,depth:double,moon_phase:double,moon_phase_name:string>" in plan


def test_kpis_of_no_events(spark, workspace):
    found = reports.kpis(workspace.view().where("false")).first()
    assert found.total_events == 0 and found.min_datetime is None


def test_T5_sample_is_stable(workspace):
    rows = star_view(workspace.star(), magnitude=True)
    first = [r.event_id for r in reports.magnitude_depth_sample(rows, 2.0, 50).collect()]
    again = [r.event_id for r in reports.magnitude_depth_sample(rows.repartition(7), 2.0, 50).collect()]
    assert first == again and len(first) == 50


def test_G2_G3_cells(spark):
    rows = spark.createDataFrame(
        [(-0.5, 0.5, 4.0), (-0.1, 0.9, 5.0), (10.0, 179.9, 6.0)],
        "latitude double, longitude double, magnitude double",
    )
    density = {(r.lat_cell, r.lon_cell): (r.event_count, r.weight) for r in grids.density_grid(rows).collect()}
    assert density == {(-1, 0): (2, 9.0), (10, 179): (1, 6.0)}
    clusters = grids.cluster_grid(rows, zoom=0).collect()
    assert sorted((r.lat_cell, r.lon_cell, r.event_count) for r in clusters) == [(-1, 0, 2), (0, 0, 1)]


def test_A14_equals_A15_without_a_filter(workspace):
    rows = star_view(workspace.star(), time=True, location=True, magnitude=True)
    days = reports.daily_trend(rows).select("date", "daily_event_count", "affected_regions")
    cube = reports.temporal_trends(workspace.cube("temporal_trends"))
    assert rows_of(days) == rows_of(cube.select("date", "daily_event_count", "affected_regions"))


def test_G2_heat_is_spread_by_the_kernel(spark):
    from tremora.operators import grids

    kernel = {(i, j): weight for i, j, weight in grids.heat_kernel()}
    assert len(kernel) == 9 and kernel[0, 0] == 1.0 and abs(kernel[0, 1] - 0.9) < 1e-12 and kernel[1, 1] < 0.53
    assert {key: w for key, w in kernel.items()} == {(-i, j): w for (i, j), w in kernel.items()}
    events = [(10.0, 20.0, 5.0), (10.0, 20.0, 3.0), (89.9, 0.0, 4.0), (-90.0, 179.99, 2.0), (12.0, 40.0, 1.0)]
    found = grids.heat_grid(spark.createDataFrame(events, "latitude double, longitude double, magnitude double"), 3).collect()
    heat, world = {}, 2048
    for lat, lon, weight in events:
        lat = math.radians(max(-grids.HIGHEST, min(grids.HIGHEST, lat)))
        x = math.floor((lon + 180) / 360 * world / 22.5)
        y = math.floor((0.5 - math.log(math.tan(lat / 2 + math.pi / 4)) / (2 * math.pi)) * world / 22.5)
        for (i, j), share in kernel.items():
            heat[x + i, y + j] = heat.get((x + i, y + j), 0) + weight * share
    assert {(r.x_cell, r.y_cell): round(r.heat, 9) for r in found} == {key: round(v, 9) for key, v in heat.items()}
    assert sum(r.event_count for r in found) == len(events)
