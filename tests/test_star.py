"""W1-W3, J1-J6, L7, L8 and properties of the star and the cubes."""

from __future__ import annotations

import datetime as dt
from itertools import permutations

import pytest
from conftest import SMALL, rows_of
from pyspark.sql import Window
from pyspark.sql import functions as F

from tremora.checks.workspace import Workspace
from tremora.operators import profile
from tremora.operators.keyed_join import attach_id
from tremora.operators.numbering import number, number_keys, place
from tremora.plans import cubes
from tremora.plans.star import STAR_SCHEMAS, Star, build_star, event_view, star_view
from tremora.sources.shared import fresh_path, path_exists, scratch_folder, shared_root


def skewed(spark, rows=4000):
    """A third of all rows has one key, and most keys share their leading value."""
    n = F.col("id")
    return spark.range(rows).select(
        F.format_string("ev%d", n).alias("event_id"),
        F.when(n % 3 == 0, 7.0).otherwise((n % 5).cast("double")).alias("latitude"),
        F.when(n % 3 == 0, "hot").otherwise(F.format_string("p%d", n % 701)).alias("place"),
    )


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_W2_ids_equal_a_global_row_number(spark, slices):
    rows = skewed(spark).select("latitude", "place").distinct()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", slices)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        path = fresh_path(spark, "test")
        found = number(place(rows, ["latitude", "place"], path)[0], "n")
        want = rows.withColumn("n", F.row_number().over(Window.orderBy("latitude", "place")).cast("long"))
        assert rows_of(found) == rows_of(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_W1_numbering_has_no_window_over_all_rows(spark):
    rows = skewed(spark).select("latitude", "place").distinct()
    found = number(place(rows, ["latitude", "place"], fresh_path(spark, "test"))[0], "n")
    plan = found._jdf.queryExecution().executedPlan().toString()
    before_window = plan[plan.index("Window") :]
    assert "HashAggregate(keys=[_slice" in before_window


def test_keys_carry_their_weights(spark):
    keyed = number_keys(skewed(spark), ("latitude", "place"), "n", fresh_path(spark, "test"))
    assert keyed.total == 4000
    assert keyed.rows.agg(F.sum("_rows")).first()[0] == 4000


@pytest.mark.parametrize("max_hot_keys", [1, 40, 10_000])
@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_J2_hot_keys_get_the_same_ids_as_others(spark, max_hot_keys, broadcast):
    rows = skewed(spark)
    keyed = number_keys(rows, ("latitude", "place"), "n", fresh_path(spark, "test"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        found = attach_id(rows, keyed, max_hot_keys=max_hot_keys)
        want = rows.join(keyed.rows.select("latitude", "place", "n"), ["latitude", "place"], "left")
        assert rows_of(found) == rows_of(want)
        assert found.where("n IS NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_J2_hot_rows_are_spread_over_the_shuffle(spark):
    rows = skewed(spark)
    keyed = number_keys(rows, ("latitude", "place"), "n", fresh_path(spark, "test"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        joined = attach_id(rows, keyed, max_hot_keys=8)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert sum("_share" in line and "latitude" in line for line in shuffles) == 2
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 0.5 * 4000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_star_properties(workspace):
    star, silver = workspace.star(), workspace.silver()
    events = silver.count()
    assert star.fact.count() == events == 980
    assert star.time.count() == 980 and star.location.count() == 39 and star.magnitude.count() == 147
    assert star.fact.where("time_id IS NULL OR location_id IS NULL OR magnitude_id IS NULL").count() == 0
    for rows, key, order in (
        (star.time, "time_id", "datetime"),
        (star.location, "location_id", "latitude"),
        (star.magnitude, "magnitude_id", "magnitude"),
    ):
        found = rows.agg(F.min(key), F.max(key), F.count_distinct(key), F.count("*")).first()
        assert tuple(found) == (1, found[3], found[3], found[3])
        falls = F.lag(order).over(Window.orderBy(key)) > F.col(order)
        assert rows.select(falls.alias("falls")).where("falls").count() == 0


def test_tables_hold_what_their_schemas_say(workspace):
    lake = workspace.cube_lake()
    names = lake.names.star + lake.names.cubes
    for table, schema in zip(names, (*STAR_SCHEMAS, *cubes.CUBE_SCHEMAS), strict=True):
        assert lake.read(table).dtypes == lake.read(table, schema).dtypes


def test_star_joined_back_equals_the_event_view(workspace):
    whole = star_view(workspace.star(), time=True, location=True, magnitude=True)
    columns = [c for c in whole.columns if c not in ("time_id", "location_id", "magnitude_id")]
    assert rows_of(whole.select(*columns)) == rows_of(event_view(workspace.silver()).select(*columns))


def test_hot_times_give_the_same_star(spark, lake, workspace):
    silver = workspace.silver()
    hot = silver.withColumn(
        "datetime",
        F.when(F.crc32("event_id") % 3 == 0, F.lit(dt.datetime(2022, 1, 1)).cast("timestamp_ntz"))
        .otherwise(F.col("datetime")),
    )
    columns = ["event_id", "datetime", "time_id", "location_id", "magnitude_id", "place", "magnitude"]
    found = []
    for max_hot_keys in (1, 200):
        build_star(lake, hot, max_hot_keys=max_hot_keys)
        whole = star_view(Star.of(lake), time=True, location=True, magnitude=True)
        found.append(rows_of(whole.select(*columns)))
    assert found[0] == found[1] and len(found[0]) == 980


def test_T9_a_fact_in_time_order_holds_the_same_rows(spark, lake, workspace):
    build_star(lake, workspace.silver(), by_time=True)
    fact = lake.read("fact_earthquakes")
    assert rows_of(fact) == rows_of(workspace.star().fact)
    ranges = fact.groupBy(F.input_file_name()).agg(F.min("time_id"), F.max("time_id")).collect()
    bounds = sorted((low, high) for _, low, high in ranges)
    assert all(high <= low for (_, high), (low, _) in zip(bounds, bounds[1:]))


def test_D4_repeated_events_are_dropped_on_request(lake, workspace):
    silver = workspace.silver()
    counts = build_star(lake, silver.unionByName(silver.limit(100)), unique_events=False)
    assert counts["fact_earthquakes"] == 980


def test_E19_station_counts_round_half_to_even(spark):
    from tremora.plans.star import NUMBER_MEASURES, TEXT_MEASURES, with_measures

    rows = spark.createDataFrame([(2.5,), (2.6,), (3.5,), (None,)], "num_stations double")
    rows = rows.select(
        "*",
        F.lit("e").alias("event_id"),
        *[F.lit(None).cast("double").alias(name) for name in NUMBER_MEASURES],
        *[F.lit(None).cast("string").alias(name) for name in TEXT_MEASURES],
    )
    found = with_measures(rows)
    assert [r.num_stations for r in found.collect()] == [2, 3, 4, 0]
    first = found.first()
    assert first.moon_phase == 0.0 and first.moon_phase_name == "Unknown" and first.depth == 0.0


def test_P8_E20_unkeyed_events_are_left_out_and_keys_defaulted(workspace):
    silver = workspace.silver()
    broken = silver.limit(5).withColumns({"magnitude": F.lit(None).cast("double")})
    nameless = silver.limit(5).withColumns(
        {name: F.lit(None).cast("string") for name in ("place", "region", "magnitude_type")}
    )
    view = event_view(silver.unionByName(broken))
    assert view.count() == 980
    found = event_view(nameless).select("place", "region", "magnitude_type").distinct().collect()
    assert [tuple(row) for row in found] == [("Unknown", "Unknown", "Unknown")]


def test_A31_columns_of_a_table(workspace):
    found = profile.table_columns(workspace.star_lake(), "dim_magnitude").orderBy("position").collect()
    assert [(r.column_name, r.data_type) for r in found][:2] == [("magnitude_id", "bigint"), ("magnitude", "double")]


def test_A31_audit_of_missing_tables(lake):
    found = profile.table_audit(lake, ["dim_time", "nothing"]).collect()
    assert [(r.table_name, r.is_there, r.row_count) for r in found] == [
        ("dim_time", False, 0),
        ("nothing", False, 0),
    ]


@pytest.mark.parametrize(
    ("make", "dimensions", "count"),
    [
        (cubes.time_magnitude, {"time": True, "magnitude": True}, "event_count"),
        (cubes.location_magnitude, {"location": True, "magnitude": True}, "event_count"),
        (cubes.depth_analysis, {"time": True, "magnitude": True}, "event_count"),
        (cubes.temporal_trends, {"time": True, "location": True, "magnitude": True}, "daily_event_count"),
        (cubes.moon_phase, {"magnitude": True}, "event_count"),
    ],
)
def test_cubes_cover_every_event(workspace, make, dimensions, count):
    cube = make(star_view(workspace.star(), **dimensions))
    assert cube.agg(F.sum(count)).first()[0] == 980
    assert cube.count() == make(workspace.view()).count()


def test_cubes_from_the_event_view_need_no_join(workspace):
    for make in (cubes.time_magnitude, cubes.location_magnitude, cubes.depth_analysis, cubes.temporal_trends):
        plan = make(workspace.view())._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Python" not in plan


class Session:
    """As much of a session as finding the shared folder needs."""

    def __init__(self, master, folder=None):
        self.conf = {} if folder is None else {"spark.checkpoint.dir": folder}
        self.sparkContext = self
        self.master, self.applicationId = master, "app"

    def getCheckpointDir(self):
        return None


def test_the_shared_folder_is_the_one_the_cluster_names():
    assert shared_root(Session("yarn", "hdfs://shared/")) == "hdfs://shared/tremora-app"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(Session("yarn"))
    assert shared_root(Session("local[2]")).endswith("/tremora-app")


def test_scratch_folders_are_removed(spark):
    with scratch_folder(spark, "gone") as path:
        spark.range(3).write.parquet(f"{path}/t")
        assert path_exists(spark, path)
    assert not path_exists(spark, path)


def test_J5_hot_ids_are_split_by_adaptive_execution(spark, lake, workspace):
    """The star joined on a time that a third of all events share, with both sides shuffled."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    hot = F.when(F.crc32("event_id") % 3 == 0, F.lit(dt.datetime(2022, 1, 1)).cast("timestamp_ntz"))
    silver = workspace.silver().withColumn("datetime", F.coalesce(hot, "datetime"))
    # several files, so that there are several map tasks to split by
    build_star(lake, silver)
    lake.replace("spread", lake.read("fact_earthquakes").repartition(6))
    star = Star(*(lake.read(t) for t in ("dim_time", "dim_location", "dim_magnitude", "spread")))
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        rows = star_view(star, time=True).select("event_id", "datetime", "season")
        found = rows_of(rows.repartition(1))
        joined = star_view(star, time=True).groupBy("season").agg(F.max("event_id"))
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert found == rows_of(event_view(silver).select("event_id", "datetime", "season"))


def test_a_star_of_no_events_is_empty(lake, workspace):
    nothing = workspace.silver().where("false")
    assert set(build_star(lake, nothing).values()) == {0}
    assert set(cubes.build_cubes(lake, event_view(nothing)).values()) == {0}
    assert star_view(Star.of(lake), time=True, location=True, magnitude=True).count() == 0


def test_the_mean_magnitude_of_a_cell_is_exact_in_any_order(spark):
    """5.2, 5.3, 5.6, 5.9 have the mean 5.5; added up as doubles in some orders, a little less."""
    orders = list(permutations((5.2, 5.3, 5.6, 5.9)))
    assert any((((a + b) + c) + d) / 4 < 5.5 for a, b, c, d in orders)
    cube = cubes.Cube(("cell",), "event_count", {"avg_magnitude": cubes.TIME_MAGNITUDE.measures["avg_magnitude"]})
    rows = [(cell, place, m) for cell, order in enumerate(orders) for place, m in enumerate(order)]
    events = spark.createDataFrame(rows, "cell int, place int, magnitude double").coalesce(1).sortWithinPartitions("cell", "place")
    for made in (cube.of(events), cube.merged(cube.parts(events, "place"))):
        assert {r.avg_magnitude for r in made.collect()} == {5.5}


def test_cubes_are_built_without_the_star(spark, tmp_path):
    w = Workspace(spark, SMALL, str(tmp_path / "own"))
    lake = w.cube_lake()
    assert all(map(lake.exists, lake.names.cubes)) and not any(map(lake.exists, lake.names.star))
