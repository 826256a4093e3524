"""Benchmark: the three builds and six reports, on the tables of $BENCH_SF_DIR.

The events are taken COPIES times under different ids: at sf0.1, that makes

Prints one JSON line.  ``queries`` holds warm times (the median of the repeats
after the first), ``cold`` the first run of each.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tremora.config import local_session
from tremora.operators.conform import to_merged_events
from tremora.plans import reports
from tremora.plans.cubes import build_cubes, read_cube
from tremora.plans.loads import yearly_files
from tremora.plans.star import build_star, event_view
from tremora.sources.catalog_csv import read_catalog
from tremora.sources.derived import derived_catalog
from tremora.sources.lake import Lake
from tremora.sources.shared import scratch_folder

REPEATS = 4
COPIES = 5


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    with scratch_folder(spark, "bench") as root:
        print(json.dumps(measure(spark, folder, int(cores), root)))
    spark.stop()


def measure(spark: SparkSession, folder: str, cores: int, root: str) -> dict:
    lake = Lake(spark, f"{root}/lake")
    names = lake.names

    # The input of a load is catalogue files, so these are made first and not timed.
    raw = derived_catalog(spark, folder, COPIES).repartition(cores)
    yearly_files(raw, f"{root}/raw")

    def transform() -> int:
        files = read_catalog(spark, f"{root}/raw/*")
        return lake.replace(names.silver, to_merged_events(files))

    def shown(report: Callable[[], DataFrame]) -> Callable[[], int]:
        return lambda: len(report().collect())

    events = lambda: event_view(lake.read(names.silver))
    cube = lambda table: read_cube(lake, table)
    steps: dict[str, Callable[[], object]] = {
        "full_transform": transform,
        "star_build": lambda: build_star(lake),
        "cube_build": lambda: build_cubes(lake),
        "top_magnitude_events": shown(lambda: reports.top_magnitude_events(events(), 100)),
        "events_by_region": shown(
            lambda: reports.events_by_region(cube(names.cube_location_magnitude), 50)
        ),
        "temporal_trends": shown(lambda: reports.temporal_trends(cube(names.cube_temporal_trends))),
        "magnitude_distribution": shown(
            lambda: reports.magnitude_distribution(cube(names.cube_time_magnitude))
        ),
        "depth_analysis": shown(lambda: reports.depth_analysis(cube(names.cube_depth_analysis))),
        "events_for_map": shown(lambda: reports.events_for_map(events(), 4.0, 1000)),
    }
    cold: dict[str, float] = {}
    warm: dict[str, float] = {}
    for name, step in steps.items():
        times = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            step()
            times.append(time.perf_counter() - start)
        cold[name], warm[name] = round(times[0], 3), round(statistics.median(times[1:]), 3)

    rows = lake.read(names.silver).count()
    return {
        "metric": "builds and reports, warm",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "sf": float(Path(folder).name.removeprefix("sf")),
        "cold": cold,
        "silver_rows": rows,
        "copies": COPIES,
        "transform_rows_per_sec": round(rows / warm["full_transform"]),
        "cores": cores,
        "spark": spark.version,
    }


if __name__ == "__main__":
    sys.exit(main())
