"""Settings that are shared by several modules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

UNKNOWN = "Unknown"


@dataclass(frozen=True)
class Limits:
    """Inclusive validation limits."""

    min_magnitude: float = -2.0
    max_magnitude: float = 10.0
    min_depth: float = -10.0
    max_depth: float = 1000.0
    max_latitude: float = 90.0
    max_longitude: float = 180.0


@dataclass(frozen=True)
class TableNames:
    """The one place where table names are decided."""

    bronze: str = "bronze"
    silver: str = "raw_earthquakes"
    ledger: str = "ledger"
    contents: str = "ledger_contents"
    silver_ids: str = "silver_ids"
    refused: str = "refused_rows"
    dim_time: str = "dim_time"
    dim_location: str = "dim_location"
    dim_magnitude: str = "dim_magnitude"
    fact: str = "fact_earthquakes"
    cube_time_magnitude: str = "cube_time_magnitude"
    cube_location_magnitude: str = "cube_location_magnitude"
    cube_depth_analysis: str = "cube_depth_analysis"
    cube_temporal_trends: str = "cube_temporal_trends"
    cube_moon_phase: str = "cube_moon_phase"

    @property
    def star(self) -> tuple[str, ...]:
        return (self.dim_time, self.dim_location, self.dim_magnitude, self.fact)

    @property
    def cubes(self) -> tuple[str, ...]:
        return (
            self.cube_time_magnitude,
            self.cube_location_magnitude,
            self.cube_depth_analysis,
            self.cube_temporal_trends,
            self.cube_moon_phase,
        )


# Results do not depend on these; they are what the plans were tuned with.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cores: int | str = "*", **settings: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tremora")
    local = {
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8" if cores == "*" else str(cores),
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for name, value in {**SESSION_SETTINGS, **local, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
