"""Running independent writes at the same time."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Result = TypeVar("Result")


def together(spark: SparkSession, *jobs: Callable[[], Result]) -> list[Result]:
    """Results of the jobs, in order.  One job's tail leaves executors free for the next."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        return list(pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs))
