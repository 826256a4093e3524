"""Tables of Parquet files below one root.

What a table holds is said by the lake's manifest and not by its folder: a write
goes to a folder of its own (``<table>/lake_version=...``, or one in each partition
folder), and the table switches to it when the next manifest, a file of some
lines, is renamed into place.  So a reader sees the old table or the new one, of
several tables that are committed together all old or all new, and a write that
stops has changed nothing.  Folders that no manifest names any more are kept for
readers that still scan them, and go when a commit finds them old enough.

One loader at a time may write to a lake.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import RLock

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.config import TableNames
from tremora.sources.shared import child_names, move, path_exists, read_text, remove, write_text_once

MANIFESTS = "_manifests"
KEPT_MANIFESTS = 10
VERSION = "lake_version"
MOVED = 16  # folders at a time
RETENTION = 86_400.0  # seconds that folders out of use are kept for their readers

_commits = RLock()  # tables are written by several threads of one loader


def column_names(schema: str) -> tuple[str, ...]:
    """The names in a schema text such as ``a INT, b STRING``."""
    return tuple(column.split()[0] for column in schema.split(","))


def clustered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Rows laid out in order over the files, so that a range filter skips most of them."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def gathered(rows: DataFrame, by: str) -> DataFrame:
    """Rows of one partition value together, so that a table partitioned by it gets a file per value.

    Otherwise each task writes a file per value, which are many small ones.  AQE splits
    values of more than its advisory size; without AQE the rows stay as they are.
    """
    return rows.hint("rebalance", by)


@dataclass(frozen=True)
class Written:
    """Rows of a table that lie in folders of their own, not yet part of the table.

    ``replaces`` lists the partition values that these folders take the place of,
    None for the whole table.  ``made_of`` says what the table is made of then.
    """

    table: str
    schema: T.StructType
    by: str | None
    folders: Mapping[str, str]
    rows: int
    replaces: frozenset[str] | None = None
    made_of: Mapping[str, str] | None = None


@dataclass(frozen=True)
class Lake:
    """A folder of tables.  The root must be reachable from every executor."""

    spark: SparkSession
    root: str
    names: TableNames = field(default_factory=TableNames)
    retention: float = RETENTION

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    # -- the manifest ---------------------------------------------------------------------

    def _manifest(self) -> tuple[int, dict]:
        """Number and content of the newest manifest."""
        names = child_names(self.spark, self.path(MANIFESTS))
        numbers = [int(name.removesuffix(".json")) for name in names if name.endswith(".json")]
        if not numbers:
            return 0, {"tables": {}, "retired": {}}
        newest = max(numbers)
        return newest, json.loads(read_text(self.spark, self._manifest_path(newest)))

    def _manifest_path(self, number: int) -> str:
        return f"{self.path(MANIFESTS)}/{number:012d}.json"

    def _entry(self, table: str) -> dict | None:
        return self._manifest()[1]["tables"].get(table)

    def folders(self, table: str) -> dict[str, str]:
        """The folders that make up a table, by partition value ('' without partitions).

        A partition whose folder has been taken away is gone.
        """
        entry = self._entry(table)
        if entry is None:
            return {}
        there = set(child_names(self.spark, self.path(table)))
        return {value: folder for value, folder in entry["folders"].items() if folder.split("/")[0] in there}

    def made_of(self, table: str) -> dict[str, str] | None:
        """What the table was said to be made of when it was last written; None if it isn't there."""
        return self._entry(table)["made_of"] if self.exists(table) else None

    def commit(self, *changes: Written) -> None:
        """Switch all these tables at once."""
        with _commits:
            number, manifest = self._manifest()
            tables, retired, now = manifest["tables"], manifest["retired"], time.time()
            for change in changes:
                old = tables.get(change.table, {"folders": {}, "made_of": {}})["folders"]
                kept = {} if change.replaces is None else {v: f for v, f in old.items() if v not in change.replaces}
                tables[change.table] = {
                    "folders": kept | dict(change.folders),
                    "schema": change.schema.jsonValue(),
                    "by": change.by,
                    "made_of": dict(change.made_of or {}),
                }
                gone = set(old.values()) - set(tables[change.table]["folders"].values())
                retired |= {f"{change.table}/{folder}": now for folder in gone}
            old_enough = [folder for folder, since in retired.items() if now - since >= self.retention]
            for folder in old_enough:
                del retired[folder]
            write_text_once(self.spark, self._manifest_path(number + 1), json.dumps(manifest))
            for folder in old_enough:
                remove(self.spark, self.path(folder))
            if number >= KEPT_MANIFESTS:
                remove(self.spark, self._manifest_path(number + 1 - KEPT_MANIFESTS))

    # -- reading --------------------------------------------------------------------------

    def _read(self, table: str, schema: T.StructType | str, folders: Sequence[str], by: str | None) -> DataFrame:
        paths = [f"{self.path(table)}/{folder}" for folder in folders]
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        if by is not None:
            reader = reader.option("basePath", self.path(table))
        return reader.parquet(*paths).drop(VERSION)

    def read(self, table: str, schema: T.StructType | str | None = None) -> DataFrame:
        """The table as the newest manifest has it; with the schema given, or its own.

        A folder of Parquet files that was not written by this class is read as it lies.
        """
        entry = self._entry(table)
        if entry is None:
            reader = self.spark.read if schema is None else self.spark.read.schema(schema)
            return reader.parquet(self.path(table))
        own = T.StructType.fromJson(entry["schema"])
        rows = self._read(table, own if schema is None else schema, list(self.folders(table).values()), entry["by"])
        return rows.select(*own.names) if schema is None else rows

    def read_written(self, change: Written) -> DataFrame:
        """Rows that are written and not yet committed."""
        rows = self._read(change.table, change.schema, list(change.folders.values()), change.by)
        return rows.select(*change.schema.names)

    def location(self, table: str) -> str:
        """The one folder that a table without partitions lies in, for readers of folders."""
        return f"{self.path(table)}/{self.folders(table).get('', '')}".rstrip("/")

    def exists(self, table: str) -> bool:
        if self._entry(table) is None:
            return path_exists(self.spark, self.path(table))
        return path_exists(self.spark, self.path(table)) and bool(
            self.folders(table) or not self._entry(table)["folders"]
        )

    def expose(self, table: str) -> DataFrame:
        """Make a table visible to SQL under its own name."""
        rows = self.read(table)
        rows.createOrReplaceTempView(table)
        return rows

    # -- writing --------------------------------------------------------------------------

    def write(
        self,
        table: str,
        rows: DataFrame,
        by: str | None = None,
        replaces: Sequence[object] | None = None,
        made_of: Mapping[str, str] | None = None,
    ) -> Written:
        """Write rows to folders of their own, to be committed; counts them on the way.

        With ``replaces``, they take the place of those partitions, and of the
        partitions that they fill, and the others stay.
        """
        counted, version = Observation(), f"{dt.datetime.now(dt.timezone.utc):%Y%m%d%H%M%S}-{uuid.uuid4().hex[:12]}"
        own, home = f"{VERSION}={version}", self.path(table)
        writer = rows.observe(counted, F.count("*").alias("rows")).write
        if by is None:
            writer.parquet(f"{home}/{own}")
            folders = {"": own}
        else:
            aside = f"{home}/_{version}"
            writer.partitionBy(by).parquet(aside)
            parts = [part for part in child_names(self.spark, aside) if part.startswith(f"{by}=")]
            folders = {part.removeprefix(f"{by}="): f"{part}/{own}" for part in parts}
            with ThreadPoolExecutor(MOVED) as pool:
                list(pool.map(lambda part: move(self.spark, f"{aside}/{part}", f"{home}/{part}/{own}"), parts))
            remove(self.spark, aside)
        taken = None if replaces is None else frozenset(map(str, replaces)) | frozenset(folders)
        return Written(table, rows.schema, by, folders, counted.get["rows"], taken, made_of)

    def replace(
        self, table: str, rows: DataFrame, partition_by: Sequence[str] = (), made_of: Mapping[str, str] | None = None
    ) -> int:
        """Write the whole table anew; gives the rows written."""
        by, *more = [*partition_by, None]
        if more[1:]:
            raise ValueError("a table is partitioned by one column at most")
        change = self.write(table, rows, by, made_of=made_of)
        self.commit(change)
        return change.rows

    def replace_partitions(
        self, table: str, rows: DataFrame, partition_by: str, also: Sequence[object] = ()
    ) -> int:
        """Write only the partitions that the rows name, and leave the others as they are.

        Partitions listed in ``also`` go if the rows don't fill them.
        """
        change = self.write(table, rows, partition_by, also)
        self.commit(change)
        return change.rows

    def drop_partitions(self, table: str, values: Sequence[object]) -> None:
        """The table without these partitions, where it has any of them."""
        if set(map(str, values)) & set(self.folders(table)):
            entry = self._entry(table)
            schema = T.StructType.fromJson(entry["schema"])
            self.commit(Written(table, schema, entry["by"], {}, 0, frozenset(map(str, values)), entry["made_of"]))

    def export(self, table: str, path: str | None = None) -> str:
        """Copy a table to Parquet files elsewhere, by default ``processed/`` in the lake."""
        path = path or self.path(f"processed/{table}.parquet")
        self.read(table).write.mode("overwrite").parquet(path)
        return path
