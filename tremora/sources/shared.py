"""The folder that all executors can reach, for tables a plan writes half way.

A written table cuts the lineage: a lost executor never forces a recomputation
from the raw files, and values that depend on how rows were partitioned (the
positions of ``operators.numbering``) are read back the same by every later job.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, tempfile.TemporaryDirectory] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _local_roots:
            _local_roots[context.applicationId] = tempfile.TemporaryDirectory(prefix="tremora-")
        root = _local_roots[context.applicationId].name
    return f"{root.rstrip('/')}/tremora-{context.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def _located(spark: SparkSession, path: str):
    """A path and the file system it is on, as Hadoop sees them."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    location, files = _located(spark, path)
    return files.exists(location)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder if it is there."""
    location, files = _located(spark, path)
    files.delete(location, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Give a file or folder another path, which nothing has yet."""
    location, files = _located(spark, path)
    target, _ = _located(spark, to)
    files.mkdirs(target.getParent())
    if files.exists(target) or not files.rename(location, target):
        raise FileExistsError(to)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it isn't there."""
    location, files = _located(spark, path)
    return [child.getPath().getName() for child in files.listStatus(location)] if files.exists(location) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    location, files = _located(spark, path)
    stream = files.open(location)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def first_line(spark: SparkSession, path: str, most: int) -> str | None:
    """The first line of a file that isn't blank, unpacked if its name says that it is packed.

    At most that many bytes are read; None if there is no line.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    location, files = _located(spark, path)
    stream = files.open(location)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(location)
        unpacked = stream if codec is None else codec.createInputStream(stream)
        bounded = jvm.org.apache.commons.io.input.BoundedInputStream(unpacked, most)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(bounded, "UTF-8"))
        line = lines.readLine()
        while line is not None and not line.strip():
            line = lines.readLine()
        return line
    finally:
        stream.close()


def write_text_once(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole or not at all; one that is there already is an error."""
    location, files = _located(spark, path)
    unfinished, _ = _located(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    stream = files.create(unfinished, False)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    if files.exists(location) or not files.rename(unfinished, location):
        files.delete(unfinished, False)
        raise FileExistsError(f"{path}: written by someone else meanwhile")


@contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A fresh path that is deleted again once what was built from it has been written."""
    path = fresh_path(spark, name)
    try:
        yield path
    finally:
        remove(spark, path)


def written(rows: DataFrame, path: str) -> DataFrame:
    """The same rows, read back from a table at the path."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
