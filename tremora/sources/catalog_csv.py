"""Reading catalogue files.

The schema is declared: inference would read the files twice and would type a
column by whatever one file happens to hold.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.sources.shared import first_line

# --- fixed values: the header of a catalogue file and the names used from there on ---
RAW_COLUMNS = (
    ("time", "time", T.StringType()),
    ("latitude", "latitude", T.DoubleType()),
    ("longitude", "longitude", T.DoubleType()),
    ("depth", "depth", T.DoubleType()),
    ("mag", "magnitude", T.DoubleType()),
    ("magType", "magnitude_type", T.StringType()),
    ("nst", "num_stations", T.IntegerType()),
    ("gap", "azimuthal_gap", T.DoubleType()),
    ("dmin", "min_distance", T.DoubleType()),
    ("rms", "rms", T.DoubleType()),
    ("net", "network", T.StringType()),
    ("id", "event_id", T.StringType()),
    ("updated", "updated", T.StringType()),
    ("place", "place", T.StringType()),
    ("type", "event_type", T.StringType()),
    ("horizontalError", "horizontal_error", T.DoubleType()),
    ("depthError", "depth_error", T.DoubleType()),
    ("magError", "magnitude_error", T.DoubleType()),
    ("magNst", "magnitude_stations", T.IntegerType()),
    ("status", "status", T.StringType()),
    ("locationSource", "location_source", T.StringType()),
    ("magSource", "magnitude_source", T.StringType()),
)
# --- end of fixed values ---

# Counts may be written as 12.0, which is no integer to a CSV reader.
COUNTS = ("nst", "magNst")
RAW_SCHEMA = T.StructType([T.StructField(name, kind) for name, _, kind in RAW_COLUMNS])
SCAN_SCHEMA = T.StructType(
    [T.StructField(f.name, T.DoubleType() if f.name in COUNTS else f.dataType) for f in RAW_SCHEMA]
)
RENAMES = {name: new for name, new, _ in RAW_COLUMNS if name != new}

# Quotes inside a quoted field are doubled.  A header that isn't the schema's is an error: without
# the check, Spark would read the cells by position, whatever the header says.
CSV_OPTIONS = {"escape": '"', "enforceSchema": "false"}

OPENED = 16  # files at a time
LONGEST_HEADER = 1 << 20

POSITION = ("_file", "_block", "_row")


class EmptyCatalog(ValueError):
    """None of the files to read holds a row."""


def whole_counts(rows: DataFrame) -> DataFrame:
    """Rows of ``SCAN_SCHEMA`` with the counts as integers, half to even."""
    return rows.withColumns({name: F.rint(name).try_cast("int") for name in COUNTS})


def _with_place(rows: DataFrame) -> DataFrame:
    # The id only ever grows within a block, since one task reads a block in order.
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def _with_origin(rows: DataFrame) -> DataFrame:
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_size").alias("source_bytes"),
    )


def _as_read(rows: DataFrame) -> DataFrame:
    return rows


ADDED = {None: _as_read, "place": _with_place, "origin": _with_origin}


def read_catalog(
    spark: SparkSession,
    paths: str | Sequence[str],
    with_position: bool = False,
    partitions: T.StructType | None = None,
    add: str | None = None,
) -> DataFrame:
    """All rows of the files, in one scan; a header other than the schema's is an error.

    A cell that does not fit its type becomes null; a file with nothing but a
    header gives no rows; a missing path raises.  ``partitions`` names columns
    that are spelt in directory names (``load_year=2024/``).  ``with_position``
    adds the place of each row (file, block, row number), which gives "first
    row" a meaning when files are read in parallel.  Files then rank by path.
    ``add="origin"`` adds the path and size of each row's file.
    """
    schema = T.StructType(SCAN_SCHEMA.fields + (partitions.fields if partitions else []))
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .options(**CSV_OPTIONS)
        .csv([paths] if isinstance(paths, str) else list(paths))
    )
    return whole_counts(ADDED["place" if with_position else add](rows))


def headers_of(spark: SparkSession, files: Sequence[str]) -> dict[str, list[str]]:
    """The files that begin with each header line, by that line; files without a line are left out.

    No job: the driver, which lists the files for any scan, opens ``OPENED`` of them at a
    time and reads the first line, at most ``LONGEST_HEADER`` bytes of a file, whatever its size.
    """
    found: dict[str, list[str]] = {}
    with ThreadPoolExecutor(OPENED) as pool:
        for file, line in zip(files, pool.map(lambda file: first_line(spark, file, LONGEST_HEADER), files)):
            if line is not None:
                found.setdefault(line, []).append(file)
    return found


def headers(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, list[str]]:
    """``headers_of`` all files that a reader of these paths would read."""
    files = spark.read.text([paths] if isinstance(paths, str) else list(paths)).inputFiles()
    return headers_of(spark, sorted(unquote(file) for file in files))


def header_cells(line: str) -> list[str]:
    """The names in a header line."""
    return [cell.strip() for cell in next(csv.reader([line.removeprefix("\ufeff")]), [])]


def places_of_known(cells: Sequence[str]) -> dict[str, int]:
    """Where each known column stands: under its name, else under that name in other letters."""
    exact = {cell: at for at, cell in reversed(list(enumerate(cells)))}
    folded = {cell.lower(): at for at, cell in reversed(list(enumerate(cells)))}
    found = {name: exact.get(name, folded.get(name.lower())) for name in SCAN_SCHEMA.names}
    return {name: at for name, at in found.items() if at is not None}


def names_of_others(cells: Sequence[str], known: dict[str, int], taken: Sequence[str]) -> dict[int, str]:
    """Names for the further columns, by place.  One that is taken already, in any letters, gets a number."""
    used = {name.lower() for name in (*SCAN_SCHEMA.names, *RENAMES.values(), *taken, *POSITION, "source_file", "source_bytes")}
    found = {}
    for at, cell in enumerate(cells):
        if at in known.values():
            continue
        name, n = cell or "column", 1
        while (name if n == 1 else f"{name}_{n}").lower() in used:
            n += 1
        found[at] = name if n == 1 else f"{name}_{n}"
        used.add(found[at].lower())
    return found


def read_by_header(
    spark: SparkSession,
    paths: str | Sequence[str],
    with_position: bool = False,
    partitions: T.StructType | None = None,
    add: str | None = None,
    root: str | None = None,
    found: dict[str, list[str]] | None = None,
) -> DataFrame:
    """As ``read_catalog``, but columns go by each file's own header.

    Known columns may stand in any order, in any letters; those a file lacks are null.
    Further columns follow as text, null in files without them, and get a number if
    their name is taken.  One scan per distinct header, whose cells are read by their
    place.  Partition folders are those below ``root``, or the one path.  ``found``
    has what ``headers`` gives, if that is known already.
    """
    kept = [f.name for f in partitions.fields] if partitions else []
    parts = []
    for header, files in sorted((headers(spark, paths) if found is None else found).items()):
        cells = header_cells(header)
        known = places_of_known(cells)
        others = names_of_others(cells, known, kept)
        by_place = T.StructType([T.StructField(f"__{at}", T.StringType()) for at in range(len(cells))])
        by_place = T.StructType(by_place.fields + (partitions.fields if partitions else []))
        reader = spark.read.schema(by_place).option("header", True).option("mode", "PERMISSIVE").options(escape='"')
        if partitions:
            reader = reader.option("basePath", root or (paths if isinstance(paths, str) else paths[0]))
        rows = ADDED["place" if with_position else add](reader.csv(files))
        added = [c for c in rows.columns if c not in by_place.names]
        ours = [
            (F.col(f"__{known[f.name]}").try_cast(f.dataType) if f.name in known else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in SCAN_SCHEMA
        ]
        further = [F.col(f"__{at}").alias(name) for at, name in others.items()]
        parts.append(whole_counts(rows.select(*ours, *further, *added, *kept)))
    if not parts:  # files without a line
        return read_catalog(spark, paths, with_position, partitions, add)
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked


def require_rows(rows: DataFrame) -> DataFrame:
    """S3: raise when there is nothing to process."""
    if rows.isEmpty():
        raise EmptyCatalog("all files are empty: no data to process")
    return rows


def preview(rows: DataFrame, n_rows: int = 5) -> DataFrame:
    """T10."""
    return rows.limit(n_rows)


def stack(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The rows of frames with the same columns, matched by name."""
    for other in others:
        first = first.unionByName(other)
    return first
