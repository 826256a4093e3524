"""Sharding by extendible hashing.

A shard is a prefix of the bits of a document's hash.  The directory is indexed
by the first bits; a bucket holds every document under its prefix, and only
buckets over the byte limit are split on another bit.  Sizes come from a
histogram over the directory's cells, never from lists of documents; cells that
are too large by themselves go through further rounds with more bits.

Defined results: a null text has 0 bytes; documents that agree in id and text
have one hash, which no bit can split, so where such copies exceed the limit
they fill numbered overflow pages of as many as fit; a single document over the
limit is a shard by itself, marked ``oversize``; an empty table has no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import ranked, settled

LIMIT = 8 << 20  # bytes of a shard
SPARE_BITS = 4  # bits of a round beyond those that even buckets would need
MAX_ROUND_BITS = 20
HASH_BITS = 64


def _prefix(bits: int):
    return F.shiftrightunsigned("__hash", HASH_BITS - bits) if bits else F.lit(0).cast("long")


def _directory(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, depth, shard_bytes): the shortest prefix from ``low`` bits on that fits; null
    depth for a cell that doesn't fit at ``high`` bits."""
    levels = cells.withColumn(
        "__depth", F.explode(F.sequence(F.lit(low), F.lit(high)))
    ).withColumn("__bucket", F.expr(f"shiftright(__cell, {high} - __depth)") if high < 64 else
                 F.expr("shiftrightunsigned(__cell, 64 - __depth)"))
    levels = levels.withColumn("__bucket", F.when(F.col("__depth") == 0, 0).otherwise(F.col("__bucket")))
    sums = levels.groupBy("__depth", "__bucket").agg(
        F.sum("__bytes").alias("__bytes"), F.sum("__rows").alias("__rows")
    )
    fits = sums.where((F.col("__bytes") <= limit) | (F.col("__rows") == 1))
    leaves = (
        levels.select("__cell", "__depth", "__bucket")
        .join(fits, ["__depth", "__bucket"])
        .groupBy("__cell")
        .agg(F.min(F.struct("__depth", "__bytes")).alias("__leaf"))
    )
    return settled(
        cells.select("__cell").join(leaves, "__cell", "left").select(
            "__cell",
            F.col("__leaf.__depth").alias("__depth"),
            F.col("__leaf.__bytes").alias("__shard_bytes"),
        ),
        "directory",
    )


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, shard (its bits, and after a dash its overflow page),
    depth, shard_bytes, oversize."""
    return _placed(docs.select("doc_id", "text", F.lit(None).cast("long").alias("__row")), limit).drop("__row")


def _placed(docs: DataFrame, limit: int) -> DataFrame:
    """``shards`` of rows that have a number, with that number."""
    rows = settled(
        docs.select(
            "doc_id",
            "__row",
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
            F.xxhash64("doc_id", "text").alias("__hash"),
        ),
        "hashes",
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    done, bits = None, 0
    while True:
        wanted = max(1, math.ceil(math.log2(total / limit + 1)) + SPARE_BITS) if total else 1
        low, bits = (bits + 1 if bits else 0), min(HASH_BITS, bits + min(wanted, MAX_ROUND_BITS))
        rows = rows.withColumn("__cell", _prefix(bits))
        cells = rows.groupBy("__cell").agg(
            F.sum("n_bytes").alias("__bytes"), F.count(F.lit(1)).alias("__rows")
        )
        directory = _directory(settled(cells, "cells"), low, bits, limit)
        found = rows.join(directory, "__cell").drop("__cell")
        fit = found.where(F.col("__depth").isNotNull()).withColumn("__page", F.lit(None).cast("long"))
        done = fit if done is None else done.unionByName(fit)
        total = (
            rows.join(directory.where(F.col("__depth").isNull()), "__cell", "left_semi")
            .agg(F.sum("n_bytes")).first()[0]
        )
        if not total:
            break
        rows = found.where(F.col("__depth").isNull()).drop("__depth", "__shard_bytes")
        if bits == HASH_BITS:
            done = done.unionByName(_overflow(rows, limit))
            break
        rows = settled(rows, "deeper")
    binary = F.lpad(F.bin(F.col("__hash")), HASH_BITS, "0")
    shard = F.substring(binary, F.lit(1), F.col("__depth"))
    page = F.when(F.col("__page").isNull(), "").otherwise(F.concat(F.lit("-"), F.col("__page")))
    return done.select(
        "doc_id",
        "__row",
        "n_bytes",
        F.concat(shard, page).alias("shard"),
        F.col("__depth").cast("int").alias("depth"),
        F.col("__shard_bytes").alias("shard_bytes"),
        (F.col("__shard_bytes") > limit).alias("oversize"),
    )


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Pages of rows that have one hash, hence one size."""
    per_page = F.greatest(F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))), F.lit(1))
    placed = ranked(rows, ["__hash", "n_bytes"], "__place")
    paged = settled(placed.withColumn("__page", F.floor(F.col("__place") / per_page)).drop("__place"), "pages")
    sums = settled(
        paged.groupBy("__hash", "__page").agg(F.sum("n_bytes").alias("__shard_bytes")), "page-sums"
    )
    return (
        paged.join(sums, ["__hash", "__page"])
        .withColumn("__depth", F.lit(HASH_BITS))
        .select("doc_id", "__row", "n_bytes", "__hash", "__depth", "__shard_bytes", "__page")
    )


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """The documents as Parquet, one folder and one file per shard, every row once.

    Rows get a number before they are placed, and shard and row meet by it, so rows that
    repeat an id or a text, also ones dealt over overflow pages, are written as often as they
    are given.  A shard is at most ``limit`` bytes of text, or one longer document, for one task.
    """
    names = [f"__{i}" for i in range(len(docs.columns))]
    rows = settled(docs.toDF(*names).withColumn("__row", F.monotonically_increasing_id()), "rows")
    at = {name.lower(): own for name, own in zip(docs.columns, names)}
    placed = _placed(rows.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"), "__row"), limit)
    shown = rows.join(placed.select("__row", "shard"), "__row").drop("__row")
    # A column of the documents by this name would stand for the folder; it is written as ``shard_``.
    renamed = [f"{name}_" if name.lower() == "shard" else name for name in docs.columns]
    shown = shown.select(*[F.col(own).alias(name) for own, name in zip(names, renamed)], "shard")
    shown.repartition("shard").write.partitionBy("shard").parquet(path)
