"""Sharding: whole rows in whole shards, and no bucket split that fits."""

from __future__ import annotations

import collections
import random

from corpus_rows import documents, empty  # noqa: F401
from pyspark.sql import functions as F

from tremora.llm import sharding

random.seed(5)
LIMIT = 2000


def rows_written(spark, path):
    return spark.read.parquet(path)


def test_write_shards_writes_every_row_once(spark, tmp_path):
    rows = [(1, "a" * 900, "x"), (1, "b" * 900, "y"), (1, "a" * 900, "x")]  # one id, one size
    rows += [(2, "copy" * 200, str(k)) for k in range(9)]  # dealt over overflow pages
    rows += [(None, None, "n"), (None, None, "n"), (3, "", "e"), (4, "long" * 3000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    sharding.write_shards(docs, str(tmp_path / "out"), LIMIT)
    found = rows_written(spark, str(tmp_path / "out"))
    assert collections.Counter(tuple(r) for r in found.select("doc_id", "text", "shard_").collect()) == collections.Counter(rows)
    sizes = found.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"), F.count("*").alias("rows"))
    assert all(r.n <= LIMIT or r.rows == 1 for r in sizes.collect())
    files = collections.Counter(p.parent.name for p in (tmp_path / "out").glob("shard=*/*.parquet"))
    assert set(files.values()) == {1} and len(files) == sizes.count()


def test_write_shards_of_the_documents_and_of_none(spark, documents, empty, tmp_path):
    sharding.write_shards(documents, str(tmp_path / "out"), 50_000)
    found = rows_written(spark, str(tmp_path / "out"))
    placed = {r.doc_id: r.shard for r in sharding.shards(documents, 50_000).collect()}
    assert {r.doc_id: r["shard"] for r in found.select("doc_id", F.col("shard").cast("string").alias("shard")).collect()}.keys() == placed.keys()
    assert found.exceptAll(found.select(*documents.columns, "shard")).count() == 0
    assert found.select(*documents.columns).exceptAll(documents).count() == 0 == documents.exceptAll(found.select(*documents.columns)).count()
    sharding.write_shards(empty, str(tmp_path / "none"), LIMIT)


def test_only_buckets_over_the_limit_are_split(spark, documents):
    rows = [(i, "x" * random.choice([0, 10, 300, 1500])) for i in range(400)]
    for docs, limit in ((spark.createDataFrame(rows, "doc_id long, text string"), LIMIT), (documents, 50_000)):
        sizes, depths = collections.Counter(), {}
        for r in sharding.shards(docs, limit).collect():
            assert "-" not in r.shard and len(r.shard) == r.depth
            depths[r.shard] = r.depth
            for n in range(len(r.shard) + 1):
                sizes[r.shard[:n]] += r.n_bytes
        for shard in depths:
            assert sizes[shard] <= limit or sum(1 for other in depths if other.startswith(shard)) == 1
            assert all(sizes[shard[:n]] > limit for n in range(len(shard)))  # whatever stands above was too large
        assert not any(a != b and b.startswith(a) for a in depths for b in depths)
