"""Exact top-k search by inner product with vector-approximation files.

Vectors are rows of whole numbers.  A block holds a few thousand of them in two
parts: the approximation, one byte per component, the cell of ``2 ** shift``
values that it lies in, and the exact components.  The shift is the smallest with
which a block's cells fit in a byte, ``CELL_BITS`` at least.  For a block of
queries, one pass over the approximations bounds every score from below and above.  The k-th
largest lower bound rules out what can't be among the k best; the rest is read
exactly, in the order of the upper bounds, until the k-th best score is above
the next upper bound, so no vector that was not read can belong to the result.

Queries and vectors meet in blocks, on a grid of slices, so neither side is
broadcast and each task holds one block of each; only k rows per query and block
go on.

Defined results: vectors that are null, empty, or hold a null or a component
that isn't finite, and rows without an id, take no part; vectors of different
lengths are never compared; rows that repeat an id are rows of their own, and a
query's own row alone is left out; fewer than k candidates are all returned.
Scores are exact as long as sums of products fit in 63 bits; beyond, they are out of range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremora.llm.common import settled

SCALE = 64
K = 20
EVERY = 20  # ids divisible by this are queries
CELL_BITS = 1  # at least; a cell holds 2 ** CELL_BITS values
BLOCK = 4096  # vectors of a block
QUERY_BLOCK = 512
SLICES = 64  # of either side of the grid, at most
READ = 64  # exact vectors read at a time

_BLOCK_SCHEMA = "dim int, n int, rows binary, ids binary, shift int, cells binary, exact binary"


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(row, vec_id, vector) of the rows that take part; components become floor(SCALE * x)."""
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    kept = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
    table = settled(kept.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("vector")), "vectors")
    return table.withColumn("row", F.monotonically_increasing_id())


def _blocks(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of at most so many vectors of one length, numbered."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(rows: list) -> pd.DataFrame:
            exact = np.stack([v for _, _, v in rows]).astype(np.int64)
            widest = max(int(exact.max()), -int(exact.min()) - 1)
            shift = max(CELL_BITS, widest.bit_length() - 7)
            cells = (exact >> shift).astype(np.int8).tobytes()
            exact = exact.astype(np.int16 if widest < 1 << 15 else np.int64)
            ids = [np.array([r[i] for r in rows], np.int64).tobytes() for i in (0, 1)]
            return pd.DataFrame(
                [(exact.shape[1], len(rows), *ids, shift, cells, exact.tobytes())],
                columns=["dim", "n", "rows", "ids", "shift", "cells", "exact"],
            )

        waiting: dict[int, list] = {}
        for batch in batches:
            for row, vec_id, vector in zip(batch["row"], batch["vec_id"], batch["vector"]):
                same = waiting.setdefault(len(vector), [])
                same.append((row, vec_id, np.asarray(vector)))
                if len(same) == size:
                    yield block(waiting.pop(len(vector)))
        for same in waiting.values():
            yield block(same)

    packed = settled(vectors.mapInPandas(pack, _BLOCK_SCHEMA), name)
    return packed.withColumn("block", F.monotonically_increasing_id())


def _matrix(part: bytes, n: int, dim: int) -> np.ndarray:
    kind = np.int16 if len(part) == 2 * n * dim else np.int64
    return np.frombuffer(part, kind).reshape(n, dim)


def search_block(q: dict, b: dict, k: int) -> Iterator[tuple]:
    """(query row, query id, vector id, score) of the k best of a block, for each query."""
    queries = _matrix(q["exact"], q["n"], q["dim"]).astype(np.float64)
    cells = np.frombuffer(b["cells"], np.int8).reshape(b["n"], b["dim"]).astype(np.float64)
    exact = _matrix(b["exact"], b["n"], b["dim"]).astype(np.int64)
    q_rows, q_ids = np.frombuffer(q["rows"], np.int64), np.frombuffer(q["ids"], np.int64)
    rows, ids = np.frombuffer(b["rows"], np.int64), np.frombuffer(b["ids"], np.int64)
    width = float((1 << b["shift"]) - 1)
    base = queries @ np.ldexp(cells, b["shift"]).T
    # Sums of floating point numbers are exact for small components; for others, the bounds give way.
    total = np.abs(queries).sum(1) * np.ldexp(129.0, b["shift"])
    blur = np.where(total < 1 << 52, 0, total * b["dim"] * 2.0**-51)
    above = width * np.maximum(queries, 0).sum(1) + blur
    below = width * np.minimum(queries, 0).sum(1) - blur
    where = {row: i for i, row in enumerate(rows.tolist())}
    for i in range(len(queries)):
        upper, lower = base[i] + above[i], base[i] + below[i]
        own = where.get(int(q_rows[i]))
        if own is not None:
            upper[own] = lower[own] = -np.inf
        n = len(upper) - (own is not None)
        if not n:
            continue
        least = np.partition(lower, -min(k, n))[-min(k, n)]
        maybe = np.flatnonzero((upper >= least) & (upper > -np.inf))
        maybe = maybe[np.argsort(-upper[maybe], kind="stable")]
        query = queries[i].astype(np.int64)
        found, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for at in range(0, len(maybe), READ):
            if len(scores) >= k and scores[k - 1] > upper[maybe[at]]:
                break
            read = maybe[at : at + READ]
            found = np.concatenate([found, read])
            scores = np.concatenate([scores, exact[read] @ query])
            best = np.lexsort((ids[found], -scores))[:k]
            found, scores = found[best], scores[best]
        for j, score in zip(found.tolist(), scores.tolist()):
            yield int(q_rows[i]), int(q_ids[i]), int(ids[j]), score


def top_k(rows: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of every query, ties to smaller ids."""
    vectors = whole_vectors(rows)
    blocks = _blocks(vectors, BLOCK, "va-file")
    asked = _blocks(vectors.where(F.pmod("vec_id", F.lit(every)) == 0), QUERY_BLOCK, "queries")

    def searched(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = ("n", "dim", "rows", "ids", "shift", "cells", "exact")
        for batch in pairs:
            for pair in batch.to_dict("records"):
                found = search_block({p: pair[f"q_{p}"] for p in parts if p not in ("shift", "cells")}, {p: pair[p] for p in parts}, k)
                yield pd.DataFrame(found, columns=["q_row", "query_id", "vec_id", "score"], dtype="int64")

    n_blocks, n_asked = (min(SLICES, max(1, x.count())) for x in (blocks, asked))
    left = asked.select(
        *[F.col(c).alias(f"q_{c}") for c in ("dim", "n", "rows", "ids", "exact")],
        F.pmod(F.hash("block"), F.lit(n_asked)).alias("across"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("down"),
    )
    right = blocks.withColumn("down", F.pmod(F.hash("block"), F.lit(n_blocks))).withColumn(
        "across", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)))
    )
    pairs = left.join(
        right.drop("block"),
        (left["across"] == right["across"]) & (left["down"] == right["down"]) & (left["q_dim"] == right["dim"]),
    ).drop("across", "down")
    found = pairs.mapInPandas(searched, "q_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
