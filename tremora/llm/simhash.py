"""SimHash near-duplicates, found with pivot distance tables.

Fingerprints are 64 bits over three-word shingles.  Distinct fingerprints are
linked if at most ``RADIUS`` bits differ.  Cut into ``BLOCKS`` blocks, two such
fingerprints agree in at least ``BLOCKS - RADIUS`` whole blocks; fingerprints
meet under every choice of so many blocks, about 26 bits, in sorted runs.  In a
run, each has its Hamming distances to ``PIVOTS`` reference fingerprints, a row
of small numbers.  By the triangle inequality the distances of linked
fingerprints differ by at most ``RADIUS`` in every column, so a pair with a
larger difference in any column is discarded, and the rest is verified bit by
bit.  A run is passed through in pieces, pairs are not emitted: only links of a
spanning forest leave it, at most one per fingerprint.  Components follow by
alternating stars.

Defined results: a null, empty or blank text has fingerprint 0, linked like any
other; rows that repeat an id are rows of one document; null ids are never the
smallest unless a component has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import settled
from tremora.llm.components import components

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 3
BLOCKS = 5
PIVOTS = 16
PIECE = 1 << 16  # shingles whose bits are counted at a time


def fingerprint(text: bytes | None) -> int:
    """Of one text in UTF-8, as a signed 64-bit number."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and white space of ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    last = stops[min(SHINGLE, len(words)) - 1 :]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, PIECE):
        spans = zip(starts[at : min(n, at + PIECE)].tolist(), last[at : at + PIECE].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(text: Column) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint).astype("int64")

    return of(F.coalesce(text, F.lit("")).cast("binary"))


def _pivots() -> np.ndarray:
    """Reference fingerprints, spread evenly: hashes of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(PIVOTS)], np.uint64)


def _block_masks() -> list[int]:
    """For every choice of blocks that must agree, the mask of their bits, signed."""
    edges = [round(BITS * i / BLOCKS) for i in range(BLOCKS + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    chosen = [sum(c) for c in combinations(masks, BLOCKS - RADIUS)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in chosen]


def forest(run: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """For each fingerprint, the index of the smallest one it is connected with inside its run.

    ``run`` numbers the runs 0, 1, 2, ...; equal numbers are neighbours.
    """
    n = len(fps)
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    first = starts[run]
    label = np.arange(n)
    table = np.bitwise_count(fps[:, None] ^ _pivots()[None, :]).astype(np.int8)
    stop = np.searchsorted(run, run, side="right")
    active = np.flatnonzero(stop > np.arange(n) + 1)
    step = 1
    while len(active):
        i, j = active, active + step
        near = label[i] != label[j]
        i, j = i[near], j[near]
        for column in range(PIVOTS):  # each column leaves fewer pairs for the next one
            near = np.abs(table[i, column] - table[j, column]) <= RADIUS
            i, j = i[near], j[near]
        linked = np.bitwise_count(fps[i] ^ fps[j]) <= RADIUS
        pairs = list(zip(i[linked].tolist(), j[linked].tolist()))
        for a, b in pairs:
            while label[a] != a:
                a = label[a]
            while label[b] != b:
                b = label[b]
            if a != b:
                label[max(a, b)] = min(a, b)
        while pairs and not np.array_equal(label, label[label]):
            label = label[label]
        step += 1
        active = active[stop[active] > active + step]
        if step & (step - 1) == 0 and len(active):  # runs that are one component are done
            apart = np.add.reduceat(label != label[first], starts)
            active = active[apart[run[active]] > 0]
    return label


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links inside runs, from rows sorted by (choice, part); a run may span batches."""
    rest = None

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        changes = (rows["choice"].diff().ne(0) | rows["part"].diff().ne(0)).to_numpy()
        values = rows["fp"].to_numpy()
        label = forest(np.cumsum(changes) - 1, values.view(np.uint64))
        other = label != np.arange(len(label))
        return pd.DataFrame({"u": values[other], "v": values[label[other]]})

    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        end = rows.iloc[-1]
        open_ = (rows["choice"] == end["choice"]) & (rows["part"] == end["part"])
        rest = rows[open_].reset_index(drop=True)
        if not open_.all():
            yield links(rows[~open_].reset_index(drop=True))
    if rest is not None and len(rest):
        yield links(rest)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(u, v): links that connect what is connected, of distinct fingerprints in column ``fp``."""
    choices = F.array(
        *[
            F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("part"))
            for i, m in enumerate(_block_masks())
        ]
    )
    runs = (
        distinct.select("fp", F.inline(choices))
        .repartition("choice", "part")
        .sortWithinPartitions("choice", "part", "fp")
    )
    return runs.mapInPandas(_linked, "u long, v long")


def fingerprint_components(rows: DataFrame) -> DataFrame:
    """(fp, root, component_id) for rows (doc_id, fp)."""
    lowest = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("__low")), "fingerprints")
    roots = components(fingerprint_links(lowest.select("fp"))).withColumnRenamed("u", "fp")
    rooted = settled(
        lowest.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted"
    )
    # Written before it is joined: the members of a large component are split then.
    ids = settled(rooted.groupBy("root").agg(F.min("__low").alias("component_id")), "ids")
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    rows = settled(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")), "documents")
    found = fingerprint_components(rows)
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(found, "fp").select("doc_id", shown.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest id
    (of several such rows, one), with all columns."""
    rows = docs.withColumn("__fp", fingerprints(F.col("text")))
    found = settled(
        fingerprint_components(rows.select("doc_id", F.col("__fp").alias("fp"))).select(
            F.col("fp").alias("__fp"), F.col("root").alias("__root"), F.col("component_id").alias("__component")
        ),
        "components",
    )
    return (
        rows.join(found, "__fp")
        .where(F.col("doc_id").eqNullSafe(F.col("__component")))
        # One row already, unless ids repeat or are null; components without any id are told apart by root.
        .dropDuplicates(["__root"])
        .select(*docs.columns)
    )
