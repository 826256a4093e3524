"""Near copies by five-word shingles: candidates from SimHashes of parts, decided by a long SimHash.

A text is the set of its hashed shingles.  Its fingerprint is a SimHash of ``BITS`` bits,
long enough to tell a Jaccard similarity of 0.8 (about 39 bits apart) from one of 0.6
(about 59).  No two blocks of such fingerprints need to agree at that distance, so candidates
come from smaller SimHashes: shingles are dealt to parts by the first bits of their hash,
3 to 6 shingles a part, and each of the first ``PARTS`` parts has a fingerprint of its own.
A part whose shingles are the same in two texts has the same fingerprint; of texts that are
similar by 0.8, one of 12 parts agrees in over 97 of 100 cases.  The number of parts follows the
size; a text a little above a step also has the fingerprints of the step below, so sizes
that differ by a quarter meet.

Texts that agree in a part lie in one sorted run.  Some members of the run are its pivots:
all distances to them are computed first, and pairs whose distances to any pivot differ by more
than ``RADIUS`` can't be near; the others are verified bit by bit, and by their sizes.  Links of a
spanning forest leave the run, never all pairs, and components follow by alternating stars.
Texts with the same shingles are one text from the start.

Defined results: null, empty and blank texts have no shingles and are copies of each other; a
text of fewer than five words is one shingle; rows that repeat an id are rows of their own,
null ids come last; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import byte_slices, settled
from tremora.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
WORDS = 4  # of 64 bits in a fingerprint
BITS = 64 * WORDS
RADIUS = 48  # bits; 95 of 100 pairs at a similarity of 0.8 are nearer, 1 of 20 at 0.6
PARTS = 12
PER_PART = 3  # shingles of a part, and up to twice as many
FEWEST = 3  # bits that deal shingles to parts, at least
PIVOTS = 8
PIECE = 1 << 12  # shingles whose bits are counted at a time
BLOCK = 1 << 20  # bytes of text at a time
PAIRS = 1 << 18  # pairs that are compared at a time


def _mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of 64-bit hashes."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _packed(ones: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Bits that are set in over half of n."""
    return np.packbits(2 * ones > n, axis=-1, bitorder="little").view("<u8")


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words; words as in the other fingerprints."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    last = stops[min(SHINGLE, len(words)) - 1 :]
    spans = zip(starts[: len(last)].tolist(), last.tolist())
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b]) for a, b in spans], np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS numbers of 64 bits."""
    found = np.zeros(WORDS, np.uint64)
    for word in range(WORDS):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), PIECE):
            ones += _bits(_mixed(hashes[at : at + PIECE], word)).sum(0, dtype=np.int64)
        found[word] = _packed(ones, len(hashes))[0]
    return found


def part_keys(hashes: np.ndarray) -> list[tuple[int, int]]:
    """(kind, fingerprint) of the first parts; kinds tell steps and parts apart."""
    n = len(hashes)
    if not n:
        return [(-1, 0)]
    step = max(FEWEST, int(n / PER_PART).bit_length() - 1)
    steps = [step]
    if step > FEWEST and n * SIMILARITY < PER_PART << step:
        steps.append(step - 1)
    found = []
    for bits in steps:
        part = hashes >> np.uint64(64 - bits)
        some = hashes[part < PARTS]
        if not len(some):
            continue
        part = part[: len(some)].astype(np.int64)  # sorted hashes, so the first parts come first
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        ones = np.add.reduceat(_bits(_mixed(some, WORDS)).astype(np.int64), starts, axis=0)
        counts = np.diff(starts, append=len(some))[:, None]
        prints = _packed(ones, counts).reshape(-1).view(np.int64)
        found += [(bits * PARTS + int(p), int(f)) for p, f in zip(part[starts], prints)]
    return found


def near(fps: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the texts i and j are near copies of each other."""
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    apart = np.bitwise_count(fps[i] ^ fps[j]).sum(1, dtype=np.int64)
    return (apart <= RADIUS) & (small >= SIMILARITY * large)


def run_forest(fps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each member of a run, the first member that it is connected with."""
    n = len(fps)
    label = np.arange(n)
    pivots = fps[np.linspace(0, n - 1, min(PIVOTS, n)).astype(int)]
    table = np.stack([np.bitwise_count(fps ^ pivot).sum(1, dtype=np.int16) for pivot in pivots], 1)

    def root(a: int) -> int:
        while label[a] != a:
            label[a] = label[label[a]]
            a = label[a]
        return a

    for step in range(1, n):
        for at in range(0, n - step, PAIRS):
            i = np.arange(at, min(n - step, at + PAIRS))
            i = i[label[i] != label[i + step]]
            for column in range(table.shape[1]):  # each pivot leaves fewer pairs for the next
                i = i[np.abs(table[i, column] - table[i + step, column]) <= RADIUS]
            for a in i[near(fps, sizes, i, i + step)].tolist():
                a, b = sorted((root(a), root(a + step)))
                label[b] = a
        if step & (step - 1) == 0:
            while not np.array_equal(label, label[label]):
                label = label[label]
            if not label.any():  # the run is one component
                break
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label


def sketched(rows: DataFrame) -> DataFrame:
    """(__row, doc_id) of the rows with their fingerprint, its size, and the keys of its parts."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in byte_slices(batch, "text", BLOCK):
                sets = [shingles(text) for text in some.column("text").to_pylist()]
                keys = [part_keys(hashes) for hashes in sets]
                stops = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                columns = (pa.array([key[i] for found in keys for key in found], kind) for i, kind in enumerate((pa.int32(), pa.int64())))
                pairs = pa.StructArray.from_arrays(list(columns), ["kind", "part"])
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("__row"),
                        pa.array([fingerprint(hashes).tobytes() for hashes in sets], pa.binary()),
                        pa.array(map(len, sets), pa.int64()),
                        pa.array([int(hashes.sum(dtype=np.uint64).astype(np.int64)) for hashes in sets], pa.int64()),
                        pa.ListArray.from_arrays(stops, pairs),
                    ],
                    names=["__row", "__fp", "__n", "__total", "__keys"],
                )
            pa.default_memory_pool().release_unused()

    schema = "__row long, __fp binary, __n long, __total long, __keys array<struct<kind: int, part: long>>"
    return rows.select("__row", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(sketch, schema)


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links inside runs, from rows sorted by (kind, part); a run may span batches."""
    held: list[tuple[np.ndarray, ...]] = []
    key = None

    def links(fps: np.ndarray, sizes: np.ndarray, nodes: np.ndarray) -> pd.DataFrame:
        label = run_forest(fps, sizes)
        other = label != np.arange(len(label))
        return pd.DataFrame({"u": nodes[other], "v": nodes[label[other]]})

    for batch in batches:
        kind, part = batch["kind"].to_numpy(), batch["part"].to_numpy()
        fps = np.frombuffer(b"".join(batch["__fp"]), "<u8").reshape(-1, WORDS)
        data = fps, batch["__n"].to_numpy(), batch["__node"].to_numpy()
        change = np.ones(len(batch), bool)
        change[1:] = (kind[1:] != kind[:-1]) | (part[1:] != part[:-1])
        starts = np.flatnonzero(change)
        stops = np.append(starts[1:], len(batch))
        first = int(bool(held) and key == (kind[0], part[0]))
        if first:
            held.append(tuple(x[: stops[0]] for x in data))
        if len(starts) > first:  # the run that was held is whole; the batch's last one is held now
            if held:
                yield links(*map(np.concatenate, zip(*held)))
            whole = slice(first, len(starts) - 1)
            some = stops[whole] - starts[whole] > 1
            for low, high in zip(starts[whole][some].tolist(), stops[whole][some].tolist()):
                yield links(*(x[low:high] for x in data))
            held, key = [tuple(x[starts[-1] :] for x in data)], (kind[-1], part[-1])
    if held:
        yield links(*map(np.concatenate, zip(*held)))


def near_copy_links(texts: DataFrame) -> DataFrame:
    """(u, v): links that connect what is connected, for rows (__node, __fp, __n, __keys)."""
    runs = (
        texts.select("__node", "__fp", "__n", F.inline("__keys"))
        .repartition("kind", "part")
        .sortWithinPartitions("kind", "part", "__n", "__node")
    )
    return runs.mapInPandas(_links, "u long, v long")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each group the row with the smallest id (of several
    such rows, one), with all columns."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    own = {name.lower(): ours for name, ours in zip(docs.columns, names)}
    # Written with a number per row; fingerprints are written once and meet their rows by it.
    rows = settled(docs.toDF(*names).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    text = F.col(own["text"]).cast("string")
    sketches = settled(sketched(rows.select("__row", text.alias("text"))), "sketches")
    node = F.xxhash64("__fp", "__n", "__total")
    noded = sketches.withColumn("__node", node)
    texts = noded.groupBy("__node").agg(
        F.first("__fp").alias("__fp"), F.first("__n").alias("__n"), F.first("__keys").alias("__keys")
    )
    roots = components(near_copy_links(texts)).withColumnRenamed("u", "__node")
    ids = rows.select("__row", F.col(own["doc_id"]).alias("__id")).join(noded.select("__row", "__node"), "__row")
    first = F.min(F.struct(F.col("__id").isNull(), "__id", "__row")).alias("__first")
    # The first row of each text, then of each group of texts: a group of many copies never meets in one task.
    by_text = ids.groupBy("__node").agg(first).join(roots, "__node", "left")
    groups = by_text.groupBy(F.coalesce("root", "__node")).agg(F.min("__first").alias("__first"))
    kept = settled(groups.select(F.col("__first.__row").alias("__row")), "kept")
    # One plan at every size: what is kept grows with the corpus, so no size of its is a bound.
    chosen = rows.join(kept.hint("merge"), "__row", "left_semi")
    return chosen.select(*[F.col(ours).alias(name) for ours, name in zip(names, docs.columns)])
