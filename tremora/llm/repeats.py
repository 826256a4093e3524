"""Suffix-array deduplication: long passages that occur more than once are cut out.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else.  Sorting every suffix would move the corpus hundreds of times over, so
suffixes are sorted at anchors only: every stretch of ``reach`` possible starts
has one, its leftmost smallest byte hash, so that equal strings have their
anchor at the same place.  An anchor stands for the starts that chose it; what
those cover is its content, and the ``core`` bytes after it are common to all.

1. Anchors are found in one pass; texts are kept compressed.
2. Anchors whose core occurs once are dropped; of equal contents one is kept,
   and their number: pre-aggregated counts, by hash, so a passage that a third
   of all documents share is one row from here on.
3. Where one core has several contents, their suffixes are sorted: each task
   writes front-coded sorted runs, which are exchanged and merged by loser trees
   that never compare a known prefix again (``merge``).  Neighbours that share
   the core form groups, and inside a group the strings of ``length`` bytes
   around the anchors are compared.  Cores with over ``HOT`` contents don't meet
   in one task: their strings are counted by grouped aggregation instead.
4. Repeated starts become spans of each document, and the rest is its text.

Hashes have 64 bits, those of contents go with that of their core (128 bits),
those of strings with their core's group.

Defined results: a null text is empty; shorter texts than ``length`` bytes are
never cut; rows that repeat an id are documents of their own; matches inside one
document count, also where they overlap; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import settled
from tremora.llm.merge import front_coded, merged

LENGTH = 400
SHORTEST = 32  # bytes of a string: an anchor's hash takes 8, and its core must hold them
HOT = 20_000  # contents of one core beyond which they are counted, not merged
RUN_BYTES = 32 << 20  # of strings that a task sorts at a time
BUCKET_ROWS = 10_000  # contents that a merging task gets, about
GROUP_ROWS = 4_096  # contents whose strings are compared at a time, or one group's
PIECE_ROWS, PIECE_BYTES = 1_000, 8 << 20  # of texts that a task hands over at a time, or one text

_FACTOR = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def reach_of(length: int) -> int:
    """Starts of which one anchor at least is chosen."""
    return length * 16 // 25


def core_of(length: int) -> int:
    """Bytes from an anchor on that all strings hold whose anchor it is."""
    return length - reach_of(length) + 1


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor) for every anchor of a text, in order."""
    n = len(text) - length + 1  # starts
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    reach = reach_of(length)
    last = n + reach - 1
    data = np.frombuffer(text, np.uint8, last + 7)
    eights = np.lib.stride_tricks.sliding_window_view(data, 8)
    hashes = np.ascontiguousarray(eights).view("<u8").ravel() * np.uint64(_FACTOR)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(_BASE)
    # Hash first, place second: the smallest of a stretch is the leftmost smallest hash.
    keys = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(last, dtype=np.uint64)
    blocks = np.full(-(-last // reach) * reach, np.iinfo(np.uint64).max, np.uint64)
    blocks[:last] = keys
    blocks = blocks.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = np.minimum(back[:n], ahead[reach - 1 : reach - 1 + n]) & np.uint64(0xFFFFFFFF)
    chosen = chosen.astype(np.int64)
    low = np.flatnonzero(np.diff(chosen, prepend=-1))
    high = np.append(low[1:] - 1, n - 1)
    return low, high, chosen[low]


def _hash(part: bytes, seed: int) -> int:
    """Signed, for a column."""
    value = xxhash.xxh3_64_intdigest(part, seed)
    return value - (1 << 64) if value >> 63 else value


def _pieces(rows: pd.DataFrame, sizes: np.ndarray) -> Iterator[pd.DataFrame]:
    """The rows, so many at a time that their texts stay within the bounds."""
    stops = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(rows):
        most = (stops[at - 1] if at else 0) + PIECE_BYTES
        stop = min(at + PIECE_ROWS, max(at + 1, int(np.searchsorted(stops, most, side="right"))))
        yield rows.iloc[at:stop]
        at = stop


_PREPARED = (
    "n_bytes long, packed binary, lows array<int>, highs array<int>, places array<int>, "
    "cores array<long>, contents array<long>"
)


def _prepare(length: int):
    """Anchors and compressed texts, from rows (row, doc_id, text)."""
    core_bytes = core_of(length)

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for piece in _pieces(batch, batch["text"].map(len).to_numpy(np.int64)):
                rows = []
                for text in piece["text"]:
                    low, high, place = anchors(text, length)
                    spans = list(zip(low.tolist(), high.tolist(), place.tolist()))
                    cores = [_hash(text[a : a + core_bytes], 1) for _, _, a in spans]
                    contents = [_hash(text[i : j + length], 2) for i, j, _ in spans]
                    rows.append((len(text), packer.compress(text), low, high, place, cores, contents))
                done = pd.DataFrame(rows, columns=[x.split()[0] for x in _PREPARED.split(", ")])
                yield done.assign(row=piece["row"].to_numpy(), doc_id=piece["doc_id"].to_numpy())

    return prepare


def _wanted(rows: pd.DataFrame, length: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(core, content, starts, bytes before the anchor, bytes from it on) of wanted contents."""
    unpack = zstandard.ZstdDecompressor()
    for packed, wanted in zip(rows["packed"], rows["wanted"]):
        text = unpack.decompress(packed)
        for w in wanted:
            low, high, place = w["low"], w["high"], w["place"]
            yield w["core"], w["content"], high - low + 1, text[low:place], text[place : high + length]


def _runs(n_buckets: int, length: int):
    """Sorted runs per bucket of cores, from rows (packed, wanted)."""

    def encoded(entries: dict[int, list]) -> pd.DataFrame:
        return pd.DataFrame(
            [(bucket, front_coded(some)) for bucket, some in entries.items()], columns=["bucket", "run"]
        )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries: dict[int, list] = {}
        held = 0
        for batch in batches:
            for core, content, starts, before, after in _wanted(batch, length):
                carried = np.array([core, starts], "<i8").tobytes() + before
                entries.setdefault(core % n_buckets, []).append((after, carried, content))
                held += len(before) + len(after)
                if held >= RUN_BYTES:
                    yield encoded(entries)
                    entries, held = {}, 0
        yield encoded(entries)

    return write


def string_hashes(
    texts: list[bytes], starts: list[int], length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, hash) of the first ``starts`` strings of that length of each text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    powers = np.ones(n, np.uint64)
    inverse = np.ones(n, np.uint64)
    powers[1:], inverse[1:] = np.uint64(_BASE), np.uint64(_INVERSE)
    powers, inverse = np.multiply.accumulate(powers), np.multiply.accumulate(inverse)
    values = np.array([xxhash.xxh64_intdigest(bytes([b]), 3) for b in range(256)], np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * powers, out=sums[1:])
    firsts = np.cumsum([0, *map(len, texts)])[:-1]
    number = np.repeat(np.arange(len(texts)), starts)
    start = np.arange(len(number)) - np.repeat(np.cumsum([0, *starts])[:-1], starts)
    at = firsts[number] + start
    found = (sums[at + length] - sums[at]) * inverse[at]
    return number, start, found ^ (found >> np.uint64(31))


def _stretches(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of runs of consecutive ascending numbers."""
    first = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
    last = np.append(first[1:] - 1, len(starts) - 1)
    return list(zip(starts[first].tolist(), starts[last].tolist()))


_FOUND = "core long, content long, starts array<struct<first:int,last:int>>"


def _resolve(group: list[tuple[int, int, int, bytes]], length: int) -> list[tuple]:
    """(core, content, repeated starts) of contents in which some string occurs again."""
    number, start, found = string_hashes([g[3] for g in group], [g[2] for g in group], length)
    _, inverse, counts = np.unique(found, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    number, start = number[again], start[again]
    rows = []
    cuts = np.flatnonzero(np.diff(number, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(number)]):
        core, content = group[number[a]][:2]
        rows.append((core, content, [{"first": i, "last": j} for i, j in _stretches(start[a:b])]))
    return rows


def _merge(length: int):
    """Repeated starts of the contents of a bucket, from its sorted runs."""
    core_bytes = core_of(length)

    def merge(bucket: pd.DataFrame) -> pd.DataFrame:
        rows, batch, group = [], [], []

        def close(everything: bool = False) -> None:
            nonlocal batch, group
            if len(group) > 1:
                batch += group
            group = []
            if batch and (everything or len(batch) >= GROUP_ROWS):
                rows.extend(_resolve(batch, length))
                batch = []

        for shared, (after, carried, content) in merged(bucket["run"].tolist()):
            if shared < core_bytes:
                close()
            core, starts = np.frombuffer(carried, "<i8", 2).tolist()
            group.append((core, content, starts, carried[16:] + after))
        close(everything=True)
        return pd.DataFrame(rows, columns=["core", "content", "starts"])

    return merge


def _strings(length: int):
    """(core, content, start, hash): one row per string, for cores with too many contents."""

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                some = list(_wanted(batch.iloc[at : at + 100], length))
                if not some:
                    continue
                number, start, found = string_hashes([b + a for *_, b, a in some], [s[2] for s in some], length)
                yield pd.DataFrame(
                    {
                        "core": np.array([s[0] for s in some])[number],
                        "content": np.array([s[1] for s in some])[number],
                        "start": start,
                        "hash": found.view(np.int64),
                    }
                )

    return strings


def _counted(cut: DataFrame, length: int) -> DataFrame:
    """The result of ``_merge`` for hot cores, by grouped aggregation."""
    each = cut.mapInPandas(_strings(length), "core long, content long, start int, hash long")
    strings = settled(each, "strings")
    again = strings.groupBy("core", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    same = F.struct(F.col("start").alias("first"), F.col("start").alias("last"))
    return (
        strings.join(again, ["core", "hash"])
        .groupBy("core", "content")
        .agg(F.collect_list(same).alias("starts"))  # as many as an anchor has starts, at most
    )


_CUT = "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>"


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is left of each text and the spans cut out, from rows (doc_id, n_bytes, packed, spans)."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for piece in _pieces(batch, batch["n_bytes"].to_numpy()):
            kept, cut = [], []
            for packed, spans in zip(piece["packed"], piece["spans"]):
                text = unpack.decompress(packed)
                gone: list[dict] = []
                for start, end in sorted((s["start"], s["end"]) for s in (() if spans is None else spans)):
                    if gone and start <= gone[-1]["end"]:  # spans that touch are one
                        gone[-1]["end"] = max(gone[-1]["end"], end)
                    else:
                        gone.append({"start": start, "end": end})
                edges = [0, *(x for s in gone for x in (s["start"], s["end"])), len(text)]
                kept.append(b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2])) if gone else text)
                cut.append(gone)
            yield piece[["doc_id", "n_bytes"]].assign(kept=kept, spans=cut)


def cut_texts(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, kept (bytes), spans (start, end) of the bytes cut out, in order."""
    if length < SHORTEST:
        raise ValueError(f"strings have {SHORTEST} bytes at least, not {length}")
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    )
    prepared = settled(texts.mapInPandas(_prepare(length), f"row long, doc_id long, {_PREPARED}"), "prepared")
    each = F.inline(
        F.arrays_zip(
            F.col("lows").alias("low"),
            F.col("highs").alias("high"),
            F.col("places").alias("place"),
            F.col("cores").alias("core"),
            F.col("contents").alias("content"),
        )
    )
    # Written before they are joined: a join of plain shuffles is one that Spark can split by skew.
    repeated = settled(
        prepared.select(F.explode("cores").alias("core"))
        .groupBy("core")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("core"),
        "cores",
    )
    shared = settled(prepared.select("row", each).join(repeated, "core"), "anchors")
    contents = settled(
        shared.groupBy("core", "content").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "low", "high", "place")).alias("at")
        ),
        "contents",
    )
    variants = settled(
        contents.groupBy("core").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1"), "variants"
    )
    wanted = settled(
        contents.join(variants, "core")
        .select((F.col("variants") > hot).alias("hot"), "at.row", "core", "content", "at.low", "at.high", "at.place")
        .groupBy("row", "hot")
        .agg(F.collect_list(F.struct("core", "content", "low", "high", "place")).alias("wanted")),
        "wanted",
    )
    n_wanted, n_hot = wanted.agg(
        F.coalesce(F.sum(F.size("wanted")), F.lit(0)), F.count_if(F.col("hot"))
    ).first()
    cut = prepared.select("row", "packed").join(wanted, "row").select("packed", "wanted", "hot")
    n_buckets = max(1, n_wanted // BUCKET_ROWS)
    runs = cut.where(~F.col("hot")).drop("hot").mapInPandas(_runs(n_buckets, length), "bucket long, run binary")
    found = runs.groupBy("bucket").applyInPandas(_merge(length), _FOUND)
    if n_hot:
        found = found.unionByName(_counted(cut.where("hot").drop("hot"), length))
    found = settled(found, "found")
    # Of a content that occurs again, every start is repeated.
    known = settled(
        contents.join(found, ["core", "content"], "left")
        .where("n > 1 or starts is not null")
        .select("core", "content", "n", "starts"),
        "known",
    )
    starts = F.when(
        F.col("n") > 1,
        F.array(F.struct(F.lit(0).alias("first"), (F.col("high") - F.col("low")).alias("last"))),
    ).otherwise(F.col("starts"))
    spans = (
        shared.join(known, ["core", "content"])
        .select("row", "low", F.inline(starts))
        .groupBy("row")
        .agg(
            F.collect_list(
                F.struct(
                    (F.col("low") + F.col("first")).alias("start"),
                    (F.col("low") + F.col("last") + length).alias("end"),
                )
            ).alias("spans")
        )
    )
    return prepared.select("row", "doc_id", "n_bytes", "packed").join(spans, "row", "left").mapInPandas(_finish, _CUT)


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The digest of ``cut_texts``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return cut_texts(docs, hot=hot).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
