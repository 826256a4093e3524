"""Alignment of two tokenizers by the byte offsets at which tokens of both end.

Both tokenizers' end offsets in a text are two sorted lists.  The shorter one
drives a galloping search into the longer: steps that double until they pass the
offset, then a binary search in the last step.  Offsets in both lists cut the
tokens into groups; the difference of the ranks of two neighbouring cuts says
which tokens of either side a group has.  All pairs of an A and a B token of a
group are links.

A pair of ids has a count: in how many documents it is linked.  Documents are
taken in blocks of ``BLOCK`` bytes; a block writes down its different pairs, with
their number of documents, once, and each document its own as places in that
list.  So what is counted over the corpus, and joined back, is a row for each
block and pair, and not one for each link.

Where a stretch of text (a word with the space before it) is always cut off by both
tokenizers, its ends are common ends of any document, and its tokens and groups don't
depend on what stands around it.  So a task aligns each distinct stretch once and a
document is the list of its stretches; a table of them that has ``KNOWN``, or
``CHARACTERS`` in all, starts anew with the next block.

Defined results: a document whose text is null or empty, or whose tokens don't
spell the text behind a space (a text with U+2581, which the second tokenizer turns
into a space), has no tokens, groups or links; each row is a document of its own,
also if it repeats an id or a text; an empty table has no rows.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import byte_slices, settled
from tremora.llm.sentencepieces import JOINED, LETTERS, MARK, STOPS, Numbers

# A word with one space before it, and white space that isn't a single space or line end
# with what follows it; a single line end between words stands alone.
STRETCH = re.compile(r"(?:\A\s+\S*| ?\S+)(?:(?:\s{2,}|[^\S \n]|\s\Z)\S*)*|\n")
# Letters between cuts, and stops between cuts: the first tokenizer always cuts between the two.
SHORT_STRETCH = re.compile(
    rf" ?[{LETTERS}]+(?= \S|\n\S|[{STOPS}]|\Z)| ?[{STOPS}]+(?= \S|\n\S|[{LETTERS}]|\Z)|{STRETCH.pattern}"
)
KNOWN = 250_000  # stretches of a table
CHARACTERS = 8_000_000  # of the stretches of a table
PART = 1 << 12  # stretches that are aligned at a time
BLOCK = 1 << 21  # bytes of text of a block
LINKS = 1 << 12  # links of a group that are spread out one by one
LISTED = 1 << 13  # pairs in one row of a block's list


def common_ends(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Ranks in both lists of the values that both have; sorted lists of different values."""
    if len(b) < len(a):
        return [(i, j) for j, i in common_ends(b, a)]
    found, j, n = [], 0, len(b)
    for i, end in enumerate(a):
        if j == n:
            break
        at = b[j]
        if at < end:
            step, low = 1, j
            while low + step < n and b[low + step] < end:
                low += step
                step *= 2
            j = bisect_left(b, end, low + 1, min(low + step, n))
            if j == n:
                break
            at = b[j]
        if at == end:
            found.append((i, j))
            j += 1
    return found


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are
    the character of that number, all others, in order, the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    letters = _letters()
    entries = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return [bytes(letters.get(c, 63) for c in entry) for entry in entries]


def piece_bytes(model) -> list[bytes]:
    """The bytes of each id of a SentencePiece model."""
    found = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        found.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(MARK, " ").encode())
    return found


def width(b_path: str) -> int:
    """Ids of the second tokenizer; a pair is written as its A id times this, plus its B id."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=b_path).get_piece_size()


class Rows:
    """Rows of numbers of different lengths, one behind the other."""

    def __init__(self):
        self.flat = np.empty(0, np.int64)
        self.stops = np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat])
        self.stops = np.concatenate([self.stops, self.stops[-1] + np.cumsum(lengths)])

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        return self.stops[rows + 1] - self.stops[rows]

    def of(self, rows: np.ndarray) -> np.ndarray:
        lengths = self.lengths(rows)
        before = np.cumsum(lengths) - lengths
        return self.flat[np.repeat(self.stops[rows] - before, lengths) + np.arange(lengths.sum())]


class Side:
    """One tokenizer's ids of a list of stretches, one behind the other."""

    def __init__(self, ids: list[list[int]], bytes_of: list[bytes], length_of: np.ndarray):
        self.lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.fromiter((i for x in ids for i in x), np.int64, int(self.lengths.sum()))
        self.bytes_of = bytes_of
        # Bytes before each token, and before each stretch.
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(length_of[self.flat])])

    def spells(self, stretches: list[bytes]) -> np.ndarray:
        """For each stretch, whether its tokens' bytes are the stretch."""
        wanted = np.fromiter(map(len, stretches), np.int64, len(stretches))
        right = self.before[self.starts + self.lengths] - self.before[self.starts] == wanted
        whole = b"".join(map(self.bytes_of.__getitem__, self.flat.tolist()))
        if right.all() and whole == b"".join(stretches):
            return right
        at = zip(self.before[self.starts].tolist(), self.before[self.starts + self.lengths].tolist())
        return np.fromiter((whole[low:high] == s for (low, high), s in zip(at, stretches)), bool, len(stretches))


def groups_text(a: list[str], b: list[str], first: np.ndarray, last: np.ndarray) -> list[str]:
    """Each group as `a1,a2|b1,b2`, of ids in decimal, from the ranks of its first and last tokens."""
    found = [f"{a[i]}|{b[j]}" for i, j in last.tolist()]
    for g in np.flatnonzero((first < last).any(1)).tolist():
        (i0, j0), (i, j) = first[g].tolist(), last[g].tolist()
        found[g] = f"{','.join(a[i0 : i + 1])}|{','.join(b[j0 : j + 1])}"
    return found


def _summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(codes, return_inverse=True)
    return codes, np.bincount(at, times, len(codes)).astype(np.int64)


def linked_pairs(
    a: np.ndarray, b: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All links of groups: (group, a * width + b, how often), in the order of the groups.

    ``starts`` and ``sizes`` have a row per group, where its ids begin in a and in b and how many there are.
    """
    links = sizes.prod(1)
    found = []
    for g in np.flatnonzero(links > LINKS).tolist():  # ids that repeat within one long group are put together first
        (x, nx), (y, ny) = (
            np.unique(ids[s : s + n], return_counts=True) for ids, s, n in zip((a, b), starts[g], sizes[g])
        )
        for one, n in zip(x, nx):
            found.append((np.full(len(y), g), one * width + y, n * ny))
    few = np.flatnonzero(links <= LINKS)
    n = links[few]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(sizes[few, 1], n)
    codes = a[np.repeat(starts[few, 0], n) + inside // wide] * width + b[np.repeat(starts[few, 1], n) + inside % wide]
    found.append((np.repeat(few, n), codes, np.ones(len(codes), np.int64)))
    group, codes, times = map(np.concatenate, zip(*found))
    order = np.argsort(group, kind="stable")
    return group[order], codes[order], times[order]


class Stretches:
    """The alignment of every distinct stretch: its tokens, groups and links."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and threads hold on to memory
        self.a_model = Tokenizer.from_file(a_path)
        self.a_model.encode_special_tokens = True  # their strings are ordinary text
        self.b_model = SentencePieceProcessor(model_file=b_path)
        self.bytes_of = byte_level_bytes(self.a_model), piece_bytes(self.b_model)
        self.length_of = [np.array(list(map(len, of)), np.int64) for of in self.bytes_of]
        self.width = len(self.bytes_of[1])
        self.decimal = list(map(str, range(max(map(len, self.bytes_of)))))
        self.line_end = len(self.b_model.encode("\n"))
        pieces = map(self.b_model.id_to_piece, range(self.width))
        self.stretch = STRETCH if any(map(JOINED.search, pieces)) else SHORT_STRETCH
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        self.characters = 0
        self.right = np.empty(0, bool)
        self.counts = np.empty((0, 3), np.int64)  # tokens of A and B, groups
        self.groups: list[str] = []
        self.pairs, self.times = Rows(), Rows()

    def _b_ids(self, stretches: list[str]) -> list[list[int]]:
        """The model puts a marker in front of what it encodes: in place of the stretch's
        own space, or before a line end, with which it is taken off again."""
        spaced = [s[0] == " " for s in stretches]
        found = self.b_model.encode(
            [s[1:] if space else "\n" + s for s, space in zip(stretches, spaced)], num_threads=1
        )
        # A lone space is the marker that is put before nothing.
        lone = self.b_model.encode("\n")[: self.line_end - 1]
        return [
            (ids or lone) if space else ids[self.line_end :] for ids, space in zip(found, spaced)
        ]

    def learn(self) -> None:
        """Align the stretches that have got a number since the last time, in parts."""
        fresh = list(islice(self.numbers, len(self.right), None))
        self.characters += sum(map(len, fresh))
        parts = [self._align(fresh[at : at + PART]) for at in range(0, len(fresh), PART)]
        if parts:
            right, counts, lengths, codes, times = map(np.concatenate, zip(*parts))
            self.right = np.concatenate([self.right, right])
            self.counts = np.concatenate([self.counts, counts])
            self.pairs.add(codes, lengths)
            self.times.add(times, lengths)

    def _align(self, stretches: list[str]) -> tuple[np.ndarray, ...]:
        """Both tokenizers' ends in all these stretches, one behind the other, are intersected at once."""
        encoded = [x.ids for x in self.a_model.encode_batch_fast(stretches, add_special_tokens=False)]
        encoded = encoded, self._b_ids(stretches)
        a, b = (Side(*of) for of in zip(encoded, self.bytes_of, self.length_of))
        spelt = [s.encode() for s in stretches]
        right = a.spells(spelt) & b.spells(spelt)
        if not right.all():
            kept = [[ids if good else [] for ids, good in zip(side, right.tolist())] for side in encoded]
            a, b = (Side(*of) for of in zip(kept, self.bytes_of, self.length_of))

        last = np.array(common_ends(a.before[1:].tolist(), b.before[1:].tolist()), np.int64).reshape(-1, 2)
        first = np.concatenate([np.zeros((1, 2), np.int64), last + 1])[:-1]
        stretch = np.searchsorted(a.starts + a.lengths, last[:, 0], side="right")
        n_groups = np.bincount(stretch, minlength=len(stretches))
        decimals = (list(map(self.decimal.__getitem__, side.flat.tolist())) for side in (a, b))
        shown = groups_text(*decimals, first, last)
        stops = np.cumsum(n_groups).tolist()
        self.groups += [";".join(shown[low:high]) for low, high in zip([0, *stops], stops)]
        group, codes, times = linked_pairs(a.flat, b.flat, first, last + 1 - first, self.width)
        lengths = np.bincount(stretch[group], minlength=len(stretches))
        return right, np.stack([a.lengths, b.lengths, n_groups], 1), lengths, codes, times

    def align(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Per text, the numbers of its stretches; none if it has no tokens."""
        if len(self.numbers) > KNOWN or self.characters > CHARACTERS:
            self.clear()
        cut = [self.stretch.findall(" " + text) if text else [] for text in texts]
        cut = [np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found)) for found in cut]
        self.learn()
        for places in cut:
            yield places if self.right[places].all() else places[:0]

    def document(self, places: np.ndarray) -> tuple[list[int], str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links; the groups; the different pairs and how often each is linked."""
        codes, times = _summed(self.pairs.of(places), self.times.of(places))
        groups = ";".join(map(self.groups.__getitem__, places.tolist()))
        return [*self.counts[places].sum(0).tolist(), int(times.sum())], groups, codes, times


DOCUMENT = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
ALIGNED = f"{DOCUMENT}, places binary, times binary, first long, pairs array<long>, n_docs array<int>"

_loaded: dict[tuple[str, str], Stretches] = {}  # of a Python worker, which serves many tasks


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Two kinds of rows.  A document: block, doc_id, n_a, n_b, n_groups, n_links, its groups, and
    its pairs as places in its block's list with how often each is linked (unsigned 32-bit).
    Or a part of a block's list of pairs, from place ``first``, with their number of documents."""
    schema = pa.schema(
        [("block", pa.int64()), *[(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]]
        + [("groups", pa.string()), ("places", pa.binary()), ("times", pa.binary()), ("first", pa.int64())]
        + [("pairs", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int32()))]
    )

    def rows_of_block(table: Stretches, block: int, rows: pa.RecordBatch) -> Iterator[dict]:
        found = [table.document(places) for places in table.align(rows.column("text").to_pylist())]
        listed, n_docs = np.unique(np.concatenate([pairs for _, _, pairs, _ in found]), return_counts=True)
        for doc_id, ((n_a, n_b, n_groups, n_links), groups, pairs, times) in zip(
            rows.column("doc_id").to_pylist(), found
        ):
            places = np.searchsorted(listed, pairs).astype("<u4").tobytes()
            yield {
                "block": block, "doc_id": doc_id, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
                "groups": groups, "places": places, "times": times.astype("<u4").tobytes(),
            }
        for at in range(0, len(listed), LISTED):
            part = slice(at, at + LISTED)
            yield {"block": block, "first": at, "pairs": listed[part], "n_docs": n_docs[part]}

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _loaded:
            _loaded[a_path, b_path] = Stretches(a_path, b_path)
        table = _loaded[a_path, b_path]
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in byte_slices(batch, "text", BLOCK):
                yield pa.RecordBatch.from_pylist(list(rows_of_block(table, block, rows)), schema)
                block += 1
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(align, ALIGNED)


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """(pair, count, best) over settled rows of ``aligned``: the documents that link the pair,
    and whether no pair of the same A id has more."""
    listed = found.where(F.col("pairs").isNotNull())
    each = listed.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("x"))
    counts = settled(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.n_docs").alias("count")), "counts")
    a_id = F.floor(F.col("pair") / width)
    most = counts.groupBy(a_id.alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", a_id).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def counted(found: DataFrame, width: int) -> DataFrame:
    """The documents of settled rows of ``aligned``, with n_best and count_sum."""
    counts = settled(pair_counts(found, width), "pairs")
    listed = found.where(F.col("pairs").isNotNull())
    each = listed.select("block", "first", F.posexplode("pairs").alias("at", "pair"))
    looked_up = each.join(counts, "pair").select(F.col("block").alias("of"), (F.col("first") + F.col("at")).alias("place"), "count", "best")
    documents = found.where(F.col("pairs").isNull()).drop("first", "pairs", "n_docs")
    kept = [(f.name, f.dataType) for f in documents.schema if f.name not in ("block", "places", "times")]

    def of_block(documents: pa.Table, listed: pa.Table) -> pa.Table:
        place = listed.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place] = listed.column("count").to_numpy()
        best[place] = listed.column("best").to_numpy(zero_copy_only=False)
        sums = []
        for places, times in zip(documents.column("places").to_pylist(), documents.column("times").to_pylist()):
            at, n = np.frombuffer(places, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
            sums.append((int(n @ best[at]), int(n @ count[at])))
        kept_columns = documents.select([name for name, _ in kept])
        more = pd.DataFrame(sums, columns=["n_best", "count_sum"], dtype="int64")
        for name in more.columns:
            kept_columns = kept_columns.append_column(name, pa.array(more[name], pa.int64()))
        return kept_columns

    schema = ", ".join(f"`{name}` {kind.simpleString()}" for name, kind in kept)
    grouped = documents.groupBy("block").cogroup(looked_up.groupBy("of"))
    return grouped.applyInArrow(of_block, f"{schema}, n_best long, count_sum long")


def digest(found: DataFrame) -> DataFrame:
    """Rows of ``aligned`` with the hash of a document's groups in their place ('' without any)."""
    hashed = F.when(F.col("groups") == "", "").when(F.col("groups").isNotNull(), F.sha2("groups", 256))
    return found.withColumn("groups_sha256", hashed).drop("groups")
