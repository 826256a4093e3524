"""Best-fit packing with patterns fitted by non-negative least squares.

Documents become token ids and are cut into pieces of at most ``CAPACITY`` ids.
Only the histogram of the lengths, at most ``CAPACITY`` numbers, reaches the
driver.  There, lengths are rounded up to a grid; patterns of at most
``MOST_PARTS`` pieces that fill a sequence on the grid are enumerated, and their
repeat counts are fitted to the histogram by non-negative least squares and
rounded down.  What they leave, small pieces mostly, is packed best-fit by
decreasing exact length into the gaps of the pattern sequences and then into new
ones, whole groups of equal sequences at a time, so the plan's size depends on
the number of different lengths and not on the number of documents.  Pieces of
one length are interchangeable: a piece finds its place by its rank among them.

Defined results: a null or empty text is the closing id alone; repeated rows are
packed each by itself; an empty table has no pieces.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremora.llm.common import settled

CAPACITY = 4096
CLOSING = 1  # id after each document
GRID = 64  # tokens that lengths are rounded up to for the patterns
MOST_PARTS = 4  # pieces of a pattern
SALTS = 64
KNOWN_WORDS = 600_000  # of a Python worker's table of words, which starts anew when full
LONGEST_KNOWN = 40

# Small letters of Latin-1 in UTF-8, and what may follow them.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([.,]?)")
BEYOND_LATIN = re.compile("[^\x00-\xff]")


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones as the character of that number,
    all others, in order, as the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(others)}


class Words(dict):
    """Token ids of texts, word by word: the tokenizer drops white space and never joins over it.

    Words map to their ids as bytes, four per id.  Words of small letters only need
    neither normalising nor splitting: as byte letters they go to the tokenizer's model at once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        plain = PLAIN.fullmatch(word)
        if plain is None:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
            found = np.array(ids, "<u4").tobytes()
        elif plain[2]:
            found = self[plain[1]] + self[plain[2]]
        else:
            letters = word.decode("latin-1").translate(self.letters)
            ids = [token.id for token in self.model.tokenize(letters)]
            found = np.array(ids, "<u4").tobytes()
        if len(word) <= LONGEST_KNOWN:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = found
        return found

    def of_text(self, text: str) -> bytes:
        # Lower case here means fewer different words; special tokens are told apart before.
        if "<|" not in text and not BEYOND_LATIN.search(text):
            text = text.lower()
        return b"".join(map(self.__getitem__, text.encode().split()))


_loaded: dict[str, Words] = {}  # of a Python worker, which serves many tasks


def pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = Words(tokenizer)
        words = _loaded[tokenizer]
        closing = np.array([CLOSING], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, known, text in zip(batch["doc_id"], batch["known"], batch["text"]):
                ids = words.of_text(text) + closing
                for k, at in enumerate(range(0, len(ids), 4 * CAPACITY)):
                    part = ids[at : at + 4 * CAPACITY]
                    rows.append((doc_id, known, k, k * CAPACITY, len(part) // 4, zlib.crc32(part)))
            names = ["doc_id", "known", "piece", "start", "length", "ids_crc32"]
            yield pd.DataFrame(rows, columns=names)

    rows = docs.select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"),
        F.col("doc_id").isNotNull().alias("known"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    schema = "doc_id long, known boolean, piece int, start long, length long, ids_crc32 long"
    found = rows.mapInPandas(cut, schema)
    return found.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with the least |ax - b|, by active sets."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        gain = np.where(used, -np.inf, a.T @ (b - a @ x))
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        used[best] = True
        while True:
            z = np.zeros(n)
            z[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            bad = used & (z <= 1e-12)
            if not bad.any():
                break
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-30))
            x = x + step * (z - x)
            used &= x > 1e-12
            x[~used] = 0
        x = z
    return x


def patterns() -> list[tuple[int, ...]]:
    """Multisets of 2 to MOST_PARTS grid lengths that fill a sequence."""
    whole = CAPACITY // GRID
    found = []
    for n in range(1, MOST_PARTS):
        for parts in combinations_with_replacement(range(1, whole), n):
            last = whole - sum(parts)
            if last >= parts[-1]:
                found.append((*parts, last))
    return found


class Plan:
    """Groups of equal sequences: (count, [(length, first rank), ...])."""

    def __init__(self, histogram: dict[int, int]):
        self.left = dict(histogram)
        self.next_rank: dict[int, int] = defaultdict(int)
        self.groups: list[tuple[int, list[tuple[int, int]]]] = []

    def take(self, length: int, n: int) -> int:
        first = self.next_rank[length]
        self.next_rank[length] += n
        self.left[length] -= n
        return first

    def add_pattern(self, lengths_of: dict[int, list[int]], parts: tuple[int, ...], n: int) -> None:
        """n sequences of the pattern, from the longest pieces of each grid length."""
        while n:
            chosen, need = [], defaultdict(int)
            for part in parts:
                for length in lengths_of[part]:
                    if self.left[length] > need.get(length, 0):
                        chosen.append(length)
                        need[length] += 1
                        break
            if len(chosen) < len(parts):
                return
            step = min(n, *[self.left[length] // k for length, k in need.items()])
            self.groups.append((step, [(length, self.take(length, step)) for length in chosen]))
            n -= step

    def fill(self) -> None:
        """Best fit, by decreasing length, into gaps of the groups and then into new sequences."""
        by_gap: dict[int, list] = defaultdict(list)
        for n, parts in self.groups:
            by_gap[CAPACITY - sum(length for length, _ in parts)].append((n, parts))
        gaps = sorted(by_gap)

        def put(gap: int, group: tuple) -> None:
            if not by_gap[gap]:
                i = bisect_left(gaps, gap)
                if i == len(gaps) or gaps[i] != gap:
                    insort(gaps, gap)
            by_gap[gap].append(group)

        for length in sorted(self.left, reverse=True):
            while self.left[length] > 0:
                i = bisect_left(gaps, length)
                while i < len(gaps) and not by_gap[gaps[i]]:
                    gaps.pop(i)
                if i < len(gaps):
                    gap = gaps[i]
                    n, parts = by_gap[gap].pop()
                    used = min(n, self.left[length])
                    if used < n:
                        by_gap[gap].append((n - used, [(x, first + used) for x, first in parts]))
                    put(gap - length, (used, [*parts, (length, self.take(length, used))]))
                    continue
                k = CAPACITY // length
                n = self.left[length] // k
                if n:
                    put(CAPACITY - k * length, (n, [(length, self.take(length, n)) for _ in range(k)]))
                elif self.left[length]:
                    k = self.left[length]
                    put(CAPACITY - k * length, (1, [(length, self.take(length, 1)) for _ in range(k)]))
        self.groups = [group for groups in by_gap.values() for group in groups]

    def places(self) -> pd.DataFrame:
        """Per part of a group: length, first rank, first sequence, offset; sorted."""
        rows, sequence = [], 0
        for n, parts in self.groups:
            offset = 0
            for length, first in parts:
                rows.append((length, first, sequence, offset))
                offset += length
            sequence += n
        names = ["length", "first", "sequence", "offset"]
        return pd.DataFrame(rows, columns=names, dtype="int64").sort_values(names[:2])


def plan(histogram: dict[int, int]) -> Plan:
    """Patterns first, then best fit for the rest."""
    made = Plan(histogram)
    whole = CAPACITY // GRID
    lengths_of: dict[int, list[int]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        lengths_of[-(-length // GRID)].append(length)
    have = np.array([sum(histogram[x] for x in lengths_of[u]) for u in range(1, whole)], float)
    found = patterns()
    a = np.zeros((whole - 1, len(found)))
    for k, parts in enumerate(found):
        for part in parts:
            a[part - 1, k] += 1
    times = nnls(a, have) if have.any() else np.zeros(len(found))
    for k in np.argsort(-times, kind="stable"):
        if int(times[k]) > 0:
            made.add_pattern(lengths_of, found[k], int(times[k]))
    made.fill()
    return made


def packed(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = settled(pieces(docs, tokenizer), "pieces")
    # Ranks among pieces of one length: inside salted parts first, then moved by the parts before.
    part = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32", "__row")
    ranked = settled(
        cut.withColumn("__row", F.monotonically_increasing_id())
        .withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)))
        .withColumn("__rank", F.row_number().over(part) - 1)
        .drop("__row"),
        "ranked",
    )
    counts = settled(ranked.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n")), "counts")
    histogram = {
        r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()
    }
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    # CAPACITY * SALTS rows at most, so the broadcast has a bound.
    ranks = ranked.join(F.broadcast(moved.drop("__n")), ["length", "__salt"]).withColumn(
        "__rank", F.col("__rank") + F.col("__before")
    )
    places = docs.sparkSession.sparkContext.broadcast(plan(histogram).places())

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = places.value
        key = table["length"].to_numpy() * (1 << 48) + table["first"].to_numpy()
        at = np.searchsorted(key, length.to_numpy() * (1 << 48) + rank.to_numpy(), side="right") - 1
        row = table.iloc[at]
        sequence = row["sequence"].to_numpy() + rank.to_numpy() - row["first"].to_numpy()
        return pd.DataFrame({"sequence_id": sequence, "offset": row["offset"].to_numpy()})

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranks.withColumn("__place", place("length", "__rank")).select(*names, "__place.*")
