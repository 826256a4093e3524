"""Spelling variants, grouped with PartEnum signatures.

Words one edit apart (a code point inserted, deleted or replaced) have letter
multisets that, as binary vectors (one place for the first, second, ... occurrence
of each letter), differ in one place or in two.  The places are dealt to ``PARTS``
parts.  Two vectors that differ in at most k places agree in all parts but k, so
for every choice of k parts left out, the rest of the vector is a signature, and
words one edit apart share at least one.  A replacement keeps the length and
changes two places: signatures leave two parts out and have the length.  An
insertion changes one place: signatures leave one part out and have the shorter
length.  An equi-join on signatures finds the pairs; anagrams, and words that
agree neither at their front nor at their end, are left out there, and the edit
distance itself decides the rest.  A pair found under several signatures counts once.

A word's form is its most frequent near word, if that is at least ``RATIO`` times
as frequent; following forms to the last gives its root, by pointer doubling.

Defined results: null or empty texts have no words; a null id is written as
nothing in the hash that decides which occurrences lose a code point; repeated
rows count each; equally frequent near words are told apart by code points; an
empty table has no words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import settled

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 199  # one occurrence of so many loses a code point
SHORTEST = 6  # code points of a word
LEAST = 5  # occurrences of a word
RATIO = 5  # times a word's occurrences that its form has at least
PARTS = 8  # any number from 3 on gives the same result


def occurrences(docs: DataFrame) -> DataFrame:
    """Every word of every text, in column ``word``."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__doc"),
        F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("__run"),
    )
    lowered = runs.select("__doc", F.translate("__run", UPPER, LOWER).alias("__run"))
    hashed = lowered.select("__run", F.crc32(F.concat("__doc", F.lit(":"), "__run").cast("binary")).alias("__h"))
    at = F.pmod("__h", F.length("__run")).cast("int")
    shorter = F.concat(F.substring("__run", F.lit(1), at), F.substring("__run", at + 2, F.length("__run")))
    return hashed.select(F.when(F.col("__h") % SLIP == 0, shorter).otherwise(F.col("__run")).alias("word"))


def frequent_words(found: DataFrame) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    counts = found.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= LEAST)


def places(word: str) -> list[tuple[str, int]]:
    """The vector of a word's letters: each with the number of its occurrence."""
    seen: Counter[str] = Counter()
    found = []
    for letter in word:
        seen[letter] += 1
        found.append((letter, seen[letter]))
    return found


class Signatures:
    """Signatures of words; a part's places are told apart by the sum of their hashes."""

    def __init__(self, parts: int):
        self.parts = parts
        # Kinds of a signature: the parts left out; two for replacements, one for insertions.
        self.left_out = [*combinations(range(parts), 2), *combinations(range(parts), 1)]
        self.hashes: dict[tuple[str, int], tuple[int, int]] = {}

    def _hash(self, place: tuple[str, int]) -> tuple[int, int]:
        if place not in self.hashes:
            value = xxhash.xxh64_intdigest(f"{place[0]}{place[1]}")
            self.hashes[place] = value % self.parts, value
        return self.hashes[place]

    def sums(self, word: str) -> list[int]:
        """Per part, the sum of the hashes of the word's places in it."""
        found = [0] * self.parts
        for place in places(word):
            part, value = self._hash(place)
            found[part] = (found[part] + value) & 0xFFFFFFFFFFFFFFFF
        return found

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word its vector's hash, and a row of signatures, one for each kind."""
        sums = np.array([self.sums(word) for word in words], np.uint64).reshape(len(words), self.parts)
        # Each part is multiplied by a number of its own, so that equal sums in other parts differ.
        own = np.array([xxhash.xxh64_intdigest(f"part {i}") | 1 for i in range(self.parts)], np.uint64)
        mixed = (sums ^ (sums >> np.uint64(29))) * own
        vector = mixed.sum(1, dtype=np.uint64)
        table = [vector - mixed[:, list(out)].sum(1, dtype=np.uint64) for out in self.left_out]
        return vector.view(np.int64), np.stack(table, 1).view(np.int64)


def signed(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, vector, signatures) for rows with ``word``."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signatures = Signatures(parts)
        for batch in batches:
            vector, table = signatures.of(batch["word"].tolist())
            yield pd.DataFrame({"word": batch["word"], "vector": vector, "signatures": list(table)})

    return words.select("word").mapInPandas(sign, "word string, vector long, signatures array<long>")


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(a, b), once each: distinct words of at least ``SHORTEST`` code points that are one edit apart."""
    n_two = parts * (parts - 1) // 2
    half = SHORTEST // 2
    rows = settled(signed(words, parts), "signed").select(
        "word",
        "vector",
        F.length("word").alias("length"),
        # One edit leaves the first or the last code points of both words alone.
        F.xxhash64(F.substring("word", 1, half)).alias("front"),
        F.xxhash64(F.expr(f"right(word, {half})")).alias("end"),
        F.posexplode("signatures").alias("kind", "signature"),
    )

    def joined(a: DataFrame, b: DataFrame, more: Column) -> DataFrame:
        keys = [F.col(f"a.{key}") == F.col(f"b.{key}") for key in ("kind", "length", "signature")]
        agree = (F.col("a.front") == F.col("b.front")) | (F.col("a.end") == F.col("b.end"))
        apart = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
        where = keys[0] & keys[1] & keys[2] & more & agree & apart
        return a.alias("a").join(b.alias("b"), where).select(F.col("a.word").alias("a"), F.col("b.word").alias("b"))

    replaced = rows.where(F.col("kind") < n_two)
    inserted = rows.where(F.col("kind") >= n_two)
    other = (F.col("a.vector") != F.col("b.vector")) & (F.col("a.word") < F.col("b.word"))
    same_length = joined(replaced, replaced, other)
    longer = joined(inserted, inserted.withColumn("length", F.col("length") - 1), F.lit(True))
    return same_length.unionByName(longer).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form, for rows (word, form).

    Occurrences grow at least ``RATIO`` times with each step, so chains are short and
    have no cycles; each round doubles the steps that a row has gone.
    """
    step = settled(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "steps")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("__ahead"))
        step = settled(step.join(ahead, "root", "left"), "ahead")
        if not step.where(F.col("__ahead").isNotNull()).take(1):
            return step.select("word", "root")
        step = step.select("word", F.coalesce("__ahead", "root").alias("root"))


def variants(docs: DataFrame, parts: int = PARTS) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = settled(frequent_words(occurrences(docs)), "words")
    pairs = settled(near_pairs(words, parts), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("__n")), "b")
    # The most occurrences first, then the smallest word.
    best = F.min(F.struct((-F.col("__n")).alias("less"), F.col("b").alias("form"))).alias("__best")
    near = counted.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best)
    is_form = -F.col("__best.less") >= RATIO * F.col("n")
    formed = settled(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("__best.form")).alias("form"),
            F.when(is_form, -F.col("__best.less")).alias("form_n"),
        ),
        "formed",
    )
    return (
        formed.join(roots(formed), "word", "left")
        .withColumn("root", F.coalesce("root", "word"))
        .select("word", "n", "n_near", "form", "form_n", "root")
    )
