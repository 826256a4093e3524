"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source whose target is f times its size is to be taken f times:
floor(f) times for sure, once more with probability f - floor(f).  Pairs of such
probabilities play against each other: words move from one document to the other
until one of the two probabilities is 0 or 1, in a random direction that leaves
both expectations as they were.  The words expected of the pair never change, so
those of the source don't either, until one document of it is left undecided.

The pairs are played in a tree: buckets of documents first, each leaving one
undecided document, then buckets of those, and so on; each level is one grouped
aggregation of buckets of about ``FANOUT`` documents, whatever the source's size.

Defined results: a null text or one without words has size 0 and is never taken;
a null source is a source, the last one; rows that agree in source, id and text
are decided together, as many of them as are due get the further copy; an empty
table gives an empty result.  The draws depend on ids, sizes and ``SEED`` alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import n_words, numbered, ranked, settled, uniform

WEIGHTS = (1, 2, 3)  # of the sources in code point order, repeating
MOST = 3  # times a source's size that its target is at most
FANOUT = 64  # documents of a bucket, on average
SEED = 4
UNIT = ("source", "doc_id", "size", "text_hash")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Targets share the sum of all sizes by weight; what exceeds ``MOST`` times a
    source's size is shared again among the others until none is above.
    """
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in WEIGHTS]),
        (F.col("__place") % len(WEIGHTS) + 1).cast("int"),
    )
    stats = settled(numbered(stats, order, "__place").withColumn("__weight", weight), "sources")
    cap = (F.col("source_size") * MOST).cast("double")
    total, share = stats.agg(F.sum("source_size"), F.sum("__weight")).first()
    rate = total / share if share else 0.0
    full = -1
    while True:  # each round adds at least one source to those at their limit
        at_limit = cap <= F.col("__weight") * rate
        n, words, rest = stats.agg(
            F.count_if(at_limit),
            F.sum(F.when(at_limit, cap).otherwise(0.0)),
            F.sum(F.when(at_limit, 0.0).otherwise(F.col("__weight"))),
        ).first()
        if n == full or not rest:
            break
        full, rate = n, (total - words) / rest
    return stats.select(
        "source", "source_size", F.least(cap, F.col("__weight") * rate).alias("target")
    )


def _of_text() -> tuple[Column, Column]:
    return n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")


def _units(docs: DataFrame) -> DataFrame:
    sizes = docs.select("doc_id", "source", *_of_text())
    units = settled(sizes.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("rows")), "units")
    targets = settled(
        source_targets(units.select("source", (F.col("size") * F.col("rows")).alias("size"))),
        "targets",
    )
    by_source = targets.withColumnRenamed("source", "__source")
    units = units.join(by_source, F.col("source").eqNullSafe(F.col("__source")), "left")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
    times = F.when(F.col("size") > 0, times).otherwise(0.0)
    due = (F.col("__times") - F.col("base")) * F.col("rows")
    return (
        units.drop("__source")
        .withColumn("__times", times)
        .withColumn("base", F.floor("__times"))
        .withColumn("more", F.floor(due))
        .withColumn("chance", due - F.col("more"))
        .drop("__times")
    )


def _play(left: Column, right: Column, level: int) -> tuple[Column, Column]:
    """(the document that stays undecided, the decided one) of two."""
    a, b = left["size"] * left["chance"], right["size"] * right["chance"]
    room_left = left["size"] * (1 - left["chance"])
    room_right = right["size"] * (1 - right["chance"])
    to_right, to_left = F.least(a, room_right), F.least(b, room_left)
    draw = uniform(left["doc_id"], left["size"], right["doc_id"], right["size"], F.lit(SEED + level))
    rightward = (to_right == 0) | (draw * (to_right + to_left) < to_left)

    def ends(unit: Column, chance: Column) -> Column:
        return unit.withField("chance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), chance)))

    zero, one = F.lit(0.0), F.lit(1.0)
    right_more = ends(right, right["chance"] + to_right / right["size"])
    left_less = ends(left, left["chance"] - to_right / left["size"])
    left_more = ends(left, left["chance"] + to_left / left["size"])
    right_less = ends(right, right["chance"] - to_left / right["size"])
    left_out, right_out = a <= room_right, b <= room_left
    stays = F.when(
        rightward, F.when(left_out, right_more).otherwise(left_less)
    ).otherwise(F.when(right_out, left_more).otherwise(right_less))
    goes = F.when(
        rightward, F.when(left_out, ends(left, zero)).otherwise(ends(right, one))
    ).otherwise(F.when(right_out, ends(right, zero)).otherwise(ends(left, one)))
    return stays, goes


def _level(units: DataFrame, columns: list[str], level: int) -> DataFrame:
    """One row per bucket: the document left undecided, and those decided."""

    def step(state: Column, unit: Column) -> Column:
        stays, goes = _play(state["stays"], unit, level)
        return F.struct(stays.alias("stays"), F.concat(state["gone"], F.array(goes)).alias("gone"))

    buckets = units.groupBy("source", "__bucket").agg(
        F.sort_array(F.collect_list(F.struct(*columns)), asc=False).alias("__all")
    )
    everyone = F.col("__all")
    nobody = F.filter(everyone, lambda _: F.lit(False))
    first = F.struct(everyone[0].alias("stays"), nobody.alias("gone"))
    rest = F.slice(everyone, F.lit(2), F.greatest(F.size(everyone) - 1, F.lit(0)))
    played = buckets.select(F.aggregate(rest, first, step).alias("__played"))
    return settled(played.select("__played.*"), "mix-level")


def decided_units(docs: DataFrame) -> DataFrame:
    """One row per distinct ``UNIT``: ``rows`` such documents, each taken ``base``
    times, and ``more`` of them once more; with ``source_size`` and ``target``."""
    units = settled(_units(docs), "units")
    columns = ["size", *[c for c in units.columns if c != "size"]]
    decided = units.where(F.col("chance") == 0).select(columns)
    open_units = units.where(F.col("chance") > 0)
    counts = open_units.groupBy("source").agg(F.count(F.lit(1)).alias("__n"))
    most = counts.agg(F.max("__n")).first()[0] or 0
    sources = settled(counts.withColumnRenamed("source", "__source"), "counts")
    open_units = open_units.join(sources, F.col("source").eqNullSafe(F.col("__source")))
    buckets = F.ceil(F.col("__n") / FANOUT)
    open_units = open_units.drop("__source").withColumn(
        "__bucket", F.pmod(F.xxhash64(*UNIT[1:], F.lit(SEED)), buckets)
    )
    for level in range(max(1, math.ceil(math.log(max(most, 2), FANOUT)) + 1)):
        played = _level(open_units, [*columns, "__bucket"], level)
        gone = played.select(F.inline("gone")).select(columns)
        decided = decided.unionByName(gone)
        # The undecided go on in buckets of FANOUT buckets; at last, one is left per source.
        open_units = played.select("stays.*").withColumn(
            "__bucket", F.floor(F.col("__bucket") / FANOUT)
        )
    # One document of each source stays undecided: the nearer number is taken.
    last = open_units.withColumn("chance", F.round("chance")).select(columns)
    return decided.unionByName(last).withColumn(
        "more", F.col("more") + F.col("chance").cast("long")
    )


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted),
    and its source and copies."""
    units = decided_units(docs)
    each = units.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    copies = F.col("base") + (F.col("__i") <= F.col("more")).cast("long")
    return each.withColumn("copies", copies).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "source",
        "copies",
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with all their columns."""
    names = ["__key1", "__key2"]

    def keyed(*unit: str | Column) -> list[Column]:
        """128 bits: two hashes that differ from their first byte on."""
        return [F.xxhash64(F.lit(i), *unit).alias(name) for i, name in enumerate(names)]

    units = settled(
        decided_units(docs)
        .where("base > 0 or more > 0")
        .select(
            *keyed(*UNIT),
            F.col("base").alias("__base"),
            F.col("more").alias("__more"),
            F.col("rows").alias("__rows"),
        ),
        "decisions",
    )
    rows = docs.select("*", *keyed("source", "doc_id", *_of_text()))
    # Nearly always all rows of a unit are taken equally often; where not, they get a place.
    some = (F.col("__more") > 0) & (F.col("__more") < F.col("__rows"))
    whole = rows.join(units.where(~some), names)
    taken = whole.withColumn("__copies", F.col("__base") + (F.col("__more") > 0).cast("long"))
    if not units.where(some).isEmpty():
        placed = ranked(rows.join(units.where(some), names), names, "__place")
        copies = F.col("__base") + (F.col("__place") < F.col("__more")).cast("long")
        taken = taken.unionByName(placed.withColumn("__copies", copies).drop("__place"))
    return (
        taken.where(F.col("__copies") > 0)
        .withColumn("__copies", F.col("__copies").cast("int"))
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies")))
        .select(*docs.columns)
    )
