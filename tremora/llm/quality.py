"""Quality rules by a log-likelihood ratio between trusted texts and the raw corpus.

Hashed word n-grams are counted over all documents, and over all those that the
labels call trusted; both counts make a multinomial over ``BUCKETS`` buckets.  A document's score is the sum of its n-grams' log
ratios divided by their number.  Every document at or above the threshold is
kept, a quantile of the trusted documents' scores, so junk goes and what reads
like trusted text stays.  Weights and scores are whole numbers (millionths), so
sums don't depend on the order of rows and the decision repeats exactly.

Defined results: a null text has no words and fails the base rules, as a text
with under ``LEAST_WORDS`` words does; rows that repeat an id are judged each by
itself; without labels or documents the ratio is 0 everywhere and only the base
rules decide; labels that contradict each other are not trusted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.llm.common import SPACE, settled

BUCKETS = 1 << 16
QUANTILE = 0.002  # of trusted documents that may fall below the threshold
SCALE = 1_000_000
SCORE_BINS = 1_000  # per unit of the score, for the threshold's histogram
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words in repeated windows
WINDOW = 3
SYMBOLS = r"[#*$%&|<>]"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def split_words(text: Column) -> Column:
    """array of the words of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed != "", F.split(trimmed, SPACE + "+")).otherwise(F.array().cast("array<string>"))


def with_base_rules(docs: DataFrame) -> DataFrame:
    """Adds ``words`` and the columns of ``BASE`` to rows with a ``text``."""
    text = F.coalesce("text", F.lit(""))
    words, n = F.col("words"), F.col("n_words").cast("int")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )
    some = F.col("__hashes")
    sorted_places = F.array_sort(
        F.transform(some, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    places = F.col("__places")

    def repeated(place: Column, j: Column) -> Column:
        before, after = F.get(places, j - 1)["h"], F.get(places, j + 1)["h"]
        return (place["h"] == before) | (place["h"] == after)

    starts = F.array_sort(F.transform(F.filter(places, repeated), lambda p: p["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words")),
        lambda s, i: F.struct(
            (i + WINDOW).alias("end"),
            (s["words"] + i + WINDOW - F.greatest(s["end"], i)).alias("words"),
        ),
        lambda s: s["words"],
    )
    return (
        docs.withColumn("words", split_words(F.col("text")))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("__hashes", F.when(n >= WINDOW, hashes))
        .withColumn("__places", F.when(F.size(F.array_distinct(some)) < F.size(some), sorted_places))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("word_chars", (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
        .withColumn("__lines", lines)
        .withColumn(
            "n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")
        )
        .drop("__hashes", "__places", "__lines")
    )


def _grams(rows: DataFrame) -> DataFrame:
    """One row per word, with the buckets of the word and of it with the next one."""
    following = F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0)))
    pairs = F.arrays_zip(F.col("words").alias("word"), following.alias("next"))
    others = [c for c in rows.columns if c != "words"]
    spread = rows.withColumn("__pair", F.explode_outer(pairs)).select(
        *others, F.col("__pair.word").alias("__word"), F.col("__pair.next").alias("__next")
    )
    pair = F.when(F.col("__next").isNotNull(), F.pmod(F.xxhash64("__word", "__next"), F.lit(BUCKETS)))
    return spread.select(
        *others,
        F.when(F.col("__word").isNotNull(), F.pmod(F.xxhash64("__word"), F.lit(BUCKETS))).alias("__one"),
        pair.alias("__two"),
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all trusted documents."""
    agreed = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("quality"),
        F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    return agreed.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")


def weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, weight): the log ratio of every bucket, in millionths."""
    ids = trusted.select(F.col("doc_id").alias("__id"), F.lit(1).alias("__trusted"))
    # Labels have no bound, so both sides are shuffled, texts before they are split: one plan at every size.
    rows = docs.select("doc_id", "text").join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("__id"), "left")
    words = split_words(F.col("text")).alias("words")
    grams = _grams(rows.select(words, F.coalesce("__trusted", F.lit(0)).alias("__trusted")))
    counts = (
        grams.select("__trusted", F.explode(F.array("__one", "__two")).alias("bucket"))
        .where(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("__trusted").alias("target"))
    )
    none = F.lit(0).cast("long")
    every = settled(
        docs.sparkSession.range(BUCKETS)
        .withColumnRenamed("id", "bucket")
        .join(counts, "bucket", "left")
        .select("bucket", F.coalesce("raw", none).alias("raw"), F.coalesce("target", none).alias("target")),
        "gram-counts",
    )
    all_raw, all_target = every.agg(F.sum("raw"), F.sum("target")).first()
    if not all_target:
        return every.select("bucket", none.alias("weight"))
    trusted_part = (F.col("target") + 1) / F.lit(float(all_target + BUCKETS))
    raw_part = (F.col("raw") + 1) / F.lit(float(all_raw + BUCKETS))
    ratio = F.log(trusted_part) - F.log(raw_part)
    return every.select("bucket", F.rint(ratio * SCALE).cast("long").alias("weight"))


def scored(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, the columns of ``BASE`` and the score (millionths per n-gram) of every document."""
    based = with_base_rules(docs.select("doc_id", "text")).drop("text")
    rows = based.withColumn("__row", F.monotonically_increasing_id())
    grams = _grams(rows)
    for side in ("__one", "__two"):  # BUCKETS rows, so the broadcast has a bound
        one = table.select(F.col("bucket").alias(side), F.col("weight").alias(f"{side}_weight"))
        grams = grams.join(F.broadcast(one), side, "left")
    total = F.sum(F.coalesce("__one_weight", F.lit(0)) + F.coalesce("__two_weight", F.lit(0)))
    sums = grams.groupBy("__row", "doc_id", *BASE).agg(total.alias("__total"))
    n_grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    return sums.select("doc_id", *BASE, F.expr("__total").alias("__total"), n_grams.alias("__n")).select(
        "doc_id", *BASE, F.floor(F.col("__total") / F.col("__n")).alias("score")
    )


def threshold(scores: DataFrame, trusted: DataFrame) -> int:
    """The quantile of the trusted documents' scores, from a histogram of bounded size."""
    step = SCALE // SCORE_BINS
    most = 20 * SCORE_BINS
    bin_ = F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.col("score") / step)))
    good = scores.join(trusted.hint("shuffle_hash"), "doc_id", "left_semi").where(~base_failed())
    bins = good.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # A window over the histogram, whose bins have a bounded number.
    so_far = F.sum("n").over(Window.orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy())
    passed = bins.select("bin", so_far.alias("so_far"), total.alias("total")).where(
        F.col("so_far") > QUANTILE * F.col("total")
    )
    least = passed.agg(F.min("bin")).first()[0]
    return (-most if least is None else least) * step


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, the columns of ``BASE``, score, base_failed, kept."""
    trusted = settled(trusted_ids(labels), "trusted")
    scores = settled(scored(docs, weights(docs, trusted)), "scores")
    least = threshold(scores, trusted)
    failed = base_failed()
    return scores.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("score") >= least)
    )
