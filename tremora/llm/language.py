"""Language identification by fusing evidence.

The posterior of a language is the product of
* the text's likelihood under byte-bigram models, fitted on a bounded sample of
  the rows that declare a language, drawn per language so that a rare one is
  fitted on all its rows, with the exponent ``TEMPER`` since neighbouring bigrams
  aren't independent;
* how often texts of the language come with this declared language and this
  address suffix; and
* the prior of the host, smoothed by its domain's, which is smoothed by that of
  all hosts.
The last two are grouped aggregations over all rows, of the language that the
text alone suggests.  Declared languages and addresses may thus be wrong, rare
or missing: their weight is what the corpus shows it to be.

A row is accepted if its text has letters, fits its language better than byte
frequencies alone do, and the posterior is at least ``LEAST``.

Defined results: null, empty and letterless texts have the language ``und`` and
are rejected; a null declared language or address is evidence of its own kind or
none; rows that repeat an id are judged each by itself; where no row declares a
language there is no model, and all are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import settled

SAMPLE = 20_000  # rows that the text models are fitted on, about
TEMPER = 0.3
SMOOTHING = 20.0  # rows that a domain's or the general prior counts as
LEAST = 0.5
NONE = "und"
PIECE = 1 << 20  # bigrams that are gathered at a time

# Bytes other than letters become spaces; bytes beyond ASCII are parts of letters.
_LETTERS = bytes(b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256))
_BLANK = 32 * 256 + 32


def _bigrams(text: bytes) -> np.ndarray:
    plain = np.frombuffer(b" " + text.lower().translate(_LETTERS) + b" ", np.uint8).astype(np.int32)
    pairs = plain[:-1] * 256 + plain[1:]
    return pairs[pairs != _BLANK]


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, domain, suffix) of an address; an address without a dot is host and domain."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    suffix = F.regexp_extract(host, r"\.([^.]+)$", 1)
    return host, F.when(domain != "", domain).otherwise(host), F.when(suffix != "", suffix)


def language_code(declared: Column) -> Column:
    """The first part of a language tag, in small letters."""
    code = F.lower(F.regexp_extract(F.trim(declared), r"^([A-Za-z]{2,3})\b", 1))
    return F.when(code != "", code)


def with_clues(rows: DataFrame, row_id: Column, text: Column, declared: Column, address: Column) -> DataFrame:
    host, domain, suffix = address_parts(address)
    return (
        rows.withColumn("__text", F.coalesce(text, F.lit("")))
        # By id and text: of the copies of a text, as large a share is sampled as of all rows.
        .withColumn("__draw", F.pmod(F.xxhash64(row_id, "__text"), F.lit(1 << 30)))
        .withColumn("__declared", language_code(declared))
        .withColumn("__host", host)
        .withColumn("__domain", domain)
        .withColumn("__suffix", suffix)
    )


def rows_per_language(counts: list[int], bound: int) -> int:
    """The largest number of rows such that as many of each language, or all it has, are within the bound."""
    left, each = bound, bound
    for i, n in enumerate(sorted(counts)):
        each = left // (len(counts) - i)
        if n > each:
            return max(each, 1)
        left -= n
    return max([each, *counts])


@dataclass
class TextModel:
    """Log likelihoods of byte bigrams, stored by the bigrams that a language has in its sample.

    Of the others, a language needs one number per first byte, so a model of thousands
    of languages is as large as the sample, not 65,536 numbers for each.
    """

    languages: list[str]
    first: np.ndarray  # per first byte and language: log of what its conditional frequencies are divided by
    smooth: np.ndarray  # per bigram: log of the smoothing that every language has
    general: np.ndarray  # per bigram: log of the second byte's frequency
    ends: np.ndarray  # where the entries of each bigram end
    entries: np.ndarray  # languages that have the bigram
    gains: np.ndarray  # their log frequencies over the smoothing alone

    def likelihoods(self, text: bytes) -> tuple[np.ndarray, float, int]:
        """Per language; of byte frequencies; and the number of bigrams."""
        pairs = _bigrams(text)
        times = np.bincount(pairs, minlength=1 << 16)
        bins = np.flatnonzero(times)
        times = times[bins].astype(np.float64)
        n = len(self.languages)
        sums = times @ self.smooth[bins] - np.bincount(bins >> 8, times, 256) @ self.first
        stop = self.ends[bins]
        sizes = stop - np.where(bins > 0, self.ends[bins - 1], 0)
        total = np.cumsum(sizes)
        at = 0
        while at < len(bins):  # a bigram has one entry per language at most
            to = max(at + 1, int(np.searchsorted(total, total[at] - sizes[at] + PIECE, "right")))
            size = sizes[at:to]
            places = np.repeat(stop[at:to] - np.cumsum(size), size) + np.arange(size.sum())
            sums += np.bincount(self.entries[places], self.gains[places] * np.repeat(times[at:to], size), n)
            at = to
        return sums, float(times @ self.general[bins]), len(pairs)


def fit_text_model(rows: DataFrame) -> TextModel:
    """From rows with clues; only counts per language and bigram reach the driver."""
    declared = rows.where(F.col("__declared").isNotNull())
    # At most 26^2 + 26^3 languages, as there are codes.
    sizes = settled(
        declared.groupBy("__declared").agg(F.count(F.lit(1)).alias("__n"), F.min("__draw").alias("__lowest")),
        "languages",
    )
    rows_of = {r["__declared"]: r["__n"] for r in sizes.select("__declared", "__n").collect()}
    languages = sorted(rows_of)
    each = rows_per_language(list(rows_of.values()), SAMPLE)
    # The row drawn first is always in, so that no language is left without one.
    share = F.greatest(F.floor(F.lit(each * float(1 << 30)) / F.col("__n")), F.col("__lowest"))
    chosen = (F.col("__n") <= each) | (F.col("__draw") <= share)
    sample = declared.join(sizes, "__declared").where(chosen)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, texts in batch.groupby("__declared")["__text"]:
                one = np.zeros(1 << 16, np.int64)
                for text in texts:
                    one += np.bincount(_bigrams(text), minlength=1 << 16)
                bins = np.flatnonzero(one)
                yield pd.DataFrame({"language": language, "bin": bins, "n": one[bins]})

    counted = (
        sample.select("__declared", F.col("__text").cast("binary").alias("__text"))
        .mapInPandas(count, "language string, bin int, n long")
        .groupBy("language", "bin")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # the distinct bigrams of SAMPLE rows at most
    )
    n = len(languages)
    place = {language: i for i, language in enumerate(languages)}
    which = counted["language"].map(place).to_numpy(np.int64)
    bins = counted["bin"].to_numpy(np.int64)
    times = counted["n"].to_numpy(np.float64)
    order = np.lexsort((which, bins))
    which, bins, times = which[order], bins[order], times[order]
    # Languages count for the byte frequencies as much as they have rows, however many were drawn.
    weight = np.array([max(1.0, rows_of[language] / each) for language in languages] or [0.0])
    single = np.bincount(bins & 255, times * weight[which], 256) + 0.5
    single /= single.sum()
    # Conditional on the first byte, smoothed by the second byte's frequency.
    firsts = np.bincount((bins >> 8) * n + which, times, 256 * n).reshape(256, n)
    return TextModel(
        languages,
        np.log(firsts + 8),
        np.tile(np.log(8 * single), 256),
        np.tile(np.log(single), 256),
        np.cumsum(np.bincount(bins, minlength=1 << 16)),
        which.astype(np.int32),
        np.log1p(times / (8 * single[bins & 255])).astype(np.float32),
    )


def with_best(rows: DataFrame, model: TextModel) -> DataFrame:
    """Adds ``__best``, the place of the language that the text alone suggests, null without bigrams."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("int")
    def best(texts: pd.Series) -> pd.Series:
        def one(text: bytes) -> int | None:
            sums, _, n = shared.value.likelihoods(text)
            return int(sums.argmax()) if n else None

        return texts.map(one).astype("Int32")

    return rows.withColumn("__best", best(F.col("__text").cast("binary")))


def _seen(counts: DataFrame, key: str) -> DataFrame:
    """key -> its languages and how many rows it has of each; languages it has none of are left out."""
    each = counts.where(F.col(key).isNotNull()).groupBy(key, "__best").agg(F.sum("n").cast("double").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("__best", "n")))  # one per language at most
    return each.groupBy(key).agg(pairs.alias("__pairs"), F.sum("n").alias("__total"))


def _host_table(counts: DataFrame) -> DataFrame:
    """Host -> the languages of its domain and, for each, by how many times the general prior's share it is seen.

    The host's prior, smoothed by its domain's, is proportional to the general one plus these numbers.
    """
    domains = settled(
        _seen(counts, "__domain").select("__domain", F.col("__pairs").alias("__wide"), F.col("__total").alias("__all")),
        "domains",
    )
    own = counts.groupBy("__host").agg(F.min("__domain").alias("__domain"))  # a host has one domain
    hosts = _seen(counts, "__host").join(own, "__host").join(domains, "__domain")
    n_own = F.map_from_entries("__pairs")

    def times(pair: Column) -> Column:
        in_host = F.coalesce(F.element_at(n_own, pair["__best"]), F.lit(0.0))
        return (in_host * (F.col("__all") + SMOOTHING) + SMOOTHING * pair["n"]) / SMOOTHING**2

    return hosts.select(
        "__host",
        F.transform("__wide", lambda pair: pair["__best"]).alias("__host_which"),
        F.transform("__wide", times).alias("__host_times"),
    )


def fused(rows: DataFrame, clues: DataFrame, model: TextModel) -> DataFrame:
    """Adds ``language``, ``probability`` and ``accepted``.

    ``rows``: rows with clues that the result is about;
    ``clues``: the clue columns and ``__best`` of the same rows, for the aggregations.
    """
    n = len(model.languages)
    if not n:
        return rows.withColumns(
            {"language": F.lit(NONE), "probability": F.lit(0.0), "accepted": F.lit(False)}
        )
    keys = ["__host", "__domain", "__suffix", "__declared"]
    # Rows without a best one are left out after writing: a filter before it runs the model a second time, in
    # Python workers of its own.
    counts = settled(clues.groupBy(*keys, "__best").agg(F.count(F.lit(1)).alias("n")), "clues")
    counts = counts.where("__best is not null")
    sizes = np.ones(n)
    for r in counts.groupBy("__best").agg(F.sum("n").alias("n")).collect():
        sizes[r["__best"]] += r["n"]
    # Small unless there are many hosts; written, so that Spark knows their size.
    tables = {"__host": settled(_host_table(counts), "hosts")}
    for key, name in (("__suffix", "suffixes"), ("__declared", "declared")):
        table = _seen(counts, key).select(
            key,
            F.transform("__pairs", lambda pair: pair["__best"]).alias(f"{key}_which"),
            F.transform("__pairs", lambda pair: pair["n"]).alias(f"{key}_times"),
        )
        tables[key] = settled(table, name)
    shared = rows.sparkSession.sparkContext.broadcast((model, sizes))

    @F.pandas_udf("language string, probability double, fits boolean")
    def judge(
        texts: pd.Series,
        host: pd.Series, host_times: pd.Series,
        suffix: pd.Series, suffix_times: pd.Series,
        declared: pd.Series, declared_times: pd.Series,
    ) -> pd.DataFrame:
        model, sizes = shared.value
        general = sizes / sizes.sum()
        found = []
        for text, which, times, *others in zip(
            texts, host, host_times, suffix, suffix_times, declared, declared_times
        ):
            sums, bytes_alone, pairs = model.likelihoods(text)
            if not pairs:
                found.append((NONE, 0.0, False))
                continue
            prior = general.copy()
            if which is not None:
                prior[which] += times
            logs = TEMPER * sums + np.log(prior)
            for seen, n_seen in (others[:2], others[2:]):
                if seen is not None:  # (n + 1/2) of the language's rows, for each language
                    logs -= np.log(sizes)
                    logs[seen] += np.log1p(2 * n_seen)
            winner = int(logs.argmax())
            probability = 1 / np.exp(logs - logs[winner]).sum()
            found.append((model.languages[winner], probability, bool(sums[winner] > bytes_alone)))
        return pd.DataFrame(found, columns=["language", "probability", "fits"])

    for key, table in tables.items():
        rows = rows.join(table, key, "left")
    parts = [F.col(f"{key}_{part}") for key in tables for part in ("which", "times")]
    rows = rows.withColumn("__found", judge(F.col("__text").cast("binary"), *parts))
    return (
        rows.withColumn("language", F.col("__found.language"))
        .withColumn("probability", F.round("__found.probability", 6))
        .withColumn("accepted", F.col("__found.fits") & (F.col("probability") >= LEAST))
        .drop("__found", *[f"{key}_{part}" for key in tables for part in ("which", "times")])
    )


def _identified(rows: DataFrame, kept: list[str]) -> DataFrame:
    """Narrow result: the text is read for the sample, for what it suggests, and for the judgement."""
    model = fit_text_model(rows)
    found = fused(rows, with_best(rows, model), model)
    return found.select(*kept, "language", "probability", "accepted", F.col("__declared").alias("declared"))


def document_languages(docs: DataFrame) -> DataFrame:
    """doc_id, language, probability, accepted, declared; a document's source is its host."""
    rows = docs.select("doc_id", "text", "lang", "source")
    rows = with_clues(rows, F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source"))
    return _identified(rows, ["doc_id"])


def page_languages(pages: DataFrame) -> DataFrame:
    """page_id, language, probability, accepted, declared of web pages: the markup's language
    attribute, the address and the text outside tags, scripts and styles."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", 1)
    rows = with_clues(pages.select("page_id", "url", "html"), F.col("page_id"), text, declared, F.col("url"))
    return _identified(rows.drop("html"), ["page_id"])


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language was identified, with all their columns."""
    rows = with_clues(docs, F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source"))
    model = fit_text_model(rows)
    clues = with_best(rows, model).select("__host", "__domain", "__suffix", "__declared", "__best")
    # Named apart from columns of the documents that may be called the same.
    outer = rows.withColumnsRenamed({c: f"__doc_{c}" for c in docs.columns})
    found = fused(outer, clues, model).where("accepted")
    return found.select(*[F.col(f"__doc_{c}").alias(c) for c in docs.columns])
