"""Secret scans with an incremental ledger of blobs.

Every version of a text is a blob, addressed by its SHA-256.  The ledger has one
row per blob, rule and version of the rule, with the spans found.  A scan looks
up which (blob, rule, version) are not in the ledger yet, reads only those
texts, appends their rows, and joins the findings back to every path (document)
that has the blob.  A second run over the same texts scans nothing; a new
version of one rule scans the texts for that rule alone.

Spans are places of code points, the end exclusive.  A rule is applied by
splitting the text at its matches: the lengths of the pieces and of the matches
add up to the places, without a loop over the text outside the regular
expressions.

Defined results: a null text is the empty text and has no findings; repeated
rows and copies share a blob, scanned once; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import settled
from tremora.sources.shared import path_exists


@dataclass(frozen=True)
class Rule:
    """Matches of the pattern whose group has at least so many characters are findings.

    ``hint`` matches in every text that has a finding; others are not split.
    """

    name: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str


# Fixed values.
RULES = (
    Rule(
        "assign",
        1,
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)


def address(text: Column) -> Column:
    """The content address of a text."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def rule_spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's findings in a text."""
    places = "array<struct<start:bigint,end:bigint>>"
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long"))
    matches = F.transform(
        F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x).cast("long")
    )
    groups = F.transform(
        F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x).cast("long")
    )
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(places).alias("spans"))

    def step(state: Column, match: Column) -> Column:
        start = state["at"] + match["gap"]
        end = start + match["length"]
        found = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(match["group"] >= rule.least, F.concat(state["spans"], found))
        return F.struct(end.alias("at"), spans.otherwise(state["spans"]).alias("spans"))

    pieces = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(matches)),
        F.arrays_zip(matches.alias("length"), groups.alias("group")),
        lambda gap, m: F.struct(
            gap.alias("gap"), m["length"].alias("length"), m["group"].alias("group")
        ),
    )
    found = F.aggregate(pieces, nothing, step, lambda state: state["spans"])
    return F.when(text.rlike(rule.hint), found).otherwise(F.array().cast(places))


def extend_ledger(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at the path has not seen, append it, and return the ledger."""
    spark = docs.sparkSession
    blobs = docs.select(address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    known = spark.read.parquet(ledger) if path_exists(spark, ledger) else None
    scanned = None
    if known is None:
        # Copies of a blob meet after one row of each has been kept on every side of the shuffle.
        scanned = blobs.dropDuplicates(["blob"]).withColumn("__open", F.lit((1 << len(rules)) - 1))
    else:
        # Bit i is set where rule i, in its version, has not seen the blob.
        wanted = [(F.col("rule") == r.name) & (F.col("version") == r.version) for r in rules]
        seen = known.select(
            "blob",
            sum((F.when(w, F.lit(1 << i)).otherwise(0) for i, w in enumerate(wanted)), F.lit(0)).alias("bit"),
        ).groupBy("blob").agg(F.bit_or("bit").alias("bits"))
        left = blobs.join(seen, "blob", "left").withColumn(
            "__open", F.lit((1 << len(rules)) - 1).bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0))))
        )
        scanned = left.where(F.col("__open") != 0).dropDuplicates(["blob"])
    rows = F.array(
        *[
            F.when(
                F.col("__open").bitwiseAND(F.lit(1 << i)) != 0,
                F.struct(
                    F.lit(r.name).alias("rule"),
                    F.lit(r.version).alias("version"),
                    rule_spans(F.col("text"), r).alias("spans"),
                ),
            )
            for i, r in enumerate(rules)
        ]
    )
    found = scanned.select("blob", F.inline(F.filter(rows, lambda x: x.isNotNull())))
    found.write.mode("append").parquet(ledger)
    return spark.read.schema(found.schema).parquet(ledger)


def findings(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, blob, and per rule an array of spans (``<rule>_spans``)."""
    table = extend_ledger(docs, ledger, rules)
    wanted = [(F.col("rule") == r.name) & (F.col("version") == r.version) for r in rules]
    by_blob = table.groupBy("blob").agg(
        *[F.first(F.when(w, F.col("spans")), ignorenulls=True).alias(f"{r.name}_spans") for r, w in zip(rules, wanted)]
    )
    some = by_blob.where(sum((F.size(f"{r.name}_spans") for r in rules), F.lit(0)) > 0)
    # Written before it is joined: Spark splits the copies of one blob where both sides are plain shuffles.
    found = settled(some, "findings")
    paths = docs.select("doc_id", address(F.col("text")).alias("blob"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    joined = paths.join(found, "blob", "left")
    return joined.select(
        "doc_id", "blob", *[F.coalesce(f"{r.name}_spans", none).alias(f"{r.name}_spans") for r in rules]
    )


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts per rule, and all spans as text, of the rows of ``findings``."""

    def kinds(i: int, rule: Rule) -> Column:
        """Sorted by start, then by the rules' order."""
        return F.transform(
            f"{rule.name}_spans",
            lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")),
        )

    every = F.sort_array(
        F.concat(
            *[kinds(i, r) for i, r in enumerate(rules)]
        )
    )
    names = F.array(*[F.lit(r.name) for r in rules])
    shown = F.transform(
        every, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    )
    return found.select(
        "doc_id",
        *[F.size(f"{r.name}_spans").cast("long").alias(f"n_{r.name}") for r in rules],
        F.array_join(shown, ",").alias("spans"),
    ).select("*", F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"))


def masked_documents(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every finding replaced; of overlapping findings, the union is.

    Texts without findings pass unchanged (a null text stays null); only the
    findings, a small table, are joined to the documents.
    """
    table = extend_ledger(docs, ledger, rules)
    wanted = F.concat_ws(":", "rule", "version").isin([f"{r.name}:{r.version}" for r in rules])
    by_blob = settled(
        table.where(wanted & (F.size("spans") > 0))
        .groupBy(F.col("blob").alias("__blob"))
        .agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("__spans")),
        "findings",
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("kept"))
    text = F.col("text")

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        fresh = span["start"] >= state["at"]
        kept = F.when(fresh, F.concat(state["kept"], gap, F.lit(mask))).otherwise(state["kept"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), kept.alias("kept"))

    clean = F.aggregate(
        F.col("__spans"),
        start,
        step,
        lambda s: F.concat(s["kept"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))),
    )
    # One plan at every size: findings grow with the corpus, so no size of theirs is a bound.
    joined = docs.withColumn("__blob", address(text)).join(by_blob.hint("merge"), "__blob", "left")
    shown = {c: F.col(c) for c in docs.columns} | {
        "text": F.when(F.col("__spans").isNotNull(), clean).otherwise(text)
    }
    if "n_chars" in docs.columns:
        shown["n_chars"] = F.when(F.col("__spans").isNotNull(), F.length(clean)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[shown[c].alias(c) for c in docs.columns])
