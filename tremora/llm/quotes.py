"""Quotation linking: conversations in reply order, without the passages they quote.

A line's quote level is the number of ``>`` before it.  Quoted passages are
normalised (case, white space) and hashed, in two forms: whole lines, and all runs of
``WINDOW`` words of a level, over the line breaks, so that a quote that has been wrapped
anew, or is a part of a line, is found as well.  In the same conversation, the latest
earlier message that has the passage as its own is what was quoted.  The lookup is
a running window over (conversation, hash), not a join of all pairs, so a line
that everybody writes costs one row per message.  It runs inside stretches of
``STRETCH`` turns first and then over the stretches, so that no task sees all
messages of a long conversation.  A message answers the message that most of its
first-level quoted lines come from (of deeper levels if no first-level line was found),
by runs of words on a tie or where no line was found, and the later one after that.
A quotation of fewer words than a run is found if it is whole lines.

Defined results: a null text has an empty body; rows with a null conversation or
turn keep their body and are linked to nothing; repeated rows stay, each with
the links of its turn; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.llm.common import settled

QUOTED = r"^(?:[ \t]*>)+[ \t]?"
ATTRIBUTION = r"^[ \t]*On\b.*\bwrote:[ \t\r]*$"
KEY = ("conv_id", "turn")
WINDOW = 5  # words
STRETCH = 1024  # turns of a conversation that one window runs over


def _lines(text: Column) -> Column:
    """array<struct<level, body, hash>> of a text's lines; the hash is null for blank lines."""

    def parsed(line: Column) -> Column:
        mark = F.regexp_extract(line, QUOTED, 0)
        body = F.regexp_replace(line, QUOTED, "")
        level = F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))
        plain = F.trim(F.regexp_replace(F.lower(body), r"\s+", " "))
        return F.struct(
            level.alias("level"),
            body.alias("body"),
            F.when(plain != "", F.xxhash64(plain)).alias("hash"),
        )

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), parsed)


def _body(lines: Column) -> Column:
    """Own lines, joined, without the line that announces a quotation."""

    def own(line: Column, i: Column) -> Column:
        following = F.get(lines, i + 1)["level"]
        announces = line["body"].rlike(ATTRIBUTION) & F.coalesce(following > 0, F.lit(False))
        return (line["level"] == 0) & ~announces

    kept = F.transform(F.filter(lines, own), lambda line: line["body"])
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def _with_origin(seen: DataFrame, stretch: int) -> DataFrame:
    """Adds ``origin``, the latest earlier turn that has the line as its own."""
    parted = seen.withColumn("__stretch", F.floor(F.col("turn") / stretch))
    own = F.max(F.when(F.col("own"), F.col("turn")))
    inside = (
        Window.partitionBy("conv_id", "hash", "__stretch")
        .orderBy("turn")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    over = Window.partitionBy("conv_id", "hash").orderBy("__stretch")
    carried = settled(
        parted.groupBy("conv_id", "hash", "__stretch")
        .agg(own.alias("__last"))
        .withColumn("__before", F.max("__last").over(over.rowsBetween(Window.unboundedPreceding, -1)))
        .where(F.col("__before").isNotNull())
        .drop("__last"),
        "stretches",
    )
    return (
        parted.withColumn("__inside", own.over(inside))
        .join(carried, ["conv_id", "hash", "__stretch"], "left")
        .withColumn("origin", F.coalesce("__inside", "__before"))
        .drop("__stretch", "__inside", "__before")
    )


def _seen_lines(messages: DataFrame) -> DataFrame:
    """One row per message and line: whether it is the message's own, and the lowest level it is quoted at."""
    lines = (
        messages.select(*KEY, F.explode(_lines(F.col("text"))).alias("line"))
        .select(*KEY, "line.level", "line.hash")
        .dropna(subset=[*KEY, "hash"])
    )
    return lines.groupBy(*KEY, "hash").agg(
        F.max(F.col("level") == 0).alias("own"), F.min(F.when(F.col("level") > 0, F.col("level"))).alias("level")
    )


def _windows(lines: Column, length: int) -> Column:
    """array<struct<level, hash>>: the runs of words at each quote level, over the line breaks."""

    def of_level(level: Column) -> Column:
        same = F.filter(lines, lambda line: line["level"] == level)
        plain = F.transform(same, lambda line: F.trim(F.regexp_replace(F.lower(line["body"]), r"\s+", " ")))
        words = F.split(F.trim(F.array_join(F.filter(plain, lambda text: text != ""), " ")), " ")

        def runs(words: Column) -> Column:
            at = F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - length + 1))
            return F.transform(
                F.coalesce(at, F.array().cast("array<int>")),
                lambda i: F.struct(
                    level.alias("level"), F.xxhash64(F.lit("window"), *[F.get(words, i + k - 1) for k in range(length)]).alias("hash")
                ),
            )

        # An array of one, so that the words are made once and not once a run.
        return F.flatten(F.transform(F.array(words), runs))

    levels = F.array_distinct(F.transform(lines, lambda line: line["level"]))
    return F.flatten(F.transform(levels, of_level))


def _seen_windows(messages: DataFrame, length: int) -> DataFrame:
    """As ``_seen_lines``, of runs of words; own ones only where the conversation quotes them."""
    lines = messages.select(*KEY, _lines(F.col("text")).alias("__lines")).dropna(subset=list(KEY))
    # Conversations without a quoted line have nothing to look up.
    quoting = lines.where(F.exists("__lines", lambda line: line["level"] > 0)).select("conv_id").distinct()
    quoting = settled(quoting, "quoting")
    windows = (
        lines.join(quoting, "conv_id", "left_semi")
        .select(*KEY, F.explode(_windows(F.col("__lines"), length)).alias("window"))
        .groupBy(*KEY, "window.hash")
        .agg(
            F.max(F.col("window.level") == 0).alias("own"),
            F.min(F.when(F.col("window.level") > 0, F.col("window.level"))).alias("level"),
        )
    )
    windows = settled(windows, "windows")
    quoted = settled(windows.where(F.col("level").isNotNull()).select("conv_id", "hash").distinct(), "quoted")
    return windows.join(quoted, ["conv_id", "hash"], "left_semi")


def _votes(found: DataFrame, first: str, every: str) -> DataFrame:
    """Per message and origin, what was found there: at the first level, and at all."""
    return found.where(F.col("level").isNotNull() & F.col("origin").isNotNull()).groupBy(*KEY, "origin").agg(
        F.count_if(F.col("level") == 1).alias(first), F.count(F.lit(1)).alias(every)
    )


def reply_links(messages: DataFrame, stretch: int = STRETCH, window: int = WINDOW) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked) of the messages whose quotations were found.

    ``n_linked`` counts the lines that were found, or the runs of words where no line was.
    """
    lines = _votes(_with_origin(_seen_lines(messages), stretch), "first", "all")
    windows = _votes(_with_origin(_seen_windows(messages, window), stretch), "first_windows", "windows")
    names = ["first", "all", "first_windows", "windows"]
    votes = lines.join(windows, [*KEY, "origin"], "full").na.fill(0, names)
    return votes.groupBy(*KEY).agg(
        F.max(F.struct(*names, "origin"))["origin"].alias("reply_to"),
        F.when(F.sum("all") > 0, F.sum("all")).otherwise(F.sum("windows")).alias("n_linked"),
    )


def _threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth): the message a chain of replies starts from, by pointer
    doubling, so that a chain of n replies takes log2(n) rounds."""
    state = settled(
        links.select(*KEY, F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")),
        "threads",
    )
    while True:
        above = state.select(
            "conv_id",
            F.col("turn").alias("thread"),
            F.col("thread").alias("__thread"),
            F.col("depth").alias("__depth"),
        )
        longer = state.join(above, ["conv_id", "thread"], "left")
        if longer.where(F.col("__thread").isNotNull()).isEmpty():
            return state
        state = settled(
            longer.select(
                *KEY,
                F.coalesce("__thread", "thread").alias("thread"),
                (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"),
            ),
            "threads",
        )


def linked_conversations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, body, n_quoted, n_linked, reply_to, thread, depth,
    formatted.  Ordered by (conv_id, thread, turn), replies follow what they answer."""
    messages = messages.select(*KEY, "role", "text")
    links = settled(reply_links(messages), "links")
    info = links.join(_threads(links), [*KEY], "left")
    parsed = messages.withColumn("__lines", _lines(F.col("text"))).select(
        *KEY,
        "role",
        _body(F.col("__lines")).alias("body"),
        F.size(F.filter("__lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
    )
    return parsed.join(info, [*KEY], "left").select(
        *KEY,
        "role",
        "body",
        "n_quoted",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "body").alias(
            "formatted"
        ),
    )


def write_conversations(messages: DataFrame, path: str) -> None:
    """Chat lines in reply order, conversations side by side; no conversation is collected."""
    order = ["conv_id", "thread", "turn"]
    (
        linked_conversations(messages)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.json(path)
    )
