"""Quotations that are wrapped anew, partial or nested, against a brute force."""

from __future__ import annotations

import random
import re
import textwrap

from corpus_rows import empty  # noqa: F401
from pyspark.sql import functions as F

from tremora.llm import quotes

random.seed(31)
SCHEMA = "conv_id long, turn long, role string, text string"
WORDS = ["".join(random.choices("abcdefgh", k=random.randrange(3, 8))) for _ in range(500)]


def same(frame, want):
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(want, key=repr)


def passages(text):
    """(level, kind, passage) of a text: its lines, and its runs of five words at each level."""
    found, words = [], {}
    for line in (text or "").split("\n"):
        mark = re.match(r"(?:[ \t]*>)+[ \t]?", line)
        level = mark[0].count(">") if mark else 0
        plain = " ".join((line[len(mark[0]) :] if mark else line).lower().split())
        if plain:
            found.append((level, "line", plain))
            words.setdefault(level, []).extend(plain.split())
    for level, run in words.items():
        found += [(level, "window", " ".join(run[i : i + 5])) for i in range(len(run) - 4)]
    return found


def links_by_hand(rows):
    seen = {(c, t): passages(text) for c, t, _, text in rows}
    for (conv, turn), found in seen.items():
        lowest = {}
        for level, *passage in found:
            if level:
                lowest[tuple(passage)] = min(level, lowest.get(tuple(passage), level))
        votes = {}
        for passage, level in lowest.items():
            origins = [t for (c, t), other in seen.items() if c == conv and t < turn and (0, *passage) in other]
            if origins:
                tally = votes.setdefault(max(origins), [0, 0, 0, 0])
                at = 0 if passage[0] == "line" else 2
                tally[at] += level == 1
                tally[at + 1] += 1
        if votes:
            lines, windows = sum(v[1] for v in votes.values()), sum(v[3] for v in votes.values())
            yield conv, turn, max((*v, t) for t, v in votes.items())[4], lines or windows


def quoted(text, width, depth=1):
    lines = [line for part in text.split("\n") for line in (textwrap.wrap(part, width) or [""])]
    return "\n".join(">" * depth + " " + line for line in lines)


def test_threads_of_all_kinds(spark):
    rows = []
    for conv in range(25):
        texts = []
        for turn in range(12):
            own = "\n".join(" ".join(random.choices(WORDS, k=random.randrange(1, 25))) for _ in range(random.randrange(1, 4)))
            parts = []
            for _ in range(random.randrange(0, 3) if texts else 0):
                source = random.choice(texts)
                kind = random.randrange(4)
                if kind == 0:
                    parts.append(quoted(source, random.choice([20, 40, 200])))
                elif kind == 1:  # a part of a line
                    words = source.split()
                    at = random.randrange(len(words))
                    parts.append("> " + " ".join(words[at : at + random.randrange(2, 12)]).upper())
                elif kind == 2:
                    parts.append(quoted(source, 30, 2))
                else:
                    parts.append(quoted(quoted(source, 50), 60))
            text = "\n".join([*parts, own])
            texts.append(own)
            rows.append((conv, turn, "user", text))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = list(links_by_hand(rows))
    assert len(want) > 100
    for stretch in (5, 1024):
        same(quotes.reply_links(frame, stretch), want)


def test_wrapped_anew_and_half_a_line(spark):
    first = "The cubes are built from the merged events and not from the star,\nso no join is needed at all"
    rows = [
        (1, 0, "user", first),
        (1, 1, "user", "Something else that nobody quotes at any time here"),
        (1, 2, "user", quoted(first.replace("\n", " "), 28) + "\nyes"),
        (1, 3, "user", "> from the merged events and not\nwhy?"),
        (2, 0, "user", "> from the merged events and not\nanother conversation"),
    ]
    found = quotes.linked_conversations(spark.createDataFrame(rows, SCHEMA))
    same(found.select("conv_id", "turn", "reply_to", "body"), [
        (1, 0, None, first), (1, 1, None, rows[1][3]), (1, 2, 0, "yes"), (1, 3, 0, "why?"), (2, 0, None, "another conversation"),
    ])
    assert found.where("conv_id = 1 and turn = 3").first().n_linked == 2


def test_long_texts_clashing_columns_and_no_rows(spark, tmp_path):
    long = " ".join(random.choices(WORDS, k=30_000))
    rows = [(1, 0, "user", long), (1, 1, "bot", quoted(long, 70) + "\nread"), (None, 1, "user", "> x"), (1, None, "user", long), (2, 5, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    extra = frame.withColumn("level", F.lit("x")).withColumn("hash", F.lit(1.5)).withColumn("origin", F.lit(None)).withColumn("window", F.lit(2))
    found = quotes.linked_conversations(extra)
    assert sorted((r.reply_to is None, r.body or "") for r in found.collect())[0] == (False, "read")
    assert found.count() == 5
    quotes.write_conversations(frame, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 5
    assert quotes.linked_conversations(frame.limit(0)).count() == 0
