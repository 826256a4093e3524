"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model goes on over a white space marker: markers stand at the
front of a piece or make up the whole of it.  So a text, its spaces marked, falls
into chunks (a run of markers and what follows it, up to the next run or line
end, and up to a stop where no piece joins letters and stops) whose segmentations
don't depend on each other.  A task keeps one table of
distinct chunks: each is segmented and decoded by the library once, and a text is
the list of its chunks' numbers, in whose places the ids and the decoded strings
are put back.  A table that has ``KNOWN`` chunks, or ``CHARACTERS`` in all, starts
anew with the next block; texts are taken in blocks of ``BLOCK`` bytes, whole texts always.

The table is one for each task, not for the corpus: it never leaves memory, so
nothing is shuffled.  A model that doesn't allow for chunks (a piece with a marker
inside, normalisation, no byte pieces) gets whole texts as its chunks.

Defined results: a null text is empty; an empty text has no ids and decodes to an
empty text; a marker in a text decodes to a space, as in the library; rows that
repeat an id are rows of their own, null ids stay null; an empty table has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import byte_slices

MARK = "▁"
# Letters and stops that a model may or may not join in a piece.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
STOPS = r""".,;:!?()\[\]{}\""""
JOINED = re.compile(f"[{LETTERS}][{STOPS}]|[{STOPS}][{LETTERS}]")
CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
SHORT_CHUNK = re.compile(
    f"{MARK}*[{LETTERS}]+(?![^{STOPS}{MARK}\n])|{MARK}*[{STOPS}]+(?![^{LETTERS}{MARK}\n])|{CHUNK.pattern}"
)
KNOWN = 400_000  # chunks of a table
CHARACTERS = 12_000_000  # of the chunks of a table
BLOCK = 1 << 22  # bytes of text at a time

# Has what normalisers change: double and outer spaces, wide letters, ligatures, marks, other spaces.
UNTOUCHED = "  a  Ａﬁ é é 　\tb\r\n  "


class Numbers(dict):
    """Numbers of keys in the order of their first use."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class ChunkTable:
    """Ids and decoded string of every distinct chunk of a model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.in_chunks = (
            not any(re.search(f"[^{MARK}]{MARK}|\n", piece) for piece in pieces)
            and sum(map(self.model.is_byte, range(len(pieces)))) == 256
            and self.model.encode("") == []
            and self.model.decode(self.model.encode(UNTOUCHED)) == UNTOUCHED
        )
        self.chunk = CHUNK if any(map(JOINED.search, pieces)) else SHORT_CHUNK
        self.line_end = self.model.encode("\n")  # a marker and the line end
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        self.ids: list[list[int]] = []
        self.shown: list[str] = []  # behind another chunk
        self.characters = 0

    def cut(self, text: str) -> list[str]:
        if not self.in_chunks:
            return [text]
        return self.chunk.findall(MARK + text.replace(" ", MARK)) if text else []

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks; the library puts a marker in front of whatever it encodes."""
        if not self.in_chunks:
            return self.model.encode(chunks, num_threads=1)
        marked = [chunk[0] == MARK for chunk in chunks]
        given = [chunk[1:] if mark else "\n" + chunk for chunk, mark in zip(chunks, marked)]
        found = self.model.encode(given, num_threads=1)
        lone = self.line_end[:1]
        return [
            (ids or lone) if mark else ids[len(self.line_end) :] for ids, mark in zip(found, marked)
        ]

    def learn(self) -> None:
        """Segment and decode the chunks that have got a number since the last time."""
        fresh = list(islice(self.numbers, len(self.ids), None))
        self.characters += sum(map(len, fresh))
        ids = self.segment(fresh)
        self.ids += ids
        if self.in_chunks:
            # A line end in front, so that the library doesn't take the chunk for the text's first.
            before = self.line_end[1:]
            self.shown += [shown[1:] for shown in self.model.decode([before + x for x in ids])]
        else:
            self.shown += self.model.decode(ids) if ids else []

    def first_shown(self, number: int) -> str:
        """Decoded as the first chunk of a text, whose first marker is not shown."""
        return self.model.decode(self.ids[number])

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids and decoded text of each text."""
        if len(self.numbers) > KNOWN or self.characters > CHARACTERS:
            self.clear()
        cut = [list(map(self.numbers.__getitem__, self.cut(text))) for text in texts]
        self.learn()
        for places in cut:
            ids = np.fromiter(chain.from_iterable(map(self.ids.__getitem__, places)), np.int32)
            shown = ""
            if places:
                rest = map(self.shown.__getitem__, islice(places, 1, None))
                shown = self.first_shown(places[0]) + "".join(rest)
            yield ids, shown


_loaded: dict[str, ChunkTable] = {}  # of a Python worker, which serves many tasks


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = ChunkTable(path)
        table = _loaded[path]
        for batch in batches:
            for rows in byte_slices(batch, "text", BLOCK):
                found = list(table.encode(rows.column("text").to_pylist()))
                stops = np.cumsum([0, *(len(ids) for ids, _ in found)])
                flat = np.concatenate([ids for ids, _ in found])
                lists = pa.ListArray.from_arrays(stops.astype(np.int32), flat)
                shown = pa.array([text for _, text in found], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), lists, shown], names=["doc_id", "ids", "decoded"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids array<int>, decoded string")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the hashes of the ids in decimal and of the decoded text."""
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
