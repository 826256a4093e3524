"""Alignment, SentencePiece and spelling operators against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from corpus_rows import awkward, documents, empty  # noqa: F401
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tremora.llm import alignment, sentencepieces, spelling
from tremora.llm.common import settled

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
STRANGE = [
    "", " ", "  ", "\n", "\n\n", " \n", "\n a", "a ", "a\n", " a", "  a  b  ", "a\n\nb", "a \n b", "a\tb\r\nc", "\x00a\x1cb",
    "a▁b", "▁", "▁▁ ▁", "wörd　wide", "Ａﬁ é é", "😀‍😀 x", "<s>a</s><unk><0x0A>", "<|endoftext|> it's 'll", "中文 中文。日本",
    "1234 5,678.90", " " * 700 + "x", "=" * 900, "a" * 5000, "'s", " 's it 's",
]
random.seed(11)
LETTERS = [*"  \n\nabth eing.,.,()'é\t\r 　ﬁ😀‍\x00\x1c<s>1", "the", "'s", "'ll", " '", "<s>", "<|endoftext|>", "中文", "   ", "\r\n", " \n"]
RANDOM = ["".join(random.choices([*LETTERS, *"▁" * (k % 9 == 0)], k=random.randrange(30))) for k in range(3000)]


def same(frame, want):
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def strange(spark):
    return spark.createDataFrame(list(enumerate(STRANGE + RANDOM)), "doc_id long, text string")


@pytest.fixture(params=["documents", "awkward", "empty", "strange"])
def any_docs(request):
    return request.getfixturevalue(request.param)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Alignment


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=PIECES)
    return a, b, alignment.byte_level_bytes(a), alignment.piece_bytes(b)


def groups_of(text, models):
    """Groups of (A ids, B ids), by the set of common ends."""
    a, b, a_bytes, b_bytes = models
    if not text:
        return []
    spelt = (" " + text).encode()
    sides = [(a.encode(" " + text, add_special_tokens=False).ids, a_bytes), (b.encode(text), b_bytes)]
    if any(b"".join(of[i] for i in ids) != spelt for ids, of in sides):
        return []
    ends = [np.cumsum([len(of[i]) for i in ids]).tolist() for ids, of in sides]
    common = sorted(set(ends[0]) & set(ends[1]))
    return [
        tuple(
            [i for i, end in zip(ids, stops) if low < end <= high] for (ids, _), stops in zip(sides, ends)
        )
        for low, high in zip([0, *common], common)
    ]


def aligned_by_hand(rows, models):
    found = [groups_of(text, models) for _, text in rows]
    links = [[(x, y) for a, b in groups for x in a for y in b] for groups in found]
    counts = collections.Counter(pair for held in links for pair in set(held))
    most = collections.defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    for (doc_id, _), groups, held in zip(rows, found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (
            doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(held),
            hexed(text) if text else "", sum(counts[p] == most[p[0]] for p in held), sum(counts[p] for p in held),
        )


def aligned(docs):
    found = settled(alignment.digest(alignment.aligned(docs, BYTES, PIECES)), "aligned")
    return alignment.counted(found, alignment.width(PIECES)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"
    )


def test_op11_contract(any_docs, models):
    same(aligned(any_docs), list(aligned_by_hand(rows_of(any_docs), models)))


def test_op11_long_groups_and_many_blocks(strange, models, monkeypatch):
    for limit in (0, 7, 1 << 12):
        monkeypatch.setattr(alignment, "LINKS", limit)
        table = alignment.Stretches(BYTES, PIECES)
        texts = [*STRANGE, *RANDOM[:300]]
        for text, places in zip(texts, table.align(texts)):
            groups = groups_of(text, models)
            want = collections.Counter(x * 32000 + y for left, right in groups for x in left for y in right)
            _, _, pairs, times = table.document(places)
            assert dict(zip(pairs.tolist(), times.tolist())) == want
    rows = strange.sparkSession.createDataFrame(rows_of(strange) * 3, "doc_id long, text string").repartition(7)
    same(aligned(rows), list(aligned_by_hand(rows_of(rows), models)))


def test_op11_common_ends():
    for _ in range(2000):
        a, b = (sorted(random.sample(range(60), random.randrange(40))) for _ in range(2))
        want = [(a.index(x), b.index(x)) for x in sorted(set(a) & set(b))]
        assert alignment.common_ends(a, b) == want
    assert alignment.common_ends([5, 10**6], list(range(1, 10**6 + 1))) == [(0, 4), (1, 10**6 - 1)]


def test_op11_stretches_make_up_the_text():
    for text in STRANGE + RANDOM:
        for pattern in (alignment.STRETCH, alignment.SHORT_STRETCH):
            assert "".join(pattern.findall(" " + text)) == " " + text


@pytest.mark.parametrize("change", [("KNOWN", 50), ("CHARACTERS", 300), ("PART", 7)])
def test_op11_tables_that_start_anew(models, monkeypatch, change):
    monkeypatch.setattr(alignment, *change)
    table = alignment.Stretches(BYTES, PIECES)
    for at in range(0, 600, 20):
        texts = RANDOM[at : at + 20]
        for text, places in zip(texts, table.align(texts)):
            groups = groups_of(text, models)
            counts, shown, _, _ = table.document(places)
            assert counts[:3] == [sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups)]
            assert shown == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


# SentencePiece


def test_op12_contract(any_docs):
    model = SentencePieceProcessor(model_file=PIECES)
    want = []
    for doc_id, text in rows_of(any_docs):
        ids = model.encode(text or "")
        want.append((doc_id, len(ids), hexed(",".join(map(str, ids))), hexed(model.decode(ids))))
    same(sentencepieces.digest(sentencepieces.encoded(any_docs, PIECES)), want)


def test_op12_real_outputs(strange):
    model = SentencePieceProcessor(model_file=PIECES)
    for row, text in zip(sentencepieces.encoded(strange, PIECES).orderBy("doc_id").collect(), STRANGE + RANDOM):
        assert (row.ids, row.decoded) == (model.encode(text), model.decode(model.encode(text)))


@pytest.mark.parametrize("change", [("KNOWN", 30), ("CHARACTERS", 300)])
def test_op12_tables_that_start_anew(change, monkeypatch):
    monkeypatch.setattr(sentencepieces, *change)
    table = sentencepieces.ChunkTable(PIECES)
    assert table.in_chunks
    for at in range(0, 600, 20):
        texts = RANDOM[at : at + 20]
        for text, (ids, shown) in zip(texts, table.encode(texts)):
            assert ids.tolist() == table.model.encode(text) and shown == table.model.decode(ids.tolist())


def test_op12_each_chunk_is_segmented_once(monkeypatch):
    table = sentencepieces.ChunkTable(PIECES)
    given = []
    segment = table.segment
    monkeypatch.setattr(table, "segment", lambda chunks: given.extend(chunks) or segment(chunks))
    for _ in range(3):
        list(table.encode(["the cat and the dog\nthe cat", "the dog"]))
    assert sorted(given) == sorted(["▁the", "▁cat", "▁and", "▁dog", "\n", "the"])
    table.chunk = sentencepieces.CHUNK
    assert table.cut("the cat, (so)") == ["▁the", "▁cat,", "▁(so)"]
    table.chunk = sentencepieces.SHORT_CHUNK
    assert table.cut("the cat, (so) 3.5") == ["▁the", "▁cat", ",", "▁(", "so", ")", "▁3.5"]


def test_op12_whole_texts_where_chunks_are_not_allowed():
    table = sentencepieces.ChunkTable(PIECES)
    table.in_chunks = False
    for text, (ids, shown) in zip(RANDOM, table.encode(RANDOM)):
        assert ids.tolist() == table.model.encode(text) and shown == table.model.decode(ids.tolist())


# Spelling


def words_by_hand(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near_by_hand(words):
    """Words that become equal, at the same place, once a code point is left out of both or of one."""
    near = collections.defaultdict(set)
    left = collections.defaultdict(list)
    for w in words:
        left[w].append((w, None))
        for i in range(len(w)):
            left[w[:i] + w[i + 1 :]].append((w, i))
    for same_rest in left.values():
        for u, i in same_rest:
            for v, j in same_rest:
                if u != v and (i == j or i is None or j is None):
                    near[u].add(v)
    return near


def variants_by_hand(rows):
    words = words_by_hand(rows)
    near = near_by_hand(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        yield w, n, len(near[w]), form[w], form[w] and words[form[w]], root


def test_op13_contract(any_docs):
    same(spelling.variants(any_docs), list(variants_by_hand(rows_of(any_docs))))


def test_op13_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = list(variants_by_hand(rows_of(docs)))
    assert sum(form is not None for _, _, _, form, _, _ in want) > 100
    same(spelling.variants(docs), want)


@pytest.mark.parametrize("parts", [3, 5, 8, 11])
def test_op13_pairs(spark, parts):
    some = {"".join(random.choices("abé", k=random.randrange(6, 10))) for _ in range(500)}
    some |= {"abcdefghijklmnop", "abcdefghijklmno", "xbcdefghijklmnop", "abcdefgxijklmnop", "bcdefghijklmnop", "listen", "silent"}
    near = near_by_hand(some)
    words = spark.createDataFrame([(w,) for w in some], "word string")
    same(spelling.near_pairs(words, parts), [(u, v) for u in near for v in near[u] if (u < v and len(u) == len(v)) or len(u) < len(v)])


def test_op13_chains_of_forms(spark):
    texts = ["lettera " * 5, "letterab " * 30, "letterabc " * 160, "letterabcd " * 900, "letterabce " * 900]
    rows = list(enumerate(texts))
    found = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    same(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")), list(variants_by_hand(rows)))
    assert found["letterab"].form == "letterabc" and found["letterab"].root in ("letterabcd", "letterabce")
