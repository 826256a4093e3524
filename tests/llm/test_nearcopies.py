"""The pipeline's near-dedup stage: recall on planted edits, clean documents left alone, defined results."""

from __future__ import annotations

import random

import numpy as np
from corpus_rows import awkward, documents, empty  # noqa: F401
from pyspark.sql import functions as F

from tremora.llm import nearcopies

random.seed(23)
WORDS = ["".join(random.choices("abcdefghijklmnop", k=random.randrange(2, 9))) for _ in range(4000)]


def similarity(one, other):
    a, b = (set(nearcopies.shingles(text).tolist()) for text in (one, other))
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, n):
    words = text.split()
    for _ in range(n):
        at = random.randrange(len(words))
        kind = random.randrange(3)
        words[at : at + (kind > 0)] = [] if kind == 2 else [random.choice(WORDS)]
    return " ".join(words)


def test_recall_on_planted_edits(spark):
    bands = {(0.8, 0.9): [], (0.9, 0.95): [], (0.95, 1.0): []}
    below = []
    while min(map(len, bands.values())) < 170 or len(below) < 170:
        n = random.choice([30, 60, 120, 250, 600, 1500])
        text = " ".join(random.choices(WORDS, k=n))
        other = edited(text, max(1, int(n * random.choice([0.002, 0.005, 0.01, 0.015, 0.02, 0.1, 0.14]))))
        found = similarity(text, other)
        for (low, high), pairs in bands.items():
            if low <= found < high and len(pairs) < 170:
                pairs.append((text, other))
        if found < 0.5 and len(below) < 170:
            below.append((text, other))
    listed = [(band, *pair) for band, pairs in [*bands.items(), (None, below)] for pair in pairs]
    rows = [(2 * k + side, pair[side + 1]) for k, pair in enumerate(listed) for side in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in nearcopies.one_of_each(docs).collect()}
    assert all(2 * k in kept for k in range(len(listed)))  # the smallest id of a pair always stays
    for band in bands:
        caught = [2 * k + 1 not in kept for k, (of, _, _) in enumerate(listed) if of == band]
        print(band, np.mean(caught))
        assert np.mean(caught) >= 0.9, (band, np.mean(caught))
    assert all(2 * k + 1 in kept for k, (of, _, _) in enumerate(listed) if of is None)


def test_copies_and_large_groups(spark):
    base = " ".join(random.choices(WORDS, k=300))
    family = [edited(base, 1) for _ in range(400)]
    others = [" ".join(random.choices(WORDS, k=random.randrange(5, 400))) for _ in range(200)]
    passage = " ".join(random.choices(WORDS, k=60))
    sharing = [f"{text} {passage}" for text in others if len(text.split()) > 200]
    texts = [base, *family, *[base] * 300, *others]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10_000 + i, t) for i, t in enumerate(sharing)]
    kept = {r.doc_id for r in nearcopies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = 1 + 400 + 300
    want = {0} | set(range(first, first + 200))
    assert want <= kept
    for i, text in enumerate(sharing):  # a shared passage alone doesn't make a copy
        like = max(similarity(text, other) for other in others)
        assert (10_000 + i in kept) or like > 0.6
    assert len([i for i in kept if 0 < i < first]) == 0


def test_one_run_however_it_is_cut(spark):
    import pandas as pd

    texts = [" ".join(random.choices(WORDS, k=50)) for _ in range(30)]
    texts += [edited(t, 1) for t in texts]
    prints = [(nearcopies.fingerprint(h), len(h)) for h in map(nearcopies.shingles, texts)]
    rows = pd.DataFrame({
        "kind": [0] * 40 + [1] * 20, "part": [5] * 40 + [5] * 20, "__node": range(60),
        "__fp": [fp.tobytes() for fp, _ in prints], "__n": [n for _, n in prints],
    })
    whole = pd.concat(nearcopies._links([rows]))
    for size in (1, 7, 20, 59):
        cut = pd.concat(nearcopies._links(rows.iloc[at : at + size] for at in range(0, 60, size)))
        assert cut.values.tolist() == whole.values.tolist()


def test_defined_results(spark, documents, awkward, empty):
    assert nearcopies.one_of_each(empty).count() == 0
    kept = nearcopies.one_of_each(awkward)
    assert kept.dtypes == awkward.dtypes
    found = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert found == [(False, 1), (False, 4), (False, 4), (False, 5), (False, 6), (False, 7), (False, 8), (True, 0)]
    again = nearcopies.one_of_each(documents.union(documents))
    once = nearcopies.one_of_each(documents)
    assert {r.doc_id for r in again.collect()} == {r.doc_id for r in once.collect()}
    assert again.count() == once.count() <= documents.select(F.col("text")).distinct().count()
