"""Exact duplicates against plain grouping; chunks against their definition."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import recipes

from . import corpus


def check(got, rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    assert len(got) == len(rows)
    by_text = defaultdict(list)
    for g in got:
        by_text[g["text_sha256"]].append(g)
    assert len(by_text) == len(groups)
    import hashlib

    for text, ids in groups.items():
        own = by_text[hashlib.sha256(text.encode()).hexdigest()]
        best = max((i for i in ids if i is not None), default=None)
        assert sorted(map(str, ids)) == sorted(str(g["doc_id"]) for g in own)
        assert {(g["keep_id"], g["group_size"]) for g in own} == {(best, len(ids))}
        assert [g["doc_id"] for g in own if g["kept"]] == [best]


def test_matches_plain_grouping(spark):
    check(recipes.exact_duplicates(corpus.docs(spark)).collect(), [(r[0], r[1]) for r in corpus.rows()])
    assert recipes.exact_duplicates(corpus.empty(spark)).count() == 0


def test_clashing_identifiers_are_found_and_widened(spark):
    """Identifiers of one byte clash for certain; nothing is joined by a clash."""
    check(recipes.exact_duplicates(corpus.docs(spark), width=1).collect(), [(r[0], r[1]) for r in corpus.rows()])


def test_long_copies_and_one_changed_byte(spark):
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh \n") for _ in range(300_000))
    changed = long[:150_000] + "X" + long[150_001:]
    rows = [(1, long), (2, changed), (3, long), (4, long + " "), (None, long), (None, "x"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(recipes.exact_duplicates(docs).collect(), rows)
    # a changed byte costs a chunk or two, not the text
    texts = docs.where("doc_id in (1, 2)").select(F.col("text").cast("binary").alias("text"))
    one, both = (recipes.chunks(x).count() for x in (texts.limit(1), texts))
    assert one > 50 and both <= one + 3


def test_a_normal_form_is_compared(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in recipes.exact_duplicates(docs, normal=F.lower("text")).collect()}
    assert got == {1: (2, False), 2: (2, True), 3: (3, True)}


def test_chunks_cover_the_text_and_depend_on_it_alone():
    r = np.random.default_rng(2)
    texts = [r.integers(0, 256, n, np.uint8) for n in (0, 5, 1024, 1025, 90_000, 3_000_000, 40)]
    texts.append(np.zeros(100_000, np.uint8))
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    edges, counts = recipes.cuts(starts, np.concatenate(texts))
    sizes, at = np.diff(edges), 0
    for i, t in enumerate(texts):
        own = sizes[at : at + counts[i]]
        at += counts[i]
        assert own.sum() == len(t) and (own <= recipes.MOST).all() and (own[:-1] >= recipes.LEAST).all()
        alone, n = recipes.cuts(np.array([0, len(t)]), t)
        assert n[0] == counts[i] and np.diff(alone).tolist() == own.tolist()
    assert recipes.marks(texts[5]).tolist() == sorted({int(x) for x in recipes.marks(texts[5])})
