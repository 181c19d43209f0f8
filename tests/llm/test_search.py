"""Block-max search against a scorer that looks at every document, and block boundaries against all boundaries."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import search

from . import corpus

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=10):
    import math

    own = [(i, brute_terms(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    every, n_docs, out = sum(len(t) for _, t in own), len(own), []
    for item, text in sorted({(i, t or "") for i, t in items}):
        asked, scored = brute_terms(text), []
        df = {t: sum(t in d for _, d in own) for t in set(asked)}
        for i, d in own:
            m = 25 + 75 * len(d) * n_docs // every
            total = 0
            for t in asked:
                if t in d:
                    tf = d.count(t)
                    total += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if total:
                scored.append((-total, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_docs", [3, 4096])
def test_matches_brute_force(spark, shard_docs):
    items = [(1, "The thing, and the REEN of ther"), (2, None), (3, "É à 中文 word"), (4, "nothinglikeit"), (5, "a row without an id"), (5, "a row without an id"), (6, "the " * 30 + "x")]
    index, documents = search.build(corpus.docs(spark), shard_docs=shard_docs)
    got = search.search(index, documents, spark.createDataFrame(items, "item_id long, text string"))
    want = brute_search([(r[0], r[1]) for r in corpus.rows()], items)
    assert sorted([tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()], key=str) == want


def test_items_go_in_blocks_with_the_same_rows(spark, monkeypatch):
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["the thing", "ing of", "word", "he on was", None])], "item_id long, text string")
    index, documents = search.build(corpus.docs(spark))
    whole = sorted(search.search(index, documents, items).collect())
    monkeypatch.setattr(search, "ITEMS", 2)
    assert sorted(search.search(index, documents, items).collect()) == whole


def test_no_documents_and_no_items(spark):
    index, documents = search.build(corpus.empty(spark))
    items = spark.createDataFrame([(1, "the thing")], "item_id long, text string")
    assert documents == 0 and search.search(index, documents, items).count() == 0
    index, documents = search.build(corpus.docs(spark))
    assert search.search(index, documents, items.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 40), min_size=1, max_size=9), min_size=1, max_size=4), st.integers(1, 60), st.integers(1, 5))
def test_block_boundaries_are_the_cheapest(lists, cost, longest):
    def paid(x, ends):
        begins = [0, *ends[:-1]]
        return sum(max(x[a:b]) * (b - a) + cost for a, b in zip(begins, ends, strict=True)) if all(b - a <= longest for a, b in zip(begins, ends, strict=True)) else None

    lengths = np.array([len(x) for x in lists])
    last, at = search.block_ends(np.array(sum(lists, []), np.int64), lengths, longest, cost), 0
    for x in lists:
        own = (np.flatnonzero(last[at : at + len(x)]) + 1).tolist()
        at += len(x)
        costs = [paid(x, [*c, len(x)]) for n in range(len(x)) for c in combinations(range(1, len(x)), n)]
        assert paid(x, own) == min(c for c in costs if c is not None)


def test_blocks_are_skipped_without_loss():
    """A rare term in few documents and a common one in all: most documents are never scored."""
    r = random.Random(3)
    texts = [["the"] * r.randint(1, 3) + ["fill"] * r.randint(5, 60) + (["rare"] if i % 97 == 0 else []) for i in range(2000)]
    every = sum(map(len, texts))
    from collections import Counter

    counted = [Counter(w.encode() for w in t) for t in texts]
    batches = list(search._shard(0, list(range(2000)), counted, [len(t) for t in texts], 2000, every))
    rows = {x["term"]: (x["docs"], x["tf"], x["ends"], x["tops"]) for b in batches[1:] for x in b.to_pylist()}
    head = batches[0].to_pylist()[0]
    shard = search.Shard(rows, head["ids"], np.frombuffer(head["docs"], np.int64))
    query = [("the", 40), ("rare", 4000)]
    docs, scores = shard.search(query, 10)
    brute = shard._score([(w, shard.lists[t]) for t, w in query], np.arange(2000))
    best = np.lexsort((np.arange(2000), -brute))[:10]
    assert docs.tolist() == best.tolist() and scores.tolist() == brute[best].tolist()
    assert shard.scored - 2000 < 600
