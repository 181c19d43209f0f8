"""The audit against a run of every order over every document."""

from collections import Counter
from itertools import permutations

from ledgerloom.llm import audit

from . import corpus


def brute(rows, labels):
    first, out = {}, Counter()
    for doc, text, lang in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    shapley = Counter()
    for doc, text, lang in rows:
        t, part = text or "", lang or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t) else set()
        fails |= {"D"} if any(c in t for c in "#$%&*|") else set()
        fails |= {"E"} if doc is not None and doc > first[t] else set()
        good, toxic = labels.get(doc, (0, 0))
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, x in enumerate(order, 1):
                key = (part, order, step)
                hit = x in fails and not gone
                gone = gone or x in fails
                for name, value in (("kept", not gone), ("removed", hit), ("redundant", x in fails and not hit), ("unique_fails", fails == {x}), ("good_lost", hit and good == 1), ("toxic_lost", hit and toxic == 1)):
                    out[(*key, name)] += value
                shapley[(part, x)] += hit
    for part, order, step in {k[:3] for k in out}:
        out[(part, order, step, "shapley")] = shapley[(part, order[step - 1])]
    return out


def test_matches_every_order_over_every_document(spark):
    rows = [(r[0], r[1], r[2]) for r in corpus.rows()] + [(900, "one two " * 150, "fr"), (901, " ".join(f"w{i}" for i in range(300)), "fr"), (901, " ".join(f"w{i}" for i in range(300)), "fr")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 3)] + [(3, None, 1), (None, 1, 1), (901, 1, 0), (901, 1, 0)]
    docs = spark.createDataFrame([(d, t, p, True, "x") for d, t, p in rows], "doc_id long, text string, lang string, A boolean, part string").repartition(3)
    got = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    folded = {}
    for i, q, t in labels:
        a, b = folded.get(i, (0, 0))
        folded[i] = (max(a, q or 0), max(b, t or 0))
    folded.pop(None)
    want = brute(rows, folded)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert len(got) == len({r[2] or "" for r in rows}) * 600
    assert {(g["part"], g["filter_order"], g["step"], n): g[n] for g in got for n in names} == dict(want)


def test_empty_tables(spark):
    docs = corpus.docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(corpus.empty(spark), none).count() == 0
    assert audit.audit(docs, none).where("good_lost + toxic_lost > 0").count() == 0
