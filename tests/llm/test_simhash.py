import random
from collections import defaultdict

import pytest
import xxhash
from ledgerloom.llm import simhash
from ledgerloom.llm.components import connected_components

from . import corpus


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_matches_brute_force(spark):
    got = simhash.near_duplicates(corpus.docs(spark)).collect()
    rows = corpus.rows()
    assert sorted(str(g["doc_id"]) for g in got) == sorted(str(r[0]) for r in rows)
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    roots = brute_components(sorted(set(fps.values())), 4)
    least = defaultdict(list)
    for d, f in fps.items():
        if d is not None:
            least[roots[f]].append(d)
    for g in got:
        assert g["fingerprint"] == f"{fps[g['doc_id']]:016x}"
        assert g["component_id"] == min(least[roots[fps[g["doc_id"]]]], default=None)


@pytest.mark.parametrize("wide", [2, 3, 256])
def test_large_buckets_lose_no_link(spark, wide):
    """Buckets beyond `wide` go by midpoints; components must be the same as by comparing all."""
    r = random.Random(wide)
    values = set()
    for _ in range(6):
        center = r.getrandbits(64)
        for _ in range(12):
            values.add(center ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
    signed = [(simhash._signed(v),) for v in values]
    fps = spark.createDataFrame(signed, "fp long")
    found = {n: t for n, t in connected_components(simhash.near_links(fps, 4, wide)).collect()}
    want = brute_components([v for v in values], 4)
    groups = lambda m: {frozenset(k for k in m if m[k] == t) for t in m.values()}
    assert groups({simhash._signed(v): found.get(simhash._signed(v), simhash._signed(v)) for v in values}) == groups({simhash._signed(v): simhash._signed(t) for v, t in want.items()})


def test_masks_cover_every_pair_within_the_radius():
    r, masks = random.Random(1), simhash.covering_masks(4)
    for _ in range(2000):
        diff = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
        assert any(not diff & m for m in masks)


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (None, 3), (7, 7)], "u long, v long")
    found = {n: t for n, t in connected_components(links).collect()}
    assert all(found[i] == 0 for i in range(201)) and found[501] == 500


def test_empty_table_and_keep_one(spark):
    assert simhash.near_duplicates(corpus.empty(spark)).count() == 0
    docs = corpus.docs(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {r["component"]["doc_id"] for r in simhash.near_texts(docs).collect()}
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


def test_keep_one_tells_rows_apart_by_id_and_text(spark, monkeypatch):
    """No text is lost because its id comes again, and which row stays doesn't depend on the partitions."""
    alpha, beta, gamma = ("alpha one two three four", "beta six seven eight nine ten", "gamma a b c d e f")
    rows = [(5, alpha, "x", 1), (5, beta, "x", 2), (9, gamma, "y", 3), (9, gamma, "y", 0), (3, beta, "z", 4), (7, None, "n", 5), (8, "", "n", 6), (None, gamma, "q", 7)]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string, id string, text_hash int").repartition(parts)
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        got = {tuple(r) for r in kept.collect()}
        assert {r[:2] for r in got} == {(5, alpha), (9, gamma), (3, beta), (7, None), (None, gamma)} and len(got) == 5
        if parts == 1:
            first = got
        assert got == first
        monkeypatch.setattr(simhash, "SLOTS", 64)
    unique = docs.where("id <> 'y'")
    assert {tuple(r) for r in simhash.keep_one(unique).collect()} == {r for r in first if r[0] != 9}
    assert simhash.keep_one(docs.where("false")).count() == 0


def similarity(a, b):
    sets = []
    for text in (a, b):
        w = (text or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


@pytest.mark.parametrize("members", [simhash.MEMBERS, 6])
def test_near_texts_against_brute_force(spark, monkeypatch, members):
    """What links of similarity 0.8 join, neither more nor less; also where clusters are dealt over tasks and the table of bits is full."""
    monkeypatch.setattr(simhash, "SLOTS", simhash.SLOTS if members > 6 else 64)
    r = random.Random(4)
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7))) for _ in range(900)]
    texts = []
    for _ in range(14):
        base = [r.choice(vocabulary) for _ in range(r.choice([40, 80, 200, 600]))]
        for share in (0, 0, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.05):
            texts.append(" ".join(r.choice(vocabulary) if r.random() < share else w for w in base))
    texts += ["", None, " \n", "one two", "one two", "One  Two", "x" * 3000] + [" ".join(texts[0].split()[5:]), texts[1] + "\nand a tail"]
    got = {x["doc_id"]: x["component"]["doc_id"] for x in simhash.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), members=members).collect()}
    links = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(texts[i], texts[j]) >= 0.8]
    root = list(range(len(texts)))
    for i, j in links:
        a, b = root[i], root[j]
        root = [min(a, b) if x in (a, b) else x for x in root]
    assert all(root[i] == root[c] for i, c in got.items()) and len(got) == len(texts)
    assert all(got[i] == got[j] for i, j in links) and len(links) > 100
    assert simhash.near_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_borderline_groups_lose_no_pair(spark):
    """Sixty groups of twelve texts whose pairs lie around the limit: a link that fails must not cost one that holds."""
    r = random.Random(11)
    texts = []
    for g in range(60):
        base = [f"w{g}x{r.randrange(10_000)}" for _ in range(300)]
        for _ in range(12):
            words = list(base)
            for at in r.sample(range(300), r.choice((3, 4))):
                words[at] = f"v{r.randrange(10**9)}"
            texts.append(" ".join(words))
    got = {x["doc_id"]: x["component"]["doc_id"] for x in simhash.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [set(simhash.shingle_set(t.encode().split()).tolist()) for t in texts]
    tried = held = 0
    for g in range(60):
        own = range(12 * g, 12 * g + 12)
        root = {i: i for i in own}
        for i in own:
            for j in own:
                if i < j:
                    tried += 1
                    if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                        held += 1
                        a, b = sorted((root[i], root[j]))
                        root = {k: a if v == b else v for k, v in root.items()}
        assert {i: got[i] for i in own} == root
    assert 0.1 * tried < held < 0.9 * tried


def test_many_near_copies_are_one_component(spark):
    """Ten thousand near copies of one text, in tasks of a few hundred; and a few texts that are alike to each other, and too far from all the rest."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:-1], f"n{i}"]) for i in range(10_000)]
    far = [*base[:30], *(f"far{i}" for i in range(20))]
    texts += [" ".join([*far, f"f{i}"]) for i in range(5)]
    r.shuffle(texts)
    got = simhash.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), members=300).collect()
    groups = {}
    for x in got:
        groups.setdefault(x["component"]["doc_id"], []).append(x["doc_id"])
    assert sorted(map(len, groups.values())) == [5, 10_000]


def test_sketches_tell_similarity():
    r = random.Random(2)
    words = [str(r.random()).encode() for _ in range(3000)]
    for kept in (3000, 2700, 1500):
        a, b = simhash.shingle_set(words), simhash.shingle_set(words[:kept] + [str(r.random()).encode() for _ in range(3000 - kept)])
        exact = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        told = sum(x == y for x, y in zip(simhash.sketch(a), simhash.sketch(b))) / simhash.SKETCH
        assert abs(exact - told) < 0.15
