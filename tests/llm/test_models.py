"""Language models, classifiers, rules and URL filters: held-out accuracy, brute force, awkward rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bloomlm, crf, langid, oracles, quality, queries, rules, urltree

from . import corpus

DATA = "/root/testdata/sf0.001"


def test_bloom_lm_base_is_exact(spark, monkeypatch):
    monkeypatch.setattr(bloomlm, "HEAD", 20)  # so that most words go by the join
    docs = corpus.docs(spark)
    train = [r for r in corpus.rows() if zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 7 != 2]
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    counts = Counter(w for r in train for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    model, words = bloomlm.train(docs.where(~langid.held_out(mod=7, rest=2)))
    assert (model.tokens, model.words, model.texts) == (n, v, len(train))
    got = bloomlm.score(docs, model, words).collect()
    assert len(got) == len(corpus.rows())
    by_id = {r[0]: r[1] for r in corpus.rows()}
    for g in got:
        own = tokens(by_id[g["doc_id"]])
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert (g["n_tokens"], g["n_known"]) == (len(own), sum(counts[w] > 0 for w in own)) and math.isclose(g["base_score"], base, rel_tol=1e-9)
        assert -400 * len(own) < g["score"] <= 0
    copy = sum(g["score"] - g["base_score"] for g in got)
    assert copy > 0  # pairs that come again make the texts likelier


def test_bloom_lm_score_is_the_mixture(spark, monkeypatch):
    """The score against counts held exactly and quantised alike; pairs seen once count. A wide filter leaves almost no false hits."""
    monkeypatch.setattr(bloomlm, "BITS", 64)
    docs = corpus.docs(spark)
    model, words = bloomlm.train(docs)
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    single = Counter(w for r in corpus.rows() for w in tokens(r[1]))
    pairs = Counter(p for r in corpus.rows() for p in zip([None, *tokens(r[1])], tokens(r[1])))
    value = lambda c: float(bloomlm.VALUES[bloomlm.level(np.array([c]))[0]])
    assert value(0) == 0 and value(1) == 1 and value(2) == 2 and min(pairs.values()) == 1

    def brute(text):
        total, before = 0.0, None
        for w in tokens(text):
            past = value(single[before]) if before is not None else float(model.texts)
            weight = model.weights[int(np.log2(past + 1))]
            total += math.log10(weight * min(value(pairs[before, w]), past) / max(past, 1) + (1 - weight) * (value(single[w]) + 1) / (model.tokens + model.words + 1))
            before = w
        return total

    text = {r[0]: r[1] for r in corpus.rows()}
    got = bloomlm.score(docs, model, words).collect()
    assert np.mean([math.isclose(g["score"], brute(text[g["doc_id"]]), rel_tol=1e-6) for g in got]) > 0.95
    assert all(math.isclose(g["score"], brute(text[g["doc_id"]]), rel_tol=1e-2) for g in got)


def test_bloom_lm_spread_filter_keeps_every_level(spark, monkeypatch):
    """A filter beyond the bound scores as one within it."""
    monkeypatch.setattr(bloomlm, "ASKED", 2000)
    docs = corpus.docs(spark)
    whole, words = bloomlm.train(docs)
    spread, _ = bloomlm.train(docs, most_bits=1 << 10)
    assert whole.segments is None and spread.segments is not None and not len(spread.grams.marks)
    assert np.array_equal(whole.weights, spread.weights)
    key = lambda r: (str(r["doc_id"]), r["score"])
    want, got = (sorted(bloomlm.score(docs, m, words).collect(), key=key) for m in (whole, spread))
    assert len(got) == len(corpus.rows()) and all(a[:3] == b[:3] and np.allclose(a[3:], b[3:], rtol=1e-9) for a, b in zip(want, got, strict=True))


def test_bloom_filter_gives_counts_back():
    bits, size = 3, 1 << 16
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, 500, np.int64).astype(np.uint64)
    counts = r.integers(1, 5000, 500)
    keys = np.sort(bloomlm._key(h, bits))
    order = np.argsort(bloomlm._key(h, bits), kind="stable")
    marks = np.zeros((1 << bits, size // 64), np.uint64)
    import pyarrow as pa

    blobs = bloomlm._blobs(keys, counts[order])
    for row in pa.Table.from_batches([blobs]).to_pylist():
        table = bloomlm._reduced(pa.Table.from_pylist([row, row], schema=bloomlm.BLOBS))  # counts of two tasks add up
        seg = next(bloomlm._segments(size)(iter([table.select(["bucket", "low", "high", "level"]).to_batches()[0]])))
        marks[row["bucket"]] = np.frombuffer(seg.column(1)[0].as_py(), "<u8")
    f = bloomlm.Filter(bits, size, 40, marks.ravel())
    got = f.value(h)
    assert np.mean(got == bloomlm.VALUES[bloomlm.level(2 * counts)]) > 0.97
    assert np.mean(f.value(r.integers(0, 1 << 63, 5000, np.int64).astype(np.uint64)) == 0) > 0.97


def test_bloom_lm_on_nothing(spark):
    model, words = bloomlm.train(corpus.empty(spark))
    assert bloomlm.score(corpus.empty(spark), model, words).count() == 0
    assert bloomlm.score(corpus.docs(spark), model, words).count() == len(corpus.rows())


def test_language_id_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.op9_language_id(spark, DATA).where("held_out").join(docs, "doc_id").where("lang is not null")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95


def test_language_id_awkward_rows(spark):
    docs = corpus.docs(spark)
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.classify(docs, model).collect()}
    for doc_id, text, *_ in corpus.rows():
        r = got[doc_id]
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    assert langid.classify(corpus.empty(spark), model).count() == 0
    none = langid.train(docs.where("false"))
    assert {r["lang_pred"] for r in langid.classify(docs, none).collect()} == {"und"}
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 0


def test_unknown_words_fall_back_to_shorter_grams():
    model = langid.Model(["de", "en"], {"de": {"schule": 3, "über": 2}, "en": {"thing": 3, "over": 2}})
    assert model.backoff("schuld").argmax() == 0 and model.backoff("things").argmax() == 1 and not model.backoff("§").any()


def test_crf_against_enumeration():
    r = np.random.default_rng(3)
    from itertools import product

    rows = [r.normal(size=(t, 3)) for t in (1, 4, 2)]
    trans = r.normal(size=(3, 3))
    scores, lengths = crf.padded(rows)
    marginals, pairs = crf.forward_backward(scores, trans, lengths)
    best = crf.viterbi(scores, trans, lengths)
    want_pairs = np.zeros((3, 3))
    for i, x in enumerate(rows):
        value = {y: sum(x[t, k] for t, k in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:])) for y in product(range(3), repeat=len(x))}
        z = sum(math.exp(v) for v in value.values())
        for t in range(len(x)):
            for k in range(3):
                assert math.isclose(marginals[i, t, k], sum(math.exp(v) for y, v in value.items() if y[t] == k) / z, rel_tol=1e-9)
        for y, v in value.items():
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += math.exp(v) / z
        assert tuple(best[i, : len(x)]) == max(value, key=value.get)
    assert np.allclose(pairs, want_pairs)


def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.op7_quality_classifier(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    good, bad = [r["score"] for r in got if r["quality"] == 1], [r["score"] for r in got if r["quality"] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc >= 0.9 and np.mean([r["predicted"] for r in got if r["quality"] == 1]) >= 0.95


def test_quality_awkward_rows(spark):
    docs = corpus.docs(spark)
    labels = spark.createDataFrame([(i, i % 3 and 1, 0, "x") for i in range(60)] + [(None, 1, 0, "x"), (5, None, 0, "y"), (10**9, 1, 0, "z")], "doc_id long, quality int, toxic int, text string").select("doc_id", "quality", "toxic")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(corpus.rows()) and all(0 <= r["score"] <= 1 for r in got)
    by_text = defaultdict(set)
    text = {r[0]: r[1] for r in corpus.rows()}
    for r in got:
        by_text[text[r["doc_id"]] or ""].add(round(r["score"], 9))
    assert all(len(s) == 1 for s in by_text.values())
    assert quality.score(corpus.empty(spark), quality.train(docs, labels.where("false"))).count() == 0


def brute_quality(text, model):
    """The score from the line features, the forward and backward sums and the weighted mean, one step at a time."""
    lines, own, seen = text.encode().split(b"\n"), [], set()
    classes = (b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b".,;:?", b"!", b"\"'()[]{}/\\=+-_~^`@")
    for line in lines:
        words = line.split()
        shares = [sum(c in k for c in line) / max(1, len(line)) for k in classes]
        spoken = [math.log1p(len(words)), len(set(words)) / len(words), len(line) / len(words) / 10] if words else [0, 0, 0]
        own.append([*shares, *spoken, float(not line), math.log1p(len(line)) / 5, float(bool(line) and line in seen), 1.0])
        seen.add(line)
    none = [0.0] * len(own[0])
    full = [x + (own[i - 1] if i else none) + (own[i + 1] if i + 1 < len(own) else none) for i, x in enumerate(own)]
    e = [[math.exp(sum(a * b for a, b in zip(x, model.weights[:, k]))) for k in (0, 1)] for x in full]
    t = np.exp(model.trans)
    front, back = [e[0]], [[1.0, 1.0]]
    for x in e[1:]:
        step = [x[k] * sum(front[-1][j] * t[j, k] for j in (0, 1)) for k in (0, 1)]
        front.append([v / sum(step) for v in step])
    for x in e[:0:-1]:
        step = [sum(t[k, j] * x[j] * back[0][j] for j in (0, 1)) for k in (0, 1)]
        back.insert(0, [v / sum(step) for v in step])
    bad = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(front, back)]
    weight = [len(line) + 1 for line in lines]
    mean, most = sum(b * w for b, w in zip(bad, weight)) / sum(weight), sum(w for b, w in zip(bad, weight) if b > 0.5) / sum(weight)
    return 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * mean + model.curve[2] * most)))


def test_quality_score_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = [(i, t) for i, (t,) in enumerate(docs.select("text").limit(40).collect())] + [(100 + i, t) for i, t in enumerate((None, "", "\n\n", "a\na\n\nB 1!", "### $$$\n" * 300))]
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert len(got) == len(rows) and all(math.isclose(got[i], brute_quality(t or "", model), rel_tol=1e-3, abs_tol=1e-6) for i, t in rows)


def test_quality_sample_is_bounded(spark, monkeypatch):
    """One labelled id with very many rows, or very long ones, brings no more rows and lines than the bounds."""
    docs = spark.range(4000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 2000).cast("string")).alias("text"), F.lit("q").alias("__quality"), F.lit("g").alias("good"), F.lit(1).alias("id"))
    docs = docs.unionByName(spark.createDataFrame([(8, "line\n" * 5000, "q", "g", 1), (9, "fine", "q", "g", 1), (None, "x", "q", "g", 1)], "doc_id int, text string, __quality string, good string, id int"))
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 0)], "doc_id long, quality int")
    got = []
    monkeypatch.setattr(quality, "fit_model", lambda features, weights, good: got.append((features, good)))
    quality.train(docs, labels, at_most=50, lines=60)
    (features, good), = got
    assert len(features) <= 50 and sum(map(len, features)) <= 60 and len(good) == len(features)
    quality.train(docs, labels, at_most=3000, lines=200_000)
    assert len(got[1][0]) == 2002 and sum(got[1][1]) == 2000


def brute_language(text, counts):
    """The language by the definition: log frequencies of known words, else the mean of the longest known n-grams."""
    langs = sorted(counts)
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    grams = lambda w, n: [f"_{w}_"[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w)
    tables = [counts] + [{k: Counter() for k in langs} for _ in range(5)]
    for k in langs:
        for w, c in counts[k].items():
            for n in range(1, 6):
                for g in grams(w, n):
                    tables[n][k][g] += c
    every = [set().union(*(t[k] for k in langs)) for t in tables]
    sums = [{k: sum(t[k].values()) for k in langs} for t in tables]
    log = lambda n, x, k: math.log((tables[n][k][x] + 0.5) / (sums[n][k] + 0.5 * len(every[n])))
    total = dict.fromkeys(langs, 0.0)
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if w in every[0]:
            for k in langs:
                total[k] += log(0, w, k)
            continue
        for n in range(5, 0, -1):
            if found := [g for g in grams(w, n) if g in every[n]]:
                for k in langs:
                    total[k] += sum(log(n, g, k) for g in found) / len(found)
                break
    best = max(langs, key=lambda k: (total[k], [-ord(c) for c in k]))
    return best, 1 / sum(math.exp(max(-700, total[k] - total[best])) for k in langs)


def test_language_id_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    train = docs.where("doc_id % 2 = 0")
    model = langid.train(train)
    counts = defaultdict(Counter)
    for r in train.where("lang is not null and text is not null").collect():
        counts[r["lang"]].update(re.findall(r"[^\W\d_]+", r["text"].lower()))
    sampled = len(model.index[0]) + len(model.langs)  # small tables are below the bounds but for the dealing into parts
    rows = [(i, r["text"]) for i, r in enumerate(docs.where("doc_id % 2 = 1").limit(25).collect())] + [(100, "zzzyq xkcd"), (101, "a"), (102, None), (103, "12 !"), (104, "ß" * 70)]
    got = {r["doc_id"]: r for r in langid.classify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    own = {k: Counter({w: n for w, n in c.items()}) for k, c in counts.items()}
    assert sampled and set(model.langs) == set(own) and {w for c in own.values() for w in c} == set(model.index[0])
    for i, t in rows:
        lang, score = brute_language(t, own)
        assert got[i]["lang_pred"] == lang and math.isclose(got[i]["score"], score, rel_tol=1e-3, abs_tol=1e-6)


def test_language_sample_is_bounded(spark):
    rows = [(1, f"word{i} same", "en") for i in range(500)] + [(2, "x" * 5000, "en"), (3, "wort", "de"), (None, "mot", "fr"), (4, None, "es"), (5, "palabra", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, per_lang=64, chars=32 * 1000)
    assert model.langs == ["de", "en", "fr"] and sum(w.startswith("word") for w in model.index[0]) <= 2 and "x" * 5000 not in model.index[0]
    assert langid.train(docs, rows=1).langs == ["en"] and langid.train(docs.where("false")).langs == []


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    seen, dup, places, covered = set(), 0, defaultdict(list), set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    for own in places.values():
        if len(own) > 1:
            covered.update(j for i in own for j in range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_rules_against_brute_force(spark):
    docs = corpus.docs(spark)
    got = rules.judge(docs, limit=5).collect()
    rows = corpus.rows()
    assert len(got) == len(rows)
    lines = lambda t: {n: len(n.split(" ")) for x in t.split("\n") if (n := re.sub(r"[ \t\n\x0b\f\r]+", " ", x.lower()).strip(" "))}
    seen = defaultdict(set)
    for r in rows:
        for line in lines(r[1] or ""):
            seen[r[3] or "", line].add((r[0], r[1] or ""))
    text = {r[0]: (r[1] or "", r[3] or "") for r in rows}
    removed = 0
    for g in got:
        t, host = text[g["doc_id"]]
        counts = brute_counts(t)
        assert tuple(g[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        own = lines(t)
        total, lost = sum(own.values()), sum(n for line, n in own.items() if len(seen[host, line]) > 5)
        assert g["base_failed"] == failed and g["kept"] == (not failed and not (total - lost < 20 and 2 * lost > total))
        removed += not failed and not g["kept"]
    assert rules.judge(corpus.empty(spark)).count() == 0


def test_rules_reject_depleted_documents(spark):
    line = "this very line of many words stands in all of the documents of one host and so it goes away with no doubt"
    rows = [(i, f"{line}\nown {i} words", "h", 1) for i in range(30)] + [(100 + i, f"{line}\n" + " ".join(f"w{i}x{j}" for j in range(40)), "h", 1) for i in range(3)] + [(200, line + " but longer", "h", 1), (300, "clean " * 3 + " ".join(f"c{j}" for j in range(30)), "h", 1)]
    rows += [(400 + i, " ".join(f"copy{j}" for j in range(30)), "h", 1) for i in range(50)]  # copies are documents: their line is frequent, but not where exact copies count as one
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    kept = {r["doc_id"] for r in rules.judge(docs).where("kept").collect()}
    assert kept == {100, 101, 102, 200, 300}
    clean = {r["doc_id"]: r for r in rules.clean(docs).collect()}
    assert set(clean) == kept | set(range(400, 450)) and all(line + "\n" not in r["text"] for r in clean.values()) and all(r["n_chars"] == len(r["text"]) for r in clean.values())


def test_clean_keeps_near_copies_whole(spark):
    """Near copies don't make their own lines frequent, and a line of 21 different documents is frequent in a host of any size."""
    r = random.Random(8)
    own = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    base = [own(12) for _ in range(40)]
    rows = [(i, "\n".join([*base, f"copy number {i}"]), "h") for i in range(30)]
    rows += [(100 + i, own(30) + "\nread more here", "g") for i in range(21)] + [(1000 + i, own(20), "g") for i in range(21_000)]
    got = {x["doc_id"]: x["text"] for x in rules.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id < 1000").collect()}
    assert len(got) == 51 and all(got[i] == rows[i][1] for i in range(30))
    assert all("read more" not in got[100 + i] for i in range(21))


def test_rules_with_clashing_columns_and_either_way_of_cutting(spark):
    """Columns of any name come back as they were, and frequent lines go alike whether looked for in place or joined."""
    line = "one line that many of the documents of this host have among others and that goes away"
    rows = [(i, f"{line}\n\n  " + " ".join(f"w{i}x{j}" for j in range(40)) + f"\n{line.upper()}", "h", "orig", "g", "d", "t", "n", "l", "e") for i in range(30)]
    rows += [(100 + i, f"{line}\nshort {i}", "h", "orig", "g", "d", "t", "n", "l", "e") for i in range(5)] + [(200, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __doc string, __gone string, __drop string, doc string, new string, line string, row string")
    assert {r["doc_id"] for r in rules.judge(docs).where("kept").collect()} == set(range(30))
    ways = [sorted(map(tuple, rules.clean(docs, in_place=n).collect())) for n in (5000, 0)]
    assert ways[0] == ways[1] == [(i, "\n  " + " ".join(f"w{i}x{j}" for j in range(40)), *rows[i][2:]) for i in range(30)]
    assert rules.clean(docs).columns == docs.columns and rules.clean(docs.where("false")).count() == 0


def test_training_reads_whole_texts(spark):
    """Bad lines and words of a language count however late in a text they come."""
    r = random.Random(3)
    fine = lambda: " ".join(r.choice("alpha river stone market winter garden letter people little water answer".split()) for _ in range(9)).capitalize() + "."
    texts = ["\n".join([fine() for _ in range(250)] + ["$$$ ### BUY !!! $$$" if i % 2 else fine() for _ in range(250)]) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.train(docs, labels)
    whole = quality.fit_model(*quality.line_features(texts), np.arange(40) % 2 == 0)
    assert np.allclose(model.weights, whole.weights) and np.allclose(model.curve, whole.curve)
    early = quality.train(docs.withColumn("text", F.substring_index("text", "\n", 200)), labels)
    assert not np.allclose(model.weights, early.weights)
    late = docs.select("doc_id", F.concat("text", F.lit(" filler" * 4000 + " zebra")).alias("text"), "lang")
    known = langid.train(late)
    assert "zebra" in known.index[0]


def sql(text, spark, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    return con.execute(text).fetchall()


def test_rules_sql_on_awkward_rows(spark):
    docs = corpus.docs(spark).select("doc_id", "text", "source")
    got = [tuple(r) for r in rules.judge(docs).collect()]
    key = lambda r: tuple(str(x) for x in r)
    want = [(None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:]) for r in sql(oracles.OP8, spark, documents=docs)]
    assert sorted(got, key=key) == sorted(want, key=key)


URLS = [
    ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"), ("https://a.net/x", "a.net", "/x", "net/", "block"), ("http://net", "net", "", None, None), ("http://x.org/fr/a/b", "x.org", "/fr/a/b", "org/fr/", "allow"),
    ("ftp://borg/fr/", "borg", "/fr/", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("http://h?a/b", "h", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("http://x.example.com/de/", "x.example.com", "/de/", "example.com/de/", "block"), ("", "", "", None, None),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], 1, "t") for i, u in enumerate(URLS)] + [(None, "http://q.net/", 1, "t"), (0, URLS[0][0], 1, "t")], "page_id long, url string, host int, template string")
    got = urltree.judge(pages).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r["page_id"] is not None:
            _, host, path, rule, verdict = URLS[r["page_id"]]
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or "allow")
    assert urltree.judge(pages.where("false")).count() == 0


def test_url_templates_generalise(spark):
    """A host's bad branch is rejected beyond its labelled URLs, its good one isn't, numbers and rare names become wildcards."""
    rows = [(i, f"http://h.io/bad/{i}") for i in range(40)] + [(100 + i, f"http://h.io/good/{i}") for i in range(40)] + [(200 + i, f"http://h.io/user/name{'abcdefghijklmnopqrstuvwxyz'[i % 26]}x{'q' * i}/post") for i in range(60)]
    rules_ = tuple((f"h.io/bad/{i}", "block") for i in range(1, 4)) + tuple((f"h.io/good/{i}", "allow") for i in range(1, 4))
    got = {r["page_id"]: r for r in urltree.judge(spark.createDataFrame(rows, "page_id long, url string"), rules_).collect()}
    assert got[0]["template"] == "/bad/*" and all(got[i]["verdict"] == "block" for i in range(40))
    assert all(got[100 + i]["verdict"] == "allow" for i in range(40))
    assert {got[200 + i]["template"] for i in range(60)} == {"/user/*/post"}


def test_url_templates_of_other_hosts_speak_for_an_unlabelled_one(spark):
    """A host without any label is judged by the same templates elsewhere; a hot host counts once, so it can't decide for others."""
    rows, at = [], 0
    for h in range(12):
        for branch in ("shop", "news"):
            for i in range(6):
                rows.append((at := at + 1, f"http://h{h}.site{h}.net/{branch}/{i}"))
    rows += [(1000 + i, f"http://hot.net/only/{i}") for i in range(3000)]
    new = [(5000, "http://new.org/shop/9"), (5001, "http://new.org/news/9"), (5002, "http://new.org/only/9"), (5003, "http://new.org/"), (5004, "http://other.org/unseen/9")]
    rules_ = (("net/shop/", "block"), ("net/news/", "allow"), ("hot.net/", "block"))
    got = {r["page_id"]: r["verdict"] for r in urltree.judge(spark.createDataFrame(rows + new, "page_id long, url string"), rules_).collect()}
    assert [got[i] for i in range(5000, 5005)] == ["block", "allow", "allow", "allow", "allow"]


def test_url_templates_are_as_deep_as_paths(spark):
    """Branches below the fourth and below the last level of the tree stay apart."""
    for stem in ("/a/b/c/d", "/a/b/c/d/e/f/g/h"):
        rows = [(i, f"http://h.io{stem}/bad/{i}") for i in range(40)] + [(100 + i, f"http://h.io{stem}/good/{i}") for i in range(40)]
        rules_ = tuple((f"h.io{stem}/bad/{i}", "block") for i in range(1, 4)) + tuple((f"h.io{stem}/good/{i}", "allow") for i in range(1, 4))
        got = {r["page_id"]: r for r in urltree.judge(spark.createDataFrame(rows, "page_id long, url string"), rules_).collect()}
        assert {got[i]["template"] for i in range(40)} == {f"{stem}/bad/*"} and {got[100 + i]["template"] for i in range(40)} == {f"{stem}/good/*"}
        assert all(got[i]["verdict"] == "block" and got[100 + i]["verdict"] == "allow" for i in range(40))


def test_url_branches_merge_by_tokens(spark):
    """Sibling branches with like children merge; one with other children stays, and so does one whose labels differ."""
    rows = [(i * 100 + j, f"http://h.io/{user}/{j}") for i, user in enumerate(("ann", "bob", "cy")) for j in range(30)] + [(1000 + j, f"http://h.io/about/{w}") for j, w in enumerate(("us", "team", "jobs") * 10)]
    got = {r["page_id"]: r["template"] for r in urltree.judge(spark.createDataFrame(rows, "page_id long, url string"), ()).collect()}
    assert got[1000] == "/about/*" and got[0] == "/ann/*"  # its leaves are alike; each user against all others, about among them, is not
    got = {r["page_id"]: r["template"] for r in urltree.judge(spark.createDataFrame(rows[:90], "page_id long, url string"), ()).collect()}
    assert set(got.values()) == {"/*/*"}
    told = (("h.io/ann/", "block"), ("h.io/bob/", "allow"))
    more = [(2000 + i, f"http://h{i}.io/{u}/1") for i in range(20) for u in ("ann", "bob")]
    many = told + tuple((f"h{i}.io/{u}/", v) for i in range(20) for u, v in (("ann", "block"), ("bob", "allow")))
    got = {r["page_id"]: r["template"] for r in urltree.judge(spark.createDataFrame(rows[:90] + more, "page_id long, url string"), many).collect()}
    assert got[0] == "/ann/*" and got[100] == "/bob/*"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in queries.queries()[name](spark, DATA).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_many_languages_take_memory_by_what_they_have():
    """256 made-up languages: a table of all strings by all languages would take a gigabyte."""
    import tracemalloc

    r = random.Random(5)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 2000)]
    langs = [f"l{k:03d}" for k in range(256)]
    counts = {lang: {"".join(r.choice(letters[k * 7 : k * 7 + 40]) for _ in range(r.randint(2, 6))): r.randint(1, 9) for _ in range(800)} for k, lang in enumerate(langs)}
    tracemalloc.start()
    model = langid.Model(langs, counts)
    assert tracemalloc.get_traced_memory()[1] < 700e6
    tracemalloc.stop()
    reader = langid.Reader(model)
    assert reader.table.nbytes <= 4 * langid.NUMBERS
    for lang in langs[::25]:
        words = list(counts[lang])
        assert reader.classify(" ".join(words[:50]))[0] == lang and reader.classify(" ".join(w[:-1] + w[0] for w in words[:80]))[0] == lang
    compact = langid.Compact(model)
    some = [*list(counts["l007"])[:40], "unseen", "", chr(0x4E00), *[w[::-1] for w in counts["l100"]][:40]]
    assert np.allclose(compact.vectors(some), [model.vector(w) for w in some], atol=1e-5)
    # each vector is what the full table has: log of smoothed shares
    word = next(iter(counts["l003"]))
    known = len({w for own in counts.values() for w in own})
    want = [np.log((counts[x].get(word, 0) + langid.SMOOTH) / (sum(counts[x].values()) + langid.SMOOTH * known)) for x in langs]
    assert np.allclose(model.vector(word), want, atol=1e-4)


def test_every_language_is_learned(spark):
    """More languages than were ever counted as classes, one row of each."""
    rows = [(k, " ".join(f"{chr(0x4E00 + k)}{chr(0x5E00 + j)}" for j in range(9)), f"l{k:03d}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.langs) == 300
    got = {x["doc_id"]: x["lang_pred"] for x in langid.classify(docs, model).collect()}
    assert got == {k: lang for k, _, lang in rows}


def test_tokens_are_split_and_hashed_together(monkeypatch):
    texts = ["", "  A b\x0bÄ\tß a\x1cb \r\n", "x\u00a0y \u0130I " + "w" * 70, "\n", " " + "É" * 40 + " b", "b " * 2000]
    alone = []
    digest = bloomlm.xxhash.xxh64_intdigest
    monkeypatch.setattr(bloomlm.xxhash, "xxh64_intdigest", lambda word, seed: alone.append(bytes(word)) or digest(word, seed))
    tokens = bloomlm.Tokens(pa.array(["cut", *texts]).slice(1))
    want = [[*t.encode().lower().split(), b"\n"] for t in texts]
    words = tokens.words.cast(pa.binary()).to_pylist()
    assert [words[i] for i in tokens.rows] == [w for own in want for w in own] and tokens.sizes.tolist() == [len(own) for own in want]
    assert len({*words}) == len(words) == len({*tokens.hashes.tolist()})
    assert sorted(alone) == sorted(w for w in words if len(w) > bloomlm.LONG)  # none of the usual words goes through Python
    again = dict(zip(words, tokens.hashes.tolist(), strict=True))
    other = bloomlm.Tokens(pa.array(["w b", "ä " + "É" * 40]))
    assert all(again.get(w, h) == h for w, h in zip(other.words.cast(pa.binary()).to_pylist(), other.hashes.tolist(), strict=True))


def test_marks_stay_in_their_words():
    assert langid.words_of("हिन्दी में, Über café x_y 12ab") == ["हिन्दी", "में", "über", "café", "x", "y", "ab"]
    assert langid.words_of("plain Words") == ["plain", "words"]


def test_branches_far_below_are_generalised(spark):
    """Nine equal segments, then branches: those that are alike become a wildcard however deep they lie; a path that is alone stays as it is."""
    top = "/".join("abcdefghi")
    many = [f"http://x.net/{top}/user{chr(97 + k)}{chr(97 + j)}/page" for k in range(5) for j in range(6)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*many, "http://y.org/a/b/c/d/e/f/g/h/i/j/k/l"])], "page_id long, url string")
    got = {x["page_id"]: x["template"] for x in urltree.judge(pages).collect()}
    assert {got[i] for i in range(len(many))} == {f"/{top}/*/page"} and got[len(many)] == "/a/b/c/d/e/f/g/h/i/j/k/l"
