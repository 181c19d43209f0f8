"""Personal data: fixed patterns, and further spans by a linear-chain CRF over word shapes."""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import slices

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns; the look-behinds only skip starts that can't match, so that long runs take linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT, NOT_DIGIT = re.compile("[0-9]"), re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return NOT_DIGIT.sub("", text)


def _ip_fits(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start; leftmost and non-overlapping within a kind."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:  # a local part ends at its @, so each match has exactly one
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((0, start, done := m.end()))
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        found += [(1, *m.span()) for m in IP.finditer(text) if _ip_fits(m[0])]
        found += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


#: Tokens of the CRF: letters, digits, or one other character that is not white space.
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
#: A token that a span can hang on: the check of each kind asks for a digit, an @ or the word at. Tokens further than REACH characters from all of
#: these are O by rule; each stretch between is decoded whole, as one chain, with the BESIDE tokens that its features look at on either side.
HOOK, REACH, BESIDE = re.compile(r"[0-9@]|\b(?:[Dd][Oo]|[Aa])[Tt]\b"), 48, 2
#: Padded tokens that are decoded together, and tokens of a chain whose features are held at once.
TOGETHER, BLOCK = 1 << 16, 1 << 12
WORDS = frozenset("at dot mail email com org net phone tel call mobile card visa ip host address version license section page year token key id".split())
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def _shape(token: str) -> str:
    if token.isdigit():
        return f"d{min(len(token), 20)}"
    low = token.lower()
    return low if low in WORDS or not token.isalnum() else f"a{min(len(token), 3)}"


def token_features(text: str, tokens: list[tuple[int, int]]) -> list[list[str]]:
    """Names of the features that each token has: shapes of it and its neighbours, whether they touch, digits of its number run."""
    return list(each_features(text, tokens))


def each_features(text: str, tokens: list[tuple[int, int]]) -> Iterator[list[str]]:
    shapes = [_shape(text[a:b]) for a, b in tokens]
    n = len(tokens)
    glued = [i > 0 and tokens[i - 1][1] == tokens[i][0] for i in range(n)] + [False]
    runs, i = [""] * n, 0
    while i < n:
        j = i
        while j < n and (shapes[j][0] == "d" and shapes[j][1:].isdigit() or shapes[j] in "+().-/") and (j == i or tokens[j][0] - tokens[j - 1][1] <= 1):
            j += 1
        if j > i:
            count = sum(int(s[1:]) for s in shapes[i:j] if s[0] == "d" and len(s) > 1)
            parts = sum(s[0] == "d" and len(s) > 1 for s in shapes[i:j])
            touch = "w" if glued[i] or glued[j] else ""
            for k in range(i, j):
                runs[k] = f"n{min(count, 20)}p{min(parts, 6)}{touch}"
        i = max(j, i + 1)
    at = lambda i: shapes[i] if 0 <= i < n else "-"
    for i in range(n):
        g = "gs"[not glued[i]] + "gs"[not glued[i + 1]]
        yield [f"0{at(i)}", f"0{at(i)}{g}", f"-{at(i - 1)}", f"+{at(i + 1)}", f"={at(i - 2)}", f"#{at(i + 2)}", f"-0{at(i - 1)}|{at(i)}{g[0]}", f"0+{at(i)}|{at(i + 1)}{g[1]}", f"r{runs[i]}", f"r0{runs[i]}|{at(i)}"]


def labelled_table(rows: int = 600, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The small labelled table: sentences with marked spans, and sentences with numbers and words that are none."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "the", "er", "on", "ti", "re", "sch", "ue", "eau", "ció", "st", "mo"]) for _ in range(r.randint(1, 3)))
    part = lambda: str(r.randint(0, 255))

    def card() -> str:
        d = num(15)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def email() -> str:
        at = r.choice(["@", "@", " (at) ", " [at] ", "(at)", " at "])
        dot = "." if "@" in at else r.choice([" dot ", " (dot) ", " [dot] "])
        return word() + r.choice(["", f".{num(2)}", f"_{word()}"]) + at + word() + r.choice(["", num(1)]) + dot + r.choice([f"example{dot}com", "org", "net", "com"])

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return r.choice([f"+{num(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(2)} {a} {b} {c}", f"{a}.{b}.{c}", f"00{num(2)} {a} {b}{c}"])

    def cards() -> str:
        c = card()
        return r.choice([c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), "-".join(c[i : i + 4] for i in range(0, 16, 4)), ".".join(c[i : i + 4] for i in range(0, 16, 4))])

    make = (email, lambda: ".".join(part() for _ in range(4)), cards, phone)
    other = (lambda: f"Version {r.randint(1, 9)}.{r.randint(0, 9)}.", lambda: f"{r.randint(1900, 2030)}-{num(2)}-{num(2)}", lambda: f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', lambda: num(r.randint(1, 6)), lambda: f"{num(1)}.{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: f"dot {word()}", lambda: f"{word()} at {word()}", lambda: f"{num(2)}.{num(2)}.{num(4)}", lambda: f"{num(3)},{num(3)}.{num(2)}", lambda: f"@{word()}", lambda: f"{word()}{num(2)}", lambda: f"{num(8)}-{num(4)}-{num(4)}-{num(4)}-{num(12)}")
    table = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(0, 4))) + r.choice([" ", ", ", ". ", "\n"])
            if r.random() < 0.6:
                kind = r.randrange(4)
                value = make[kind]()
                text += r.choice(["", "", {0: "mail ", 1: "ip ", 2: "card ", 3: "tel "}[kind], "("])
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + r.choice(["", ".", ",", "!!", ")", "***"])
            else:
                text += r.choice(other)()
            text += " "
        table.append((text + word(), spans))
    return table


class Model:
    """Weights by feature name; fitted by fit_model()."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, trans: np.ndarray):
        self.names, self.weights, self.trans = names, np.vstack([weights, np.zeros(weights.shape[1])]), trans

    def scores(self, features: Iterable[list[str]]) -> np.ndarray:
        none, features = len(self.weights) - 1, iter(features)
        parts = iter(lambda: [[self.names.get(x, none) for x in f] for f in islice(features, BLOCK)], [])
        return np.concatenate([self.weights[np.array(part)].sum(1) for part in parts])


def fit_model(table: list[tuple[str, list[tuple[int, int, int]]]]) -> Model:
    """Fit the CRF to (text, [(kind, start, end)]) rows; a B label opens a span and an I label goes on with the same kind."""
    names: dict[str, int] = {}
    rows, labels = [], []
    for text, spans in table:
        tokens = [m.span() for m in TOKEN.finditer(text)]
        if not tokens:
            continue
        rows.append([[names.setdefault(x, len(names)) for x in f] for f in token_features(text, tokens)])
        y = np.zeros(len(tokens), np.int64)
        for kind, start, end in spans:
            inside = [i for i, (a, b) in enumerate(tokens) if a >= start and b <= end]
            y[inside] = 2 + 2 * kind
            y[inside[:1]] = 1 + 2 * kind
        labels.append(y)
    n = len(LABELS)
    forbidden = np.array([[b and b % 2 == 0 and a not in (b, b - 1) for b in range(n)] for a in range(n)])
    weights, trans = crf.fit([np.array(r) for r in rows], labels, n, rounds=50, rate=0.3, n_features=len(names), forbidden=forbidden)
    return Model(names, weights, trans)


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit_model(labelled_table())


def _fits(kind: int, text: str) -> bool:
    """The exact check of a span that the CRF proposes."""
    d = _digits(text)
    if kind == 0:
        return bool(re.search(r"@|\bat\b", text, re.I) and re.search(r"\.|\bdot\b", text, re.I)) and text[0].isalnum() and text[-1].isalnum()
    if kind == 1:
        return len(p := re.findall(r"\d+", text)) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in p)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and text[-1].isdigit() and not any(c.isalpha() for c in text)


def stretches(text: str) -> list[tuple[list[tuple[int, int]], int, int]]:
    """(tokens, first, end) of each chain: its tokens from `first` up to `end` are near hooks, those before and behind are O by rule."""
    near: list[list[int]] = []
    for m in HOOK.finditer(text):
        if near and m.start() - REACH <= near[-1][1]:
            near[-1][1] = m.end() + REACH
        else:
            near.append([m.start() - REACH, m.end() + REACH])
    if not near:
        return []
    tokens = [t.span() for t in TOKEN.finditer(text)]
    starts, ends = [a for a, _ in tokens], [b for _, b in tokens]
    ranges: list[list[int]] = []
    for low, high in near:
        first, end = bisect_right(ends, low), bisect_left(starts, high)
        if ranges and first <= ranges[-1][1]:
            ranges[-1][1] = max(end, ranges[-1][1])
        elif first < end:
            ranges.append([first, end])
    return [(tokens[max(0, a - BESIDE) : b + BESIDE], min(a, BESIDE), min(a, BESIDE) + b - a) for a, b in ranges]


def chain_scores(text: str, chain: tuple[list[tuple[int, int]], int, int], model: Model) -> np.ndarray:
    """Scores (token, label) of a chain; outside of its own tokens every label but O is ruled out."""
    tokens, first, end = chain
    scores = model.scores(each_features(text, tokens))
    scores[:first, 1:] = scores[end:, 1:] = -1e4
    return scores


def find(texts: list[str], model: Model) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and all spans, by kind and start. Chains of all texts are decoded together."""
    base = [base_spans(t) for t in texts]
    chains = [(i, c) for i, t in enumerate(texts) for c in stretches(t)]
    added: dict[int, list[tuple[int, int, int]]] = {}
    chains.sort(key=lambda c: len(c[1][0]))
    at = 0
    while at < len(chains):
        size = max(1, min(128, TOGETHER // len(chains[min(at + 127, len(chains) - 1)][1][0])))
        part = chains[at : at + size]
        at += size
        scores, lengths = crf.padded([chain_scores(texts[i], c, model) for i, c in part])
        for (i, (tokens, _, _)), labels in zip(part, crf.viterbi(scores, model.trans, lengths).tolist(), strict=True):
            k = 0
            while k < len(tokens):
                end = k + 1
                if label := labels[k]:
                    while end < len(tokens) and labels[end] == label + label % 2 and labels[end] % 2 == 0:
                        end += 1
                    kind, span = (label - 1) // 2, (tokens[k][0], tokens[end - 1][1])
                    if not any(a < span[1] and span[0] < b for _, a, b in base[i]) and _fits(kind, texts[i][span[0] : span[1]]):
                        added.setdefault(i, []).append((kind, *span))
                k = end
    return [(own, sorted(own + added.get(i, []))) for i, own in enumerate(base)]


def _spans(model: Model):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = find([t or "" for t in batch.column(1).to_pylist()], model)
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": (k, a, b) in own} for k, a, b in every] for own, every in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return run


def spans(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, start, end, base) for each row of docs; places are code points, ends exclusive.

    Base spans always stay; the CRF adds spans that overlap none of them and pass the check of their kind. A null text counts as empty.
    Repeated rows stay repeated, a null doc_id stays null, an empty table gives no rows, other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_spans(model or default_model()), "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, their SHA-256 and all spans as text, from spans()."""
    base = F.filter("spans", lambda s: s["base"])
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def masked(text: str, every: list[tuple[int, int, int]]) -> str:
    """The text with each span, or each chain of overlapping spans, replaced by its kind in angle brackets."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in every):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _masked(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            new = [t if t is None else masked(t, every) for t, (_, every) in zip(texts, find([t or "" for t in texts], model), strict=True)]
            yield batch.set_column(at, "text", pa.array(new, pa.string()))

    return run


def mask(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with the spans in column text replaced; other columns as they were, n_chars (if there) counted anew.

    A null text stays null, an empty one empty. Repeated rows stay repeated, rows without an id stay, an empty table gives no rows.
    """
    out = docs.mapInArrow(_masked(model or default_model()), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
