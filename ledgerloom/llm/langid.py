"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

UNKNOWN = "und"
#: The bounded sample: rows of a language, whole, and their characters together, at most; rows and characters of all languages, which they share evenly
#: if there are many. It is dealt into PARTS by hash; a row that is longer than its part's characters, or goes beyond them, is left out.
DOCS, CHARS, ROWS, ALL_CHARS, PARTS = 800, 1 << 25, 204_800, 1 << 33, 32
LONGEST, SMOOTH = 5, 0.5
WORD = re.compile(r"[^\W\d_]+")
#: Combining marks, which belong to the letter before them; those beyond the first plane are looked for by their plane, as a search by a table can't.
_MARKS = [chr(c) for c in range(0x300, 0x20000) if unicodedata.category(chr(c)) in ("Mn", "Mc")]
_FAR = "\U00010000-\U0001ffff"
MARK = re.compile(f"[{''.join(re.escape(c) for c in _MARKS if c < chr(0x10000))}]|[{_FAR}]")
MARKED_WORD = re.compile(f"[^\\W\\d_](?:[^\\W\\d_]|[{''.join(map(re.escape, _MARKS))}])*")
#: Words whose vector a task keeps, and numbers of these vectors together.
KEPT, NUMBERS = 200_000, 25_000_000


def words_of(text: str) -> list[str]:
    """Runs of letters and their combining marks, in lower case."""
    low = text.lower()
    return (WORD if low.isascii() or not MARK.search(low) else MARKED_WORD).findall(low)


def held_out(column: str = "doc_id", mod: int = 5, rest: int = 0) -> F.Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod == rest


def _grams(word: str, size: int) -> list[str]:
    """The character n-grams of a word; its ends are marked but for single characters, where a mark would say nothing."""
    marked = f"_{word}_" if size > 1 else word
    return [marked[at : at + size] for at in range(len(marked) - size + 1)]


@dataclass
class Table:
    """Log frequencies of strings by language: those of strings that a language has, and what it gives for all others. Compact arrays, which are
    read a number at a time: a string has few languages."""

    first: array
    lang: array
    more: array
    other: list[float]

    def mean(self, rows: list[int]) -> np.ndarray:
        """The mean vector of these strings."""
        first, lang, more = self.first, self.lang, self.more
        out, share = self.other.copy(), 1.0 / len(rows)
        for i in rows:
            for at in range(first[i], first[i + 1]):
                out[lang[at]] += more[at] * share
        return np.array(out, np.float32)


class Model:
    """Per-language log frequencies of words and of n-grams of each size. Only what a language has takes memory, a few bytes for each string, so it follows
    the sample and not the number of languages."""

    def __init__(self, langs: list[str], counts: dict[str, dict[str, int]]):
        self.langs = langs
        self.index: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        columns: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(LONGEST + 1)]
        for lang in langs:
            rows, times = [array("l") for _ in self.index], [array("d") for _ in self.index]
            for word, n in counts[lang].items():
                for size, index in enumerate(self.index):
                    for gram in _grams(word, size) if size else (word,):
                        rows[size].append(index.setdefault(gram, len(index)))
                        times[size].append(n)
            for column, r, t in zip(columns, rows, times, strict=True):
                own, at = np.unique(np.array(r, np.int64), return_inverse=True)
                column.append((own, np.bincount(at, np.array(t), len(own))))
        self.tables = [self._table(column, len(index)) for column, index in zip(columns, self.index, strict=True)]

    def _table(self, columns: list[tuple[np.ndarray, np.ndarray]], n: int) -> Table:
        below = np.array([np.log(own.sum() + SMOOTH * max(1, n)) for _, own in columns])
        other = (np.log(SMOOTH) - below).tolist()
        row = np.concatenate([r for r, _ in columns]) if columns else np.zeros(0, np.int64)
        lang = np.repeat(np.arange(len(columns), dtype=np.int32), [len(r) for r, _ in columns])
        more = np.concatenate([np.log(own + SMOOTH) - np.log(SMOOTH) for _, own in columns]).astype(np.float32) if columns else np.zeros(0, np.float32)
        order = np.argsort(row, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int64)
        return Table(array("q", first.tobytes()), array("i", lang[order].tobytes()), array("f", more[order].tobytes()), other)

    def backoff(self, word: str) -> np.ndarray:
        """The mean vector of the word's longest n-grams that are known; none: all languages alike."""
        for size in range(LONGEST, 0, -1):
            if found := [i for gram in _grams(word, size) if (i := self.index[size].get(gram)) is not None]:
                return self.tables[size].mean(found)
        return np.zeros(len(self.langs), np.float32)

    def vector(self, word: str) -> np.ndarray:
        """A known word's own vector, else that of its n-grams."""
        known = self.index[0].get(word)
        return self.backoff(word) if known is None else self.tables[0].mean([known])


class Compact:
    """A model as tasks hold it: strings as sorted 64-bit hashes, some bytes each, in place of dictionaries of text, which take a hundred."""

    def __init__(self, model: Model):
        self.langs, self.keys, self.tables = model.langs, [], []
        for index, table in zip(model.index, model.tables, strict=True):
            keys = np.fromiter(map(_hash, index), np.uint64, len(index))
            order = np.argsort(keys, kind="stable")
            first, lang, more = (np.frombuffer(x, t) for x, t in ((table.first, np.int64), (table.lang, np.int32), (table.more, np.float32)))
            sizes = np.diff(first)[order]
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            at = np.arange(ends[-1]) + np.repeat(first[:-1][order] - ends[:-1], sizes)
            self.keys.append(keys[order])
            self.tables.append((ends, lang[at], more[at], np.array(table.other)))

    def vectors(self, words: list[str]) -> np.ndarray:
        """A row for each word: a known word's own vector, else the mean of its longest n-grams that are known; none: all languages alike. All words are
        looked up together."""
        width = len(self.langs)
        out, left = np.zeros((len(words), width)), np.arange(len(words))
        for size in (0, *range(LONGEST, 0, -1)):
            keys, (first, lang, more, other) = self.keys[size], self.tables[size]
            if not len(left) or not len(keys):
                continue
            grams = [_grams(words[i], size) if size else [words[i]] for i in left]
            owner = np.repeat(left, [len(x) for x in grams])
            wanted = np.fromiter(map(_hash, chain.from_iterable(grams)), np.uint64, len(owner))
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found = keys[at] == wanted
            owner, at = owner[found], at[found]
            times = np.bincount(owner, minlength=len(words))
            sizes = first[at + 1] - first[at]
            ends = np.cumsum(sizes)
            each = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[at] - ends + sizes, sizes)
            whose = np.repeat(owner, sizes)
            sums = np.bincount(whose * width + lang[each], more[each] / times[whose], len(words) * width).reshape(len(words), width)
            hit = left[times[left] > 0]
            out[hit], left = other + sums[hit], left[times[left] == 0]
        return out.astype(np.float32)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


class Reader(dict):
    """Word to the number of its vector in `table`; up to `most` words are kept, then all are forgotten."""

    def __init__(self, model: Model | Compact):
        super().__init__()
        self.model, width = model if isinstance(model, Compact) else Compact(model), max(1, len(model.langs))
        self.most, self.step = max(1, min(KEPT, NUMBERS // width)), max(1, min(4096, (1 << 22) // width))
        self.table = np.zeros((self.most, width), np.float32)

    def learn(self, words: list[str]) -> None:
        """Take in words that are not kept yet."""
        for at in range(0, len(words), self.step):
            part = words[at : at + self.step]
            n = len(self)
            self.table[n : n + len(part), : len(self.model.langs)] = self.model.vectors(part)
            self.update(zip(part, range(n, n + len(part)), strict=True))

    def classify(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the softmax over the summed log frequencies; no letter: UNKNOWN and 0."""
        if not text or not self.model.langs or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        words, step = words_of(text), min(50_000, self.most)
        total = np.zeros(len(self.model.langs))
        for at in range(0, len(words), step):
            part = words[at : at + step]
            if len(self) + len(part) > self.most:
                self.clear()
            self.learn([w for w in dict.fromkeys(part) if w not in self])
            total += self.table[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(0, np.float64)
        best = int(total.argmax())
        return self.model.langs[best], 1 / float(np.exp(np.maximum(total - total[best], -700)).sum())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 128):
        counts: dict[tuple[str, str], int] = defaultdict(int)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word in words_of(text):
                counts[lang, word] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = DOCS, chars: int = CHARS, rows: int = ROWS) -> Model:
    """Fit on a bounded sample of rows with text and language: `per_lang` rows of each language with `chars` characters at most, `rows` rows in all, dealt into
    PARTS by hash, and of each part those whose id hashes lowest, among about twice as many that are drawn by hash. Every language is learned; only if there are
    more languages than `rows`, so that not each one can have a row, the most frequent ones are.

    The rows are read whole, and all of their words count: on the executors, so that the driver gets a row for each different word. A
    repeated row counts once. An empty table, or one without languages, gives a model that knows none.
    """
    text = F.col(text_col).cast("string")
    own = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    known = materialize(own.groupBy("lang").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "lang").limit(rows))
    langs = known.count()
    if not langs:
        return Model([], {})
    per_lang, chars = max(1, min(per_lang, rows // langs)), max(1, min(chars, ALL_CHARS // langs))
    parts = min(PARTS, per_lang)
    order = Window.partitionBy("lang", "part").orderBy("h", "id", "text_hash")
    key = ["id", "text_hash", "lang"]
    # of a language with many rows only about twice as many as are wanted are dealt at all: those whose hash is low
    low = F.pmod(F.xxhash64("id", "text_hash", F.lit("sample")), F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(2.0 * per_lang) / F.col("times")) * (1 << 30)
    part = F.pmod(F.xxhash64("id", "lang"), F.lit(parts)).alias("part")
    drawn = own.join(F.broadcast(known), "lang").where(low)  # at most `rows` languages
    dealt = drawn.select(*key, F.length("text").alias("n"), F.xxhash64("id").alias("h"), part).where(F.col("n") <= chars // parts)
    first = dealt.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_lang // parts)
    chosen = first.withColumn("so_far", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("so_far") <= chars // parts)
    sample = own.join(F.broadcast(chosen.select(key).distinct()), key, "left_semi").groupBy(key).agg(F.max("text").alias("text"))
    counted = sample.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    table = counted.toArrow()
    for lang, word, n in zip(*(table[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts[lang][word] = n
    return Model(sorted(counts), {k: dict(sorted(v.items())) for k, v in counts.items()})


def _classified(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in slices(batches):
            found = [reader.classify(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for each row of docs, from its text alone.

    A null text, one without a letter, or a model without languages gives `und` and 0. Ties go to the language that sorts first.
    Repeated rows stay repeated, a null doc_id stays null, an empty table gives no rows, other columns are ignored. The
    model's size is bounded by its sample, so it is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Compact(model))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_classified(shared), "doc_id long, lang_pred string, score double")


def _kept(shared, lowest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in slices(batches):
            at, own = batch.schema.get_field_index("text"), batch.schema.get_field_index("lang")
            found = [reader.classify(t) for t in batch.column(at).to_pylist()]
            batch = batch.set_column(own, "lang", pa.array([x for x, _ in found], pa.string()))
            yield batch.filter(pa.array([x != UNKNOWN and s >= lowest for x, s in found], pa.bool_()))

    return run


def keep_known(docs: DataFrame, model: Model, lowest: float = 0.5) -> DataFrame:
    """The rows of docs whose language is told with a score of at least `lowest`, with it in column lang; other columns as they were.

    Rows with a null text or one without a letter go, as do all rows if the model knows no language. Repeated rows stay repeated, a null doc_id
    stays null, an empty table gives no rows.
    """
    return docs.mapInArrow(_kept(docs.sparkSession.sparkContext.broadcast(Compact(model)), lowest), docs.schema)
