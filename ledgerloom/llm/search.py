"""Ranked lexical search: an inverted index in shards, postings in blocks of variable size with their best score, exact search that skips blocks."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

#: Documents of a shard (their numbers take two bytes) and terms in it at most; a longer text ends its shard.
SHARD_DOCS, SHARD_TERMS = 4096, 2_000_000
#: Postings of a block at most, and what a block costs, in units of the score's term part (under a million): more blocks or looser bounds.
LONGEST, COST = 64, 400_000
#: Queries that are searched in one pass over the index at most, and bytes of their texts.
ITEMS, ITEM_BYTES = 1024, 4 << 20
#: Lists that are cut into blocks at once.
LISTS = 4096
#: Documents that are scored at once.
BATCH = 64
#: The term of the row that holds a shard's documents; no text has it.
HEAD = ""
INDEX = "shard long, term string, df long, docs binary, tf binary, ends binary, tops binary, ids array<long>"

_LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of digits, letters and all that is not ASCII, with A-Z in lower case."""
    return text.translate(_LETTERS).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def length_part(n: int, documents: int, every: int) -> int:
    """What a document of n terms adds to the divisor of a term's part: 100 at the mean length."""
    return 100 - 75 + 75 * n * documents // every


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of the score before its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        n = np.array([len(terms(t)) for t in batch.column(0).to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["documents", "every"])


def _cut(parts: np.ndarray, begin: np.ndarray, size: np.ndarray, back: np.ndarray, longest: int, cost: int) -> None:
    """Fill `back` for some lists, the longest first: how many postings the cheapest last block of the prefix that ends at each posting has."""
    size_of = np.arange(1, longest + 1, dtype=np.int64)
    top, paid = np.zeros((len(size), longest), np.int64), np.full((len(size), longest), np.iinfo(np.int64).max // 2)
    paid[:, 0] = 0
    for j in range(int(size[0])):
        on = int(np.searchsorted(-size, -j, "left"))
        s = parts[begin[:on] + j]
        wide = min(longest, j + 1)
        t, p = top[:on, :wide], paid[:on]
        t[:, 1:] = np.maximum(t[:, :-1], s[:, None])
        t[:, 0] = s
        made = t * size_of[:wide]
        made += p[:, :wide]
        pick = made.argmin(1)
        best = made[np.arange(on), pick] + cost
        back[begin[:on] + j] = pick + 1
        p[:, 1:] = p[:, :-1]
        p[:, 0] = best


def block_ends(parts: np.ndarray, lengths: np.ndarray, longest: int = LONGEST, cost: int = COST) -> np.ndarray:
    """Whether a block ends at each posting, for lists that lie one after the other.

    By dynamic programming over the prefixes of a list: the sum of each posting's distance from its block's greatest part, plus `cost` a block, is the least
    that blocks of at most `longest` postings can have. All lists go step by step together.
    """
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    back = np.ones(len(parts), np.int16)
    many = np.flatnonzero(lengths > 1)
    many = many[np.argsort(-lengths[many], kind="stable")]
    for at in range(0, len(many), LISTS):
        _cut(parts, starts[many[at : at + LISTS]], lengths[many[at : at + LISTS]], back, longest, cost)
    last = np.zeros(len(parts), bool)
    at = starts + lengths - 1
    while len(at):
        last[at] = True
        starts, at = starts[keep := at - back[at] >= starts], (at - back[at])[keep]
    return last


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary value a list: its part of the values' bytes."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


class Growing:
    """A shard while its documents come: what is kept of one is its terms' numbers and counts."""

    def __init__(self, number: int):
        self.number, self.ids, self.sizes, self.total = number, [], [], 0
        self.known: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, doc: int | None, counted: Counter, size: int) -> None:
        known = self.known
        self.ids.append(doc)
        self.sizes.append(size)
        self.total += size
        self.terms.append(np.fromiter((known.setdefault(t, len(known)) for t in counted), np.int32, len(counted)))
        self.times.append(np.fromiter(counted.values(), np.int64, len(counted)))


def _shard(number: int, ids: list, counted: list[Counter], sizes: list[int], documents: int, every: int) -> Iterator[pa.RecordBatch]:
    """The rows of a shard of counted documents."""
    shard = Growing(number)
    for doc, own, size in zip(ids, counted, sizes, strict=True):
        shard.add(doc, own, size)
    yield from _rows(shard, documents, every)


def _rows(shard: Growing, documents: int, every: int) -> Iterator[pa.RecordBatch]:
    """The rows of a shard: its head (ids, and the length parts in docs), then one row a term."""
    number, known = shard.number, shard.known
    m = np.array([length_part(n, documents, every) for n in shard.sizes], np.int64)
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), *((c, pa.binary()) for c in ("docs", "tf", "ends", "tops")), ("ids", pa.list_(pa.int64()))])
    yield pa.RecordBatch.from_pylist([{"shard": number, "term": HEAD, "df": 0, "docs": m.tobytes(), "ids": shard.ids}], schema)
    term, tf = np.concatenate(shard.terms), np.concatenate(shard.times)
    doc = np.repeat(np.arange(len(shard.terms)), [len(x) for x in shard.terms])
    order = np.argsort(term, kind="stable")
    doc, tf, df = doc[order], tf[order], np.bincount(term, minlength=len(known))
    parts = part(tf, m[doc])
    last = block_ends(parts, df)
    starts, ends = np.concatenate([[0], np.cumsum(df)]), np.flatnonzero(last)
    tops = np.maximum.reduceat(parts, np.concatenate([[0], ends[:-1] + 1])) if len(ends) else parts
    blocks = np.searchsorted(ends, starts)
    inside = ends - np.repeat(starts[:-1], np.diff(blocks))
    names, step = pa.array(list(known), pa.binary()).cast(pa.string()), 5_000
    for at in range(0, len(known), step):
        end = min(len(known), at + step)
        a, b, c, d = starts[at], starts[end], blocks[at], blocks[end]
        own, cut = starts[at : end + 1] - a, blocks[at : end + 1] - c
        columns = [_binary(doc[a:b].astype("<u2"), own), _binary(tf[a:b].astype("<u4"), own), _binary(inside[c:d].astype("<u2"), cut), _binary(tops[c:d].astype("<u4"), cut)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(end - at, number)), names[at:end], pa.array(df[at:end]), *columns, pa.nulls(end - at, pa.list_(pa.int64()))], schema=schema)


def _index(documents: int, every: int, shard_docs: int, shard_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Growing(TaskContext.get().partitionId() << 32)
        for batch in slices(batches, 256):
            for text, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own := terms(text):
                    shard.add(doc, Counter(own), len(own))
                    if len(shard.ids) >= shard_docs or shard.total >= shard_terms:
                        yield from _rows(shard, documents, every)
                        shard = Growing(shard.number + 1)
        if shard.ids:
            yield from _rows(shard, documents, every)

    return run


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_terms: int = SHARD_TERMS) -> tuple[DataFrame, int]:
    """(index, number of documents with a term): all rows and all terms of docs.

    A shard is a run of the rows that one task reads, so nothing is shuffled: it counts its terms, lists the documents of each with their
    counts, and cuts each list into blocks by block_ends(), whose greatest parts bound every document in them. Two passes over the
    texts: one for the number of documents and terms, which the parts need, one for the index.
    """
    own = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    row = own.select("text").mapInArrow(_sizes, "documents long, every long").agg(F.sum("documents"), F.sum("every")).first()
    documents, every = row[0] or 0, row[1] or 0
    return materialize(own.mapInArrow(_index(documents, every, shard_docs, shard_terms), INDEX)), documents


@dataclass
class Postings:
    """The list of a term: documents, parts, and its blocks: first document, that after the last one, size, greatest part."""

    docs: np.ndarray
    parts: np.ndarray
    first: np.ndarray
    after: np.ndarray
    sizes: np.ndarray
    tops: np.ndarray
    top: int


class Shard:
    """The lists of one shard that some queries need."""

    def __init__(self, rows: dict[str, tuple], ids: list, m: np.ndarray):
        self.n, self.lists = len(ids), {}
        self.none = np.array([i is None for i in ids])
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        self.scored = 0
        for term, (docs, tf, ends, tops) in rows.items():
            at = np.frombuffer(docs, "<u2").astype(np.int64)
            end, top = np.frombuffer(ends, "<u2").astype(np.int64), np.frombuffer(tops, "<u4").astype(np.int64)
            begin = np.concatenate([[0], end[:-1] + 1])
            self.lists[term] = Postings(at, part(np.frombuffer(tf, "<u4").astype(np.int64), m[at]), at[begin], at[end] + 1, end - begin + 1, top, int(top.max()))

    def _score(self, own: list[tuple[int, Postings]], some: np.ndarray) -> np.ndarray:
        total = np.zeros(len(some), np.int64)
        for w, x in own:
            k = np.minimum(np.searchsorted(x.docs, some), len(x.docs) - 1)
            total += np.where(x.docs[k] == some, w * x.parts[k], 0)
        self.scored += len(some)
        return total

    def _bounds(self, own: list[tuple[int, Postings]], some: int) -> np.ndarray:
        """For each document of one of the first `some` lists what it can score at most, for others zero: in those lists the greatest part of
        its own block, in the other lists that of the block that lies over it, whether it is in it or not."""
        bound, rest = np.zeros(self.n, np.int64), np.zeros(self.n + 1, np.int64)
        for w, x in own[:some]:
            bound[x.docs] += w * np.repeat(x.tops, x.sizes)
        if own[some:]:
            gains = np.concatenate([w * x.tops for w, x in own[some:]])
            np.add.at(rest, np.concatenate([x.first for _, x in own[some:]]), gains)
            np.subtract.at(rest, np.concatenate([x.after for _, x in own[some:]]), gains)
        return np.where(bound > 0, bound + np.cumsum(rest[:-1]), 0)

    def search(self, query: list[tuple[str, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the best k of the shard, equal scores by ascending id, rows without an id last.

        Lists go by the most that they can give. The documents of the first ones are scored, which sets a bar: the k-th best score. Lists whose
        greatest parts sum to less than the bar can't lift a document of theirs alone over it, so, as in WAND, only documents of the others are
        pivots; and of those, only ones whose blocks allow the bar are scored, from the highest bound down, while the bar rises. What stays below it is skipped
        unscored, block by block in the lists that make no pivots.
        """
        own = sorted(((w, self.lists[t]) for t, w in query if t in self.lists and w > 0), key=lambda x: -x[0] * x[1].top)
        if not own:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rest = np.cumsum([w * x.top for w, x in own][::-1])[::-1]  # what the lists from here on give together
        docs, scores, bar = np.zeros(0, np.int64), np.zeros(0, np.int64), 1

        def look(some: np.ndarray) -> None:
            nonlocal docs, scores, bar
            found = self._score(own, some)
            docs, scores = np.concatenate([docs, some[found > 0]]), np.concatenate([scores, found[found > 0]])
            best = np.lexsort((self.ids[docs], self.none[docs], -scores))[:k]
            docs, scores = docs[best], scores[best]
            bar = int(scores[-1]) if len(scores) == k else 1

        first = np.searchsorted(np.cumsum([len(x.docs) for _, x in own]), BATCH) + 1
        look(seen := np.unique(np.concatenate([x.docs for _, x in own[:first]]))[: 4 * BATCH])
        bound = self._bounds(own, int(np.searchsorted(-rest, -bar, "right")))
        bound[seen] = 0
        left, take = np.flatnonzero(bound >= bar), BATCH
        while len(left):
            cut = np.partition(bound[left], -take)[-take] if len(left) > take else 0
            some, left = left[bound[left] >= cut], left[bound[left] < cut]
            look(some)
            left, take = left[bound[left] >= bar], 2 * take
        return docs, scores


def _searcher(queries: list[list[tuple[str, int]]], k: int):
    def run(table: pa.Table) -> pa.Table:
        rows, head = {}, None
        for row in zip(*(table.column(c).to_pylist() for c in ("term", "docs", "tf", "ends", "tops", "ids")), strict=True):
            if row[0] == HEAD:
                head = row
            else:
                rows[row[0]] = row[1:5]
        shard = Shard(rows, head[5], np.frombuffer(head[1], np.int64))
        items, ids, scores = [], [], []
        for i, query in enumerate(queries):
            docs, found = shard.search(query, k)
            items += [i] * len(docs)
            ids += [None if shard.none[d] else int(shard.ids[d]) for d in docs]
            scores += found.tolist()
        return pa.table({"item": pa.array(items, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    return run


def _blocks(items: DataFrame) -> Iterator[list]:
    """The items in blocks that are small enough to be sent to all tasks."""
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append(row)
        size += len(row["text"])
        if len(block) >= ITEMS or size >= ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(index: DataFrame, documents: int, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0, equal scores by ascending id.

    Items are the stated queries; they go in blocks of bounded size, each one pass over the lists of its terms. A shard gives k
    documents an item at most, of which the best are ranked. Items that repeat id and text are one; a null text, or one without terms, finds
    nothing, and an empty index as well.
    """
    spark = index.sparkSession
    shown = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct()
    out = []
    for block in _blocks(shown):
        asked = [Counter(t.decode() for t in terms(row["text"].encode())) for row in block]
        words = spark.createDataFrame([(t,) for t in {HEAD}.union(*asked)], "term string")
        wanted = index.join(F.broadcast(words), "term", "left_semi")  # the words of one block, bounded by its size
        df = dict(wanted.groupBy("term").agg(F.sum("df")).collect())
        weighed = [[(t, n * weight(documents, df[t])) for t, n in c.items() if t in df] for c in asked]
        found = wanted.groupBy("shard").applyInArrow(_searcher(weighed, k), "item long, doc_id long, score long")
        nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = found.withColumn("rank", nth).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(block)], "item long, item_id long")
        out.append(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if len(out) == 1:
        return out[0]
    done = [materialize(x) for x in out]
    for x in done[1:]:
        done[0] = done[0].unionByName(x)
    return done[0]
