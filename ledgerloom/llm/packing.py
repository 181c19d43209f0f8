"""Best-fit packing of token sequences with large-item matching."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import bpe
from .common import materialize, slices

CAPACITY, END_ID = 2048, 0
#: Pieces of one length that one task ranks, at most on average.
GROUP, LEAST_SALTS = 100_000, 64


class Tokens:
    """Ids of a text by the vocabulary file of the tokenizers library.

    The rank file of the same vocabulary gives the same ids several times faster and is used where the text holds none of the file's
    special tokens; texts that do, or that the fast path can't take, go to the tokenizers library itself.
    """

    def __init__(self, json_path: str, ranks_path: str):
        self.json_path = json_path
        with open(json_path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.fast = bpe.codec(ranks_path).library

    @cached_property
    def exact(self) -> Tokenizer:
        return Tokenizer.from_file(self.json_path)

    def __call__(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            try:
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            except Exception:  # noqa: BLE001  the library gives up on some very long runs
                pass
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def tokens(json_path: str, ranks_path: str) -> Tokens:
    return Tokens(json_path, ranks_path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all are full but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(json_path: str, ranks_path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(json_path, ranks_path)
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            arrays = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return run


def pieces(docs: DataFrame, json_path: str, ranks_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of each piece of each document."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(json_path, ranks_path, capacity, with_ids), schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the items of each length go, from how many there are: (length, first rank, end rank, first bin, items a bin, offset).

    Items over a third of the capacity go at most two to a bin: the largest is matched with the largest that still fits
    beside it. Smaller ones, the largest first, go to the fullest bins that still take them. Bins with like
    contents are one run of bin numbers, so the work depends on the number of lengths and not on that of the items.
    """
    segments, used = [], defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    order: list[int] = []
    bins = 0

    def put(length: int, n: int, first: int, per: int, offset: int) -> None:
        segments.append((length, used[length], used[length] + n, first, per, offset))
        used[length] += n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                insort(order, gap)
            gaps[gap].append((first, n))

    left = {k: n for k, n in counts.items() if n}
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        fits = bisect_left(large, capacity - a + 1)
        b = large[fits - 1] if fits else 0
        if b == a and left[a] < 2:
            b = large[fits - 2] if fits > 1 else 0
        n = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        put(a, n, bins, 1, 0)
        left[a] -= n
        if b:
            put(b, n, bins, 1, a)
            left[b] -= n
        leave(capacity - a - b, bins, n)
        bins += n
        large = [k for k in large if left[k]]
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(order, s)
            if at == len(order):
                per = capacity // s
                full, rest = divmod(n, per)
                if full:
                    put(s, full * per, bins, per, 0)
                    leave(capacity - per * s, bins, full)
                    bins += full
                if rest:
                    put(s, rest, bins, rest, 0)
                    leave(capacity - rest * s, bins, 1)
                    bins += 1
                n = 0
                continue
            gap = order[at]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                order.pop(at)
            per, offset = gap // s, capacity - gap
            full = min(many, n // per)
            if full:
                put(s, full * per, first, per, offset)
                leave(gap - per * s, first, full)
                n -= full * per
                first, many = first + full, many - full
            if many and n:
                put(s, n, first, n, offset)
                leave(gap - n * s, first, 1)
                first, many, n = first + 1, many - 1, 0
            leave(gap, first, many)
    return segments


def _placed(segments: list[tuple[int, int, int, int, int, int]]):
    table = np.array(sorted(segments), np.int64).reshape(-1, 6)
    keys = (table[:, 0] << 44) | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            _, low, _, first, per, offset = table[np.searchsorted(keys, (length << 44) | rank, "right") - 1].T
            nth, within = np.divmod(rank - low, per) if len(rank) else (rank, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first + nth), pa.array(offset + within * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, json_path: str, ranks_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of docs.

    Texts are tokenised once; their pieces' sizes, a few dozen bytes each, are written to the shared folder. The driver
    sees only how many pieces have each length (at most `capacity` numbers) and plans from that. Each piece then needs its rank
    among those of its length: they are ranked in salted groups whose offsets come from the groups' counts, so one very common
    length is not one task. The table of these offsets grows with the input, so it is merged with the ranked rows, which are sorted by
    the same keys, and not broadcast. A null or empty text is a piece of one id. Repeated rows are packed each; an empty
    table gives no rows; other columns are ignored.
    """
    made = materialize(pieces(docs, json_path, ranks_path, capacity))
    salts = max(LEAST_SALTS, -(-made.count() // GROUP))
    salted = made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    by_length = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = materialize(groups.select("length", "salt", "n", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("before")))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_group = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(by_group)).join(groups.drop("n").hint("merge"), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(_placed(plan(counts, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(docs: DataFrame, placed: DataFrame, json_path: str, ranks_path: str, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids of each packed sequence: the ids of its pieces in order. doc_id must be unique and not null in docs.

    Null and empty texts are one id; pieces of documents that are not in docs are left out of their sequence; an empty table gives no rows; other
    columns are ignored. A group is one sequence, so it never holds more than `capacity` ids.
    """
    own = pieces(docs, json_path, ranks_path, capacity, with_ids=True).select("doc_id", "piece", "ids")
    joined = placed.join(own, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return joined.select("sequence_id", F.flatten(F.transform("x", lambda e: e["ids"])).alias("ids"))
