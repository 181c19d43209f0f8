"""Exact duplicates by recipes: texts are cut where their content says so, equal chunks share a verified identifier, lists of identifiers are compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

#: Bytes of a chunk: at least, at most; a boundary needs so many zero bits of the rolling hash, which gives 2 KB on top of the least on average.
LEAST, MOST, BITS = 1024, 16384, 11
#: Bytes of an identifier. A clash of two contents, which verification finds, doubles it.
WIDTH = 16
#: A group is large if it has more than one in so many of all rows; bytes of the list of one that is sent to all tasks (of longer texts few are alike).
HOT, HOT_BYTES = 1024, 1 << 14
#: Bytes that the rolling hash sees, and bytes hashed at once.
WINDOW, BLOCK = 32, 1 << 20
_GEAR = np.random.default_rng(12).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)


def marks(data: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Ascending positions after which the last WINDOW bytes ask for a cut: the gear hash, by doubling its window five times."""
    found = []
    for at in range(0, len(data), BLOCK):
        begin = max(0, at - WINDOW + 1)
        h = _GEAR[data[begin : at + BLOCK]]
        for k in (1, 2, 4, 8, 16):
            h[k:] += h[:-k] << np.uint32(k)
        ends = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + begin + 1
        found.append(ends[ends > at])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts(starts: np.ndarray, data: np.ndarray, least: int = LEAST, most: int = MOST, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Chunk boundaries of the texts that lie one after the other in data (starts: where, with the end), and the number of each text's chunks.

    A text's chunks depend on its own bytes alone, as the least size covers the window. Empty texts have none.
    """
    ends, edges, counts = marks(data[: starts[-1]], bits) if (np.diff(starts) > least).any() else np.zeros(0, np.int64), [starts[:1]], np.zeros(len(starts) - 1, np.int64)
    for i, (begin, end) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        own = []
        while begin < end:
            if end - begin > least:
                k = np.searchsorted(ends, begin + least)
                begin = min(end, begin + most, int(ends[k]) if k < len(ends) else end)
            else:
                begin = end
            own.append(begin)
        counts[i] = len(own)
        edges.append(np.array(own, np.int64))
    return np.concatenate(edges), counts


def _name(piece: memoryview, width: int) -> bytes:
    return b"".join(xxhash.xxh3_128_digest(piece, seed) for seed in range(-(-width // 16)))[:width]


def _cut(column: pa.Array) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """The bytes of a binary column, chunk boundaries in them, chunks of each row."""
    column = column.cast(pa.large_binary())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = memoryview(column.buffers()[2] or b"")[starts[0] : starts[-1]]
    return raw, *cuts(starts - starts[0], np.frombuffer(raw, np.uint8))


def _recipes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            raw, edges, counts = _cut(batch.column(0))
            names = b"".join(_name(raw[a:b], width) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            at = np.concatenate([[0], np.cumsum(counts)]) * width
            lists = pa.array([names[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], [*batch.schema.names[1:], "recipe"])

    return run


def _pieces(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            raw, edges, _ = _cut(batch.column(0))
            names = [_name(raw[a:b], width) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            pieces = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pieces], ["id", "piece"])

    return run


def chunks(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """id, piece: the different chunks of texts.text (binary), each once. Copies are folded in each task before anything is sent."""
    return texts.select("text").mapInArrow(_pieces(width), "id binary, piece binary").distinct()


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Column | None = None, width: int = WIDTH) -> DataFrame:
    """doc_id, row (a number that tells rows apart), text_sha256, recipe (identifiers of the text's chunks in order, joined) of each row of docs.

    normal: the text that is compared, a column of docs; by default the text as it is. Null counts as empty and has an empty recipe. All
    chunks are compared by content before their identifiers are trusted: if two contents share one, identifiers of twice the width are made, until none do.
    """
    text = F.coalesce((F.col(text_col) if normal is None else normal).cast("string"), F.lit("")).cast("binary")
    own = docs.select(text.alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    shown = own.select("text", "doc_id", F.monotonically_increasing_id().alias("row"), F.sha2("text", 256).alias("text_sha256"))
    while not chunks(own, width).groupBy("id").count().where("count > 1").isEmpty():
        width *= 2
    return materialize(shown.mapInArrow(_recipes(width), "doc_id long, row long, text_sha256 string, recipe binary"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Column | None = None, width: int = WIDTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs: of equal texts the row with the largest id stays.

    Texts move once, as chunks folded in each task, to verify identifiers; what is grouped and joined are lists of identifiers, under one percent of
    the texts. Groups are folded by combining aggregates; the facts of the few that hold a large share of all rows are sent to all tasks, of which there
    are fewer than HOT, of HOT_BYTES each at most, and all others meet theirs by a join without a hot key. Of rows that repeat the largest id one stays; rows without an id come last, and are kept by number if a group has no others.
    Other columns are ignored; an empty table gives no rows.
    """
    own = recipes(docs, id_col, text_col, normal, width)
    facts = own.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    facts = materialize(facts.select("recipe", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size"))
    rows = facts.agg(F.sum("group_size")).first()[0] or 0
    # groups with more than a part in HOT of all rows, fewer than HOT, are told to all tasks; the rest has no hot key
    hot = facts.where((F.col("group_size") > rows / HOT) & (F.octet_length("recipe") <= HOT_BYTES))
    told = own.join(F.broadcast(hot), "recipe", "left")
    rest = told.where("group_size is null").select(*own.columns).join(facts, "recipe")
    both = told.where("group_size is not null").unionByName(rest)
    return both.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
