"""Byte-level BPE: chunks are pre-tokenised with an overlap, stitched where their boundaries agree, then encoded by piece."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

RANKS, PATTERN = "byte_bpe_50k.tiktoken", public_tokenizers.PATTERN
#: Characters of a chunk, and of it those that it shares with the next one.
CHUNK, OVERLAP = 1 << 12, 1 << 8
#: Characters from which a text's chunks are dealt over all tasks; those of a shorter one are worked on where it is.
DEALT = 1 << 20
#: Characters after a piece that can change how the pattern ends it.
AHEAD = 3
#: Pieces whose ids a task keeps.
KEPT = 150_000


class _Joined:
    """Strings end to end, to join many of them by number in one gather."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.fromiter(map(len, strings), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def join(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The strings of ids joined, for each part of ids that ends before one of the given places."""
        sizes = self.sizes[ids]
        behind = np.cumsum(sizes)
        data = self.flat[np.repeat(self.starts[ids] - (behind - sizes), sizes) + np.arange(behind[-1] if len(ids) else 0)].tobytes()
        cuts = np.concatenate([[0], np.concatenate([[0], behind])[ends]]).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Codec(dict):
    """Piece to its ids, kept for frequent pieces; the vocabulary is read once per Python worker."""

    def __init__(self, ranks_path: str, pattern: str):
        super().__init__()
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.table = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.table[i] = raw
        self.raw, self.decimal = _Joined(self.table), _Joined([f"{i} ".encode() for i in range(len(self.table))])
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= KEPT:
            self.clear()
        ids = tuple(self.library._encode_single_piece(piece))
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, pieces)))

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        """The ids of a text: its chunks are pre-tokenised, stitched, and the pieces encoded."""
        return self.encode_pieces(self.stitched([(at, part, self.ends(part)) for at, part in chunks_of(text, chunk, overlap)]))

    def ends(self, text: str) -> np.ndarray:
        """Where the pieces of a text end."""
        return np.cumsum(np.fromiter(map(len, self.pattern.findall(text)), np.int64))

    def stitched(self, chunks: list[tuple[int, str, np.ndarray]]) -> list[str]:
        """The pieces of a text from its overlapping chunks: (place of the chunk, its text, where its pieces end).

        A piece of a chunk counts if the pattern could not see the chunk's end from it. From the first place after which
        two neighbours agree, the later one holds, as the pattern looks only ahead. Where they agree nowhere (one piece fills the
        overlap), the text is cut again from the last sure place, with as much more of it as there was, so a very long piece takes
        linear time.
        """
        pieces: list[str] = []
        start, text, ends = chunks[0]
        at, following = start, 1

        def take(cut: np.ndarray) -> None:
            nonlocal at
            own = cut[cut + start > at].tolist()
            pieces.extend(text[a:b] for a, b in zip([at - start, *own], own, strict=False))
            at = start + own[-1] if own else at

        while following < len(chunks):
            sure = ends[ends + AHEAD <= len(text)]
            place, _, more_ends = chunks[following]
            both = np.intersect1d(sure + start, np.append(more_ends + place, place), assume_unique=True)
            both = both[both >= max(place, at)]
            take(sure[sure + start <= both[0]] if len(both) else sure)
            if len(both):
                start, text, ends = chunks[following]
                following += 1
                continue
            grown, reach = [text[at - start :]], start + len(text)
            wanted = at + 2 * len(grown[0])
            while following < len(chunks) and (reach < wanted or len(grown) == 1):
                place, more, _ = chunks[following]
                grown.append(more[reach - place :])
                reach, following = place + len(more), following + 1
            start, text = at, "".join(grown)
            ends = self.ends(text)
        take(ends)
        return pieces


def chunks_of(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(place, text) of the overlapping chunks of a text; an empty one has one empty chunk."""
    for at in range(0, max(1, len(text) - overlap), chunk - overlap):
        yield at, text[at : at + chunk]


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str = PATTERN) -> Codec:
    return Codec(ranks_path, pattern)


def _whole(path: str, pattern: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in slices(batches, 256):
            ids = [np.array(c.encode(t, chunk, overlap), np.int32) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))], ["doc_id", "ids"])

    return run


def _chunked(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                every = chunks_of(text, chunk, overlap)
                while part := list(islice(every, 256)):
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc_id, "at": at, "text": own} for at, own in part], pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("text", pa.string())]))

    return run


def _pretokenised(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in slices(batches, 16):
            ends = [c.ends(t).tolist() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int32()))], ["row", "doc_id", "at", "text", "ends"])

    return run


def _joined(path: str, pattern: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        c = codec(path, pattern)
        group = group.sort_values("at")
        pieces = c.stitched([(int(a), t, np.asarray(e, np.int64)) for a, t, e in zip(group["at"], group["text"], group["ends"], strict=True)])
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[:1].to_numpy(), "ids": [np.array(c.encode_pieces(pieces), np.int32)]})

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP, dealt: int = DEALT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids for each row of docs: the ids of its whole text, as the tiktoken library gives them without special tokens.

    Every text is cut into overlapping chunks, which are pre-tokenised, stitched and encoded by piece. Texts of more than `dealt` characters
    have their chunks dealt over all tasks for the first step; one task per text then stitches and encodes them. A null text
    counts as empty and has no ids. Repeated rows stay repeated, a null doc_id stays null, an empty table gives no rows, other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    short = source.where(F.length("text") <= dealt).mapInArrow(_whole(ranks_path, pattern, chunk, overlap), "doc_id long, ids array<int>")
    long = source.where(F.length("text") > dealt).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = long.mapInArrow(_chunked(chunk, overlap), "row long, doc_id long, at long, text string").repartition("row", "at")
    ended = parts.mapInArrow(_pretokenised(ranks_path, pattern), "row long, doc_id long, at long, text string, ends array<int>")
    return short.unionByName(ended.groupBy("row").applyInPandas(_joined(ranks_path, pattern), "doc_id long, ids array<int>"))


def _decoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in slices(batches, 256):
            column = batch.column(1)
            ids, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
            out = [pa.array(c.raw.join(ids, ends), pa.binary()), pa.array([x[:-1].decode() for x in c.decimal.join(ids, ends)], pa.string()), column.value_lengths().cast(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["doc_id", "raw", "decimal", "n_tokens"])

    return run


def decode(encoded: DataFrame, ranks_path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, raw (the bytes that the ids stand for), decimal (the ids with one space between), n_tokens for each row of encode().

    No ids give no bytes and an empty decimal. Repeated rows stay repeated, a null doc_id stays null, an empty table gives no rows.
    """
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(ranks_path, pattern), "doc_id long, raw binary, decimal string, n_tokens long")
