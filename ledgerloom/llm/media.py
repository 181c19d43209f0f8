"""Media columns: signatures by Aho-Corasick, structure by format validators, declared types corrected, embedded media carved."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: The magic bytes of each format.
MAGIC = {"audio/wav": b"RIFF", "image/bmp": b"BM", "image/png": b"\x89PNG\r\n\x1a\n", "image/gif": b"GIF8", "image/jpeg": b"\xff\xd8\xff", "application/zip": b"PK\x03\x04", "application/pdf": b"%PDF-"}
UNIT, HEADER = 192, 44


class Bytes:
    """The bytes that are sniffed, with what the validators look up more than once: places of end markers, each searched for once, and how
    chains of blocks end. So all validators together take linear time, however many magic bytes there are."""

    def __init__(self, data: bytes):
        self.data = data
        self.places: dict[bytes, list[int]] = {}
        self.chains: dict[tuple[str, int], int] = {}

    def next(self, marker: bytes, at: int) -> int:
        """The first place of the marker from `at` on; -1 if there is none."""
        if marker not in self.places:
            self.places[marker] = [m.start() for m in re.finditer(re.escape(marker), self.data)]
        found = self.places[marker]
        k = bisect_left(found, at)
        return found[k] if k < len(found) else -1

    def chain(self, kind: str, at: int, step: Callable[[int], tuple[int, bool]]) -> int:
        """Where the chain of step(place) -> (next place or result, whether it goes on) ends. Every 32nd place is kept: chains that meet
        go on alike."""
        seen, place, on, n = [], at, True, 0
        while on:
            if (kind, place) in self.chains:
                place = self.chains[kind, place]
                break
            if n % 32 == 0:
                seen.append(place)
            place, on = step(place)
            n += 1
        for x in seen:
            self.chains[kind, x] = place
        return place

    @cached_property
    def archives(self) -> dict[int, int]:
        """Start of each archive whose end record says where it begins, and the end of the first such record."""
        found: dict[int, int] = {}
        self.next(b"PK\x05\x06", 0)
        for end in self.places[b"PK\x05\x06"]:
            if end + 22 <= len(self.data):
                size, offset, note = struct.unpack_from("<IIH", self.data, end + 12)
                if end + 22 + note <= len(self.data):
                    found.setdefault(end - offset - size, end + 22 + note)
        return found


def _wav(b: Bytes, at: int) -> int:
    """Bytes of the WAV file at this place; 0 if there is none. Its chunks, the first of them fmt, must fill the declared length."""
    data = b.data
    if len(data) < at + 16 or data[at + 8 : at + 16] != b"WAVEfmt ":
        return 0
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return 0
    place, sound = at + 12, False
    while place + 8 <= end:
        kind, n = struct.unpack_from("<4sI", data, place)
        sound |= kind == b"data"
        place += 8 + n + n % 2
    return end - at if place == end and sound else 0


def _bmp(b: Bytes, at: int) -> int:
    if len(b.data) < at + 26:
        return 0
    size, _, _, offset, header = struct.unpack_from("<IHHII", b.data, at + 2)
    return size if header in (12, 40, 108, 124) and 14 + header <= offset <= size and at + size <= len(b.data) else 0


def _png(b: Bytes, at: int) -> int:
    data = b.data

    def step(place: int) -> tuple[int, bool]:
        if place + 12 > len(data):
            return 0, False
        n, kind = struct.unpack_from(">I4s", data, place)
        if place + 12 + n > len(data) or zlib.crc32(data[place + 4 : place + 8 + n]) != struct.unpack_from(">I", data, place + 8 + n)[0]:
            return 0, False
        return place + 12 + n, kind != b"IEND"

    if data[at + 8 : at + 16] != b"\0\0\0\rIHDR":
        return 0
    return max(0, b.chain("png", at + 8, step) - at)


def _gif(b: Bytes, at: int) -> int:
    data = b.data
    if data[at + 4 : at + 6] not in (b"7a", b"9a") or len(data) < at + 14:
        return 0

    def rows(place: int) -> tuple[int, bool]:  # sub-blocks up to the empty one
        return (place + data[place] + 1, True) if place < len(data) and data[place] else (place + 1, False)

    def block(place: int) -> tuple[int, bool]:
        if place >= len(data):
            return 0, False
        kind = data[place]
        if kind == 0x3B:
            return place + 1, False
        if kind == 0x21:
            return b.chain("gif rows", place + 2, rows), True
        if kind == 0x2C and place + 10 <= len(data):
            local = data[place + 9]
            return b.chain("gif rows", place + 11 + (3 << ((local & 7) + 1) if local & 128 else 0), rows), True
        return 0, False

    flags = data[at + 10]
    return max(0, b.chain("gif", at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0), block) - at)


def _jpeg(b: Bytes, at: int) -> int:
    data = b.data

    def segment(place: int) -> tuple[int, bool]:
        if place + 4 > len(data) or data[place] != 0xFF:
            return 0, False
        after = place + 2 + struct.unpack_from(">H", data, place + 2)[0]
        if data[place + 1] != 0xDA:
            return after, True
        end = b.next(b"\xff\xd9", after)  # coded data up to the end marker
        return (end + 2 if end >= 0 else 0), False

    return max(0, b.chain("jpeg", at + 2, segment) - at)


def _zip(b: Bytes, at: int) -> int:
    """Up to the end record whose directory lies where it says, counted from this place."""
    return max(0, b.archives.get(at, 0) - at)


def _pdf(b: Bytes, at: int) -> int:
    end, start = b.next(b"%%EOF", at), b.next(b"startxref", at)
    return end + 5 - at if 0 <= start and start + 9 <= end else 0


VALID = {"audio/wav": _wav, "image/bmp": _bmp, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "application/zip": _zip, "application/pdf": _pdf}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, magic in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of each valid medium in the bytes, in order of start; what lies inside another one is told too.

    One pass of the automaton finds all magic bytes; those whose format's structure and lengths don't hold are dropped.
    """
    found, b = [], Bytes(data)
    for last, (kind, n) in _automaton().iter(data.decode("latin-1")):
        start = last - n + 1
        if length := VALID[kind](b, start):
            found.append((kind, start, length))
    return sorted(found, key=lambda x: (x[1], -x[2], x[0]))


def typed(data: bytes, declared: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The type of the bytes and the media inside: that of a valid medium at the start, else what was declared."""
    found = sniff(data)
    own = next((k for k, start, length in found if start == 0), declared)
    return own, [x for x in found if x[1] > 0]


def payload(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes with spaces up to a positive multiple of 192, and how many there were before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT or UNIT * (not raw)), len(raw)


def store(data: bytes) -> bytes:
    """The bytes as a WAV file of 8-bit mono samples, 8,000 a second."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", HEADER - 8 + len(data), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(data)) + data


def read_back(stored: bytes) -> tuple[str | None, bytes, list[tuple[str, int, int]]]:
    """The sniffed type of a stored medium, its samples, and the media carved from within them."""
    kind, inside = typed(stored, None)
    if kind != "audio/wav":
        raise ValueError(f"not a stored payload: {kind}")
    place = 12
    while stored[place : place + 4] != b"data":
        place += 8 + struct.unpack_from("<I", stored, place + 4)[0]
    n = struct.unpack_from("<I", stored, place + 4)[0]
    return kind, stored[place + 8 : place + 8 + n], inside


def feature(kind: str | None, samples: bytes, inside: list[tuple[str, int, int]]) -> str:
    """Type, samples, mean level and mean absolute step of the samples in thousandths, and the types carved from within."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    level, step = int(x.sum()) * 1000 // len(x), int(np.abs(np.diff(x)).sum()) * 1000 // max(1, len(x) - 1)
    return f"{kind};samples={len(x)};level={level};step={step};inside={'+'.join(k for k, _, _ in inside)}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 128):
        made = [payload(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([store(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the WAV file) for each row of docs; a null text counts as empty.

    Repeated rows stay repeated, a null doc_id stays null, an empty table gives no rows, other columns are ignored.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 128):
        rows = []
        for stored in batch.column(2).to_pylist():
            kind, samples, inside = read_back(stored)
            rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(kind, samples, inside)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of what the media of to_media() hold, from the stored bytes.

    Repeated rows stay repeated and read alike, a null doc_id stays null, an empty table gives no rows, other columns are ignored;
    bytes that are no stored payload are an error.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _sniffed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("data", pa.binary())]))
    for batch in slices(batches, 64):
        found = [typed(d or b"", t) for d, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        inside = [[{"type": k, "start": a, "length": n, "data": d[a : a + n]} for k, a, n in x] for (_, x), d in zip(found, batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([k for k, _ in found], pa.string()), pa.array(inside, kind)], ["id", "declared", "type", "inside"])


def sniff_types(media: DataFrame, id_col: str, data_col: str, declared_col: str) -> DataFrame:
    """id, declared, type, inside (type, start, length, data of each embedded medium) for any table with a binary column.

    A null or empty content keeps its declared type and holds nothing; so does content that is no valid medium.
    """
    return media.select(F.col(id_col).cast("string").alias("id"), F.col(data_col).alias("data"), F.col(declared_col).cast("string").alias("declared")).mapInArrow(_sniffed, "id string, declared string, type string, inside array<struct<type:string,start:long,length:long,data:binary>>")
