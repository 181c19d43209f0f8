"""XLSX workbooks as a Spark data source: read by sheets and ranges of rows, written as one workbook a task with a commit of all."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from itertools import islice

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .containers import SHEET_ROWS, sheet_matrix, sheet_parts, workbook

#: Rows of a sheet that one task gives.
ROWS = 250_000


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a plain path is a local or mounted folder."""
    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _files(path: str) -> tuple[fs.FileSystem, list[str]]:
    files, place = _place(path)
    info = files.get_file_info(place)
    if info.type == fs.FileType.File:
        return files, [place]
    every = files.get_file_info(fs.FileSelector(place, allow_not_found=True))
    return files, sorted(x.path for x in every if x.path.endswith(".xlsx") and not x.base_name.startswith(("_", ".")))


@dataclass
class Rows(InputPartition):
    """Rows first to last (without the title row) of a sheet of a file."""

    file: str
    part: str
    first: int
    last: int


def _size(book: zipfile.ZipFile, part: str) -> int:
    """Rows of a sheet: by what it says of its size at its head, else counted."""
    with book.open(part) as f:
        said = re.search(rb'<dimension ref="[A-Z]+\d+(?::[A-Z]+(\d+))?"', f.read(2000))
    return int(said[1]) if said and said[1] else sum(1 for _ in sheet_matrix(book, part))


def _value(text: str | None, kind: object) -> object:
    """A cell as a value of a column; null if it is none."""
    if text is None or isinstance(kind, StringType):
        return text
    try:
        if isinstance(kind, (LongType, IntegerType)):
            return int(text) if re.fullmatch(r"-?\d+", text) else int(float(text)) if float(text) == int(float(text)) else None
        if isinstance(kind, DoubleType):
            return float(text)
        if isinstance(kind, BooleanType):
            return {"1": True, "0": False, "true": True, "false": False}.get(text.lower())
        if isinstance(kind, DateType):
            return datetime.strptime(text[:10], "%Y-%m-%d").date()
    except (ValueError, OverflowError):
        return None
    raise ValueError(f"columns of a workbook are string, long, int, double, boolean or date, not {kind}")


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.rows = schema, options["path"], int(options.get("rows", ROWS))
        self.wanted = options.get("sheet")

    def partitions(self) -> list[InputPartition]:
        files, paths = _files(self.path)
        out = []
        for path in paths:
            with files.open_input_file(path) as f, zipfile.ZipFile(f) as book:
                for name, part in sheet_parts(book):
                    if self.wanted is None or name == self.wanted or re.fullmatch(re.escape(self.wanted[:26]) + r" \(\d+\)", name):
                        n = _size(book, part) - 1
                        out += [Rows(path, part, at, min(n, at + self.rows)) for at in range(0, n, self.rows)]
        return out

    def read(self, partition: Rows | None) -> Iterator[tuple]:
        if partition is None:  # there are no sheets with rows
            return
        files, _ = _place(self.path)
        with files.open_input_file(partition.file) as f, zipfile.ZipFile(f) as book:
            matrix = sheet_matrix(book, partition.part)
            titles = next(matrix, [])
            at = [titles.index(x.name) if x.name in titles else None for x in self.schema]
            kinds = [x.dataType for x in self.schema]
            for row in islice(matrix, partition.first, partition.last):
                yield tuple(None if k is None or k >= len(row) else _value(row[k], kind) for k, kind in zip(at, kinds, strict=True))


@dataclass
class Written(WriterCommitMessage):
    """A finished workbook under its temporary name."""

    name: str
    rows: int


class Writer(DataSourceWriter):
    """Every task writes a workbook of its rows under a name of its own in a hidden folder; commit() moves them to their places, abort() deletes them.

    A task that runs twice leaves a file that no message names, which goes with the hidden folder.
    """

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.titles, self.path, self.overwrite = schema.names, options["path"], overwrite
        self.sheet, self.most = options.get("sheet", "Rows"), int(options.get("sheet_rows", SHEET_ROWS))
        self.aside = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        files, place = _place(self.path)
        files.create_dir(f"{place}/{self.aside}")
        name, rows = f"{uuid.uuid4().hex}.xlsx", 0
        with files.open_output_stream(f"{place}/{self.aside}/{name}") as out:
            held = _Held(out)
            with Book(held, self.sheet, self.titles, self.most) as book:
                for row in iterator:
                    book.add(row)
                    rows += 1
        return Written(name, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, place = _place(self.path)
        files.create_dir(place)
        old = [x.path for x in files.get_file_info(fs.FileSelector(place)) if x.path.endswith(".xlsx")]
        told = [m for m in messages if m is not None]
        # of many tasks those without rows leave no file, but one stays, for the titles
        full = [m for m in told if m.rows] or told[:1]
        for k, m in enumerate(full):
            files.move(f"{place}/{self.aside}/{m.name}", f"{place}/part-{k:05d}-{m.name}")
        if self.overwrite:
            for path in old:
                files.delete_file(path)
        files.delete_dir(f"{place}/{self.aside}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, place = _place(self.path)
        if files.get_file_info(f"{place}/{self.aside}").type == fs.FileType.Directory:
            files.delete_dir(f"{place}/{self.aside}")


class _Held(io.RawIOBase):
    """A stream that zipfile can write to without seeking."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at


class Book:
    """A workbook that grows row by row: a sheet is written as it comes, and the next one begins when it has `most` rows, titles included."""

    def __init__(self, out, sheet: str, titles: list[str], most: int):
        self.zip, self.sheet, self.titles, self.most = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), sheet, titles, max(2, most)
        self.sheets, self.part, self.left = 0, None, 0

    def __enter__(self) -> Book:
        return self

    def add(self, row) -> None:
        if not self.left:
            self._begin()
        self.part.write(_row(row))
        self.left -= 1

    def _begin(self) -> None:
        self._end()
        self.sheets += 1
        self.part = self.zip.open(zipfile.ZipInfo(f"xl/worksheets/sheet{self.sheets}.xml"), "w", force_zip64=True)
        self.part.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + _row(self.titles))
        self.left = self.most - 1

    def _end(self) -> None:
        if self.part is not None:
            self.part.write(b"</sheetData></worksheet>")
            self.part.close()
            self.part = None

    def __exit__(self, *failed: object) -> None:
        if not failed[0] and not self.sheets:
            self._begin()
        self._end()
        if not failed[0]:
            names = [self.sheet if k == 1 else f"{self.sheet[:26]} ({k})" for k in range(1, self.sheets + 1)]
            # all parts but the sheets, as a workbook of empty sheets has them
            with zipfile.ZipFile(io.BytesIO(workbook([(n, [], []) for n in names]))) as frame:
                for part in frame.namelist():
                    if not part.startswith("xl/worksheets/"):
                        self.zip.writestr(zipfile.ZipInfo(part), frame.read(part))
        self.zip.close()


_ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"} | {chr(c): None for c in range(32) if c not in (9, 10, 13)} | {"￾": None, "￿": None})


def _row(values) -> bytes:
    return ("<row>" + "".join(map(_cell, values)) + "</row>").encode("utf-8", "replace")


def _cell(value: object) -> str:
    if value is None or value != value:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int) and abs(value) < 1 << 53 or isinstance(value, float):
        return f"<c><v>{value!r}</v></c>"
    text = value.isoformat(" ") if isinstance(value, datetime) else value.isoformat() if isinstance(value, date) else str(value)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{text.translate(_ESCAPES)}</t></is></c>'


class LedgerXlsx(DataSource):
    """Format ledger_xlsx. Options: path (a file, or a folder of workbooks), sheet (its name; by default all sheets are read, and Rows is
    written), rows (of a task, reading), sheet_rows (of a sheet, writing).

    Columns are found by title; one without a schema reads the titles of the first file, as text. Numbers that a spreadsheet can't hold exactly, decimals and
    dates are written as text. A sheet that its rows don't fit goes on, under its titles, on sheets named with a number.
    """

    @classmethod
    def name(cls) -> str:
        return "ledger_xlsx"

    def schema(self) -> StructType:
        files, paths = _files(self.options["path"])
        for path in paths:
            with files.open_input_file(path) as f, zipfile.ZipFile(f) as book:
                for name, part in sheet_parts(book):
                    if self.options.get("sheet") in (None, name):
                        return StructType([StructField(t, StringType()) for t in next(sheet_matrix(book, part), []) if t])
        raise ValueError(f"no workbook in {self.options['path']}")

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make spark.read.format("ledger_xlsx") and df.write.format("ledger_xlsx") known to a session."""
    spark.dataSource.register(LedgerXlsx)
