"""Report tables: sections, covers, previews, sheet names, pack summaries."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import try_date
from ..sources.staging import staged

#: Rows of report sheets that one task sorts and numbers.
SLICE = 250_000

#: Titles of the report columns, and what marks rows.
PURCHASES = {"Supplier": "supplier_name", "Supplier GSTIN": "supplier_gstin", "Invoice no": "invoice_number", "Date": "invoice_date", "Taxable": "taxable_value", "Tax": "tax", "Invoice value": "invoice_value", "HSN": "hsn", "Flags": "flags", "Source": "source"}
SALES = {"Party": "supplier_name", "Party GSTIN": "supplier_gstin"} | {k: v for k, v in PURCHASES.items() if not k.startswith("Supplier")}
BOOKS = {"Type": "voucher_type", "Number": "voucher_number", "Date": "date", "Party": "party_name", "GSTIN": "gstin", "Amount": "amount", "Invoice no": "invoice_number", "Invoice value": "invoice_value", "Flags": "flags", "Source": "source"}
RETURN = {"GSTIN": "gstin", "Trade name": "trade_name", "Invoice no": "invoice_number", "Date": "invoice_date", "Value": "invoice_value", "Taxable": "taxable", "IGST": "igst", "CGST": "cgst", "SGST": "sgst", "Cess": "cess", "ITC": "itc_availability", "Type": "document_type", "Flags": "flags", "Source": "source", "Match": "match_status", "Books ref": "books_ref"}
SUMMARY = {"Section": "section", "Taxable": "taxable", "IGST": "igst", "CGST": "cgst", "SGST": "sgst", "Cess": "cess", "Source": "source"}
HSN = {"HSN": "hsn", "Taxable": "taxable", "IGST": "igst", "CGST": "cgst", "SGST": "sgst", "Cess": "cess", "Flags": "flags", "Source": "source"}
BANK = {"Date": "date", "Description": "description", "Cheque / Ref": "cheque_ref", "Debit": "debit", "Credit": "credit", "Balance": "balance", "Source": "source", "Flags": "flags"}
CHECKS = {"File": "name", "Bank": "account_name", "Sheet": "sheet", "Account no": "account_number", "IFSC": "ifsc", "Rows": "row_count", "Opening": "opening_balance", "Stated close": "stated_closing", "Computed close": "computed_closing", "Result": "result", "Broken at": "broken_at_row", "Flags": "flags"}
GRID = {"GSTIN": "k_gstin", "Invoice no": "k_invoice", "Date": "k_date", "Books value": "books_value", "2B value": "portal_value", "Gap": "gap", "Status": "status"}
NO_ROWS, NONE, MATCH_NOTE = "No rows extracted", "none", "Match columns are empty until reconciliation."
NOTES = ("CDN", "CDNR", "CDNA", "CDNRA")
RED = ("gstin_checksum", "hsn_length", "invoice_math")


def project(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows under report titles; arrays as text with commas, columns that rows lack as null."""
    kinds = dict(rows.dtypes)
    cell = lambda c: F.lit(None).cast("string") if c not in kinds else F.array_join(c, ", ") if kinds[c] == "array<string>" else F.col(c)
    return rows.select(*[cell(c).alias(title) for title, c in columns.items()])


def is_note(row_type: Column) -> Column:
    return F.upper(F.trim(F.coalesce(row_type, F.lit("")))).isin(*NOTES)


def is_hsn(row_type: Column, trade_name: Column, source: Column) -> Column:
    return (F.upper(F.trim(F.coalesce(row_type, F.lit("")))) == "HSN") | (F.lower(F.trim(F.coalesce(trade_name, F.lit("")))) == "hsn summary") | F.lower(F.coalesce(source, F.lit(""))).contains("#hsn")


def is_flagged(flags: Column) -> Column:
    return F.exists(F.coalesce(flags, F.array().cast("array<string>")), lambda x: F.trim(x) != "")


def is_red(flags: Column) -> Column:
    """Whether a report paints the row."""
    return F.arrays_overlap(F.coalesce(flags, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in RED]))


def sections(rows: DataFrame) -> DataFrame:
    """A row for each sheet that a return row stands on: hsn, cdn or b2b, and flagged besides. One pass; the sheets overlap."""
    kind = F.when(is_hsn(F.col("document_type"), F.col("trade_name"), F.col("source")), "hsn").when(is_note(F.col("document_type")), "cdn").otherwise("b2b")
    sheets = F.concat(F.array(kind), F.when(is_flagged(F.col("flags")), F.array(F.lit("flagged"))).otherwise(F.array().cast("array<string>")))
    return rows.withColumn("section", F.explode(sheets))


def cover(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of a return's cover per group: b2b_rows, cdn_rows, hsn_rows, flagged_rows, total_rows."""
    hsn, note = is_hsn(F.col("document_type"), F.col("trade_name"), F.col("source")), is_note(F.col("document_type"))
    return rows.groupBy(*by).agg(F.count_if(~hsn & ~note).alias("b2b_rows"), F.count_if(~hsn & note).alias("cdn_rows"), F.count_if(hsn).alias("hsn_rows"), F.count_if(is_flagged(F.col("flags"))).alias("flagged_rows"), F.count("*").alias("total_rows"))


def preview(rows: DataFrame, by: list[str], order: list[str], k: int = 8) -> DataFrame:
    """The first k rows of each group, and the last k of groups with more than 2k, with row_count.

    Head and tail are two ranked plans, as a pure rank limit is pushed below the shuffle: of each group at most k rows leave a task.
    The order must be total.
    """
    ranked = lambda w: rows.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k).drop("__rank")
    up = Window.partitionBy(*by).orderBy(*order)
    down = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    counts = rows.groupBy(*by).agg(F.count("*").alias("row_count"))
    head, tail = ranked(up).join(counts, by), ranked(down).join(counts.where(F.col("row_count") > 2 * k), by)
    return head.unionByName(tail)


def sheet_names(files: DataFrame) -> DataFrame:
    """files (pack_id, file_id, name) with sheet: the cleaned stem, at most 28 characters, later files of a pack with the same one numbered."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    clean = F.trim(F.substring(F.regexp_replace(stem, r"[\[\]*?:/\\]", " "), 1, 28))
    df = files.withColumn("__clean", F.when(clean == "", "Transactions").otherwise(clean))
    nth = F.row_number().over(Window.partitionBy("pack_id", "__clean").orderBy("file_id"))
    return df.withColumn("sheet", F.when(nth == 1, F.col("__clean")).otherwise(F.concat(F.substring("__clean", 1, 26), F.lit("_"), nth.cast("string")))).drop("__clean")


def bank_status(summary: DataFrame, by: list[str]) -> DataFrame:
    """Balance status of a pack: match if all its files match; with files and rows."""
    return summary.groupBy(*by).agg(F.when(F.bool_and("match"), "match").otherwise("mismatch").alias("balance_status"), F.count("*").alias("files"), F.sum("row_count").alias("total_rows"))


def pack_summary(outputs: DataFrame, by: list[str]) -> DataFrame:
    """outputs (key, label, rows, status) of each pack as one JSON text, with their total."""
    item = F.struct("key", "label", "rows", "status")
    each = outputs.groupBy(*by).agg(F.sum("rows").alias("total_rows"), F.array_sort(F.collect_list(item)).alias("outputs"))
    return each.select(*by, "total_rows", F.to_json(F.struct("outputs", "total_rows")).alias("summary"))


def pack_totals(outputs: DataFrame, levels: list[str]) -> DataFrame:
    """outputs (the columns of levels, rows, status) summed for each level and all above it, in one pass: level, the columns, packs, outputs, rows, ready.

    levels go from the widest to the narrowest, say firm, client, period; level names the last one that a row is about, or all. A column that is null in a
    row's own level is a value of the data; grouping ids tell it from one that is summed over. packs counts the different narrowest groups.
    """
    each = outputs.groupBy(*levels).agg(F.count("*").alias("o"), F.sum("rows").alias("r"), F.count_if(F.col("status") == "ready").alias("y"))
    totals = each.rollup(*levels).agg(F.grouping_id(*levels).alias("id"), F.count("*").alias("packs"), F.sum("o").alias("outputs"), F.sum("r").alias("rows"), F.sum("y").alias("ready"))
    level = F.lit("all")
    for depth, name in enumerate(levels, 1):
        level = F.when(F.col("id") == (1 << (len(levels) - depth)) - 1, name).otherwise(level)
    return totals.select(level.alias("level"), *levels, "packs", "outputs", "rows", "ready")


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group in a total order; folded with max_by, so no group is sorted."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*by, "__row.*")


def first_seen(paths: DataFrame, path: str, order: list[str]) -> DataFrame:
    """One row for each path compared in lower case: the first in a total order."""
    key = F.lower(path).alias("__key")
    return paths.groupBy(key).agg(F.min_by(F.struct(*paths.columns), F.struct(*order)).alias("__row")).select("__row.*")


def _cells(rows: DataFrame, columns: dict[str, str]) -> Column:
    """The columns of a report as an array of text, amounts with two decimals."""
    kinds = dict(rows.dtypes)

    def cell(c: str) -> Column:
        if c not in kinds:
            return F.lit(None).cast("string")
        if kinds[c] == "array<string>":
            return F.array_join(c, ", ")
        return F.format_string("%.2f", F.col(c).cast("double")) if kinds[c] == "double" or kinds[c].startswith("decimal") else F.col(c).cast("string")

    # format_string writes a null as text
    return F.array(*[F.when(F.col(c).isNotNull(), cell(c)) if c in kinds else cell(c) for c in columns.values()])


def _numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with row_no, from 1 in each group of `by` by `order`; no task has more than a slice, however large a group is.

    Rows are cut into ranges of all groups one after the other and sorted there. What a range holds of a group are neighbours, so a row's number is its
    place among them and the number of the group's rows in the ranges before, which are counted for each range and group.
    """
    ranges = max(1, math.ceil(rows.count() / SLICE))
    placed = staged(rows.repartitionByRange(ranges, *by, *order).sortWithinPartitions(*by, *order).withColumn("__at", F.monotonically_increasing_id()))
    # the upper bits of the place are the range's number
    piece = F.shiftright("__at", 33)
    counts = placed.groupBy(*[F.col(c).alias(f"__{c}") for c in by], piece.alias("__piece")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*[f"__{c}" for c in by]).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], piece == F.col("__piece"))
    return placed.join(starts, same).withColumn("row_no", (F.col("__at") + F.col("__start")).cast("int")).select(*rows.columns, "row_no")


def _sheets(rows: DataFrame, sheets: dict[int, tuple[str, dict[str, str]]]) -> DataFrame:
    """pack_id, sheet_no, sheet, titles, row_no, cells of numbered rows, by the name and columns of each sheet's number."""
    by = lambda value: F.coalesce(*[F.when(F.col("sheet_no") == n, value(*sheet)) for n, sheet in sheets.items()])
    return rows.select("pack_id", "sheet_no", by(lambda name, _: F.lit(name)).alias("sheet"), by(lambda _, columns: F.array(*[F.lit(t) for t in columns])).alias("titles"), "row_no", by(lambda _, columns: _cells(rows, columns)).alias("cells"))


def _needed(rows: DataFrame, *columns: str) -> list[str]:
    return [c for c in dict.fromkeys(("pack_id", *columns)) if c in rows.columns]


def _sheet(rows: DataFrame, number: int, sheet: str, columns: dict[str, str], order: list[str]) -> DataFrame:
    """pack_id, sheet_no, sheet, titles, row_no, cells of the rows of one sheet in each pack."""
    own = staged(rows.select(*_needed(rows, *columns.values(), *order)))
    return _sheets(_numbered(own, ["pack_id"], order).withColumn("sheet_no", F.lit(number)), {number: (sheet, columns)})


def _placeholder(packs: DataFrame, rows: DataFrame, number: int, name: str, columns: dict[str, str], text: str) -> DataFrame:
    """One row with a text for each pack without rows (numbered ones, of sheet_no) on a sheet."""
    empty = packs.join(rows.where(F.col("sheet_no") == number).select("pack_id").distinct(), "pack_id", "left_anti")
    return empty.select("pack_id", F.lit(number).alias("sheet_no"), F.lit(name).alias("sheet"), F.array(*[F.lit(t) for t in columns]).alias("titles"), F.lit(1).alias("row_no"), F.array(F.lit(text)).alias("cells"))


def cover_facts(packs: DataFrame, rows: DataFrame) -> DataFrame:
    """packs (pack_id, filer_gstin, period) with source: the file that a pack's first row (by source) comes from."""
    first = rows.groupBy("pack_id").agg(F.min("source").alias("first"))
    return packs.join(first, "pack_id", "left").select("pack_id", "filer_gstin", "period", F.nullif(F.substring_index("first", "#", 1), F.lit("")).alias("source"))


def return_pack(packs: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """Rows of the workbooks of a return, for workbooks(): a cover, its sheets, flagged rows.

    packs: pack_id, filer_gstin, period; rows: pack_id and the columns of the return's rows; kind: gstr_1, gstr_2b or gstr_3b. The outward
    return's notes stand among its invoices, its HSN summary on a sheet of its own; the inward return's notes on one of theirs. A
    sheet that every such workbook has says so where it is empty. Sorting and numbering is by pack and sheet.
    """
    title = {"gstr_1": "GSTR-1", "gstr_2b": "GSTR-2B", "gstr_3b": "GSTR-3B"}[kind]
    order = ["source"]
    rows = staged(rows.select(*_needed(rows, *RETURN.values(), *SUMMARY.values(), *HSN.values())))
    if kind == "gstr_3b":
        counted = rows.groupBy("pack_id").agg(F.count("*").alias("n0"))
        counts = [("Summary rows", "n0")]
        layout, empty = {2: ("Summary", SUMMARY)}, {2: NO_ROWS}
        shown = rows.withColumn("sheet_no", F.lit(2))
    else:
        hsn, note = is_hsn(F.col("document_type"), F.col("trade_name"), F.col("source")), is_note(F.col("document_type"))
        apart, sheet, columns = (hsn, "HSN", HSN) if kind == "gstr_1" else (note, "CDN", RETURN)
        flagged = is_flagged(F.col("flags"))
        counted = rows.groupBy("pack_id").agg(F.count_if(~apart).alias("n0"), F.count_if(apart).alias("n1"), F.count_if(flagged).alias("n2"), F.count("*").alias("n3"))
        counts = [("B2B rows", "n0"), (f"{sheet} rows", "n1"), ("Flagged rows", "n2"), ("Total rows", "n3")]
        layout, empty = {2: ("B2B", RETURN), 3: (sheet, columns), 4: ("Flags", RETURN)}, {2: NO_ROWS, 4: NONE}
        places = F.array_compact(F.array(F.when(apart, 3).otherwise(2), F.when(flagged, 4)))
        shown = rows.withColumns({"document_type": F.upper(F.coalesce(F.nullif(F.trim("document_type"), F.lit("")), F.when(apart, sheet).otherwise("B2B"))), "hsn": F.coalesce(F.nullif("hsn", F.lit("")), F.col("invoice_number")), "sheet_no": F.explode(places)})
    numbered = _numbered(shown, ["pack_id", "sheet_no"], order)
    sheets = _sheets(numbered, layout)
    for number, text in empty.items():
        sheets = sheets.unionByName(_placeholder(packs, numbered, number, *layout[number], text))
    facts = cover_facts(packs, rows).join(counted, "pack_id", "left")
    line = lambda a, b=None: F.array(F.lit(a).cast("string"), (F.lit(None) if b is None else b).cast("string"))
    lines = [line("GSTIN", F.col("filer_gstin")), line("Period", F.col("period")), line("Source", F.col("source")), *[line(t, F.coalesce(c, F.lit(0))) for t, c in counts]]
    if kind != "gstr_3b":
        lines.append(line(MATCH_NOTE))
    cover = facts.select("pack_id", F.lit(1).alias("sheet_no"), F.lit("Cover").alias("sheet"), F.array(F.lit(title)).alias("titles"), F.posexplode(F.array(*lines)).alias("row_no", "cells"))
    return cover.withColumn("row_no", F.col("row_no") + 1).unionByName(sheets)


def register_pack(rows: DataFrame, sheet: str, columns: dict[str, str]) -> DataFrame:
    """Rows of the workbooks of a register, for workbooks(): one sheet of rows (pack_id and the register's columns) in the order of their sources."""
    return _sheet(rows, 1, sheet, columns, ["source", "invoice_number", "invoice_value"])


def grid_pack(rows: DataFrame) -> DataFrame:
    """Rows of the workbook of the master reconciliation grid, for workbooks(): rows are pack_id and those of recon.reconcile()."""
    return _sheet(rows, 1, "Master_Reconciliation_Grid", GRID, ["k_gstin", "k_invoice", "k_date"])


def bank_pack(files: DataFrame, rows: DataFrame, checks: DataFrame) -> DataFrame:
    """Rows of the bank workbooks, for workbooks(): the balance check of each file, and a sheet for each file.

    files: pack_id, file_id, name, account_name, account_number, ifsc; rows: file_id, row_no and a transaction's columns; checks:
    balance_summary(). A pack of one file calls its sheet Transactions; a file without rows has a sheet that says so.
    """
    alone = files.groupBy("pack_id").agg(F.count("*").alias("files"))
    named = sheet_names(files).join(alone, "pack_id").withColumn("sheet", F.when(F.col("files") == 1, "Transactions").otherwise(F.col("sheet")))
    nth = F.row_number().over(Window.partitionBy("pack_id").orderBy("file_id"))
    named = named.withColumn("sheet_no", nth + 1)
    told = named.join(checks, "file_id", "left").withColumn("result", F.when(F.col("match"), "MATCH").otherwise("MISMATCH"))
    told = told.withColumns({"sheet_no": F.lit(1), "row_no": F.row_number().over(Window.partitionBy("pack_id").orderBy("file_id"))})
    cover = _sheets(told, {1: ("Balance Check", CHECKS)})
    own = rows.join(named.select("pack_id", "file_id", F.col("sheet").alias("title"), F.col("sheet_no").alias("place")), "file_id")
    # dates are shown as the report has them, text that is none stays
    own = own.withColumn("date", F.coalesce(F.date_format(try_date("date"), "dd-MM-yyyy"), F.col("date")))
    sheets = own.select("pack_id", F.col("place").alias("sheet_no"), F.col("title").alias("sheet"), F.array(*[F.lit(t) for t in BANK]).alias("titles"), F.row_number().over(Window.partitionBy("pack_id", "file_id").orderBy("row_no")).alias("row_no"), _cells(own, BANK).alias("cells"))
    empty = named.join(rows.select("file_id").distinct(), "file_id", "left_anti").select("pack_id", "sheet_no", "sheet", F.array(*[F.lit(t) for t in BANK]).alias("titles"), F.lit(1).alias("row_no"), F.array(F.lit(NO_ROWS)).alias("cells"))
    return cover.unionByName(sheets).unionByName(empty)
