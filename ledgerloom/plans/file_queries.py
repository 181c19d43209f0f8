"""Queries of files, containers and classification, each with the SQL that gives the same rows."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, identifiers, text
from ..operators import bank, books, classify
from ..sources import containers, files
from ..streaming.ingest import overwrite_partitions
from .queries import paise_text, query, shared_place
from .views import table


def pick(key: Column, *values: Column | str | None) -> Column:
    """The value at the key's remainder by their number."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(key % len(values) == i, F.lit(v).cast("string") if v is None or isinstance(v, str) else v).otherwise(out)
    return out


@query("SELECT page_id, CASE page_id % 5 WHEN 3 THEN '/d/x.pdf' ELSE '/d/a.b/' || page_id || '.json' END AS path FROM pages WHERE page_id % 5 >= 3")
def visible_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not hidden, nor below a hidden folder or one that archives leave behind."""
    k = F.col("page_id")
    path = pick(k, F.concat(F.lit("/d/.git/"), k.cast("string")), "/d/__MACOSX/a.json", "/d/.hidden", "/d/x.pdf", F.concat(F.lit("/d/a.b/"), k.cast("string"), F.lit(".json")))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).where(files.visible(F.col("path")))


NAMED = "n AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'Inv é ' || o_orderkey || '.PDF' WHEN 1 THEN '_.a b(' || o_orderkey || ').csv' WHEN 2 THEN 'x' || o_orderkey || '.zip' ELSE repeat('long', 40) || o_orderkey || '.json' END AS name FROM orders)"


@query(f"""WITH {NAMED} SELECT '/lib/' || k || '/' || name AS path, name, CASE k % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.csv' WHEN 2 THEN '.zip' ELSE '.json' END AS suffix, CASE k % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/csv' WHEN 2 THEN 'application/zip' ELSE 'application/json' END AS mime,
CASE WHEN k % 9 = 0 THEN 'oversize' ELSE 'ok' END AS size_status, left(sha256('/lib/' || k || '/' || name), 8) || '_' || substr(trim(regexp_replace(name, '[^A-Za-z0-9_.\\-]+', '_', 'g'), '._'), 1, 120) AS stored_name FROM n""")
def library_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as the library keeps them: type, size status and a safe name; too large ones stay listed."""
    k = F.col("o_orderkey")
    name = pick(k, F.concat(F.lit("Inv é "), k.cast("string"), F.lit(".PDF")), F.concat(F.lit("_.a b("), k.cast("string"), F.lit(").csv")), F.concat(F.lit("x"), k.cast("string"), F.lit(".zip")), F.concat(F.lit("long" * 40), k.cast("string"), F.lit(".json")))
    length = F.when(k % 9 == 0, files.LARGEST + 1).otherwise(files.LARGEST).cast("long")
    paths = table(spark, sf_dir, "orders").select(F.concat(F.lit("/lib/"), k.cast("string"), F.lit("/"), name).alias("path"), length.alias("length"))
    return files.listing(paths).select("path", "name", "suffix", "mime", "size_status", "stored_name")


def _zips(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Archives of two exports and one other member; every thirteenth is broken."""
    for frame in frames:
        out = []
        for k, body in zip(frame["file_id"], frame["body"], strict=True):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                z.writestr("in/a.xml", body.replace("@", "A"))
                z.writestr("b.TXT", body.replace("@", "B"))
                z.writestr("c.bin", b"\0\1")
            out.append(held.getvalue() if k % 13 else b"PK broken")
        yield pd.DataFrame({"file_id": frame["file_id"], "content": out})


@query("""WITH m AS (SELECT o_orderkey AS file_id, unnest(['A', 'B']) AS m, floor(o_totalprice * 100 + 0.5)::BIGINT AS p FROM orders WHERE o_orderkey % 13 <> 0)
SELECT file_id, 'z.zip:' || CASE m WHEN 'A' THEN 'a.xml' ELSE 'b.TXT' END AS source, CASE WHEN file_id % 2 = 0 THEN 'sales' ELSE 'purchase' END AS register, m || file_id AS voucher_number, p / 100.0::DOUBLE AS invoice_value FROM m""")
def zip_vouchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vouchers of the members of archives; broken archives and other members give none."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit("<E><VOUCHER><VOUCHERTYPENAME>"), F.when(k % 2 == 0, "Sales").otherwise("Purchase"), F.lit("</VOUCHERTYPENAME><VOUCHERNUMBER>@"), k.cast("string"), F.lit("</VOUCHERNUMBER><AMOUNT>-"), paise_text(F.floor(F.col("o_totalprice") * 100 + 0.5)), F.lit("</AMOUNT></VOUCHER></E>"))
    # texts are dealt over tasks before they become archives: a table of few row groups has few tasks
    dealt = table(spark, sf_dir, "orders").select(k.alias("file_id"), body.alias("body")).repartition(4 * spark.sparkContext.defaultParallelism, "file_id")
    packed = dealt.mapInPandas(_zips, "file_id long, content binary")
    inside = containers.zip_members(packed).select("file_id", F.concat(F.lit("z.zip:"), "member").alias("source"), "content")
    return books.voucher_rows(containers.voucher_elements(inside)).select("file_id", "source", "register", "voucher_number", "invoice_value")


@query("""WITH o AS (SELECT o_orderkey AS k, floor(o_totalprice * 100 + 0.5)::BIGINT AS p, o_custkey AS c FROM orders)
SELECT k AS file_id, 'sales' AS register, 'A, "' || c || '"' AS supplier_name, 'N' || k AS invoice_number, p / 100.0::DOUBLE AS invoice_value, '' AS flags FROM o WHERE k % 10 <> 0""")
def csv_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV exports: byte order mark, quoted fields, a title that comes twice (the last counts), blank records; no UTF-8 gives none."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit('"A, ""'), F.col("o_custkey").cast("string"), F.lit('"""'))
    body = F.concat(F.lit("﻿Invoice Number,Customer Name,Total, TOTAL \r\nN"), k.cast("string"), F.lit(","), name, F.lit(",1,"), paise_text(F.floor(F.col("o_totalprice") * 100 + 0.5)), F.lit("\r\n,,,\r\n"))
    content = F.when(k % 10 == 0, F.unhex(F.lit("FFFE00"))).otherwise(F.encode(body, "UTF-8"))
    exports = table(spark, sf_dir, "orders").select(k.alias("file_id"), F.lit("z.csv").alias("name"), F.lit(".csv").alias("suffix"), content.alias("content"))
    return books.sheet_rows(containers.sheet_records(exports)).select("file_id", "register", "supplier_name", "invoice_number", "invoice_value", F.array_join("flags", ",").alias("flags"))


def _workbooks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A workbook for each customer, its orders by number; many customers a batch."""
    for frame in frames:
        out = []
        for keys, days, amounts in zip(frame["k"], frame["day"], frame["p"], strict=True):
            rows = [[f"B{k}", d, p / 100] for k, d, p in zip(keys, days, amounts, strict=True)]
            out.append(containers.workbook([("Bills", ["Bill Number", "Bill Date", "Total"], [[None, None, None], *rows]), ("Other", ["Invoice Number"], [["no"]])]))
        yield pd.DataFrame({"file_id": frame["file_id"], "content": out})


@query("SELECT o_custkey AS file_id, 'purchase' AS register, 'B' || o_orderkey AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, floor(o_totalprice * 100 + 0.5)::BIGINT / 100.0::DOUBLE AS invoice_value, '' AS flags FROM orders")
def sheet_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks with typed dates, one for each customer: the first sheet's records, dates as ISO text."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("p"))
    # rows are few bytes and workbooks much work, so customers are dealt over more tasks than their bytes ask for
    each = rows.repartition(4 * spark.sparkContext.defaultParallelism, "file_id").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("k", "day", "p"))).alias("x")).select("file_id", *[F.col(f"x.{c}") for c in ("k", "day", "p")])
    made = each.mapInPandas(_workbooks, "file_id long, content binary").select("file_id", F.lit("b.xlsx").alias("name"), F.lit(".xlsx").alias("suffix"), "content")
    return books.sheet_rows(containers.sheet_records(made)).select("file_id", "register", "invoice_number", "invoice_date", "invoice_value", F.array_join("flags", ",").alias("flags"))


KINDS = {0: ("zoho", 0.88, "sheet:titles"), 1: ("unknown", 0.3, "sheet:none"), 2: ("tally", 0.92, "zip:marks"), 3: ("unknown", 0.2, "zip:unreadable"), 4: ("tally", 0.55, "name:backup"), 5: ("tally", 0.9, "voucher:marks"), 6: ("zoho", 0.6, "voucher:zoho"), 7: ("zoho", 0.7, "name:zoho"), 8: ("unknown", 0.2, "sheet:unreadable"), 9: ("unknown", 0.3, "voucher:none"), 10: ("unknown", 0.2, "type:none")}


def _dump(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def packed(body: str) -> bytes:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("x.xml", body)
        return held.getvalue()

    made = {
        0: ("s.csv", b"Date,GST Treatment\n1,2\n"), 1: ("s.xlsx", containers.workbook([("A", ["Colour", "Size"], [["red", 1]])])), 2: ("b.zip", packed("<TALLYMESSAGE/>")), 3: ("b.zip", b"no archive"), 4: ("daybook.zip", packed("<x/>")),
        5: ("e.xml", b"<VOUCHER/>"), 6: ("e.txt", b"made by Zoho"), 7: ("Zoho_out.txt", b"-"), 8: ("s.xls", b"\xd0\xcf"), 9: ("e.txt", b"plain"), 10: ("e.docx", b"x"),
    }
    for frame in frames:
        own = [made[int(k) % len(made)] for k in frame["event_id"]]
        yield pd.DataFrame({"path": [f"/dump/{k}/{n}" for k, (n, _) in zip(frame["event_id"], own, strict=True)], "length": [len(c) for _, c in own], "modificationTime": pd.Timestamp(0), "content": [c for _, c in own]})


@query("WITH k AS (SELECT event_id, event_id % 11 AS m FROM events) SELECT event_id, " + ", ".join(f"CASE m {' '.join(f'WHEN {k} THEN {v[i]!r}' for k, v in KINDS.items())} END{'::DOUBLE' if i == 1 else ''} AS {name}" for i, name in enumerate(("kind", "confidence", "reason"))) + " FROM k")
def dump_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump of spreadsheets, archives and exports, told by what is in them."""
    dump = table(spark, sf_dir, "events").select("event_id").mapInPandas(_dump, "path string, length long, modificationTime timestamp, content binary")
    told = classify.classify(containers.content_clues(dump, files.LARGEST))
    return told.select(F.element_at(F.split("path", "/"), 3).cast("long").alias("event_id"), "verdict.kind", "verdict.confidence", "verdict.reason")


@query("""SELECT page_id, CASE page_id % 7 WHEN 1 THEN 'invoice' WHEN 3 THEN 'invoice' WHEN 4 THEN 'invoice' WHEN 6 THEN 'bank' ELSE 'unknown' END AS kind, CASE page_id % 7 WHEN 1 THEN 0.6 WHEN 3 THEN 0.85 WHEN 4 THEN 0.85 WHEN 6 THEN 0.9 ELSE 0.4 END::DOUBLE AS confidence FROM pages""")
def classify_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by size, recognised text, or name where none was recognised."""
    k = F.col("page_id")
    recognised = pick(k, "Tax Invoice HSN", None, None, "Tax Invoice HSN", "one hsn code", "", "narration deposit cheque")
    shots = table(spark, sf_dir, "pages").select("page_id", pick(k, "tiny_inv.png", "my_bill.jpg", "photo.webp", "a.png", "b.TIFF", "c.bmp", "d.jpeg").alias("path"), F.when(k % 7 == 0, 7).otherwise(800).alias("width"), F.lit(600).alias("height"), recognised.alias("ocr_text"))
    return classify.classify(shots).select("page_id", "verdict.kind", "verdict.confidence")


@query("""SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'gstr_2b' WHEN 2 THEN 'bank' WHEN 3 THEN 'invoice' ELSE 'unknown' END AS kind, CASE page_id % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.8 WHEN 2 THEN 0.9 WHEN 3 THEN 0.55 ELSE 0.3 END::DOUBLE AS confidence, page_id % 5 <> 1 AND page_id % 5 <> 2 AND page_id % 5 <> 3 AS needs_review, page_id % 5 = 0 AS needs_password FROM pages""")
def classify_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF files: encrypted, scanned (by name), and by the text of their first four pages; what has to be looked at."""
    k = F.col("page_id")
    none = F.array(*[F.lit("x")] * 4)
    texts = F.when(k % 5 == 2, F.array(*[F.lit(t) for t in ("narration", "cheque", "", "")])).when(k % 5 == 3, F.array(F.lit("opening balance narration deposit"))).when(k % 5 == 4, F.concat(none, F.array(F.lit("tax invoice hsn taxable")))).otherwise(none)
    shots = table(spark, sf_dir, "pages").select("page_id", pick(k, "a.pdf", "GSTR 2B.pdf", "s.pdf", "my invoice.pdf", "long.pdf").alias("path"), pick(k, "encrypted", "text", "text", "scanned", "text").alias("pdf_type"), F.when(k % 5 == 3, 1).otherwise(3).alias("pages"), texts.alias("page_texts"))
    told = classify.classify(shots).select("page_id", F.col("verdict.kind").alias("detected_kind"), "verdict.confidence", F.col("verdict.reason").alias("classify_reason"), F.lit(None).cast("string").alias("override_kind"))
    return classify.review_columns(told).select("page_id", "kind", "confidence", "needs_review", "needs_password")


@query("""SELECT user_id AS file_id, CASE WHEN user_id % 6 = 0 THEN 'sbi' WHEN user_id % 6 = 1 THEN 'hdfc' WHEN user_id % 6 = 2 THEN 'kotak' WHEN user_id % 6 = 3 THEN 'icici' ELSE 'generic' END AS profile,
CASE WHEN user_id % 6 = 0 THEN 'State Bank of India' WHEN user_id % 6 = 1 THEN 'HDFC Bank' WHEN user_id % 6 = 2 THEN 'Kotak Mahindra Bank' WHEN user_id % 6 = 3 THEN 'ICICI Bank' ELSE 'Bank statement' END AS account_name,
CASE WHEN user_id % 6 <> 5 THEN (100000000 + user_id)::VARCHAR END AS account_number, CASE WHEN user_id % 6 <> 5 THEN 'ABCD0' || lpad(user_id::VARCHAR, 6, '0') END AS ifsc FROM (SELECT DISTINCT user_id FROM events)""")
def bank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank of a statement, by its name first and its heading then; account number and code, label and digits on different lines."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id")).distinct()
    k = F.col("file_id")
    named = users.select("file_id", pick(k, "sbi_apr.pdf", "HDFC.pdf", "a.pdf", "a.pdf", "a.pdf", "a.pdf").alias("name"))
    heading = pick(k, "Welcome to ICICI", "axis bank", "Kotak Mahindra", "icici bank", "nothing", "nothing")
    late = F.when(k % 6 == 5, 3).otherwise(2)
    own = lambda n, page, t: users.select("file_id", F.lit(n).alias("line_no"), (F.lit(page) if isinstance(page, int) else page).alias("page"), t.alias("text"))
    lines = own(1, 1, heading).unionByName(own(70, late, F.lit("Account Number:"))).unionByName(own(71, late, F.concat(F.lit(" "), (F.lit(100_000_000) + k).cast("string")))).unionByName(own(72, late, F.concat(F.lit("ifsc: abcd0"), F.lpad(k.cast("string"), 6, "0"))))
    return bank.statement_context(lines, named).select("file_id", "profile", "account_name", "account_number", "ifsc")


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN 'length' WHEN 2 THEN 'shape' END AS error FROM supplier")
def client_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers as someone enters them: none, too short, misshapen, and with blanks and small letters."""
    k = F.col("s_suppkey")
    raw = pick(k, None, "27AAPFU0939F1Z", "27AAPFU0939F1YV", " 27aapfu 0939f1z0 ")
    return table(spark, sf_dir, "supplier").select("s_suppkey", identifiers.client_gstin_error(raw).alias("error"))


@query("SELECT lower(trim(n)) AS name FROM (SELECT CASE WHEN s_suppkey % 3 = 0 THEN ' Firm ' || s_suppkey // 2 ELSE 'FIRM ' || s_suppkey // 2 END AS n FROM supplier) GROUP BY lower(trim(n)) HAVING NOT regexp_matches(lower(trim(n)), '7$')")
def admitted_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New clients, one for each name, that no existing one is called."""
    k = F.col("s_suppkey")
    half = F.floor(k / 2).cast("string")
    new = table(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit(" Firm "), half)).otherwise(F.concat(F.lit("FIRM "), half)).alias("name"))
    known = new.where(F.col("name").endswith("7")).select(F.upper("name").alias("name"))
    return classify.admit(new, known, ["name"]).select(F.lower(F.trim("name")).alias("name"))


@query("""WITH w AS (SELECT p_partkey AS k, (p_partkey % 20)::BIGINT AS file_id, (p_partkey % 3)::INT AS page, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_brand END AS text, CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE (p_partkey % 100)::VARCHAR END AS conf, (p_partkey % 600)::DOUBLE AS l, (p_partkey % 1500)::DOUBLE AS t, (p_partkey % 50)::DOUBLE AS w, 20.0::DOUBLE AS h FROM part)
SELECT file_id, CASE WHEN page <= 0 THEN page + 1 ELSE page END AS page, trim(text) AS text, l / 2.0 AS x, 842.0 - (t + h) / 2.0 AS y, w / 2.0 AS width, h / 2.0 AS height FROM w WHERE trim(text) <> '' AND coalesce(TRY_CAST(conf AS DOUBLE), -1) >= 40 AND w > 0 AND k % 13 <> 0""")
def recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words with enough confidence, turned from pixels to page units."""
    return bank.recognised_items(_words(spark, sf_dir)).select("file_id", "page", "text", "x", "y", "width", "height")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    d = lambda n: (k % n).cast("double")
    return table(spark, sf_dir, "part").select((k % 20).alias("file_id"), (k % 3).cast("int").alias("page"), F.when(k % 13 == 0, 4).otherwise(5).alias("level"), F.when(k % 11 == 0, " ").otherwise(F.col("p_brand")).alias("text"), F.when(k % 9 == 0, "x").otherwise((k % 100).cast("string")).alias("conf"), d(600).alias("left"), d(1500).alias("top"), d(50).alias("width"), F.lit(20.0).alias("height"), F.lit(2.0).alias("scale"), F.lit(842.0).alias("page_height"))


def bands_sql(items: str, order: str, slack: str) -> str:
    """Greedy bands by a recursion over the items of each page, then the lines of the bands."""
    return f"""WITH RECURSIVE it AS ({items}), o AS (SELECT *, row_number() OVER (PARTITION BY file_id, page ORDER BY {order}) AS i FROM it),
f(file_id, page, i, ys, band) AS (SELECT file_id, page, i, [y], 1 FROM o WHERE i = 1
  UNION ALL SELECT file_id, page, i, CASE WHEN b IS NULL THEN list_append(ys, y) ELSE ys END, coalesce(b, len(ys) + 1) FROM (SELECT o.file_id, o.page, o.i, f.ys, o.y, nullif(list_position(list_transform(f.ys, lambda v: abs(o.y - v) <= {slack}), true), 0) AS b FROM f JOIN o ON o.file_id = f.file_id AND o.page = f.page AND o.i = f.i + 1)),
g AS (SELECT o.file_id, o.page, band, string_agg(trim(text), ' ' ORDER BY x, o.i) AS text, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM o JOIN f USING (file_id, page, i) GROUP BY ALL)
SELECT file_id, page, row_number() OVER (PARTITION BY file_id ORDER BY page, band)::INT AS line_no, text, x, y, width, height FROM g"""


@query(bands_sql("SELECT (p_partkey % 50)::BIGINT AS file_id, 1 AS page, p_brand AS text, (p_partkey % 7 * 80)::DOUBLE AS x, (800 - p_partkey // 350 * 20 + p_partkey % 3)::DOUBLE AS y, 60.0::DOUBLE AS width, 9.0::DOUBLE AS height FROM part", "y DESC, x", "4.5"))
def line_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents' numbers placed on pages, grouped to lines."""
    k = F.col("p_partkey")
    items = table(spark, sf_dir, "part").select((k % 50).alias("file_id"), F.lit(1).alias("page"), F.col("p_brand").alias("text"), (k % 7 * 80).cast("double").alias("x"), (800 - F.floor(k / 350) * 20 + k % 3).cast("double").alias("y"), F.lit(60.0).alias("width"), F.lit(9.0).alias("height"), F.lit(10.0).alias("font_size"))
    return bank.group_lines(items).select("file_id", "page", "line_no", "text", "x", "y", "width", "height")


@query(bands_sql("SELECT (p_partkey % 40)::BIGINT AS file_id, 1 AS page, p_brand AS text, (p_partkey * 7 % 997)::DOUBLE / 2 AS x, 842.0 - ((p_partkey * 13 % 1601)::DOUBLE + 20 + p_partkey % 5 * 4) / 2 AS y, 15.0::DOUBLE AS width, (20 + p_partkey % 5 * 4)::DOUBLE / 2 AS height FROM part", "-(y + height / 2), x, text", "greatest(3.0, 0.6::DOUBLE * o.height)"))
def recognised_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words grouped to lines, with a reach by their height."""
    k = F.col("p_partkey")
    words = table(spark, sf_dir, "part").select((k % 40).alias("file_id"), F.lit(0).alias("page"), F.lit(5).alias("level"), F.col("p_brand").alias("text"), F.lit("90").alias("conf"), (k * 7 % 997).cast("double").alias("left"), (k * 13 % 1601).cast("double").alias("top"), F.lit(30.0).alias("width"), (20 + k % 5 * 4).cast("double").alias("height"), F.lit(2.0).alias("scale"), F.lit(842.0).alias("page_height"))
    return bank.recognised_lines(words).select("file_id", "page", "line_no", "text", "x", "y", "width", "height")


@query("SELECT doc_id, doc_id % 5 <= 2 OR length(trim(left(text, 30), ' ')) < 20 AS needs_ocr, (CASE WHEN doc_id % 4 = 0 THEN 1 ELSE doc_id % 4 END)::INT AS page FROM documents WHERE text IS NOT NULL")
def ocr_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that have to be recognised: scanned, with all pages asking for it, or with next to nothing to read; pages from one."""
    k = F.col("doc_id")
    asks = F.when(k % 5 == 2, F.array(F.lit(True), F.lit(True))).when(k % 5 == 3, F.array(F.lit(True), F.lit(False))).otherwise(F.array().cast("array<boolean>"))
    docs = table(spark, sf_dir, "documents").where("text is not null")
    needs = bank.needs_ocr(pick(k, "scanned", "image_based", "text", "text", "text"), asks, F.array(F.lit(" "), F.trim(F.substring("text", 1, 30))))
    return docs.select("doc_id", needs.alias("needs_ocr"), bank.page_number((k % 4).cast("int")).alias("page"))


@query("SELECT o_custkey % 7 AS period_id, CASE WHEN o_custkey % 7 = 3 THEN count(*) FILTER (o_orderkey % 2 = 0) ELSE count(*) END AS rows, CASE WHEN o_custkey % 7 = 3 THEN 'again' ELSE 'first' END AS run FROM orders GROUP BY o_custkey % 7")
def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of periods, one of which is written again: only its partition is replaced."""
    path = f"{shared_place(spark)}/periods/{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("period_id"), "o_orderkey")
    overwrite_partitions(rows.withColumn("run", F.lit("first")), path, ["period_id"])
    overwrite_partitions(rows.where("period_id = 3 and o_orderkey % 2 = 0").withColumn("run", F.lit("again")), path, ["period_id"])
    return spark.read.parquet(path).groupBy(F.col("period_id").cast("long").alias("period_id")).agg(F.count("*").alias("rows"), F.max("run").alias("run"))


@query("SELECT p_partkey, substr(sha1(p_partkey || ':' || (p_partkey % 4) || ':' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '1.0,2.0,3.0,4.0' END), 1, 16) AS key, 'data:image/png;base64,' || base64(p_name::BLOB) AS url FROM part")
def crop_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names under which crops are kept, and contents as data URLs."""
    k = F.col("p_partkey")
    box = F.when(k % 5 != 0, geometry.box_text(*[F.lit(float(i)) for i in (1, 2, 3, 4)]))
    return table(spark, sf_dir, "part").select("p_partkey", geometry.crop_key(k, k % 4, box).alias("key"), geometry.data_url(F.encode("p_name", "UTF-8")).alias("url"))


@query(f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN 'x' WHEN 2 THEN 'p|q' ELSE '' END AS items, CASE o_orderkey % 4 WHEN 0 THEN 'a;b' WHEN 1 THEN '["x"' ELSE '' END AS codes, CASE o_orderkey % 3 WHEN 0 THEN 'f.pdf' END AS file, CASE WHEN contains(o_orderkey::VARCHAR, 's3') THEN '' ELSE 'pw ' || o_orderkey || '***' END AS said,
strftime(o_orderdate, '%b %Y') AS label, 'gst no. ' || o_orderkey AS header, left('a b ' || repeat('xy ', 100), 240) AS excerpt, o_orderkey % 2 = 0 AS looks FROM orders""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag lists, source files, secrets, period labels, titles, excerpts and identifier shapes as reports show them."""
    k = F.col("o_orderkey")
    raw = pick(k, "a;b,", '["x", " "]', " p ,, q", None)
    listed = F.when(k % 4 == 0, "a;b").when(k % 4 == 1, '["x"').otherwise("")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array_join(text.flag_items(raw), "|").alias("items"), text.flag_text(text.flag_list(listed)).alias("codes"), text.source_file(pick(k, "f.pdf#p1", "#x", None)).alias("file"), text.redact(F.concat(F.lit("pw "), k.cast("string"), F.lit("s3\n trace")), "s3").alias("said"),
        F.date_format("o_orderdate", "MMM yyyy").alias("label"), text.header(F.concat(F.lit("  GST  No. "), k.cast("string"))).alias("header"), text.excerpt(F.concat(F.lit(" a\n b "), F.lit("xy  " * 100))).alias("excerpt"), identifiers.looks_like_gstin(F.when(k % 2 == 0, " 27AAPFU0939F1ZV ").otherwise("27AAPFU")).alias("looks"),
    )


@query("""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey * 123457 % 10000000000 * CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE 1 END END AS p FROM customer), b AS (SELECT c_custkey, p, (abs(p) // 100)::VARCHAR AS w, lpad((abs(p) % 100)::VARCHAR, 2, '0') AS d FROM a)
SELECT c_custkey, coalesce(CASE WHEN p < 0 THEN '-' ELSE '' END || CASE WHEN length(w) > 7 THEN left(w, length(w) - 7) || ',' ELSE '' END || CASE WHEN length(w) > 5 THEN substr(w, greatest(length(w) - 6, 1), least(2, length(w) - 5)) || ',' ELSE '' END || CASE WHEN length(w) > 3 THEN substr(w, greatest(length(w) - 4, 1), least(2, length(w) - 3)) || ',' ELSE '' END || right(w, 3) || '.' || d, '—') AS shown FROM b""")
def shown_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with Indian grouping."""
    k = F.col("c_custkey")
    p = F.when(k % 10 != 0, k * 123457 % 10_000_000_000 * F.when(k % 3 == 0, -1).otherwise(1))
    return table(spark, sf_dir, "customer").select("c_custkey", text.shown_money((p.cast("decimal(20,0)") / 100).cast("decimal(20,2)")).alias("shown"))

