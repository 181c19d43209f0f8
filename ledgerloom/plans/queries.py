"""One query per ledger operator over the generic test tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, geometry, identifiers, money, text
from ..operators import bank, books, classify, gst, invoice, recon, reports
from ..sources.containers import voucher_elements
from ..sources.files import mime
from ..sources.staging import shared_place
from ..streaming.ingest import run_available
from .views import INV, STATEMENT, flags_sql, gstin_of, gstin_sql, inv, rupees, statement, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def paise_text(paise: Column) -> Column:
    """Whole paise as rupees with two decimals."""
    return (paise / 100).cast(money.MONEY).cast("string")


def joined(flags: Column | str) -> Column:
    return F.array_join(flags, ",")


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def count_sql(column: str, words) -> str:
    return " + ".join(f"contains({column}, '{w}')::INT" for w in words)


HSN_FLAG = "CASE WHEN length(regexp_replace(hsn, '[^0-9]', '', 'g')) NOT IN (0, 4, 6, 8) THEN 'hsn_length' ELSE '' END"
MATH_FLAG = "CASE WHEN abs(taxable + tax - value) > 100 THEN 'invoice_math' ELSE '' END"
ALL_FLAGS = f"array_to_string(list_filter([{flags_sql('gstin')}, {HSN_FLAG}, {MATH_FLAG}], lambda x: x <> ''), ',')"


def flagged_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = inv(spark, sf_dir)
    amounts = [(F.col(c) / 100).cast(money.MONEY) for c in ("taxable", "tax", "value")]
    return df.withColumn("flags", text.add_flags(identifiers.gstin_flags("gstin"), identifiers.hsn_flags("hsn"), invoice.math_flag(*amounts)))


@query(f"WITH {INV} SELECT supplier_name, gstin AS supplier_gstin, invoice_number, strftime(day, '%Y-%m-%d') AS invoice_date, taxable / 100.0::DOUBLE AS taxable_value, tax / 100.0::DOUBLE AS tax, value / 100.0::DOUBLE AS invoice_value, hsn, {ALL_FLAGS} AS flags, invoice_number || '#p1' AS source FROM inv")
def purchase_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices as purchases: identifier, code and arithmetic flags, the register's columns."""
    df = flagged_invoices(spark, sf_dir)
    rows = df.select("supplier_name", F.col("gstin").alias("supplier_gstin"), "invoice_number", F.date_format("day", "yyyy-MM-dd").alias("invoice_date"), rupees(F.col("taxable")).alias("taxable_value"), rupees(F.col("tax")).alias("tax"), rupees(F.col("value")).alias("invoice_value"), "hsn", "flags", F.concat("invoice_number", F.lit("#p1")).alias("source"))
    return books.register_rows(rows).select(*[F.col(c) for c in books.REGISTER if c != "flags"], joined("flags").alias("flags"))


@query(f"SELECT s_suppkey, gstin, {flags_sql('gstin')} AS flags FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 31 = 0 THEN NULL WHEN s_suppkey % 29 = 0 THEN left(g, 14) ELSE g END AS gstin FROM (SELECT s_suppkey, {gstin_sql('s_suppkey')} AS g FROM supplier))")
def gstin_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, misshapen and miskeyed identifiers."""
    k = F.col("s_suppkey")
    df = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 31 != 0, F.when(k % 29 == 0, F.substring(gstin_of(k), 1, 14)).otherwise(gstin_of(k))).alias("gstin"))
    return df.select("s_suppkey", "gstin", joined(identifiers.gstin_flags("gstin")).alias("flags"))


@query("SELECT p_partkey, code, CASE WHEN length(regexp_replace(coalesce(code, ''), '[^0-9]', '', 'g')) NOT IN (0, 4, 6, 8) THEN 'hsn_length' ELSE '' END AS flags FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'abc' ELSE substr((p_partkey * 104729 + 10000000)::VARCHAR, 1, (p_partkey % 9)::INT) END AS code FROM part)")
def hsn_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of odd lengths."""
    k = F.col("p_partkey")
    code = F.when(k % 11 == 0, "abc").otherwise(F.substring((k * 104729 + 10000000).cast("string"), F.lit(1), (k % 9).cast("int")))
    df = table(spark, sf_dir, "part").select("p_partkey", code.alias("code"))
    return df.withColumn("flags", joined(identifiers.hsn_flags("code")))


@query(f"WITH {INV} SELECT okey, skey, {MATH_FLAG} AS flags FROM inv")
def invoice_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxable value and tax against the total, to within one rupee."""
    a = [(F.col(c) / 100).cast(money.MONEY) for c in ("taxable", "tax", "value")]
    return inv(spark, sf_dir).select("okey", "skey", joined(invoice.math_flag(*a)).alias("flags"))


def _worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with some statement and invoice wording put before every few of them."""
    k = F.col("doc_id")
    head = F.when(k % 5 == 0, "Opening Balance Narration Cheque ").when(k % 5 == 1, "Tax Invoice HSN 8471 ").when(k % 5 == 2, "deposit ").otherwise("")
    name = F.concat(F.when(k % 23 == 0, "GSTR-2B_").when(k % 29 == 0, "gst1 ").otherwise("scan_"), k.cast("string"), F.lit(".pdf"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), (k % 4 + 1).cast("int").alias("pages"), F.concat(head, F.col("text")).alias("text"))


WORDED = "d AS (SELECT doc_id, lower(CASE WHEN doc_id % 23 = 0 THEN 'GSTR-2B_' WHEN doc_id % 29 = 0 THEN 'gst1 ' ELSE 'scan_' END || doc_id || '.pdf') AS name, (doc_id % 4 + 1)::INT AS pages, lower(CASE WHEN doc_id % 5 = 0 THEN 'Opening Balance Narration Cheque ' WHEN doc_id % 5 = 1 THEN 'Tax Invoice HSN 8471 ' WHEN doc_id % 5 = 2 THEN 'deposit ' ELSE '' END || text) AS t FROM documents)"


@query(f"""WITH {WORDED}, h AS (SELECT doc_id, name, pages, t, translate(name, ' _-', '') AS c, {count_sql('t', classify.BANK_WORDS)} AS b, {count_sql('t', classify.INVOICE_WORDS)} AS i FROM d)
SELECT doc_id, b AS bank_hits, i AS invoice_hits, CASE WHEN contains(c, 'gstr2b') OR contains(c, 'gst2b') THEN 'gstr_2b' WHEN contains(c, 'gstr3b') OR contains(c, 'gst3b') THEN 'gstr_3b' WHEN contains(c, 'gstr1') OR contains(c, 'gst1') THEN 'gstr_1'
 WHEN b >= 3 OR (b >= 2 AND pages >= 3) THEN 'bank' WHEN i >= 2 OR (g AND contains(t, 'invoice')) THEN 'invoice' WHEN pages >= 3 AND b >= 1 THEN 'bank' WHEN pages <= 2 AND (g OR contains(name, 'invoice')) THEN 'invoice' ELSE 'unknown' END AS kind,
 CASE WHEN contains(c, 'gstr2b') OR contains(c, 'gst2b') OR contains(c, 'gstr3b') OR contains(c, 'gst3b') THEN 0.8 WHEN contains(c, 'gstr1') OR contains(c, 'gst1') THEN 0.75
 WHEN b >= 3 OR (b >= 2 AND pages >= 3) THEN 0.9 WHEN i >= 2 OR (g AND contains(t, 'invoice')) THEN 0.85 WHEN pages >= 3 AND b >= 1 THEN 0.6 WHEN pages <= 2 AND (g OR contains(name, 'invoice')) THEN 0.55 ELSE 0.3 END::DOUBLE AS confidence
FROM (SELECT *, regexp_matches(upper(t), '\\b{identifiers.GSTIN}\\b') AS g FROM h)""")
def classify_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents by their words, file name and pages."""
    df = _worded(spark, sf_dir)
    low = F.lower("text")
    return df.select("doc_id", text.hits(low, classify.BANK_WORDS).alias("bank_hits"), text.hits(low, classify.INVOICE_WORDS).alias("invoice_hits"), classify.by_text(F.col("name"), F.col("pages"), F.col("text")).alias("v")).select("doc_id", "bank_hits", "invoice_hits", "v.kind", "v.confidence")


@query("""WITH p AS (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/\\\\]*)$', 1) || CASE page_id % 8 WHEN 0 THEN 'GSTR_3B.json' WHEN 1 THEN '.csv' WHEN 2 THEN ' books.xlsx' WHEN 3 THEN '.pdf' WHEN 4 THEN 'gstr-1.JSON' WHEN 5 THEN '_inv.PNG' WHEN 6 THEN '.docx' ELSE 'zoho.xml' END) AS name FROM pages)
SELECT page_id, name, CASE WHEN contains(name, '.json') THEN CASE WHEN contains(translate(name, ' _-', ''), 'gstr3b') THEN 'gstr_3b' ELSE 'gstr_1' END WHEN name LIKE '%.csv' THEN 'unknown' WHEN name LIKE '%books.xlsx' THEN 'zoho' WHEN name LIKE '%.pdf' THEN 'unknown' WHEN name LIKE '%.png' THEN 'invoice' WHEN name LIKE '%.docx' THEN 'unknown' ELSE 'zoho' END AS kind,
CASE WHEN name LIKE '%.json' THEN 'application/json' WHEN name LIKE '%.csv' THEN 'text/csv' WHEN name LIKE '%.xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN name LIKE '%.pdf' THEN 'application/pdf' WHEN name LIKE '%.png' THEN 'image/png' WHEN name LIKE '%.xml' THEN 'text/xml' END AS mime FROM p""")
def classify_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by suffix and name alone."""
    k = F.col("page_id") % 8
    ending = F.lit("zoho.xml")
    for i, e in enumerate(("GSTR_3B.json", ".csv", " books.xlsx", ".pdf", "gstr-1.JSON", "_inv.PNG", ".docx")):
        ending = F.when(k == i, e).otherwise(ending)
    files = table(spark, sf_dir, "pages").select("page_id", F.concat(text.file_name(F.regexp_replace("url", "[?#].*$", "")), ending).alias("path"))
    return classify.classify(files).select("page_id", F.lower("path").alias("name"), F.col("verdict.kind").alias("kind"), mime("path").alias("mime"))


@query("""WITH k AS (SELECT event_id, event_id % 7 AS m FROM events) SELECT event_id, CASE m WHEN 0 THEN 'gstr_2b' WHEN 1 THEN 'gstr_3b' WHEN 2 THEN 'gstr_1' WHEN 5 THEN 'gstr_1' ELSE 'unknown' END AS kind,
CASE m WHEN 0 THEN 0.92 WHEN 1 THEN 0.92 WHEN 2 THEN 0.9 WHEN 3 THEN 0.2 WHEN 4 THEN 0.35 WHEN 5 THEN 0.9 ELSE 0.2 END::DOUBLE AS confidence FROM k""")
def classify_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files by the keys they have; a null value still counts."""
    k = F.col("event_id") % 7
    content = F.col("props")
    for i, body in {0: '{"data":{"docdata":{}}}', 1: '{"sup_details":null}', 2: '{"b2cs":[]}', 3: "[1]", 5: '{"hsn":{},"x":1}', 6: "{broken"}.items():
        content = F.when(k == i, body).otherwise(content)
    files = table(spark, sf_dir, "events").select("event_id", F.lit("x.json").alias("path"), content.alias("content"))
    return classify.classify(files).select("event_id", "verdict.kind", "verdict.confidence")


@query(f"WITH {INV} SELECT okey, skey, gstin || ',' || upper(substr(gstin, 1, 14)) || 'X' AS found FROM inv")
def find_gstins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All identifiers in a text, whatever their case; longer runs are none."""
    t = F.concat(F.lit("From "), F.lower("gstin"), F.lit(" to: "), F.substring("gstin", 1, 14), F.lit("X; not "), F.col("gstin"), F.lit("9."))
    return inv(spark, sf_dir).select("okey", "skey", joined(identifiers.find_gstins(t)).alias("found"))


@query(f"WITH {INV} SELECT okey, skey, 3::BIGINT AS n_amounts, taxable / 100.0::DOUBLE AS first_amount, value / 100.0::DOUBLE AS last_amount, CASE WHEN okey % 2 = 0 THEN strftime(day, '%Y-%m-%d') ELSE strftime(day, '20%y-%m-%d') END AS first_date FROM inv")
def amounts_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in plain and grouped form, the first date of a line in two forms."""
    day = F.when(F.col("okey") % 2 == 0, F.date_format("day", "dd/MM/yyyy")).otherwise(F.date_format("day", "d-M-yy"))
    plain = lambda c: (F.col(c) / 100).cast(money.MONEY).cast("string")
    t = F.concat(F.lit("on "), day, F.lit(" taxable ₹ "), plain("taxable"), F.lit(" tax "), F.format_number((F.col("tax") / 100).cast(money.MONEY), 2), F.lit(" sum "), plain("value"), F.lit(" ref 12"))
    df = inv(spark, sf_dir).select("okey", "skey", money.amounts_in(t).alias("a"), dates.day_first(dates.first_date(t)).alias("first_date"))
    return df.select("okey", "skey", F.size("a").cast("long").alias("n_amounts"), F.get("a", F.lit(0)).cast("double").alias("first_amount"), F.get("a", F.size("a") - 1).cast("double").alias("last_amount"), "first_date")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'purchase' WHEN o_orderpriority LIKE '3%' OR o_orderpriority LIKE '4%' THEN 'sales' ELSE 'other' END AS voucher_register, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' OR o_orderpriority LIKE '5%' THEN 'purchase' WHEN o_orderpriority LIKE '3%' OR o_orderpriority LIKE '4%' THEN 'sales' END AS register FROM orders")
def register_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voucher types to registers, then the rule that rescues what the type alone leaves open."""
    p = F.substring("o_orderpriority", 1, 1)
    kind = F.when(p == "1", "Purchase").when(p == "2", " Debit  Note").when(p == "3", "Sales Local").when(p == "4", "CreditNote").otherwise("GST Purchase")
    first = classify.voucher_register(kind)
    return table(spark, sf_dir, "orders").select("o_orderkey", first.alias("voucher_register"), classify.books_register(first, kind, F.lit("tally")).alias("register"))


CHECKED = f"""WITH {STATEMENT}, g AS (SELECT *, count(balance) OVER (PARTITION BY file_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run, last_value(balance IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lastb,
 first_value(coalesce(balance, 0) + coalesce(debit, 0) - coalesce(credit, 0)) OVER (PARTITION BY file_id ORDER BY row_no) AS inferred FROM st),
o AS (SELECT *, CASE WHEN file_id % 3 = 0 THEN 1000000 ELSE inferred END AS opening FROM g),
e AS (SELECT *, coalesce(lastb, opening) + sum(coalesce(credit, 0) - coalesce(debit, 0)) OVER (PARTITION BY file_id, run ORDER BY row_no) AS expected FROM o)"""


def _checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = statement(spark, sf_dir)
    k = F.col("file_id")
    files = rows.groupBy("file_id").agg(F.max_by("balance", "row_no").alias("__last")).select("file_id", F.when(k % 3 == 0, F.lit("10000.00").cast(money.MONEY)).alias("opening"), F.when(k % 2 == 0, F.coalesce("__last", F.lit(0)).cast(money.MONEY) + F.when(k % 10 == 0, 3).otherwise(0)).cast(money.MONEY).alias("stated_closing"))
    return bank.running_check(rows, files), files


@query(CHECKED + " SELECT file_id, event_id, row_no::INT AS row_no, expected / 100.0::DOUBLE AS expected, CASE WHEN balance IS NULL THEN 'missing_balance' WHEN abs(expected - balance) > 100 THEN 'balance_mismatch' ELSE '' END AS flags FROM e")
def bank_running_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running balances that start again at each stated one."""
    checked, _ = _checked(spark, sf_dir)
    return checked.select("file_id", "event_id", "row_no", F.col("expected").cast("double").alias("expected"), joined("flags").alias("flags"))


@query(CHECKED + """, s AS (SELECT file_id, first(opening ORDER BY row_no) AS opening, first(coalesce(balance, 0) ORDER BY row_no DESC) AS lastb, min(CASE WHEN abs(expected - balance) > 100 THEN row_no END) AS broken, count(*) AS n FROM e GROUP BY file_id),
c AS (SELECT *, CASE WHEN file_id % 2 = 0 THEN lastb + CASE WHEN file_id % 10 = 0 THEN 300 ELSE 0 END END AS stated FROM s), m AS (SELECT *, abs(lastb - coalesce(stated, lastb)) <= 100 AND broken IS NULL AS ok FROM c)
SELECT file_id, opening / 100.0::DOUBLE AS opening_balance, file_id % 3 <> 0 AS opening_inferred, stated / 100.0::DOUBLE AS stated_closing, lastb / 100.0::DOUBLE AS computed_closing, ok AS match, CASE WHEN ok THEN 'match' ELSE 'mismatch' END AS status, broken::INT AS broken_at_row,
CASE WHEN broken IS NOT NULL AND stated IS NOT NULL THEN 'balance_mismatch,closing_mismatch' WHEN broken IS NOT NULL THEN 'balance_mismatch' WHEN stated IS NOT NULL AND NOT ok THEN 'closing_mismatch' ELSE '' END AS flags, n AS row_count, 'processed' AS parse_outcome FROM m""")
def bank_balance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per statement."""
    return bank.balance_summary(*_checked(spark, sf_dir)).withColumn("flags", joined("flags"))


def _statement_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Statements as lines of text: opening, transactions in right order, noise, closing."""
    df = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), "event_id", F.to_date("ts").alias("day"), "event_type", (F.floor(F.abs("value") * 100 + 0.5) + 100).cast("long").alias("amount"))
    w = Window.partitionBy("file_id").orderBy("event_id")
    pays = F.col("event_type") == "purchase"
    total = F.sum(F.when(pays, -F.col("amount")).otherwise(F.col("amount"))).over(w) + 100_000_000
    df = df.withColumns({"total": total, "n": F.row_number().over(w)})
    plain = lambda c: (c / 100).cast(money.MONEY).cast("string")
    words = F.when(F.col("event_id") % 6 == 0, "deposit slip").when(F.col("event_id") % 6 == 1, "withdrawal atm").otherwise("upi transfer")
    stated = F.col("total") + F.when(F.col("event_id") % 53 == 0, 7_777_777).otherwise(0)
    body = df.select("file_id", (F.col("n") * 2).cast("int").alias("line_no"), F.concat(F.date_format("day", "dd/MM/yyyy"), F.lit(" "), words, F.lit(" "), plain(F.col("amount")), F.lit(" "), plain(stated)).alias("text"))
    noise = df.where("event_id % 5 = 0").select("file_id", (F.col("n") * 2 + 1).cast("int").alias("line_no"), F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("Page "), F.col("n").cast("string"))).otherwise("to the shop").alias("text"))
    head = df.select("file_id").distinct().select("file_id", F.lit(0).alias("line_no"), F.lit("Opening Balance 1000000.00").alias("text"))
    lines = body.unionByName(noise).unionByName(head).withColumns({"page": F.lit(1), "x": F.lit(1.0), "y": F.lit(2.0), "width": F.lit(3.0), "height": F.lit(4.0)})
    return lines, df.select("file_id").distinct().withColumn("name", F.lit("sbi_statement.pdf"))


LINES = """WITH e AS (SELECT user_id AS file_id, event_id, ts::DATE AS day, event_type, (floor(abs(value) * 100 + 0.5) + 100)::BIGINT AS amount FROM events),
n AS (SELECT *, row_number() OVER w AS n, (sum(CASE WHEN event_type = 'purchase' THEN -amount ELSE amount END) OVER w + 100000000)::BIGINT AS total FROM e WINDOW w AS (PARTITION BY file_id ORDER BY event_id)),
s AS (SELECT *, total + CASE WHEN event_id % 53 = 0 THEN 7777777 ELSE 0 END AS stated, event_id % 6 = 0 AS credit_side FROM n)"""


@query(LINES + " SELECT file_id, (2 * n)::INT AS line_no, strftime(day, '%Y-%m-%d') AS date, CASE WHEN NOT credit_side THEN amount / 100.0::DOUBLE END AS debit, CASE WHEN credit_side THEN amount / 100.0::DOUBLE END AS credit, stated / 100.0::DOUBLE AS balance, trim(regexp_replace(replace(replace(' ' || CASE WHEN event_id % 6 = 0 THEN 'deposit slip' WHEN event_id % 6 = 1 THEN 'withdrawal atm' ELSE 'upi transfer' END || ' ' || a || ' ' || b, a, ''), b, ''), '\\s{2,}', ' ', 'g'), ' -|') AS description, 'sbi_statement.pdf#p1@1.0,2.0,3.0,4.0' AS source FROM (SELECT *, printf('%.2f', amount / 100.0) AS a, printf('%.2f', stated / 100.0) AS b FROM s)")
def bank_line_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement lines to date, sides, balance and description."""
    lines, files = _statement_lines(spark, sf_dir)
    found = bank.line_columns(lines, bank.statement_context(lines, files)).where("is_row")
    return found.select("file_id", "line_no", "date", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"), F.col("balance").cast("double").alias("balance"), "description", "source")


@query()
def bank_align_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines against the running balance: sides put right, lines that fit nothing rejected."""
    lines, files = _statement_lines(spark, sf_dir)
    context = bank.statement_context(lines, files)
    fold = bank.align(bank.line_columns(lines, context), context).where("outcome in ('row', 'rejected')")
    return fold.select("file_id", "line_no", F.when(F.col("outcome") == "row", F.col("row_no")).alias("row_no"), "outcome", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"))


SQL["bank_align_fold"] = LINES.replace("WITH e", "WITH RECURSIVE e") + """,
f(file_id, n, running, row_no, outcome, debit, credit) AS (
  SELECT file_id, 0::BIGINT, 100000000::BIGINT, 0::BIGINT, '', NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT file_id FROM s)
  UNION ALL
  SELECT file_id, n, CASE WHEN side IS NOT NULL THEN stated ELSE running END, row_no + (side IS NOT NULL)::INT, CASE WHEN side IS NOT NULL THEN 'row' ELSE 'rejected' END, CASE WHEN side = 'd' THEN amount END, CASE WHEN side = 'c' THEN amount END
  FROM (SELECT s.file_id, s.n, f.running, f.row_no, s.stated, s.amount, CASE WHEN abs(running + CASE WHEN credit_side THEN amount ELSE -amount END - stated) <= 100 THEN CASE WHEN credit_side THEN 'c' ELSE 'd' END WHEN abs(running - amount - stated) <= 100 THEN 'd' WHEN abs(running + amount - stated) <= 100 THEN 'c' END AS side
        FROM f JOIN s ON s.file_id = f.file_id AND s.n = f.n + 1))
SELECT file_id, (2 * n)::INT AS line_no, CASE WHEN outcome = 'row' THEN row_no::INT END AS row_no, outcome, debit / 100.0::DOUBLE AS debit, credit / 100.0::DOUBLE AS credit FROM f WHERE n > 0"""


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices packed as one return file for each day and branch; every so often an element that is no object is put among a party's invoices."""
    d = inv(spark, sf_dir).withColumn("file_id", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long") * 100 + F.col("okey") % 4)
    money_text = lambda c: F.format_number((F.col(c) / 100).cast(money.MONEY), 2)
    one = F.struct(F.col("invoice_number").alias("inum"), F.date_format("day", "dd-MM-yyyy").alias("dt"), (F.col("value") / 100).alias("val"), F.array(F.struct(F.struct(money_text("taxable").alias("txval"), (F.col("tax") / 100).alias("iamt")).alias("itm_det"))).alias("itms"))
    party = d.groupBy("file_id", "gstin").agg(F.array_sort(F.collect_list(F.struct("okey", "skey", one.alias("i")))).alias("x"))
    docs = F.transform("x", lambda e: F.to_json(e["i"]))
    listed = F.concat(F.lit("["), F.when(F.size("x") % 2 == 0, F.lit('"odd",')).otherwise(""), F.array_join(docs, ","), F.lit("]"))
    each = party.select("file_id", "gstin", F.concat(F.lit('{"ctin":"'), "gstin", F.lit('","trdnm":"T","inv":'), listed, F.lit("}")).alias("p"))
    files = each.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gstin", "p"))), lambda e: e["p"]), ",").alias("ps"))
    return files.select("file_id", F.concat(F.lit("r"), F.col("file_id").cast("string"), F.lit(".json")).alias("name"), F.concat(F.lit('{"gstin":"F","rtnprd":"042025","data":{"docdata":{"b2b":['), "ps", F.lit("]}}}")).alias("content"))


@query(f"""WITH {INV}, f AS (SELECT *, (day - DATE '1970-01-01')::BIGINT * 100 + okey % 4 AS file_id FROM inv), p AS (SELECT *, dense_rank() OVER (PARTITION BY file_id ORDER BY gstin) - 1 AS pi, row_number() OVER (PARTITION BY file_id, gstin ORDER BY okey, skey) - 1 AS ii FROM f)
SELECT file_id, gstin, 'T' AS trade_name, invoice_number, strftime(day, '%d-%m-%Y') AS invoice_date, value / 100.0::DOUBLE AS invoice_value, taxable / 100.0::DOUBLE AS taxable, tax / 100.0::DOUBLE AS igst, 'r' || file_id || '.json#2b.b2b[' || pi || '].inv[' || ii || ']' AS source, {flags_sql('gstin')} AS flags FROM p""")
def return_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return JSON to rows, odd elements left out and places counted without them."""
    rows = gst.purchase_return(gst.parse(_returns(spark, sf_dir)))
    return rows.select("file_id", "gstin", "trade_name", "invoice_number", "invoice_date", "invoice_value", "taxable", "igst", "source", joined("flags").alias("flags"))


@query(f"""WITH {INV}, m AS (SELECT (day - DATE '1970-01-01')::BIGINT AS file_id, sum(taxable) / 100.0::DOUBLE AS t, sum(tax) / 100.0::DOUBLE AS x, count(*) AS n FROM inv GROUP BY ALL)
SELECT file_id, 'Outward taxable (other than zero rated)' AS section, t AS taxable, x AS igst, 's' || file_id || '.json#3b.sup_details.osup_det' AS source FROM m WHERE n % 5 <> 0
UNION ALL SELECT file_id, 'ITC available: IMPG', NULL, x, 's' || file_id || '.json#3b.itc_elg.itc_avl[0]' FROM m WHERE n % 5 <> 0
UNION ALL SELECT file_id, 'Inward supplies: GST', t + x, NULL, 's' || file_id || '.json#3b.inward_sup.isup_details[0]' FROM m WHERE n % 5 <> 0
UNION ALL SELECT file_id, '{gst.EMPTY_SUMMARY}', NULL, NULL, 's' || file_id || '.json' FROM m WHERE n % 5 = 0""")
def return_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary returns to one row per block; empty ones give a placeholder."""
    m = inv(spark, sf_dir).groupBy(F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long").alias("file_id")).agg((F.sum("taxable") / 100.0).alias("t"), (F.sum("tax") / 100.0).alias("x"), F.count("*").alias("n"))
    full = F.to_json(F.struct(F.struct(F.struct(F.col("t").alias("txval"), F.col("x").alias("iamt")).alias("osup_det")).alias("sup_details"), F.struct(F.array(F.struct(F.lit("IMPG").alias("ty"), F.col("x").alias("iamt"))).alias("itc_avl")).alias("itc_elg"), F.struct(F.array(F.struct(F.lit("GST").alias("ty"), F.col("t").alias("inter"), F.col("x").alias("intra"))).alias("isup_details")).alias("inward_sup")))
    files = m.select("file_id", F.concat(F.lit("s"), F.col("file_id").cast("string"), F.lit(".json")).alias("name"), F.when(F.col("n") % 5 == 0, "{}").otherwise(full).alias("content"))
    return gst.summary_return(gst.parse(files)).select("file_id", "section", "taxable", "igst", "source")


@query("""SELECT l_orderkey AS okey, sum(CASE WHEN l_linenumber % 3 <> 0 THEN floor(l_extendedprice * 100 + 0.5)::BIGINT END)::BIGINT AS txval, CASE WHEN l_orderkey % 2 = 0 THEN 7 ELSE sum(CASE WHEN l_linenumber % 4 = 0 THEN floor(l_quantity)::BIGINT END)::BIGINT END AS iamt FROM lineitem GROUP BY l_orderkey""")
def item_tax_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item amounts of a document: items without one don't count, none at all gives null or the document's own amount."""
    key = F.col("l_orderkey")
    item = F.struct(F.when(F.col("l_linenumber") % 3 != 0, F.floor(F.col("l_extendedprice") * 100 + 0.5)).alias("txval"), F.when((F.col("l_linenumber") % 4 == 0) & (key % 2 != 0), F.floor("l_quantity")).alias("iamt"))
    docs = table(spark, sf_dir, "lineitem").groupBy(key.alias("okey")).agg(F.collect_list(item).alias("itms"))
    doc = docs.select("okey", F.try_parse_json(F.to_json(F.struct("itms", F.when(F.col("okey") % 2 == 0, 7).alias("iamt")))).alias("doc"))
    return doc.select("okey", gst.taxes("doc").alias("t")).select("okey", F.col("t.taxable").cast("long").alias("txval"), F.col("t.igst").cast("long").alias("iamt"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, floor(o_totalprice * 100 + 0.5)::BIGINT AS p, o_orderdate::DATE AS day FROM orders)
SELECT k AS file_id, CASE WHEN k % 2 = 0 THEN 'sales' ELSE 'purchase' END AS register, 'C' || c AS supplier_name, CASE WHEN k % 9 <> 0 THEN 'N-' || k END AS invoice_number, CASE WHEN k % 6 = 1 THEN NULL ELSE strftime(day, '%Y-%m-%d') END AS invoice_date, p / 100.0::DOUBLE AS taxable_value,
CASE WHEN k % 2 = 0 THEN (p // 1000 * 18) / 10.0::DOUBLE ELSE (p // 1000) / 1.0::DOUBLE END AS tax, CASE WHEN k % 6 = 1 THEN 'bad_date' ELSE '' END AS flags FROM o""")
def alias_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export records under varying titles to canonical rows; tax as an amount or from a percentage."""
    k = F.col("o_orderkey")
    p = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    day = F.to_date("o_orderdate")
    sale = k % 2 == 0
    date = F.when(k % 6 == 1, F.date_format(day, "dd-MMM-yyyy")).when(k % 6 == 0, F.date_format(day, "yyyy/M/d")).when(k % 6 == 2, F.date_format(day, "yyyy-MM-dd HH:mm")).otherwise(F.date_format(day, "d.M.yyyy"))
    amount = F.concat(F.lit("₹"), F.format_number((p / 100).cast(money.MONEY), 2))
    # the percentage is of the taxable value in whole tens of rupees, so that no rounding is left to the float
    percent = F.floor(p / 1000) * 18 / 10.0
    cells = F.when(sale, F.map_from_arrays(F.array(*[F.lit(x) for x in ("invoice number", "invoice date", "customer name", "subtotal", "tax amount", "item tax %")]), F.array(F.when(k % 9 != 0, F.concat(F.lit("N-"), k.cast("string"))).otherwise(""), date, F.concat(F.lit("C"), F.col("o_custkey").cast("string")), amount, percent.cast("decimal(18,2)").cast("string"), F.lit("18")))).otherwise(
        F.map_from_arrays(F.array(*[F.lit(x) for x in ("bill number", "bill date", "vendor name", "sub total", "tax")]), F.array(F.when(k % 9 != 0, F.concat(F.lit("N-"), k.cast("string"))), date, F.concat(F.lit("C"), F.col("o_custkey").cast("string")), amount, F.floor(p / 1000).cast("string")))
    )
    records = table(spark, sf_dir, "orders").select(k.alias("file_id"), F.lit("x").alias("source"), F.map_keys(cells).alias("headers"), cells.alias("cells"))
    return books.sheet_rows(records).select("file_id", "register", "supplier_name", "invoice_number", "invoice_date", "taxable_value", "tax", joined("flags").alias("flags"))


@query("""SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 3 = 0 THEN 'purchase' WHEN o_orderkey % 3 = 1 THEN 'sales' ELSE 'other' END AS register, 'P & ' || o_custkey AS supplier_name, 'V' || o_orderkey AS voucher_number, CASE WHEN o_orderkey % 2 = 0 THEN 'R' || o_orderkey ELSE 'V' || o_orderkey END AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, floor(o_totalprice * 100 + 0.5)::BIGINT / 100.0::DOUBLE AS invoice_value FROM orders WHERE o_orderkey % 11 <> 0""")
def voucher_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voucher XML in any case, with namespaces and nested amounts; malformed files give no rows."""
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "Purchase").when(k % 3 == 1, "Credit Note").otherwise("Journal")
    amount = F.concat(F.lit("-"), F.format_number((F.floor(F.col("o_totalprice") * 100 + 0.5) / 100).cast(money.MONEY), 2))
    nested = F.when(k % 4 == 0, F.concat(F.lit("<ENTRY><amount>"), amount, F.lit("</amount></ENTRY>"))).otherwise(F.concat(F.lit("<AMOUNT> "), amount, F.lit(" </AMOUNT>")))
    body = F.concat(F.lit('<ENVELOPE xmlns:u="urn:u"><u:voucher VCHTYPE="'), kind, F.lit('"><DATE>'), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("</DATE><VOUCHERNUMBER>V"), k.cast("string"), F.lit("</VOUCHERNUMBER>"), F.when(k % 2 == 0, F.concat(F.lit("<REFERENCE>R"), k.cast("string"), F.lit("</REFERENCE>"))).otherwise("<REFERENCE/>"), F.lit("<PARTYLEDGERNAME>P &amp; "), F.col("o_custkey").cast("string"), F.lit("</PARTYLEDGERNAME>"), nested, F.when(k % 11 == 0, "<open>").otherwise(""), F.lit("</u:voucher></ENVELOPE>"))
    files = table(spark, sf_dir, "orders").select(k.alias("file_id"), F.lit("e.xml").alias("source"), F.encode(body, "UTF-8").alias("content"))
    return books.voucher_rows(voucher_elements(files)).select("file_id", "register", "supplier_name", "voucher_number", "invoice_number", "invoice_date", "invoice_value")


def _invoice_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("okey")
    plain = lambda c: (F.col(c) / 100).cast(money.MONEY).cast("string")
    head = F.when(k % 5 == 0, "Bill").otherwise(F.concat(F.lit("Supplier GSTIN: "), "gstin"))
    total = F.when(k % 3 == 0, F.concat(F.lit(" paid "), plain("value"))).otherwise(F.concat(F.lit("Grand Total: "), plain("value")))
    tax = F.when(k % 2 == 0, F.concat(F.lit("CGST "), plain("tax"), F.lit("\nSGST 0.00"))).otherwise(F.concat(F.lit("Total Tax "), plain("tax")))
    number = F.when(k % 7 != 0, F.concat(F.lit("\nInvoice No: "), "invoice_number")).otherwise("")
    t = F.concat(head, F.lit("\nSupplier Name: "), F.replace("supplier_name", F.lit("#"), F.lit(" ")), F.lit("\nDate "), F.date_format("day", "dd/MM/yyyy"), number, F.lit("\nHSN: "), "hsn", F.lit("\nTaxable Value: "), plain("taxable"), F.lit("\n"), tax, F.lit("\n"), total)
    return inv(spark, sf_dir).select(F.concat_ws("-", "okey", "skey").alias("file_id"), t.alias("text"))


@query(f"""WITH {INV} SELECT okey || '-' || skey AS file_id, replace(supplier_name, '#', ' ') AS supplier_name, CASE WHEN okey % 5 <> 0 THEN gstin END AS supplier_gstin, CASE WHEN okey % 7 <> 0 THEN invoice_number END AS invoice_number, strftime(day, '%Y-%m-%d') AS invoice_date, taxable / 100.0::DOUBLE AS taxable_value, tax / 100.0::DOUBLE AS tax, value / 100.0::DOUBLE AS invoice_value, hsn,
array_to_string(list_filter([CASE WHEN okey % 5 = 0 THEN 'gstin_missing' ELSE {flags_sql('gstin')} END, {HSN_FLAG}, {MATH_FLAG}], lambda x: x <> ''), ',') AS flags FROM (SELECT * REPLACE (CASE WHEN okey % 2 = 0 THEN tax ELSE taxable END AS tax) FROM inv) WHERE okey % 5 <> 0 OR okey % 7 <> 0""")
def invoice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice texts to one row each; texts without identifier and number give none. Where no tax has its own label, the label before the
    taxable value counts as the word tax, as it begins with it."""
    rows = invoice.invoices(_invoice_text(spark, sf_dir))
    d = lambda c: F.col(c).cast("double").alias(c)
    return rows.select("file_id", "supplier_name", "supplier_gstin", "invoice_number", "invoice_date", d("taxable_value"), d("tax"), d("invoice_value"), "hsn", joined("flags").alias("flags"))


@query("""WITH r AS (SELECT o_custkey AS file_id, o_orderkey AS row_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT file_id, c_name AS filename, row_id, n AS row_count FROM r JOIN customer ON c_custkey = file_id WHERE i <= 3 OR (n > 6 AND i > n - 3)""")
def preview_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last rows of each file, with its name."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("row_id"))
    shown = reports.preview(rows, ["file_id"], ["row_id"], 3)
    return shown.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.col("c_name").alias("filename")), "file_id").select("file_id", "filename", "row_id", "row_count")


TYPED = f"typed AS (SELECT okey, skey, gstin, CASE WHEN okey % 10 = 0 THEN 'CDN' WHEN okey % 10 = 1 THEN 'DN' WHEN okey % 10 = 2 THEN 'HSN' ELSE 'B2B' END AS document_type, {flags_sql('gstin')} AS flag, date_trunc('month', day)::DATE AS month FROM inv)"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("okey") % 10
    return inv(spark, sf_dir).select("okey", "skey", "gstin", F.when(k == 0, "CDN").when(k == 1, "DN").when(k == 2, "HSN").otherwise("B2B").alias("document_type"), F.lit("T").alias("trade_name"), F.lit("f.json#2b").alias("source"), identifiers.gstin_flags("gstin").alias("flags"), F.trunc("day", "month").alias("month"))


@query(f"WITH {INV}, {TYPED} SELECT okey, skey, CASE document_type WHEN 'HSN' THEN 'hsn' WHEN 'CDN' THEN 'cdn' ELSE 'b2b' END AS section FROM typed UNION ALL SELECT okey, skey, 'flagged' FROM typed WHERE flag <> ''")
def split_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return rows to overlapping sheets."""
    return reports.sections(_typed(spark, sf_dir)).select("okey", "skey", "section")


@query(f"WITH {INV}, {TYPED} SELECT month, count(*) FILTER (document_type IN ('B2B', 'DN')) AS b2b_rows, count(*) FILTER (document_type = 'CDN') AS cdn_rows, count(*) FILTER (document_type = 'HSN') AS hsn_rows, count(*) FILTER (flag <> '') AS flagged_rows, count(*) AS total_rows FROM typed GROUP BY month")
def cover_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts on a return's cover, by month."""
    return reports.cover(_typed(spark, sf_dir), ["month"])


@query("""WITH o AS (SELECT o_custkey AS pack, CASE o_orderstatus WHEN 'F' THEN 'bank' WHEN 'O' THEN 'purchase' ELSE 'sales' END AS k, count(*) AS n FROM orders GROUP BY ALL)
SELECT pack, sum(n)::BIGINT AS total_rows, '{"outputs":[' || string_agg('{"key":"' || k || '","label":"' || upper(k) || '","rows":' || n || ',"status":"ready"}', ',' ORDER BY k) || '],"total_rows":' || sum(n)::BIGINT || '}' AS summary FROM o GROUP BY pack""")
def pack_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pack's outputs as one JSON text."""
    s = F.col("o_orderstatus")
    out = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("pack"), F.when(s == "F", "bank").when(s == "O", "purchase").otherwise("sales").alias("key")).agg(F.count("*").alias("rows"))
    return reports.pack_summary(out.select("pack", "key", F.upper("key").alias("label"), "rows", F.lit("ready").alias("status")), ["pack"])


@query(CHECKED + " , b AS (SELECT file_id, bool_and(NOT coalesce(abs(expected - balance) > 100, false)) AS ok, count(*) AS n FROM e GROUP BY file_id) SELECT (file_id % 50)::BIGINT AS pack, CASE WHEN bool_and(ok) THEN 'match' ELSE 'mismatch' END AS balance_status, count(*) AS files, sum(n)::BIGINT AS total_rows FROM b GROUP BY pack")
def pack_balance_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack matches if all of its statements do."""
    checked, files = _checked(spark, sf_dir)
    summary = bank.balance_summary(checked, files.withColumn("stated_closing", F.lit(None).cast(money.MONEY)))
    return reports.bank_status(summary.withColumn("pack", F.col("file_id") % 50), ["pack"])


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key, without a sort."""
    return reports.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("""SELECT d.doc_id AS file_id, CASE WHEN l.kind IS NOT NULL AND l.kind <> d.lang THEN l.kind END AS override_kind, coalesce(CASE WHEN l.kind <> d.lang THEN l.kind END, d.lang) AS kind FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN max(quality) = 1 THEN 'en' ELSE 'bank' END AS kind FROM labels GROUP BY doc_id) l USING (doc_id)""")
def override_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices put over what was detected; the same choice is none."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("lang").alias("detected_kind"), F.lit("auto").alias("classify_reason"), F.lit(0.9).alias("confidence"))
    choices = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.when(F.max("quality") == 1, "en").otherwise("bank").alias("kind")).withColumnRenamed("doc_id", "file_id")
    return classify.review_columns(classify.override(files, choices)).select("file_id", "override_kind", "kind")


@query("SELECT min(page_id) AS page_id, lower(path) AS key, arg_min(path, page_id) AS path FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN upper(split_part(url, '?', 1)) ELSE split_part(url, '?', 1) END AS path FROM pages) GROUP BY lower(path)")
def dup_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that differ in case only, once."""
    p = F.substring_index("url", "?", 1)
    paths = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.upper(p)).otherwise(p).alias("path"))
    return reports.first_seen(paths, "path", ["page_id"]).select("page_id", F.lower("path").alias("key"), "path")


@query("""WITH b AS (SELECT p_partkey AS k, (p_partkey * 37 % 600)::DOUBLE AS x, (p_partkey * 53 % 850)::DOUBLE AS y, (p_partkey % 90 - 5)::DOUBLE AS w, (p_partkey % 23)::DOUBLE AS h FROM part),
c AS (SELECT *, greatest(0.0, x - 8) AS x0, greatest(0.0, y - 8) AS y0, least(595.0, x + w + 8) AS x1, least(842.0, y + h + 8) AS y1 FROM b),
d AS (SELECT *, greatest(0, least(1190, floor(x0 * 2.0)::INT)) AS l, greatest(0, least(1190, ceil(x1 * 2.0)::INT)) AS r, greatest(0, least(1684, floor((842 - y1) * 2.0)::INT)) AS t, greatest(0, least(1684, ceil((842 - y0) * 2.0)::INT)) AS bt FROM c),
e AS (SELECT *, w > 0 AND h > 0 AND x1 > x0 AND y1 > y0 AND r - l >= 1 AND bt - t >= 1 AS ok FROM d)
SELECT k AS p_partkey, CASE WHEN ok THEN l ELSE 0 END AS "left", CASE WHEN ok THEN t ELSE 0 END AS top, CASE WHEN ok THEN r ELSE 1190 END AS "right", CASE WHEN ok THEN bt ELSE 562 END AS bottom FROM e""")
def pixel_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on a page to pixels of its image."""
    k = F.col("p_partkey")
    box = geometry.box_text(k * 37 % 600, k * 53 % 850, k % 90 - 5, k % 23)
    crop = geometry.pixel_box(box, F.lit(595.0), F.lit(842.0), F.lit(1190), F.lit(1684), F.lit(2.0))
    return table(spark, sf_dir, "part").select("p_partkey", crop.alias("c")).select("p_partkey", "c.*")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = inv(spark, sf_dir)
    k = F.col("okey")
    mine = df.where(k % 11 != 0).select("gstin", "invoice_number", F.date_format("day", "dd-MM-yyyy").alias("invoice_date"), rupees(F.col("value")).alias("invoice_value"))
    theirs = df.where(k % 13 != 0).select(F.lower("gstin").alias("gstin"), F.replace("invoice_number", F.lit("/"), F.lit(" ")).alias("invoice_number"), F.date_format("day", "yyyy-MM-dd").alias("invoice_date"), rupees(F.col("value") + F.when(k % 17 == 0, 500).when(k % 17 == 1, 100).when(k % 17 == 2, 101).otherwise(0)).alias("invoice_value"))
    return mine, theirs


SIDES = "s AS (SELECT *, gstin AS k_gstin, 'INV' || okey || skey AS k_invoice, strftime(day, '%Y-%m-%d') AS k_date, value + CASE okey % 17 WHEN 0 THEN 500 WHEN 1 THEN 100 WHEN 2 THEN 101 ELSE 0 END AS other FROM inv)"


@query(f"""WITH {INV}, {SIDES}, b AS (SELECT k_gstin, k_invoice, k_date, max(value) AS v FROM s WHERE okey % 11 <> 0 GROUP BY ALL), p AS (SELECT k_gstin, k_invoice, k_date, max(other) AS v FROM s WHERE okey % 13 <> 0 GROUP BY ALL)
SELECT k_gstin, k_invoice, k_date, b.v / 100.0::DOUBLE AS books_value, p.v / 100.0::DOUBLE AS portal_value, (b.v - p.v) / 100.0::DOUBLE AS gap, CASE WHEN p.v IS NULL THEN 'books_only' WHEN b.v IS NULL THEN 'portal_only' WHEN abs(b.v - p.v) <= 100 THEN 'matched' ELSE 'amount_mismatch' END AS status FROM b FULL JOIN p USING (k_gstin, k_invoice, k_date)""")
def recon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books against portal, to within one rupee."""
    return recon.reconcile(*_sides(spark, sf_dir))


@query(f"""WITH {INV}, r AS (SELECT okey, skey, gstin, skey % 100 AS no FROM inv), n AS (SELECT gstin, no, count(*) AS n FROM r GROUP BY ALL) SELECT okey, skey, n > 1 AS possible_duplicate FROM r JOIN n USING (gstin, no)""")
def possible_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose identifier, number and date come again."""
    rows = inv(spark, sf_dir).select("okey", "skey", "gstin", F.concat(F.lit("A-"), F.col("skey") % 100).alias("invoice_number"), F.lit("2025-04-01").alias("invoice_date"))
    return recon.duplicates(rows).select("okey", "skey", "possible_duplicate")


@query(f"""WITH {INV}, i AS (SELECT okey * 1000003 + skey AS id, day, value AS cents, CASE WHEN okey % 4 = 0 THEN 'in' ELSE 'out' END AS dir, supplier_name AS name FROM inv), b AS (SELECT id AS bank_id, day + (id % 10)::INT AS b_day, cents + CASE WHEN id % 5 = 0 THEN 60 ELSE 0 END AS b_cents, 'out' AS b_dir, upper(left(name, 12)) || ' LTD' AS b_name FROM i WHERE id % 3 <> 0),
m AS (SELECT bank_id, id AS invoice_id, (70 + CASE WHEN dir = b_dir THEN 10 ELSE 0 END + floor(20 * (1.0 - levenshtein(lower(trim(name)), lower(trim(b_name))) / greatest(length(trim(name)), length(trim(b_name)))::DOUBLE)))::INT AS score FROM b JOIN i ON cents BETWEEN b_cents - 100 AND b_cents + 100 AND abs(day - b_day) <= 7)
SELECT bank_id, invoice_id, score, CASE WHEN score >= 90 THEN 'auto' WHEN score >= 70 THEN 'likely' ELSE 'possible' END AS grade FROM (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY score DESC, invoice_id) AS i FROM m) WHERE i = 1""")
def scored_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best invoice of each bank row."""
    i = inv(spark, sf_dir).select((F.col("okey") * 1000003 + F.col("skey")).alias("invoice_id"), "day", F.col("value").alias("cents"), F.when(F.col("okey") % 4 == 0, "in").otherwise("out").alias("direction"), F.col("supplier_name").alias("name"))
    k = F.col("invoice_id")
    b = i.where(k % 3 != 0).select(k.alias("bank_id"), F.date_add("day", (k % 10).cast("int")).alias("day"), (F.col("cents") + F.when(k % 5 == 0, 60).otherwise(0)).alias("cents"), F.lit("out").alias("direction"), F.concat(F.upper(F.substring("name", 1, 12)), F.lit(" LTD")).alias("name"))
    return recon.score_matches(b, i)


@query("""WITH k AS (SELECT o_orderkey AS k FROM orders) SELECT k AS invoice_number, k % 3 <> 0 AS in_return, k % 4 <> 0 AS in_bank, k % 5 <> 0 AS in_books, CASE WHEN k % 3 <> 0 AND k % 4 <> 0 AND k % 5 <> 0 THEN 'consistent' ELSE 'missing in ' || array_to_string(list_filter([CASE WHEN k % 3 = 0 THEN 'return' ELSE '' END, CASE WHEN k % 4 = 0 THEN 'bank' ELSE '' END, CASE WHEN k % 5 = 0 THEN 'books' ELSE '' END], lambda x: x <> ''), '+') END AS label FROM k WHERE NOT (k % 3 = 0 AND k % 4 = 0 AND k % 5 = 0)""")
def presence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of return, bank and books has each invoice."""
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice_number"))
    return recon.presence({n: k.where(F.col("invoice_number") % m != 0) for n, m in (("return", 3), ("bank", 4), ("books", 5))}, "invoice_number")


@query("""WITH m AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate)::DATE AS month FROM orders), s AS (SELECT o_custkey, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM m GROUP BY o_custkey) SELECT o_custkey, month FROM s ANTI JOIN m USING (o_custkey, month)""")
def missing_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps in each account's months."""
    return recon.missing_months(table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")), "o_custkey", "day")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 <> 3 THEN o_orderdate::DATE < DATE '1994-01-01' OR o_orderdate::DATE > DATE '1996-12-31' END, false) AS flagged FROM orders")
def date_out_of_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates outside a period, in four forms; text that is no date isn't flagged."""
    k, day = F.col("o_orderkey") % 4, F.to_date("o_orderdate")
    raw = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "dd/MM/yyyy")).when(k == 2, F.date_format(day, "dd-MM-yyyy")).otherwise("31/31/2025")
    flagged = dates.out_of_period(raw, F.lit("1994-01-01").cast("date"), F.lit("1996-12-31").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", flagged.alias("flagged"))


@query(f"WITH {INV}, {SIDES} SELECT gstin, invoice_number FROM s WHERE okey % 11 = 0")
def missing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without an invoice document."""
    df = inv(spark, sf_dir).select("okey", "gstin", "invoice_number", F.date_format("day", "yyyy-MM-dd").alias("invoice_date"))
    return recon.missing_documents(df, df.where("okey % 11 <> 0")).select("gstin", "invoice_number")


@query("SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS files, count(*) > 100 AS over FROM events GROUP BY ALL")
def monthly_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a month against the plan."""
    return recon.monthly_quota(table(spark, sf_dir, "events"), "user_id", "ts")


@query("""WITH f AS (SELECT o_custkey AS pack_id, o_orderkey AS file_id, 'Bank: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'A*B statement of account 2025' ELSE 'x' END || '.pdf' AS name FROM orders), c AS (SELECT *, trim(substr(regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '[\\[\\]*?:/\\\\]', ' ', 'g'), 1, 28), ' ') AS clean FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY pack_id, clean ORDER BY file_id) AS i FROM c) SELECT pack_id, file_id, CASE WHEN i = 1 THEN clean ELSE substr(clean, 1, 26) || '_' || i END AS sheet FROM n""")
def sheet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a workbook's sheets, each once."""
    k = F.col("o_orderkey")
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pack_id"), k.alias("file_id"), F.concat(F.lit("Bank: "), F.when(k % 3 == 0, "A*B statement of account 2025").otherwise("x"), F.lit(".pdf")).alias("name"))
    return reports.sheet_names(files).select("pack_id", "file_id", "sheet")


@query("SELECT user_id, event_type, count(*) AS n, sum(floor(abs(value) * 100 + 0.5)::BIGINT)::BIGINT AS paise FROM events GROUP BY ALL")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken in as a stream of files that stops when none is left; the table it wrote, summed up."""
    place = f"{shared_place(spark)}/stream/{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    change = lambda df: df.select("user_id", "event_type", F.floor(F.abs("value") * 100 + 0.5).cast("long").alias("paise"))
    rows = run_available(spark, sf_dir, schema, "events.parquet", change, f"{place}/table", f"{place}/log")
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("paise").alias("paise"))
