import io
import zipfile
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import bank, books, classify, gst, invoice, recon, reports
from ledgerloom.plans import period
from ledgerloom.sources import containers, files
from ledgerloom.streaming import ingest

LINE = "file_id long, line_no int, page int, text string, x double, y double, width double, height double"
STATEMENT = ["Opening Balance 1,000.00", "01/04/2025 NEFT IN ACME deposit 500.00 1,500.00", "02/04/2025 ATM WDL 200.00 1,300.00", "Ref ABC more text", "03/04/2025 SALARY 100.00 9,999.00", "04/04/2025 UPI 50.00 1,350.00", "Closing Balance 1,350.00", "Page 3", "12,3 4.5"]


def lines(spark, *texts, file_id=1):
    return spark.createDataFrame([(file_id, i, 1, t, 1.0, 2.0, 3.0, 4.0) for i, t in enumerate(texts, 1)], LINE)


def test_statement(spark):
    rows, rejected = bank.transactions(lines(spark, *STATEMENT), spark.createDataFrame([(1, "s.pdf")], "file_id long, name string"))
    got = {r["row_no"]: r for r in rows.collect()}
    assert [(got[i]["debit"], got[i]["credit"], got[i]["balance"]) for i in (1, 2, 3)] == [(None, Decimal("500.00"), Decimal("1500.00")), (Decimal("200.00"), None, Decimal("1300.00")), (None, Decimal("50.00"), Decimal("1350.00"))]
    assert got[1]["description"] == "NEFT IN ACME deposit 1," and got[1]["source"] == "s.pdf#p1@1.0,2.0,3.0,4.0" and got[1]["date"] == "2025-04-01"
    assert got[2]["description"] == "ATM WDL Ref ABC more text 03/04/2025 SALARY 100.00 9,999.00"
    assert [r["txt"] for r in rejected.collect()] == [STATEMENT[4]]
    context = bank.statement_context(lines(spark, *STATEMENT), spark.createDataFrame([(1, "s.pdf")], "file_id long, name string"))
    checked = bank.running_check(rows, context)
    summary = bank.balance_summary(checked, context).first()
    assert (summary["opening_balance"], summary["stated_closing"], summary["status"], summary["row_count"], summary["flags"]) == (1000.0, 1350.0, "match", 3, [])


def test_profiles_and_header(spark):
    df = spark.createDataFrame([("x_SBI_apr.pdf", "hdfc bank"), ("a.pdf", "Welcome to ICICI"), ("a.pdf", "nothing")], "n string, h string")
    assert [r[0] for r in df.select(bank.profile(F.col("n"), F.col("h"))).collect()] == ["sbi", "icici", "generic"]
    head = lines(spark, "HDFC Bank", "Account No: 123456789012", "IFSC HDFC0001234", "Opening balance nil")
    c = bank.statement_context(head, spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf")], "file_id long, name string")).orderBy("file_id").collect()
    assert (c[0]["profile"], c[0]["account_number"], c[0]["ifsc"], c[0]["opening"], c[1]["profile"]) == ("hdfc", "123456789012", "HDFC0001234", None, "generic")


ROW = "file_id long, row_no int, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2)"


def checked(spark, rows, opening, closing=None):
    df = spark.createDataFrame([(1, i, *(None if v is None else Decimal(str(v)) for v in r)) for i, r in enumerate(rows, 1)], ROW)
    money = lambda v: None if v is None else Decimal(str(v))
    info = spark.createDataFrame([(1, money(opening), money(closing))], "file_id long, opening decimal(18,2), stated_closing decimal(18,2)")
    out = bank.running_check(df, info)
    summary = bank.balance_summary(out, info)
    return [r["flags"] for r in bank.stamp_closing(out, summary).orderBy("row_no").collect()], summary.first()


def test_balance_cases(spark):
    flags, s = checked(spark, [(None, 100, 1100), (50, None, None), (None, 10, 1060), (5, None, 1000), (None, 1, 1001)], 1000)
    assert flags == [[], ["missing_balance"], [], ["balance_mismatch"], []] and (s["broken_at_row"], s["status"]) == (4, "mismatch")
    assert checked(spark, [], None)[1]["match"] and checked(spark, [], None)[1]["parse_outcome"] == "empty"
    assert checked(spark, [(None, 5, 105), (None, 5, None)], 100)[1]["computed_closing"] == 0.0
    assert checked(spark, [(None, 5, 106)], 100)[0] == [[]] and checked(spark, [(None, 5, "106.01")], 100)[0] == [["balance_mismatch"]]
    flags, s = checked(spark, [(None, 5, 105)], 100, 200)
    assert flags == [["closing_mismatch"]] and s["flags"] == ["closing_mismatch"]
    assert checked(spark, [(None, 5, 105)], None)[1]["opening_balance"] == 100.0


def loop_check(rows, opening):
    running = Decimal(opening) if opening is not None else (rows[0][2] or 0) + (rows[0][0] or 0) - (rows[0][1] or 0)
    out = []
    for debit, credit, balance in rows:
        running = running - (debit or 0) + (credit or 0)
        out.append(["missing_balance"] if balance is None else ["balance_mismatch"] if abs(running - balance) > 1 else [])
        running = running if balance is None else balance
    return out


amount = st.one_of(st.none(), st.decimals(min_value=0, max_value=3, places=2))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(amount, amount, amount), min_size=1, max_size=25), st.one_of(st.none(), st.integers(0, 3)))
def test_window_is_the_sequential_loop(spark, rows, opening):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], ROW)
    info = spark.createDataFrame([(1, None if opening is None else Decimal(opening))], "file_id long, opening decimal(18,2)")
    assert [r["flags"] for r in bank.running_check(df, info).orderBy("row_no").collect()] == loop_check(rows, opening)


def test_line_bands(spark):
    items = spark.createDataFrame([(1, 1, "b", 50.0, 101.0, 10.0, 5.0, 10.0), (1, 1, "a", 10.0, 100.0, 10.0, 5.0, 10.0), (1, 1, "c", 5.0, 80.0, 4.0, 5.0, 10.0), (1, 1, " ", 0.0, 80.0, 1.0, 1.0, 1.0), (1, 2, "d", 1.0, 9.0, 1.0, 1.0, 1.0)], "file_id long, page int, text string, x double, y double, width double, height double, font_size double")
    got = bank.group_lines(items).orderBy("line_no").collect()
    assert [(r["page"], r["text"], r["x"], r["y"], r["width"], r["height"]) for r in got] == [(1, "a b", 10.0, 100.0, 50.0, 6.0), (1, "c", 5.0, 80.0, 4.0, 5.0), (2, "d", 1.0, 9.0, 1.0, 1.0)]


INVOICE = "Supplier GSTIN: 27AAPFU0939F1ZV\nInvoice No: INV/25-001\nDate 05/04/2025\nHSN: 84713\nTaxable Value: 1,000.00\nCGST 90.00\nSGST 90.00\nGrand Total: 1,200.00"


def test_invoice(spark):
    docs = spark.createDataFrame([(1, INVOICE), (2, "Hello, total 5.00"), (3, "invoice no ABC-9\nsupplier: M/s Blue Ink Co.\ninvoice total tax 7.00\ntotal tax: 5.00 due 100.00"), (4, None)], "file_id long, text string")
    got = {r["file_id"]: r for r in invoice.invoices(docs).collect()}
    r = got[1]
    assert (r["tax"], r["invoice_date"], r["flags"], r["invoice_value"], r["hsn"]) == (Decimal("180.00"), "2025-04-05", ["hsn_length", "invoice_math"], Decimal("1200.00"), "84713")
    assert set(got) == {1, 3} and got[3]["tax"] == Decimal("5.00") and got[3]["supplier_name"] == "Blue Ink Co."
    placed = invoice.locate_fields(invoice.invoices(docs.where("file_id = 1")), lines(spark, *INVOICE.split("\n"))).first()["fields"]
    assert {k: v["page"] for k, v in placed.items()} == dict.fromkeys(("supplier_gstin", "invoice_number", "taxable_value", "tax", "invoice_value"), 1)


def test_fields_are_found_in_the_lines_of_a_row(spark):
    table = lines(spark, *INVOICE.split("\n"))
    own = [tuple(r[c] for c in invoice.LINE) for r in table.collect()]
    kind = "file_id long, text string, lines array<struct<line_no:int,page:int,text:string,x:double,y:double,width:double,height:double>>"
    docs = spark.createDataFrame([(1, INVOICE, own), (2, "Invoice No: ABC-9", [])], kind)
    placed = invoice.locate_fields(invoice.invoices(docs))
    got = {r["file_id"]: r["fields"] for r in placed.collect()}
    assert got[1] == invoice.locate_fields(invoice.invoices(docs.drop("lines").where("file_id = 1")), table).first()["fields"] and len(got[1]) == 5
    assert got[2] is None and "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()


def test_classification(spark):
    rows = [("/d/GSTR-2B_apr.json", "{}"), ("x.json", '{"data":{"docdata":{}}}'), ("x.json", '{"sup_details":{}}'), ("x.json", '{"b2cs":[]}'), ("x.json", "[1]"), ("x.json", "nope"), ("x.json", '{"a":null}'), ("books.csv", None), ("e.xml", "<A><VOUCHER/></A>"), ("a.docx", None), ("i.png", None), ("inv.png", None)]
    got = [(r["k"], r["c"]) for r in classify.classify(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, path string, content string")).select("i", F.col("verdict.kind").alias("k"), F.col("verdict.confidence").alias("c")).orderBy("i").collect()]
    assert got == [("gstr_2b", 0.95), ("gstr_2b", 0.92), ("gstr_3b", 0.92), ("gstr_1", 0.9), ("unknown", 0.2), ("unknown", 0.2), ("unknown", 0.35), ("zoho", 0.8), ("tally", 0.9), ("unknown", 0.2), ("unknown", 0.4), ("invoice", 0.6)]
    pdf = spark.createDataFrame([(0, "s.pdf", "text", 3, ["narration", "cheque"]), (1, "s.pdf", "text", 1, ["Tax Invoice", "HSN"]), (2, "gst18.pdf", "text", 1, ["x"]), (3, "s.pdf", "encrypted", 1, ["x"]), (4, "invoice.pdf", "scanned", 1, ["opening balance narration deposit"])], "i int, path string, pdf_type string, pages int, page_texts array<string>")
    assert [tuple(r)[1:] for r in classify.classify(pdf).select("i", "verdict.kind", "verdict.confidence").orderBy("i").collect()] == [("bank", 0.9), ("invoice", 0.85), ("gstr_1", 0.75), ("unknown", 0.5), ("invoice", 0.55)]


def test_override_and_admit(spark):
    stored = spark.createDataFrame([(1, "bank", "auto", 0.9), (2, "bank", "auto", 0.9)], "file_id long, detected_kind string, classify_reason string, confidence double")
    got = classify.review_columns(classify.override(stored, spark.createDataFrame([(1, "invoice"), (2, "bank")], "file_id long, kind string"))).orderBy("file_id").collect()
    assert [(r["override_kind"], r["kind"]) for r in got] == [("invoice", "invoice"), (None, "bank")]
    new = spark.createDataFrame([("Acme ",), ("Beta",)], "name string")
    assert [r["name"] for r in classify.admit(new, spark.createDataFrame([("acme",)], "name string"), ["name"]).collect()] == ["Beta"]


def parsed(spark, *contents):
    return gst.parse(spark.createDataFrame([(i, f"f{i}.json", c) for i, c in enumerate(contents)], "file_id long, name string, content string"))


def test_returns(spark):
    doc = '{"gstin":"X","data":{"docdata":{"b2b":["odd",{"ctin":"27AAPFU0939F1ZV","trdnm":"T","inv":["odd",{"inum":"A","dt":"1-4-2025","val":118,"itms":[{"itm_det":{"txval":"1,00.5","iamt":18}},{"txval":1},7]}]},{"ctin":"z","inum":"SELF","txval":5,"iamt":1}],"cdnr":[{"ctin":"27AAPFU0939F1ZV","nt":[{"ntnum":"N","ntty":"D"}],"inv":[{"ntnum":"M"}]}]}}}'
    got = sorted((tuple(r) for r in gst.purchase_return(parsed(spark, doc, "[1]", "{bad", '﻿{"b2b":[{"inum":"R"}]}')).select("file_id", "invoice_number", "taxable", "igst", "document_type", "source").collect()), key=str)
    assert got == sorted([(0, "A", 101.5, 18.0, "B2B", "f0.json#2b.b2b[0].inv[0]"), (0, "SELF", 5.0, 1.0, "B2B", "f0.json#2b.b2b[1].inv[0]"), (0, "N", None, None, "DN", "f0.json#2b.cdnr[0].nt[0]"), (0, "M", None, None, "CDN", "f0.json#2b.cdnr[0].nt[1]"), (3, "R", None, None, "B2B", "f3.json#2b.b2b[0].inv[0]")], key=str)
    one = '{"b2b":[{"ctin":"c","inv":[{"inum":"1"}]}],"b2ba":[{"ctin":"c","inv":[{"inum":"2"}]}],"cdnra":[{"ctin":"c","nt":[{"nt_num":"3"}]}],"hsn":{"data":[{"hsn_sc":"8471","txval":9}]},"b2cs":[1]}'
    rows = {r["invoice_number"]: r for r in gst.sales_return(parsed(spark, one)).collect()}
    assert {k: r["document_type"] for k, r in rows.items()} == {"1": "B2B", "2": "B2BA", "3": "CDN", "8471": "HSN"} and rows["8471"]["taxable"] == 9.0
    assert gst.unparsed_sections(parsed(spark, one), "gstr_1").first()["sections"] == ["b2cs"]
    three = '{"sup_details":{"osup_det":{"txval":1},"osup_zero":5},"itc_elg":{"itc_avl":[{"ty":"IMPG","iamt":2},{}]},"inward_sup":{"isup_details":[{"ty":"GST","inter":1,"intra":"2"}]}}'
    got = {r["section"]: (r["taxable"], r["igst"]) for r in gst.summary_return(parsed(spark, three)).collect()}
    assert got == {"Outward taxable (other than zero rated)": (1.0, None), "ITC available: IMPG": (None, 2.0), "ITC available": (None, None), "Inward supplies: GST": (3.0, None)}
    assert [r["section"] for r in gst.summary_return(parsed(spark, "{}")).collect()] == [gst.EMPTY_SUMMARY]


VOUCHER = '<ENVELOPE xmlns:t="u"><t:Voucher VCHTYPE="{}"><DATE>20250401</DATE><VOUCHERNUMBER>7</VOUCHERNUMBER><PARTYLEDGERNAME>P</PARTYLEDGERNAME>{}</t:Voucher></ENVELOPE>'


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("_", "."), data)
    return out.getvalue()


def test_vouchers(spark):
    kinds = {"Purchase": "purchase", "Debit Note": "purchase", "Sales": "sales", "Credit Note": "sales", "GST Purchase": "other", "Journal": "other"}
    rows = [(i, "e.xml", VOUCHER.format(k, "<E><AMOUNT>-118.00</AMOUNT></E>").encode()) for i, k in enumerate(kinds)] + [(9, "bad.xml", b"<a>"), (10, "none.xml", None)]
    got = books.voucher_rows(containers.voucher_elements(spark.createDataFrame(rows, "file_id long, source string, content binary"))).orderBy("file_id").collect()
    assert [r["register"] for r in got] == list(kinds.values()) and {(r["invoice_value"], r["invoice_date"], r["invoice_number"]) for r in got} == {(118.0, "2025-04-01", "7")}
    packed = spark.createDataFrame([(1, archive(a_xml=VOUCHER.format("Sales", ""), b_TXT=VOUCHER.format("Sales", ""), c_bin=b"\0")), (2, b"no zip")], "file_id long, content binary")
    assert sorted(r["member"] for r in containers.zip_members(packed).collect()) == ["a.xml", "b.TXT"]
    assert {r["file_id"]: r["samples"] is not None for r in containers.archive_samples(packed).collect()} == {1: True, 2: False}


def test_sheets(spark):
    text = "﻿Invoice Date,Invoice Number,Customer Name,SubTotal,Item Tax %,Total,Total\n2025/4/1,A1,Acme,\"₹1,000\",18,x,1180\n12-Apr-2025,A2,B,1,,,2\n,,,,,,\n"
    book = containers.workbook([("One & two", ["Bill Date", "Bill Number", "Vendor Name", "Sub Total", "Tax Amount"], [["1-4-2025", "B1", "V", 10, 1.8], [None, "B2", "<x>", None, None]])])
    rows = [(1, "z.csv", ".csv", text.encode()), (2, "z.xlsx", ".xlsx", book), (3, "z.xlsx", ".xlsx", b"junk"), (4, "z.xls", ".xls", b"junk"), (5, "z.csv", ".csv", b"\xff\xfe")]
    got = {r["invoice_number"]: r for r in books.sheet_rows(containers.sheet_records(spark.createDataFrame(rows, "file_id long, name string, suffix string, content binary"))).collect()}
    assert set(got) == {"A1", "A2", "B1", "B2"}
    assert (got["A1"]["register"], got["A1"]["tax"], got["A1"]["invoice_date"], got["A1"]["invoice_value"]) == ("sales", 180.0, "2025-04-01", 1180.0)
    assert got["A2"]["invoice_date"] is None and got["A2"]["flags"] == ["bad_date"] and got["B1"]["register"] == "purchase" and got["B1"]["tax"] == 1.8 and got["B2"]["supplier_name"] == "<x>"


def test_registers(spark):
    null = F.lit(None).cast("string")
    v = spark.createDataFrame([("other", "GST Purchase", "P", 1.0), ("other", "Journal", "Q", 2.0), ("sales", "Sales", "R", 3.0)], "register string, voucher_type string, supplier_name string, invoice_value double")
    v = v.select("*", *[null.alias(c) for c in ("supplier_gstin", "invoice_number", "invoice_date", "hsn", "source")], F.lit(None).cast("double").alias("taxable_value"), F.lit(None).cast("double").alias("tax"), F.array().cast("array<string>").alias("flags"))
    s = v.where("false").drop("voucher_type")
    got = {r["supplier_name"]: r["register"] for r in books.registers(v.where("false").drop("register", "voucher_type"), v, s).collect()}
    assert got == {"P": "purchase", "Q": None, "R": "sales"}


def test_reconciliation(spark):
    kind = "gstin string, invoice_number string, invoice_date string, invoice_value double"
    b = spark.createDataFrame([("g", "A/1", "05-04-2025", 100.0), ("g", "2", "05-04-2025", 100.0), ("g", "3", "05-04-2025", 100.0), ("g", "4", "05-04-2025", 100.0), ("g", "5", "05-04-2025", 9.0), ("g", "5", "05-04-2025", 10.0), (None, None, None, 1.0)], kind)
    p = spark.createDataFrame([("G", "a1", "2025-04-05", 100.99), ("g", "02", "2025-04-05", 101.0), ("g", "3", "2025-04-05", 101.01), ("g", "9", "2025-04-05", 1.0), ("g", "5", "2025-04-05", 10.0)], kind)
    got = {r["k_invoice"]: r["status"] for r in recon.reconcile(b, p).collect()}
    assert got == {"A1": "matched", "2": "matched", "3": "amount_mismatch", "4": "books_only", "5": "matched", "": "books_only", "9": "portal_only"}
    assert [r["possible_duplicate"] for r in recon.duplicates(b).orderBy("invoice_number", "invoice_value").collect()].count(True) == 2


def test_reports(spark):
    rows = spark.createDataFrame([(f, i) for f, n in ((1, 5), (2, 12), (3, 17)) for i in range(n)], "file_id long, row_id long")
    got = {f: sorted(r["row_id"] for r in reports.preview(rows, ["file_id"], ["row_id"], 8).collect() if r["file_id"] == f) for f in (1, 2, 3)}
    assert got == {1: list(range(5)), 2: list(range(8)), 3: [*range(8), *range(9, 17)]}
    red = spark.createDataFrame([(["gstin_missing"],), (["invoice_math"],), (None,)], "flags array<string>")
    assert [r[0] for r in red.select(reports.is_red(F.col("flags"))).collect()] == [False, True, False]
    assert reports.project(red.withColumn("supplier_name", F.lit("x")), reports.PURCHASES).columns == list(reports.PURCHASES)


def test_dump_folder(spark, tmp_path):
    (tmp_path / "d" / "__MACOSX").mkdir(parents=True)
    for name, data in {"a.json": '{"b2b":[]}', "A.JSON2": "x", "e.xml": "<VOUCHER/>", ".hidden": "x", "__MACOSX/a.json": "x"}.items():
        (tmp_path / "d" / name).write_text(data)
    assert sorted(r["name"] for r in files.scan(spark, str(tmp_path / "d")).collect()) == ["A.JSON2", "a.json", "e.xml"]
    run = lambda: ingest.ingest_folder(spark, str(tmp_path / "d"), str(tmp_path / "table"), str(tmp_path / "log")).awaitTermination()
    run()
    (tmp_path / "d" / "late.csv").write_text("Invoice Number\n1")
    run()
    run()
    got = {r["name"]: (r["detected_kind"], r["batch"]) for r in spark.read.parquet(str(tmp_path / "table")).collect()}
    assert got == {"a.json": ("gstr_1", 0), "A.JSON2": ("unknown", 0), "e.xml": ("tally", 0), "late.csv": ("zoho", 1)}


def test_period(spark, tmp_path):
    rows = [(1, "s.pdf", ".pdf", "bank", None), (2, "i.pdf", ".pdf", "invoice", None), (3, "e.xml", ".xml", "tally", VOUCHER.format("Sales", "<AMOUNT>5</AMOUNT>").encode()), (4, "t.zip", ".zip", "tally", archive(a_xml=VOUCHER.format("Purchase", ""), b_xml=VOUCHER.format("Sales", ""))), (5, "r.json", ".json", "gstr_2b", b'{"b2b":[{"ctin":"c","inv":[{"inum":"1"}]}]}'), (6, "b.json", ".json", "gstr_3b", b"{}"), (7, "z.csv", ".csv", "zoho", b"Bill Number,Total\nB,5\n"), (8, "u.bin", ".bin", "unknown", b""), (9, "empty.json", ".json", "gstr_2b", b"junk"), (10, "x.xls", ".xls", "zoho", b"x"), (11, "gone.xml", ".xml", "tally", None), (12, "bad.zip", ".zip", "tally", b"x"), (13, "none.csv", ".csv", "zoho", b"Bill Number\n"), (14, "big.csv", ".csv", "zoho", None)]
    stored = spark.createDataFrame(rows, "file_id long, name string, suffix string, kind string, content binary").withColumn("size_status", F.when(F.col("file_id") == 14, "oversize").otherwise("ok"))
    every = lines(spark, *STATEMENT).unionByName(lines(spark, *INVOICE.split("\n"), file_id=2))
    p = period.parse(stored, every)
    assert {r["file_id"]: (r["rows"], r["parse_outcome"]) for r in p.outcomes.collect()} == {1: (3, "processed"), 2: (1, "processed"), 3: (1, "processed"), 4: (2, "processed"), 5: (1, "processed"), 6: (1, "processed"), 7: (1, "processed"), 8: (0, "needs_review"), 9: (0, "failed"), 10: (0, "unsupported_xls"), 11: (0, "skipped"), 12: (0, "failed"), 13: (0, "empty"), 14: (0, "oversize")}
    assert {r["key"]: r["rows"] for r in period.outputs(p).collect()} == {"bank": 3, "purchase": 3, "sales": 2, "gstr_2b": 1, "gstr_3b": 1}
    for _ in range(2):
        period.write(p, 4, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "registers")).where("period_id = 4").count() == 5


def test_workbooks(spark):
    rows = spark.createDataFrame([(1, 1, "Cover", ["a"], 1, ["x"]), (1, 2, "Rows", ["b", "c"], 1, ["1", None]), (2, 1, "Empty", ["a"], 1, None)], "pack_id long, sheet_no int, sheet string, titles array<string>, row_no int, cells array<string>")
    got = {r["pack_id"]: bytes(r["content"]) for r in containers.workbooks(rows).collect()}
    assert containers.xlsx_records(got[1])[0][1] == [("a", "x")] and containers.xlsx_records(got[2]) == []


@pytest.mark.parametrize("bad", [b"", b"PK\x03\x04", b"\x00" * 50])
def test_malformed_contents_give_no_rows(bad):
    assert containers.members(bad) == [] and containers.xlsx_records(bad) == [] and containers.vouchers(bad) == []


def test_identifier_once_in_plan(spark):
    """An identifier that is an expression stands in the plan of its check only once, so a filter on the flags doesn't run it many times."""
    from ledgerloom.functions.identifiers import gstin_flags

    df = spark.range(3).select(gstin_flags(F.concat(F.lit("27AAPFU0939F1Z"), F.col("id").cast("string"), F.lit("marked"))).alias("flags"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("marked") == 1


def test_sheet_in_slices(spark, monkeypatch):
    """A sheet of one pack is numbered by several tasks, each with a slice, as one task would number it."""
    from ledgerloom.operators import reports

    monkeypatch.setattr(reports, "SLICE", 100)
    rows = spark.range(1_000).select(F.when(F.col("id") % 10 != 9, 1).otherwise(2).cast("long").alias("pack_id"), F.format_string("%05d", F.col("id") * 7919 % 1000).alias("source"), F.lit("n").alias("invoice_number"), F.lit(1.0).alias("invoice_value"))
    made = reports.register_pack(rows, "S", {"Source": "source"})
    got = [(r.pack_id, r.row_no, r.cells[0]) for r in made.collect()]
    want = [(p, i, s) for p in (1, 2) for i, s in enumerate(sorted(f"{k * 7919 % 1000:05d}" for k in range(1_000) if (k % 10 == 9) == (p == 2)), 1)]
    assert sorted(got) == want
    assert "Window [row_number" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_small_files_share_batches():
    """Many files with a row each are one batch, a voucher file that breaks off gives none, nested vouchers come in order."""
    import pyarrow as pa

    from ledgerloom.sources import containers

    batch = pa.RecordBatch.from_pydict({"file_id": list(range(100)), "content": [b"<V><VOUCHER VCHTYPE='a'><x:n xmlns:x='y'>1</x:n></VOUCHER></V>"] * 99 + [b"<V><VOUCHER/>"]})
    kinds = [pa.string(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.string())]
    made = list(containers._each(containers._vouchers, ["type", "child", "deep"], kinds)(iter([batch])))
    assert [m.num_rows for m in made] == [99]
    nested = b"<V><voucher VCHTYPE='a'><VOUCHER VCHTYPE='b'><N>1</N></VOUCHER><M>2</M></voucher></V>"
    import io

    assert containers.vouchers(nested) == list(containers.voucher_stream(io.BytesIO(nested)))


def test_returns_parsed_once(spark):
    """Contents of returns are parsed once for each kind of rows, whatever lies between them and the rows."""
    names = spark.range(4).select("id", F.lit("x").alias("name"))
    content = F.when(F.col("id") != 3, '{"b2b":[{"ctin":"c","inv":[{"inum":"1"}]}],"hsn":{"data":[{"hsn_sc":"7"}]}}').otherwise("junk")
    files = names.join(names.select("id"), "id").select(F.col("id").alias("file_id"), "name", content.alias("content"))
    parsed = gst.parse(files)
    times = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson")
    one = times(parsed.select("doc"))
    assert times(gst.purchase_return(parsed)) == one and times(gst.sales_return(parsed)) == 2 * one
    assert gst.purchase_return(parsed).count() == 3 and gst.sales_return(parsed).count() == 6


def test_workbooks_dealt_over_tasks(spark):
    """Making archives and workbooks from small tables is dealt over all tasks, not over as many as the tables have bytes for."""
    from ledgerloom.plans import file_queries

    for name in ("zip_vouchers", "sheet_dates"):
        made = getattr(file_queries, name)(spark, "/root/testdata/sf0.001").select("file_id", F.spark_partition_id().alias("task"))
        assert made.select("task").distinct().count() > 8, name


def test_counted_sheet_rows_are_not_made(spark):
    """Whether a record stays needs no flags or taxes of it; contents of a period's files are made once."""
    from ledgerloom.operators import books
    from ledgerloom.plans import whole_queries

    from .conftest import DATA

    given = [{"total": "5"}, {"total": "0", "date": " "}, {"date": "12-Apr-2025"}, {"date": "1/4/2025"}, {"tax %": "18", "sub total": "x"}, {"tax": "₹2"}, {"hsn": " 84 "}, {"sub total": "100", "tax %": "18", "gstin": "27AAPFU0939F1YV"}, {}]
    records = spark.createDataFrame([(i, "s", list(c), c) for i, c in enumerate(given)], "file_id long, source string, headers array<string>, cells map<string,string>")
    rows = books.sheet_rows(records)
    got = {r["file_id"]: (r["invoice_date"], r["tax"], r["hsn"], r["flags"]) for r in rows.collect()}
    assert got == {0: (None, None, None, []), 3: ("2025-04-01", None, None, []), 5: (None, 2.0, None, []), 6: (None, None, "84", []), 7: (None, 18.0, None, ["gstin_format"])}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "gstin_format" in plan(rows) and "gstin_format" not in plan(rows.select("file_id"))
    assert "l_orderkey" not in plan(whole_queries.whole_period_outcomes(spark, DATA))


def test_lines_of_statements_are_taken_apart_once(spark):
    """The fold, rows and rejected lines read what lines gave; none of them looks for amounts again."""
    rows, rejected = bank.transactions(lines(spark, *STATEMENT), spark.createDataFrame([(1, "s.pdf")], "file_id long, name string"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan(rows) + plan(rejected) and rows.count() > 1


def test_registers_of_a_period_parse_each_file_once(spark):
    from ledgerloom.plans import whole_queries

    from .conftest import DATA

    # the rows meet the counts of their keys, so files that were read in this plan would be read twice
    assert "MapInArrow" not in whole_queries.whole_period_registers(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
