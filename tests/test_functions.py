from datetime import date
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import dates, geometry, identifiers, money, text


def values(spark, kind, items, make):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}").select("i", make(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


def test_gstin_flags(spark):
    items = ["27AAPFU0939F1ZV", "29AAGCB7383J1Z4", " 27aapfu0939f1zv ", "07ABCDE1234F1Z0", "27AAPFU0939F1YV", "27AAPFU0939F1Z", None, ""]
    assert values(spark, "string", items, identifiers.gstin_flags) == [[], [], [], ["gstin_checksum"], ["gstin_format"], ["gstin_format"], ["gstin_missing"], ["gstin_missing"]]
    assert values(spark, "string", ["a 27aapfu0939f1zv, x27AAPFU0939F1ZV 29AAGCB7383J1Z4", None], identifiers.find_gstins) == [["27AAPFU0939F1ZV", "29AAGCB7383J1Z4"], None]
    assert values(spark, "string", ["27AAPFU0939F1ZV", "12", "27AAPFU0939F1YV", None], identifiers.client_gstin_error) == [None, "length", "shape", None]


ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, min_size=14, max_size=14), min_size=1, max_size=30))
def test_check_character(spark, items):
    def check(t):
        total = sum(sum(divmod(ALPHABET.index(c) * (1 + i % 2), 36)) for i, c in enumerate(t))
        return ALPHABET[-total % 36]

    assert values(spark, "string", items, identifiers.check_character) == [check(t) for t in items]


def test_hsn_flags(spark):
    assert values(spark, "string", ["8471", "847130", "84713010", None, "abc", "847", "84713", "8471301"], identifiers.hsn_flags) == [[]] * 5 + [["hsn_length"]] * 3


def test_amounts(spark):
    items = ["01/04/2025 NEFT IN ACME deposit 500.00 1,500.00", "₹ 1,23,456.7 and 12", "01.04.2025 X 5,000.00 1,23,456.78", "none", None]
    assert values(spark, "string", items, money.amounts_in) == [[Decimal("500.00"), Decimal("1500.00")], [Decimal("123456.70")], [Decimal("4.20"), Decimal("5000.00"), Decimal("123456.78")], [], None]
    assert values(spark, "string", ["₹1,180.00", " ", "x", "18%", None], money.loose_number) == [1180.0, None, None, 18.0, None]
    assert values(spark, "string", ["-1,118.00", "", None, "z"], money.absolute_amount) == [1118.0, None, None, None]
    assert values(spark, "decimal(18,4)", [Decimal("2.675"), Decimal("-0.005"), None], money.edge) == [2.68, -0.01, None]


def test_dates(spark):
    assert values(spark, "string", ["1/4/25", "31-13-2025", "01.04.2025", "x", "a/b/c", None], dates.day_first) == ["2025-04-01", "2025-13-31", "2025-04-01", "x", None, None]
    assert values(spark, "string", ["2025-04-01 10:00", "2025/4/1", "1-4-2025", "12-Apr-2025", " ", None], dates.sheet_date) == ["2025-04-01", "2025-04-01", "2025-04-01", None, None, None]
    assert values(spark, "string", ["20250401", "1-4-25", "", None], dates.compact_date) == ["2025-04-01", "1-4-25", None, None]
    assert values(spark, "string", ["2025-04-01", "01-04-2025", "01/04/2025", "01/04/25", "31/02/2025", "soon", None], dates.try_date) == [date(2025, 4, 1)] * 4 + [None] * 3
    assert values(spark, "date", [date(2025, 4, 1)], dates.period_label) == ["Apr 2025"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.dates(min_value=date(2000, 1, 1), max_value=date(2099, 12, 31)), min_size=1, max_size=20), st.sampled_from("/-."), st.booleans())
def test_day_first_any_date(spark, items, sep, short):
    shown = [f"{d.day}{sep}{d.month}{sep}{d.year % 100:02d}" if short else f"{d.day:02d}{sep}{d.month:02d}{sep}{d.year}" for d in items]
    assert values(spark, "string", shown, dates.day_first) == [d.isoformat() for d in items]


def test_text(spark):
    assert values(spark, "string", ["  a \t b\n", None], text.squeeze) == ["a b", None]
    assert values(spark, "string", ["..My file (1).pdf", "é" * 3 + ".x"], text.safe_name) == ["My_file_1_.pdf", "x"]
    assert values(spark, "string", ["A/B: c?", "x" * 100], text.folder_name) == ["A B c", "x" * 80]
    assert values(spark, "string", ["a, b,,c", "", None], text.flag_list) == [["a", "b", "c"], [], []]
    assert values(spark, "array<string>", [["a", "b", "a"], None], lambda c: text.add_flags(c, F.array(F.lit("b")))) == [["a", "b"], ["b"]]
    assert values(spark, "string", ["f.pdf#p1@1,2,3,4", "#x", None], text.source_file) == ["f.pdf", None, None]
    assert values(spark, "string", ["bad key hunter2 used\nTraceback"], lambda c: text.redact(c, "hunter2")) == ["bad key *** used"]
    assert values(spark, "string", ["/a/B.PDF", "x", "/a.b/c"], text.file_suffix) == [".pdf", "", ""]


def test_boxes(spark):
    crop = lambda b: geometry.pixel_box(b, F.lit(595.0), F.lit(842.0), F.lit(1190), F.lit(1684), F.lit(2.0))
    third = (0, 0, 1190, 562)
    got = values(spark, "string", ["100.0,700.0,50.0,10.0", "0,0,0,5", "a,b,c,d", "1,2,3", None, "900,1,5,5"], crop)
    assert [tuple(g) for g in got] == [(184, 248, 316, 300), third, third, third, third, third]
    boxes = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0), (0.0, 5.0, 10.0, 1.0)], "x double, y double, width double, height double")
    assert boxes.agg(geometry.union_box("x", "y", "width", "height").alias("u")).first()["u"] == "0.0,2.0,10.0,4.0"
    assert values(spark, "string", ["1,2,3,4"], lambda b: geometry.crop_key(F.lit(7), F.lit(1), b))[0].__len__() == 16


def test_dates_of_any_width_and_amounts_too_long(spark):
    """Parts beyond two or four digits are kept whole, the first amount that is one counts, and a document's fields are looked for once."""
    from ledgerloom.functions import dates, money
    from ledgerloom.operators import invoice

    given = ["1/2/25", "01-02-2025", "3.4.20251", "123/4/2025", "1/2", "a/b/c", " 7-8-1999 ", "2025/1/2", None, "1/-2/2025"]
    df = spark.createDataFrame([(x,) for x in given], "d string")
    assert [x[0] for x in df.select(dates.day_first("d")).collect()] == ["2025-02-01", "2025-02-01", "20251-04-03", "2025-04-123", "1/2", None, "1999-08-07", "0002-01-2025", None, "1/-2/2025"]
    assert [x[0] for x in df.select(dates.sheet_date("d")).collect()] == ["2025-02-01", "2025-02-01", "20251-04-03", "2025-04-123", "1/2", None, "1999-08-07", "2025-01-02", None, "1/-2/2025"]
    amounts = spark.createDataFrame([("12345678901234567890.00 and ₹ 1,250.5 or 7.00",), ("none 12",), (None,)], "t string")
    assert [x[0] and str(x[0]) for x in amounts.select(money.first_amount("t")).collect()] == ["1250.50", None, None]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = invoice.invoices(amounts.selectExpr("t as file_id", "t as text"))
    assert "240" in plan(rows) and "240" not in plan(rows.drop("raw_excerpt"))
