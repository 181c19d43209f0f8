"""The workbook source: round trips, sheets that are too long, failures; and archives whose members are streams."""

import io
import os
import subprocess
import sys
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import containers, xlsx

SCHEMA = "k long, x double, t string, d date, b boolean"


def test_values_come_back(spark, tmp_path):
    xlsx.register(spark)
    rows = [(1, 0.1, "a <b> & \"c\" é 中 🙂 ", date(2025, 4, 1), True), (2**60, None, "", None, False), (None, -1e300, " \n\t", date(1899, 12, 31), None), (-5, 3.0, None, None, True)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df.write.format("ledger_xlsx").mode("overwrite").save(str(tmp_path / "out"))
    back = lambda: spark.read.format("ledger_xlsx").schema(SCHEMA).load(str(tmp_path / "out"))
    assert sorted(map(tuple, back().collect()), key=str) == sorted(rows, key=str)
    plain = spark.read.format("ledger_xlsx").load(str(tmp_path / "out"))
    assert plain.columns == ["k", "x", "t", "d", "b"] and {t for _, t in plain.dtypes} == {"string"}
    # columns go by title; an unknown one is null; appending keeps what is there, overwriting does not
    assert [tuple(r) for r in spark.read.format("ledger_xlsx").schema("t string, no string").load(str(tmp_path / "out")).where("t like 'a%'").collect()] == [(rows[0][2], None)]
    df.write.format("ledger_xlsx").mode("append").save(str(tmp_path / "out"))
    assert back().count() == 8
    df.limit(1).write.format("ledger_xlsx").mode("overwrite").save(str(tmp_path / "out"))
    assert back().count() == 1
    df.where("false").write.format("ledger_xlsx").mode("overwrite").save(str(tmp_path / "none"))
    assert spark.read.format("ledger_xlsx").load(str(tmp_path / "none")).count() == 0
    assert not [x for x in os.listdir(tmp_path / "out") if x.startswith("_")]


def test_long_sheets_go_on(spark, tmp_path):
    """1.2 million rows of one task: two sheets, the first as long as the format allows; read in ranges of rows."""
    xlsx.register(spark)
    n = 1_200_000
    spark.range(0, n, 1, 1).select("id", (F.col("id") % 7).cast("string").alias("t")).write.format("ledger_xlsx").mode("overwrite").save(str(tmp_path / "long"))
    (file,) = [x for x in os.listdir(tmp_path / "long")]
    with zipfile.ZipFile(tmp_path / "long" / file) as book:
        assert [name for name, _ in containers.sheet_parts(book)] == ["Rows", "Rows (2)"]
    back = spark.read.format("ledger_xlsx").schema("id long, t string").option("rows", 300_000).load(str(tmp_path / "long"))
    assert back.rdd.getNumPartitions() == 5
    got = back.agg(F.count("*"), F.sum("id"), F.count_distinct("id"), F.sum((F.col("t") == (F.col("id") % 7).cast("string")).cast("int"))).first()
    assert tuple(got) == (n, n * (n - 1) // 2, n, n)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    xlsx.register(spark)
    spark.range(3).write.format("ledger_xlsx").mode("overwrite").save(str(tmp_path / "out"))
    broken = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("ledger_xlsx").mode("overwrite").save(str(tmp_path / "out"))
    assert spark.read.format("ledger_xlsx").schema("id long").load(str(tmp_path / "out")).count() == 3
    assert not [x for x in os.listdir(tmp_path / "out") if x.startswith("_")]


def packed(**members):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "."), text)
    return held.getvalue()


V = "<VOUCHER VCHTYPE='{0}'><DATE>20250401</DATE><AMOUNT>{1}</AMOUNT></VOUCHER>"


def test_members_are_told_and_read_one_by_one(spark):
    nested = f"<E><X>{V.format('Sales', 1)}</X><VOUCHER VCHTYPE='Out'><IN>{V.format('In', 2)}</IN><AMOUNT>9</AMOUNT></VOUCHER></E>"
    content = packed(a__xml=nested, b__txt=f"<E>{V.format('Late', 3)}</E><", c__bin="x", d__xml=f"<E>{V.format('Big', 4)}{' ' * 500}</E>", e__xml=f"<E>{V.format('After', 5)}</E>")
    files = spark.createDataFrame([(1, "z.zip", content), (2, "bad.zip", b"PK"), (3, None, None)], "file_id long, name string, content binary")
    told = [tuple(r) for r in containers.zip_index(files, most=400).select("file_id", "member", "outcome").collect()]
    assert told == [(1, "a.xml", "ok"), (1, "b.txt", "ok"), (1, "c.bin", "other"), (1, "d.xml", "oversize_member"), (1, "e.xml", "ok")]
    got = [(r["member"], r["type"], dict(r["child"]).get("AMOUNT")) for r in containers.archive_vouchers(files, most=400).collect()]
    assert got == [("a.xml", "Sales", "1"), ("a.xml", "Out", "9"), ("a.xml", "In", "2"), ("e.xml", "After", "5")]


BOMB = """
import io, resource, sys, zipfile
sys.path.insert(0, {root!r})
from ledgerloom.sources import containers
held = io.BytesIO()
with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z, z.open("big.xml", "w", force_zip64=True) as f:
    f.write(b"<E>")
    pad = b"<P>" + b"x" * 1_000_000 + b"</P>" + b"<Q/>" * 1000
    for i in range(1000):
        f.write(pad + b"<VOUCHER><AMOUNT>%d</AMOUNT></VOUCHER>" % i)
    f.write(b"</E>")
content = held.getvalue()
resource.setrlimit(resource.RLIMIT_AS, (1 << 30, 1 << 30))
rows = list(containers.whole(lambda: containers._member_vouchers(content, "big.xml"), containers.UNREADABLE))
assert [dict(r[1])["AMOUNT"] for r in rows] == [str(i) for i in range(1000)]
assert containers.index(content, most=1 << 29)[0][3] == "oversize_member"
print("rows", len(rows))
"""


def test_a_gigabyte_of_xml_within_a_gigabyte():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", BOMB.format(root=root)], capture_output=True, text=True, timeout=600, env={**os.environ, "OPENBLAS_NUM_THREADS": "1", "OMP_NUM_THREADS": "1"})
    assert done.stdout.strip() == "rows 1000", done.stderr[-2000:]
