"""Queries of published tables, streams of deliveries, workbook files, archives and what a period adds to its rows, each with the SQL that gives the same."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import recon, reports
from ..sources import containers, xlsx
from ..sources.snapshots import Snapshots
from ..sources.staging import shared_place, staged
from ..streaming.ingest import upsert_stream
from .queries import SIDES, _sides, joined, query
from .report_queries import _cells
from .views import INV, inv, rupees, table


#: Files of a delivery.
DELIVERED = 12


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_place(spark)}/{name}/{uuid.uuid4().hex}"


@query("""WITH e AS (SELECT user_id, floor(value * 100)::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS z FROM events),
u AS (SELECT user_id, max(v) FILTER (a = 1) AS v1, max(v) FILTER (z = 1) AS last FROM e GROUP BY user_id), d AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN v1 ELSE last END AS v2 FROM u), g AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN v1 ELSE v2 END AS v3 FROM d)
SELECT user_id AS file_id, v3 AS value, (1 + (v2 <> v1)::INT + (v3 <> v2)::INT)::BIGINT AS changes FROM g""")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries of each user's row as a stream: the same again, another one, and the first one after another one."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 100).cast("long").alias("v"))
    u = e.groupBy(F.col("user_id").alias("file_id")).agg(F.min_by("v", "event_id").alias("v1"), F.max_by("v", "event_id").alias("last"))
    u = u.withColumn("v2", F.when(F.col("file_id") % 2 == 0, F.col("v1")).otherwise(F.col("last")))
    u = u.withColumn("v3", F.when(F.col("file_id") % 3 == 0, F.col("v1")).otherwise(F.col("v2")))
    folder, place = _place(spark, "deliveries"), _place(spark, "upserts")
    u = staged(u)
    # each delivery has the same keys, dealt alike, and so the same number of files, which are a batch
    for k, v in enumerate(("v1", "v2", "v3"), 1):
        u.select("file_id", F.timestamp_seconds(F.lit(k)).alias("at"), F.col(v).alias("value")).repartition(DELIVERED, "file_id").write.mode("append").parquet(folder)
        files = len(spark.read.parquet(folder).inputFiles()) // k
    stream = spark.readStream.schema("file_id long, at timestamp, value long").option("maxFilesPerTrigger", files).parquet(folder)
    sets = Snapshots(spark, place)
    upsert_stream(stream, sets, "latest", "file_id", "at", ["value"], f"{place}-checkpoint", buckets=2).awaitTermination()
    return sets.read("latest").select("file_id", "value", "changes")


@query("""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version, count(*) AS orders, sum(CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice)::BIGINT * 2 ELSE floor(o_totalprice)::BIGINT END)::BIGINT AS total FROM orders GROUP BY ALL""")
def published_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of each of three keys; one key is published again, and one draft never is."""
    sets = Snapshots(spark, _place(spark, "snapshots"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("price"))
    tables = lambda k, v: {"prices": o.where(F.col("o_orderkey") % 3 == k).select("o_orderkey", (F.col("price") * v).alias("price")), "versions": o.where(F.col("o_orderkey") % 3 == k).select("o_orderkey", F.lit(v).cast("long").alias("version"))}
    for k in range(3):
        sets.write(f"k{k}", tables(k, 1))
    sets.write("k0", tables(0, 2))
    sets.draft("k1").add("prices", o)
    both = sets.read("prices").join(sets.read("versions"), "o_orderkey")
    return both.groupBy("version").agg(F.count("*").alias("orders"), F.sum("price").alias("total"))


@query("""SELECT o_orderkey, o_totalprice, o_orderstatus || ' <&> "' || o_orderpriority || '"' AS said, o_orderdate::DATE AS day FROM orders""")
def xlsx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as workbooks, with sheets of 4,000 rows, and read back by ranges of rows."""
    xlsx.register(spark)
    said = F.concat("o_orderstatus", F.lit(' <&> "'), "o_orderpriority", F.lit('"')).alias("said")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", said, F.to_date("o_orderdate").alias("day"))
    place = _place(spark, "workbooks")
    o.write.format("ledger_xlsx").option("sheet_rows", 4_000).mode("overwrite").save(place)
    return spark.read.format("ledger_xlsx").schema("o_orderkey long, o_totalprice double, said string, day date").option("rows", 1_500).load(place)


def _archives(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Archives of a folder, an XML member, a text member of so many bytes, and another file."""
    for frame in frames:
        out = []
        for k, n in zip(frame["file_id"], frame["n"], strict=True):
            held = BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("in/", "")
                z.writestr("in/a.xml", f"<V>{k}</V>")
                z.writestr("b.TXT", "x" * n)
                z.writestr("c.bin", b"\0" * (n % 7))
            out.append(held.getvalue())
        yield pd.DataFrame({"file_id": frame["file_id"], "content": out})


@query("""WITH o AS (SELECT o_orderkey AS file_id, (floor(o_totalprice)::BIGINT % 3000)::BIGINT AS n FROM orders)
SELECT file_id, 'in/' AS member, 0::BIGINT AS size, 'folder' AS outcome FROM o UNION ALL SELECT file_id, 'in/a.xml', 7 + length(file_id::VARCHAR), 'ok' FROM o
UNION ALL SELECT file_id, 'b.TXT', n, CASE WHEN n > 2000 THEN 'oversize_member' ELSE 'ok' END FROM o UNION ALL SELECT file_id, 'c.bin', n % 7, 'other' FROM o""")
def archive_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the directories of archives say of their members, and which ones are read."""
    n = (F.floor("o_totalprice") % 3000).alias("n")
    packed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), n).mapInPandas(_archives, "file_id long, content binary")
    return containers.zip_index(packed, most=2000).drop("compressed")


@query(f"""WITH {INV}, {SIDES}, b AS (SELECT k_gstin, k_invoice, k_date, max(value) AS v FROM s WHERE okey % 11 <> 0 GROUP BY ALL), p AS (SELECT k_gstin, k_invoice, k_date, max(other) AS v FROM s WHERE okey % 13 <> 0 GROUP BY ALL),
g AS (SELECT k_gstin, k_invoice, k_date, b.v AS bv, p.v AS pv, CASE WHEN p.v IS NULL THEN 'books_only' WHEN b.v IS NULL THEN 'portal_only' WHEN abs(b.v - p.v) <= 100 THEN 'matched' ELSE 'amount_mismatch' END AS status FROM b FULL JOIN p USING (k_gstin, k_invoice, k_date)),
f AS (SELECT *, substr(k_gstin, 1, 2)::BIGINT AS pack_id FROM g), m AS (SELECT pack_id, 1 AS sheet_no, 'Master_Reconciliation_Grid' AS sheet, k_gstin, k_invoice, k_date,
 k_gstin || '|' || k_invoice || '|' || k_date || '|' || coalesce(printf('%.2f', bv / 100.0), '~') || '|' || coalesce(printf('%.2f', pv / 100.0), '~') || '|' || coalesce(printf('%.2f', (bv - pv) / 100.0), '~') || '|' || status AS cells FROM f)
SELECT pack_id, sheet_no, sheet, row_number() OVER (PARTITION BY pack_id ORDER BY k_gstin, k_invoice, k_date)::INT AS row_no, cells FROM m""")
def recon_pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master reconciliation grid as the workbooks of the states that identifiers begin with."""
    grid = recon.reconcile(*_sides(spark, sf_dir)).withColumn("pack_id", F.substring("k_gstin", 1, 2).cast("long"))
    return _cells(reports.grid_pack(grid))


@query(f"""WITH {INV}, r AS (SELECT okey, skey, gstin, skey % 40 AS no, day, okey % 2 AS side FROM inv), n AS (SELECT gstin, no, day, side, count(*) AS n FROM r GROUP BY ALL)
SELECT okey, skey, concat_ws(',', CASE WHEN okey % 5 = 0 THEN 'hsn_length' END, CASE WHEN n > 1 THEN 'possible_duplicate' END, CASE WHEN day < DATE '1994-01-01' OR day > DATE '1996-12-31' THEN 'date_out_of_period' END) AS flags
FROM r JOIN n USING (gstin, no, day, side)""")
def period_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a period with what came twice on a side, and what lies outside the period, marked behind the flags that they had."""
    had = F.when(F.col("okey") % 5 == 0, F.array(F.lit("hsn_length"))).otherwise(F.array().cast("array<string>"))
    day = F.when(F.col("okey") % 4 == 0, F.date_format("day", "dd/MM/yyyy")).otherwise(F.date_format("day", "yyyy-MM-dd"))
    rows = inv(spark, sf_dir).select("okey", "skey", "gstin", F.concat(F.lit("A-"), F.col("skey") % 40).alias("invoice_number"), day.alias("invoice_date"), (F.col("okey") % 2).alias("side"), had.alias("flags"))
    ends = [F.lit(x).cast("date") for x in ("1994-01-01", "1996-12-31")]
    return recon.stamped(rows, "gstin", "side", *ends).select("okey", "skey", joined("flags").alias("flags"))


@query(f"""WITH {INV}, t AS (SELECT (okey % 9)::BIGINT AS pack_id, hsn, taxable, tax, 'g.json#3b.' || lpad(okey::VARCHAR, 9, '0') || lpad(skey::VARCHAR, 9, '0') AS source FROM inv WHERE okey % 9 < 8),
k AS (SELECT DISTINCT (okey % 9)::BIGINT AS pack_id FROM inv), c AS (SELECT k.pack_id, count(t.pack_id) AS n FROM k LEFT JOIN t USING (pack_id) GROUP BY k.pack_id)
SELECT pack_id, 2 AS sheet_no, 'Summary' AS sheet, row_number() OVER (PARTITION BY pack_id ORDER BY source)::INT AS row_no, hsn || '|' || printf('%.2f', taxable / 100.0) || '|' || printf('%.2f', tax / 100.0) || '|~|~|~|' || source AS cells FROM t
UNION ALL SELECT pack_id, 2, 'Summary', 1, 'No rows extracted' FROM c WHERE n = 0
UNION ALL SELECT pack_id, 1, 'Cover', unnest(range(1, 5))::INT, unnest(['GSTIN|F' || pack_id, 'Period|042025', 'Source|' || CASE WHEN n > 0 THEN 'g.json' ELSE '~' END, 'Summary rows|' || n]) FROM c""")
def summary_pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks of a summary return: cover and summary, and what stands where there is none."""
    k = (F.col("okey") % 9).alias("pack_id")
    pad = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    i = inv(spark, sf_dir)
    source = F.concat(F.lit("g.json#3b."), pad("okey"), pad("skey")).alias("source")
    rows = i.where(F.col("okey") % 9 < 8).select(k, F.col("hsn").alias("section"), rupees(F.col("taxable")).alias("taxable"), rupees(F.col("tax")).alias("igst"), source)
    packs = i.select(k).distinct().select("pack_id", F.concat(F.lit("F"), F.col("pack_id").cast("string")).alias("filer_gstin"), F.lit("042025").alias("period"))
    return _cells(reports.return_pack(packs, rows, "gstr_3b"))


@query(r"""SELECT DISTINCT s_name || ' <' || s_suppkey % 9 || '>: a/b\c | ' || repeat('x', s_suppkey % 90) || ' ?*' AS name,
trim(substr(trim(regexp_replace(regexp_replace(s_name || ' <' || s_suppkey % 9 || '>: a/b\c | ' || repeat('x', s_suppkey % 90) || ' ?*', '[<>:"/\\|?*]', ' ', 'g'), '\s+', ' ', 'g')), 1, 80)) AS folder FROM supplier""")
def folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of firms as names of folders: refused characters, blanks, length."""
    digit: Column = (F.col("s_suppkey") % 9).cast("string")
    name = F.concat("s_name", F.lit(" <"), digit, F.lit(r">: a/b\c | "), F.repeat(F.lit("x"), (F.col("s_suppkey") % 90).cast("int")), F.lit(" ?*"))
    return table(spark, sf_dir, "supplier").select(name.alias("name")).distinct().select("name", text.folder_name("name").alias("folder"))


@query("""SELECT DISTINCT o_orderdate::DATE AS day, strftime(o_orderdate::DATE, '%b %Y') AS label, date_trunc('month', o_orderdate)::DATE AS first, last_day(o_orderdate::DATE) AS last FROM orders""")
def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of a day's period, and the days that the label, in any case, stands for."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    first, last = dates.label_bounds(F.lower(dates.period_label("day")))
    return days.select("day", dates.period_label("day").alias("label"), first.alias("first"), last.alias("last"))
