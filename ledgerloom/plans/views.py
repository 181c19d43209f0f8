"""Ledger tables derived from the generic test tables, each as a DataFrame and as the SQL that gives the same rows.

Amounts are whole paise made by floor(x * 100 + 0.5), so both sides do the same arithmetic; they turn to rupees at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.identifiers import ALPHABET, check_character

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paise(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("long")


def rupees(x: Column) -> Column:
    return x.cast("double") / 100.0


def gstin_of(key: Column) -> Column:
    """An identifier for a supplier number; every seventh has check character 0 whether or not that is right."""
    letter = lambda n: F.substring(F.lit(LETTERS), (n % 26 + 1).cast("int"), F.lit(1))
    first = F.concat(F.lpad((key % 37 + 1).cast("string"), 2, "0"), letter(key), letter(F.floor(key / 26)), letter(F.floor(key / 676)), F.lit("PF"), F.lpad((key % 10000).cast("string"), 4, "0"), letter(key * 7), F.lit("1Z"))
    return F.concat(first, F.when(key % 7 == 0, "0").otherwise(check_character(first)))


def inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice for each order and supplier: keys, gstin, number, day, taxable, tax, value in paise, hsn."""
    # dealt by order once, for the sums and for the join
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", paise(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")).repartition("l_orderkey")
    li = lines.groupBy("l_orderkey", "l_suppkey").agg(F.sum("net").alias("taxable"), F.min("l_partkey").alias("part"))
    df = li.join(table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", gstin_of(F.col("s_suppkey")).alias("gstin")), F.col("l_suppkey") == F.col("s_suppkey"))
    tax = F.floor(F.col("taxable") * 18 / 100).cast("long")
    odd = F.when(F.col("l_orderkey") % 19 == 0, 250).otherwise(0)
    hsn = F.substring(F.lpad((F.col("part") * 7919).cast("string"), 8, "8"), 1, F.when(F.col("part") % 9 == 0, 5).otherwise(8))
    number = F.concat(F.lit("INV/"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
    return df.select(F.col("l_orderkey").alias("okey"), F.col("l_suppkey").alias("skey"), F.col("s_name").alias("supplier_name"), "gstin", number.alias("invoice_number"), "day", "taxable", tax.alias("tax"), (F.col("taxable") + tax + odd).cast("long").alias("value"), hsn.alias("hsn"))


def statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bank statements, one for each user: file_id, row_no, debit, credit, balance, some balances wrong or missing."""
    w = Window.partitionBy("file_id").orderBy("event_id")
    amount, pays = paise(F.abs("value")), F.col("event_type") == "purchase"
    df = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), "event_id", F.to_date("ts").alias("day"), F.when(pays, amount).alias("debit"), F.when(~pays, amount).alias("credit"))
    total = F.sum(F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))).over(w) + 1_000_000
    balance = F.when(F.col("event_id") % 41 != 0, total + F.when(F.col("event_id") % 97 == 0, 500).otherwise(0))
    money = lambda c: (c / 100).cast("decimal(18,2)")
    return df.select("file_id", "event_id", "day", F.row_number().over(w).alias("row_no"), money(F.col("debit")).alias("debit"), money(F.col("credit")).alias("credit"), money(balance).alias("balance"))


def gstin_sql(key: str) -> str:
    first = f"lpad((({key}) % 37 + 1)::VARCHAR, 2, '0') || substr('{LETTERS}', (({key}) % 26 + 1)::INT, 1) || substr('{LETTERS}', ((({key}) // 26) % 26 + 1)::INT, 1) || substr('{LETTERS}', ((({key}) // 676) % 26 + 1)::INT, 1) || 'PF' || lpad((({key}) % 10000)::VARCHAR, 4, '0') || substr('{LETTERS}', (({key}) * 7 % 26 + 1)::INT, 1) || '1Z'"
    return f"{first} || CASE WHEN ({key}) % 7 = 0 THEN '0' ELSE {check_sql(f'({first})')} END"


def check_sql(first14: str) -> str:
    product = f"(instr('{ALPHABET}', substr({first14}, i::INT, 1)) - 1) * (2 - i % 2)"
    return f"substr('{ALPHABET}', ((36 - list_sum(list_transform(range(1, 15), lambda i: {product} // 36 + {product} % 36)) % 36) % 36 + 1)::INT, 1)"


def flags_sql(gstin: str) -> str:
    shape = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]$"
    return f"CASE WHEN {gstin} IS NULL OR {gstin} = '' THEN 'gstin_missing' WHEN NOT regexp_matches({gstin}, '{shape}') THEN 'gstin_format' WHEN {check_sql(f'substr({gstin}, 1, 14)')} <> substr({gstin}, 15, 1) THEN 'gstin_checksum' ELSE '' END"


INV = f"""inv AS (SELECT okey, skey, s_name AS supplier_name, {gstin_sql('skey')} AS gstin, 'INV/' || okey || '-' || skey AS invoice_number, day, taxable, tax,
  (taxable + tax + CASE WHEN okey % 19 = 0 THEN 250 ELSE 0 END)::BIGINT AS value, substr(lpad((part * 7919)::VARCHAR, 8, '8'), 1, CASE WHEN part % 9 = 0 THEN 5 ELSE 8 END) AS hsn
  FROM (SELECT *, (taxable * 18 // 100)::BIGINT AS tax FROM (SELECT l_orderkey AS okey, l_suppkey AS skey, sum(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5)::BIGINT)::BIGINT AS taxable, min(l_partkey) AS part FROM lineitem GROUP BY ALL) g
  JOIN (SELECT o_orderkey, o_orderdate::DATE AS day FROM orders) ON okey = o_orderkey JOIN supplier ON skey = s_suppkey))"""

STATEMENT = """st AS (SELECT user_id AS file_id, event_id, ts::DATE AS day, row_number() OVER w AS row_no, CASE WHEN event_type = 'purchase' THEN amount END AS debit, CASE WHEN event_type <> 'purchase' THEN amount END AS credit,
  CASE WHEN event_id % 41 <> 0 THEN sum(CASE WHEN event_type = 'purchase' THEN -amount ELSE amount END) OVER w + 1000000 + CASE WHEN event_id % 97 = 0 THEN 500 ELSE 0 END END AS balance
  FROM (SELECT *, floor(abs(value) * 100 + 0.5)::BIGINT AS amount FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""
