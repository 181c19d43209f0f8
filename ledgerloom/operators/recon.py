"""Reconciliation: books against portal, bank against invoices, duplicates, gaps and outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import out_of_period, sheet_date
from ..functions.money import TOLERANCE
from ..functions.text import add_flags, alphanumeric, flag

KEY = ["k_gstin", "k_invoice", "k_date"]


def keyed(rows: DataFrame) -> DataFrame:
    """rows (gstin, invoice_number, invoice_date) with the key that both sides are compared by: identifier and number in upper case without
    separators, leading zeros of the number dropped, the date as ISO text."""
    squash = lambda c: F.upper(alphanumeric(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    own = rows.withColumns({"k_gstin": squash("gstin"), "k_invoice": squash("invoice_number"), "k_date": F.coalesce(sheet_date("invoice_date"), F.lit(""))})
    bare = F.ltrim("k_invoice", F.lit("0"))
    return own.withColumn("k_invoice", F.when((bare == "") & (F.col("k_invoice") != ""), "0").otherwise(bare))


def reconcile(books: DataFrame, portal: DataFrame, tolerance: str = TOLERANCE) -> DataFrame:
    """One row for each key of either side with both values and status: matched, amount_mismatch, books_only, portal_only.

    Sides are folded to one row a key (the greatest value, as exports repeat an invoice's total on each of its items) before they meet, so
    the join is one to one and the tolerance is a test after it.
    """
    fold = lambda df, name: keyed(df).groupBy(*KEY).agg(F.max("invoice_value").alias(f"{name}_value"), F.count("*").alias(f"{name}_rows"))
    joined = fold(books, "books").join(fold(portal, "portal"), KEY, "full")
    gap = F.round(F.col("books_value") - F.col("portal_value"), 2)
    status = F.when(F.col("portal_rows").isNull(), "books_only").when(F.col("books_rows").isNull(), "portal_only").when(F.abs(gap) <= float(tolerance), "matched").otherwise("amount_mismatch")
    return joined.select(*KEY, "books_value", "portal_value", gap.alias("gap"), status.alias("status"))


def duplicates(rows: DataFrame) -> DataFrame:
    """rows with possible_duplicate: whether another row has the same identifier, number and date. Counts are folded per key and joined back,
    so that a key with very many rows is a join that adaptive execution splits; rows without a number are never duplicates."""
    marked = keyed(rows)
    many = marked.where(F.col("k_invoice") != "").groupBy(*KEY).agg(F.count("*").alias("__n")).where("__n > 1")
    return marked.join(many, KEY, "left").withColumn("possible_duplicate", F.col("__n").isNotNull()).drop("__n", *KEY)


def stamped(rows: DataFrame, gstin: str = "gstin", by: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """rows (gstin, invoice_number, invoice_date, flags, ...) with the flags possible_duplicate and date_out_of_period where they hold; other columns
    as they were.

    A row is a possible duplicate if another one, in the same group of column `by`, has its identifier, number and date, compared as in keyed(). Its date is
    out of the period if it is a date before start or after end; without both, no date is looked at. Rows are marked, never dropped or changed.
    """
    group = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    own = keyed(rows.select(F.struct(*rows.columns).alias("row"), F.col(gstin).alias("gstin"), "invoice_number", "invoice_date", group.alias("__by")))
    many = own.where("k_invoice <> ''").groupBy("__by", *KEY).agg(F.count("*").alias("__n")).where("__n > 1")
    out = out_of_period("invoice_date", start, end) if start is not None and end is not None else F.lit(False)
    marked = own.join(many, ["__by", *KEY], "left")
    flags = add_flags(F.col("row.flags"), flag(F.col("__n").isNotNull(), "possible_duplicate"), flag(out, "date_out_of_period"))
    return marked.select(*[flags.alias(c) if c == "flags" else F.col(f"row.{c}") for c in rows.columns])


def similarity(a: Column, b: Column) -> Column:
    """1 minus edit distance over the longer length, of trimmed lower-case names."""
    a, b = F.lower(F.trim(F.coalesce(a, F.lit("")))), F.lower(F.trim(F.coalesce(b, F.lit(""))))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "auto").when(score >= 70, "likely").otherwise("possible")


#: Cells in which amounts meet, in paise, and how many times `days` they last: wide against the reach of one rupee and of `days`, so that invoices stand
#: in 1.6 of them on average. Narrower cells shuffle more copies, wider ones look at more pairs that don't meet.
CELL, SPAN = 800, 8


def near_kinds(bank: DataFrame, invoices: DataFrame, days: int) -> DataFrame:
    """Candidates of two sides that have different rows only, with score: amounts within one rupee, dates at most `days` apart.

    Both have day, cents, direction, name, and columns of their own, which stay. They meet by cells of amounts and days, in which the second side stands
    in all that it reaches, so no side is compared with all of the other. Points: amount 50, date 20, direction 10, name 20 times similarity, rounded
    down. The columns cell and span tell where a pair met: all pairs of a row of the first side lie in one cell.
    """
    key = ["day", "cents", "direction", "name"]
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    cell = lambda c: F.floor(c / CELL)
    span = lambda c: F.floor(c / (SPAN * days))
    reached = lambda of, c, reach: F.explode(F.sequence(of(c - reach), of(c + reach)))
    left = bank.select(F.struct(*key).alias("k"), *[c for c in bank.columns if c not in key])
    left = left.select("*", cell(F.col("k.cents")).alias("cell"), span(number("k.day")).alias("span"))
    right = invoices.select("*", reached(cell, F.col("cents"), 100).alias("cell")).select("*", reached(span, number("day"), days).alias("span"))
    near = left.join(right, ["cell", "span"]).where((F.abs(F.col("cents") - F.col("k.cents")) <= 100) & (F.abs(F.datediff("day", "k.day")) <= days))
    score = 70 + F.when(F.col("direction") == F.col("k.direction"), 10).otherwise(0) + F.floor(20 * similarity(F.col("name"), F.col("k.name")))
    return near.withColumn("score", score.cast("int"))


def score_matches(bank: DataFrame, invoices: DataFrame, days: int = 7) -> DataFrame:
    """The best invoice of each bank row: bank_id, invoice_id, score, grade.

    bank: bank_id, day, cents, direction, name; invoices: the same with invoice_id. Rows of a side that agree in all of this score alike, so both
    sides are folded to their different rows first, the invoices with their smallest id, and a common amount counts once a day,
    direction and name; then they meet by near_kinds(). 90 and more is auto, 70 likely, 40 possible. Ties go to the smallest invoice_id. An invoice may
    be the best of several rows: matching.assign() gives each one once.
    """
    key = ["day", "cents", "direction", "name"]
    kinds = invoices.groupBy(*key).agg(F.min("invoice_id").alias("invoice_id"))
    near = near_kinds(bank.select(*key).distinct(), kinds, days).select("cell", "span", F.col("k").alias("b"), "invoice_id", "score")
    # pairs may be many times more than rows: they are folded where they met, without a shuffle, and by a score first, as that needs no sort
    least = near.groupBy("cell", "span", "b", "score").agg(F.min("invoice_id").alias("invoice_id"))
    best = least.groupBy("cell", "span", "b").agg(F.max_by("invoice_id", "score").alias("invoice_id"), F.max("score").alias("score"))
    best = best.select(*[F.col(f"b.{k}").alias(f"b_{k}") for k in key], "invoice_id", "score")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in key])
    matched = bank.select("bank_id", *key).join(best, same).select("bank_id", "invoice_id", "score")
    return matched.withColumn("grade", grade(F.col("score")))


def presence(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """Which of the named sides has each key, and label: consistent, or the sides that miss it. Keys are folded on each side and then
    counted over their union, so there is one shuffle and no chain of full joins."""
    names = list(sides)
    union = None
    for name in names:
        one = sides[name].select(key).distinct().select(key, *[F.lit(n == name).alias(f"in_{n}") for n in names])
        union = one if union is None else union.unionByName(one)
    each = union.groupBy(key).agg(*[F.max(f"in_{n}").alias(f"in_{n}") for n in names])
    missing = F.array_join(F.filter(F.array(*[F.when(~F.col(f"in_{n}"), F.lit(n)) for n in names]), lambda x: x.isNotNull()), "+")
    return each.withColumn("label", F.when(missing == "", "consistent").otherwise(F.concat(F.lit("missing in "), missing)))


#: What it is called when some sources have an entry and others don't. A rule looks at the named sources only.
FINDINGS = (
    ("possible_sale_missing_from_books", {"gstr_1": True, "bank": True, "books": False}),
    ("possible_gst_reporting_gap", {"books": True, "bank": True, "gstr_1": False}),
    ("documents_or_books_entry_missing", {"gstr_2b": True, "invoice": False, "books": False}),
    ("supporting_document_missing", {"gstr_2b": True, "invoice": False, "books": True}),
)


def inconsistencies(present: DataFrame, findings: tuple = FINDINGS) -> DataFrame:
    """present (of presence(), columns in_<source>) with finding: the first rule that fits a key, or null. A rule about a source that wasn't compared
    can't fit."""
    found = F.lit(None).cast("string")
    for name, rule in reversed(findings):
        if all(f"in_{source}" in present.columns for source in rule):
            found = F.when(reduce(lambda x, y: x & y, [F.col(f"in_{source}") == F.lit(has) for source, has in rule.items()]), name).otherwise(found)
    return present.withColumn("finding", found)


def period_owners(periods: DataFrame, clients: DataFrame) -> DataFrame:
    """period_id, label, client_id, client, gstin: whose each period is; a period of an unknown client stays, without one."""
    own = clients.select("client_id", F.col("name").alias("client"), "gstin")
    return periods.select("period_id", "label", "client_id").join(own, "client_id", "left").select("period_id", "label", "client_id", "client", "gstin")


def missing_months(rows: DataFrame, account: str, day: str) -> DataFrame:
    """account, month (first day): the months without a row between an account's first and last one."""
    months = rows.where(F.col(day).isNotNull()).select(account, F.trunc(day, "month").alias("month")).distinct()
    span = months.groupBy(account).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    return span.select(account, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")).join(months, [account, "month"], "left_anti")


def missing_documents(portal: DataFrame, invoices: DataFrame) -> DataFrame:
    """Portal entries for which there is no invoice document with the same key."""
    return keyed(portal).join(keyed(invoices).select(*KEY).distinct(), KEY, "left_anti").drop(*KEY)


def coverage_gaps(statements: DataFrame, accounts: DataFrame, start: Column, end: Column) -> DataFrame:
    """account, gap_from, gap_to, days: the stretches of a period that no statement of an account covers, at both ends as well.

    statements: account, day_from, day_to (both included; turned ones are put right, ones without both days are left out); accounts: account, all that are known, so one
    without any statement lacks the whole period. Statements are cut to the period and those that overlap or touch are joined to
    islands by the greatest end so far; a gap is what lies before an island, or after the last one.
    """
    low, high = F.least("day_from", "day_to"), F.greatest("day_from", "day_to")
    own = statements.where("day_from is not null and day_to is not null").select("account", F.greatest(low, start).alias("a"), F.least(high, end).alias("b")).where("a <= b")
    known = accounts.select("account").distinct()
    # an empty island after the period, so that what follows the last one is a gap like any other
    every = own.join(known, "account", "left_semi").unionByName(known.select("account", F.date_add(end, 1).alias("a"), F.date_add(end, 1).alias("b")))
    before = Window.partitionBy("account").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("b").over(before), F.date_sub(start, 1))
    gaps = every.withColumn("reached", reached).where(F.col("a") > F.date_add("reached", 1))
    return gaps.select("account", F.date_add("reached", 1).alias("gap_from"), F.date_sub("a", 1).alias("gap_to"), (F.datediff("a", "reached") - 1).alias("days"))


def missing_statement_months(gaps: DataFrame) -> DataFrame:
    """account, month (first day), days: how many days of each month lie in gaps."""
    month = F.explode(F.sequence(F.trunc("gap_from", "month"), F.trunc("gap_to", "month"), F.expr("interval 1 month"))).alias("month")
    each = gaps.select("account", "gap_from", "gap_to", month)
    days = F.datediff(F.least("gap_to", F.last_day("month")), F.greatest("gap_from", "month")) + 1
    return each.groupBy("account", "month").agg(F.sum(days).cast("int").alias("days"))


def unusual_months(monthly: DataFrame, account: str, factor: float = 3.0, least: int = 3, floor: float = 0.1) -> DataFrame:
    """monthly (account, month, amount) with months_before, median_before, spread_before and activity: low, high, normal, or null while there are
    fewer than `least` months before.

    What was usual is the median of the months before, how far months strayed from it the median distance from it, times 1.4826, and `floor` of the median at
    least, so that equal months don't make every change unusual. A month is low or high from more than `factor` spreads on. An account's months are bounded by
    the calendar, so they are an array in its rows. Months without an amount count for nothing.
    """
    before = Window.partitionBy(account).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    median = lambda x: (F.get(x, F.floor((F.size(x) - 1) / 2).cast("int")) + F.get(x, F.floor(F.size(x) / 2).cast("int"))) / 2
    df = monthly.withColumn("__past", F.sort_array(F.collect_list(F.col("amount").cast("double")).over(before)))
    df = df.withColumns({"months_before": F.size("__past"), "median_before": median(F.col("__past"))})
    df = df.withColumn("__off", F.sort_array(F.transform("__past", lambda x: F.abs(x - F.col("median_before")))))
    df = df.withColumn("spread_before", F.greatest(1.4826 * median(F.col("__off")), floor * F.abs("median_before")))
    off = F.col("amount").cast("double") - F.col("median_before")
    told = F.when(off < -factor * F.col("spread_before"), "low").when(off > factor * F.col("spread_before"), "high").otherwise("normal")
    return df.withColumn("activity", F.when((F.col("months_before") >= least) & F.col("amount").isNotNull(), told)).drop("__past", "__off")


def graded_activity(documents: DataFrame, evidence: dict[str, DataFrame], account: str) -> DataFrame:
    """account, month, amount, activity and grade of documents (account, month, amount), with what other sources say of the same month.

    A low month is merely unusual_low if every source that has the month is low as well, and probably_missing if one of them is not; without any it is
    low_without_evidence. A high one is unusual_high, all others are usual.
    """
    df = unusual_months(documents, account).select(account, "month", "amount", "activity")
    names = list(evidence)
    for name in names:
        df = df.join(unusual_months(evidence[name], account).select(account, "month", F.col("activity").alias(f"in_{name}")), [account, "month"], "left")
    said = F.array_compact(F.array(*[F.col(f"in_{n}") for n in names])) if names else F.array().cast("array<string>")
    low = F.when(F.size(said) == 0, "low_without_evidence").when(F.forall(said, lambda x: x == "low"), "unusual_low").otherwise("probably_missing")
    return df.withColumn("grade", F.when(F.col("activity") == "low", low).when(F.col("activity") == "high", "unusual_high").otherwise("usual"))


def monthly_quota(files: DataFrame, client: str, created: str, most: int = 100) -> DataFrame:
    """client, month, files, over: how many files each client added in a month, and whether that is more than the plan allows."""
    return files.groupBy(client, F.date_format(created, "yyyy-MM").alias("month")).agg(F.count("*").alias("files")).withColumn("over", F.col("files") > most)

