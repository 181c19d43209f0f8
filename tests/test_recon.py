"""Matching, coverage, activity and findings against plain loops and cases written by hand."""

import random
from collections import Counter
from datetime import date, timedelta
from itertools import combinations

from pyspark.sql import functions as F

from ledgerloom.functions import dates, text
from ledgerloom.operators import matching, recon, reports

DAY = date(2025, 4, 1)
SIDE = "day date, cents long, direction string, name string"


def side(r, n, first):
    """Rows that agree often."""
    return [(first + i, DAY + timedelta(r.randint(0, 20)), r.choice([100_00, 100_50, 101_20, 250_00]), r.choice(["in", "out"]), r.choice(["abc traders", "abc trader", "xyz", None])) for i in range(n)]


def test_assignment_is_stable_and_one_to_one(spark):
    r = random.Random(7)
    for n, m in ((60, 45), (30, 80)):
        bank, invoices = side(r, n, 0), side(r, m, 1000)
        bank += [(500, *bank[0][1:])] * 1 + [(None, *bank[0][1:])]
        b, v = spark.createDataFrame(bank, f"bank_id long, {SIDE}"), spark.createDataFrame(invoices, f"invoice_id long, {SIDE}")
        got = [tuple(x) for x in matching.assign(b, v).select("bank_id", "invoice_id", "score").collect()]
        assert max(Counter(x[0] for x in got).values()) == 1 and max(Counter(x[1] for x in got).values()) == 1
        kinds = lambda rows, name: spark.createDataFrame([x for x in rows if x[0] is not None], f"{name} long, {SIDE}")
        scores = {(x["b"], x["v"]): x["score"] for x in recon.near_kinds(kinds(bank, "b"), kinds(invoices, "v"), 7).collect()}
        assert all(scores[x[0], x[1]] == x[2] for x in got) and len(got) > 20
        have_b, have_v = {x[0]: x[2] for x in got}, {x[1]: x[2] for x in got}
        # nobody would rather have each other
        assert not [e for e, s in scores.items() if s > have_b.get(e[0], -1) and s > have_v.get(e[1], -1)]
    none = matching.assign(b.where("false"), v)
    assert none.count() == 0 and none.columns == ["bank_id", "invoice_id", "score", "grade"]


def test_many_equal_rows_are_one_edge(spark):
    """Two thousand equal payments of fifteen hundred equal invoices: one kind each, matched by number."""
    same = [F.lit(DAY).alias("day"), F.lit(5000).cast("long").alias("cents"), F.lit("out").alias("direction"), F.lit("x").alias("name")]
    b, v = spark.range(2000).select(F.col("id").alias("bank_id"), *same), spark.range(1500).select((F.col("id") * 2).alias("invoice_id"), *same)
    got = matching.assign(b, v).collect()
    assert sorted((x["bank_id"], x["invoice_id"]) for x in got) == [(i, 2 * i) for i in range(1500)] and {x["grade"] for x in got} == {"auto"}


def test_splits_equal_all_subsets(spark):
    r = random.Random(3)
    invoices = [(i, r.choice("ab"), DAY + timedelta(r.randint(0, 25)), r.randint(1, 40) * 100) for i in range(60)]
    payments = [(900 + k, r.choice("ab"), DAY + timedelta(r.randint(0, 25)), r.randint(2, 130) * 100) for k in range(40)] + [(990, None, DAY, 100), (991, "a", None, 100)]
    p, i = spark.createDataFrame(payments, "payment_id long, party string, day date, cents long"), spark.createDataFrame(invoices, "invoice_id long, party string, day date, cents long")
    for most in (2, 3, 4):
        want = {}
        for pid, party, day, cents in payments:
            own = [(x[0], x[3]) for x in invoices if day and x[1] == party and abs((x[2] - day).days) <= 7]
            sets = [[x[0] for x in c] for n in range(1, most + 1) for c in combinations(own, n) if sum(x[1] for x in c) == cents]
            best = min(sets, key=lambda s: (len(s), s), default=None)
            if best and len(best) > 1:
                want[pid] = (best, len(best))
        got = {x["payment_id"]: (x["invoice_ids"], x["parts"]) for x in matching.splits(p, i, most=most).collect()}
        assert got == want and want


def test_coverage_of_a_period(spark):
    d = lambda m, n: date(2025, m, n)
    rows = [("sbi", d(3, 1), d(4, 30)), ("sbi", d(5, 31), d(5, 1)), ("sbi", d(5, 10), d(6, 10)), ("sbi", d(7, 1), d(7, 31)), ("sbi", d(1, 1), d(1, 31)), ("sbi", None, d(9, 1)), ("all", d(1, 1), d(12, 31)), ("unknown", d(4, 1), d(4, 2))]
    statements = spark.createDataFrame(rows, "account string, day_from date, day_to date")
    accounts = spark.createDataFrame([("sbi",), ("all",), ("none",)], "account string")
    gaps = recon.coverage_gaps(statements, accounts, F.lit(d(4, 1)), F.lit(d(9, 30)))
    assert sorted(map(tuple, gaps.collect())) == [("none", d(4, 1), d(9, 30), 183), ("sbi", d(6, 11), d(6, 30), 20), ("sbi", d(8, 1), d(9, 30), 61)]
    months = recon.missing_statement_months(gaps).where("account = 'sbi'").orderBy("month").collect()
    assert [(x["month"], x["days"]) for x in months] == [(d(6, 1), 20), (d(8, 1), 31), (d(9, 1), 30)]


def test_a_drop_is_unusual_and_evidence_grades_it(spark):
    month = lambda k: date(2025, k, 1)
    usual = lambda last: [("c", month(k + 1), x) for k, x in enumerate([100, 104, 96, 100, last])]
    schema = "account string, month date, amount long"
    last = lambda df: df.where(F.col("month") == month(5)).first()
    docs = spark.createDataFrame([*usual(20), ("new", month(5), 3)], schema)
    assert last(recon.unusual_months(docs.where("account = 'c'"), "account"))["activity"] == "low"
    assert last(recon.unusual_months(docs.where("account = 'new'"), "account"))["activity"] is None
    equal = spark.createDataFrame([("c", month(k), x) for k, x in enumerate([100, 100, 100, 105], 1)], schema)
    assert {x["activity"] for x in recon.unusual_months(equal, "account").collect()} == {None, "normal"}
    low, steady = spark.createDataFrame(usual(15), schema), spark.createDataFrame(usual(101), schema)
    grade = lambda evidence: last(recon.graded_activity(docs.where("account = 'c'"), evidence, "account"))["grade"]
    assert grade({"bank": low, "gstr_2b": low}) == "unusual_low"
    assert grade({"bank": low, "gstr_2b": steady}) == "probably_missing"
    assert grade({}) == "low_without_evidence"
    assert last(recon.graded_activity(spark.createDataFrame(usual(400), schema), {}, "account"))["grade"] == "unusual_high"


def test_findings_need_their_sources(spark):
    one = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k string")
    both = recon.inconsistencies(recon.presence({"gstr_1": one("a", "b"), "bank": one("a", "c"), "books": one("c")}, "k"))
    assert {x["k"]: x["finding"] for x in both.collect()} == {"a": "possible_sale_missing_from_books", "b": None, "c": "possible_gst_reporting_gap"}
    assert recon.inconsistencies(recon.presence({"gstr_1": one("a"), "bank": one("a")}, "k")).first()["finding"] is None


def test_rollup_tells_null_values_from_sums(spark):
    rows = [(1, 10, "a", 5, "ready"), (1, 10, "a", 2, "open"), (1, None, "b", 3, "ready"), (2, 20, None, 1, "open")]
    out = reports.pack_totals(spark.createDataFrame(rows, "firm int, client int, period string, rows long, status string"), ["firm", "client", "period"])
    got = sorted([tuple(x) for x in out.collect()], key=str)
    want = [("all", None, None, None, 3, 4, 11, 2), ("client", 1, 10, None, 1, 2, 7, 1), ("client", 1, None, None, 1, 1, 3, 1), ("client", 2, 20, None, 1, 1, 1, 0), ("firm", 1, None, None, 2, 3, 10, 2),
            ("firm", 2, None, None, 1, 1, 1, 0), ("period", 1, 10, "a", 1, 2, 7, 1), ("period", 1, None, "b", 1, 1, 3, 1), ("period", 2, 20, None, 1, 1, 1, 0)]
    assert got == sorted(want, key=str)


def test_assignment_takes_edges_from_the_best_down(spark, monkeypatch):
    """Amounts and days on both sides of the borders of cells, against a loop over all edges; and a crowd in which all prefer the same takes no round a match."""
    r = random.Random(11)
    row = lambda k: (k, DAY + timedelta(r.randint(0, 150)), r.randint(0, 120) * 50 + 97_00, r.choice(["in", "out"]), r.choice(["abc traders", "abc trader"]))
    crowd = lambda first, step: [(first + k, DAY + timedelta(k % 7), 500_00 + k // 7 * step, "out", "x") for k in range(28)]
    bank, invoices = [row(k) for k in range(400)] + crowd(2000, 3), [row(k) for k in range(5000, 5400)] + crowd(7000, 2)
    b, v = spark.createDataFrame(bank, f"bank_id long, {SIDE}"), spark.createDataFrame(invoices, f"invoice_id long, {SIDE}")
    tables = []
    monkeypatch.setattr(matching, "staged", lambda df, keep=matching.staged: tables.append(df) or keep(df))
    got = sorted((x["bank_id"], x["invoice_id"], x["score"]) for x in matching.assign(b, v).collect())
    kinds = lambda rows: {k: sorted(x[0] for x in rows if x[1:] == k) for k in {x[1:] for x in rows}}
    left, right = kinds(bank), kinds(invoices)
    side_of = lambda of, name: spark.createDataFrame([(ids[0], *k) for k, ids in of.items()], f"{name} long, {SIDE}")
    edges = [(x["b"], x["v"], x["score"]) for x in recon.near_kinds(side_of(left, "b"), side_of(right, "v"), 7).collect()]
    spare_b, spare_v, want = {ids[0]: list(ids) for ids in left.values()}, {ids[0]: list(ids) for ids in right.values()}, []
    for x, y, score in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        while spare_b[x] and spare_v[y]:
            want.append((spare_b[x].pop(0), spare_v[y].pop(0), score))
    assert got == sorted(want) and len(want) > 200
    assert len(tables) <= 8


def test_invoices_of_splits_are_not_copied(spark):
    """Payments stand in the cells of days that they reach; an invoice goes to its own cell alone."""
    i = spark.createDataFrame([(k, "a", DAY + timedelta(k), 100) for k in range(40)], "invoice_id long, party string, day date, cents long")
    p = spark.createDataFrame([(900 + k, "a", DAY + timedelta(k), 200) for k in range(0, 40, 3)], "payment_id long, party string, day date, cents long")
    seen = []
    keep = matching.staged
    matching.staged = lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df)
    try:
        got = {x["payment_id"]: x["invoice_ids"] for x in matching.splits(p, i).collect()}
    finally:
        matching.staged = keep
    assert got == {900 + k: [max(0, k - 7), max(0, k - 7) + 1] for k in range(0, 40, 3)}
    assert seen[0].count("Generate") == 1 and "invoice_id" not in seen[0].split("Generate", 1)[1].split("\n", 1)[0] and len(seen) == 2


def test_signs_and_usual_dates_by_no_pattern(spark):
    values = lambda items, make: [r["y"] for r in spark.createDataFrame(list(enumerate(items)), "i int, x string").select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]
    items = ["INV/0-12", "a_é ß1", "\x00\x7f٣", "", None]
    assert values(items, text.alphanumeric) == ["INV012", "a1", "", "", None]
    df = spark.createDataFrame([(n, d) for n, d in (("0-00", "01-04-2025"), ("/00a0", "01/04/2025\n"), ("é", "1.4.25"), (None, "01.04.2025 x"))], "invoice_number string, invoice_date string")
    keyed = recon.keyed(df.withColumn("gstin", F.lit("x 1")))
    assert [(r["k_gstin"], r["k_invoice"], r["k_date"]) for r in keyed.collect()] == [("X1", "0", "2025-04-01"), ("X1", "A0", "2025-04-01"), ("X1", "", "2025-04-01"), ("X1", "", "")]
    # one pattern for each of the two keys, only for text beyond ASCII
    plan = keyed._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == plan.count("octet_length(") == 2 and "gettimestamp" not in dates.try_date("invoice_date")._jc.toString().lower()
    assert values(["0000-01-01", "2025-02-30", "01/04/25\n", "31-04-2025", "01-04/2025"], lambda x: dates.try_date(x).cast("string")) == ["0000-01-01", None, None, None, None]


def test_pairs_are_folded_where_they_met(spark):
    """Pairs outnumber rows where amounts are common, so none is shuffled or sorted to find the best; an invoice stands in few cells."""
    r = random.Random(9)
    amounts = [49_900 + r.randint(0, 400) for _ in range(30)]
    rows = [(i, DAY + timedelta(r.randint(0, 40)), r.choice(amounts), r.choice(["in", "out"]), r.choice(["abc", "abd", "xyz"])) for i in range(240)]
    bank, invoices = (spark.createDataFrame(own, f"{name} long, {SIDE}") for own, name in ((rows[:120], "bank_id"), (rows[120:], "invoice_id")))
    got = recon.score_matches(bank, invoices)
    points = spark.createDataFrame([(x, y) for x in ("abc", "abd", "xyz") for y in ("abc", "abd", "xyz")], "x string, y string")
    alike = {(p["x"], p["y"]): p["s"] for p in points.withColumn("s", F.floor(20 * recon.similarity(F.col("x"), F.col("y"))).cast("int")).collect()}
    want = {}
    for b in rows[:120]:
        near = [(70 + 10 * (v[3] == b[3]) + alike[v[4], b[4]], -v[0]) for v in rows[120:] if abs(v[2] - b[2]) <= 100 and abs((v[1] - b[1]).days) <= 7]
        if near:
            want[b[0]] = (-max(near)[1], max(near)[0])
    assert {x["bank_id"]: (x["invoice_id"], x["score"]) for x in got.collect()} == want and len(want) > 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(b#" not in plan and "SortAggregate" not in plan
    kinds = invoices.groupBy("day", "cents", "direction", "name").agg(F.min("invoice_id").alias("v"))
    placed = recon.near_kinds(bank, kinds, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert placed.count("Generate explode") == 2 and "array(" not in placed


def test_invoices_stand_in_few_cells(spark):
    """Payments at all ends of what invoices reach show in how many cells these stand, which is how often they are shuffled: 1.6 on average, and every pair is there once."""
    r = random.Random(5)
    rows = [(k, DAY + timedelta(r.randint(0, 2000)), r.randint(1_000_00, 900_000_00), "out", f"x{k}") for k in range(600)]
    ends = [(v, d, c, "out", "y") for v, day, cents, *_ in rows for d in (day - timedelta(7), day + timedelta(7)) for c in (cents - 100, cents + 100)]
    invoices, bank = spark.createDataFrame(rows, f"v long, {SIDE}"), spark.createDataFrame(ends, f"b long, {SIDE}").dropDuplicates()
    near = recon.near_kinds(bank, invoices, 7)
    met = near.where("b = v").select("v", "k", "cell", "span").collect()
    assert len(met) == len({(x["v"], x["k"]) for x in met}) == 4 * len(rows)
    places = {(x["v"], x["cell"], x["span"]) for x in met}
    assert len(rows) < len(places) < 1.75 * len(rows)
