"""Alignment with the running balance, against a fold that goes through the lines one by one."""

import random
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import bank, chain

COLUMNS = "file_id long, line_no int, is_row boolean, continues boolean, has_date boolean, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2), txt string"


def fold(lines, opening):
    """Outcomes of one statement in order, as the rules are told."""
    near, running, row_no, out = Decimal("1.00"), opening, 0, []
    for f, line, is_row, continues, has_date, debit, credit, balance, txt in sorted(lines, key=lambda x: x[1]):
        if row_no and not has_date and continues:
            out.append((f, line, row_no, "continuation", None, None, txt))
            continue
        if not is_row:
            out.append((f, line, None, "skipped", None, None, None))
            continue
        fits = True
        if running is not None and abs(running - (debit or 0) + (credit or 0) - balance) > near:
            moved = debit or credit
            if moved and abs(running - moved - balance) <= near:
                debit, credit = moved, None
            elif moved and abs(running + moved - balance) <= near:
                debit, credit = None, moved
            else:
                fits = False
        if fits:
            row_no, running = row_no + 1, balance
            out.append((f, line, row_no, "row", debit, credit, None))
        else:
            adds = bool(row_no and continues)
            out.append((f, line, row_no if adds else None, "rejected", None, None, txt if adds else None))
    return out


def statement(r, f):
    """A statement in disorder: wrong sides, wrong balances, balances that come back, noise."""
    money = lambda x: None if x is None else Decimal(x).scaleb(-2)
    total, lines = r.choice([0, 500, 100_000]), []
    opening = r.choice([total, None, total + 90, total + 7_000])
    for n in range(r.randint(0, 60)):
        amount, pays = r.choice([0, 50, 100, 150, r.randint(1, 900)]), r.random() < 0.5
        new = total + (-amount if pays else amount)
        state = new + r.choice([0, 0, 0, 0, 60, -100, 101, 5_000, -250])
        if r.random() < 0.7:
            total = new
        debit, credit = (amount, None) if pays == (r.random() < 0.8) else (None, amount)
        if r.random() < 0.05:
            debit = credit = amount
        kind = r.random()
        if kind < 0.75:
            lines.append((f, n * 2, True, r.random() < 0.5, True, money(debit), money(credit), money(state), f"t{n}"))
        else:
            lines.append((f, n * 2, False, r.random() < 0.6, r.random() < 0.3, None, None, None, f"x{n}"))
    return lines, money(opening)


def test_align_equals_the_fold(spark):
    r = random.Random(9)
    every = [statement(r, f) for f in range(250)]
    rows = [x for lines, _ in every for x in lines]
    r.shuffle(rows)
    openings = spark.createDataFrame([(f, o) for f, (_, o) in enumerate(every)], "file_id long, opening decimal(18,2)")
    got = bank.align(spark.createDataFrame(rows, COLUMNS), openings).select("file_id", "line_no", "row_no", "outcome", "debit", "credit", "extra").collect()
    want = [x for lines, o in every for x in fold(lines, o)]
    assert sorted(map(tuple, got), key=lambda x: x[:2]) == sorted(want, key=lambda x: x[:2])
    assert {x[3] for x in want} == {"row", "continuation", "skipped", "rejected"}
    plan = bank.align(spark.createDataFrame(rows, COLUMNS), openings)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert bank.align(spark.createDataFrame([], COLUMNS), openings).count() == 0


def test_ranges_are_just_the_interval(spark):
    rows = [(a, a + n) for a in (-300, -129, -1, 0, 5, 127, 1000) for n in (0, 1, 63, 127, 200, 254)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", chain._ranges(F.col("a"), F.col("b")).alias("r"))
    for x in df.collect():
        covered = [v for n in x["r"] for v in range(n["node"] << n["level"], (n["node"] + 1) << n["level"])]
        assert sorted(covered) == list(range(x["a"], x["b"] + 1)) and len(x["r"]) <= 16


def test_a_statement_of_a_million_lines(spark):
    """One file, every fiftieth line a stray one, and balances that come back to the same values all the time: all in sorts and joins."""
    n = 1_000_000
    idx = F.col("id").cast("int") + 1
    amount = F.pmod(F.xxhash64("id"), F.lit(5_000)) + 200
    gain = F.when(F.col("id") % 2 == 0, amount).otherwise(-amount)
    wrong = F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)) == 0, 33_333).otherwise(0)
    total = F.sum(F.when(F.col("wrong") == 0, F.col("gain")).otherwise(0)).over(Window.partitionBy("file_id").orderBy("id"))
    df = spark.range(n).select("id", F.lit(1).cast("long").alias("file_id"), idx.alias("idx"), gain.alias("gain"), wrong.alias("wrong"))
    df = df.withColumn("state", total + F.col("wrong")).select("file_id", "idx", "state", F.array(F.col("state") - F.col("gain"), F.col("state") + F.abs("gain"), F.col("state") - F.abs("gain")).alias("wants"), F.lit(0).cast("long").alias("start"))
    data = df.orderBy("idx").toPandas()
    want, running = [], 0
    for i, state, wants in zip(data["idx"].tolist(), data["state"].tolist(), data["wants"].tolist(), strict=True):
        if any(abs(w - running) <= 100 for w in wants):
            want.append((i, running))
            running = state
    got = chain.accepted(df).select("idx", "before").orderBy("idx").toPandas()
    assert list(zip(got["idx"].tolist(), got["before"].tolist(), strict=True)) == want
    assert 0.9 * n < len(want) < 0.99 * n
