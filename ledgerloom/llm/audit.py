"""How filters interact: what every order of them removes, told from one CUBE over their failure flags. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .rules import words

#: The filters of the audit by letter: whether a text fails, from the text and its words. REPEAT is told from the whole table.
REPEAT = "E"
CONDITIONS = {
    "A": lambda text, own: F.size(own) < 200,
    "B": lambda text, own: 100 * F.size(F.array_distinct(own)) < 50 * F.size(own),
    "C": lambda text, own: 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 3 * F.length(text),
    "D": lambda text, own: text.rlike(r"[#$%&*|]"),
}


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, one boolean a filter (its letter), good, toxic (0 or 1) for each row of docs.

    A row repeats if a smaller id has the same text (told by SHA-256) anywhere in docs; the least id of a text is found by a combining
    aggregate, and rows meet it by text and id, so a text with very many copies is no hot key. Null texts are empty, a null part is the empty
    string, a null id repeats nothing and is repeated by nothing; rows that repeat id and text have no smaller id. Labels of an id are folded, 1 counts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    told = plain.withColumn("own", words(F.col("text")))
    flags = [test(F.col("text"), F.col("own")).alias(letter) for letter, test in CONDITIONS.items()]
    marked = materialize(told.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), *flags))
    firsts = marked.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    one = lambda c: F.max((F.col(c) == 1).cast("int"))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    every = marked.join(firsts, ["sha", "doc_id"], "left").join(said, "doc_id", "left")
    repeat = (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias(REPEAT)
    return every.select("part", *CONDITIONS, repeat, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def survivors(flags: DataFrame, letters: str) -> DataFrame:
    """part, mask, n, good, toxic: rows of each part that fail no filter of the mask (bit i: the i-th letter); all masks, zeros included.

    Rows are first counted by part and flags, so what the cube multiplies is at most two to the number of filters per part.
    """
    counts = [F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    counted = materialize(flags.groupBy("part", *letters).agg(*counts))
    selected = [(F.grouping(x) == 0).alias(f"in_{x}") for x in letters]
    cube = counted.cube("part", *letters).agg(F.grouping("part").alias("whole"), *selected, *(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    passing = reduce(lambda a, x: a & (~F.col(f"in_{x}") | ~F.col(x)), letters, F.col("whole") == 0)
    mask = sum((F.col(f"in_{x}").cast("int") * (1 << i) for i, x in enumerate(letters)), F.lit(0)).alias("mask")
    found = cube.where(passing).select("part", mask, "n", "good", "toxic")
    grid = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(letters)) - 1))).alias("mask"))
    return grid.join(found, ["part", "mask"], "left").fillna(0, ["n", "good", "toxic"])


def _bits(letters: str, of: Column) -> Column:
    """The mask of the letters that the string `of` has."""
    return sum((F.when(F.instr(of, x) > 0, 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))


def steps(kept: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step and its counts from survivors(): each step is a pair of subsets, that before and that after it."""
    full = (1 << len(letters)) - 1
    orders = F.split(F.lit(",".join(map("".join, permutations(letters)))), ",")
    each = kept.where("mask = 0").select("part", F.col("n").alias("total"), F.explode(orders).alias("filter_order"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    letter, done = F.col("filter_order").substr(F.col("step"), F.lit(1)), F.col("filter_order").substr(F.lit(1), F.col("step"))
    each = each.withColumns({"letter": letter, "own": _bits(letters, letter), "after": _bits(letters, done)})
    each = each.withColumns({"before": F.col("after") - F.col("own"), "others": F.lit(full) - F.col("own")})
    subset = lambda name, *more: kept.select("part", F.col("mask").alias(name), F.col("n").alias(f"{name}_n"), *(F.col(c).alias(f"{name}_{c}") for c in more))
    for name, more in (("before", ("good", "toxic")), ("after", ("good", "toxic")), ("own", ()), ("others", ())):
        each = each.join(subset(name, *more), ["part", name])
    each = each.join(kept.where(F.col("mask") == full).select("part", F.col("n").alias("clean")), "part")
    lost = lambda c: F.col(f"before_{c}") - F.col(f"after_{c}")
    rows = each.select(
        "part", "filter_order", "step", "letter", F.col("after_n").alias("kept"), lost("n").alias("removed"), (F.col("total") - F.col("own_n") - lost("n")).alias("redundant"),
        (F.col("others_n") - F.col("clean")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
    )
    shares = rows.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shares, ["part", "letter"]).drop("letter")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every order of the five filters.

    Every row is counted once and every text looked at once, whatever the number of orders: only the subsets' counts are joined, 32 a part. Null
    and empty texts, null parts and ids, repeated rows and labels as in failures(); other columns of docs are ignored; no documents, no rows.
    """
    letters = "".join(CONDITIONS) + REPEAT
    kept = materialize(survivors(failures(docs, labels, id_col, text_col, part_col), letters))
    return steps(kept, letters)
