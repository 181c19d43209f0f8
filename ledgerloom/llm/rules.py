"""Quality rules: counts within a text, and lines that too many documents of a host share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import materialize

BLANKS, WINDOW = "[ \\t\\n\\x0B\\f\\r]+", 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A line is frequent if more than so many documents of its host have it.
LIMIT = 20
#: Frequent lines up to this number are looked for in each text where it lies; more are joined.
IN_PLACE = 5_000
#: A document is depleted if without frequent lines it has fewer words than this, and has lost more than half of them.
LEFT = 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), BLANKS, " "))


def repeat_words(tokens: Column) -> Column:
    """Words that lie in an 8-word window which occurs twice or more in the text, the first included.

    Windows are compared by 64-bit hashes; positions of equal ones are found by sorting, so a long text takes n log n steps.
    """

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def twins(ordered: Column) -> Column:
        marked = F.transform(ordered, lambda s, i: F.when((s["h"] == F.get(ordered, i - 1)["h"]) | (s["h"] == F.get(ordered, i + 1)["h"]), s["i"]))
        return let(F.sort_array(F.filter(marked, lambda p: p.isNotNull())), covered)

    def windows(hashes: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(hashes) - WINDOW + 1), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
        return let(each, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(let(F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twins)))

    return F.when(F.size(tokens) <= WINDOW, 0).otherwise(let(F.transform(tokens, lambda w: F.xxhash64(w)), windows))


def text_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text that isn't null."""
    full = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, BLANKS, "")) > 0)
    dup = let(full, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    long = lambda c, name: c.cast("long").alias(name)
    return let(words(text), lambda w: F.struct(long(F.size(w), "n_words"), long(F.length(F.array_join(w, "")), "word_chars"), long(F.regexp_count(text, F.lit("[#*$%&|<>]")), "n_symbols"), long(dup, "n_dup_lines"), long(repeat_words(w), "n_repeat_words")))


def too_poor(n_words: Column, n_repeat_words: Column) -> Column:
    """Whether a text has too few words or repeats too many of them."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _own(docs: DataFrame, *more: Column) -> DataFrame:
    """text, host and `more` of docs, so that no other column's name can clash; null texts and hosts are empty."""
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), *more)


def entries(text: Column, host: Column) -> Column:
    """Array of line (hash of host and normalised line) and words (0 for a blank line) of the \\n-split lines of a text, in order."""
    return F.transform(F.split(text, "\n"), lambda x: let(normal(x), lambda n: F.struct(F.xxhash64(host, n).alias("line"), F.size(words(n)).alias("words"))))


def document(identity: Column | None = None) -> Column:
    """What tells documents apart: id and text, so that a repeated row is one document and copies are several; or text alone."""
    return F.xxhash64("host", "text") if identity is None else F.xxhash64("host", identity, "text")


def line_table(own: DataFrame) -> DataFrame:
    """doc, line, words for each normalised line of each different document of own (doc, text, host); a line counts once in a document."""
    rows = own.select("doc", F.explode(F.array_distinct(entries(F.col("text"), F.col("host")))).alias("e"))
    return rows.select("doc", "e.line", "e.words").where("words > 0").groupBy("doc", "line").agg(F.max("words").alias("words"))


def frequent_lines(lines: DataFrame, limit: int = LIMIT) -> DataFrame:
    """line, n of the lines that more than `limit` documents of their host have."""
    return lines.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") > limit)


def depleted(lines: DataFrame, frequent: DataFrame, left: int = LEFT) -> DataFrame:
    """doc of the documents that frequent lines leave too little of."""
    had = lines.join(frequent.select("line"), "line").groupBy("doc").agg(F.sum("words").alias("lost"))
    total = lines.groupBy("doc").agg(F.sum("words").alias("total"))
    return had.join(total, "doc").where(too_little(F.col("total"), F.col("lost"), left)).select("doc")


def too_little(total: Column, lost: Column, left: int) -> Column:
    """Whether fewer than `left` words and less than half remain."""
    return (total - lost < left) & (2 * lost > total)


def judge(docs: DataFrame, limit: int = LIMIT, left: int = LEFT) -> DataFrame:
    """doc_id, the counts of text_counts(), base_failed, kept for each row of docs (doc_id, text, source).

    kept is false if base_failed, or if the document is depleted by lines that more than `limit` documents of its source have; copies of a
    text under several ids are several documents. A null text is empty and fails; a null source is a source of its own; repeated rows stay
    repeated, are judged alike and count once; rows without an id are told apart by their text; an empty table gives no rows;
    other columns are ignored.
    """
    own = _own(docs, F.col("doc_id").cast("long").alias("doc_id"))
    own = own.withColumn("doc", document(F.col("doc_id")))
    counts = own.select("doc_id", "doc", text_counts(F.col("text")).alias("c")).select("doc_id", "doc", "c.*")
    counts = counts.withColumn("base_failed", too_poor(F.col("n_words"), F.col("n_repeat_words")))
    lines = materialize(line_table(own))
    gone = depleted(lines, materialize(frequent_lines(lines, limit)), left).withColumn("gone", F.lit(True))
    return counts.join(gone, "doc", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("gone").isNull()).alias("kept"))


def shared_lines(lines: DataFrame, limit: int = LIMIT) -> DataFrame:
    """line of the lines that more than `limit` documents share which are no near copies of each other.

    Of the documents that have a frequent line, one counts if such lines are at most half of its words, or if this is its only one. One
    that consists mostly of several such lines is a near copy of the others, which near-dedup deals with.
    """
    often = frequent_lines(lines, limit).select("line")
    busy = lines.join(materialize(often), "line")
    had = busy.groupBy("doc").agg(F.sum("words").alias("lost"), F.count("*").alias("n"))
    total = lines.groupBy("doc").agg(F.sum("words").alias("total"))
    counts = had.join(total, "doc").where((2 * F.col("lost") <= F.col("total")) | (F.col("n") == 1)).select("doc")
    return busy.join(counts, "doc").groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("line")


def _without(text: Column, hit) -> Column:
    """The text without its lines for which hit(place) holds."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~hit(i)), "\n")


def _in_place(values: list[int], left: int) -> Column:
    """Array of the text without the lines in `values`; empty if the document is depleted."""

    def decided(e: Column) -> Column:
        words_of = lambda x: F.aggregate(F.array_distinct(x), F.lit(0), lambda a, y: a + y["words"])
        hits = F.filter(e, lambda x: x["line"].isin(values))
        cut = F.array(_without(F.col("text"), lambda i: F.get(e, i)["line"].isin(values)))
        return let(hits, lambda h: F.when(F.size(h) == 0, F.array("text")).when(too_little(words_of(e), words_of(h), left), F.array().cast("array<string>")).otherwise(cut))

    return let(entries(F.col("text"), F.col("host")), decided)


def clean(docs: DataFrame, limit: int = LIMIT, left: int = LEFT, in_place: int = IN_PLACE) -> DataFrame:
    """The rows of docs (text, source and others) that pass the rules of judge(), without their frequent lines; n_chars, if there, is counted anew.

    Unlike there, exact copies count as one document and near copies not at all, see shared_lines(), so that near-dedup finds one of
    each group whole. Null and empty texts fail; a null source is a source of its own; repeated rows stay repeated; an empty table gives no rows;
    other columns stay as they were, whatever their names. Up to `in_place` frequent lines are looked for in each text as it is read, so
    no text is shuffled; where there are more, each text meets its own by a join on its hash. Both give the same rows.
    """
    lines = materialize(line_table(_own(docs).withColumn("doc", document())))
    frequent = materialize(shared_lines(lines, limit))
    few = [r[0] for r in frequent.limit(in_place + 1).collect()]
    own = _own(docs, F.struct(*docs.columns).alias("row"))
    if len(few) <= in_place:
        new = _in_place(few, left) if few else F.array("text")
    else:
        hits = lines.join(frequent, "line").groupBy("doc").agg(F.collect_set("line").alias("hits"))
        marks = hits.join(depleted(lines, frequent, left).withColumn("gone", F.lit(True)), "doc", "left")
        own = own.withColumn("doc", document()).join(marks, "doc", "left")
        cut = let(entries(F.col("text"), F.col("host")), lambda e: _without(F.col("text"), lambda i: F.array_contains("hits", F.get(e, i)["line"])))
        new = F.when(F.col("hits").isNull(), F.array("text")).when(F.col("gone"), F.array().cast("array<string>")).otherwise(F.array(cut))
    poor = let(words(F.col("text")), lambda w: too_poor(F.size(w), repeat_words(w)))
    kept = own.select("row", F.explode(F.when(poor, F.array().cast("array<string>")).otherwise(new)).alias("new"))
    row = F.col("row").withField("text", F.col("new"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("new").cast(docs.schema["n_chars"].dataType))
    return kept.select(row.alias("row")).select("row.*")
