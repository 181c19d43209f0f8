"""Bank statements: lines to transactions, alignment with the running balance, balance checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import DATE, day_first, first_date
from ..functions.geometry import box_text
from ..functions.money import MONEY, amounts_in, edge, or_zero, within_tolerance
from ..functions.text import add_flags, any_of, flag, let, squeeze
from ..sources.staging import staged
from .chain import accepted

#: Lines that are never transactions, labels, and references.
SKIP = r"(?i)page\s+\d+|statement of account|account statement|customer id|nomination|gstin of bank|relationship manager|continued on next|computer generated|end of statement|confidential|^summary\b|debits\s+\d+|opening\s+[\d,]+|this statement is system"
OPENING, CLOSING = r"(?i)opening\s+balance", r"(?i)closing\s+balance"
HEADING = r"(?i)txn date|narration|withdrawal|transaction remarks|closing balance|debit credit|chq / ref|description"
ACCOUNT = r"(?i)\b(?:a/?c|account)\s*(?:no|number|#)?\.?\s*[:\-]?\s*(\d{9,18})\b"
IFSC = r"\b([A-Z]{4}0[A-Z0-9]{6})\b"
REFERENCE = r"(?i)\b(?:chq|cheque|ref)[^\d]{0,6}(\d{4,})\b"
CREDIT_TALK = ("deposit", "neft inward", "imps", "salary", "refund")
#: Bank, label, what names it, and its words for both sides.
PLAIN_WORDS = (("withdrawal", "dr", "debit"), ("deposit", "cr", "credit"))
PROFILES = (
    ("hdfc", "HDFC Bank", ("hdfc",), *PLAIN_WORDS),
    ("icici", "ICICI Bank", ("icici",), *PLAIN_WORDS),
    ("sbi", "State Bank of India", ("state bank", "sbi ", " sbi", "sbi_", "sbi-"), ("debit", "withdrawal", "dr", "to transfer", "atm wdl", "cheque wdl"), ("credit", "deposit", "cr", "by transfer", "cash deposit")),
    ("axis", "Axis Bank", ("axis",), *PLAIN_WORDS),
    ("kotak", "Kotak Mahindra Bank", ("kotak",), *PLAIN_WORDS),
)
GENERIC = ("generic", "Bank statement")


def profile(name: Column, header_text: Column) -> Column:
    """Key of the bank: what the file name says, then the first 500 characters; else generic."""
    out = F.lit(GENERIC[0])
    head = F.lower(F.substring(header_text, 1, 500))
    for text in (head, F.lower(name)):
        for key, _, marks, _, _ in reversed(PROFILES):
            out = F.when(any_of(text, marks), key).otherwise(out)
    return out


def profile_label(key: Column) -> Column:
    out = F.lit(GENERIC[1])
    for k, label, *_ in PROFILES:
        out = F.when(key == k, label).otherwise(out)
    return out


def _side_words(key: Column, text: Column, side: int) -> Column:
    out = any_of(text, PLAIN_WORDS[side])
    for k, _, _, *words in PROFILES:
        if words[side] != PLAIN_WORDS[side]:
            out = F.when(key == k, any_of(text, words[side])).otherwise(out)
    return out


def continues(text: Column) -> Column:
    """Whether a line without a date goes on with the transaction before it."""
    return ~((F.length(text) < 4) | text.rlike(SKIP) | text.rlike(HEADING) | text.rlike(OPENING) | text.rlike(CLOSING) | text.rlike(r"^[\d,.\s]+$"))


def statement_context(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Per file: profile, opening, stated_closing, account_number, ifsc. lines: file_id, line_no, page, text; files: file_id, name.

    A label's amount is the last one of the first line that has both. The header is the text of the first two pages, in order; account number and
    code are looked for in it as a whole, so a label and its digits may stand on different lines.
    """
    last = F.when(F.col("text").rlike(OPENING) | F.col("text").rlike(CLOSING), let(amounts_in("text"), lambda a: F.get(a, F.size(a) - 1)))
    lines = lines.withColumn("__last", last)
    labelled = lambda label: F.min_by("__last", F.when(F.col("text").rlike(label) & F.col("__last").isNotNull(), F.col("line_no")))
    head = F.col("page") <= 2
    found = lambda text, shape: F.nullif(F.regexp_extract(text, shape, 1), F.lit(""))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(head, F.struct("line_no", "text")))), lambda x: x["text"]), "\n")
    each = lines.groupBy("file_id").agg(labelled(OPENING).alias("opening"), labelled(CLOSING).alias("stated_closing"), top.alias("__head"))
    joined = files.select("file_id", "name").join(each, "file_id", "left")
    key = profile(F.coalesce("name", F.lit("")), F.coalesce("__head", F.lit("")))
    return joined.select("file_id", "name", key.alias("profile"), profile_label(key).alias("account_name"), "opening", "stated_closing", found(F.col("__head"), ACCOUNT).alias("account_number"), found(F.upper("__head"), IFSC).alias("ifsc"))


def description(text: Column, amounts: Column) -> Column:
    """The line without its first date and its last three amounts, taken out one after the other as text in thousands grouping and plain."""
    shown = F.flatten(F.transform(F.slice(amounts, -F.least(F.size(amounts), F.lit(3)), F.lit(3)), lambda a: F.array(F.format_number(a, 2), a.cast("string"))))
    rest = F.aggregate(shown, F.regexp_replace(text, f"^(.*?){DATE}", "$1"), lambda left, a: F.replace(left, a, F.lit("")))
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(rest, r"\s{2,}", " "), F.lit(" -|")), F.lit("")), text)


def line_columns(lines: DataFrame, context: DataFrame) -> DataFrame:
    """lines with what each line gives as a transaction: is_row, continues, has_date, date, debit, credit, balance, description, cheque_ref, source.

    A line is a row if it has a date and two amounts; the last is the balance. Of three or more, those before it are debit and
    credit; a single one is told by words. All of it is columns; only align() needs the lines in order.
    """
    text = squeeze("text")
    df = lines.withColumn("txt", text).join(context.select("file_id", "name", "profile"), "file_id")
    df = df.withColumns({"amounts": amounts_in("txt"), "raw_date": first_date("txt")})
    t, low, n = F.col("txt"), F.lower("txt"), F.size("amounts")
    is_row = (F.length(t) >= 8) & ~t.rlike(SKIP) & ~t.rlike(OPENING) & ~t.rlike(CLOSING) & F.col("raw_date").isNotNull() & (n >= 2)
    a, b = F.get("amounts", n - 3), F.get("amounts", n - 2)
    credit_side = (_side_words(F.col("profile"), low, 1) & ~_side_words(F.col("profile"), low, 0)) | any_of(low, CREDIT_TALK)
    box = F.when((F.col("width") != 0) | (F.col("height") != 0), box_text(F.col("x"), F.col("y"), F.col("width"), F.col("height")))
    return df.select(
        "file_id", "line_no", "page", "txt", is_row.alias("is_row"), continues(t).alias("continues"), F.col("raw_date").isNotNull().alias("has_date"), day_first("raw_date").alias("date"),
        F.when(is_row, F.when(n >= 3, F.nullif(a, F.lit(0).cast(MONEY))).when(~credit_side, b)).alias("debit"),
        F.when(is_row, F.when(n >= 3, F.nullif(b, F.lit(0).cast(MONEY))).when(credit_side, b)).alias("credit"),
        F.when(is_row, F.get("amounts", n - 1)).alias("balance"),
        F.when(is_row, description(t, F.col("amounts"))).alias("description"), F.when(is_row, F.nullif(F.regexp_extract(t, REFERENCE, 1), F.lit(""))).alias("cheque_ref"),
        box.alias("source_bbox"), F.concat(F.col("name"), F.lit("#p"), F.col("page").cast("string"), F.coalesce(F.concat(F.lit("@"), box), F.lit(""))).alias("source"),
    )


def _settled(columns: DataFrame, openings: DataFrame) -> DataFrame:
    """file_id, line_no, row_no, debit, credit of the rows that fit the running balance, with their sides as the balance has them.

    What a row may follow, in paise: its balance with its sides taken back, or with its amount taken back from either side. Which rows follow
    one another from the opening on is found by chain.accepted().
    """
    paise = lambda c: (F.coalesce(F.col(c), F.lit(0).cast(MONEY)) * 100).cast("long")
    own = columns.where("is_row").join(openings, "file_id", "left")
    moved = F.coalesce(*[F.nullif((F.col(c) * 100).cast("long"), F.lit(0)) for c in ("debit", "credit")])
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("line_no"))
    stated = paise("balance") + paise("debit") - paise("credit")
    wants = F.array(stated, paise("balance") + moved, paise("balance") - moved).alias("wants")
    rows = staged(own.select("file_id", "line_no", nth.alias("idx"), "debit", "credit", paise("balance").alias("state"), wants, (F.col("opening") * 100).cast("long").alias("start")))
    held = rows.join(accepted(rows.select("file_id", "idx", "state", "wants", "start")), ["file_id", "idx"])
    fits = lambda i: F.coalesce(F.abs(F.get("wants", F.lit(i)) - F.col("before")) <= 100, F.lit(False))
    as_is = F.col("before").isNull() | fits(0)
    amount = F.coalesce(F.nullif("debit", F.lit(0).cast(MONEY)), F.col("credit"))
    debit = F.when(as_is, F.col("debit")).when(fits(1), amount)
    credit = F.when(as_is, F.col("credit")).when(~fits(1), amount)
    row_no = F.row_number().over(Window.partitionBy("file_id").orderBy("idx"))
    return held.select("file_id", "line_no", row_no.alias("row_no"), debit.alias("debit"), credit.alias("credit"))


def align(columns: DataFrame, context: DataFrame) -> DataFrame:
    """Each line's outcome (row, continuation, rejected, skipped), the row it belongs to, and its sides after alignment.

    The state is the last accepted balance. Which rows fit it is found in sorts and joins, whatever the length of a statement; no Python runs.
    """
    small = columns.select("file_id", "line_no", "is_row", "continues", "has_date", "debit", "credit", "balance", F.when(~F.col("has_date") | F.col("is_row"), F.col("txt")).alias("txt"))
    small = staged(small.join(context.select("file_id"), "file_id", "left_semi"))
    held = _settled(small, context.select("file_id", "opening"))
    df = small.drop("debit", "credit").join(held.withColumnRenamed("row_no", "own"), ["file_id", "line_no"], "left")
    df = df.withColumn("last", F.last("own", ignorenulls=True).over(Window.partitionBy("file_id").orderBy("line_no")))
    follows = F.col("last").isNotNull() & F.col("continues")
    outcome = F.when(follows & ~F.col("has_date"), "continuation").when(~F.col("is_row"), "skipped").when(F.col("own").isNotNull(), "row").otherwise("rejected").alias("outcome")
    adds = follows & F.col("own").isNull() & (~F.col("has_date") | F.col("is_row"))
    return df.select("file_id", "line_no", F.when(F.col("own").isNotNull() | adds, F.col("last")).alias("row_no"), outcome, "debit", "credit", F.when(adds, F.col("txt")).alias("extra"))


def transactions(lines: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): accepted transactions with what follows them added to description and raw_text; and lines that fit no balance. What a line
    gives is made once, for the fold and for its rows."""
    context = staged(statement_context(lines, files))
    columns = staged(line_columns(lines, context))
    fold = align(columns, context)
    extra = fold.where("extra is not null").groupBy("file_id", "row_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "extra"))).alias("__more"))
    more = lambda sep: F.concat(*[F.array_join(F.transform(F.coalesce("__more", F.array().cast("array<struct<line_no:int,extra:string>>")), lambda x: F.concat(F.lit(sep), x["extra"])), "")])
    own = columns.drop("debit", "credit").join(fold.where("outcome = 'row'").select("file_id", "line_no", "row_no", "debit", "credit"), ["file_id", "line_no"])
    rows = own.join(extra, ["file_id", "row_no"], "left").join(context.select("file_id", "account_number", "ifsc", "account_name"), "file_id")
    rows = rows.select("file_id", "row_no", "date", F.trim(F.concat("description", more(" "))).alias("description"), "cheque_ref", "debit", "credit", "balance", F.col("page").alias("source_page"), "source_bbox", "source", F.concat("txt", more(" | ")).alias("raw_text"), "account_number", "ifsc", "account_name")
    return rows, fold.where("outcome = 'rejected'").select("file_id", "line_no").join(columns.select("file_id", "line_no", "txt"), ["file_id", "line_no"])


def _ordered(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("row_no")


def running_check(rows: DataFrame, openings: DataFrame) -> DataFrame:
    """rows (file_id, row_no, debit, credit, balance) with expected, flags, opening_balance and opening_inferred.

    The expected balance adds up from the last stated one, which counts as right from there on; rows without one go on adding and
    are flagged missing_balance. Where openings (file_id, opening) has none, it follows from the first row.
    """
    w = _ordered("file_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(openings.select("file_id", "opening"), "file_id", "left")
    first = lambda c: F.first(or_zero(c)).over(w)
    inferred = first("balance") + first("debit") - first("credit")
    rows = rows.withColumns({"opening_inferred": F.col("opening").isNull(), "opening_balance": F.coalesce("opening", inferred).cast(MONEY), "__run": F.count("balance").over(before), "__last": F.last("balance", ignorenulls=True).over(before)})
    moved = F.sum(or_zero("credit") - or_zero("debit")).over(_ordered("file_id", "__run"))
    rows = rows.withColumn("expected", (F.coalesce("__last", "opening_balance") + moved).cast(MONEY))
    off = ~within_tolerance(F.col("expected"), F.col("balance"))
    own = F.col("flags") if "flags" in rows.columns else F.array().cast("array<string>")
    return rows.withColumn("flags", add_flags(own, flag(F.col("balance").isNull(), "missing_balance"), flag(F.coalesce(off, F.lit(False)), "balance_mismatch"))).drop("__run", "__last", "opening")


def balance_summary(checked: DataFrame, files: DataFrame) -> DataFrame:
    """One row per file of files (file_id, opening, stated_closing): opening and closing balances, match, first broken row, flags, rows.

    A file without rows compares its opening with the stated closing and has outcome empty, so it never looks processed.
    """
    bad = F.array_contains("flags", "balance_mismatch")
    each = checked.groupBy("file_id").agg(F.min_by("opening_balance", "row_no").alias("__open"), F.max_by(or_zero("balance"), "row_no").alias("__last"), F.min(F.when(bad, F.col("row_no"))).alias("broken_at_row"), F.count("*").alias("row_count"))
    df = files.select("file_id", "opening", "stated_closing").join(each, "file_id", "left")
    last = F.coalesce("__last", or_zero("opening"))
    match = within_tolerance(last, F.coalesce("stated_closing", last)) & F.col("broken_at_row").isNull()
    flags = add_flags(flag(F.col("broken_at_row").isNotNull(), "balance_mismatch"), flag(F.col("stated_closing").isNotNull() & ~match, "closing_mismatch"))
    return df.select("file_id", edge(F.coalesce("__open", "opening")).alias("opening_balance"), F.col("opening").isNull().alias("opening_inferred"), edge("stated_closing").alias("stated_closing"), edge(last).alias("computed_closing"), match.alias("match"), F.when(match, "match").otherwise("mismatch").alias("status"), "broken_at_row", flags.alias("flags"), F.coalesce("row_count", F.lit(0)).alias("row_count"), F.when(F.col("row_count") > 0, "processed").otherwise("empty").alias("parse_outcome"))


def stamp_closing(checked: DataFrame, summary: DataFrame) -> DataFrame:
    """checked with closing_mismatch on the last row of files whose summary has it."""
    wrong = summary.where(F.array_contains("flags", "closing_mismatch")).select("file_id", "row_count", F.lit(True).alias("__wrong"))
    last = checked.join(wrong, "file_id", "left").withColumn("__last", F.row_number().over(_ordered("file_id")) == F.col("row_count"))
    return last.withColumn("flags", add_flags(F.col("flags"), flag(F.coalesce(F.col("__wrong") & F.col("__last"), F.lit(False)), "closing_mismatch"))).drop("__wrong", "__last", "row_count")


#: The least confidence of a recognised word, and how far items of a line may differ in height, by font size or by the height of a word.
CONFIDENCE, SLACK, FONT_SHARE, WORD_SHARE = 40, 3.0, 0.45, 0.6


def _bands(group: pd.DataFrame) -> pd.DataFrame:
    """Items in order to bands: each joins the first band whose first item is near in height. Bands begin ever lower, so those that are still in
    reach of any later item are the last ones; with the widest reach of the page known, the others are left behind for good."""
    group = group.sort_values(["top", "x"], ascending=[False, True], kind="stable")
    y, slack, widest = group["y"].to_list(), group["slack"].to_list(), group["slack"].max()
    drop = float((group["top"] - group["y"]).max() - (group["top"] - group["y"]).min())  # how far y may lag behind the order
    first, members, oldest = [], [], 0
    for i, at in enumerate(y):
        while oldest < len(first) and first[oldest] - at > widest + drop:
            oldest += 1
        for b in range(oldest, len(first)):
            if abs(at - first[b]) <= slack[i]:
                members[b].append(i)
                break
        else:
            first.append(at)
            members.append([i])
    x, w, h, text = (group[c].to_list() for c in ("x", "width", "height", "text"))
    rows = []
    for n, own in enumerate(members):
        own = sorted(own, key=lambda i: x[i])
        left, low = min(x[i] for i in own), min(y[i] for i in own)
        rows.append((group["file_id"].iloc[0], group["page"].iloc[0], n, " ".join(text[i].strip() for i in own), left, low, max(x[i] + w[i] for i in own) - left, max(y[i] + h[i] for i in own) - low))
    return pd.DataFrame(rows, columns=["file_id", "page", "band", "text", "x", "y", "width", "height"])


def _grouped(items: DataFrame) -> DataFrame:
    whole = items.where(F.trim("text") != "").groupBy("file_id", "page").applyInPandas(_bands, "file_id long, page int, band int, text string, x double, y double, width double, height double")
    return whole.withColumn("line_no", F.row_number().over(Window.partitionBy("file_id").orderBy("page", "band")))


def group_lines(items: DataFrame) -> DataFrame:
    """Visual lines of positioned text items (file_id, page, text, x, y, width, height, font_size): from the top, each item joins the first
    band whose first item is near in height. Order decides, so each page is folded by one task; a page is bounded."""
    small = items.select("file_id", "page", "text", "x", "y", "width", "height", F.col("y").alias("top"), F.greatest(F.lit(SLACK), FONT_SHARE * F.col("font_size")).alias("slack"))
    return _grouped(small)


def recognised_items(words: DataFrame) -> DataFrame:
    """Items in page units, counted from the bottom, of recognised words (file_id, page, level, text, conf, left, top, width, height in pixels, scale,
    page_height): single words (level 5, where told) with enough confidence and a size."""
    conf = F.coalesce(F.col("conf").cast("string").try_cast("double"), F.lit(-1.0))
    fine = (F.coalesce("level", F.lit(5)) == 5) & (F.trim(F.coalesce("text", F.lit(""))) != "") & (conf >= CONFIDENCE) & (F.col("width") > 0) & (F.col("height") > 0) & (F.col("scale") > 0)
    px = lambda c: F.col(c).cast("double") / F.col("scale")
    return words.where(fine).select("file_id", page_number(F.col("page")).alias("page"), F.trim("text").alias("text"), px("left").alias("x"), (F.col("page_height") - (F.col("top") + F.col("height")) / F.col("scale")).cast("double").alias("y"), px("width").alias("width"), px("height").alias("height"))


def recognised_lines(words: DataFrame) -> DataFrame:
    """Visual lines of recognised words: as group_lines(), in the order of the words' middles and with a reach by their height."""
    items = recognised_items(words).withColumns({"top": F.col("y") + F.col("height") / 2, "slack": F.greatest(F.lit(SLACK), WORD_SHARE * F.col("height"))})
    return _grouped(items)


def needs_ocr(pdf_type: Column, page_needs: Column, lines: Column) -> Column:
    """Whether a file has to be recognised: scanned, all pages ask for it, or next to nothing can be read. lines: array of text."""
    full = F.filter(lines, lambda t: F.trim(t) != "")
    little = (F.size(full) < 2) & (F.length(F.array_join(full, "")) < 20)
    return pdf_type.isin("scanned", "image_based") | ((F.size(page_needs) > 0) & F.forall(page_needs, lambda p: p)) | little


def page_number(page: Column) -> Column:
    """Pages counted from one."""
    return F.when(page <= 0, page + 1).otherwise(page)
