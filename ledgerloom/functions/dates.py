"""Dates stay text: day first, never validated; try_date() adds a checked DATE where one is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, blank_to_null, let

#: Fixed value: what counts as a date in a line.
DATE = r"\b(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})\b"


def first_date(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(text), DATE, 1), F.lit(""))


def _iso(year: Column, month: Column, day: Column) -> Column:
    numbers = F.transform(F.array(year, month, day), lambda c: F.trim(c).try_cast("int"))
    digits = lambda x, of: F.substring((x + of).cast("string"), 2, 4)
    usual = lambda n: n[0].between(0, 9999) & n[1].between(0, 99) & n[2].between(0, 99)
    plain = lambda n: F.concat_ws("-", digits(n[0], 10_000), digits(n[1], 100), digits(n[2], 100))
    return let(numbers, lambda n: F.when(usual(n), plain(n)).when(F.forall(n, lambda x: x.isNotNull()), F.format_string("%04d-%02d-%02d", n[0], n[1], n[2])))


def _parts(text: Column) -> Column:
    """What stands between / - and . in a text; one separator for all, as a pattern would be compiled for each row."""
    return F.split(F.translate(text, "-.", "//"), "/")


def _century(year: Column) -> Column:
    return F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)


def _day_first(text: Column, parts: Column) -> Column:
    return F.when(F.size(parts) != 3, text).otherwise(_iso(_century(F.get(parts, F.lit(2))), F.get(parts, F.lit(1)), F.get(parts, F.lit(0))))


def _year_first(text: Column, parts: Column) -> Column:
    return F.coalesce(_iso(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))), text)


def day_first(raw: Column | str) -> Column:
    """d/m/y with any of / - . as YYYY-MM-DD, two-digit years in this century. Other text is kept, but three parts that aren't numbers
    give null."""
    return let(F.trim(_c(raw)), lambda text: let(_parts(text), lambda parts: _day_first(text, parts)))


def sheet_date(raw: Column | str) -> Column:
    """A date of a spreadsheet export: ISO prefix, year-first parts, else day first; null stays null. The two usual forms are cut out of the text;
    only others are taken apart, by expressions that no code is generated for."""

    def told(text: Column, parts: Column) -> Column:
        year_first = (F.size(parts) == 3) & F.get(parts, F.lit(0)).rlike(r"^\d{4}$")
        return F.when(year_first, _year_first(text, parts)).otherwise(_day_first(text, parts))

    text = blank_to_null(raw)
    turned = F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2))
    other = let(text, lambda t: let(_parts(t), lambda parts: told(t, parts)))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)).when(text.rlike(r"^\d{2}[/\-.]\d{2}[/\-.]\d{4}\z"), turned).otherwise(other)


def compact_date(raw: Column | str) -> Column:
    """YYYYMMDD as YYYY-MM-DD, other text as it is."""
    text = F.nullif(_c(raw), F.lit(""))
    return F.when(text.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))).otherwise(text)


def try_date(raw: Column | str) -> Column:
    """A checked DATE from the four usual forms; null if none fits."""
    text = F.substring(F.trim(_c(raw)), 1, 10)
    turned = lambda *year: F.concat(*year, F.lit("-"), F.substring(text, 4, 2), F.lit("-"), F.substring(text, 1, 2)).try_cast("date")
    long = turned(F.substring(text, 7, 4))
    short = turned(F.lit("20"), F.substring(text, 7, 2))
    forms = ((r"^\d{4}-\d{2}-\d{2}\z", text.try_cast("date")), (r"^(\d{2}-\d{2}-\d{4}|\d{2}/\d{2}/\d{4})\z", long), (r"^\d{2}/\d{2}/\d{2}\z", short))
    return F.coalesce(*[F.when(text.rlike(shape), found) for shape, found in forms])


def period_label(day: Column | str) -> Column:
    return F.date_format(_c(day), "MMM yyyy")


def label_bounds(label: Column | str) -> tuple[Column, Column]:
    """First and last day of the month that a label like Apr 2025 names; nulls for other labels."""
    first = F.try_to_timestamp(F.initcap(F.trim(_c(label))), F.lit("MMM yyyy")).cast("date")
    return first, F.last_day(first)


def out_of_period(day: Column | str, start: Column, end: Column) -> Column:
    """Whether a date text is a date outside the period; text that is no date is not flagged."""
    return F.coalesce(let(try_date(day), lambda found: (found < start) | (found > end)), F.lit(False))
