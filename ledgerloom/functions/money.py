"""Amounts: found in text and parsed to DECIMAL(18,2); ANSI-safe on dirty input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

#: What counts as an amount in a line, and the tolerance of all balance checks.
AMOUNT = r"(?=[₹\d])(?:₹\s*)?(\d{1,3}(?:,\d{2,3})+(?:\.\d{1,2})?|\d+\.\d{2})(?!\.\d)"
TOLERANCE = "1.00"
MONEY = "decimal(18,2)"


def parse_amount(raw: Column | str) -> Column:
    """A number with rupee sign, blanks and thousands commas; null if it is none."""
    return F.translate(_c(raw), "₹ ,", "").try_cast(MONEY)


def amounts_in(text: Column | str) -> Column:
    """All amounts of a text in order, as an array."""
    found = F.regexp_extract_all(F.replace(_c(text), F.lit("₹"), F.lit("")), F.lit(AMOUNT), 1)
    return F.filter(F.transform(found, parse_amount), lambda x: x.isNotNull())


def first_amount(text: Column | str) -> Column:
    """The first amount; one that is too long for an amount is passed over."""
    first = parse_amount(F.regexp_extract(F.replace(_c(text), F.lit("₹"), F.lit("")), AMOUNT, 1))
    return F.coalesce(first, F.get(amounts_in(text), F.lit(0)))


def loose_number(raw: Column | str) -> Column:
    """A double from text with rupee sign, commas or percent sign; null if it is none."""
    return F.trim(F.translate(_c(raw), "₹,%", "")).try_cast("double")


def absolute_amount(raw: Column | str) -> Column:
    """The absolute value of a number with thousands commas."""
    return F.abs(F.trim(F.replace(_c(raw), F.lit(","), F.lit(""))).try_cast("double"))


def within_tolerance(left: Column, right: Column) -> Column:
    return F.abs(left - right) <= F.lit(TOLERANCE).cast(MONEY)


def or_zero(value: Column | str) -> Column:
    return F.coalesce(_c(value), F.lit(0).cast(MONEY))


def edge(value: Column | str) -> Column:
    """A double for reports, rounded half up to the paisa."""
    return F.round(_c(value).cast("decimal(20,4)"), 2).cast("double")
