"""Tax identifiers: shape, check character, code lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, flag, let

#: Shapes and the alphabet of the check character.
GSTIN = r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]"
GSTIN_LOOSE = r"\b[0-9]{2}[A-Z0-9]{13}\b"
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HSN_LENGTHS = (4, 6, 8)


def find_gstins(text: Column | str) -> Column:
    """All identifiers in a text, upper case, in order."""
    return F.regexp_extract_all(F.upper(_c(text)), F.lit(rf"\b{GSTIN}\b"), 0)


#: What a character at an even place adds is its doubled value in base 36, quotient and remainder added: the alphabet in the order of that.
_DOUBLED = "".join(sorted(ALPHABET, key=lambda x: sum(divmod(2 * ALPHABET.index(x), 36))))


def check_character(first14: Column) -> Column:
    """The 15th character for the first 14: base 36, weights 1 and 2 in turn, quotient and remainder of each product added. Fourteen terms of what is
    evaluated once: an expression in place of it would stand in the plan fourteen times, and filters that move below a projection would run all of them."""

    def found(x: Column) -> Column:
        terms = [F.instr(F.lit(_DOUBLED if i % 2 == 0 else ALPHABET), F.substring(x, i, 1)) - 1 for i in range(1, 15)]
        return F.substring(F.lit(ALPHABET), F.pmod(-sum(terms[1:], terms[0]), F.lit(36)) + 1, F.lit(1))

    return let(first14, found)


def gstin_flags(gstin: Column | str) -> Column:
    """[], or one of gstin_missing, gstin_format, gstin_checksum."""
    one = lambda code: F.array(F.lit(code))
    wrong = lambda value: check_character(F.substring(value, 1, 14)) != F.substring(value, 15, 1)
    shaped = lambda value: F.when(~value.rlike(f"^{GSTIN}$"), one("gstin_format")).when(wrong(value), one("gstin_checksum"))
    found = lambda raw: F.when(raw.isNull() | (raw == ""), one("gstin_missing")).otherwise(let(F.upper(F.trim(raw)), shaped))
    return F.coalesce(let(_c(gstin), found), F.array().cast("array<string>"))


def hsn_flags(hsn: Column | str) -> Column:
    """[hsn_length] for a code with digits, but not 4, 6 or 8 of them."""
    digits = F.length(F.regexp_replace(F.coalesce(_c(hsn), F.lit("")), r"[^0-9]", ""))
    return flag((digits > 0) & ~digits.isin(*HSN_LENGTHS), "hsn_length")


def client_gstin_error(gstin: Column | str) -> Column:
    """What is wrong with an identifier that someone entered (its check character isn't looked at); null if nothing."""
    value = F.upper(F.regexp_replace(_c(gstin), r"\s+", ""))
    return F.when(value.isNull() | (value == ""), F.lit(None).cast("string")).when(F.length(value) != 15, "length").when(~value.rlike(f"^{GSTIN}$"), "shape")


def looks_like_gstin(value: Column | str) -> Column:
    """Whether a shown value has the length of an identifier."""
    return F.coalesce(F.length(F.trim(_c(value))) == 15, F.lit(False))
