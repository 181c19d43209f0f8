"""Text columns: white space, names, headers, flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for each row, however often body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(text: Column | str) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def excerpt(text: Column | str, n: int = 240) -> Column:
    return F.substring(squeeze(text), 1, n)


def blank_to_null(text: Column | str) -> Column:
    """The trimmed text, null where nothing is left."""
    return F.nullif(F.trim(_c(text)), F.lit(""))


#: ASCII characters that are neither letters nor digits.
SIGNS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def alphanumeric(text: Column | str) -> Column:
    """The ASCII letters and digits of a text. Signs are translated away, as a pattern costs several times as much; text beyond ASCII goes by one."""
    plain = F.translate(_c(text), SIGNS, "")
    return F.when(F.octet_length(plain) == F.length(plain), plain).otherwise(F.regexp_replace(plain, r"[^A-Za-z0-9]", ""))


def header(name: Column | str) -> Column:
    """A column title as it is looked up: lower case, single spaces."""
    return F.lower(squeeze(name))


def safe_name(name: Column | str) -> Column:
    """A file name of ASCII word characters, dots and dashes; other runs become one underscore; ends trimmed; at most 120 characters."""
    return F.substring(F.btrim(F.regexp_replace(_c(name), r"[^A-Za-z0-9_.\-]+", "_"), F.lit("._")), 1, 120)


def folder_name(name: Column | str) -> Column:
    """A folder name without characters that file systems refuse, at most 80 characters."""
    return F.trim(F.substring(squeeze(F.regexp_replace(_c(name), r'[<>:"/\\|?*]', " ")), 1, 80))


def file_suffix(path: Column | str) -> Column:
    """The lower-case suffix with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(_c(path), r"(\.[^./\\]+)$", 1))


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/\\]*)$", 1)


def any_of(text: Column, needles: tuple[str, ...]) -> Column:
    """Whether the text holds any of the strings."""
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def hits(text: Column, needles: tuple[str, ...]) -> Column:
    """How many of the strings the text holds."""
    total = F.lit(0)
    for needle in needles:
        total = total + text.contains(needle).cast("int")
    return total


def flag_list(raw: Column | str) -> Column:
    """Flag codes from comma-separated text, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(_c(raw), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def add_flags(*flags: Column) -> Column:
    """Arrays of codes as one, each code once and in order of appearance; null arrays count as empty."""
    return F.array_distinct(F.concat(*[F.coalesce(f, F.array().cast("array<string>")) for f in flags]))


def flag(condition: Column, code: str) -> Column:
    """[code] where the condition holds, else []."""
    return F.when(condition, F.array(F.lit(code))).otherwise(F.array().cast("array<string>"))


def flag_text(flags: Column | str) -> Column:
    return F.array_join(F.filter(_c(flags), lambda x: x != ""), ", ")


def source_file(source: Column | str) -> Column:
    """The file of a source pointer: what stands before its first #."""
    return F.nullif(F.substring_index(_c(source), "#", 1), F.lit(""))


def redact(text: Column | str, secret: str, mark: str = "***") -> Column:
    """The first line of the text with a secret masked."""
    first = F.substring_index(_c(text), "\n", 1)
    return F.replace(first, F.lit(secret), F.lit(mark)) if secret else first


def flag_items(raw: Column | str) -> Column:
    """Flags of a shown row: a JSON list of text, or codes between commas and semicolons; blanks dropped, null gives none."""
    text = F.trim(F.coalesce(_c(raw), F.lit("")))
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    return F.filter(F.transform(F.coalesce(listed, F.split(text, "[,;]+")), lambda x: F.trim(x)), lambda x: x != "")


def shown(value: Column | str) -> Column:
    """Text of a cell; a dash for nothing."""
    return F.coalesce(F.nullif(_c(value).cast("string"), F.lit("")), F.lit("—"))


def shown_money(value: Column | str) -> Column:
    """An amount with two decimals and Indian grouping (the last three digits, then pairs); a dash for nothing."""
    plain = F.format_string("%.2f", F.abs(_c(value).cast("decimal(20,2)")).cast("double"))
    whole = F.substring_index(plain, ".", 1)
    pairs = F.regexp_replace(F.substring(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0))), r"(?<=\d)(?=(\d\d)+$)", ",")
    grouped = F.when(F.length(whole) > 3, F.concat(pairs, F.lit(","), F.right(whole, F.lit(3)))).otherwise(whole)
    return F.when(_c(value).isNull(), "—").otherwise(F.concat(F.when(_c(value) < 0, "-").otherwise(""), grouped, F.lit("."), F.substring_index(plain, ".", -1)))
