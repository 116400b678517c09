"""Parsing of single cell values as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .text import col, squeeze

MONEY = "decimal(18,6)"
CENTS = "decimal(28,2)"
THOUSANDS_ASSUMED = "thousands_assumed"


def cell_text(c) -> Column:
    """Cell as text; hard spaces are spaces, blank marks are null."""
    x = squeeze(F.translate(F.replace(col(c).cast("string"), F.lit("​"), F.lit("")), " ", " "))
    return F.when(~F.lower(x).isin(*V.BLANK_MARKS), x)


def parse_amount(c) -> Column:
    """struct(value DECIMAL(18,6), note) of an amount text.

    Each step rewrites the text towards a plain number; what is no number in
    the end is null."""
    t = cell_text(c)
    inner = F.regexp_replace(t, r"^\((.*)\)$", "$1")
    kept = F.regexp_replace(inner, r"[^\d,.\-+eE]", "")
    # An e stays only inside scientific notation.
    body = F.regexp_replace(kept, r"[eE](?!(?<=^[-+]?\d{1,40}(?:[.,]\d{1,40})?[eE])[-+]?\d+$)", "")
    b = F.regexp_replace(body, r"^[-+]+|[-+]+$", "")
    grouped_dot = (r"(?<=^\d{1,3})\.(?=\d{3}(?:\.\d{3})+$)|(?<=^\d{1,3}(?:\.\d{3}){1,9})\.(?=\d{3}(?:\.\d{3})*$)"
                   r"|(?<=^(?!0\.)\d{1,3})\.(?=\d{3}$)")
    grouped_comma = (r"(?<=^\d{1,3}),(?=\d{3}(?:,\d{3})+$)|(?<=^\d{1,3}(?:,\d{3}){1,9}),(?=\d{3}(?:,\d{3})*$)")
    plain = b
    # Digits with one decimal point need no rewriting.
    marked = b.rlike(r",|\..*\.|^\d{1,3}\.\d{3}$")
    for pattern, new in (
        (grouped_dot, ""), (grouped_comma, ""),
        (r"\.(?=[\d.]*,\d*$)", ""),                               # 1.234,56
        (r",(?=[\d,]*\.\d*$)", ""),                               # 1,234.56
        (r"^(\d*),(\d*(?:[eE][-+]?\d+)?)$", "$1.$2"),
    ):
        plain = F.regexp_replace(plain, pattern, new)
    value = F.when(marked, plain).otherwise(b).try_cast(MONEY)
    negative = t.startswith("(") & t.endswith(")") | body.rlike("^-|-$")
    note = F.when(b.rlike(r"^(?!0\.)\d{1,3}\.\d{3}$"), THOUSANDS_ASSUMED)
    return F.struct(F.when(negative, -value).otherwise(value).cast(MONEY).alias("value"), note.alias("note"))


_MONTHS = ("jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?", "july?", "aug(?:ust)?",
           "sep(?:tember)?", "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?")


def parse_date(c) -> Column:
    """Date text, day first, month first only when the day reading fails.

    The text is rewritten to year-month-day form. A lone year is not a date; a
    plain number is a spreadsheet serial."""
    x = F.trim(F.regexp_replace(
        cell_text(c), r"(?:[T ]\s*\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:Z|[+-]\d{2}:?\d{2})?)$", ""))
    worded = x
    for i, month in enumerate(_MONTHS, 1):
        worded = F.regexp_replace(worded, rf"(?i)(?<=^\d{{1,2}} ){month}(?= \d{{4}}$)|^{month}(?= \d{{1,2}}, \d{{4}}$)", f"{i:02d}")
    worded = F.regexp_replace(worded, r"^(\d{1,2}) (\d{2}) (\d{4})$", "$3-$2-$1")
    worded = F.regexp_replace(worded, r"^(\d{2}) (\d{1,2}), (\d{4})$", "$3-$1-$2")
    # Month names are looked for only where there are letters.
    iso = F.when(x.rlike("[A-Za-z]"), worded).otherwise(x)
    full = r"^(\d{1,2})([./-])(\d{1,2})\2(\d{4})$"
    for pattern, new in (
        (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
        (full, "$4-$3-$1"),
        (r"^(\d{1,2})([./-])(\d{1,2})\2(69|[7-9]\d)$", "19$4-$3-$1"),
        (r"^(\d{1,2})([./-])(\d{1,2})\2(\d{2})$", "20$4-$3-$1"),
        (r"^(\d{4})([./])(\d{1,2})\2(\d{1,2})$", "$1-$3-$4"),
    ):
        iso = F.regexp_replace(iso, pattern, new)
    ymd = r"^\d{4}-\d{1,2}-\d{1,2}$"
    swapped = F.regexp_replace(x, full, "$4-$1-$3")
    number = F.when(x.rlike(r"^\d+(?:[.,]\d+)?$"), F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))
    lone_year = x.rlike(r"^(?:19\d\d|20\d\d|2100)(?:[.,]0+)?$")
    # Serials below 60 precede the fictitious leap day of 1900.
    serial = F.when(number.between(1, 80000) & ~lone_year, F.date_add(
        F.lit("1899-12-30").cast("date"), (F.floor(number) + F.when(number < 60, 1).otherwise(0)).cast("int")))
    # The two usual spellings are tried first; the rest is evaluated only when they fail.
    usual = F.regexp_replace(x, full, "$4-$3-$1")
    return F.coalesce(
        F.try_to_date(F.regexp_extract(usual, ymd, 0), "yyyy-M-d"),
        F.try_to_date(F.regexp_extract(iso, ymd, 0), "yyyy-M-d"),
        F.try_to_date(F.regexp_extract(swapped, ymd, 0), "yyyy-M-d"), serial)


def national_id(c, strict: bool = True) -> Column:
    """Digits only; strict form wants eleven and no leading zero."""
    t = cell_text(c)
    digits = F.regexp_replace(F.regexp_replace(t, r"\.0+$", ""), r"\D", "")
    if strict:
        return F.when(digits.rlike(r"^[1-9]\d{10}$"), digits)
    return F.nullif(digits, F.lit(""))


def staff_id(c) -> Column:
    """Trimmed id without the decimal tail of numeric columns."""
    x = F.trim(col(c).cast("string"))
    x = F.regexp_replace(x, r"^(\d+)\.0+$", "$1")
    return F.when(~F.lower(x).isin("", "nan", "nat", "none", "null", "<na>"), x)


def id_like(c) -> Column:
    """A value that looks like a staff id (H4)."""
    from .text import fold
    x = F.regexp_replace(fold(cell_text(c)), r"^(\d+)\.0$", "$1")
    return x.rlike(r"^(?:\d{2,9}|[A-Z]{1,4}[-/ ]?\d{2,8}|\d{2,8}[-/ ]?[A-Z]{1,3})$")


def cents(c) -> Column:
    return F.round(col(c), 2).cast(CENTS)


def message_money(c) -> Column:
    """Amount with a mandatory currency mark: struct(value, currency) or null."""
    x = F.trim(F.translate(F.coalesce(col(c), F.lit("")), " ", " "))
    mark = r"([$€₺₽]|us\$|usd|try|trl|tl|eur|rub|руб\.?)?"
    pattern = rf"(?i)^\s*{mark}\s*(-?\d{{1,3}}(?:[. ]\d{{3}})*,\d{{2}}|-?\d+,\d{{2}})\s*{mark}\s*$"
    number = F.replace(F.translate(F.regexp_extract(x, pattern, 2), ". ", ""), F.lit(","), F.lit("."))
    front, back = F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 3)
    label = F.lower(F.when(front != "", front).otherwise(back))
    code = F.element_at(F.create_map(*[F.lit(v) for kv in V.MONEY_MARKS.items() for v in kv]), label)
    return F.when(x.rlike(pattern) & code.isNotNull(), F.struct(
        number.try_cast(CENTS).alias("value"), code.alias("currency")))
