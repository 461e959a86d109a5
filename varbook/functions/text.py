"""Column functions for the texts of a dictionary; each keeps to built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL_WORDS = r"(?i)(missing|unknown|not\s*applicable|not\s*assessed|not\s*collected|no\s*answer|no\s*response|refus|declin|don'?t\s*know|prefer\s*not|inapplicable|(?<![A-Za-z0-9_])n/?a(?![A-Za-z0-9_])|skipped?)"
SENTINEL_CODES = [int(str(d) * n) for n in (3, 4) for d in (6, 7, 8, 9)]


def slugify(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("section")).otherwise(s)


def escape_html(text: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def multiline(text: Column) -> Column:
    return F.replace(escape_html(text), F.lit("\n"), F.lit("<br>"))


def csv_cell(text: Column) -> Column:
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def encode_pointer(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def join_non_empty(parts: list[Column], separator: str = "\n\n") -> Column:
    trimmed = F.transform(F.array(*parts), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")), separator)


def is_sentinel(code: Column, text: Column) -> Column:
    return F.coalesce(text.rlike(SENTINEL_WORDS), F.lit(False)) | F.coalesce(code.isin(SENTINEL_CODES), F.lit(False))


def range_text(low: Column, high: Column) -> Column:
    """Text of an inclusive range of integers; null where it has no bound."""
    lo, hi = low.cast("string"), high.cast("string")
    return F.coalesce(F.concat(lo, F.lit(" ≤ value ≤ "), hi), F.concat(F.lit("value ≥ "), lo), F.concat(F.lit("value ≤ "), hi))


def length_text(low: Column, high: Column) -> Column:
    lo, hi = low.cast("string"), high.cast("string")
    both = F.when(low == high, F.concat(F.lit("Exactly "), lo, F.lit(" character(s)"))).otherwise(F.concat(F.lit("Length "), lo, F.lit("–"), hi, F.lit(" characters")))
    return F.coalesce(both, F.concat(F.lit("At least "), lo, F.lit(" character(s)")), F.concat(F.lit("At most "), hi, F.lit(" character(s)")))


def contains_text(text: Column, query: str) -> Column:
    q = query.strip().lower()
    return F.lit(True) if not q else F.contains(F.lower(text), F.lit(q))
