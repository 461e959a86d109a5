"""Column functions for JSON values, bounds, conditions and addresses; built-in expressions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from varbook.functions import text as T

def joined(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def number_text(x: Column) -> Column:
    """A double as JavaScript writes it: 1, 0.5, 12345678.5, 1e-7, 1e+21."""
    plain, size = x.cast("string"), F.abs(x)
    sign = F.when(x < 0, "-").otherwise("")
    digits = F.replace(F.regexp_replace(F.regexp_extract(plain, "([0-9.]+)", 1), r"\.0$", ""), F.lit("."), F.lit(""))
    exponent = F.regexp_extract(plain, "E(-?[0-9]+)$", 1).try_cast("int")
    wide = F.concat(sign, F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.length(digits)))
    narrow = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    mantissa = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(""))
    power = F.concat(sign, mantissa, F.when(exponent > 0, "e+").otherwise("e-"), F.abs(exponent).cast("string"))
    return F.when((F.rint(x) == x) & (size < 1e21), x.cast("decimal(38,0)").cast("string")).when(exponent.isNull(), plain).when((size >= 1e21) | (size < 1e-6), power).when(size >= 1, wide).otherwise(narrow)


def json_type(value: Column) -> Column:
    """Type of a JSON text: null, boolean, integer, number, string, array or object; null if it isn't one of them."""
    v = F.trim(value)
    number = v.try_cast("double")
    named = F.when(v.startswith("{"), "object").when(v.startswith("["), "array").when(v.startswith('"'), "string").when(v == "null", "null").when(v.isin("true", "false"), "boolean")
    return F.coalesce(named, F.when(number == F.rint(number), "integer").when(number.isNotNull(), "number"))


def display_value(value: Column) -> Column:
    """A JSON text as it is shown: strings without quotes and escapes."""
    return F.when(value.startswith('"'), F.get_json_object(joined('{"v":', value, "}"), "$.v")).otherwise(value)


def value_key(value: Column) -> Column:
    """What two JSON values have in common if they are the same."""
    return F.when(value.startswith('"'), joined("s:", display_value(value))).otherwise(joined("j:", value))


def is_empty(value: Column) -> Column:
    """Whether a JSON text is left out where information is collected."""
    return value.isNull() | value.isin("null", '""', "[]", "{}")


def range_label(low: Column, high: Column, above: Column, below: Column) -> Column:
    """Short text of numeric bounds (minimum, maximum and the exclusive ones); empty without any."""
    lo, hi = F.coalesce(low, above), F.coalesce(high, below)
    one = F.when(lo.isNotNull(), F.concat(F.when(above.isNotNull(), "> ").otherwise("≥ "), number_text(lo))).when(hi.isNotNull(), F.concat(F.when(below.isNotNull(), "< ").otherwise("≤ "), number_text(hi)))
    return F.coalesce(F.when(lo.isNotNull() & hi.isNotNull(), joined(number_text(lo), "–", number_text(hi))), one, F.lit(""))


def range_text(low: Column, high: Column, above: Column, below: Column) -> Column:
    """Constraint text of numeric bounds; empty without any."""
    lo, hi, label = F.coalesce(low, above), F.coalesce(high, below), range_label(low, high, above, below)
    both = joined(number_text(lo), F.when(above.isNotNull(), " < value ").otherwise(" ≤ value "), F.when(below.isNotNull(), "< ").otherwise("≤ "), number_text(hi))
    return F.coalesce(both, F.when(label == "", "").otherwise(joined("value ", label)))


def length_label(low: Column, high: Column) -> Column:
    lo, hi = low.cast("string"), high.cast("string")
    return F.coalesce(F.when(low == high, joined(lo, " chars")), joined(lo, "–", hi, " chars"), joined("≥ ", lo, " chars"), joined("≤ ", hi, " chars"), F.lit(""))


def items_text(low: Column, high: Column) -> Column:
    lo, hi = low.cast("string"), high.cast("string")
    return F.coalesce(joined(lo, "–", hi, " items"), joined("At least ", lo, " item(s)"), joined("At most ", hi, " item(s)"), F.lit(""))


def measurement_label(bounds: list[Column], lengths: list[Column], types: Column) -> Column:
    """Range, else length, else types of a measured value."""
    kinds = F.array_join(F.filter(types, lambda t: t != "null"), " or ")
    return F.coalesce(*(F.when(c != "", c) for c in (range_label(*bounds), length_label(*lengths))), F.when(kinds != "", joined("any ", kinds)), F.lit("measured value"))


def condition_text(name: Column, const: Column, enum: Column, low: Column, high: Column) -> Column:
    """One term of a condition: the constant or list (JSON texts) or the range that a property has."""
    lo, hi = number_text(low), number_text(high)
    span = F.coalesce(F.when(low == high, joined("= ", lo)), joined(lo, "–", hi), joined("≥ ", lo), joined("≤ ", hi), F.lit("is constrained"))
    return F.coalesce(joined(name, " = ", const), joined(name, " ∈ {", F.array_join(enum, ", "), "}"), joined(name, " ", span))


def forced_text(condition: Column, const: Column, enum: Column, label: Column) -> Column:
    """What a rule's clause says about a property."""
    named = F.coalesce(joined(" (", label, ")"), F.lit(""))
    return F.coalesce(joined("When ", condition, ", value = ", const, named, "."), joined("When ", condition, ", value is one of ", F.array_join(enum, ", "), "."), joined("Constrained when ", condition, "."))


CODED = r"([A-Z][A-Za-z0-9/+\- ]*?)\s*\(([0-9]{2,4}(?:\s*/\s*[0-9]{2,4})*)\)"


def code_labels(comment: Column) -> Column:
    """array<struct<code, label>> of the `Label (code)` and `Label (code / code)` that a comment holds; of one code's labels the first."""
    names, codes = (F.regexp_extract_all(comment, F.lit(CODED), F.lit(i)) for i in (1, 2))
    pairs = F.flatten(F.transform(F.arrays_zip(names.alias("n"), codes.alias("c")), lambda x: F.transform(F.split(x["c"], "/"), lambda c: F.struct(F.trim(c).alias("code"), F.trim(x["n"]).alias("label")))))
    return F.filter(pairs, lambda x, i: F.array_position(F.transform(pairs, lambda y: y["code"]), x["code"]) == i + 1)


def distinct_lines(parts: Column) -> Column:
    """The texts of an array without blanks around them, each once and in order, a line each."""
    trimmed = F.transform(parts, lambda x: F.regexp_replace(x, r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", ""))
    return F.array_join(F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))), "\n")


def strip_fragment(uri: Column) -> Column:
    return F.substring_index(uri, "#", 1)


def fragment_uri(base: Column, pointer: Column) -> Column:
    return F.concat(F.regexp_replace(base, "#$", ""), F.lit("#"), pointer)


def decode_pointer(pointer: Column) -> Column:
    """The parts of a JSON pointer."""
    return F.transform(F.when(pointer == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(pointer, "^/", ""), "/")), lambda p: F.replace(F.replace(p, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))


def highlight(text: Column, query: str) -> Column:
    """text as HTML with each occurrence of query, in any case, marked."""
    q = query.strip().lower()
    if not q:
        return T.escape_html(text)
    hit = F.regexp_replace(text, f"(?iu){re.escape(q)}", "\u0001$0\u0002")
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("\u0001", '<mark class="dd-hit">'), ("\u0002", "</mark>")], T.escape_html(hit))


def encoded_content(encoding: Column, media: Column) -> Column:
    """What is said of a value with contentEncoding or contentMediaType."""
    how = F.when(F.lower(encoding) == "base64", "Base64-encoded binary data").otherwise(joined("Binary data encoded as ", encoding))
    return F.concat_ws(", ", F.when(encoding != "", how), F.when(media != "", joined("media type ", media)))


def pattern_text(pattern: Column) -> Column:
    """What is said of a regular expression: a name for well-known ones, told by its source."""
    def digits(*n: int) -> str:
        return ".*".join(r"\\d\{%d\}" % k for k in n)

    name = (
        F.when(pattern.rlike(r"\\d\{5\}(\(\?:\)|\(|\\-|-)?.*\\d\{4\}") | F.contains(pattern, F.lit(r"^\d{5}")), "US ZIP code")
        .when(pattern.rlike(digits(3, 2, 4)), "US Social Security Number")
        .when(F.contains(pattern, F.lit("/")) & pattern.rlike(r"[0-9]\{4\}.*[0-9]\{2\}.*[0-9]\{2\}"), "Date (dd/mm/yyyy)")
        .when(pattern.rlike(r"[+]?\\d\{1,3\}.*\\d") & pattern.rlike("(?i)phone|tel"), "Phone number")
    )
    return F.coalesce(joined(name, " — pattern ", pattern), joined("Matches pattern ", pattern))


def data_type(types: Column, nullable: Column, n_values: Column) -> Column:
    """Text of scalar types; a variable of two coded values or more is categorical."""
    tail = F.when(nullable, " (nullable)").otherwise("")
    kind = F.when(F.size(types) == 1, types[0]).otherwise("value")
    return F.when(n_values >= 2, joined("categorical (", kind, ")", tail)).when(F.size(types) > 0, F.concat(F.array_join(types, " or "), tail)).otherwise(F.when(nullable, "null").otherwise("any"))
