"""The catalog of string formats and texts about formats, as data, plain functions and Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = [tuple(line.split("|")) for line in """\
date-time|timestamp|Date and time (ISO 8601 / RFC 3339)|2026-06-22T14:30:00Z
date|date|Calendar date (ISO 8601 / RFC 3339)|2026-06-22
time|time|Time of day (ISO 8601 / RFC 3339)|14:30:00Z
duration|duration|Time duration (ISO 8601)|P3Y6M4DT12H30M
email|email address|Email address (RFC 5321)|user@example.org
idn-email|email address (intl.)|Internationalized email address (RFC 6531)|δοκιμή@παράδειγμα.gr
hostname|hostname|Internet host name (RFC 1123)|data.example.org
idn-hostname|hostname (intl.)|Internationalized host name (RFC 5890)|παράδειγμα.gr
ipv4|IPv4 address|IPv4 network address (RFC 2673)|192.0.2.1
ipv6|IPv6 address|IPv6 network address (RFC 4291)|2001:db8::1
uri|URI|Absolute URI (RFC 3986)|https://example.org/x
uri-reference|URI reference|URI or relative reference (RFC 3986)|../record?id=1
iri|IRI|Internationalized URI (RFC 3987)|https://例え.jp/項目
iri-reference|IRI reference|IRI or relative IRI reference (RFC 3987)|../項目?id=1
uuid|UUID|Universally unique identifier (RFC 4122)|123e4567-e89b-12d3-a456-426614174000
uri-template|URI template|URI Template (RFC 6570)|https://example.org/patients/{id}
json-pointer|JSON Pointer|JSON Pointer (RFC 6901)|/items/0/id
relative-json-pointer|relative JSON Pointer|Relative JSON Pointer|1/name
regex|regular expression|ECMA-262 regular expression|^[A-Z]{2}$""".split("\n")]
_BY_NAME = {c[0]: c for c in CATALOG}


def formats_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, "name string, label string, description string, example string")


def is_known(name: str | None) -> bool:
    return bool(name) and name in _BY_NAME


def label(name: str | None) -> str:
    return _BY_NAME[name][1] if is_known(name) else name or ""


def describe(name: str | None) -> str:
    if not name:
        return ""
    return "{2} — e.g. {3}".format(*_BY_NAME[name]) if name in _BY_NAME else f'Custom format "{name}".'


def describe_content(encoding: str | None, media: str | None) -> str:
    parts = []
    if encoding:
        parts.append("Base64-encoded binary data" if encoding.lower() == "base64" else f"Binary data encoded as {encoding}")
    if media:
        parts.append(f"media type {media}")
    return ", ".join(parts)


FRIENDLY = [
    (lambda p: re.search(r"\\d\{5\}(\(\?:\)|\(|\\-|-)?.*\\d\{4\}", p) or r"^\d{5}" in p, "US ZIP code"),
    (lambda p: re.search(r"\\d\{3\}.*\\d\{2\}.*\\d\{4\}", p), "US Social Security Number"),
    (lambda p: "/" in p and re.search(r"([0-9]\{4\}).*([0-9]\{2\}).*([0-9]\{2\})", p), "Date (dd/mm/yyyy)"),
    (lambda p: re.search(r"[+]?\\d\{1,3\}.*\\d", p) and re.search("phone|tel", p, re.I), "Phone number"),
]


def describe_pattern(pattern: str) -> str:
    name = next((text for test, text in FRIENDLY if test(pattern)), None)
    return f"{name} — pattern {pattern}" if name else f"Matches pattern {pattern}"


def label_column(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for c in CATALOG for x in c[:2]))
    return F.coalesce(table[name], name, F.lit(""))


def describe_column(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for c in CATALOG for x in (c[0], describe(c[0]))))
    return F.when(name.isNull() | (name == ""), F.lit("")).otherwise(F.coalesce(table[name], F.concat(F.lit('Custom format "'), name, F.lit('".'))))
