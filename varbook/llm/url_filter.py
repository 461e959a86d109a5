"""URL rules: host-suffix and path-prefix expressions, joined on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RULES = [
    ("spam-farm.example.org/", "block"), ("cheap-pills.example.com/", "block"), ("casino-win.example.org/", "block"),
    ("free-bets.example.com/", "block"), ("ads-track.example.org/", "block"), ("www.cheap-pills.example.com/de/", "allow"),
    ("example.net/en/97/", "block"), ("therti.example.org/", "block"), ("www.therti.example.org/en/", "allow"),
]


def expressions(url: Column, most_labels: int, most_folders: int) -> Column:
    """Array of the host/path expressions of a URL, most specific first.

    Scheme, user, port and fragment are dropped, the host is in lower case
    without dots at its ends.  Hosts: the host itself and its suffixes of two to
    most_labels labels, longest first; an IPv4 address has only itself.  Paths:
    with the query, without it, then the directories of up to most_folders
    slashes, longest first, down to "/".
    """
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://|^//", "")
    authority = F.regexp_extract(rest, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@", "")), r":\d*$", ""), r"^\.+|\.+$", "")
    tail = F.substring(rest, F.length(authority) + 1, F.length(rest))
    tail = F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))
    path = F.regexp_extract(tail, r"^([^?]*)", 1)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    cut = F.when(host.rlike(r"^\d+(\.\d+){3}$") | (n < 2), F.array().cast("array<string>")).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), n - 2), lambda i: (i > 0) & (i >= n - most_labels)), lambda i: F.array_join(F.slice(labels, i + 1, n), "."))
    )
    hosts = F.concat(F.array(host), cut)
    parts = F.split(path, "/")
    m = F.size(parts)
    folders = F.reverse(F.transform(F.sequence(F.lit(1), F.least(m - 1, F.lit(most_folders))), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))
    paths = F.array_distinct(F.concat(F.array(tail, path), folders))
    return F.when(url.isNull() | (host == ""), F.array().cast("array<string>")).otherwise(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "expression string, action string")


def filter_urls(pages: DataFrame, rules: DataFrame, prefix: int = 8) -> DataFrame:
    """(page_id, url, action, rule) of every page; rule is the expression that decided, null where none holds.

    A page's expressions meet the rules on the first `prefix` hex digits of
    their SHA-256, then the whole digests are compared.  Of the rules that hold,
    the most specific decides: the longest host, then the longest path; of one
    expression's rules, allow before block.  No rule, a null or empty URL, or a
    URL without a host: allow.  Rules with a null field are ignored, repeated
    ones count once.  Pages with the same page_id and url count as one row;
    other columns are ignored.  Hosts and paths are cut down as deep as the
    deepest rule.  An empty table of pages gives no rows, one of rules only
    allows.
    """
    r = rules.where("expression is not null and action in ('allow', 'block')").groupBy("expression").agg(F.min("action").alias("action"))
    r = r.select(F.col("expression").alias("rule"), "action", F.sha2("expression", 256).alias("rule_digest")).withColumn("short", F.substring("rule_digest", 1, prefix))
    deepest = r.agg(F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\."))), F.max(F.size(F.split("rule", "/")) - 1)).first()
    own = pages.select("page_id", "url", F.posexplode_outer(expressions(F.col("url"), *(max(1, x or 1) for x in deepest))).alias("rank", "expression"))
    own = own.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, prefix)).drop("expression")
    held = own.join(r, "short", "left").withColumn("ok", F.coalesce(F.col("digest") == F.col("rule_digest"), F.lit(False)))
    return held.groupBy("page_id", "url").agg(F.min(F.when(F.col("ok"), F.struct("rank", "action", "rule"))).alias("x")).select(
        "page_id", "url", F.coalesce("x.action", F.lit("allow")).alias("action"), F.col("x.rule").alias("rule")
    )


def filter_sql() -> str:
    """The same over the view pages, with the default rules."""
    rows = ", ".join(f"('{e}', '{a}')" for e, a in RULES)
    return f"""
    WITH rules AS (SELECT expression, min(action) AS action FROM (VALUES {rows}) t(expression, action) GROUP BY 1),
    a AS (SELECT DISTINCT page_id, url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://|^//', '') AS rest FROM pages),
    b AS (SELECT *, regexp_extract(rest, '^([^/?]*)', 1) AS authority FROM a),
    c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(authority, '^.*@', '')), ':\\d*$', ''), '^\\.+|\\.+$', '', 'g') AS host,
      CASE WHEN substr(rest, length(authority) + 1, 1) = '/' THEN substr(rest, length(authority) + 1) ELSE '/' || substr(rest, length(authority) + 1) END AS tail FROM b),
    d AS (SELECT *, regexp_extract(tail, '^([^?]*)', 1) AS path, string_split(host, '.') AS labels FROM c),
    e AS (SELECT *, string_split(path, '/') AS parts, len(labels) AS n FROM d),
    f AS (SELECT page_id, url, host,
      list_concat([host], CASE WHEN regexp_matches(host, '^\\d+(\\.\\d+){{3}}$') OR n < 2 THEN [] ELSE
        list_transform(range(1, n - 1), lambda i: array_to_string(labels[i + 1:], '.')) END) AS hosts,
      list_concat([tail, path], list_reverse(list_transform(range(1, len(parts)), lambda k: array_to_string(parts[1:k], '/') || '/'))) AS paths FROM e),
    g AS (SELECT page_id, url, unnest(hosts) AS h, generate_subscripts(hosts, 1) AS hi, paths FROM f WHERE host <> ''),
    x AS (SELECT page_id, url, h || unnest(paths) AS expression, hi, generate_subscripts(paths, 1) AS pi FROM g),
    y AS (SELECT page_id, url, action, x.expression AS rule, row_number() OVER (PARTITION BY page_id, url ORDER BY hi, pi) AS k FROM x JOIN rules USING (expression))
    SELECT a.page_id, a.url, coalesce(y.action, 'allow') AS action, y.rule FROM a LEFT JOIN y ON y.page_id = a.page_id AND y.url = a.url AND y.k = 1
    """
