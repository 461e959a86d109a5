"""Queries of the dictionary engine over the test tables, with their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varbook.functions import formats
from varbook.functions import scalars as S
from varbook.functions import text as T
from varbook.operators.dictionary import Dictionary, values_text
from varbook.sources import documents

EVENTS = json.dumps({
    "title": "Patients", "type": "array", "items": {"type": "object", "required": ["id"], "title": "Patient", "properties": {
        "id": {"type": "string", "pattern": "^P[0-9]+$", "minLength": 2, "description": "Identifier"},
        "age": {"oneOf": [{"type": "integer", "minimum": 0, "maximum": 120}, {"const": 999, "title": "Unknown"}]},
        "sex": {"enum": [1, 2, 9], "enumDescriptions": ["male", "female", "not known"]},
        "born": {"type": ["string", "null"], "format": "date"},
        "visits": {"type": "array", "items": {"type": "integer"}, "minItems": 1, "uniqueItems": True},
        "pregnant": {"type": "boolean"}},
        "allOf": [{"if": {"properties": {"sex": {"const": 1}}}, "then": {"properties": {"pregnant": {"const": False}}}}]}})


def _read(s: SparkSession, d: str, t: str) -> DataFrame:
    return s.read.parquet(f"{d}/{t}.parquet")


def dictionary(s: SparkSession) -> Dictionary:
    return Dictionary.build(documents.from_list(s, [EVENTS]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    c = F.col
    return {
        "dictionary_rows": lambda s, d: dictionary(s).plain_rows(internal=True),
        "dictionary_csv": lambda s, d: dictionary(s).to_csv(),
        "dictionary_rules": lambda s, d: dictionary(s).rules().select("dataset", "ix", "condition", "description", F.explode("effects").alias("e")).select("dataset", "ix", "condition", "description", "e.*"),
        "dictionary_search": lambda s, d: dictionary(s).search_counts("unknown"),
        "u5_slugify": lambda s, d: _read(s, d, "part").select("p_partkey", T.slugify(c("p_name")).alias("slug")),
        "u4_escape_html": lambda s, d: _read(s, d, "pages").select("page_id", T.escape_html(c("html")).alias("escaped")),
        "u15_search": lambda s, d: _read(s, d, "documents").where(T.contains_text(c("text"), " The ")).groupBy("lang").agg(F.count("*").alias("visible")),
        "k3_csv_cell": lambda s, d: _read(s, d, "documents").select("doc_id", T.csv_cell(c("text")).alias("cell")),
        "n5_pointer": lambda s, d: _read(s, d, "pages").select("page_id", T.encode_pointer(c("url")).alias("pointer")),
        "x11_sentinel": lambda s, d: _read(s, d, "documents").groupBy("source", T.is_sentinel(c("doc_id"), c("text")).alias("sentinel")).agg(F.count("*").alias("n")),
        "x18_range": lambda s, d: _read(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")).select("o_custkey", T.range_text(c("lo"), c("hi")).alias("range_text"), T.length_text(c("lo"), c("hi")).alias("length_text")),
        "u14_number_text": lambda s, d: _read(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.number_text(c("l_extendedprice")).alias("price"), S.number_text(c("l_quantity")).alias("quantity")),
        "u8_json_type": lambda s, d: _json_values(_read(s, d, "part")).select("p_partkey", S.json_type(c("v")).alias("json_type")),
        "u10_display_value": lambda s, d: _json_values(_read(s, d, "part")).select("p_partkey", S.display_value(c("v")).alias("shown")),
        "u3_value_key": lambda s, d: _json_values(_read(s, d, "part")).groupBy(S.value_key(c("v")).alias("value_key")).agg(F.count("*").alias("n")),
        "u11_is_empty": lambda s, d: _json_values(_read(s, d, "part")).groupBy(S.is_empty(c("v")).alias("empty")).agg(F.count("*").alias("n")),
        "x18_range_label": lambda s, d: _bounds(_read(s, d, "lineitem")).select("l_orderkey", "l_linenumber", S.range_label(c("lo"), c("hi"), c("above"), c("below")).alias("label"), S.range_text(c("lo"), c("hi"), c("above"), c("below")).alias("range_text")),
        "x18_length_items": lambda s, d: _read(s, d, "part").select("p_partkey", S.length_label(_unless(3, "p_size"), _unless(4, "p_partkey")).alias("length_label"), S.items_text(_unless(3, "p_size"), _unless(4, "p_partkey")).alias("items_text")),
        "x18_measurement": lambda s, d: _bounds(_read(s, d, "lineitem")).select("l_orderkey", "l_linenumber", S.measurement_label([c("lo"), c("hi"), c("above"), c("below")], [F.when(c("l_linenumber") == 2, c("l_linenumber")), F.lit(None).cast("int")], F.when(c("l_linenumber") == 3, F.array(F.lit("null"))).otherwise(F.array(F.lit("integer"), F.lit("null"), F.lit("string")))).alias("label")),
        "x14_data_type": lambda s, d: _read(s, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set(F.when(c("o_orderstatus") == "F", "string").when(c("o_orderstatus") == "O", "integer"))).alias("t"), F.count_if(c("o_orderpriority") == "1-URGENT").alias("n"), F.bool_or(c("o_orderkey") % 7 == 0).alias("nullable")).select("o_custkey", S.data_type(c("t"), c("nullable"), c("n")).alias("data_type")),
        "c7_condition_text": lambda s, d: _read(s, d, "part").select("p_partkey", S.condition_text(c("p_brand"), F.when(c("p_partkey") % 5 == 0, c("p_size").cast("string")), F.when(c("p_partkey") % 5 == 1, F.array(F.lit('"a"'), c("p_size").cast("string"))), _unless(2, "p_size").cast("double"), _unless(3, "p_retailprice")).alias("condition")),
        "c6_forced_text": lambda s, d: _read(s, d, "part").select("p_partkey", S.forced_text(c("p_name"), F.when(c("p_partkey") % 3 == 0, c("p_size").cast("string")), F.when(c("p_partkey") % 3 == 1, F.array(F.lit("1"), c("p_size").cast("string"))), _unless(2, "p_type")).alias("text")),
        "c9_code_labels": lambda s, d: _read(s, d, "part").select("p_partkey", F.explode(S.code_labels(F.concat(F.lit("Source coding: those "), c("p_brand"), F.lit(" are Nonparous (777) or NA (777 / 7777), Type "), c("p_type"), F.lit(" ("), (c("p_size") + 10).cast("string"), F.lit(")")))).alias("x")).select("p_partkey", "x.code", "x.label"),
        "a8_descriptions": lambda s, d: _read(s, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: F.concat(F.lit("\t "), x["o_orderpriority"], F.lit(" "))).alias("x")).select("o_custkey", S.distinct_lines(c("x")).alias("description")),
        "u6_join_non_empty": lambda s, d: _read(s, d, "part").select("p_partkey", T.join_non_empty([_unless(2, "p_name"), F.lit("  "), _unless(3, "p_brand"), F.concat(F.lit(" "), c("p_type"))], "; ").alias("text")),
        "n4_first_wins": lambda s, d: documents.first_wins(_read(s, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type"),
        "n5_decode_pointer": lambda s, d: _read(s, d, "pages").select("page_id", F.explode(S.decode_pointer(F.concat(F.lit("/"), T.encode_pointer(c("url")), F.lit("/a~1b~01")))).alias("part")),
        "n6_fragment": lambda s, d: _read(s, d, "pages").select("page_id", S.strip_fragment(F.concat("url", F.lit("#/x"))).alias("base"), S.fragment_uri(F.concat("url", F.lit("#")), F.lit("/$defs/a")).alias("uri")),
        "j3_unresolved": lambda s, d: documents.unresolved(_read(s, d, "lineitem").where(c("l_partkey") % 3 == 0).select(F.concat(F.lit("p#"), c("l_partkey").cast("string")).alias("ref")), _read(s, d, "part").where(c("p_size") > 10).select(F.concat(F.lit("p#"), c("p_partkey").cast("string")).alias("uri"))),
        "a4_merge_bounds": lambda s, d: _merged(_read(s, d, "lineitem")),
        "k4_values_text": lambda s, d: _read(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.struct(F.when(c("n_nationkey") % 2 == 0, c("n_nationkey").cast("string")).otherwise(F.concat(F.lit('"'), c("n_name"), F.lit('"'))).alias("value"), F.when(c("n_nationkey") % 3 > 0, c("n_name")).alias("label"), F.when(c("n_nationkey") % 3 == 0, F.lit("other")).alias("description"), F.when(c("n_nationkey") % 5 == 0, "measurement").otherwise("value").alias("kind"), F.when(c("n_nationkey") % 7 == 0, F.lit("a = 1")).alias("condition")).alias("v")))).alias("x")).select("n_regionkey", values_text(F.transform("x", lambda x: x["v"])).alias("values_text")),
        "v11_highlight": lambda s, d: _read(s, d, "part").select("p_partkey", S.highlight(F.concat(F.lit("<"), c("p_name"), F.lit(" & "), F.upper("p_name")), "WID").alias("html")),
        "f5_encoded_content": lambda s, d: _read(s, d, "part").groupBy(S.encoded_content(F.when(c("p_size") % 3 == 0, "BASE64").when(c("p_size") % 3 == 1, "hex"), F.when(c("p_size") % 2 == 0, c("p_type"))).alias("content")).agg(F.count("*").alias("n")),
        "f6_patterns": lambda s, d: s.createDataFrame([(p,) for p, _ in PATTERNS], "pattern string").select("pattern", S.pattern_text(c("pattern")).alias("described")),
        "f_formats": lambda s, d: formats.formats_df(s).select("name", formats.label_column(c("name")).alias("label"), formats.describe_column(c("name")).alias("described")),
    }


PATTERNS = [
    (r"^\d{5}(-\d{4})?$", "US ZIP code — pattern "), (r"^\d{3}-\d{2}-\d{4}$", "US Social Security Number — pattern "), (r"^\d{4}/\d{2}/\d{2}$", "Matches pattern "), ("^[0-9]4{4}/2{2}/2{2}$", "Date (dd/mm/yyyy) — pattern "),
    (r"^tel:[+]?\d{1,3}-\d+$", "Phone number — pattern "), ("^P[0-9]+$", "Matches pattern "),
]


WANTED = [
    ("id", "Identifier", "string", "Matches pattern ^P[0-9]+$", "", "Required At least 2 character(s)"),
    ("age", "", "integer + coded values", "", "0–120 (measured value); 999 = Unknown", "Measured value: 0 ≤ value ≤ 120"),
    ("sex", "", "categorical (integer)", "", "1 = male; 2 = female; 9 = not known", ""),
    ("born", "", "date (nullable)", "Calendar date (ISO 8601 / RFC 3339) — e.g. 2026-06-22", "", ""),
    ("visits", "", "array of integer", "", "", "At least 1 item(s) Items must be unique"),
    ("pregnant", "", "boolean", "", "false [when sex = 1]", "When sex = 1, value = false."),
]
HEAD = ["Variable name", "Description", "Data type", "Format", "Valid values", "Constraints", "Additional information"]


def _wanted_sql() -> dict[str, str]:
    """The dictionary of EVENTS worked out by hand."""
    rows = ", ".join(f"({i}, " + ", ".join(f"'{x}'" for x in (*r, "")) + ")" for i, r in enumerate(WANTED))
    table = f"(VALUES {rows}) t(ix, " + ", ".join(f'"{h}"' for h in HEAD) + ")"
    source = """'{"pointer":"/properties/' || "Variable name" || '","uri":"https://schema.local/document-1.schema.json"}'"""
    csv = " || ',' || ".join(f"""CASE WHEN contains("{h}", ',') THEN '"' || "{h}" || '"' ELSE "{h}" END""" for h in HEAD)
    return {
        "dictionary_rows": f"SELECT 'default' AS dataset, ix::INTEGER AS ix, * EXCLUDE (ix), 'General' AS \"Category\", {source} AS \"Source\" FROM {table}",
        "dictionary_csv": f"SELECT 'default' AS dataset, '{','.join(HEAD)}' || chr(13) || chr(10) || string_agg({csv}, chr(13) || chr(10) ORDER BY ix) AS csv FROM {table}",
        "dictionary_rules": "SELECT 'default' AS dataset, 0::INTEGER AS ix, 'sex = 1' AS condition, NULL::VARCHAR AS description, 'pregnant' AS variable, 'false' AS value, NULL::VARCHAR AS label",
        "dictionary_search": "SELECT 'default' AS dataset, 0::INTEGER AS category_ix, 'General' AS category, 1::BIGINT AS visible, 6::BIGINT AS total",
    }


def _unless(k: int, name: str) -> Column:
    """The column, null where the part's key is a multiple of k."""
    return F.when(F.col("p_partkey") % k != 0, F.col(name))


def _json_values(part: DataFrame) -> DataFrame:
    """(p_partkey, v): JSON texts of all types."""
    k = F.col("p_partkey") % 9
    name = F.concat(F.lit('"'), F.col("p_name"), F.lit('\\n\\"x"'))
    made = F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, F.lit("0.25")).when(k == 2, name).when(k == 3, F.lit("true")).when(k == 4, F.lit("null")).when(k == 5, F.lit("[1,2]")).when(k == 6, F.lit('{"a":1}')).when(k == 7, F.lit('""')).otherwise(F.lit("{}"))
    return part.select("p_partkey", made.alias("v"))


def _merged(lineitem: DataFrame) -> DataFrame:
    """Each part's first and last quantity; of lines with equal keys the place in the files decides."""
    place = F.struct("l_orderkey", "l_linenumber", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return lineitem.select("l_partkey", "l_quantity", place.alias("place")).groupBy("l_partkey").agg(F.max_by("l_quantity", "place").alias("last_wins"), F.min_by("l_quantity", "place").alias("first_wins"))


def _bounds(lineitem: DataFrame) -> DataFrame:
    """Lines with bounds of every kind."""
    k, q, p = F.col("l_orderkey") % 7, F.col("l_quantity"), F.col("l_extendedprice")
    return lineitem.select("l_orderkey", "l_linenumber", F.when(k.isin(0, 1, 2), q).alias("lo"), F.when(k.isin(0, 3), p).alias("hi"), F.when(k.isin(4, 5), q).alias("above"), F.when(k.isin(2, 5), p).alias("below"))


def _values() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({q(a)}, {q(b)}, {q(x)}, {q(y)})" for a, b, x, y in formats.CATALOG)


def oracle_sql() -> dict[str, str]:
    escape = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
    words = T.SENTINEL_WORDS.replace("'", "''").replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b")
    num = r"regexp_replace({0}::VARCHAR, '\.0$', '')".format
    made = "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '0.25' WHEN 2 THEN '\"' || p_name || '\\n\\\"x\"' WHEN 3 THEN 'true' WHEN 4 THEN 'null' WHEN 5 THEN '[1,2]' WHEN 6 THEN '{\"a\":1}' WHEN 7 THEN '\"\"' ELSE '{}' END AS v FROM part"
    lines = f"SELECT l_orderkey, l_linenumber, l_orderkey % 7 AS k, {num('l_quantity')} AS q, {num('l_extendedprice')} AS p FROM lineitem"
    label = "CASE WHEN k IN (0, 2, 5) THEN q || '–' || p WHEN k = 1 THEN '≥ ' || q WHEN k = 3 THEN '≤ ' || p WHEN k = 4 THEN '> ' || q ELSE '' END"
    return _wanted_sql() | {
        "u5_slugify": "SELECT p_partkey, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part)",
        "u4_escape_html": f"SELECT page_id, {escape.format('html')} AS escaped FROM pages",
        "u15_search": "SELECT lang, count(*) AS visible FROM documents WHERE contains(lower(text), 'the') GROUP BY lang",
        "k3_csv_cell": "SELECT doc_id, CASE WHEN regexp_matches(text, '[\",\\r\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS cell FROM documents",
        "n5_pointer": "SELECT page_id, replace(replace(url, '~', '~0'), '/', '~1') AS pointer FROM pages",
        "x11_sentinel": f"SELECT source, coalesce(regexp_matches(text, '{words}'), false) OR doc_id IN ({', '.join(map(str, T.SENTINEL_CODES))}) AS sentinel, count(*) AS n FROM documents GROUP BY ALL",
        "x18_range": "SELECT o_custkey, lo || ' ≤ value ≤ ' || hi AS range_text, CASE WHEN lo = hi THEN 'Exactly ' || lo || ' character(s)' ELSE 'Length ' || lo || '–' || hi || ' characters' END AS length_text FROM (SELECT o_custkey, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1)",
        "u14_number_text": f"SELECT l_orderkey, l_linenumber, {num('l_extendedprice')} AS price, {num('l_quantity')} AS quantity FROM lineitem",
        "u8_json_type": f"SELECT p_partkey, CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END AS json_type FROM ({made})",
        "u10_display_value": f"SELECT p_partkey, CASE p_partkey % 9 WHEN 2 THEN p_name || chr(10) || '\"x' WHEN 7 THEN '' ELSE v END AS shown FROM ({made}) JOIN part USING (p_partkey)",
        "u3_value_key": f"SELECT CASE p_partkey % 9 WHEN 2 THEN 's:' || p_name || chr(10) || '\"x' WHEN 7 THEN 's:' ELSE 'j:' || v END AS value_key, count(*) AS n FROM ({made}) JOIN part USING (p_partkey) GROUP BY 1",
        "u11_is_empty": "SELECT p_partkey % 9 IN (4, 7, 8) AS empty, count(*) AS n FROM part GROUP BY 1",
        "x18_range_label": f"SELECT l_orderkey, l_linenumber, {label} AS label, CASE k WHEN 0 THEN q || ' ≤ value ≤ ' || p WHEN 1 THEN 'value ≥ ' || q WHEN 2 THEN q || ' ≤ value < ' || p WHEN 3 THEN 'value ≤ ' || p WHEN 4 THEN 'value > ' || q WHEN 5 THEN q || ' < value < ' || p ELSE '' END AS range_text FROM ({lines})",
        "x18_length_items": "SELECT p_partkey, CASE WHEN lo = hi THEN lo || ' chars' WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo || '–' || hi || ' chars' WHEN lo IS NOT NULL THEN '≥ ' || lo || ' chars' WHEN hi IS NOT NULL THEN '≤ ' || hi || ' chars' ELSE '' END AS length_label, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo || '–' || hi || ' items' WHEN lo IS NOT NULL THEN 'At least ' || lo || ' item(s)' WHEN hi IS NOT NULL THEN 'At most ' || hi || ' item(s)' ELSE '' END AS items_text FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS lo, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey END AS hi FROM part)",
        "x18_measurement": f"SELECT l_orderkey, l_linenumber, CASE WHEN k < 6 THEN {label} WHEN l_linenumber = 2 THEN '≥ 2 chars' WHEN l_linenumber = 3 THEN 'measured value' ELSE 'any integer or string' END AS label FROM ({lines})",
        "x14_data_type": "SELECT o_custkey, CASE WHEN n >= 2 THEN 'categorical (' || CASE WHEN f AND NOT o THEN 'string' WHEN o AND NOT f THEN 'integer' ELSE 'value' END || ')' || t WHEN f AND o THEN 'integer or string' || t WHEN f THEN 'string' || t WHEN o THEN 'integer' || t WHEN z THEN 'null' ELSE 'any' END AS data_type FROM (SELECT *, CASE WHEN z THEN ' (nullable)' ELSE '' END AS t FROM (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'O') AS o, count(*) FILTER (o_orderpriority = '1-URGENT') AS n, bool_or(o_orderkey % 7 = 0) AS z FROM orders GROUP BY 1))",
        "c7_condition_text": f"SELECT p_partkey, p_brand || CASE WHEN p_partkey % 5 = 0 THEN ' = ' || p_size WHEN p_partkey % 5 = 1 THEN ' ∈ {{\"a\", ' || p_size || '}}' WHEN p_partkey % 6 = 0 THEN ' is constrained' WHEN p_partkey % 2 = 0 THEN ' ≤ ' || {num('p_retailprice')} WHEN p_partkey % 3 = 0 THEN ' ≥ ' || p_size WHEN p_size = p_retailprice THEN ' = ' || p_size ELSE ' ' || p_size || '–' || {num('p_retailprice')} END AS condition FROM part",
        "c6_forced_text": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'When ' || p_name || ', value = ' || p_size || CASE WHEN p_partkey % 2 <> 0 THEN ' (' || p_type || ')' ELSE '' END || '.' WHEN 1 THEN 'When ' || p_name || ', value is one of 1, ' || p_size || '.' ELSE 'Constrained when ' || p_name || '.' END AS text FROM part",
        "c9_code_labels": "SELECT p_partkey, code, min_by(label, ix) AS label FROM (SELECT p_partkey, unnest(['777', '7777', (p_size + 10)::VARCHAR]) AS code, unnest(['Nonparous', 'NA', 'Type ' || p_type]) AS label, unnest([1, 2, 3]) AS ix FROM part) GROUP BY ALL HAVING true",
        "a8_descriptions": "SELECT o_custkey, string_agg(o_orderpriority, chr(10) ORDER BY k) AS description FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY 1",
        "u6_join_non_empty": "SELECT p_partkey, concat_ws('; ', CASE WHEN p_partkey % 2 <> 0 THEN p_name END, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END, p_type) AS text FROM part",
        "n4_first_wins": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1",
        "n5_decode_pointer": "SELECT page_id, unnest([url, 'a/b~1']) AS part FROM pages",
        "n6_fragment": "SELECT page_id, split_part(url, '#', 1) AS base, url || '#/$defs/a' AS uri FROM pages",
        "j3_unresolved": "SELECT 'p#' || l_partkey AS ref, count(*) AS n FROM lineitem WHERE l_partkey % 3 = 0 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY ALL",
        "a4_merge_bounds": "SELECT DISTINCT l_partkey, last_value(l_quantity) OVER w AS last_wins, first_value(l_quantity) OVER w AS first_wins FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
        "k4_values_text": "SELECT n_regionkey, string_agg(CASE WHEN k % 5 = 0 THEN CASE WHEN k % 3 > 0 THEN n_name ELSE 'measured value' END || ' (measured value)' ELSE CASE WHEN k % 2 = 0 THEN k::VARCHAR ELSE n_name END || ' = ' || CASE WHEN k % 3 = 0 THEN 'other' ELSE n_name END || CASE WHEN k % 7 = 0 THEN ' [when a = 1]' ELSE '' END END, '; ' ORDER BY k) AS values_text FROM (SELECT *, n_nationkey AS k FROM nation) GROUP BY 1",
        "v11_highlight": """SELECT p_partkey, '&lt;' || replace(p_name, 'wid', '<mark class="dd-hit">wid</mark>') || ' &amp; ' || replace(upper(p_name), 'WID', '<mark class="dd-hit">WID</mark>') AS html FROM part""",
        "f5_encoded_content": "SELECT concat_ws(', ', CASE p_size % 3 WHEN 0 THEN 'Base64-encoded binary data' WHEN 1 THEN 'Binary data encoded as hex' END, CASE WHEN p_size % 2 = 0 THEN 'media type ' || p_type END) AS content, count(*) AS n FROM part GROUP BY 1",
        "f6_patterns": "SELECT pattern, text || pattern AS described FROM (VALUES " + ", ".join(f"('{p}', '{t}')" for p, t in PATTERNS) + ") t(pattern, text)",
        "f_formats": f"SELECT name, label, description || ' — e.g. ' || example AS described FROM (VALUES {_values()}) t(name, label, description, example)",
    }
