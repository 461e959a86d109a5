import json

import pytest
from pyspark.sql import functions as F

from varbook.functions import formats
from varbook.functions import scalars as S
from varbook.operators.dictionary import BuildOptions, Dictionary
from varbook.plans.compiler import Compiler, canonical, num_text
from varbook.plans.queries import EVENTS, dictionary, queries
from varbook.sources import documents

PARTS = [
    {"$id": "https://x.org/root.json", "title": "Study", "items": {"allOf": [{"$ref": "a.json"}, {"$ref": "b.json#/$defs/lab"}]}},
    {"$id": "https://x.org/a.json", "title": "Person", "type": "object", "required": ["age"], "properties": {"age": {"$ref": "b.json#years"}, "loop": {"$ref": "#/properties/loop"}}, "dependentRequired": {"age": ["id"]}},
    {"$id": "https://x.org/b.json", "$defs": {"years": {"$anchor": "years", "type": "integer", "minimum": 0, "exclusiveMaximum": 130}, "lab": {"title": "Lab", "properties": {"x": {"$ref": "missing.json"}}, "patternProperties": {"^q": {"type": "number"}}, "additionalProperties": {"type": "string"}}}},
]


def rows(docs, **o):
    c = Compiler([{"schema": d} for d in docs], **o).compile()
    return c, {r["variable"]: r for r in c["rows"]}


def test_linked_documents():
    c, r = rows(PARTS)
    assert [(x["title"], x["n_rows"]) for x in c["categories"]] == [("Person", 2), ("Lab", 3)]
    assert [x["text"] for x in r["age"]["constraints"]] == ["Required", "0 ≤ value < 130", "When age is present, id is also required."]
    assert list(r) == ["age", "loop", "x", "/^q/", "(additional properties)"]
    assert any("missing.json" in w for w in c["warnings"])
    assert any("Recursive" in x["text"] for x in r["loop"]["constraints"])
    assert rows(PARTS, split=False)[0]["categories"][0]["title"] == "Variables"


def test_union_and_rules():
    c, r = rows([json.loads(EVENTS)])
    assert r["age"]["data_type"] == "integer + coded values"
    assert [v["kind"] for v in r["age"]["valid_values"]] == ["measurement", "sentinel"]
    assert r["pregnant"]["valid_values"][0]["condition"] == "sex = 1"
    assert r["visits"]["data_type"] == "array of integer" and r["born"]["data_type"] == "date (nullable)"
    assert len(c["rules"]) == 1


def test_texts():
    assert [num_text(x) for x in (1.0, 1e-7, 1e21, 0.5)] == ["1", "1e-7", "1e+21", "0.5"]
    assert canonical({"b": 1, "a": [None, "x"]}) == '{"a":[null,"x"],"b":1}'
    assert formats.describe_content("base64", "image/png") == "Base64-encoded binary data, media type image/png"
    assert formats.describe_pattern(r"^\d{5}$").startswith("US ZIP code")
    with pytest.raises(ValueError):
        Compiler([])


def test_exports(spark):
    d = dictionary(spark)
    csv = d.to_csv().first().csv
    assert csv.count("\r\n") == 6 and csv.startswith("Variable name,Description")
    assert d.search("UNKNOWN").count() == 1 and d.search("  ").count() == 6
    assert d.categories().first().n_rows == 6 and d.meta().first().title == "Patients"
    html = d.to_html().first().html
    assert html.count("<tr data-search") == 6 and "6 variables" in html


def test_many_datasets_and_bad_json(spark, tmp_path):
    for k in ("a", "b"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "one.json").write_text(EVENTS)
    (tmp_path / "b" / "two.json").write_text("{")
    docs = documents.from_directory(spark, str(tmp_path), depth=1)
    d = Dictionary.build(docs, BuildOptions(root_index=0))
    assert d.rows().groupBy("dataset").count().count() == 2
    assert d.warnings().count() == 1 and documents.bad_json(docs).count() == 1


def test_one_dataset_over_folders(spark, tmp_path):
    for k in ("x", "y/z"):
        (tmp_path / "set" / k).mkdir(parents=True)
        (tmp_path / "set" / k / "one.json").write_text(EVENTS)
    assert documents.from_directory(spark, str(tmp_path)).select("dataset").distinct().count() == 1
    assert {r.dataset.rsplit("/", 1)[-1] for r in documents.from_directory(spark, str(tmp_path / "set"), depth=1).collect()} == {"x", "y"}


@pytest.mark.parametrize(("schema", "data_type", "texts"), [
    ({"contentEncoding": "BASE64"}, "binary (base64)", []),
    ({"contentEncoding": "hex"}, "binary (hex)", []),
    ({"contentMediaType": "image/png"}, "binary", []),
    ({"type": ["object", "string"]}, "string", []),
    ({"type": "object", "minProperties": 1, "maxProperties": 3}, "object", ["At least 1 property", "At most 3 properties"]),
    ({"type": "string", "minItems": 2, "minProperties": 2}, "string", []),
    ({"items": True, "minItems": 2}, "array of any", ["At least 2 item(s)"]),
    ({"type": ["null"]}, "null", []),
    ({}, "any", []),
    ({"anyOf": [{"maxLength": 3}, {"const": 9}]}, "value + coded values", ["At most 3 character(s)"]),
    ({"oneOf": [{"type": "number", "minimum": 1}, {"type": "number", "maximum": 5, "minimum": 2}]}, "number", ["1 ≤ value ≤ 5"]),
    ({"enum": [1, 2.5, None]}, "categorical (value) (nullable)", []),
])
def test_types_and_constraints(schema, data_type, texts):
    r = rows([{"items": {"properties": {"a": schema}}}])[1]["a"]
    assert r["data_type"] == data_type and [c["text"] for c in r["constraints"]] == texts


def test_measured_values_keep_their_description():
    r = rows([{"items": {"properties": {"a": {"oneOf": [{"type": "number", "description": "in cm"}, {"const": 999}]}}}}])[1]["a"]
    assert r["valid_values"][0]["description"] == "in cm" and r["valid_values"][0]["source"]["pointer"] == "/properties/a"


def test_rules_are_conditional():
    item = {"properties": {"a": {"type": "integer"}, "b": {"type": "string"}}, "dependentRequired": {"a": ["b"]}, "dependentSchemas": {"b": {"properties": {"a": {"minimum": 1}}}, "c": 3},
            "allOf": [{"description": "Not told (777)", "if": {"required": ["a"]}, "then": {"properties": {"b": {"enum": ["x"]}}}, "else": {"properties": {"a": {"const": 777}}}}, {"$comment": "those are Never (777)", "if": {"properties": {"a": {"minimum": 2, "maximum": 2}}}, "then": {"properties": {"a": {"const": 777}}}}]}
    c, r = rows([{"items": item}])
    told = [(x["text"], x["condition"]) for x in r["a"]["constraints"]]
    assert told == [
        ("When a is present, b is also required.", "a is present"), ("Constrained when b is present.", "b is present"),
        ("When not (a present), value = 777.", "not (a present)"), ("When a = 2, value = 777 (Never).", "a = 2"),
    ]
    assert {x["keyword"] for x in r["a"]["constraints"] + r["b"]["constraints"]} == {"conditional"}
    assert [(x["condition"], x["description"]) for x in c["rules"]] == [("a present", None), ("a = 2", "those are Never (777)")]
    assert r["a"]["valid_values"][0]["condition"] == "not (a present); a = 2" and r["a"]["valid_values"][0]["label"] == "Never"


def test_sources_of_variables():
    c, r = rows(PARTS)
    assert json.loads(r["age"]["source"]) == {"pointer": "/properties/age", "uri": "https://x.org/a.json"}
    assert json.loads(r["x"]["source"]) == {"pointer": "/$defs/lab/properties/x", "uri": "https://x.org/b.json"}


def test_patterns_that_look_like_dates():
    assert formats.describe_pattern(r"^\d{4}/\d{2}/\d{2}$").startswith("Matches pattern")


def test_number_texts(spark):
    values = [1.0, -0.5, 1e7, 12345678.5, 1e20, 1e21, 1.5e22, 0.001, 0.00025, 1e-6, 1e-7, -2.5e-8, 123456789012.25]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(S.number_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == ["1", "-0.5", "10000000", "12345678.5", "100000000000000000000", "1e+21", "1.5e+22", "0.001", "0.00025", "0.000001", "1e-7", "-2.5e-8", "123456789012.25"]


def test_json_values(spark):
    df = spark.createDataFrame([('"a\\"b"', "string"), ("1e2", "integer"), ("x", None), (None, None), (" [1]", "array")], "v string, t string")
    assert all(r.t == r.got for r in df.withColumn("got", S.json_type(F.col("v"))).collect())
    assert df.select(S.display_value(F.col("v")).alias("d")).first().d == 'a"b'


def test_merge_bounds_ties(spark, tmp_path):
    rows = [(k, 1, n, float(10 * i + k)) for k in range(3) for i, n in enumerate((1, 1, 2, 2))]
    spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {tuple(r) for r in queries()["a4_merge_bounds"](spark, str(tmp_path)).collect()}
    assert got == {(k, 30.0 + k, 0.0 + k) for k in range(3)}
