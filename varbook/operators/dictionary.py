"""Data dictionaries as DataFrames: build, export, search."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varbook.functions import text as T
from varbook.plans.compiler import Compiler, canonical

VALUE = "struct<value: string, label: string, description: string, kind: string, condition: string>"
CONSTRAINT = "struct<keyword: string, text: string, condition: string>"
COMPILED = (
    "dataset string, part string, ix int, category_ix int, category string, variable string, description string, data_type string, format string, "
    f"valid_values array<{VALUE}>, constraints array<{CONSTRAINT}>, additional_information string, source_uri string, source string, detail string"
)
USER_COLUMNS = [("variable", "Variable name"), ("description", "Description"), ("data_type", "Data type"), ("format", "Format"), ("values_text", "Valid values"), ("constraints_text", "Constraints"), ("info_text", "Additional information")]


@dataclass(frozen=True)
class BuildOptions:
    root_uri: str | None = None
    root_index: int | None = None
    max_depth: int = 6
    split: bool = True
    patterns: bool = True
    open_rows: bool = True


def _compile(pdf: pd.DataFrame, options: BuildOptions) -> pd.DataFrame:
    pdf = pdf.sort_values("doc_ix")
    dataset, docs, bad = pdf["dataset"].iloc[0], [], []
    for r in pdf.itertuples():
        try:
            docs.append({"uri": r.uri, "name": r.name, "schema": json.loads(r.schema_json)})
        except (TypeError, ValueError) as e:
            bad.append(f"{r.uri or r.doc_ix}: {e}")
    out = []
    if docs:
        c = Compiler(docs, **asdict(options)).compile()
        for i, x in enumerate(c["rows"]):
            strip = [{k: v[k] for k in ("value", "label", "description", "kind", "condition")} for v in x["valid_values"]]
            limits = [{k: v.get(k) for k in ("keyword", "text", "condition")} for v in x["constraints"]]
            out.append({"part": "row", "ix": i, "category_ix": x["category_ix"], "category": x["category"], "variable": x["variable"], "description": x["description"], "data_type": x["data_type"], "format": x["format"], "valid_values": strip, "constraints": limits, "additional_information": canonical(x["info"]) if x["info"] else None, "source_uri": x["source_uri"], "source": x["source"]})
        out += [{"part": "category", "ix": i, "category": x["title"], "description": x["description"], "detail": x["id"]} for i, x in enumerate(c["categories"])]
        out += [{"part": "rule", "ix": i, "description": x["description"], "detail": canonical(x)} for i, x in enumerate(c["rules"])]
        out += [{"part": "meta", "ix": 0, "description": c["meta"]["description"], "variable": c["meta"]["title"], "detail": c["meta"]["$comment"]}]
        bad += c["warnings"]
    out += [{"part": "warning", "ix": i, "detail": w} for i, w in enumerate(bad)]
    names = [x.split()[0] for x in COMPILED.replace(f"array<{VALUE}>", "x").replace(f"array<{CONSTRAINT}>", "x").split(", ")]
    frame = pd.DataFrame(out, columns=names).astype(object)
    frame = frame.where(frame.notna(), None)
    frame["dataset"] = dataset
    for k in ("ix", "category_ix"):
        frame[k] = frame[k].astype("Int32")
    return frame


class Dictionary:
    """The dictionaries of all datasets in docs (see sources.documents).

    Sets of documents are compiled apart from one another, one group each, so
    any number of sets is spread over the cluster.  Documents that aren't JSON
    are left out and named among the warnings.
    """

    def __init__(self, compiled: DataFrame) -> None:
        self.compiled = compiled

    @staticmethod
    def build(docs: DataFrame, options: BuildOptions | None = None) -> Dictionary:
        return Dictionary(docs.groupBy("dataset").applyInPandas(partial(_compile, options=options or BuildOptions()), COMPILED))

    def _part(self, name: str) -> DataFrame:
        return self.compiled.where(F.col("part") == name)

    def rows(self) -> DataFrame:
        return self._part("row").drop("part", "detail")

    def categories(self) -> DataFrame:
        counts = self._part("row").groupBy("dataset", F.col("category_ix").alias("ix")).count().withColumnRenamed("count", "n_rows")
        return self._part("category").select("dataset", "ix", F.col("detail").alias("id"), F.col("category").alias("title"), "description").join(counts, ["dataset", "ix"])

    def rules(self) -> DataFrame:
        schema = "condition string, description string, effects array<struct<variable: string, value: string, label: string>>"
        return self._part("rule").select("dataset", "ix", F.from_json("detail", schema).alias("r")).select("dataset", "ix", "r.*")

    def warnings(self) -> DataFrame:
        return self._part("warning").select("dataset", "ix", F.col("detail").alias("warning"))

    def meta(self) -> DataFrame:
        return self._part("meta").select("dataset", F.col("variable").alias("title"), "description", F.col("detail").alias("comment"))

    def view(self) -> DataFrame:
        """rows() with the texts of the exported columns and the text that search looks through."""
        df = self.rows().withColumn("values_text", values_text(F.col("valid_values"))).withColumn("constraints_text", F.array_join(F.transform("constraints", lambda c: c["text"]), " ")).withColumn("info_text", F.coalesce("additional_information", F.lit("")))
        for kind in ("measurement", "value", "sentinel"):
            df = df.withColumn(f"{kind}s", F.filter("valid_values", lambda v, k=kind: v["kind"] == k))
        return df.withColumn("search_text", F.lower(F.concat_ws("  ", *(F.coalesce(F.col(a), F.lit("")) for a, _ in USER_COLUMNS))))

    def plain_rows(self, internal: bool = False, empty: str = "") -> DataFrame:
        cells = [F.col(a).alias(b) if a == "variable" else F.when(F.coalesce(F.col(a), F.lit("")) == "", F.lit(empty)).otherwise(F.col(a)).alias(b) for a, b in USER_COLUMNS]
        return self.view().select("dataset", "ix", *cells, *([F.col("category").alias("Category"), F.col("source").alias("Source")] if internal else []))

    def to_csv(self, internal: bool = False) -> DataFrame:
        """(dataset, csv): one text a dataset, CRLF between lines, none at the end."""
        cols = ([("category", "Category")] if internal else []) + USER_COLUMNS
        line = F.concat_ws(",", *(T.csv_cell(F.coalesce(F.col(a), F.lit(""))) for a, _ in cols))
        lines = self.view().groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("ix", line.alias("line")))).alias("x"))
        return lines.select("dataset", F.concat_ws("\r\n", F.lit(",".join(b for _, b in cols)), F.array_join(F.transform("x", lambda v: v["line"]), "\r\n")).alias("csv"))

    def search(self, query: str) -> DataFrame:
        return self.view().where(T.contains_text(F.col("search_text"), query))

    def search_counts(self, query: str) -> DataFrame:
        """(dataset, category, visible, total) of each section."""
        return self.view().groupBy("dataset", "category_ix", "category").agg(F.count_if(T.contains_text(F.col("search_text"), query)).alias("visible"), F.count("*").alias("total"))

    def to_html(self, title: str | None = None) -> DataFrame:
        """(dataset, html): a page with a table for each section; all texts are escaped."""
        e = T.multiline
        cell = F.concat_ws("", *(F.concat(F.lit("<td>"), e(F.when(F.coalesce(F.col(a), F.lit("")) == "", F.lit("—")).otherwise(F.col(a))), F.lit("</td>")) for a, _ in USER_COLUMNS))
        rows = self.view().withColumn("tr", F.concat(F.lit('<tr data-search="'), T.escape_html(F.col("search_text")), F.lit('">'), cell, F.lit("</tr>")))
        head = "<tr>" + "".join(f"<th>{b}</th>" for _, b in USER_COLUMNS) + "</tr>"
        parts = rows.groupBy("dataset", "category_ix", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "tr"))), lambda v: v["tr"]), "").alias("body"), F.count("*").alias("n"))
        section = F.concat(F.lit("<section><h2>"), T.escape_html(F.col("category")), F.lit(" ("), F.col("n").cast("string"), F.lit(f")</h2><table>{head}"), F.col("body"), F.lit("</table></section>"))
        pages = parts.groupBy("dataset").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category_ix", section.alias("s")))), lambda v: v["s"]), "").alias("body"), F.sum("n").alias("n"))
        name = T.escape_html(F.lit(title) if title else F.coalesce("title", F.lit("Data dictionary")))
        return pages.join(self.meta().select("dataset", "title"), "dataset").select("dataset", F.concat(F.lit("<!DOCTYPE html><meta charset=utf-8><h1>"), name, F.lit("</h1><p>"), F.col("n").cast("string"), F.lit(" variables</p>"), F.col("body")).alias("html"))


def values_text(values: Column) -> Column:
    def line(v: Column) -> Column:
        shown = F.when(v["value"].startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), v["value"], F.lit("}")), "$.v")).otherwise(v["value"])
        name = F.coalesce(v["label"], v["description"])
        text = F.concat(shown, F.coalesce(F.concat(F.lit(" = "), name), F.lit("")), F.coalesce(F.concat(F.lit(" [when "), v["condition"], F.lit("]")), F.lit("")))
        return F.when(v["kind"] == "measurement", F.concat(F.coalesce(v["label"], F.lit("measured value")), F.lit(" (measured value)"))).otherwise(text)

    return F.array_join(F.transform(values, line), "; ")
