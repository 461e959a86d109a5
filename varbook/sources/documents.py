"""Schema documents as DataFrames: (dataset, doc_ix, uri, name, schema_json)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "dataset string, doc_ix int, uri string, name string, schema_json string"


def from_list(spark: SparkSession, docs: list, dataset: str = "default") -> DataFrame:
    """docs: JSON texts, or (uri, name, JSON text) tuples, in order."""
    rows = [(dataset, i, *(d if isinstance(d, tuple) else (None, None, d))) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, SCHEMA)


def from_directory(spark: SparkSession, path: str, glob: str = "*.json", depth: int = 0) -> DataFrame:
    """All JSON files under a folder, however deep, in order of path.

    They are one dataset; with `depth`, each folder so many levels below is one.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().getRawPath().rstrip("/")
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("schema_json"))
    inner = F.expr("substring(uri, locate('{0}/', uri) + {1})".format(root.replace("'", r"\'"), len(root)))
    files = files.withColumn("dataset", F.concat(F.lit(root), F.regexp_extract(inner, f"^((?:/[^/]+(?=/)){{0,{depth}}})", 1))).withColumn("name", F.regexp_extract("uri", "([^/]*)$", 1))
    order = F.row_number().over(Window.partitionBy("dataset").orderBy("uri")) - 1
    return files.select("dataset", order.alias("doc_ix"), "uri", "name", "schema_json")


def bad_json(docs: DataFrame) -> DataFrame:
    """(dataset, uri, error) of documents that aren't JSON."""
    return docs.where(F.try_parse_json("schema_json").isNull()).select("dataset", "uri", F.lit("invalid JSON").alias("error"))


def first_wins(locations: DataFrame, uri: str, order: str) -> DataFrame:
    """One row of each uri, the first by `order`: partial minima before the shuffle, so a hot uri is no single group."""
    rest = [c for c in locations.columns if c != uri]
    return locations.groupBy(uri).agg(F.min_by(F.struct(*rest), order).alias("_first")).select(uri, "_first.*")


def unresolved(refs: DataFrame, locations: DataFrame) -> DataFrame:
    """(ref, n): references (ref) that no location (uri) has, and how often each stands; counted before the join."""
    counts = refs.where("ref is not null").groupBy("ref").agg(F.count("*").alias("n"))
    return counts.join(locations.select(F.col("uri").alias("ref")), "ref", "left_anti")
