"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from varbook.llm import embed_dedup, fingerprint, html, line_dedup, mixing, omh_dedup, packing, quality, substring_dedup, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": lambda s, d: fingerprint.matches(_read(s, d, "documents")),
        "op2_packing": lambda s, d: packing.pack(_read(s, d, "documents")),
        "op3_quality": lambda s, d: quality.keep_good(_read(s, d, "documents"), _read(s, d, "labels")).select("doc_id", "score"),
        "op4_html": lambda s, d: html.extract_pages(_read(s, d, "pages")),
        "op5_mixing": lambda s, d: mixing.mix_sources(_read(s, d, "documents")).select("doc_id", "lang", "source", "epoch"),
        "op6_embeddings": lambda s, d: embed_dedup.near_embeddings(_read(s, d, "embeddings")),
        "op7_lines": lambda s, d: line_dedup.without_repeats(_read(s, d, "documents"), least=1, q=1),
        "op8_passages": lambda s, d: substring_dedup.repeats(_read(s, d, "documents")),
        "op9_urls": lambda s, d: url_filter.filter_urls(_read(s, d, "pages"), url_filter.default_rules(s)),
        "op10_near": lambda s, d: omh_dedup.near_groups(_read(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_urls": url_filter.filter_sql()}
