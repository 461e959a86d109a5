"""Near-duplicate embeddings: random hyperplanes, exact cosine, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varbook.llm import store
from varbook.llm.words import U64, mix, signed

TABLES = 16


def plan(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """(bits a table, tables): bits for about 8 random vectors a bucket, and tables enough that a pair at the threshold meets with probability `recall`."""
    bits = max(4, ceil(log2(max(n, 2) / 8)))
    one = (1 - acos(cosine) / pi) ** bits
    return bits, ceil(log(1 - recall) / log(1 - one))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    m = np.array([np.asarray(x, np.float64) for x in column.to_numpy(zero_copy_only=False)])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _by_dimension(*columns: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(rows, their vectors as unit rows, one matrix a column) of each dimension."""
    size = columns[0].value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, [_matrix(c.take(pa.array(at))) for c in columns]


def _buckets(batches: Iterator[pa.RecordBatch], bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(bucket, id) of each table, TABLES of them at a time; only vectors of one dimension share buckets."""
    weights = 1 << np.arange(bits, dtype=np.int64)
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for at, (m,) in _by_dimension(batch.column(1)) if batch.num_rows else ():
            for first in range(0, tables, TABLES):
                n = min(TABLES, tables - first)
                planes = np.random.default_rng((seed, m.shape[1], first)).standard_normal((m.shape[1], bits * n))
                signs = (m @ planes > 0).reshape(len(at), n, bits)
                keys = mix((signs @ weights * tables + np.arange(first, first + n)).astype(U64) * U64(3) + U64(m.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys.reshape(-1))), pa.array(np.repeat(ids[at], n))], ["bucket", "id"])


def _verify(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = batch.filter(pc.equal(pc.list_value_length(batch.column(2)), pc.list_value_length(batch.column(3))))
        good = np.zeros(same.num_rows, bool)
        for at, (x, y) in _by_dimension(same.column(2), same.column(3)) if same.num_rows else ():
            good[at] = np.einsum("ij,ij->i", x, y) >= cosine - 1e-9
        yield pa.RecordBatch.from_arrays([same.column(0), same.column(1)], ["a", "b"]).filter(pa.array(good))


def near_embeddings(embeddings: DataFrame, cosine: float = 0.9, recall: float = 0.97, seed: int = 7) -> DataFrame:
    """(vec_id, rep_id) of all vectors in a group of two or more; rep_id is the group's least vec_id.

    Two vectors match if they have one dimension and their cosine is at least
    `cosine`; groups are connected components.  Equal vectors are searched once.
    The number of bits follows the number of vectors and the number of tables
    follows it, so that `recall` at the threshold is the same at any size.  Rows
    with a null vec_id or vector, with a null, NaN or infinite entry, and zero
    vectors match nothing.  A vec_id that is repeated with several vectors
    matches by any of them; other columns are ignored; an empty table gives no
    rows.
    """
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    plain = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    plain = plain.select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))
    own = store.save(plain.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")), "vectors")
    bits, tables = plan(own.count(), cosine, recall)
    buckets = store.save(own.select("id", "v").mapInArrow(partial(_buckets, bits=bits, tables=tables, seed=seed), "bucket long, id long"), "buckets")

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = (own.select(F.col("id").alias(k), F.col("v").alias(f"v{k}")) for k in "ab")
        return pairs.join(x, "a").join(y, "b").select("a", "b", "va", "vb").mapInArrow(partial(_verify, cosine=cosine), "a long, b long").distinct()

    reps = store.linked(buckets, verify)
    copies = plain.join(own.where("n > 1").select("v", F.col("id").alias("a")), "v").select("a", F.col("id").alias("b")).where("a <> b")
    found = store.components(reps.select(F.col("rep").alias("a"), F.col("id").alias("b")).union(copies))
    return found.select(F.col("id").alias("vec_id"), F.col("rep").alias("rep_id"))
