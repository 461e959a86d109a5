"""Best-fit packing of documents into sequences: patterns by non-negative least squares."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICES, MOST_SLICES, SLICE_ROWS = 64, 1 << 14, 1 << 20


def patterns(bins: int, most: int = 3) -> list[tuple[int, ...]]:
    """All ways to fill a sequence of `bins` units with at most `most` lengths, longest first."""
    out: list[tuple[int, ...]] = []

    def add(left: int, top: int, parts: tuple[int, ...]) -> None:
        if not left:
            out.append(parts)
        elif len(parts) < most:
            for k in range(min(left, top), 0, -1):
                if k * (most - len(parts)) < left:
                    break
                add(left - k, k, (*parts, k))

    add(bins, bins, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, steps: int | None = None) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by Lawson and Hanson's active sets."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ b
    tolerance = 1e-9 * max(1.0, np.abs(gradient).max(initial=0))
    for _ in range(steps or 3 * n):
        open_ = np.where(passive, -np.inf, gradient)
        if open_.max(initial=-np.inf) <= tolerance:
            break
        passive[open_.argmax()] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if s[passive].min() > 0:
                break
            low = passive & (s <= 0)
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                s = x
                break
        x = s
        gradient = a.T @ (b - a @ x)
    return x


def plan(histogram: np.ndarray, most: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, times) that take every document of the histogram of lengths 1..len(histogram) exactly once.

    The repeat counts fitted to the histogram are rounded down, then to nearest
    where the documents allow, and what is left is packed by best fit, longest
    first, many equal sequences at a time: the next longest length that still
    fits closes each.
    """
    bins = len(histogram)
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    ways = patterns(bins, most)
    if left.sum():
        a = np.zeros((bins, len(ways)))
        for j, w in enumerate(ways):
            for k in w:
                a[k - 1, j] += 1
        x = nnls(a, left / left.sum()) * left.sum()
        for j in np.argsort(-x, kind="stable"):
            need = a[:, j].astype(np.int64)
            times = min(round(float(x[j])), int((left[need > 0] // need[need > 0]).min()))
            if times > 0:
                left -= times * need
                out.append((ways[j], times))
    while left.any():
        parts: list[int] = []
        rest, top = bins, bins
        free = left.copy()
        while rest:
            fit = np.flatnonzero(free[: min(rest, top)])
            if not len(fit):
                break
            k = int(fit[-1]) + 1
            parts.append(k)
            free[k - 1] -= 1
            rest -= k
            top = k
        need = np.bincount(parts, minlength=bins + 1)[1:]
        times = int((left[need > 0] // need[need > 0]).min())
        left -= times * need
        out.append((tuple(parts), times))
    return out


def places(chosen: list[tuple[tuple[int, ...], int]], bins: int) -> tuple[np.ndarray, ...]:
    """Intervals of the ranks of each length, sorted: (length, first rank, first sequence, slot), each slot of a pattern taking as many ranks in a row as the pattern has sequences."""
    used, pack, rows = np.zeros(bins + 1, np.int64), 0, []
    for parts, times in chosen:
        for slot, k in enumerate(parts):
            rows.append((k, used[k], pack, slot))
            used[k] += times
        pack += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(table.T)


def _place(batches: Iterator[pa.RecordBatch], table: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    length, first, pack, slot = table
    key = length << 44 | first
    for batch in batches:
        bin_, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("bin", "rank"))
        at = np.searchsorted(key, bin_ << 44 | rank, "right") - 1
        columns = [pa.array(pack[at] + rank - first[at]), pa.array(slot[at].astype(np.int32)), *(batch.column(k) for k in ("doc_id", "piece", "start_token", "n_tokens"))]
        yield pa.RecordBatch.from_arrays(columns, ["pack_id", "slot", "doc_id", "piece", "start_token", "n_tokens"])


def pack(docs: DataFrame, length: int = 2048, bins: int = 128, most: int = 3) -> DataFrame:
    """(pack_id, slot, doc_id, piece, start_token, n_tokens): every token of docs is in exactly one place.

    Tokens are words.  A text of more than `length` words is cut into pieces of
    that many and a last one.  Lengths are rounded up to a multiple of
    length / bins for the histogram and the patterns, so a sequence never holds
    more than `length` tokens.  Documents of one rounded length are numbered by
    a seeded hash; ranks give sequences and slots.

    docs needs doc_id and text; other columns are ignored.  Rows without words,
    with null text too, are in no sequence; a null doc_id is kept; repeated rows
    are packed each; an empty table gives no rows.
    """
    # rows of a bin are ordered a slice at a time
    slices = min(MOST_SLICES, max(SLICES, 1 << (docs.count() // SLICE_ROWS).bit_length()))
    unit = -(-length // bins)
    bins = -(-length // unit)
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x20]+")), F.lit(0)).cast("long")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n")).where("n > 0")
    cut = own.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(length).cast("long"))).alias("piece", "start_token"))
    cut = cut.withColumn("n_tokens", F.least(F.lit(length), F.col("n") - F.col("start_token")).cast("long")).drop("n")
    cut = cut.withColumn("bin", F.ceil(F.col("n_tokens") / unit).cast("long")).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(slices)).cast("int"))
    # at most bins * MOST_SLICES rows, whatever the input
    counts = cut.groupBy("bin", "part").count().orderBy("bin", "part").collect()
    histogram, starts = np.zeros(bins, np.int64), []
    for r in counts:
        starts.append((r["bin"], r["part"], int(histogram[r["bin"] - 1])))
        histogram[r["bin"] - 1] += r["count"]
    table = places(plan(histogram, most), bins)
    offsets = docs.sparkSession.createDataFrame(starts, "bin long, part int, before long")
    rank = F.row_number().over(Window.partitionBy("bin", "part").orderBy("doc_id", "piece", "n_tokens"))
    ranked = cut.withColumn("r", rank).join(F.broadcast(offsets), ["bin", "part"]).withColumn("rank", F.col("before") + F.col("r") - 1)
    schema = "pack_id long, slot int, doc_id long, piece int, start_token long, n_tokens long"
    return ranked.select("bin", "rank", "doc_id", "piece", "start_token", "n_tokens").mapInArrow(partial(_place, table=table), schema)
