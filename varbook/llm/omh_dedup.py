"""Near-duplicate documents by Order MinHash and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varbook.llm import store
from varbook.llm.words import ALL, U64, mix, owners, pieces, signed, words


BAG = 256
SHORT = 16


def kmers(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words (of all its words where it has fewer) and their bounds."""
    lengths = np.diff(bounds)
    ends = np.concatenate([[0], np.cumsum(np.where(lengths == 0, 0, np.maximum(lengths - k + 1, 1)))])
    n = len(hashes)
    h = np.zeros(n, U64)
    for i in range(min(k, n)):
        h[: n - i] = mix(h[: n - i] * U64(3) + hashes[i:])
    valid = np.ones(n, bool)
    for i in range(1, k):
        last = bounds[1:] - i
        valid[last[last >= bounds[:-1]]] = False
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(short):
        first, x = bounds[:-1][short], np.zeros(len(short), U64)
        for i in range(k):
            x = mix(x * U64(3) + np.where(i < lengths[short], hashes[np.minimum(first + i, n - 1)], U64(7)))
        h[first], valid[first] = x, True
    return h[valid], ends


def occurrences(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many times each k-mer stood earlier in its text."""
    if not len(h):
        return np.zeros(0, np.int64)
    key = mix(h + owners(bounds).astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    at = np.arange(len(h))
    out = np.empty(len(h), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def sketches(hashes: np.ndarray, bounds: np.ndarray, k: int, rounds: int, picked: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have words, rounds x texts sketches): each the hash of the least k-mers in text order."""
    h, ends = kmers(hashes, bounds, k)
    some = np.flatnonzero(np.diff(ends))
    starts = ends[:-1][some]
    if not len(some):
        return some, np.zeros((rounds, 0), U64)
    labelled = mix(h + occurrences(h, ends).astype(U64) * U64(0xA24BAED4963EE407))
    bits = U64(max(1, int(len(h)).bit_length()))
    low = (U64(1) << bits) - U64(1)
    at = np.arange(len(h), dtype=U64)
    out = np.empty((rounds, len(some)), U64)
    for j in range(rounds):
        x = mix(labelled ^ U64((j + 1) * 0x9FB21C651E98DF25 & (1 << 64) - 1))
        x = (x & ~low) | at
        found = np.empty((picked, len(some)), U64)
        for i in range(picked):
            found[i] = least = np.minimum.reduceat(x, starts)
            x[(least[least != ALL] & low).astype(np.int64)] = ALL
        where = np.where(found == ALL, ALL, found & low)
        where.sort(axis=0)
        s = np.full(len(some), U64(j))
        for i in range(picked):
            s = mix(s * U64(5) + np.where(where[i] == ALL, U64(1), h[np.minimum(where[i], U64(len(h) - 1)).astype(np.int64)]))
        out[j] = s
    return some, out


def bags(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of each text's words fall into each of BAG classes, up to 255, and the number of words in 4 bytes."""
    n = len(bounds) - 1
    counts = np.bincount(owners(bounds) * BAG + (hashes >> U64(56)).astype(np.int64), minlength=n * BAG).reshape(n, BAG)
    return np.hstack([np.minimum(counts, 255).astype(np.uint8), np.minimum(np.diff(bounds), (1 << 32) - 1).astype("<u4").view(np.uint8).reshape(n, 4)])


def bags_apart(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Where bags prove that texts aren't similar: an edit changes the counts by 2 at most and the length by 1."""
    n, m = (np.ascontiguousarray(v[:, BAG:]).view("<u4")[:, 0].astype(np.int64) for v in (x, y))
    most = ((1 - least) * np.maximum(n, m) + 1e-9).astype(np.int64)
    differ = np.maximum(x[:, :BAG], y[:, :BAG]) - np.minimum(x[:, :BAG], y[:, :BAG])
    return (np.abs(n - m) > most) | (differ.sum(axis=1, dtype=np.int64) > 2 * most)


def _sketch(batches: Iterator[pa.RecordBatch], k: int, rounds: int, picked: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for first, end, data, offsets in pieces(batch.column(1)):
            h, bounds = words(data, offsets)
            some, s = sketches(h, bounds, k, rounds, picked)
            if not len(some):
                continue
            sizes = np.full(len(some), rounds)
            short = np.flatnonzero(np.diff(bounds)[some] < SHORT) if k > 1 else some[:0]
            if len(short):  # a changed word leaves a short text few runs of words, so single words are picked too
                own = np.zeros(len(bounds), np.int64)
                own[1:] = np.cumsum(np.where(np.isin(np.arange(len(bounds) - 1), some[short]), np.diff(bounds), 0))
                _, more = sketches(h[np.isin(owners(bounds), some[short])], own, 1, rounds, picked)
                sizes[short] *= 2
            ends = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.empty(ends[-1], U64)
            flat[ends[:-1][:, None] + np.arange(rounds)] = s.T
            if len(short):
                flat[ends[:-1][short][:, None] + rounds + np.arange(rounds)] = mix(more.T ^ U64(SHORT))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(signed(flat)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[first:end][some]), lists, pa.array([f.tobytes() for f in bags(h, bounds)[some]], pa.binary())], ["id", "buckets", "features"])


def banded_distance(x: list, y: list, k: int) -> int:
    """Edit distance of two lists within k of the diagonal; k + 1 where it is larger.

    Bit-parallel: one integer of 2 k + 1 bits holds the band's column.
    """
    if len(x) < len(y):
        x, y = y, x
    n, m = len(x), len(y)
    if n - m > k:
        return k + 1
    top, k = k, min(k, n)
    if k == 0:
        return int(x != y) and top + 1
    width = 2 * k + 1
    full = (1 << width) - 1
    masks: dict = {}
    for i, c in enumerate(x):
        masks[c] = masks.get(c, 0) | 1 << i
    vp, vn, d, diagonal, last, start = (full << k) & full, 0, k, 1 << width - 1, 1 << width - 2, -k
    for i in range(m):
        p = masks.get(y[i], 0)
        p = (p >> start if start >= 0 else p << -start) & full
        d0 = ((((p & vp) + vp) & full) ^ vp) | p | vn
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if i < n - k:
            d += not d0 & diagonal
        else:
            d += bool(hp & last) - bool(hn & last)
            last >>= 1
        vp = hn | (full & ~((d0 >> 1) | hp))
        vn = (d0 >> 1) & hp
        start += 1
    return d if d <= top else top + 1


def similar(x: np.ndarray, y: np.ndarray, least: float) -> float:
    """1 - distance / longer length; -1 where that is under least."""
    longer = max(len(x), len(y))
    if not longer:
        return 1.0
    k = int((1 - least) * longer + 1e-9)
    if abs(len(x) - len(y)) > k:
        return -1.0
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    head = int(differ[0]) if len(differ) else n
    x, y = x[head:], y[head:]
    n = min(len(x), len(y))
    if n:
        differ = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
        tail = int(differ[0]) if len(differ) else n
        x, y = x[: len(x) - tail], y[: len(y) - tail]
    if max(len(x), len(y)) - shared(x, y) > k:  # an edit changes one word of either text
        return -1.0
    d = banded_distance(x.tolist(), y.tolist(), k)
    return 1 - d / longer if d <= k else -1.0


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """Words that two texts have in common, each as often as in both."""
    u, n = np.unique(x, return_counts=True)
    v, m = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = []
        for column in (2, 3):
            own = []
            for _, _, data, offsets in pieces(batch.column(column)):
                h, bounds = words(data, offsets)
                own += [h[bounds[i] : bounds[i + 1]] for i in range(len(bounds) - 1)]
            sides.append(own)
        good = pa.array([similar(x, y, least) >= 0 for x, y in zip(*sides, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(good)


def text_groups(docs: DataFrame, least: float, k: int, rounds: int, picked: int) -> DataFrame:
    """(h, g, id, first_id, first_h): each distinct text, by two hashes of it, its least doc_id, and the first text, by (doc_id, hash), of its group."""
    plain = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    texts = store.save(plain.groupBy("h", F.md5("text").alias("g")).agg(F.min("doc_id").alias("id")), "texts")
    # copies go by before their text is looked at: only the row with a text's least doc_id is sketched
    first = texts.select(F.col("h").alias("_h"), F.col("id").alias("_id"))
    sketched = plain.select("h", "text", "doc_id").mapInArrow(partial(_with_id, k=k, rounds=rounds, picked=picked), "id long, buckets array<long>, features binary, doc_id long")
    sketched = store.save(sketched.join(first, (F.col("id") == F.col("_h")) & (F.col("doc_id") == F.col("_id")), "left_semi").drop("doc_id").dropDuplicates(["id"]), "sketches")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = store.save(pairs.distinct(), "pairs")
        needed = texts.join(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "h").select(F.col("h").alias("_h"), F.col("id").alias("_id"))
        t = store.marked(plain, "doc_id", needed.select("_id")).where("_mark").join(needed, (F.col("h") == F.col("_h")) & (F.col("doc_id") == F.col("_id"))).select("h", "text")
        p = pairs.join(t.select(F.col("h").alias("a"), F.col("text").alias("text_a")), "a").join(t.select(F.col("h").alias("b"), F.col("text").alias("text_b")), "b")
        return p.select("a", "b", "text_a", "text_b").mapInArrow(partial(_verify, least=least), "a long, b long").distinct()

    buckets = sketched.select(F.explode("buckets").alias("bucket"), "id").distinct()
    reps = store.linked(buckets, verify, sketched.select("id", "features"), partial(bags_apart, least=least))
    member = texts.join(reps.select(F.col("id").alias("h"), "rep"), "h", "left").withColumn("rep", F.coalesce("rep", "h"))
    heads = member.groupBy("rep").agg(F.min(F.struct("id", "h")).alias("first"))
    return member.join(heads, "rep").select("h", "g", "id", F.col("first.id").alias("first_id"), F.col("first.h").alias("first_h"))


def _with_id(batches: Iterator[pa.RecordBatch], k: int, rounds: int, picked: int) -> Iterator[pa.RecordBatch]:
    """Sketches of the texts of (h, text, doc_id), with both ids."""
    for batch in batches:
        place = pa.array(np.arange(batch.num_rows))
        for out in _sketch(iter([pa.RecordBatch.from_arrays([place, batch.column(1)], ["id", "text"])]), k, rounds, picked):
            at = out.column(0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), out.column(1), out.column(2), batch.column(2).take(at)], ["id", "buckets", "features", "doc_id"])


def near_groups(docs: DataFrame, least: float = 0.8, k: int = 2, rounds: int = 16, picked: int = 2) -> DataFrame:
    """(doc_id, rep_id) of all documents that have a near copy; rep_id is the group's least doc_id.

    docs needs doc_id and text; other columns are ignored.  Two documents match
    if their edit similarity over words is at least `least`; a group is a
    connected component.  Equal texts are one candidate.  Rows with a null
    doc_id or text, and texts without words, match nothing but equal texts; rows
    that repeat a doc_id are one document, which matches by any of its texts; an
    empty table gives no rows.
    """
    groups = store.save(text_groups(docs, least, k, rounds, picked), "text-groups")
    plain = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.md5("text").alias("g"))
    edges = plain.join(groups.select("h", "g", "first_id"), ["h", "g"]).where("doc_id <> first_id").select(F.col("first_id").alias("a"), F.col("doc_id").alias("b"))
    found = store.components(edges)
    return found.select(F.col("id").alias("doc_id"), F.col("rep").alias("rep_id"))


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one text of each group of near copies, all columns kept: the one with the least doc_id.

    A row goes if its text stands under a lesser doc_id too, or if the first
    text of its text's group is another one.  Rows that repeat both doc_id and
    text stay or go together; a doc_id with several texts keeps those that are
    first.  Rows that match nothing stay, those with a null doc_id or text too;
    an empty table gives no rows.
    """
    groups = store.save(text_groups(docs, **({"least": 0.8, "k": 2, "rounds": 16, "picked": 2} | parameters)), "text-groups")
    # of most texts there is one row, which stays: only the others are looked up
    own = store.aside(docs, ("doc_id", "text"))
    plain = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_h"), F.md5("text").alias("_g"))
    gone = plain.join(groups.withColumnsRenamed({"h": "_h", "g": "_g"}), ["_h", "_g"]).where("_id <> id or _h <> first_h").select("_id", "_h").distinct()
    kept = own.join(store.save(gone, "gone"), (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64("text") == F.col("_h")), "left_anti")
    return store.restored(kept, docs.columns, ("doc_id", "text"))
