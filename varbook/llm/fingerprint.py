"""Context-triggered piecewise hashing of documents, compared by edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varbook.llm import store
from varbook.llm.words import _BYTES, U64, mix, pieces, run_hashes, signed

ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
LENGTH, LEAST_BLOCK, WINDOW = 64, 3, 7
GRAM = 4
HOT, SAMPLED, MOST_HOT = 8192, 64, 10_000
AT_ONCE, MOST_EDGES = 1 << 13, 1 << 17


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the seven bytes up to each byte."""
    d = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)])
    n = len(data)
    h = np.zeros(n, np.uint32)
    shifted = np.zeros(n, np.uint32)
    for i in range(WINDOW):
        c = d[WINDOW - 1 - i : WINDOW - 1 - i + n]
        h += c * np.uint32(WINDOW - i + 1)
        shifted ^= c << np.uint32(5 * i) if 5 * i < 32 else c * np.uint32(0)
    return h + shifted


def signature(text: np.ndarray, roll: np.ndarray, block: int) -> bytes:
    """One character for each chunk that ends where the rolling hash is -1 modulo block, and one for the rest."""
    ends = np.flatnonzero(roll % np.uint32(block) == block - 1) + 1
    if len(ends) >= LENGTH:
        ends = ends[: LENGTH - 1]
    if not len(ends) or ends[-1] < len(text):
        ends = np.append(ends, len(text))
    starts = np.concatenate([[0], ends[:-1]])
    return ALPHABET[(run_hashes(_BYTES[text], starts, ends) >> U64(58)).astype(np.int64)].tobytes()


def fingerprint(text: np.ndarray) -> tuple[int, bytes, bytes]:
    """(block size, signature, signature at twice the block size) of a text's bytes.

    The block size is the least of 3, 6, 12, ... at which 64 chunks would cover
    the text, and is halved while the signature has under 32 characters.
    """
    if not len(text):
        return LEAST_BLOCK, b"", b""
    roll, block = rolling(text), LEAST_BLOCK
    while block * LENGTH < len(text):
        block *= 2
    while block > LEAST_BLOCK and np.count_nonzero(roll % np.uint32(block) == block - 1) + 1 < LENGTH // 2:
        block //= 2
    return block, signature(text, roll, block), signature(text, roll, block * 2)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in pieces(batch.column(1)):
            rows = [fingerprint(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            block, one, two = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], pa.array(block, pa.int64()), pa.array([x.decode() for x in one]), pa.array([x.decode() for x in two])], ["doc_id", "block", "one", "two"])


def codes(texts: list[bytes], pad: int) -> np.ndarray:
    return np.frombuffer(b"".join(s.ljust(LENGTH, bytes([pad])) for s in texts), np.uint8).reshape(-1, LENGTH)


def common(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of signatures, rows of u and w that are padded differently, 64 bits at a time."""
    v = np.full(len(u), (1 << 64) - 1, U64)
    for j in range(LENGTH):
        hit = np.packbits(u == w[:, j : j + 1], axis=1, bitorder="little").view(U64)[:, 0]
        both = v & hit
        v = (v + both) | (v & ~hit)
    return LENGTH - np.bitwise_count(v).astype(np.int64)


def runs(data: np.ndarray, offsets: np.ndarray, size: np.ndarray, run: int) -> tuple[np.ndarray, ...]:
    """(signature, gram, the gram's place, begin, hash) of each run of `run` characters of signatures of the given block sizes.

    A run's gram is the least hash of its GRAM characters in a row, so two
    signatures with a common run have its gram in common.
    """
    n = len(data)
    if n < run:
        return (np.zeros(0, np.int64),) * 5
    values = _BYTES[data] * U64(0x9E3779B97F4A7C15) ^ data
    h = run_hashes(values, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    begin = np.arange(n - run + 1)
    least = np.lib.stride_tricks.sliding_window_view(h, run - GRAM + 1).argmin(axis=1) + begin
    own = np.searchsorted(offsets, begin, "right") - 1
    ok = begin + run <= offsets[own + 1]
    own, least, begin = own[ok], least[ok], begin[ok]
    return own, signed(mix(h[least] ^ size[own].astype(U64))), least, begin, signed(run_hashes(values, begin, begin + run))


def _field(place: int, run: int) -> tuple[np.uint64, np.uint64]:
    """(shift, mask) of the bits for the run that begins `place` characters before its gram."""
    bits = 60 // (run - GRAM + 1)
    return U64(1 + place * bits), U64((1 << bits) - 1)


def _gram_rows(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """(gram, key, around): a row for each gram of each signature, without the signature.

    around has a bit for second signatures and some bits of the hash of each run
    that has the gram, by where the run begins; those of other runs are random.
    """
    for batch in batches:
        key, block = (batch.column(i).to_numpy() for i in (0, 1))
        for column in (2, 3):
            for first, _, data, offsets in pieces(batch.column(column)):
                own, gram, least, begin, h = runs(data, offsets, block[first : first + len(offsets) - 1] * (column - 1), run)
                at, index, which = np.unique(least, return_index=True, return_inverse=True)
                own, gram, place, h = own[index], gram[index], least - begin, h.view(U64)
                around = mix(key[first + own].view(U64) ^ U64(column)) & ~U64(1) | U64(column - 2)
                for i in range(run - GRAM + 1):
                    shift, mask = _field(i, run)
                    some = place == i
                    around[which[some]] = around[which[some]] & ~(mask << shift) | (h[some] & mask) << shift
                order = np.lexsort((around, gram, own))
                own, gram, around = own[order], gram[order], around[order]
                new = np.ones(len(own), bool)
                new[1:] = (own[1:] != own[:-1]) | (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])
                columns = (gram[new], key[first + own[new]], signed(around[new]))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["gram", "key", "around"])


def _shared(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """(gram, key, second): rows whose gram has a run in common with that of another key, as far as the bits show; no such row is missed."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    gram, key, around = (table.column(k).to_numpy() for k in ("gram", "key", "around"))
    order = np.argsort(gram, kind="stable")
    g = gram[order]
    again = g[1:] == g[:-1]
    some = order[np.concatenate([[False], again]) | np.concatenate([again, [False]])]
    gram, key, around = gram[some], key[some], around[some].view(U64)
    keep = np.zeros(len(gram), bool)
    for i in range(run - GRAM + 1 if len(gram) else 0):
        shift, mask = _field(i, run)
        code = around >> shift & mask
        order = np.lexsort((key, code, gram))
        g, c, k = gram[order], code[order], key[order]
        new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])]))
        ends = np.append(new[1:], len(g))
        keep[order] |= np.repeat(k[new] != k[ends - 1], ends - new)
    columns = (gram[keep], key[keep], (around[keep] & U64(1)).astype(bool))
    yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["gram", "key", "second"])


def runs_in_common(x: list[bytes], y: list[bytes], run: int) -> np.ndarray:
    out = np.zeros(len(x), bool)
    for i, (u, v) in enumerate(zip(x, y, strict=True)):
        out[i] = not {u[k : k + run] for k in range(len(u) - run + 1)}.isdisjoint(v[k : k + run] for k in range(len(v) - run + 1))
    return out


def _links(batches: Iterator[pa.RecordBatch], least: int, run: int) -> Iterator[pa.RecordBatch]:
    """What the pairs of each gram show: (key, links, other): documents that key matches, and edges that connect what is linked.

    Whole groups are taken, as many as have AT_ONCE rows or one that has more,
    so that memory doesn't follow the rows of a part.
    """
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    gram, part_a, part_b, key = (table.column(k).to_numpy() for k in ("gram", "first", "second", "key"))
    order = np.lexsort((key, part_b, part_a, gram))
    g, p, q = gram[order], part_a[order], part_b[order]
    ends = np.append(np.flatnonzero((g[1:] != g[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1, len(order))
    edges: list[np.ndarray] = []
    at = 0
    while at < len(order):
        end = int(ends[max(np.searchsorted(ends, at + AT_ONCE, "right") - 1, np.searchsorted(ends, at, "right"))])
        k, n, found = _group_links(table.take(order[at:end]).combine_chunks(), least, run)
        at = end
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n), pa.nulls(len(k), pa.int64())], ["key", "links", "other"])
        edges += found
        if sum(e.shape[1] for e in edges) > MOST_EDGES:
            x, y = forest(np.concatenate(edges, axis=1))
            edges = []
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.nulls(len(x), pa.int64()), pa.array(y)], ["key", "links", "other"])
    if edges:
        x, y = forest(np.concatenate(edges, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.nulls(len(x), pa.int64()), pa.array(y)], ["key", "links", "other"])


def _group_links(table: pa.Table, least: int, run: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(keys that match others, how many documents, edges between them) of the pairs in these groups.

    A pair is counted at the least gram of the runs that its two signatures have
    in common, and not for its second signatures if its first ones match.
    """
    gram, part_a, part_b, mine, key, block, weight, part = (table.column(k).to_numpy() for k in ("gram", "first", "second", "mine", "key", "block", "weight", "part"))
    texts = [t.encode() for t in table.column("text").to_pylist()]
    sign = [t[p:] for t, p in zip(texts, part.tolist(), strict=True)]
    size = np.array([len(t) for t in sign])
    order = np.lexsort((key, part_b, part_a, gram))
    table_u, table_w = codes(sign, 0), codes(sign, 1)
    bag = np.zeros((len(sign), 64), np.uint8)
    lookup = np.zeros(256, np.uint8)
    lookup[ALPHABET] = np.arange(64)
    rows = np.repeat(np.arange(len(sign)), size)
    np.add.at(bag, (rows, lookup[np.frombuffer(b"".join(sign), np.uint8)]), 1)
    offsets = np.concatenate([[0], np.cumsum(size)])
    own, h, _, _, r = runs(np.frombuffer(b"".join(sign), np.uint8), offsets, block * np.where(part > 0, 2, 1), run)
    o = np.lexsort((h, own))
    own, h, r = own[o], h[o], r[o]
    start = np.searchsorted(own, np.arange(len(sign) + 1))
    width = int(np.diff(start).max(initial=1))
    all_grams, all_runs = np.full((len(sign), width), np.iinfo(np.int64).max), np.zeros((len(sign), width), np.int64)
    all_grams[own, np.arange(len(own)) - start[own]] = h
    all_runs[own, np.arange(len(own)) - start[own]] = r
    links = np.zeros(len(sign), np.int64)
    edges: list[np.ndarray] = []
    g = gram[order]
    same = np.concatenate([(g[1:] == g[:-1]) & (part_a[order][1:] == part_a[order][:-1]) & (part_b[order][1:] == part_b[order][:-1]), [False]])
    group = np.concatenate([[0], np.cumsum(~same)[:-1]])
    at, step = np.flatnonzero(same), 1
    while len(at):
        for i in range(0, len(at), 1 << 15):
            x, y = order[at[i : i + (1 << 15)]], order[at[i : i + (1 << 15)] + step]
            total = size[x] + size[y]
            # of a divided gram, rows of two parts meet here, each with those of the other part
            ok = (key[x] != key[y]) & ((part_a[x] == part_b[x]) | (mine[x] != mine[y]))
            x, y, total = x[ok], y[ok], total[ok]
            bound = np.minimum(bag[x], bag[y]).sum(axis=1, dtype=np.int64)
            ok = 200 * bound // np.maximum(1, total) >= least
            x, y, total = x[ok], y[ok], total[ok]
            if not len(x):
                continue
            here = gram[x][:, None]
            # a run of this gram in common, and none of an earlier gram
            p, q = np.where(all_grams[x] == here, all_runs[x], -1), np.where(all_grams[y] == here, all_runs[y], -2)
            ok, now = np.zeros(len(x), bool), (p != -1).argmax(axis=1)
            for j in range(width):
                column = np.minimum(now + j, width - 1)
                own_run = p[np.arange(len(x)), column][:, None]
                if (own_run == -1).all():
                    break
                ok |= (own_run == q).any(axis=1)
            x, y, total, here = x[ok], y[ok], total[ok], here[ok]
            p, q = np.where(all_grams[x] < here, all_runs[x], -1), np.where(all_grams[y] < here, all_runs[y], -2)
            earlier = np.zeros(len(x), bool)
            for j in range(width):
                if (p[:, j] == -1).all():
                    break
                earlier |= (p[:, j : j + 1] == q).any(axis=1)
            x, y, total = x[~earlier], y[~earlier], total[~earlier]
            ok = 200 * common(table_u[x], table_w[y]) // np.maximum(1, total) >= least
            x, y = x[ok], y[ok]
            ok = runs_in_common([sign[k] for k in x], [sign[k] for k in y], run)
            x, y = x[ok], y[ok]
            both = np.flatnonzero((part[x] > 0) & (part[y] > 0) & (block[x] == block[y]))
            if len(both):  # first signatures of one block size: they may match too
                u, w = [texts[k][: part[k]] for k in x[both]], [texts[k][: part[k]] for k in y[both]]
                again = (200 * common(codes(u, 0), codes(w, 1)) // np.array([len(s) + len(t) for s, t in zip(u, w, strict=True)]) >= least) & runs_in_common(u, w, run)
                keep = np.ones(len(x), bool)
                keep[both[again]] = False
                x, y = x[keep], y[keep]
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
            edges.append(np.stack([key[x], key[y]]))
            if sum(e.shape[1] for e in edges) > MOST_EDGES:
                edges = [forest(np.concatenate(edges, axis=1))]
        step += 1
        at = at[at + step < len(order)]
        at = at[group[at] == group[at + step]]
    k, where = np.unique(key, return_inverse=True)
    n = np.bincount(where, links, len(k)).astype(np.int64)
    some = n > 0
    return k[some], n[some], [forest(np.concatenate(edges, axis=1))] if edges else []


def forest(edges: np.ndarray) -> np.ndarray:
    """As few of the edges as connect the same nodes."""
    nodes, ends = np.unique(edges, return_inverse=True)
    ends = ends.reshape(2, -1)
    up = list(range(len(nodes)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    kept = []
    for i, (a, b) in enumerate(ends.T.tolist()):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append(i)
    return edges[:, kept]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, block, one, two) of each row with a doc_id: the fingerprint of its whole text.

    docs needs doc_id and text; other columns are ignored.  A null text counts
    as empty, and an empty one has empty signatures.  Repeated rows each get
    their fingerprint.
    """
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, block long, one string, two string")


def matches(docs: DataFrame, least: int = 60, run: int = 7) -> DataFrame:
    """(doc_id, block, one, two, class_id, links): each document's fingerprint, its class and the number of documents it matches.

    Fingerprints match if they are equal or if, at one block size, their
    signatures have a common run of `run` characters and a score of at least
    `least`.  A class is a connected component of matches; class_id is the
    least doc_id in it.  links counts the rows (doc_id, fingerprint) of all
    matching fingerprints, equal ones included, but not the row itself.  An
    empty text matches nothing: it has no links and its own class.  A doc_id
    that is repeated with several fingerprints has a row for each, one that is
    repeated with the same one a single row.  An empty table gives no rows.
    """
    own = store.save(fingerprints(docs).distinct(), "fingerprints")
    heads = own.where("one <> ''").groupBy("block", "one", "two").agg(F.min("doc_id").alias("id"), F.count("*").alias("weight"))
    heads = store.save(heads.select(F.xxhash64("block", "one", "two").alias("key"), "block", "weight", "one", "two", "id"), "heads")
    rows = heads.select("key", "block", "one", "two").mapInArrow(partial(_gram_rows, run=run), "gram long, key long, around long")
    # most grams have no run in common with another document's; signatures are only sent for those that may
    shared = store.save(rows.repartition("gram").mapInArrow(partial(_shared, run=run), "gram long, key long, second boolean").distinct(), "grams")
    text, part = F.when(F.col("second"), F.concat("one", "two")).otherwise(F.col("one")), F.when(F.col("second"), F.length("one")).otherwise(0)
    rows = shared.join(heads, "key").select("gram", "key", F.col("block").cast("int").alias("block"), "weight", part.alias("part"), text.alias("text"))
    # how many rows a gram has is only needed where they are too many for one task; a sample shows that, and the result is the same however rows are divided
    often = shared.select("gram").sample(1 / SAMPLED, 1).groupBy("gram").count().where(F.col("count") > HOT // SAMPLED).orderBy(F.desc("count"), "gram").limit(MOST_HOT)
    often = often.select(F.col("gram").alias("_g"), F.ceil(F.col("count") * SAMPLED / HOT).cast("int").alias("n"))
    divided = rows.join(F.broadcast(often), F.col("gram") == F.col("_g"), "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("mine", F.pmod("key", F.col("n")).cast("int"))
    divided = divided.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    divided = divided.select("gram", F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"), "mine", "key", "block", "weight", "part", "text")
    found = store.save(divided.repartition("gram", "first", "second").mapInArrow(partial(_links, least=least, run=run), "key long, links long, other long"), "links")
    linked = found.where("links is not null").groupBy("key").agg(F.sum("links").alias("links"))
    classes = store.components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    # only keys and numbers are joined, of fingerprints that have links or stand several times
    known = heads.select("key", "weight", "id").join(linked.join(classes.select(F.col("id").alias("key"), "rep"), "key"), "key", "left").where("links is not null or weight > 1").withColumn("rep", F.coalesce("rep", "key"))
    known = known.join(known.groupBy("rep").agg(F.min("id").alias("class_id")), "rep").select("key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    out = own.withColumn("key", F.xxhash64("block", "one", "two")).join(known, "key", "left")
    return out.select("doc_id", "block", "one", "two", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
