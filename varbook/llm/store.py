"""Tables cut from their lineage, connected components, and grouping of candidates."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where that is unset, a folder of this machine's if all of Spark runs in one
    process here, as in tests; on a cluster it is an error, as executors
    wouldn't see each other's files.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="varbook-")
    return _own[app]


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lost executors lose nothing of it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    saved = df.sparkSession.read.schema(df.schema).parquet(path)
    saved._saved_at = path
    return saved


def discard(*saved: DataFrame) -> None:
    """Delete tables of save() that nothing reads any more."""
    for df in saved:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def aside(docs: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """docs with all columns but the needed ones in one struct, so that their names can't clash with ours."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*(c for c in needed if c in docs.columns), (F.struct(*rest) if rest else F.lit(0)).alias("__aside"))


def restored(df: DataFrame, columns: list[str], needed: tuple[str, ...], *added: str) -> DataFrame:
    """The given columns of docs in their order, then the added ones, which replace columns of their name."""
    return df.select(*(F.col(c) if c in needed else F.col("__aside").getField(c).alias(c) for c in columns if c not in added), *added)


MARKS = 1 << 23


def marked(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """df with the column `_mark`: true for each row whose key is in ids (one column), for others only where hashes meet.

    A bitmap of MARKS bits is sent to all executors, 1 MB for any number of
    ids.  It keeps rows that a join would drop out of its shuffle; with more
    ids than bits it lets most rows pass, and the join still decides.
    """
    def bit(c: Column) -> Column:
        return F.pmod(F.xxhash64(c.cast("long")), F.lit(MARKS))

    h = bit(ids[ids.columns[0]])
    bitmap = ids.select(F.bitmap_bucket_number(h).alias("_bucket"), F.bitmap_bit_position(h).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    own = bit(F.col(key))
    at = F.bitmap_bit_position(own).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("true") & (F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1), F.lit(False))
    return df.withColumn("_own", F.bitmap_bucket_number(own)).join(F.broadcast(bitmap), F.col("_own") == F.col("_bucket"), "left").withColumn("_mark", hit).drop("_own", "_bucket", "_bits")


def components(edges: DataFrame) -> DataFrame:
    """(id, rep) of every node of the edges (a, b); rep is the least id of its component.

    Alternates large-star and small-star steps till the edges stay the same, so
    rounds grow with the logarithm of a component's size, not with its diameter.
    Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    mark, old = None, []
    while True:
        large = with_least(e.union(e.select("v", "u")), "u", "v").withColumn("m", F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = with_least(large, "u", "v")
        e = save(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct(), "components")
        discard(*old)
        old = [e]
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("rep")).union(e.select(F.col("v").alias("id"), F.col("v").alias("rep")).distinct())


def with_least(df: DataFrame, key: str, value: str) -> DataFrame:
    """df with the column m, the least value of its key: summed up before the shuffle, so a hot key is joined in parts and never ordered as one group."""
    return df.join(df.groupBy(F.col(key).alias("_k")).agg(F.min(value).alias("m")), F.col(key) == F.col("_k")).drop("_k")


CROSS = 4096


def _cross(batches: Iterator[pa.RecordBatch], apart: Callable | None) -> Iterator[pa.RecordBatch]:
    """All pairs of this part's buckets that are in two components, but for those that `apart` tells from their features.

    Of a bucket cut into blocks a part holds two blocks; its pairs are those of one block and the other.
    """
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    bucket, ids, rep, block, mixed = (table.column(k).to_numpy(zero_copy_only=False) for k in ("bucket", "id", "rep", "block", "two"))
    order = np.argsort(bucket, kind="stable")
    bucket, ids, rep, block, mixed = bucket[order], ids[order], rep[order], block[order], mixed[order]
    features = np.array([np.frombuffer(f, np.uint8) for f in table.column("features").to_pylist()])[order] if apart else None
    at = np.flatnonzero(bucket[1:] == bucket[:-1])
    step, out, held = 1, [], 0
    while len(at):
        a = at[(rep[at] != rep[at + step]) & (ids[at] != ids[at + step]) & ~(mixed[at] & (block[at] == block[at + step]))]
        for i in range(0, len(a), 1 << 16):
            x = a[i : i + (1 << 16)]
            y = x + step
            if apart:
                ok = ~apart(features[x], features[y])
                x, y = x[ok], y[ok]
            out.append(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])]))
            held += len(x)
        step += 1
        at = at[at + step < len(bucket)]
        at = at[bucket[at] == bucket[at + step]]
        if out and (held > 1 << 20 or not len(at)):
            a, b = np.unique(np.concatenate(out, axis=1), axis=1)
            out, held = [], 0
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _near(batches: Iterator[pa.RecordBatch], apart: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.array([np.frombuffer(f, np.uint8) for f in batch.column(k).to_pylist()]) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(~apart(x, y)))


def linked(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], features: DataFrame | None = None, apart: Callable | None = None) -> DataFrame:
    """(id, rep) of the components that verified pairs within buckets (bucket, id) form.

    Each bucket's least id is first held against all others there, which settles
    large groups of copies with as many pairs as members.  Then every pair of a
    bucket that is still in two components is verified too, so the components
    are those of all pairs, without a cap on a bucket's size.  verify takes
    distinct pairs (a, b), a < b, and returns those that match.  features (id,
    features) holds bytes, of one length, from which `apart` may prove, for
    arrays of them, that pairs don't match; these aren't verified.
    """
    pairs = with_least(buckets, "bucket", "id").where("m < id").select("bucket", F.col("m").alias("a"), F.col("id").alias("b"))
    pairs = save(pairs, "stars")

    def possible(p: DataFrame) -> DataFrame:
        if features is None:
            return p
        x, y = (features.withColumnsRenamed({"id": k, "features": f"f{k}"}) for k in "ab")
        return p.join(x, "a").join(y, "b").select("a", "b", "fa", "fb").mapInArrow(partial(_near, apart=apart), "a long, b long")

    good = save(verify(possible(pairs.select("a", "b").distinct())).select("a", "b"), "verified")
    reps = components(good)
    placed = (
        pairs.select("bucket", F.explode(F.array("a", "b")).alias("id")).distinct()
        .join(reps, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    )
    several = placed.groupBy(F.col("bucket").alias("_b")).agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("_b", F.ceil(F.col("n") / CROSS).cast("int").alias("blocks"))
    mixed = placed.join(several, F.col("bucket") == F.col("_b")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    if features is not None:
        mixed = mixed.join(features, "id")
    # a large bucket's blocks meet two by two, each two in a task of their own
    mixed = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    mixed = mixed.withColumn("bucket", F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")))).withColumn("two", F.col("block") != F.col("other"))
    columns = ["bucket", "id", "rep", "block", "two"] + (["features"] if features is not None else [])
    rest = mixed.select(*columns).repartition("bucket").mapInArrow(partial(_cross, apart=apart), "a long, b long").distinct().join(pairs.select("a", "b").distinct(), ["a", "b"], "left_anti")
    more = save(verify(rest).select("a", "b"), "verified")
    if more.isEmpty():
        return reps
    return components(good.union(more))
