"""Mixing sources to target weights over a tree of domains, languages and sources."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varbook.llm import store

LEVELS = ("domain", "lang", "source")
DOMAINS = {"web": range(0, 8), "books": range(8, 14), "forum": range(14, 20)}
WEIGHTS: dict[tuple, float] = {("web",): 0.5, ("books",): 0.3, ("forum",): 0.2, ("web", "en"): 0.6, ("books", "en"): 0.6, ("forum", "en"): 0.6}
SLICES = 1 << 10
BROADCAST_LEAVES = 100_000


@dataclass
class Node:
    """What a subtree can give, at most, and what it is given."""

    most: float
    children: dict[str, Node]
    given: float = 0.0


def domain_of(source: Column) -> Column:
    """The default domain: by the number at the source's end, `other` without one that is listed."""
    n = F.regexp_extract(source, r"(\d+)$", 1).try_cast("int")
    out = F.lit("other")
    for name, r in DOMAINS.items():
        out = F.when(n.between(r.start, r.stop - 1), F.lit(name)).otherwise(out)
    return out


def share(amount: float, most: dict[str, float], weights: dict[str, float]) -> dict[str, float]:
    """amount by weight, at most `most` each; what one can't take goes to the others by their weights."""
    given, open_ = dict.fromkeys(most, 0.0), sorted(most)
    left = min(amount, sum(most.values()))
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        part = {k: left * (weights[k] / total if total else 1 / len(open_)) for k in open_}
        full = [k for k in open_ if given[k] + part[k] >= most[k] - 1e-9]
        if not full:
            return given | {k: given[k] + part[k] for k in open_}
        for k in full:
            left -= most[k] - given[k]
            given[k] = most[k]
        open_ = [k for k in open_ if k not in full]
    return given


def propagate(node: Node, amount: float, weights: Mapping[tuple, float], path: tuple = ()) -> None:
    """Give amount to a subtree, top down.

    Siblings share by weight; a sibling can take what its leaves hold, so a
    shortage goes to its siblings first and only what none of them can take
    reaches their parent's siblings, which the parent's own limit has seen to.
    A child without a weight gets an equal part of what the listed ones leave of
    1, or, if that is nothing, no weight.
    """
    node.given = min(amount, node.most)
    if not node.children:
        return
    named = {k: weights[(*path, k)] for k in node.children if (*path, k) in weights}
    rest = [k for k in node.children if k not in named]
    spare = max(0.0, 1 - sum(named.values()))
    w = named | {k: spare / len(rest) for k in rest}
    for k, v in share(node.given, {k: c.most for k, c in node.children.items()}, w).items():
        propagate(node.children[k], v, weights, (*path, k))


def tree(available: Mapping[tuple, float], epochs: float) -> Node:
    root = Node(0.0, {})
    for leaf, tokens in available.items():
        node = root
        node.most += tokens * epochs
        for k in leaf:
            node = node.children.setdefault(k, Node(0.0, {}))
            node.most += tokens * epochs
    return root


def budgets(available: Mapping[tuple, float], weights: Mapping[tuple, float], budget: float, epochs: float) -> dict[tuple, float]:
    """Tokens of each leaf."""
    root = tree(available, epochs)
    propagate(root, budget, weights)

    def leaves(node: Node, path: tuple) -> dict[tuple, float]:
        return {path: node.given} if not node.children else {p: v for k, c in node.children.items() for p, v in leaves(c, (*path, k)).items()}

    return leaves(root, ()) if available else {}


def mix_sources(docs: DataFrame, weights: Mapping[tuple, float] | None = None, budget: float | None = None, epochs: int = 4, seed: int = 17, domain: Column | None = None) -> DataFrame:
    """The rows of docs in the mix, with the column `epoch` (from 0), in place of one it has.

    weights gives a node's share among its siblings by its path (domain,),
    (domain, lang) or (domain, lang, source); budget is in words, by default as
    many as docs has.  A leaf is used for at most `epochs` epochs: each whole
    epoch has all its rows once; the last is the longest prefix, in that epoch's
    order by seeded hash, whose words fit the rest of its budget.  Rows of equal
    doc_id and text have one place.  domain may refer to doc_id, text, lang and
    source.

    docs needs doc_id, text, lang and source; null lang or source counts as
    "unknown", a null text has no words, and rows without words go with the
    first row whose prefix they are in.  Rows that are repeated are rows of
    their own.  An empty table gives no rows.

    The words of each leaf and of each of its slices of the hash's range are
    summed; only rows of the slice in which a leaf's prefix ends are ordered.
    """
    needed = ("doc_id", "text", "lang", "source")
    base = store.aside(docs, needed)
    source, lang = (F.coalesce(F.col(k), F.lit("unknown")) for k in ("source", "lang"))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x20]+")), F.lit(0)).cast("long")
    keyed = base.select("*", F.coalesce(domain_of(source) if domain is None else domain, F.lit("unknown")).alias("_domain"), lang.alias("_lang"), source.alias("_source"), words.alias("_n"))
    leaf = ["_domain", "_lang", "_source"]
    sums = keyed.groupBy(leaf).agg(F.sum("_n").alias("n")).collect()
    available = {tuple(r[:3]): float(r.n) for r in sums}
    given = budgets(available, WEIGHTS if weights is None else weights, sum(available.values()) if budget is None else budget, epochs)
    plan = [(*k, int(min(epochs, v // available[k])) if available[k] else 1, float(v - available[k] * min(epochs, v // available[k])) if available[k] else 0.0) for k, v in given.items()]
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(k, T.StringType()) for k in leaf] + [T.StructField("_whole", T.IntegerType()), T.StructField("_rest", T.DoubleType())])
    plans = spark.createDataFrame(plan, schema)
    # one row a leaf: broadcast while there are few leaves, shuffled beyond
    sent = F.broadcast if len(plan) <= BROADCAST_LEAVES else lambda df: df
    place = F.xxhash64(F.lit(seed), F.col("_whole"), F.col("doc_id").cast("string"), F.col("text"))
    ranked = keyed.join(sent(plans), leaf).withColumn("_h", place).withColumn("_slice", F.shiftrightunsigned("_h", 64 - SLICES.bit_length() + 1))
    slices = ranked.groupBy(*leaf, "_slice").agg(F.sum("_n").alias("s"), F.first("_rest").alias("r"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy(leaf).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = slices.withColumn("b", before).where((F.col("b") <= F.col("r")) & (F.col("b") + F.col("s") > F.col("r"))).groupBy(leaf).agg(F.min("_slice").alias("_edge"), F.min_by("b", "_slice").alias("_before"))
    ranked = ranked.join(sent(edge), leaf, "left")
    inner = ranked.where(F.col("_slice") == F.col("_edge")).select(*leaf, "_h", "_n", "_rest", "_before")
    running = F.col("_before") + F.sum("_n").over(Window.partitionBy(leaf).orderBy("_h").rangeBetween(Window.unboundedPreceding, 0))
    last = inner.withColumn("t", running).groupBy(leaf).agg(F.coalesce(F.max(F.when(F.col("t") <= F.col("_rest"), F.struct(F.lit(1), "_h"))), F.min(F.struct(F.lit(0), "_h"))).alias("_last"))
    ranked = ranked.join(sent(last), leaf, "left")
    inside = (F.col("_rest") > 0) & (
        F.col("_edge").isNull() | (F.col("_slice") < F.col("_edge"))
        | ((F.col("_slice") == F.col("_edge")) & (F.col("_last.col1") == 1) & (F.col("_h") <= F.col("_last._h")))
    )
    times = F.col("_whole") + F.when(inside, F.lit(1)).otherwise(F.lit(0))
    chosen = ranked.where(times > 0).select(*base.columns, F.explode(F.sequence(F.lit(0), times - 1)).alias("epoch"))
    return store.restored(chosen, docs.columns, needed, "epoch")
