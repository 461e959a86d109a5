"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varbook.llm import store

FEATURES = ("n_words", "word_length", "distinct", "distinct_root", "capitals", "symbols", "bars", "digits", "lines_distinct", "lexicon")


@dataclass
class Model:
    """rules: (weight, ((feature, is greater, threshold), ...)); the log-odds of a bad text are bias plus the weights of the rules that hold."""

    bias: float = -1.0
    rules: list[tuple[float, tuple[tuple[str, bool, float], ...]]] = field(default_factory=list)
    lexicon: list[str] = field(default_factory=list)


def with_statistics(docs: DataFrame, lexicon: list[str], prefix: str = "_f_") -> DataFrame:
    """docs with the features of the whole text, all by built-in expressions; a null text counts as an empty one.

    Both steps are generators of one row: their columns aren't merged into later
    expressions or filters, so each scan of the text is made once.
    """
    t = F.coalesce("text", F.lit(""))
    lines = F.split(t, "\n")
    scans = {
        "length": F.length(t),
        "words": F.regexp_count(t, F.lit(r"[^\x00-\x20]+")),
        "kinds": F.array_distinct(F.split(F.lower(t), r"[^\p{L}\p{N}]+")),
        "capitals": F.regexp_count(t, F.lit(r"\p{Lu}{2,}")),
        "symbols": F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s]{2,}")),
        "bars": F.regexp_count(t, F.lit(r"[|]")),
        "digits": F.regexp_count(t, F.lit(r"[0-9]+")),
        "lines": F.size(F.split(t, "\n")),
        "lines_distinct": F.size(F.array_distinct(lines)),
    }
    scanned = docs.select("*", F.inline(F.array(F.struct(*(c.alias("_s_" + k) for k, c in scans.items())))))
    s = {k: F.col("_s_" + k) for k in scans}
    n = F.greatest(s["words"], F.lit(1)).cast("double")
    kinds = F.size(s["kinds"])
    known = F.split(F.lit(" ".join(lexicon)), " ") if lexicon else F.array().cast("array<string>")
    features = {
        "n_words": n, "word_length": s["length"] / n, "distinct": kinds / n, "distinct_root": kinds / F.sqrt(n),
        "capitals": s["capitals"] / n, "symbols": s["symbols"] / n, "bars": s["bars"] / n, "digits": s["digits"] / n,
        "lines_distinct": s["lines_distinct"] / s["lines"], "lexicon": F.size(F.array_intersect(s["kinds"], known)),
    }
    return scanned.select(*docs.columns, F.inline(F.array(F.struct(*(features[k].cast("double").alias(prefix + k) for k in FEATURES)))))


def tree_paths(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, seed: int = 1) -> list[tuple[tuple[int, bool, float], ...]]:
    """The paths from the root to each node of gradient-boosted trees, each fitted to half the rows."""
    rng, paths, margin = np.random.default_rng(seed), [], np.zeros(len(y))
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 33))) for c in x.T]

    def grow(rows: np.ndarray, path: tuple, g: np.ndarray, h: np.ndarray) -> None:
        if path:
            paths.append(path)
        best = (1e-6, None)
        if len(path) < depth and len(rows) >= 20:
            for j, c in enumerate(cuts):
                over = x[rows, j][:, None] > c
                gr, hr = (over * g[rows][:, None]).sum(0), (over * h[rows][:, None]).sum(0)
                gl, hl = g[rows].sum() - gr, h[rows].sum() - hr
                n = over.sum(0)
                gain = np.where((n >= 5) & (len(rows) - n >= 5), gr**2 / (hr + 1) + gl**2 / (hl + 1) - g[rows].sum() ** 2 / (h[rows].sum() + 1), 0)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (j, float(c[gain.argmax()])))
        if best[1] is None:
            where = np.ones(len(y), bool)
            for j, over, c in path:
                where &= (x[:, j] > c) == over
            margin[where] += 0.3 * g[rows].sum() / (h[rows].sum() + 1)
            return
        j, c = best[1]
        for over in (True, False):
            grow(rows[(x[rows, j] > c) == over], (*path, (j, over, c)), g, h)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grow(np.flatnonzero(rng.random(len(y)) < 0.5), (), y - p, p * (1 - p))
    return paths


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and sparse weights by accelerated proximal gradient descent."""
    n, m = z.shape
    z = np.hstack([np.ones((n, 1)), z])
    rate = 4 * n / max(1e-9, np.linalg.norm(z, 2) ** 2)
    w = v = np.zeros(m + 1)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        u = v - rate * (z.T @ (p - y)) / n
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - rate * penalty, 0)
        v, w = u + k / (k + 3) * (u - w), u
    return float(w[0]), w[1:]


def learn_rules(x: np.ndarray, y: np.ndarray, penalty: float = 0.002, most: int = 40) -> tuple[float, list]:
    """At most `most` rules for bad texts (y = 1); none where only one class is there or there are under 20 rows.

    If the lasso leaves more, those with the largest weights are fitted again.
    """
    if len(y) < 20 or y.min() == y.max():
        return -1.0, []
    kept, seen = [], set()
    for path in tree_paths(x, y):
        fires = np.ones(len(y), bool)
        for j, over, c in path:
            fires &= (x[:, j] > c) == over
        key = fires.tobytes()
        if key not in seen and fires.any() and not fires.all():
            seen.add(key)
            kept.append((path, fires))
    if not kept:
        return -1.0, []
    z = np.stack([f for _, f in kept], axis=1).astype(float)
    bias, w = lasso_logistic(z, y.astype(float), penalty)
    if np.count_nonzero(w) > most:
        top = np.sort(np.argsort(-np.abs(w), kind="stable")[:most])
        kept, z = [kept[i] for i in top], z[:, top]
        bias, w = lasso_logistic(z, y.astype(float), penalty)
    return bias, [(float(a), tuple((FEATURES[j], over, c) for j, over, c in path)) for a, (path, _) in zip(w, kept, strict=True) if abs(a) > 1e-6]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, lexicon_size: int = 200) -> Model:
    """Fit on at most max_labelled labelled documents, those with the least hash of doc_id.

    A document is bad if its quality is 0 or it is toxic.  Half the sample gives
    the lexicon, words that mark toxic documents by the log-likelihood ratio;
    the other half gives the rules.  Labels with nulls are ignored; of several
    labels of a document the worst holds.
    """
    y = labels.where("doc_id is not null and quality is not null and toxic is not null")
    y = y.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("_bad"), F.max(F.col("toxic") == 1).alias("_toxic"))
    y = y.withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(max_labelled)
    sample = store.save(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(y), F.col("doc_id").cast("long") == F.col("_id")).select("_id", "_bad", "_toxic", "text", (F.col("_h") % 2 == 0).alias("_a")), "labelled")
    first = sample.where("_a")
    n_toxic, n_clean = (int(v or 0) for v in first.agg(F.sum(F.col("_toxic").cast("int")), F.sum((~F.col("_toxic")).cast("int"))).first())
    lexicon: list[str] = []
    if n_toxic and n_clean:
        word = first.select("_toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("w")).where("w <> ''")
        t, c = F.col("t"), F.col("c")
        ratio = 2 * (t * F.log(t * (n_toxic + n_clean) / (n_toxic * (t + c))) + F.when(c > 0, c * F.log(c * (n_toxic + n_clean) / (n_clean * (t + c)))).otherwise(0))
        counts = word.groupBy("w").agg(F.sum(F.col("_toxic").cast("int")).alias("t"), F.sum((~F.col("_toxic")).cast("int")).alias("c"))
        top = counts.where((t >= max(3, 0.02 * n_toxic)) & (t / n_toxic > 8 * c / n_clean)).withColumn("g", ratio).where("g >= 15").orderBy(F.desc("g"), "w").limit(lexicon_size)
        lexicon = [r.w for r in top.collect()]
    rows = with_statistics(sample.where("not _a"), lexicon).select("_bad", *("_f_" + k for k in FEATURES)).orderBy("_id").toPandas()
    bias, rules = learn_rules(rows.iloc[:, 1:].to_numpy(float), rows["_bad"].to_numpy(float))
    return Model(bias, rules, lexicon)


def score_column(model: Model, prefix: str = "_f_") -> Column:
    """Probability that a text is good, compiled from the rules."""
    total = F.lit(model.bias)
    for weight, terms in model.rules:
        holds = reduce(lambda a, b: a & b, [F.col(prefix + k) > c if over else F.col(prefix + k) <= c for k, over, c in terms])
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(total))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the column `score`, in place of one it has; all rows stay, a null text counts as empty."""
    own = store.aside(docs, ("text",))
    scored = with_statistics(own, model.lexicon).select(*own.columns, score_column(model).alias("score"))
    return store.restored(scored, docs.columns, ("text",), "score")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **parameters) -> DataFrame:
    """The rows of docs with a score of at least `least`, with their score.

    docs needs doc_id and text, labels doc_id, quality and toxic.  Repeated rows
    are each scored; without labels of both kinds every row stays; an empty
    table gives no rows.
    """
    return score(docs, fit(docs, labels, **parameters)).where(F.col("score") >= least)
