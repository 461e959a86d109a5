"""Main text of web pages: the maximum-scoring subsequence of words and tags."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLOSING = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "noscript", "template", "title")}
MARK = re.compile(r"[>\"']")
UNCLOSED = 4
ROWS = 256
NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9-]*)")
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "header", "footer", "nav", "blockquote", "pre", "td", "th", "main", "aside", "body", "dd", "dt"}
DEFAULT = {"": -3.0}
LABEL = ("article", "main")


def pieces(page: str) -> list[str]:
    """Text at even places, tags at odd ones; comments, scripts, styles and the title are gone.

    One pass over the page, in time linear in its length.  A tag ends at the
    first > outside quotes, or, if its quotes don't close, at the first one at
    all; after UNCLOSED such tags quotes count no more on the page.  Without a
    later > a < is text.  A comment or script that isn't closed takes the rest.
    """
    out: list[str] = []
    text: list[str] = []
    last, at, begin, unclosed = page.rfind(">"), 0, 0, 0
    while True:
        i = page.find("<", at)
        if i < 0 or (i > last and not page.startswith("<!--", i)):
            break
        if page.startswith("<!--", i):
            text += [page[begin:i], " "]
            end = page.find("-->", i + 4)
            at = begin = len(page) if end < 0 else end + 3
            continue
        c = page[i + 1 : i + 2]
        if not (c in "/!?" or (c.isascii() and c.isalpha())):
            at = i + 1
            continue
        end, k = -1, i + 1
        while unclosed < UNCLOSED:
            m = MARK.search(page, k)
            if not m or m[0] == ">":
                end = m.start() if m else -1
                break
            k = page.find(m[0], m.end()) + 1
            if not k:
                break
        if end < 0:
            unclosed += 1
            end = page.find(">", i)
        tag = page[i : end + 1]
        at = begin_next = end + 1
        closing = CLOSING.get(tag_name(tag)) if tag[1] != "/" else None
        if closing:
            m = closing.search(page, at)
            text += [page[begin:i], " "]
            at = begin = m.end() if m else len(page)
            continue
        out += ["".join([*text, page[begin:i]]), tag]
        text, begin = [], begin_next
    return [*out, "".join([*text, page[begin:]])]


def tag_name(tag: str) -> str:
    m = NAME.match(tag)
    return m[1].lower() if m else "!"


def best_region(scores: list[float]) -> tuple[int, int, float]:
    """(start, end, score) of the contiguous region with the greatest sum, by one scan; the first and longest of equals; (0, 0, 0) if none is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and best > 0 and start == at[0]):
            best, at = total, (start, i + 1)
    return *at, best


def extract(page: str | None, weights: dict[str, float]) -> tuple[str, int, float]:
    """(text, words, score): each word scores 1, each tag the weight of its name."""
    if not page:
        return "", 0, 0.0
    parts = pieces(page)
    other = weights[""]
    scores = [weights.get(tag_name(p), other) if i % 2 else float(len(p.split())) for i, p in enumerate(parts)]
    start, end, best = best_region(scores)
    out = []
    for i in range(start, end):
        p = parts[i]
        out.append(("\n" if tag_name(p) in BLOCKS else " ") if i % 2 else p)
    text = entities.unescape("".join(out))
    lines = [" ".join(line.split()) for line in text.split("\n")]
    text = "\n".join(line for line in lines if line)
    return text, len(text.split()), best


def labelled(page: str) -> tuple[list[str], int, int] | None:
    """Pieces of a page with one article (or else main) element, and the bounds of what is in it."""
    parts = pieces(page)
    for name in LABEL:
        opens = [i for i in range(1, len(parts), 2) if re.match(rf"<{name}\b", parts[i], re.I)]
        closes = [i for i in range(1, len(parts), 2) if re.match(rf"</{name}\b", parts[i], re.I)]
        if len(opens) == len(closes) == 1 and opens[0] < closes[0]:
            return parts, opens[0] + 1, closes[0]
    return None


def fit(pages: list[str]) -> dict[str, float]:
    """Weights of tags (negative) against 1 for a word, from pages whose content is marked.

    A tag's weight is -strength times how much likelier it is outside the
    content than inside, by smoothed log-odds, and at least a tenth of that of
    an even tag.  The strength is the one with the best F1 over words.  The
    marking elements get the weight of an unknown tag, so the mark isn't seen.
    """
    marked = [x for x in map(labelled, pages) if x]
    if not marked:
        return dict(DEFAULT)
    inside, outside = Counter(), Counter()
    for parts, a, b in marked:
        for i in range(1, len(parts), 2):
            (inside if a <= i < b else outside)[tag_name(parts[i])] += 1
    odds = {t: log((outside[t] + 1) / (sum(outside.values()) + 2)) - log((inside[t] + 1) / (sum(inside.values()) + 2)) for t in inside | outside if t not in LABEL}
    best = (-1.0, DEFAULT)
    for strength in (0.5, 1, 2, 3, 4, 6, 8, 12):
        w = {t: -strength * max(0.1, 1 + o / 2) for t, o in odds.items()} | {"": -float(strength)}
        hit = found = true = 0
        for parts, a, b in marked:
            n = [len(p.split()) if i % 2 == 0 else 0 for i, p in enumerate(parts)]
            s, e, _ = best_region([w.get(tag_name(p), w[""]) if i % 2 else float(n[i]) for i, p in enumerate(parts)])
            hit += sum(n[max(a, s) : min(b, e)])
            found += sum(n[s:e])
            true += sum(n[a:b])
        f1 = 2 * hit / max(1, found + true)
        if f1 > best[0]:
            best = (f1, w)
    return best[1]


def _extract(batches: Iterator[pa.RecordBatch], weights: dict[str, float]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            batch = whole.slice(i, ROWS)
            text, words, score = zip(*(extract(p.as_py(), weights) for p in batch.column(2)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(words, pa.int64()), pa.array(score, pa.float64())], ["page_id", "url", "text", "n_words", "score"])


def extract_pages(pages: DataFrame, max_labelled: int = 400, max_chars: int = 200_000) -> DataFrame:
    """(page_id, url, text, n_words, score) of every page, as many rows as pages has.

    pages needs page_id, url and html; other columns are ignored.  The weights
    are fitted on at most max_labelled different pages of up to max_chars
    characters with a single article or main element, those with the least
    hashes; without such pages default weights hold.  Every page is extracted
    whole, in time linear in its length, however malformed.  A null, empty or
    wordless page has an empty text and a score of 0; repeated rows each have a
    result; an empty table gives no rows.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    # only hashes are ordered; texts of no more than max_labelled pages are fetched
    mark = own.where(F.col("html").rlike("(?i)<(article|main)[ >]") & (F.length("html") <= max_chars)).withColumn("h", F.xxhash64("html"))
    top = mark.select("h").distinct().orderBy("h").limit(max_labelled).agg(F.max("h")).first()[0]
    weights = fit([r.html for r in mark.where(F.col("h") <= top).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()] if top is not None else [])
    return own.mapInArrow(partial(_extract, weights=weights), "page_id long, url string, text string, n_words long, score double")
