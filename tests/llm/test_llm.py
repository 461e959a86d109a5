import random
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varbook.llm import embed_dedup, fingerprint, html, line_dedup, mixing, omh_dedup, packing, quality, store, substring_dedup, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, a string, _gone string, _h string, score string, epoch string, row string"


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(100_000)}" for _ in range(n)]


def text(n, seed):
    return " ".join(words(n, seed))


@pytest.fixture(scope="module")
def odd(spark):
    long = "\n".join(text(60, 900 + i) for i in range(400))
    rows = [(1, long), (2, ""), (3, None), (None, text(70, 1)), (5, text(70, 1)), (5, text(70, 1)), (6, text(70, 2) + "\n\nx"), (7, " \n\t "), (8, "one"), (9, long), (None, None)]
    return spark.createDataFrame([(i, t, None if i == 6 else "en", None if i == 8 else "src1", len(t or ""), "q", "q", "q", "q", "q", "q") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 1, 1), (5, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


def test_odd_rows(spark, odd, labels):
    assert {(r.doc_id, r.class_id, r.links) for r in fingerprint.matches(odd).collect() if r.links} == {(9, 1, 1), (1, 1, 1)}
    packed = packing.pack(odd).toPandas()
    n = sum(len((r.text or "").split()) for r in odd.collect())
    assert packed.n_tokens.sum() == n and packed.groupby("pack_id").n_tokens.sum().max() <= 2048
    assert quality.keep_good(odd, labels).count() == odd.count()
    assert mixing.mix_sources(odd, epochs=1).columns == [c for c in odd.columns if c != "epoch"] + ["epoch"]
    lines = line_dedup.without_repeats(odd).collect()
    assert len(lines) == odd.count() and next(r.text for r in lines if r.doc_id == 9).strip() == "" and all(r.a == "q" and r._gone == "q" for r in lines)
    assert {(r.doc_id, r.match_id) for r in substring_dedup.repeats(odd).collect()} == {(9, 1)}
    assert {(r.doc_id, r.rep_id) for r in omh_dedup.near_groups(odd).collect()} == {(1, 1), (9, 1), (2, 2)} - {(2, 2)}
    assert omh_dedup.one_of_each(odd).columns == odd.columns and omh_dedup.one_of_each(odd).count() == odd.count() - 1


def test_empty_tables(spark, odd, labels):
    none = odd.where("false")
    for f in (fingerprint.matches, packing.pack, mixing.mix_sources, line_dedup.without_repeats, substring_dedup.repeats, omh_dedup.near_groups, omh_dedup.one_of_each):
        assert f(none).count() == 0, f
    assert quality.keep_good(none, labels).count() == 0 and quality.keep_good(odd, labels.where("false")).count() == odd.count()
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract_pages(pages).count() == 0 and url_filter.filter_urls(pages, url_filter.default_rules(spark)).count() == 0
    assert embed_dedup.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def lcs(x, y):
    p = [0] * (len(y) + 1)
    for c in x:
        q = [0]
        for j, d in enumerate(y):
            q.append(max(p[j + 1], q[-1], p[j] + (c == d)))
        p = q
    return p[-1]


@pytest.mark.parametrize("hot", [8192, 64])
def test_fingerprints_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(fingerprint, "HOT", hot)
    monkeypatch.setattr(fingerprint, "SAMPLED", 1)
    base = [text(300, i) for i in range(12)]
    texts = base + [b.replace(" w1", " v1") if i % 2 else b + " tail end" for i, b in enumerate(base)]
    texts += [base[3].replace(" w2", f" x{i}") for i in range(90)] + ["same small"] * 2 + ["a" * 5000] * 3 + [""] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    want, edges = Counter(), []
    for i in prints:
        for j in range(i):
            best, p, q = 0, prints[i], prints[j]
            if (p.block, p.one, p.two) == (q.block, q.one, q.two) and p.one:
                best = 100
            for s, b in ((p.one, p.block), (p.two, p.block * 2)):
                for t, c in ((q.one, q.block), (q.two, q.block * 2)):
                    if best < 60 and b == c and any(s[k : k + 7] in t for k in range(len(s) - 6)):
                        best = max(best, 200 * lcs(s, t) // (len(s) + len(t)))
            if best >= 60:
                want[i] += 1
                want[j] += 1
                edges.append((j, i))
    rep = {x.id: x.rep for x in store.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    got = {r.doc_id: (r.links, r.class_id) for r in fingerprint.matches(docs).collect()}
    assert got == {i: (want[i], rep.get(i, i)) for i in prints} and len(rep) > 40


def test_signatures_travel_only_for_runs_in_common(spark, monkeypatch):
    """Documents that have no run in common with another send no signature, whatever grams they share."""
    import pyarrow as pa

    seen = []
    saved = store.save
    monkeypatch.setattr(store, "save", lambda df, name: seen.append((name, saved(df, name))) or seen[-1][1])
    base = text(300, 70000)
    docs = spark.createDataFrame([(i, text(300, 70001 + i)) for i in range(200)] + [(500, base), (501, base + " tail end")], "doc_id long, text string")
    got = {r.doc_id: r.links for r in fingerprint.matches(docs).collect() if r.links}
    keys = {r.key for n, df in seen if n == "heads" for r in df.where("id >= 500").collect()}
    assert got == {500: 1, 501: 1} and len(keys) == 2
    sent = [r.key for n, df in seen if n == "grams" for r in df.collect()]
    assert keys <= set(sent) and len(set(sent) - keys) < 10
    # a gram alone is not enough, one run around it is
    ones = ["ABCDEFGHIJKLMNOP", "QRSABCDEFGHIJTUV", "xxABCDyy"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([3, 3, 3]), pa.array(ones), pa.array([""] * 3)], ["key", "block", "one", "two"])
    rows = [r for b in fingerprint._shared(fingerprint._gram_rows(iter([batch]), 7), 7) for r in b.to_pylist()]
    assert {r["key"] for r in rows} == {1, 2} and not any(r["second"] for r in rows)


def test_rolling_hash_depends_on_seven_bytes():
    x = np.frombuffer(b"abcdefghijklmnopq", np.uint8)
    assert fingerprint.rolling(x)[-1] == fingerprint.rolling(x[5:])[-1]


def test_packing_plan_uses_every_document_once():
    h = np.random.default_rng(1).integers(0, 200, 16)
    used = np.zeros(16, int)
    for parts, times in packing.plan(h):
        assert sum(parts) <= 16
        for k in parts:
            used[k - 1] += times
    assert (used == h).all()
    a, b = np.random.default_rng(2).random((6, 9)), np.random.default_rng(3).random(6)
    x = packing.nnls(a, b)
    g = a.T @ (a @ x - b)
    assert (x >= 0).all() and g.min() > -1e-6 and abs(g @ x) < 1e-6


def test_rules_on_held_out_rows():
    r = np.random.default_rng(0)
    x = r.random((1200, len(quality.FEATURES)))
    y = ((x[:, 4] > 0.6) & (x[:, 2] < 0.7) | (x[:, 9] > 0.9)).astype(float)
    bias, rules = quality.learn_rules(x[:600], y[:600])
    at = {k: i for i, k in enumerate(quality.FEATURES)}
    total = np.full(600, bias)
    for w, terms in rules:
        total += w * np.all([(x[600:, at[k]] > c) == over for k, over, c in terms], axis=0)
    assert ((total > 0) == y[600:]).mean() > 0.95 and len(rules) <= 40
    assert quality.learn_rules(x[:600], np.ones(600))[1] == []


def test_quality_compiles_to_columns(spark):
    docs = spark.createDataFrame([(i, text(50, i) if i % 2 else (text(5, i) + "!! ").upper() * 10) for i in range(200)], "doc_id long, text string")
    y = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    kept = {r.doc_id for r in quality.keep_good(docs, y.where("doc_id < 120")).collect()}
    assert kept == set(range(1, 200, 2))


def test_best_region_against_all_regions():
    r = random.Random(4)
    for _ in range(200):
        s = [r.choice([-3, -1, 0, 1, 2]) for _ in range(r.randrange(12))]
        start, end, best = html.best_region([float(v) for v in s])
        assert best == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))]) and sum(s[start:end]) == best


def test_html(spark):
    page = "<html><script>var a='<p>no</p>'</script><nav><a href=x>home</a><a>b</a></nav><{0}><p>" + text(80, 3) + " &amp; more</p></{0}><footer><a>c</a></footer>"
    rows = [(1, "u", page.format("article")), (2, "u", page.format("div")), (3, None, None), (4, "u", ""), (4, "u", "<p>"), (5, "u", "<" * 50_000)]
    got = {r.page_id: r for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == got[2].text == text(80, 3) + " & more" and got[3].text == "" and got[4].n_words == 0


@pytest.mark.parametrize("page", ["<a" * 5_000_000, "<script " * 1_000_000, '<a ">" ' * 1_000_000, "<a '" * 1_000_000 + ">", "<!-- " * 1_000_000, "<p>" * 300_000])
def test_html_in_linear_time(page):
    began = time.time()
    assert html.extract(page, html.DEFAULT)[1] >= 0 and time.time() - began < 15


def test_html_pieces():
    assert html.pieces("a<b c='>'>d<!-- <i> -->e</b>< f<script>x<y></script >g<3 h<u") == ["a", "<b c='>'>", "d e", "</b>", "< f g<3 h<u"]
    assert html.pieces("<p title='x>y<q>z")[1::2] == ["<p title='x>", "<q>"] and html.pieces("") == [""] and html.pieces("a<!-- b") == ["a "]


def test_embeddings_of_several_dimensions(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).standard_normal(8)]) for i in range(9)] + [(20, [1.0, 2.0]), (21, [1.0, 2.001]), (21, [-5.0, 1.0]), (22, [-5.0, 1.001]), (23, [1.0, 2.0])]
    docs = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, id string")
    assert {(r.vec_id, r.rep_id) for r in embed_dedup.near_embeddings(docs).collect()} == {(20, 20), (21, 20), (22, 20), (23, 20)}


def test_packs_hold_every_token_once(spark):
    r = random.Random(12)
    sizes = [r.choice([0, 1, 7, 40, 99, 100, 101, 230]) for _ in range(400)]
    docs = spark.createDataFrame([(i // 2, text(n, i), "q") for i, n in enumerate(sizes)], "doc_id long, text string, pack_id string")
    rows = packing.pack(docs, length=100, bins=20).collect()
    want = Counter((i // 2, p, 100 * p, min(100, n - 100 * p)) for i, n in enumerate(sizes) for p in range(-(-n // 100)))
    assert Counter((x.doc_id, x.piece, x.start_token, x.n_tokens) for x in rows) == want
    assert len({(x.pack_id, x.slot) for x in rows}) == len(rows)
    full = Counter()
    for x in rows:
        full[x.pack_id] += x.n_tokens
    assert max(full.values()) <= 100 and len(full) <= 1.15 * sum(sizes) / 100


def test_budgets():
    have = {("a", "x", "1"): 10.0, ("a", "x", "2"): 100.0, ("b", "y", "3"): 1000.0}
    got = mixing.budgets(have, {("a",): 0.5, ("b",): 0.5, ("a", "x", "1"): 0.5, ("a", "x", "2"): 0.5}, 200, 2)
    assert got == {("a", "x", "1"): 20.0, ("a", "x", "2"): 80.0, ("b", "y", "3"): 100.0}
    got = mixing.budgets(have, {("a",): 0.9, ("b",): 0.1}, 1000, 2)
    assert round(got["b", "y", "3"]) == 780 and round(sum(got.values())) == 1000


def test_mix_takes_prefixes(spark):
    docs = spark.createDataFrame([(i, text(1 + i % 7, i), "en", f"src{i % 3 * 8}") for i in range(900)], "doc_id long, text string, lang string, source string")
    n = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    rows = mixing.mix_sources(docs, budget=3000, weights={("web",): 0.8, ("books",): 0.1, ("forum",): 0.1}).collect()
    got, times = defaultdict(int), Counter(r.doc_id for r in rows)
    for r in rows:
        got[r.source] += n[r.doc_id]
    for source, want in {"src0": 2400, "src8": 300, "src16": 300}.items():
        assert want - 7 < got[source] <= want
        assert len({times.get(i, 0) for i in n if f"src{i % 3 * 8}" == source}) <= 2


def test_embeddings_against_all_pairs(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((60, 32))
    v = np.vstack([base, base[:30] + 0.05 * r.standard_normal((30, 32)), base[:3]])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, base[0].tolist()), (900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [1.0])]
    got = embed_dedup.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9).sum(1) > 1
    assert {x.vec_id for x in got} == set(np.flatnonzero(near).tolist()) and all(x.rep_id <= x.vec_id for x in got)


def test_lines_against_all_pairs(spark):
    r, rows = random.Random(6), []
    pool = [words(r.randrange(3, 25), 1000 + i) for i in range(40)]
    for d in range(40):
        own = []
        for _ in range(6):
            w = list(r.choice(pool))
            if r.random() < 0.5:
                w[r.randrange(len(w))] = f"z{r.randrange(9)}"
            own.append(" ".join(w))
        rows.append((d, "\n".join(own)))
    seen, want = [], set()
    for d, t in rows:
        for i, line in enumerate(t.split("\n")):
            w = line.split()
            g = set(zip(w, w[1:]))
            if len(g) >= 3:
                if any(len(g & h) >= 0.8 * len(g | h) - 1e-9 for h in seen):
                    want.add((d, i))
                seen.append(g)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(x.doc_id, x.line) for x in line_dedup.repeated_lines(docs, least=3, q=2).collect()} == want
    left = {x.doc_id: x.text for x in line_dedup.without_repeats(docs, least=3, q=2).collect()}
    assert all(left[d] == "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in want) for d, t in rows)


def test_short_lines_take_part(spark, tmp_path):
    from varbook.llm import queries

    docs = spark.createDataFrame([(1, "home\nread more\n\nall rights reserved\none two one two one"), (2, "all rights reserved\nHome\nother words here\n\nread more\none two one two one")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = {x.doc_id: x.text for x in queries.queries()["op7_lines"](spark, str(tmp_path)).collect()}
    assert left == {1: docs.where("doc_id = 1").first().text, 2: "other words here\n"}


@pytest.mark.parametrize(("often", "hot", "best"), [(192, 1 << 20, 4), (1, 1 << 20, 1), (1, 2, 1)])
def test_lines_by_words_against_all_pairs(spark, tmp_path, monkeypatch, often, hot, best):
    from varbook.llm import queries

    for name, value in (("OFTEN", often), ("HOT", hot), ("BEST", best)):
        monkeypatch.setattr(line_dedup, name, value)
    r, rows = random.Random(16), []
    pool = [words(r.randrange(1, 40), 3000 + i) for i in range(40)]
    pool += [[f"c{r.randrange(20)}" for _ in range(r.randrange(1, 14))] for _ in range(20)]
    for d in range(60):
        own = []
        for _ in range(6):
            w = list(r.choice(pool))
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = f"z{r.randrange(9)}"
            if r.random() < 0.3:
                r.shuffle(w)
            own.append(" ".join(w))
        rows.append((d, "\n".join(own)))
    seen, want = [], {}
    for d, t in rows:
        kept = []
        for line in t.split("\n"):
            g = set(line.split())
            if not any(len(g & h) >= 0.8 * len(g | h) - 1e-9 for h in seen):
                kept.append(line)
            seen.append(g)
        want[d] = "\n".join(kept)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {x.doc_id: x.text for x in queries.queries()["op7_lines"](spark, str(tmp_path)).collect()} == want


def test_compact_windows_against_the_tree():
    h = np.random.default_rng(7).integers(0, 1 << 60, 80).astype(np.uint64)

    def nodes(i, j):
        if j - i < 6:
            return set()
        p = i + int(h[i:j].argmin())
        return {p} | nodes(i, p) | nodes(p + 1, j)

    got, lo, hi = substring_dedup.compact_windows(h, np.array([0, 30, 80]), 6)
    assert got.tolist() == sorted(nodes(0, 30) | nodes(30, 80))
    for p, a, b in zip(got, lo, hi):
        assert [i for i in range(75) if (i + 6 <= 30 or i >= 30) and i <= p < i + 6 and h[i : i + 6].argmin() + i == p] == list(range(a, b + 1))


def test_passages(spark):
    p, head = text(55, 50), text(20, 51)
    changed = p.split()
    changed[27] = "other"
    rows = [(i, f"{head} {text(90, 60 + i)} {p} {text(40, 160 + i)}") for i in range(30)] + [(40, f"{text(60, 300)} {' '.join(changed)} {text(9, 301)}"), (41, f"{head} {text(200, 302)}")]
    got = {r.doc_id: r for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {*range(1, 30), 40} and got[7].start_word == 110 and got[7].end_word == 165


def test_passages_behind_a_fragment(spark):
    p = words(50, 400)
    rows = [(i, f"{text(30, 410 + i)} {' '.join(p[i % 20 : i % 20 + 30])} {text(30, 450 + i)}") for i in range(30)]
    rows += [(100 + i, f"{text(40, 500 + i)} {' '.join(p)} {text(40, 520 + i)}") for i in range(3)]
    got = {(r.doc_id, r.match_id) for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, _ in got} == {101, 102} and (101, 100) in got


@pytest.mark.parametrize("every", [10, 13, 20])
def test_passages_with_changed_words(spark, every):
    rows = []
    for i in range(40):
        p = words(70, 7000 + i)
        changed = [f"x{i}-{k}" if k % every == 5 else w for k, w in enumerate(p)]
        rows += [(2 * i, f"{text(40, 7100 + i)} {' '.join(p)} {text(30, 7200 + i)}"), (2 * i + 1, f"{text(25, 7300 + i)} {' '.join(changed)} {text(50, 7400 + i)}")]
    got = {(r.match_id, r.doc_id) for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= {(2 * i, 2 * i + 1) for i in range(40)} and len(got) >= 38


def test_passages_against_all_pairs(spark):
    """Every exact run of 50 words that an earlier text has too is in a reported passage, and each report is true."""
    r, pool = random.Random(77), [words(60, 8000 + i) for i in range(12)]
    texts = []
    for i in range(60):
        w = words(r.randrange(20, 90), 8100 + i)
        for _ in range(r.randrange(3)):
            p, at = r.choice(pool), r.randrange(len(w))
            a = r.randrange(11)
            w[at:at] = p[a : a + r.choice([30, 50, 60])]
        texts.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(60, None), (None, rows_text := " ".join(pool[0])), (61, ""), (62, rows_text), (62, "aa bb")]
    got = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    seen, want = {}, set()
    for i, w in enumerate([*texts, [], [], pool[0]]):
        own = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        want |= {(i, k) for k, g in enumerate(own) if seen.get(g, i) < i}
        for g in own:
            seen.setdefault(g, i)
    hit = {(d, k) for d, k in want if any(x.doc_id == d and x.start_word <= k and k + 50 <= x.end_word for x in got)}
    assert len(want) > 20 and len(hit) >= 0.95 * len(want), (want - hit, [tuple(x) for x in got if x.doc_id in {d for d, _ in want - hit}])
    for x in got:
        u, v = Counter(texts[x.match_id][x.match_start : x.match_end] if x.match_id < 60 else pool[0]), Counter((texts[x.doc_id] if x.doc_id < 60 else pool[0])[x.start_word : x.end_word])
        both = sum((u & v).values())
        assert x.match_id < x.doc_id and min(sum(u.values()), sum(v.values())) >= 50 and abs(both / (sum(u.values()) + sum(v.values()) - both) - x.jaccard) < 1e-9 and x.jaccard >= 0.8


@pytest.mark.parametrize(("near", "rows", "want"), [(True, [(1, "A"), (5, "A"), (5, "B"), (9, "C")], {(5, 1), (9, 5)}), (True, [(1, "A"), (5, "A"), (5, "aa bb")], {(5, 1)})])
def test_passages_of_repeated_ids(spark, near, rows, want):
    texts = {"A": text(70, 1), "B": text(70, 2), "C": text(70, 2).replace(" w9", " z9", 1)}
    docs = spark.createDataFrame([(i, texts.get(t, t)) for i, t in rows], "doc_id long, text string")
    assert {(r.doc_id, r.match_id) for r in substring_dedup.repeats(docs).collect()} == want


def test_near_copies_of_repeated_ids(spark):
    a, b, u = text(30, 1), text(30, 2), text(30, 3)
    docs = spark.createDataFrame([(1, a), (5, a), (5, u), (5, u), (7, None), (None, a)], "doc_id long, text string")
    assert Counter((r.doc_id, r.text) for r in omh_dedup.one_of_each(docs).collect()) == Counter([(1, a), (5, u), (5, u), (7, None), (None, a)])
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (9, "x " + " ".join(b.split()[1:]))], "doc_id long, text string")
    assert {(r.doc_id, r.rep_id) for r in omh_dedup.near_groups(docs).collect()} == {(1, 1), (5, 1), (9, 1)}


def test_short_texts_are_near(spark):
    rows = [(i, " ".join(words(n, 9000 + i // 2)[: n - i % 2] + ["x"] * (i % 2))) for n in (5, 6) for i in range(100 * n, 100 * n + 100)]
    got = {r.doc_id for r in omh_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) >= 195


def test_near_groups_against_all_pairs(spark):
    r, rows = random.Random(8), []
    for i in range(25):
        w = words(r.randrange(5, 120), 2000 + i)
        for _ in range(r.randrange(1, 5)):
            v = list(w)
            for _ in range(int(len(v) * r.random() * 0.15)):
                v[r.randrange(len(v))] = f"z{r.randrange(999)}"
            rows.append((len(rows), " ".join(v)))
    pairs = [(i, j) for i, x in rows for j, y in rows[:i] if distance(x.split(), y.split()) <= 0.2 * max(len(x.split()), len(y.split())) + 1e-9]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rep = {x.doc_id: x.rep_id for x in omh_dedup.near_groups(docs).collect()}
    assert sum(rep.get(i, -1) == rep.get(j, -2) for i, j in pairs) >= 0.9 * len(pairs)
    edges = spark.createDataFrame(pairs, "a long, b long")
    exact = {x.id: x.rep for x in store.components(edges).collect()}
    assert all(exact[i] == exact[j] for i in rep for j in [rep[i]])


def distance(x, y):
    p = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        q = [i]
        for j, b in enumerate(y, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (a != b)))
        p = q
    return p[-1]


def test_banded_distance():
    r = random.Random(9)
    for _ in range(500):
        x, y = ([r.randrange(3) for _ in range(r.randrange(12))] for _ in "xy")
        k = r.randrange(9)
        assert omh_dedup.banded_distance(x, y, k) == min(distance(x, y), k + 1)


def test_urls(spark):
    urls = ["http://u@Spam-Farm.example.org:80/x?q#f", "https://www.cheap-pills.example.com/de/1", "https://www.cheap-pills.example.com/en/1", "notspam-farm.example.org", None, "", "http://10.0.0.1/a", "//www.therti.example.org/en/5", "http://therti.example.org"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: r.action for r in url_filter.filter_urls(pages, url_filter.default_rules(spark)).collect()}
    assert got == dict(enumerate(["block", "allow", "block", "allow", "allow", "allow", "allow", "allow", "block"]))


def test_deep_url_rules(spark):
    rules = spark.createDataFrame([("a.org/1/2/3/4/5/", "block"), ("c.d.e.f.g.h.org/", "block")], "expression string, action string")
    urls = ["http://a.org/1/2/3/4/5/6/7/x", "http://a.org/1/2/3/4/x", "http://a.b.c.d.e.f.g.h.org/x/y", "http://d.e.f.g.h.org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r.page_id: r.action for r in url_filter.filter_urls(pages, rules).collect()} == {0: "block", 1: "allow", 2: "block", 3: "allow"}
    assert {r.action for r in url_filter.filter_urls(pages, rules.where("false")).collect()} == {"allow"}


def test_marked(spark):
    df = store.marked(spark.range(5000).withColumnRenamed("id", "k"), "k", spark.range(0, 5000, 7))
    got = {r.k for r in df.where("_mark").collect()}
    assert set(range(0, 5000, 7)) <= got and len(got) < 760


def test_components_of_a_chain(spark):
    got = store.components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")).collect()
    assert len(got) == 43 and {r.rep for r in got} == {0, 100}


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), d).columns == columns, name
    assert corpus_pipeline.run(spark, d).count() > 0


def test_agreement_against_all_pairs():
    for seed in range(40):
        r = np.random.default_rng(seed)
        n = int(r.integers(0, 200))
        pair, at, diagonal, function = (r.integers(0, k, n) for k in (5, 60 if seed % 2 else 2000, 5 if seed % 3 else 80, 6))
        near = (pair[:, None] == pair) & (np.abs(at[:, None] - at) <= 48) & (np.abs(diagonal[:, None] - diagonal) <= 12)
        for enough in (1, 2, 3):
            want = np.array([len(set(function[x])) >= enough for x in near], bool)
            assert (substring_dedup.agreeing(pair, at, diagonal, function, enough, 48) == want).all()
    n = 4000  # a line that a text repeats: one place of the earlier text, thousands of diagonals
    began = time.time()
    got = substring_dedup.agreeing(np.zeros(6 * n, int), np.repeat(np.arange(6) * 7, n), np.tile(np.arange(n) * 9, 6), np.repeat(np.arange(6), n), 2, 48)
    assert got.all() and time.time() - began < 5


def test_spots_of_a_pair_travel_packed():
    """Two documents with thousands of meetings make one row of few bytes, and none is lost."""
    import pyarrow as pa

    n = 120
    doc, at = np.repeat([1, 2], n), np.tile(np.arange(n) * 30, 2)
    place = at << 24 | np.arange(2 * n) % n << 54 | 10 << 8 | 245
    batch = pa.RecordBatch.from_arrays([pa.array(v) for v in (np.full(2 * n, 77), doc, place, np.full(2 * n, 5 << 32 | 6))], ["key", "doc_id", "place", "context"])
    rows = [r for b in substring_dedup._edges(iter([batch]), 6) for r in b.to_pylist()]
    assert [(r["a"], r["b"]) for r in rows] == [(1, 2)] and len(rows[0]["spots"]) < 2 * n * n
    a, d, f = substring_dedup.unpack(rows[0]["spots"])
    assert {(x, x + y) for x, y in zip(a.tolist(), d.tolist(), strict=True)} == {(x * 30, y * 30) for x in range(n) for y in range(n)} and not f.any()
    for m in (0, 1, 3, 500):
        r = np.random.default_rng(m)
        own = r.integers(0, 1 << 29, m), r.integers(-(1 << 29), 1 << 29, m), r.integers(0, 6, m)
        assert (substring_dedup.unpack(substring_dedup.pack(*own)) == np.stack(own)).all()


def test_spots_without_a_long_match_give_no_passage():
    for seed in range(60):
        r = np.random.default_rng(seed)
        x, y = ([r.integers(0, 3 if seed % 2 else 50, int(r.integers(1, 300))).astype(np.uint32) for _ in range(4)] for _ in range(2))
        for k in range(4):  # changed, lost and added words
            v = list(x[k])
            for _ in range(int(r.integers(0, 12))):
                i = int(r.integers(0, len(v)))
                v[i : i + int(r.integers(0, 2))] = [int(r.integers(100, 200))] * int(r.integers(0, 2)) or v[i : i + 1]
            y[k] = np.array(v, np.uint32)
        pair, at, diagonal = r.integers(0, 4, 400), r.integers(-3, 300, 400), r.integers(-4, 5, 400)
        ok = substring_dedup.long_enough(x, y, pair, at, diagonal, 20, 3)
        for k in range(400):
            got = substring_dedup.passages(x[pair[k]], y[pair[k]], [(int(at[k]), int(diagonal[k]))], 20, 0.0, 3)
            assert bool(got) == ok[k]


def test_dense_spots_agree_in_little_time():
    r = np.random.default_rng(5)
    n = 60_000  # of two texts that repeat lines, thousands of spots within the same places and diagonals
    began = time.time()
    got = substring_dedup.agreeing(np.zeros(n, int), r.integers(0, 200, n), r.integers(0, 100, n), r.integers(0, 6, n), 2, 48)
    assert got.all() and time.time() - began < 2


@pytest.mark.parametrize(("sampled", "often"), [(16, 2), (1, 6), (1, 1)])
def test_passages_among_many_fragments(spark, monkeypatch, sampled, often):
    """Two documents have a passage in common, and many before and between them 40 words of it."""
    monkeypatch.setattr(substring_dedup, "SAMPLED", sampled)
    monkeypatch.setattr(substring_dedup, "OFTEN", often)
    rows, want = [], set()
    for k in range(12):
        p, base = words(50, 9000 + k), 100 * k
        for i in range(14):
            own = p if i in (5, 12) else p[5:45]
            rows.append((base + i, f"{text(60, 9100 + base + i)} {' '.join(own)} {text(60, 19100 + base + i)}"))
        want.add((base + 12, base + 5))
    got = {(r.doc_id, r.match_id) for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_passages_of_a_text_with_repeats(spark):
    """The earlier document's match is neither its first nor its last window under the tokens."""
    rows, want = [], set()
    for k in range(12):
        p, base = words(50, 9500 + k), 10 * k
        near = [f"{text(60, 9600 + 50 * k + i)} {' '.join(p[5:45])} {text(60, 29600 + 50 * k + i)}" for i in range(20)]
        rows += [(base, f"{' '.join(near[:9])} {' '.join(p)} {' '.join(near[9:])}"), (base + 1, f"{text(60, 39600 + k)} {' '.join(p)} {text(60, 49600 + k)}")]
        want.add((base + 1, base))
    got = {(r.doc_id, r.match_id) for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_rare_tokens_go_without_the_next():
    """Only where groups may be divided do rows have the tokens after theirs; groups larger than foreseen stay whole."""
    import pyarrow as pa

    lines = [text(30, 60000 + i) for i in range(50)] + [f"{text(24, 60100)} {text(6, 60200 + i)}" for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lines))), pa.array(lines)], ["doc_id", "text"])
    counts = np.zeros(line_dedup.COUNTERS, np.uint8)
    tokens = line_dedup.line_tokens(*line_dedup.pieces(batch.column(1)).__next__()[2:], 1)[3]
    np.add.at(counts, (tokens & np.uint64(line_dedup.COUNTERS - 1)).astype(np.int64), 1)
    rank = type("Rank", (), {"value": np.where(counts, np.maximum(1, 8 * np.log2(np.maximum(counts, 1))), 0).astype(np.uint8)})

    def found(divide_at, often):
        rows = list(line_dedup._prefixes(iter([batch]), 1, 1, 0.8, rank, 100, 1 << 20, divide_at))
        pairs = {(r["doc_a"], r["doc_b"]) for b in line_dedup._candidates(iter(rows), 0.8, often, 1000) for r in b.to_pylist() if r["token"] is None}
        return sum(len(x) for b in rows for x in b.column("next").to_pylist()), pairs

    some, want = found(192, 192)
    none, divided = found(1, 192)
    assert some == 0 < none and want == divided
    assert found(192, 3)[1] >= found(1, 3)[1]


def test_dense_spots_of_one_function_agree_in_little_time():
    """Spots in dense places that no other function settles: their number in reach must not count."""
    r = np.random.default_rng(6)
    n = 60_000
    at, diagonal = np.append(r.integers(0, 100, n), 0), np.append(r.integers(0, 300, n), 0)
    began = time.time()
    got = substring_dedup.agreeing(np.zeros(n + 1, int), at, diagonal, np.append(np.zeros(n, int), 3), 2, 48)
    assert (got == ((at <= 48) & (diagonal <= 12))).all() and time.time() - began < 2


def test_batches_without_any_passage():
    """A batch of pairs none of which agrees, and one none of which aligns, give no rows and no error."""
    import pyarrow as pa

    one = [np.array(v) for v in ([5], [3], [0])]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([[substring_dedup.pack(*one)]], pa.list_(pa.binary()))], ["a", "b", "spots"])
    assert sum(b.num_rows for b in substring_dedup._agree(iter([batch]), 2, 48)) == 0
    text_ = np.arange(20, dtype=np.uint32).tobytes()
    columns = [pa.array([1]), pa.array([2]), pa.array([substring_dedup.pack(*one)], pa.binary()), pa.array([0]), pa.array([text_], pa.binary()), pa.array([0]), pa.array([text_], pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, ["a", "b", "spots", "u", "x", "v", "y"])
    assert sum(b.num_rows for b in substring_dedup._verify(iter([batch]), 50, 0.8, 3)) == 0
    assert substring_dedup.pack_all(*[np.zeros(0, np.int64)] * 4) == [] and substring_dedup.unpack_all([])[1].shape == (3, 0)


def test_fingerprint_links_memory_follows_groups():
    r, n = np.random.default_rng(1), 60_000
    sign = fingerprint.ALPHABET[np.repeat(r.integers(0, 64, (n // 3, 64)), 3, axis=0)]
    sign[1::3, 60:] = fingerprint.ALPHABET[r.integers(0, 64, (n // 3, 4))]
    sign[2::3, 8:] = fingerprint.ALPHABET[r.integers(0, 64, (n // 3, 56))]
    begin, gram = (fingerprint.runs(sign.ravel(), np.arange(n + 1) * 64, np.full(n, 48), 7)[i] for i in (3, 1))
    zero, block = pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, 48, np.int32))
    columns = [pa.array(gram[begin % 64 == 0]), zero, zero, zero, pa.array(np.arange(n)), block, pa.array(np.ones(n, np.int64)), zero, pa.array([x.tobytes().decode() for x in sign])]
    batch = pa.RecordBatch.from_arrays(columns, ["gram", "first", "second", "mine", "key", "block", "weight", "part", "text"])

    def links(rows):
        found, edges = Counter(), 0
        for b in fingerprint._links(iter([rows]), 60, 7):
            for k, v, other in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found[k] += v or 0
                edges += other is not None
        return +found, edges

    tracemalloc.start()
    got = links(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    parts = [links(batch.slice(i, 600)) for i in range(0, n, 600)]  # groups are whole in each
    assert got == (sum((x for x, _ in parts), Counter()), sum(e for _, e in parts)) and got[1] > 500
    assert peak < 80e6, peak
