"""Each operator against brute force, an exact round trip or held-out labels."""

import itertools
import math
import random
import re
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import bpe, crossent, decontam, jaccard, langid, simple8b, topk, toxicity, urls, warc
from graphloom.llm.text import per_document

DATA = "/root/testdata"
WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def words(t):
    return WORD.findall((t or "").lower())


def corpus(n, seed, vocabulary=400, length=(5, 90)):
    r = random.Random(seed)
    vocab = ["w" + "".join(r.choices("abcdefgh", k=r.randint(1, 6))) for _ in range(vocabulary)]
    return [" ".join(r.choices(vocab, k=r.randint(*length))) for _ in range(n)]


def edited(t, rate, r):
    return " ".join(r.choice(["new", "old", "odd"]) if r.random() < rate else w for w in t.split())


# Language ID


def test_filters_hold_all_grams_and_correct_chance():
    r = np.random.default_rng(1)
    sets = {k: r.choice(1 << 30, 5000, replace=False).astype(np.uint32) for k in ("aa", "bb", "cc")}
    f = langid.Filters.build(sets, bits=1 << 14)
    for i, k in enumerate(f.langs):
        assert (f.masks(sets[k]) >> i & 1).all()
    other = r.integers(1 << 30, 1 << 31, 200_000).astype(np.uint32)
    raw = (f.masks(other) & 1).mean()
    assert abs(raw - f.chance[0]) < 0.02 and raw > 0.05
    assert f.counts(other, np.array([0, len(other)]))[0, 0] / len(other) < 0.02


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = langid.identify(docs, train_docs=60).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.lang_pred == got.lang).mean() > 0.98 and got.accepted.mean() > 0.98


def test_noise_has_no_language(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    f = langid.fit(docs)
    r = random.Random(2)
    noise = [(i, "".join(r.choices("qxzjkvw0123456789#@ ", k=800))) for i in range(30)]
    assert langid.accepted(spark.createDataFrame(noise, "doc_id int, text string"), f).count() <= 1


def test_more_languages_than_bits_of_a_word(spark):
    r, rows = random.Random(51), []
    for k in range(70):
        letters = r.sample("abcdefghijklmnopqrstuvwxyz", 6)
        vocab = ["".join(r.choices(letters, k=5)) for _ in range(12)]
        rows += [(10 * k + i, " ".join(r.choices(vocab, k=40)), f"l{k:02}") for i in range(6 if k < 64 else 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    f = langid.fit(docs)
    assert len(f.langs) == 70
    got = langid.apply(docs, f).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.lang_pred == got.lang).mean() > 0.98 and (got.lang_pred == got.lang)[got.lang >= "l64"].all()


def plain_grams(t):
    b = bytes(x if x >= 128 or 97 <= x <= 122 else 32 for x in t.lower().encode())
    b = b" " + b + b" "
    return [int.from_bytes(b[i : i + 4], "little") for i in range(len(b) - 3) if b"  " not in b[i : i + 4]]


def test_language_by_sets_of_n_grams():
    texts = [*corpus(30, 27, length=(1, 30)), "", "  12 ", "a", "ÀB c東", "a-b--c"]
    of = {k: np.unique(np.array([g for t in corpus(20, 28 + i) for g in plain_grams(t)], np.uint32)) for i, k in enumerate(("aa", "bb", "cc"))}
    f = langid.Filters.build(of, bits=1 << 20)
    for _, _, data, off in per_document(pa.array(texts)):
        g, go = langid.grams(data, off)
        assert [g[go[i] : go[i + 1]].tolist() for i in range(len(texts))] == [plain_grams(t) for t in texts]
        best, n, share, lead, ok = langid.decide(f, g, go)
    for i, t in enumerate(texts):
        grams = plain_grams(t)
        held = sorted(((sum(x in s for x in grams) / len(grams), -k) for k, s in enumerate(set(of[c].tolist()) for c in f.langs)), reverse=True) if grams else [(0.0, -3)] * 2
        assert n[i] == len(grams) and share[i] == pytest.approx(held[0][0], abs=0.02) and lead[i] == pytest.approx(held[0][0] - held[1][0], abs=0.02)
        if lead[i] > 0.03:
            assert best[i] == -held[0][1]
        if share[i] > langid.MIN_SHARE + 0.02 and lead[i] > langid.MIN_LEAD + 0.02:
            assert ok[i]


# Toxicity


def plain_features(t, strong, weak):
    low = t.lower()
    read = low.translate(str.maketrans("0134578@$", "oieastbas"))
    ws = [w for w in re.findall(rb"[a-z0-9\x80-\xff]+", read.encode())]
    starts = lambda w, lex: any(len(w) > n and (n, w[:n]) in lex for n in toxicity.BEGINNINGS)
    word, start = [(0, w) in strong for w in ws], [starts(w, strong) and (0, w) not in strong for w in ws]
    hit = [a or b for a, b in zip(word, start, strict=True)]
    weak_hit = [((0, w) in weak or starts(w, weak)) and not h for w, h in zip(ws, hit, strict=True)]
    you = [w.decode("utf-8", "replace") in toxicity.PRONOUNS for w in ws]
    near = [h and any(you[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i, h in enumerate(hit)]
    b, raw, per = low.encode(), t.encode(), max(len(ws), 1)
    letter = lambda x: x >= 128 or 97 <= x <= 122
    odd = sum(letter(b[i - 1]) and b[i] in b"0123456789@$*" and letter(b[i + 1]) for i in range(1, len(b) - 1))
    kinds = len({w for w, h in zip(ws, hit, strict=True) if h})
    return [math.log1p(len(ws)), sum(word) / per, sum(start) / per, math.log1p(sum(hit)), kinds, sum(near) / per, sum(you) / per, sum(65 <= x <= 90 for x in raw) / max(len(raw), 1), sum(x in b"!?" for x in b) / max(len(b), 1), odd / per, sum(weak_hit) / per, math.log1p(sum(weak_hit))]


def test_toxicity_features():
    from graphloom.llm.text import hash_of

    texts = [*corpus(40, 29, length=(1, 40)), "", "YOU are an 1d10t, you m0r*n!!", "idiotic; and you?", "ÀÉ tú h4cker$ vous", "x"]
    r = random.Random(30)
    vocab = sorted({w for t in texts[:40] for w in t.split()})
    strong = {(0, w.encode()) for w in [*r.sample(vocab, 15), "idiot", "hackers"]} | {(4, b"mor*"[:3] + b"x"), (5, b"idiot")}
    weak = {(0, w.encode()) for w in r.sample(vocab, 15)} | {(n, w.encode()[:n]) for n in (4, 6) for w in r.sample([v for v in vocab if len(v) > 6], 4)}
    units = lambda lex: np.sort(np.array([hash_of(w) ^ n for n, w in lex], np.uint64))
    got = toxicity.batch_features(pa.array(texts), units(strong), units(weak))
    assert np.allclose(got, [plain_features(t, strong, weak) for t in texts])


def test_isotonic_is_least_squares():
    r = np.random.default_rng(3)
    x = r.integers(0, 12, 60).astype(float)
    y = (r.random(60) < x / 12).astype(float)
    at, value = toxicity.isotonic(x, y)
    assert (np.diff(value) >= 0).all()
    # The solution's minimax form.
    mean = lambda a, b: y[(x >= a) & (x <= b)].mean()
    for a, v in zip(at, value, strict=True):
        assert v == pytest.approx(max(min(mean(lo, hi) for hi in at[at >= a]) for lo in at[at <= a]))


def test_trees_learn_an_interaction():
    r = np.random.default_rng(4)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    t = toxicity.Trees.fit(x[:2000], y[:2000])
    assert ((t.raw(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def test_toxicity_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    train = labels.where("doc_id % 2 = 0")
    got = toxicity.apply(docs, toxicity.fit(docs, train)).toPandas().merge(labels.where("doc_id % 2 = 1").toPandas(), on="doc_id")
    hit, said, true = (got.toxic_x & (got.toxic_y == 1)).sum(), got.toxic_x.sum(), (got.toxic_y == 1).sum()
    assert hit / said > 0.95 and hit / true > 0.75


# URL filters


def test_url_intervals(spark):
    t = lambda d: datetime(2024, 1, d)
    e = spark.createDataFrame([("ads", "b.com", "add", t(2)), ("ads", "b.com", "remove", t(4)), ("allow", "a.b.com", "add", t(3)), ("spam", "b.com/x", "add", t(1)), ("spam", "b.com", "remove", t(2))], "list_name string, pattern string, action string, at timestamp")
    caps = [("http://b.com/", 1, False, None), ("http://b.com/", 2, True, "ads"), ("http://b.com/", 4, False, None), ("https://u:p@A.b.com:80/q", 2, True, "ads"), ("https://A.b.com/q", 3, False, "allow"), ("http://b.com/x/y?z", 5, True, "spam"), ("http://b.com/xy", 5, False, None), ("http://notb.com/", 3, False, None), ("http://a.b.com/x", 3, True, "spam")]
    got = urls.evaluate(spark.createDataFrame([(i, u, t(d)) for i, (u, d, *_) in enumerate(caps)], "page_id bigint, url string, fetched_at timestamp"), e).collect()
    assert {r.page_id: (r.blocked, r.list_name) for r in got} == {i: (b, n) for i, (_, _, b, n) in enumerate(caps)}


def test_url_patterns_of_any_depth(spark):
    t = datetime(2024, 1, 1)
    deep = "l1.l2.l3.l4.l5.l6.l7.l8.l9.b.com"
    patterns = [("ads", "h.com/a/b/c/d/e"), ("allow", "h.com/a/b/c/d/e/f/g"), ("spam", deep), ("ads", "s.com/x/"), ("ads", "s.com/y/z")]
    e = spark.createDataFrame([(k, p, "add", t) for k, p in patterns], "list_name string, pattern string, action string, at timestamp")
    caps = {"http://h.com/a/b/c/d": None, "http://h.com/a/b/c/d/e": "ads", "http://h.com/a/b/c/d/e/f": "ads", "http://h.com/a/b/c/d/e/f/g/h?q": "allow", f"http://{deep}/": "spam", f"http://m.{deep}": "spam", "http://s.com/x": None, "http://s.com/x/": "ads", "http://s.com/y//z": None}
    got = urls.evaluate(spark.createDataFrame([(i, u, t) for i, u in enumerate(caps)], "page_id bigint, url string, fetched_at timestamp"), e).collect()
    assert {r.url: r.list_name for r in got} == caps


def test_url_repeats_and_ties(spark):
    t = lambda d: datetime(2024, 1, d)
    entries = [("ads", "b.com", "add", t(1)), ("ads", "b.com", "add", t(1)), ("spam", "b.com", "add", t(1)), ("spam", "b.com", "remove", t(1)), ("zzz", "b.com", "add", t(1)), ("ads", "c.com", "add", t(1)), ("allow", "c.com", "add", t(1)), ("ads", None, "add", t(1)), ("ads", "d.com", "burn", t(1))]
    e = spark.createDataFrame(entries, "list_name string, pattern string, action string, at timestamp")
    long = "http://b.com/" + "/".join(f"p{i}" for i in range(300)) + "?" + "q" * 50_000
    caps = spark.createDataFrame([(1, "http://b.com/", t(2), "x"), (1, "http://b.com/", t(2), "x"), (2, "http://c.com", t(2), "x"), (3, long, t(2), "x"), (4, "http://d.com", t(2), "x")], "page_id bigint, url string, fetched_at timestamp, `HOST` string")
    got = sorted((r.page_id, r.blocked, r.list_name, r.n_active) for r in urls.evaluate(caps, e).collect())
    assert got == [(1, True, "zzz", 2)] * 2 + [(2, False, "allow", 2), (3, True, "zzz", 2), (4, False, None, 0)]
    assert not any(r.blocked for r in urls.evaluate(caps, e.limit(0)).collect())


# Top-k


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 6000)
    texts = corpus(400, 5) + corpus(20, 6, 20)
    queries = corpus(25, 5, length=(1, 40)) + ["nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    q = spark.createDataFrame(list(enumerate(queries)), "item_id bigint, text string")
    stats = topk.statistics(docs)
    got = topk.search(topk.build(docs, stats), q, stats, 7).collect()
    tf = [Counter(words(t)) for t in texts]
    df = Counter(w for c in tf for w in c)
    mean = sum(c.total() for c in tf) / len(tf)
    want = []
    for i, t in enumerate(queries):
        score = []
        for d, c in enumerate(tf):
            s = sum(n * math.log(1 + (len(tf) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (topk.K1 + 1) / (c[w] + topk.K1 * (1 - topk.B + topk.B * c.total() / mean)) for w, n in Counter(words(t)).items() if w in c)
            if s:
                score.append((-round(s, 6), d))
        want += [(i, k + 1, d, -s) for k, (s, d) in enumerate(sorted(score)[:7])]
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got)
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)] and [r[3] for r in got] == pytest.approx([r[3] for r in sorted(want)])


def test_every_hundredth_document_is_a_query(spark, tmp_path):
    import duckdb

    texts = corpus(500, 45, 60, (1, 120)) + ["", "one word", None]
    texts[200] = texts[3]
    spark.createDataFrame([*enumerate(texts), (None, "one")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in topk.query(spark, str(tmp_path)).collect()]
    assert {r[0] for r in got} == {i for i in range(0, len(texts), 100) if texts[i]} and len(got) == topk.K * len({r[0] for r in got})
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(db.execute(topk.ORACLE).fetchall())
    assert [r[:3] for r in sorted(got)] == [r[:3] for r in want] and [r[3] for r in sorted(got)] == pytest.approx([r[3] for r in want])


def test_long_queries_are_searched_together(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 6000)
    texts = corpus(300, 8, length=(1, 120))
    texts += texts[:20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    stats = topk.statistics(docs)
    q = topk.queries_of([(i, t) for i, t in enumerate(texts) if len(set(words(t))) >= topk.WHOLE])
    kinds = {"words": np.uint64, "counts": np.uint32, "docs": np.uint32, "impacts": np.uint8, "tfs": np.uint32, "ids": np.int64, "lengths": np.uint32}
    index = topk.written(topk.build(docs.coalesce(1), stats), "index")
    shards = [topk.Shard({c: np.frombuffer(r[c], kind) for c, kind in kinds.items()}, q.vocab, stats.mean_length) for r in index.collect()]
    idf = np.linspace(0.01, 9, len(q.vocab))
    weights = [idf[w] * n for w, n in zip(q.words, q.times, strict=True)]
    assert len(shards) > 2 and len(q.ids) > 50
    want = topk.Best(len(q.ids), 7)
    for s in shards:
        for i, w in enumerate(q.words):
            want.add(i, *s.whole(w[s.size[w] > 0], weights[i][s.size[w] > 0], 7))
    for how in ((600, 8 << 20, 1 << 19, 1 << 20), (10**9, 8 << 20, 1, 1), (0, 1, 5000, 100), (600, 5000, 500, 1 << 20)):
        for name, x in zip(("PRODUCTS", "CELLS", "SCORES", "POSTINGS"), how, strict=True):
            monkeypatch.setattr(topk, name, x)
        got = topk.Best(len(q.ids), 7)
        for s in shards:
            s.together(q.words, weights, got, np.arange(len(q.ids)), 7)
        assert all(np.array_equal(a, b) for a, b in zip(want.ids + want.scores, got.ids + got.scores, strict=True))
    sent = spark.sparkContext.broadcast((q, idf, stats.mean_length))
    assert topk._searched(index.coalesce(1), sent, 7).count() == 7 * len(q.ids)  # of a task, not of each of its shards


def test_search_stops_early():
    r = np.random.default_rng(7)
    n, vocab = 4000, np.arange(1, 4, dtype=np.uint64)
    docs = [np.arange(n), r.choice(n, 40, replace=False), r.choice(n, 30, replace=False)]
    length, cells = np.full(n, 100, np.uint32), {"words": vocab, "counts": np.array([len(d) for d in docs], np.uint32)}
    tf = [np.ones(len(d)) for d in docs]
    imp = [np.ceil(topk.part(t, 100, 100.0) / ((topk.K1 + 1) / topk.LEVELS)).astype(np.uint8) for t in tf]
    cells |= {"docs": np.concatenate(docs).astype(np.uint32), "tfs": np.concatenate(tf).astype(np.uint32), "impacts": np.concatenate(imp), "ids": np.arange(n), "lengths": length}
    s = topk.Shard(cells, vocab, 100.0)
    both = len(set(docs[1]) & set(docs[2]))
    ids, score = s.best(np.arange(3), np.array([0.01, 5.0, 5.0]), max(both, 1))
    assert s.read < 0.1 * s.held and (not both or set(ids) == set(docs[1]) & set(docs[2]))


# Decontamination


def lcs_plain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@given(st.lists(st.integers(0, 5), max_size=90), st.lists(st.integers(0, 5), max_size=60))
def test_lcs(a, b):
    assert decontam.lcs(np.array(a, np.int64), np.array(b, np.int64)) == lcs_plain(a, b)


def dense(texts, known):
    rows = []
    for t in texts:
        h = decontam.hashes(t)
        for i in range(0, len(h), decontam.PASSAGE):
            row = np.zeros(decontam.WIDTH)
            row[decontam.column(h[i : i + decontam.PASSAGE], known)] = 1
            rows.append(row)
    return np.array(rows)


def test_sketch_is_of_all_passages(spark):
    texts = corpus(60, 8, length=(1, 700))
    known = decontam.known_words(np.concatenate([decontam.hashes(texts[3]), decontam.hashes(texts[9])]))
    y, df, n = decontam.sketch(spark.createDataFrame([(t,) for t in [*texts, "", None]], "text string"), known)
    t = dense(texts, known)
    assert n == len(t) and np.array_equal(df, t.sum(axis=0)) and np.allclose(y, t.T @ (t @ decontam.test_matrix()), rtol=1e-4, atol=1e-3)


def test_svd_is_that_of_numpy():
    r = np.random.default_rng(9)
    cols = r.choice(decontam.WIDTH, 300, replace=False)
    few = np.zeros((40, decontam.WIDTH))
    few[:, cols] = r.random((40, 300)) < 0.2
    t = few[r.integers(0, 40, 400)]
    got = decontam.factorised(t.T @ (t @ decontam.test_matrix().astype(float)), t.sum(axis=0), len(t))
    n, df = len(t), t.sum(axis=0)
    idf = (np.log((1 + n) / (1 + df)) + 1) ** decontam.IDF_POWER
    _, value, v = np.linalg.svd(t * idf, full_matrices=False)
    rank = int((value**2 > 1e-5 * value[0] ** 2).sum())
    want = v[:rank].T * idf[:, None] / (value[:rank] ** 2 / n) ** 0.5
    want -= df / n @ want / (df.sum() / n)
    a, b = few @ got, few @ want  # alike but for a rotation
    assert rank < decontam.RANK and np.allclose(a @ a.T, b @ b.T, rtol=1e-3, atol=1e-3 * np.abs(b @ b.T).max())


def test_words_of_a_benchmark_have_no_bound(spark, monkeypatch):
    r = random.Random(71)
    vocab = [f"v{i}x" for i in range(9000)]
    bench = [" ".join(vocab[i : i + 30]) for i in range(0, 9000, 30)] + ["four plain short words", "two words", "single"]
    docs = [(i, " ".join(r.choices(vocab, k=60)) + " " + (edited(bench[i], 0.1, r) if i < 300 else "")) for i in range(360)]
    docs += [(1000, "here are four plain short words again"), (1001, "four plain and short words"), (1002, "only two words here"), (1003, "single"), (1004, "a single word")]
    docs, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string")
    want = {(i, i) for i in range(300)} | {(1000, 300), (1002, 301), (1003, 302)}
    one = decontam.find(docs, items).collect()
    assert want == {(x.doc_id, x.item_id) for x in one}
    monkeypatch.setattr(decontam, "ITEMS_AT_ONCE", 100)  # several parts, and nothing else changes
    assert sorted(map(tuple, decontam.find(docs, items).collect())) == sorted(map(tuple, one))


def test_leaks_are_found(spark):
    r = random.Random(11)
    bench = corpus(40, 12, 3000, (15, 60))
    docs, want = [], {}
    for i, t in enumerate(corpus(400, 13, 3000, (30, 400))):
        if i % 4 == 0:
            k, at = r.randrange(40), r.randrange(len(t.split()))
            leak = bench[k] if i % 8 else edited(bench[k], 0.15, r)
            w = t.split()
            t, want[i] = " ".join(w[:at] + [leak] + w[at:]), k
        docs.append((i, t))
    got = decontam.find(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string")).collect()
    found = {(x.doc_id, x.item_id) for x in got}
    assert len(found & set(want.items())) >= 0.95 * len(want) and {d for d, _ in found} <= set(want)
    exact = {(d, k) for d, k in want.items() if d % 8}
    assert len(found & exact) >= 0.98 * len(exact)


@pytest.mark.parametrize("rate", [0, 0.2])
def test_long_items_are_found(spark, rate):
    r = random.Random(31)
    bench = [t for n in (100, 150, 155, 160, 161, 200, 300, 500, 1000) for t in corpus(2, n, 3000, (n, n))]
    bench = [" ".join(w[:-10]) + ". " + " ".join(w[-10:]) for w in map(str.split, bench)]
    docs = []
    for i, t in enumerate(corpus(3 * len(bench), 32, 3000, (200, 900))):
        w = t.split()
        at = r.randrange(len(w))
        docs.append((i, " ".join(w[:at] + [edited(bench[i], rate, r)] + w[at:]) if i < len(bench) else t))
    got = decontam.find(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(i, i) for i in range(len(bench))}


@pytest.mark.parametrize("rate", [0, 0.25])
def test_short_items_are_found(spark, rate):
    r = random.Random(41)
    bench = [t for n in range(5 + 3 * (rate > 0), 16) for t in corpus(8, 50 + n, 3000, (n, n))]
    docs, want = [], set()
    for i, t in enumerate(corpus(3 * len(bench), 42, 3000, (200, 1500))):
        w = t.split()
        if i < len(bench):
            at, leak = r.randrange(len(w)), edited(bench[i], rate, r)
            w[at:at] = leak.split()
            if lcs_plain(bench[i].split(), leak.split()) >= 0.6 * len(bench[i].split()):
                want.add((i, i))
        docs.append((i, " ".join(w)))
    got = decontam.find(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string")).collect()
    found = {(x.doc_id, x.item_id) for x in got}
    assert len(want) > 0.7 * len(bench) and want <= found
    for x in got:  # what else is found is a common subsequence of that length, by chance
        part = docs[x.doc_id][1].split()[max(x.word_at - decontam.STEP, 0) : x.word_at + 3 * max(len(bench[x.item_id].split()) // 4, 2) + 80]
        assert lcs_plain(bench[x.item_id].split(), part) >= x.lcs >= 0.6 * len(bench[x.item_id].split())


# Simple-8b

IDS = st.lists(st.one_of(st.just(0), st.integers(0, 1), st.integers(0, 1 << 17), st.integers(0, (1 << 64) - 1)), max_size=400)


@settings(deadline=None, max_examples=60)
@given(st.lists(IDS, max_size=5))
def test_simple8b_round_trip(docs):
    ids = np.array([i for d in docs for i in d], np.uint64).view(np.int64)
    off = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    w, w_off, at = simple8b.pack(ids, off)
    size = simple8b.sizes(np.diff(off))
    assert np.array_equal(simple8b.unpack(w, at, size), ids)
    for k, n in enumerate(size):  # a block alone
        end = at[k + 1] if k + 1 < len(at) else len(w)
        b = simple8b.unpack(w[at[k] : end], np.zeros(1, np.int64), np.array([n]))
        first = int(size[:k].sum())
        assert np.array_equal(b, ids[first : first + n])


def test_simple8b_packs():
    for bits, most in ((1, 60), (2, 30), (10, 6), (15, 4), (60, 1)):
        n = simple8b.BLOCK
        w, _, _ = simple8b.pack(np.full(n, (1 << bits) - 1), np.array([0, n]))
        assert len(w) == -(-n // most)


def plain_simple8b(words, n):
    """A word at a time, by the layout's definition."""
    out, i = [], 0
    while len(out) < n:
        w, s = words[i], words[i] >> 60
        if s == simple8b.ESCAPE:
            out.append(words[i + 1])
            i += 2
            continue
        width = int(simple8b.WIDTHS[s])
        out += [w >> k * width & ((1 << width) - 1) for k in range(simple8b.COUNTS[s])][: n - len(out)]
        i += 1
    return out


@settings(deadline=None, max_examples=60)
@given(IDS)
def test_simple8b_by_a_plain_decoder(doc):
    ids = np.array(doc, np.uint64).view(np.int64)
    w, _, at = simple8b.pack(ids, np.array([0, len(ids)]))
    size = simple8b.sizes(np.array([len(ids)]))
    got = [x for k, n in enumerate(size.tolist()) for x in plain_simple8b(w[at[k] :].tolist(), n)]
    assert got == doc


# Jaccard join


@pytest.mark.parametrize("light", [None, 0.0, 25.0, 1e9])
def test_jaccard_is_exact(spark, light):
    r = random.Random(14)
    texts = corpus(150, 15, 60, (1, 60))
    texts += [edited(r.choice(texts[:20]), r.choice([0, 0.03, 0.1]), r) for _ in range(150)]
    n, threshold = 2, 0.4
    sets = []
    for t in texts:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else None)
    rep = {}
    for i, s in enumerate(sets):
        rep.setdefault(s, i)
    want = {(rep[s], i, 1.0) for i, s in enumerate(sets) if s and rep[s] != i}
    for a, b in itertools.combinations([i for s, i in rep.items() if s], 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= threshold:
            want.add((a, b, round(j, 6)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {tuple(x) for x in jaccard.join(docs, n, threshold, light=light).collect()} == want


def classes_of(texts, n, threshold):
    """By comparing all pairs: the class of each document, and its number of links."""
    sets = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if (w := words(t)) else set() for t in texts]
    up, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {(i, find(i), k) for i, k in enumerate(links)}


@pytest.mark.parametrize(("light", "few"), [(None, False), (0.0, False), (1e9, False), (None, True), (0.0, True), (1e9, True)])
def test_classes_of_documents(spark, monkeypatch, light, few):
    if few:  # hot n-grams, long lists and split places from a few sets on
        for name, value in (("OFTEN", 2), ("HOT", 6), ("LIST", 5), ("VERIFIED", 40)):
            monkeypatch.setattr(jaccard, name, value)
    r = random.Random(24)
    base = corpus(30, 25, 60, (5, 60))
    texts = [edited(t, rate, r) for t in base[:8] for rate in (0.02, 0.1)]
    texts = base + base[:8] * 12 + texts * 3 + ["", None] + corpus(40, 26, 12, (5, 40))
    r.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string").repartition(3)
    got = jaccard.classes(docs, 2, 0.4, light).collect()
    assert len(got) == len(texts) and {(x.doc_id, x.class_id, x.n_links) for x in got} == classes_of(texts, 2, 0.4)


def test_no_pair_of_a_cluster_leaves_its_place(spark, monkeypatch):
    for name, value in (("LIST", 100), ("VERIFIED", 2500)):
        monkeypatch.setattr(jaccard, name, value)
    r = random.Random(34)
    texts = [edited(t, 0.1, r) for t in corpus(2, 34, 60, (60, 61)) for _ in range(200)]
    made, write = [], jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name="t": made.append(write(df, name)) or made[-1])
    got = jaccard.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 2, 0.4).collect()
    assert {(x.doc_id, x.class_id, x.n_links) for x in got} == classes_of(texts, 2, 0.4)
    assert sum(x.n_links for x in got) > 60 * len(texts) and all(t.count() < 20 * len(texts) for t in made)


def test_one_of_each_sends_no_pairs(spark, monkeypatch):
    r = random.Random(35)
    texts = [edited(t, 0.1, r) for t in corpus(2, 35, 60, (60, 61)) for _ in range(120)]
    made, write = [], jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name="t": made.append(write(df, name)) or made[-1])
    got = jaccard.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 2, 0.4)
    assert {x.doc_id for x in got.collect()} == {c for _, c, _ in classes_of(texts, 2, 0.4)}
    assert all(t.count() < 20 * len(texts) for t in made)


def test_clusters_of_one_of_each_are_sent_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST", 32)
    r = random.Random(36)
    base = corpus(2, 36, 60, (60, 61))
    texts = [edited(t, 0.05, r) for t in base for _ in range(300)] + [edited(t, 0.3, r) for t in base for _ in range(20)] + corpus(40, 37, 60, (60, 61))
    r.shuffle(texts)
    sent, keys = [], jaccard._keys
    monkeypatch.setattr(jaccard, "_keys", lambda *a: sent.append(jaccard.written(keys(*a))) or sent[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {x.doc_id for x in jaccard.one_of_each(docs, 2, 0.4).collect()} == {c for _, c, _ in classes_of(texts, 2, 0.4)}
    assert sent[0].count() < 8 * len(texts)  # 13.8 times where each part meets each other


def test_a_set_of_many_places_is_sent_in_parts(spark):
    class Sets:  # gives the function that the workers run
        sparkSession, select, mapInArrow = spark, lambda self, *_: self, lambda self, f, _: f  # noqa: N815

    tokens = np.arange(1, 2001, dtype=np.uint64)
    of = {"id": 1, "size": 2000, "copies": 1, "p1": 1000, "star": 1, "tokens": tokens.tobytes(), "homes": (tokens % 500).astype(np.uint32).tobytes(), "dfs": np.full(2000, 2, np.uint32).tobytes()}
    run = jaccard._keys(Sets(), 0.0, 1000)
    got = list(run(iter([pa.record_batch({k: pa.array([v]) for k, v in of.items()})])))
    assert sum(b.num_rows for b in got) == 500 and max(b.nbytes for b in got) < 5 << 20


def test_sets_of_many_subsets_are_heavy(spark):
    sets = spark.createDataFrame([(30, 450.0, 1e9), (300, 11325.0, 1e12)], "size bigint, subsets double, lists double")
    assert jaccard.boundary(sets) == 30


def test_pairs_that_share_a_single_n_gram(spark):
    docs = spark.createDataFrame(list(enumerate(["a b c d e", "a b c d e f", "b c d e f"])), "doc_id bigint, text string")
    assert {tuple(x) for x in jaccard.join(docs, light=1e9).collect()} == {(0, 1, 0.5), (1, 2, 0.5)}
    assert {tuple(x) for x in jaccard.classes(docs, light=1e9).collect()} == {(0, 0, 1), (1, 0, 2), (2, 0, 1)}


def test_components(spark):
    r = random.Random(16)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {x.id: x.least for x in jaccard.components(spark.createDataFrame(edges, "left_id bigint, right_id bigint")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up if find(x) != x}


# Byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.load()


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = st.text(st.one_of(st.sampled_from("aAétheing '\"\n\t  .,!0123"), st.characters(codec="utf-8")), max_size=60)


@settings(deadline=None, max_examples=150)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_bpe_equals_reference(ranks, reference, texts):
    b = bpe.worker("test", ranks)
    ids, off = b.encode(pa.array(texts))
    assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(texts))] == [reference.encode_ordinary(t) for t in texts]
    assert b.returns(pa.array(texts), ids, off).all()


@settings(deadline=None, max_examples=60)
@given(TEXTS, st.lists(st.tuples(st.integers(0, 80), st.integers(0, 10), TEXTS), max_size=4))
def test_bpe_edits(ranks, reference, text, edits):
    e = bpe.Editable(bpe.worker("test", ranks).prefixes, text)
    for at, n, new in edits:
        at = min(at, len(text))
        text = text[:at] + new + text[at + n :]
        e.replace(at, min(at + n, len(e.text)), new)
        assert e.ids == reference.encode_ordinary(text)
    e.append("s and more")
    assert e.ids == reference.encode_ordinary(text + "s and more")


def test_bpe_documents(spark, reference):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = {r.doc_id: r.token_ids for r in bpe.encoded(docs).collect()}
    assert all(got[r.doc_id] == reference.encode_ordinary(r.text) for r in docs.collect())


def test_bpe_tells_all_strings_apart(ranks, reference):
    """Strings that every polynomial hash modulo a power of two confuses."""
    morse = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    from graphloom.llm.text import hash_of

    assert hash_of(morse) != hash_of(other)
    b = bpe.Batches(ranks)
    ids, off = b.encode(pa.array([morse, other]))
    assert [ids[off[i] : off[i + 1]].tolist() for i in range(2)] == [reference.encode_ordinary(morse), reference.encode_ordinary(other)]
    assert b.returns(pa.array([morse, other]), ids, off).all()


def test_bpe_decodes(spark, reference):
    texts = ["plain", "", "œ 東京\n", "x" * 5000]
    rows = [(i, reference.encode_ordinary(t), "other") for i, t in enumerate(texts)] + [(4, None, ""), (5, [1, None], ""), (6, [-1], ""), (7, [1, 10_000_000], ""), (None, [], ""), (8, reference.encode_ordinary("東")[:1], "")]
    got = {r.doc_id: r.text for r in bpe.decoded(spark.createDataFrame(rows, "doc_id int, token_ids array<int>, `TEXT` string")).collect()}
    assert got == dict(enumerate(texts)) | dict.fromkeys((4, 5, 6, 7)) | {None: "", 8: got[8]} and "\ufffd" in got[8]
    assert bpe.decoded(spark.createDataFrame([], "doc_id bigint, token_ids array<int>")).count() == 0


# WARC


def test_warc_files_and_bytes(spark, tmp_path):
    bodies = [b"\x89PNG\xff\xfe\x00\x80" * 9, b"", "é東".encode()]
    for k in range(2):
        (tmp_path / f"{k}.warc.zst").write_bytes(warc.archive([warc.record(f"http://h/{i}", b, f"<urn:{i}>") for i, b in enumerate(bodies)] * 20))
    got = warc.read(warc.files(spark, str(tmp_path))).collect()
    assert len(got) == 120 and all(r.valid and bytes(r.payload) == bodies[int(r.record_id[5:-1])] for r in got)


def test_warc_reports_what_is_broken():
    good = [warc.record(f"http://h/{i}", f"<p>{i}</p>".encode() * 40, f"<urn:{i}>") for i in range(40)]
    data = warc.archive(good)
    assert data[:4] == warc.DICTIONARY_MAGIC
    rows = list(warc.records(data))
    assert len(rows) == 40 and all(r["valid"] for r in rows) and rows[7]["payload"] == b"<p>7</p>" * 40
    z = zstandard.ZstdCompressor()
    changed = {
        "no WARC version": b"HTTP/1.1 200\r\n\r\n",
        "the header doesn't end": b"WARC/1.1\r\nWARC-Type: resource",
        "a header line isn't a field": good[0].replace(b"WARC-Type:", b"WARC Type"),
        "no warc-date": good[0].replace(b"WARC-Date", b"WARC-Dat"),
        "unknown warc-type": good[0].replace(b"resource", b"resourcf"),
        "content-length is no number": good[0].replace(b"Content-Length: ", b"Content-Length: +"),
        "the record doesn't end with two empty lines": good[0][:-1] + b"x",
        "the block's digest differs": good[0].replace(b"<p>0", b"<p>1", 1),
        "warc-date is no UTC time": good[0].replace(b"T00:00:00Z", b"T00:00:00"),
    }
    got = list(warc.records(b"".join(z.compress(x) for x in changed.values())))
    assert [r["error"] for r in got] == list(changed)
    short = list(warc.records(z.compress(good[0][:-9] + b"\r\n\r\n")))
    assert "content-length" in short[0]["error"]
    # A damaged frame costs its record, not those that follow.
    frames = [z.compress(x) for x in good[:3]]
    frames[1] = frames[1][:6] + bytes(8) + frames[1][14:]
    got = list(warc.records(b"".join(frames)))
    assert [r["valid"] for r in got][0] and got[-1]["valid"] and got[-1]["record_id"] == "<urn:2>" and not all(r["valid"] for r in got)
    cut = list(warc.records(b"".join(frames[:1]) + frames[2][:-5]))
    assert cut[0]["valid"] and cut[-1]["error"] == "the frame is cut off"
    assert [r["error"] for r in warc.records(data[:30])] == ["the dictionary's frame is cut off"]


# LM scoring


def test_cross_entropy_difference(spark, monkeypatch):
    texts = corpus(60, 17, 50) + ["", corpus(1, 17, 50)[0]]
    good = set(range(0, 60, 3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(60)], "doc_id bigint, quality int")
    size = 30
    every = Counter(w for t in texts for w in words(t))
    top = {w for w, _ in every.most_common(size - 2)}
    least = min(every[w] for w in top)
    from graphloom.llm.text import hash_of

    signed = lambda w: int(np.array([hash_of(w)], np.uint64).view(np.int64)[0])
    top = set(sorted(every, key=lambda w: (-every[w], signed(w)))[: size - 2])
    assert least == min(every[w] for w in top)
    seqs = {i: ["|", *(w if w in top else "?" for w in words(t)), "|"] for i, t in enumerate(texts) if t}
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for i, q in seqs.items():
        for k in [0, 1] if i in good else [1]:
            uni[k].update(q[1:])
            bi[k].update(zip(q, q[1:], strict=False))
    got = {r.doc_id: r for r in crossent.score(docs, labels, size).collect()}
    for i, q in seqs.items():
        own, ctx, ce = Counter(zip(q, q[1:], strict=False)), Counter(q[:-1]), []
        for k in range(2):
            m = int(k == 1 or i in good)
            prior = {w: crossent.MU * (uni[k][w] + 1) / (uni[k].total() + size) for _, w in own}
            ce.append(-sum(n * math.log((bi[k][v, w] - m * n + prior[w]) / (uni[k][v] - m * ctx[v] + crossent.MU)) for (v, w), n in own.items()) / (len(q) - 1))
        assert (got[i].ce_target, got[i].ce_background, got[i].score) == pytest.approx((*ce, ce[0] - ce[1]), abs=2e-6)
    monkeypatch.setattr(crossent, "TARGETS_AT_ONCE", 0)  # labels are joined
    again = {r.doc_id: r.score for r in crossent.score(docs, labels, size).collect()}
    assert all(again[i] == pytest.approx(got[i].score, abs=2e-6) for i in seqs)


def test_cross_entropy_of_all_words(spark):
    r = random.Random(61)
    vocab = [f"r{i}" for i in range(80_000)]
    r.shuffle(vocab)
    texts = [" ".join(vocab[i : i + 1000] + r.choices(vocab, k=20)) for i in range(0, len(vocab), 1000)]
    texts += [" ".join(r.choices(vocab[k : k + 1000], k=300)) for k in (5000, 6000)]
    good = {i for i in range(len(texts)) if i % 2}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x for x in crossent.score(docs, spark.createDataFrame([(i, int(i in good)) for i in range(len(texts))], "doc_id bigint, quality int")).collect()}
    seqs, uni, bi = [["|", *t.split(), "|"] for t in texts], [Counter(), Counter()], [Counter(), Counter()]
    for i, q in enumerate(seqs):
        for k in [0, 1] if i in good else [1]:
            uni[k].update(q[1:])
            bi[k].update(zip(q, q[1:], strict=False))
    for i, q in enumerate(seqs):
        own, ctx, ce = Counter(zip(q, q[1:], strict=False)), Counter(q[:-1]), []
        for k in range(2):
            m = int(k == 1 or i in good)
            total = uni[k].total() + len(vocab) + 2
            ce.append(-sum(n * math.log((bi[k][v, w] - m * n + crossent.MU * (uni[k][w] + 1) / total) / (uni[k][v] - m * ctx[v] + crossent.MU)) for (v, w), n in own.items()) / (len(q) - 1))
        assert (got[i].ce_target, got[i].ce_background, got[i].score) == pytest.approx((*ce, ce[0] - ce[1]), abs=2e-6)


def test_words_match_the_pattern():
    texts = ["Don't stop ÀB-c 東京x 1_2", "", "...", "a"]
    from graphloom.llm.text import Words

    for _, _, data, off in per_document(pa.array(texts)):
        w = Words(data, off)
        assert [bytes(data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)] == [x for t in texts for x in words(t)]
