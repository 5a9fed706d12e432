"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import pytest

from graphloom.llm import bpe, crossent, decontam, jaccard, langid, simple8b, topk, toxicity, urls, warc

LONG = "lorem ipsum dolor sit amet consectetur " * 30_000
WORDS = "the quick brown fox jumps over the lazy dog while seven other foxes look on and wonder what it is that makes it jump so high"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `TEXT` string, `key` int, size string, word string"


def rows():
    text = [None, "", "   \n", WORDS, WORDS, WORDS.upper() + "!", LONG, "e" * 40_000, "ÀÉÎ œuvre 東京 🙂", "x"]
    out = [(i, t, "en", "s", len(t or ""), "other", i, "7", None) for i, t in enumerate(text)]
    return out + [out[3], (None, WORDS, None, None, None, None, None, None, None), (None,) * 9]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0, "x"), (3, 0, 1, "x"), (5, 1, None, "x"), (None, 1, 1, "x"), (99, 1, 1, "x"), (8, 0, 0, "x")], "doc_id bigint, quality int, toxic int, text string")


def test_language_id(docs, none):
    got = langid.identify(docs).collect()
    assert len(got) == 13
    assert all(not r.accepted and r.lang_pred is None for r in got if r.doc_id in (0, 1, 2))
    assert langid.identify(none).count() == 0
    assert langid.accepted(docs, langid.fit(none)).count() == 0
    assert langid.accepted(docs, langid.fit(docs)).columns == docs.columns


def test_toxicity(docs, none, labels):
    m = toxicity.fit(docs, labels)
    got = toxicity.apply(docs, m).collect()
    assert len(got) == 13 and all(0 <= r.toxicity <= 1 for r in got)
    assert toxicity.apply(none, toxicity.fit(none, labels)).count() == 0
    assert {r.toxicity for r in toxicity.apply(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.clean(docs, toxicity.fit(none, labels)).columns == docs.columns


def test_jaccard(docs, none):
    got = {(r.left_id, r.right_id): r.jaccard for r in jaccard.join(docs).collect()}
    assert got == {(3, 4): 1.0, (3, 5): 1.0}
    assert jaccard.join(none).count() == 0 and jaccard.classes(none).count() == 0
    assert {tuple(r) for r in jaccard.classes(docs).collect()} == {(i, 3 if i in (4, 5) else i, 2 if i in (3, 4, 5) else 0) for i in range(10)}
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 6, 7, 8, 9] and ids.count(None) == 2


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, WORDS, 0), (1, "zzz", 1), (2, None, 0), (None, WORDS, 0), (3, "", 0), (4, "too short", 0)], "item_id bigint, text string, lcs int")
    got = decontam.find(docs, bench).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in got) == [(-1, 1), (3, 1), (3, 1), (4, 1), (5, 1)]
    assert all(r.lcs_share == 1 and r.word_at == 0 for r in got)
    assert decontam.find(none, bench).count() == 0 and decontam.find(docs, bench.limit(0)).count() == 0
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == 8


def test_bpe_and_simple8b(docs, none):
    a = {r.doc_id: r for r in bpe.encoded(docs).collect()}
    b = {r.doc_id: r for r in simple8b.documents(docs).collect()}
    assert all(r.round_trip for r in [*a.values(), *b.values()]) and len(a) == len(b) == 11
    assert a[0].n_tokens == a[1].n_tokens == b[0].n_tokens == 0 and not b[0].words and not b[0].block_offsets
    back = {r.doc_id: r.token_ids for r in simple8b.unpacked(simple8b.documents(docs)).collect()}
    assert all(back[i] == list(a[i].token_ids) for i in a if i is not None)
    assert bpe.encoded(none).count() == simple8b.documents(none).count() == 0


def test_simple8b_nulls(spark):
    ids = spark.createDataFrame([(1, [1, None]), (2, None), (3, []), (4, [-1, 5, 1 << 61])], "doc_id int, token_ids array<bigint>")
    packed = simple8b.packed(ids)
    assert {r.doc_id: r.n_words for r in packed.collect()} == {1: None, 2: None, 3: 0, 4: 5}
    assert {r.doc_id: r.token_ids for r in simple8b.unpacked(packed).collect()} == {1: None, 2: None, 3: [], 4: [-1, 5, 1 << 61]}


def test_cross_entropy(docs, none, labels):
    got = crossent.score(docs, labels).collect()
    assert len(got) == 13
    assert all(r.score is None and r.n_tokens == 0 for r in got if r.doc_id in (0, 1, 2))
    assert all(r.score is not None for r in got if r.doc_id in (3, 6, 8))
    assert crossent.score(none, labels).count() == 0
    assert crossent.score(docs, labels.limit(0)).count() == 13


def test_top_k(spark, docs, none):
    q = spark.createDataFrame([(1, "fox dog", 0), (2, "nothing here", 0), (3, None, 0), (None, "fox", 0), (4, "fox", 1), (4, "zzz", 1)], "item_id bigint, text string, score int")
    stats = topk.statistics(docs)
    got = topk.search(topk.build(docs, stats), q, stats, 3).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in got) == [(1, 1, 3), (1, 2, 3), (1, 3, 4), (4, 1, 3), (4, 2, 3), (4, 3, 4)]
    stats = topk.statistics(none)
    assert topk.search(topk.build(none, stats), q, stats).count() == 0


def test_urls(spark):
    at = "timestamp'2024-01-01 00:00:00'"
    none = spark.sql(f"select cast(null as bigint) page_id, cast(null as string) url, {at} fetched_at, 'x' pattern")
    caps = none.unionByName(spark.sql(f"select bigint(1) page_id, 'no url' url, {at} fetched_at, 'x' pattern")).unionByName(spark.sql("select bigint(2) page_id, 'http://a.b' url, cast(null as timestamp) fetched_at, 'x' pattern"))
    entries = spark.sql("select 'l' list_name, 'a.b' pattern, 'add' action, cast(null as timestamp) at")
    assert [(r.blocked, r.n_active) for r in urls.evaluate(caps, entries).collect()] == [(False, 0)] * 3
    assert urls.evaluate(caps.limit(0), entries).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>é"), (2, None, None), (None, "http://b\r\nc", "x" * 3_000_000), (1, "http://a", "<p>é")], "page_id int, url string, html string")
    got = warc.read(warc.write(pages)).collect()
    assert len(got) == 4 and all(r.valid for r in got)
    assert sorted((r.record_id, r.target_uri or "", len(r.payload)) for r in got) == [("<urn:page:1>", "http://a", 5)] * 2 + [("<urn:page:2>", "", 0), ("<urn:page:>", "http://b c", 3_000_000)]
    assert warc.read(warc.write(pages.limit(0))).count() == 0
    odd = spark.createDataFrame([("a", None), ("b", b""), ("c", b"no archive")], "path string, content binary")
    assert sorted((r.archive, r.valid) for r in warc.read(odd).collect()) == [("a", False), ("c", False)]
