"""The pipeline's stages: each keeps the columns and the clean documents, and does what its operator decides."""

import random

import corpus_pipeline as p
from graphloom.llm import bpe, decontam, jaccard, langid, toxicity

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    r = random.Random(1)
    rows = {x.doc_id: x for x in docs.collect()}
    some = r.sample([x for x in rows.values() if 100 < len(x.text.split()) < 800], 12)
    near = []
    for k, x in enumerate(some):
        w = x.text.split(" ")
        for _ in range(max(1, len(w) // 50)):
            w[r.randrange(len(w))] = "changed"
        near.append((10_000 + k, " ".join(w), x.lang, x.source, x.n_chars))
    near.append((20_000, some[0].text + " " + bench.first().text, "en", "s", 1))
    docs = docs.unionByName(spark.createDataFrame(near, docs.schema))
    cur = docs
    for name, stage in p.STAGES:
        out = stage(spark, cur, SF)
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
        ids, kept = {x.doc_id for x in cur.select("doc_id").collect()}, {x.doc_id for x in out.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.75 * len(ids)
        if name == "language_id":
            assert kept == {x.doc_id for x in langid.identify(cur).where("accepted").collect()}
        elif name == "toxicity":
            m = toxicity.fit(cur, spark.read.parquet(f"{SF}/labels.parquet"))
            assert kept == {x.doc_id for x in toxicity.apply(cur, m).where("not toxic").collect()}
        elif name == "near_duplicates":
            up = {i: i for i in ids}

            def find(x, up=up):
                while up[x] != x:
                    x = up[x]
                return x

            for x in jaccard.join(cur).collect():
                a, b = find(x.left_id), find(x.right_id)
                up[max(a, b)] = min(a, b)
            assert kept == {i for i in ids if find(i) == i}
            assert not {i for i in kept if 10_000 <= i < 20_000 and some[i - 10_000].doc_id in ids}
        elif name == "decontamination":
            assert kept == ids - {x.doc_id for x in decontam.find(cur, bench).collect()}
            assert 20_000 not in kept
        else:
            assert kept == ids and all(x.round_trip for x in out.collect())
        cur = spark.createDataFrame(out.collect(), out.schema)
    assert {x.doc_id for x in bpe.encoded(cur.selectExpr("doc_id", "'x' as text")).collect()} == kept


def test_run(spark):
    assert p.run(spark, "/root/testdata/sf0.001").count() > 100
