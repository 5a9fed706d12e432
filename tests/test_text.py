"""Chunking, Turtle, JSON, files, workflow, streaming."""

import hashlib
import json
import os
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom import session
from graphloom.__main__ import main
from graphloom.functions import vocab as V
from graphloom.operators import chunking
from graphloom.plans import jobs, workflow
from graphloom.plans.client import Client
from graphloom.plans.models import Rules
from graphloom.sources import files, jsonmd, turtle
from graphloom.streaming import ingest

TTL = """
@prefix v: <http://v#> .
# a comment
v:a a v:T ; v:name "one", 'two'@EN-gb, \"\"\"long "quoted"
text\"\"\" ; v:n 1, -2.5, 3e4, true ; v:d "2020-01-01"^^xsd:date .
<http://x/é> v:has [ v:in ( 1 v:b ) ] ; v:u "\\u00e9\\n" ;  .
[] v:p () .
PREFIX w: <http://w/>
w:x%20y v:q _:z , _:z .
_:z v:q w:x\\,y .
"""


def test_turtle():
    t = turtle.parse(TTL)
    assert len(t) == 19
    of = {(x[0], x[2]): x for x in t}
    assert of["http://x/é", "http://v#u"][3] == "é\n" and of["http://v#a", "http://v#d"][5] == V.XSD + "date"
    assert ("http://v#a", "iri", "http://v#name", "two", "literal", None, "en-gb") in t
    assert [x[5] for x in t if x[2] == "http://v#n"] == [V.XSD + k for k in ("integer", "decimal", "double", "boolean")]
    assert any(x[3] == "http://w/x,y" for x in t)
    again = turtle.parse(turtle.render(t))
    plain = lambda t: {x for x in t if x[1] != "bnode" and x[4] != "bnode"}
    assert plain(again) == plain(t) and len(again) == len(t)


@pytest.mark.parametrize("bad", ["v:a v:b v:c .", "<a> <b> .", "<a> <b> <c>", '<a> <b> "x .', "<a b> <c> <d> ."])
def test_turtle_refuses(bad):
    with pytest.raises(turtle.TurtleError):
        turtle.parse(bad)


LITERALS = st.tuples(st.just("http://s"), st.just("iri"), st.sampled_from(["http://p", V.LABEL]), st.text(max_size=30), st.just("literal"), st.sampled_from([None, V.XSD + "string"]), st.none())


@settings(deadline=None)
@given(st.lists(LITERALS, max_size=6))
def test_turtle_round_trip(rows):
    assert set(turtle.parse(turtle.render(rows))) == set(rows)


def test_escapes_are_latin():
    assert turtle.parse('<a> <b> "\\\\u0041é" .', escapes=True)[0][3] == "AÃ©"


def test_json_markdown():
    data = {"z": 1, "a": {"k": "x*y", "l": [], "m": [1, None, True]}, "b": [{"q": 1}, {"q": 2}], "e": {}}
    md = jsonmd.markdown(data)
    assert md.startswith("# JSON Data\n\n**z**: 1\n\n\n## a\n**k**: x-y\n\n### l\n*Empty list*\n\n### m\n- 1\n- *null*\n- true\n\n")
    assert "### Item 1\n\n**q**: 1\n" in md and md.endswith("## e\n") and jsonmd.markdown({}) == jsonmd.markdown(None) == ""


def docs_of(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc string, text string")


def sentences_of(t, pattern):
    return [p for p in (x.strip() for x in re.split(pattern, t)) if p]


@pytest.mark.parametrize("pattern", [chunking.PLAIN, chunking.MARKDOWN])
def test_sentences(spark, pattern):
    texts = ["One. Two! Three?\n\n# Head\ntext here. Extraordinary things. Émigrés", "", "a\n\n- b\n\n- c ##d", "x.  Abcdefghij y", "##\n#"]
    got = {}
    for r in chunking.sentences(docs_of(spark, texts), pattern).orderBy("doc", "ord").collect():
        got.setdefault(r.doc, []).append(r.sentence)
    assert got == {str(i): s for i, t in enumerate(texts) if (s := sentences_of(t, pattern))}


@pytest.mark.parametrize("kind", list(chunking.AMOUNTS))
def test_operators_equal_the_fold_of_one_document(spark, kind):
    r = random.Random(5)
    texts = [" ".join(f"{' '.join(r.choices(['alpha', 'beta', 'gamma', 'delta'], k=r.randint(2, 9)))}." for _ in range(n)) for n in (1, 3, 12, 40)]
    amount = {"percentile": 70.0, "gradient": 70.0, "standard_deviation": 0.5, "interquartile": 0.2}[kind]
    cfg = chunking.Chunking(kind, amount, 1, 60, 10**6, chunking.PLAIN)
    s = chunking.with_context(chunking.sentences(docs_of(spark, texts), chunking.PLAIN), 1)
    rows = s.toPandas()
    rows["embedding"] = [v.tolist() for v in chunking.hashed_vectors(rows.combined)]
    s = spark.createDataFrame(rows[["doc", "ord", "sentence", "combined", "embedding"]].astype({"ord": int}))
    d = chunking.distances(s)
    d = chunking.gradient(d) if kind == "gradient" else d
    points = chunking.breakpoints(d, chunking.thresholds(d, kind, amount), "gradient" if kind == "gradient" else "distance")
    got = {}
    for x in chunking.slices(s, points, 60).orderBy("doc", "chunk_ord").collect():
        got.setdefault(x.doc, []).append(x.text)
    assert got == {str(i): chunking.split_text(t, cfg) for i, t in enumerate(texts)}


def test_threshold_for_chunks(spark):
    d = [0.1, 0.5, 0.2, 0.9, 0.4, 0.3]
    rows = spark.createDataFrame([("d", x) for x in d], "doc string, distance double")
    for n in (0, 1, 3, 6, 9):
        y = 100 * (len(d) - min(max(n, 1), len(d))) / (len(d) - 1)
        assert chunking.threshold_for_chunks(rows, n).first().threshold == pytest.approx(np.percentile(d, y))
    with pytest.raises(ValueError, match="unknown"):
        chunking.thresholds(rows, "median")


def test_recursion():
    cfg = chunking.Chunking("percentile", 50.0, 1, 40, 200, chunking.PLAIN)
    text = " ".join(f"Sentence number {i} is about {'cats' if i % 7 < 3 else 'ships'}." for i in range(60))
    out = chunking.recursive(text, cfg)
    assert len(out) > 3 and "".join(out).replace(" ", "") == text.replace(" ", "")
    assert chunking.recursive("short", cfg) == ["short"] and chunking.recursive("", cfg) == [""] and chunking.recursive("x" * 500, cfg) == ["x" * 500]


def test_turtle_is_read_and_written_a_graph_at_a_time(spark, monkeypatch):
    assert isinstance(turtle.Parser(TTL).tokens, Iterator)  # one token is held, not all
    rows = [(f"g{g}", k, f"http://o/{g}/{n}", "iri", f"http://o/p{n % 3}", f'a "{n}" é', "literal", None, "en") for g in range(5) for k in range(2) for n in range(7 * g + 1)]
    t = spark.createDataFrame(rows, "doc string, k int, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string")
    for at_once in (3, 10_000):
        monkeypatch.setattr(turtle, "AT_ONCE", at_once)
        monkeypatch.setattr(turtle, "TEXT_AT_ONCE", at_once)
        texts = turtle.rendered(t.coalesce(1), "doc", "k")
        assert {(r.doc, r.k): r.turtle for r in texts.collect()} == {(f"g{g}", k): turtle.render([r[2:] for r in rows if r[:2] == (f"g{g}", k)]) for g in range(5) for k in range(2)}
        got = turtle.triples_of(texts.unionByName(spark.createDataFrame([("bad", 0, "<a> <b> ."), ("none", 0, None)], texts.schema)), "turtle").coalesce(1)
        assert got.columns == ["doc", "k", "triple_ord", *t.columns[2:]] and sorted(map(str, got.drop("triple_ord").collect())) == sorted(map(str, t.collect()))
        assert got.groupBy("doc", "k").agg({"triple_ord": "max"}).where("`max(triple_ord)` + 1 <> 7 * substr(doc, 2) + 1").count() == 0


def test_chunking_keeps_a_bounded_number_of_words(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000)) + " " + "x" * 5000 + " w1"
    want = chunking.Hashed().slots(text)
    monkeypatch.setattr(chunking, "_SLOTS", {})
    monkeypatch.setattr(chunking, "KEPT_WORDS", 100)
    assert chunking.Hashed().slots(text) == want and want[1] == want[-1]
    assert 0 < len(chunking._SLOTS) <= 100 and max(map(len, chunking._SLOTS)) < 100


def test_chunks_of_a_batch_leave_in_parts(spark):
    texts = [f"Text {i} is one. It has two sentences." if i % 3 else None for i in range(60)]
    conf, at_once = "spark.sql.execution.arrow.maxBytesPerBatch", chunking.AT_ONCE
    try:
        chunking.AT_ONCE = 30
        c = chunking.chunk_documents(docs_of(spark, texts).coalesce(1))
        assert sorted(r.text for r in c.collect()) == sorted(t for t in texts if t) and spark.conf.get(conf)
    finally:
        chunking.AT_ONCE = at_once


def test_chunk_documents(spark):
    c = chunking.chunk_documents(docs_of(spark, ["a. b.", None, ""]))
    assert sorted((r.doc, r.chunk_ord, r.text) for r in c.collect()) == [("0", 0, "a. b."), ("2", 0, "")]
    assert [r.start_index for r in chunking.start_indices(spark.createDataFrame([("d", 0, "abc"), ("d", 1, "de"), ("d", 2, "f")], "doc string, chunk_ord int, text string")).orderBy("chunk_ord").collect()] == [0, 3, 5]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.json").write_text(json.dumps({"text": "hello"}))
    (tmp_path / "b.json").write_text(json.dumps({"x": 1, "y": {"z": 2}, "w": []}))
    (tmp_path / "c.json").write_text(json.dumps({"x": 1}))
    (tmp_path / "d.txt").write_text('"quoted"')
    (tmp_path / "e.PDF").write_bytes(b"%PDF")
    (tmp_path / "f.md").write_text("# x")
    every = files.crawl(spark, str(tmp_path))
    assert every.count() == 6 and files.of_kind(every, (".json",), "b").count() == 1 and files.of_kind(every, (".pdf",)).count() == 0
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.status) for r in files.converted(every, lambda b: f"{len(b)} bytes").collect()}
    assert got["a.json"] == ("hello", "success") and got["b.json"][0].startswith("# JSON Data") and got["d.txt"] == ("quoted", "success")
    assert got["e.PDF"] == ("4 bytes", "success") and got["c.json"] == got["f.md"] == (None, "failed")


def test_ontologies_and_store(spark, tmp_path):
    src = tmp_path / "o"
    src.mkdir()
    (src / "x.ttl").write_text('<http://o/x#> a owl:Ontology ;\n rdfs:label "X" ; owl:versionInfo "1.2.0" . <http://o/x#A> a rdfs:Class .')
    (src / "bad.ttl").write_text("not turtle")
    store = files.FolderStore(str(tmp_path / "out"), str(src))
    heads, t = store.ontologies(spark)
    h = heads.first()
    assert (h.short_name, h.title, h.version, h.iri) == ("x", "X", "1.2.0", "http://o/x#") and t.count() == 4
    store.write_ontology(t.withColumn("short_name", files.F.lit("x")).withColumn("version", files.F.lit("1.2.0")))
    assert len(turtle.parse((tmp_path / "out/ontology_x_1.2.0.ttl").read_text())) == 4
    facts = t.limit(1).withColumn("doc", files.F.lit("https://example.com/doc/ab12/"))
    store.write_facts(facts.drop("doc"), files.F.lit("https://example.com/doc/ab12/"))
    store.write_facts(facts.drop("doc"))
    assert (tmp_path / "out/facts_ab12.ttl").exists() and (tmp_path / "out/current.ttl").exists() and (tmp_path / "out/ontology_x_1.2.0.ttl").exists()
    assert spark.read.parquet(f"{tmp_path}/out/facts").count() == 1 and spark.read.parquet(f"{tmp_path}/out/ontologies").count() == 4
    assert files.descriptions(heads.unionByName(heads)).first()[0].count("\n\n") == 1
    assert heads.select(files.described(heads)).first()[0] == "name: x\nabout: X\niri: http://o/x#"
    assert files.FolderStore("x").ontologies(spark)[1].count() == 0


def test_states(spark, tmp_path):
    ttl = "<http://a> <http://b> <http://c> ."
    for n in (2, 10):
        (tmp_path / f"run.{n}.json").write_text(json.dumps({"success_score": n, "current_chunk": {"graph": ttl}, "current_ontology": {"graph": ttl + " <http://a> <http://b> 1 ."}, "ontology_addendum": None}, indent=1))
    got = jobs.compare_runs(spark, str(tmp_path)).collect()
    assert [(r.number, r.facts, r.ontology, r.addendum, r.success_score) for r in got] == [(2, 1, 2, 0, 2.0), (10, 1, 2, 0, 10.0)]


class Stubborn(Rules):
    """Never content."""

    def criticise_ontology(self, text, addendum, visit):
        return False, 10.0, "no"

    def criticise_facts(self, text, facts, visit):
        return False, 10.0, "no"


class Broken(Rules):
    def facts(self, namespace, text, note):
        raise ValueError("unreadable")


@pytest.mark.parametrize("v", [1, 2, 3, 4])
def test_calls_are_bounded(v):
    calls = lambda log: sum(r[3] != "Sublimate Ontology" for r in log)
    log, _, _ = workflow.run_document("d", ["Alpha meets Beta."], {"o": []}, Stubborn(), v, "https://example.com")
    assert 5 <= calls(log) <= 6 * v - 1 and max(r[4] for r in log) <= v and log[-1][5] == "success"
    log, facts, _ = workflow.run_document("d", ["Alpha meets Beta."], {"o": []}, Broken(), v, "https://example.com")
    assert not facts and sum(r[3] == "Text to Facts" and r[5] == "failed" for r in log) >= v - 1


def test_workflow(spark):
    c = spark.createDataFrame([("d", 1, "Gamma sees Delta."), ("d", 0, "Alpha meets Beta."), ("e", 0, None)], "doc string, chunk_ord int, text string")
    log = workflow.run(c).toPandas()
    assert set(log.doc) == {"d", "e"} and log[log.doc == "d"].chunk_ord.is_monotonic_increasing
    assert set(log[log.doc == "d"].ontology) >= {"ontology_d"}
    facts = workflow.run(c, facts=True).toPandas()
    assert f"https://example.com/doc/d/chunk/{hashlib.sha256(b'Alpha meets Beta.').hexdigest()[:12]}/Alpha" in set(facts.s) and (facts[facts.p == V.LABEL].o_kind == "literal").all()


def test_process_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"text": "Alpha meets Beta. Beta likes Gamma."}))
    jobs.run_batch(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    t = spark.read.parquet(f"{tmp_path}/out/facts")
    name = t.select("file").distinct().collect()
    assert t.count() > 5 and len(name) == 1 and len(turtle.parse((tmp_path / "out" / name[0].file).read_text())) == t.count()
    assert "Term5" in next((tmp_path / "out").glob("ontology_ontology_*_0.0.0.ttl")).read_text()
    q = lambda: ingest.ingest(spark, str(tmp_path / "in"), f"{tmp_path}/chunks", f"{tmp_path}/check", glob="*.json").awaitTermination()
    q()
    assert spark.read.parquet(f"{tmp_path}/chunks").count() == 1
    (tmp_path / "in/b.json").write_text(json.dumps({"text": "New."}))
    q()
    got = spark.read.parquet(f"{tmp_path}/chunks").toPandas()
    assert sorted(got.text) == ["Alpha meets Beta. Beta likes Gamma.", "New."] and got.batch.nunique() == 2
    assert jobs.health() == {"status": "healthy"} and jobs.info()["name"] == "graphloom"


def test_vectors_are_the_same_everywhere():
    a, b = chunking.hashed_vectors(pd.Series(["One two", ""]))
    assert np.linalg.norm(a) == pytest.approx(1) and not b.any()


def test_words_of_one_beginning_differ():
    a, b = chunking.hashed_vectors(pd.Series(["http_example_org_some_long_word_one", "http_example_org_some_long_word_two"]))
    assert not np.array_equal(a, b)



def test_models_are_called_once_and_chunks_connected(spark, tmp_path):
    text = "Alpha meets Beta. Gamma sees Delta. Zeta likes Omega."
    docs = spark.createDataFrame([(text,), (text,), (None,)], "text string")
    at = str(tmp_path / "calls")

    class Counting(Rules):
        def facts(self, namespace, text, note):
            with open(at, "a") as f:
                f.write(namespace + "\n")
            return Rules.facts(self, namespace, text, note)

    graphs, log, added = jobs.process(docs, jobs.Config(model=Counting))
    got, steps = graphs.collect(), log.collect()
    assert added.select("short_name").distinct().count() == 1
    calls = open(at).read().splitlines()
    hid = hashlib.sha256(text.encode()).hexdigest()[:12]
    assert len(calls) == sum(r.node == "Text to Facts" for r in steps) and set(calls) == {f"https://example.com/doc/{hid}/chunk/{hid}/"}
    parts = {r.s for r in got if r.p == V.PROV + "wasQuotedFrom"}  # triples about the chunk itself are left out
    assert len(parts) == 3 and {r.o for r in got if r.p == V.PROV + "wasQuotedFrom"} == {f"https://example.com/doc/{hid}/chunk/{hid}"}


def test_answers(spark):
    rows = [("application/json; charset=utf-8", b'{"text": "Alpha meets Beta."}', None), ("text/plain", b"x", None), ("multipart/form-data", b"%PDF", "a.pdf"), ("application/json", None, None), (None, b"{}", None)]
    got = jobs.respond(spark.createDataFrame(rows, "content_type string, body binary, name string"), jobs.Config(converter=lambda b: "Gamma sees Delta.")).collect()
    assert sorted(r.code for r in got) == [200, 200, 400, 400, 500]
    ok = [json.loads(r.json) for r in got if r.code == 200]
    assert all(x["status"] == "success" and x["metadata"]["chunks_processed"] == 0 and turtle.parse(x["data"]["facts"]) and "Term5" in x["data"]["ontology"] for x in ok)
    assert {json.loads(r.json)["error_type"] for r in got if r.code != 200} == {"ContentType", "KeyError"}


def test_only_office_bytes_are_converted(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def convert(b):
        with open(seen, "a") as f:
            f.write(f"{len(b)}\n")
        return "text"

    rows = [("a.pdf", b"12345"), ("b.json", b'{"text": "x"}'), ("c.pdf", None), ("d.json", None)]
    got = {r.path: r.status for r in files.converted(spark.createDataFrame(rows, "path string, content binary"), convert).collect()}
    assert got == {"a.pdf": "success", "b.json": "success", "c.pdf": "failed", "d.json": "failed"} and open(seen).read() == "5\n"


def test_files_of_commands(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.json").write_text(json.dumps({"text": "One. Two."}))
    (src / "p.pdf").write_bytes(b"%PDF")
    main(["split-chunks", "--input-path", str(src), "--output-path", str(tmp_path / "chunks")], spark)
    assert json.loads((tmp_path / "chunks/a.json").read_text()) == {"chunks": ["One. Two."]}
    jobs.pdfs_to_markdown(spark, str(src), str(tmp_path / "md"), lambda b: f"# {len(b)}")
    assert json.loads((tmp_path / "md/p.json").read_text()) == {"text": "# 4"}
    with pytest.raises(Exception, match="not a PDF"):
        files.pdf_to_markdown(files.crawl(spark, str(src), (".json",)), str).collect()
    (src / "b.json").write_text(json.dumps({"x": 1}))
    with pytest.raises(Exception, match="neither text nor fields"):
        jobs.split_chunks(spark, str(src), str(tmp_path / "more"))
    main(["batch", "--input-path", str(src), "--working-directory", str(tmp_path / "out"), "--max-visits", "1"], spark)
    assert list((tmp_path / "out").glob("facts_*.ttl")) and spark.read.parquet(f"{tmp_path}/out/failed").count() == 2
    with pytest.raises(SystemExit):
        main(["batch", "--input-path", "x", "--working-directory", "y", "--provider", "openai"])
    assert "CriticiseFacts --> TextToFacts: failure" in jobs.diagram()


def test_states_come_back(spark, tmp_path):
    state = {"input_text": "t", "doc_hid": "ab", "files": {"a.json": "x"}, "current_chunk": {"text": "c", "hid": "h", "doc_iri": "i", "graph": "<http://a> <http://b> 1 .", "processed": True}, "chunks": [], "success_score": 7.5, "node_visits": {"Text to Facts": 2}, "max_visits": 3, "status": "success"}
    row = spark.read.schema(files.STATE).json(spark.sparkContext.parallelize([json.dumps(state)]))
    files.save_states(row, str(tmp_path))
    back = files.states(spark, str(tmp_path)).drop("file").first()
    assert back == row.first() and back.node_visits == {"Text to Facts": 2}


def test_blank_nodes_of_two_texts_stay_apart(spark):
    rows = [("<http://a> <http://b> [ <http://c> 1 ] .",), ("<http://a> <http://b> [ <http://c> 2 ] .",)]
    got = spark.createDataFrame(rows, "t string").select(files.F.explode(turtle.parsed(files.F.col("t"))).alias("x")).select("x.*").collect()
    assert len({r.s for r in got if r.s_kind == "bnode"}) == 2


def test_client():
    asked = []

    def send(url, headers, body):
        asked.append((url, headers, body["messages"][0]["content"]))
        text = body["messages"][0]["content"]
        answer = '{"success": true, "score": 80, "critique": "fine"}' if "Score" in text else " base \n" if "Name the one" in text else "```turtle\ncd:Alpha a <http://o/T> ; rdfs:label \"Alpha\" .\n```" if "states" in text else "<http://o/T> a rdfs:Class ." if "Write Turtle" in text else "no"
        return {"choices": [{"message": {"content": answer}}]}

    c = Client("ollama", "m", base_url="http://h/v1", registry={"base": [("http://o/T", "iri", V.TYPE, V.RDFS + "Class", "iri")]}, send=send)
    log, facts, added = workflow.run_document("d", ["Alpha is."], {"base": []}, c, 3, "https://example.com")
    assert [r[5] for r in log] == ["success"] * 6 and len(facts) == 2 and added[0][1] == "base" and asked[0][0] == "http://h/v1/chat/completions"
    assert "http://o/T" in asked[1][2]
    with pytest.raises(ValueError, match="isn't such an object"):
        c.summary("base")
    with pytest.raises(ValueError, match="unknown provider"):
        Client("other")
    with pytest.raises(ValueError, match="api_key"):
        Client("openai")
    Client("openai", api_key="k", base_url="http://ignored", send=send)("x")
    assert asked[-1][:2] == ("https://api.openai.com/v1/chat/completions", {"Authorization": "Bearer k"})


def test_windows_are_sums_of_sentences():
    r = random.Random(9)
    words = ["alpha", "Beta", "gamma_1", "ÉTÉ", "x"]
    for b in (0, 1, 3):
        parts = [" ".join(r.choices(words, k=r.randint(1, 6))) + r.choice(".!?") for _ in range(20)]
        e = chunking.Hashed(64)
        got = e.windows(parts, b)
        want = e.counts(["".join(parts[max(0, i - b) : i]) + parts[i] + "".join(" " + x for x in parts[i + 1 : i + 1 + b]) for i in range(len(parts))])
        assert np.array_equal(got, want)
    assert e.windows(["no end", "here"], 1) is None


def test_tables_of_a_scope(spark):
    with session.scope(spark):
        inner = session.written(spark.range(3))
        assert inner.count() == 3
        at = inner.inputFiles()[0]
    outer = session.written(spark.range(2))
    with session.scope(spark):
        session.written(spark.range(4))
    assert not os.path.exists(at[7:]) and outer.count() == 2


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        class conf:
            get = staticmethod(lambda k, d: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake)
