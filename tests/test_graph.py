"""Scenarios with known counts, and operators against plain Python on random graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import ids
from graphloom.functions import vocab as V
from graphloom.functions.similarity import lengths_allow, lcs, ratio
from graphloom.operators import entities, graph

D = V.DOMAIN
FOAF = "http://xmlns.com/foaf/0.1/"


def chunk():
    return F.concat(F.lit(f"{D}/doc/"), F.col("doc"), F.lit("/chunk/"), F.col("hid"))


def table(spark, rows):
    """rows: doc, chunk, hid, s, p, o, kind of o."""
    return spark.createDataFrame([(d, c, h, i, s, "iri", p, o, k, None, None) for i, (d, c, h, s, p, o, k) in enumerate(rows)], V.TRIPLES)


def two_chunks():
    out = []
    for c, hid in enumerate(("abc123", "def456")):
        ns = f"{D}/doc/123/chunk/{hid}/"
        out += [("123", c, hid, ns + n, V.LABEL, label, "literal") for n, label in (("person1", "John Doe"), ("person3", "Alexander Bell"), ("person2", "Jane Smith"))]
        out.append(("123", c, hid, ns + "person1", FOAF + "knows", ns + "person2", "iri"))
    return out


def test_two_chunks_connect_and_aggregate(spark):
    t = graph.connected(table(spark, two_chunks()), chunk())
    assert {(r.hid, r["count"]) for r in t.groupBy("hid").count().collect()} == {("abc123", 10), ("def456", 10)}
    assert {r.num_components for r in graph.connectivity(graph.components(t)).collect()} == {1}
    t = t.withColumn("triple_ord", F.row_number().over(graph.Window.partitionBy("hid").orderBy("s", "p", "o")).cast("bigint"))
    out = entities.aggregated(t, F.lit(f"{D}/123/"), chunk())
    assert out.count() == 22
    one = out.withColumns({"chunk_ord": F.lit(0), "hid": F.lit("x")})
    assert graph.connectivity(graph.components(one)).first().num_components == 1


def test_entities_are_not_broadcast(spark):
    t = table(spark, two_chunks())
    m = entities.numbered(entities.entity_meta(t))
    to = m.select("doc", F.col("e").alias("original"), F.col("e").alias("canonical"))
    clusters = m.select("doc", "i", F.col("i").alias("leader"))
    groups = clusters.select("doc", "leader", F.lit("x").alias("canonical"))
    for df in (m, entities.entity_edges(m), entities.entity_classes(m), entities.best_labels(m, clusters), entities.mapping(m, clusters, groups, "e"), entities.rewritten(t, to, to.hint("merge"), chunk())):  # predicates are left to Spark otherwise
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_literals_are_not_renamed(spark):
    t = table(spark, [("d", 0, "h", "http://o/x", "p", "http://o/x", "iri"), ("d", 0, "h", "http://o/x", "p", "http://o/x", "literal")])
    to = spark.createDataFrame([("d", "http://o/x", "new")], "doc string, original string, canonical string")
    got = {(r.s, r.o, r.o_kind) for r in entities.rewritten(t, to, to.where("false"), chunk()).collect()}
    assert got == {("new", "new", "iri"), ("new", "http://o/x", "literal")}


def test_split_is_a_partition(spark):
    rows = [("d", 0, "h", f"{D}/x", "p", "o", "literal"), ("d", 0, "h", "http://o/x", "p", f"{D}/y", "iri"), ("d", 0, "h", "http://o/x", "p", f"{D}/y", "literal"), ("d", 0, "h", "http://o/x", f"{D}/p", "o", "literal")]
    got = graph.split(table(spark, rows)).orderBy("triple_ord").collect()
    assert [r.is_fact for r in got] == [True, True, False, True]


def test_union_is_idempotent(spark):
    t = table(spark, two_chunks())
    assert graph.union(t, t).count() == t.count() == 8


def random_graph(seed, n=40, m=45):
    r = random.Random(seed)
    return [("d", c, f"h{c}", f"e{r.randrange(n)}", f"p{r.randrange(3)}", f"e{r.randrange(n)}", r.choice(["iri", "iri", "literal"])) for c in range(3) for _ in range(m)]


def test_components_of_random_graphs(spark):
    rows = random_graph(1) + [("long", 0, "h", f"n{i:04d}", "p", f"n{i + 1:04d}", "iri") for i in range(150)]
    got = {(r.doc, r.hid, r.e): r.component for r in graph.components(table(spark, rows)).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for d, _, h, s, _, o, k in rows:
        a = find((d, h, s))
        if k == "iri":
            b = find((d, h, o))
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x)[2] for x in up}


def test_every_graph_is_connected_after_the_hub(spark):
    t = graph.connected(table(spark, random_graph(2)), chunk())
    assert all(r.is_fully_connected for r in graph.connectivity(graph.components(t)).collect())


def test_leaders_are_greedy(spark):
    r = random.Random(3)
    rows, want = [], set()
    for d in range(12):
        n = r.randint(2, 25)
        edges = {(a, b) for a, b in itertools.combinations(range(1, n + 1), 2) if r.random() < r.choice([0.05, 0.2, 0.5])}
        rows += [(str(d), a, b) for a, b in edges]
        done = {}
        for i in range(1, n + 1):
            if i not in done:
                done[i] = i
                for j in range(i + 1, n + 1):
                    if (i, j) in edges and j not in done:
                        done[j] = i
        led = {j for j in done if done[j] != j}
        want |= {(str(d), j, done[j]) for j in done if j in led or j in {done[k] for k in led}}
    got = entities.leaders(spark.createDataFrame(rows, "doc string, i1 int, i2 int"))
    assert {tuple(x) for x in got.select("doc", "i", "leader").collect()} == want


def test_ratio():
    assert ratio("john doe", "john d.") == 80 and ratio("café_owner", "cafe_owner") == 90 and ratio("acme corporation", "acme corp") == 72
    assert ratio("", "") == 100 and ratio("", "a") == 0 and lcs("abcbdab", "bdcaba") == 4


def test_lengths_never_exclude_a_match(spark):
    r = random.Random(4)
    pairs = [("".join(r.choices("ab", k=r.randint(1, 12))), "".join(r.choices("ab", k=r.randint(1, 12)))) for _ in range(300)]
    ok = [x.ok for x in spark.createDataFrame(pairs, "a string, b string").select(lengths_allow(F.col("a"), F.col("b"), 85.0).alias("ok")).collect()]
    assert all(k or ratio(a, b) < 85 for k, (a, b) in zip(ok, pairs, strict=True))


def meta_of(spark, rows):
    return spark.createDataFrame(rows, "doc string, i int, e string, local_name string, label string, comment string, types array<string>")


@pytest.mark.parametrize("seed", range(3))
def test_entity_edges(spark, seed):
    r = random.Random(seed)
    labels = ["John Doe", "john doe", "John D.", "J. Doe", "café owner", "cafe owner", "Acme Corporation", "Acme Corporatiom", "", None]
    rows = [("d", i, f"e{i}", r.choice(["a", "A", "b", f"n{i}", f"n{i}"]), r.choice(labels), None, r.sample(["t", "u", "v"], r.randint(0, 2))) for i in range(1, 40)]
    want = set()
    for a, b in itertools.combinations(rows, 2):
        share = bool(set(a[6]) & set(b[6]))
        if (share or not a[6] or not b[6]) and (a[3].lower() == b[3].lower() or (a[4] and b[4] and ratio(a[4].lower(), b[4].lower()) >= (90 if share else 85))):
            want.add((a[1], b[1]))
    assert {(x.i1, x.i2) for x in entities.entity_edges(meta_of(spark, rows)).collect()} == want


@pytest.mark.parametrize("seed", range(2))
def test_clusters_are_those_of_all_edges(spark, seed):
    r = random.Random(10 + seed)
    labels = ["John Doe", "john doe", "John D.", "J. Doe", "café owner", "cafe owner", "Acme Corporation", "Acme Corporatiom", "", None]
    rows = [(d, i, f"e{i}", r.choice(["a", "A", f"n{i}", f"n{i}", f"n{i}"]), r.choice(labels), None, r.sample(["t", "u", "v"], r.randint(0, 2))) for d in "xy" for i in range(1, 60)]
    m = meta_of(spark, rows)
    assert sorted(entities.entity_clusters(m).select("doc", "i", "leader").collect()) == sorted(entities.leaders(entities.entity_edges(m)).select("doc", "i", "leader").collect())


def test_types_keep_namesakes_apart(spark):
    ns = f"{D}/doc/d/chunk/"
    rows = [("d", i, f"h{i}", f"{ns}h{i}/apple", V.TYPE, FOAF + t, "iri") for i, t in enumerate(("Person", "Company", "Fruit"))]
    out = entities.aggregated(table(spark, rows), F.lit(f"{D}/doc/d/"), chunk())
    assert {r.s for r in out.where(F.col("p") == V.TYPE).where("s like '%apple'").collect()} == {r[3] for r in rows}


def test_later_chunk_replaces_a_record(spark):
    rows = [("d", 0, "h", "e", V.LABEL, "one", "literal"), ("d", 0, "h", "e", V.LABEL, "two", "literal"), ("d", 1, "g", "x", "p", "e", "iri")]
    got = {r.e: r.label for r in entities.entity_meta(table(spark, rows)).collect()}
    assert got == {"e": None, "x": None}
    assert {(r.chunk_ord, r.label) for r in entities.entity_labels(table(spark, rows)).where("e = 'e'").collect()} == {(0, "two"), (1, None)}


def test_suffixes_that_collide(spark):
    rows = [("d", 1, "x"), ("d", 2, "x"), ("d", 3, "x_1"), ("d", 4, "")]
    got = entities.canonical(spark.createDataFrame(rows, "doc string, leader int, local_name string"), F.lit("n/")).collect()
    assert len({r.canonical for r in got}) == 4 and {r.canonical for r in got} >= {"n/x", "n/entity"}


def test_columns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(ids.text_hash(lit("test"))) == "9f86d081884c"
    assert one(ids.namespace(lit("http://x##"), True)) == "http://x#" and one(ids.namespace(lit("http://x/"))) == "http://x//"
    assert [one(ids.local_name(lit(x))) for x in ("http://a/b#c", "http://a/b", "abc", "http://a/")] == ["c", "b", "abc", ""]
    assert [one(ids.clean_local_name(lit(x))) for x in ("café  owner!", "__", "a-b.c")] == ["café_owner", "entity", "a-b.c"]
    assert [one(ids.facts_filename(lit(x))) for x in (f"{D}/doc/ab12/", "a/b", "x")] == ["facts_ab12.ttl", "facts_a_b.ttl", "facts_x.ttl"]
    assert one(ids.facts_filename(lit(None).cast("string"))) == "current.ttl"
    assert [one(ids.suffix(lit(x))) for x in ("a/b.tar.gz", "a.b/c", ".hidden", "x.JSON")] == [".gz", "", "", ".JSON"]
    assert [one(ids.trailing_number(lit(x))) for x in ("s/a.update.12.json", "a.json", "a.1x.json")] == [12, 0, 0]
    assert ids.recursion_limit(3) == 1000 and ids.recursion_limit(3, 50) == 1500


def test_namespaces_merge(spark):
    rows = [("g", 0, "a", "u1"), ("g", 1, "a", "u2"), ("g", 2, "b", "u1"), ("g", 3, "a", "u1"), ("h", 0, "a", "u9")]
    got = graph.merged_namespaces(spark.createDataFrame(rows, graph.NAMESPACES), {"prov": V.PROV}).collect()
    assert {(r.graph_id, r.prefix, r.uri) for r in got} == {("g", "a", "u1"), ("g", "a_1", "u2"), ("g", "b", "u1"), ("g", "prov", V.PROV), ("h", "a", "u9"), ("h", "prov", V.PROV)}
    assert {(r.iri, r.prefix) for r in graph.prefix_of(spark.createDataFrame([("u1",), ("x",)], "iri string"), spark.createDataFrame(rows, graph.NAMESPACES)).collect()} == {("u1", "a"), ("x", None)}


def test_registry_update(spark):
    t = table(spark, two_chunks())
    reg = t.where("hid = 'abc123'").withColumn("short_name", F.lit("o"))
    assert graph.updated(reg, "o", t).count() == 8
    with pytest.raises(KeyError):
        graph.updated(reg, "x", t)


def test_curies(spark):
    ns = spark.createDataFrame([("g", 0, "a", "http://a#"), ("g", 1, "ab", "http://ab/")], graph.NAMESPACES)
    rows = [("a:x a:y",), ("ab:z",), ("http://q/w",)]
    got = {r.uri: (r.full, r.local) for r in graph.normalized(spark.createDataFrame(rows, "uri string"), ns).collect()}
    assert got == {"a:x a:y": ("http://a#x http://a#y", "y"), "ab:z": ("http://ab/z", "z"), "http://q/w": ("http://q/w", "w")}
