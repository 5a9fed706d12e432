"""Entities and predicates across the chunks of a document: metadata, similarity, clusters, canonical IRIs, the aggregated graph.

Order: an entity comes where it is first seen: by chunk, those with a label or comment first, then by triple, subject before
object, then by IRI. Of a value that is given repeatedly the last counts; of chunks the last that has the entity, nulls included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import ids
from graphloom.functions.similarity import lengths_allow, ratio_of
from graphloom.functions.vocab import COMMENT, DOMAIN_OF, LABEL, PROPERTY, PROV, RANGE, TRIPLE, TYPE
from graphloom.session import written

#: Least similarity of labels, and of those of entities that share a type.
SIMILAR, STRICT = 85.0, 90.0


def apart(df: DataFrame) -> DataFrame:
    """df as a side of a join that isn't broadcast. Spark would go by the bytes of files, where names and numbers take a tenth of what their rows do, and put many
    such tables together in the driver's memory; they grow with the entities."""
    return df.hint("merge")


def entity_labels(triples: DataFrame) -> DataFrame:
    """A row for each entity of each chunk: local name, label, comment, and first, its place in the chunk."""
    named = triples.where("s_kind = 'iri' and o_kind = 'literal'").where(F.col("p").isin(LABEL, COMMENT))
    last = lambda p: F.max_by(F.when(F.col("p") == p, F.col("o")), F.when(F.col("p") == p, F.col("triple_ord")))
    of = named.groupBy("doc", "chunk_ord", F.col("s").alias("e")).agg(last(LABEL).alias("label"), last(COMMENT).alias("comment"), F.min("triple_ord").alias("named_at"))
    seen = triples.select("doc", "chunk_ord", "triple_ord", F.explode(F.array(F.struct(F.col("s").alias("e"), F.col("s_kind").alias("kind"), F.lit(0).alias("pos")), F.struct(F.col("o").alias("e"), F.col("o_kind").alias("kind"), F.lit(1).alias("pos")))).alias("x"))
    seen = seen.where("x.kind = 'iri'").groupBy("doc", "chunk_ord", F.col("x.e").alias("e")).agg(F.min(F.struct("triple_ord", F.col("x.pos").alias("pos"))).alias("at"))
    out = seen.join(apart(of), ["doc", "chunk_ord", "e"], "left")
    first = F.struct(F.when(F.col("named_at").isNull(), F.lit(1)).otherwise(0).alias("pass"), F.coalesce("named_at", "at.triple_ord").alias("at"), F.when(F.col("named_at").isNull(), F.col("at.pos")).otherwise(0).alias("pos"))
    return out.select("doc", "chunk_ord", "e", ids.local_name("e").alias("local_name"), "label", "comment", first.alias("first"))


def entity_types(triples: DataFrame) -> DataFrame:
    """Types of each subject over all chunks, sorted."""
    t = triples.where((F.col("p") == TYPE) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri"))
    return t.groupBy("doc", F.col("s").alias("e")).agg(F.array_sort(F.collect_set("o")).alias("types"))


def entity_meta(triples: DataFrame) -> DataFrame:
    """A row for each entity of each document: the last chunk's record, the place of the first, the types."""
    of = entity_labels(triples).groupBy("doc", "e").agg(F.max_by(F.struct("local_name", "label", "comment"), "chunk_ord").alias("m"), F.min(F.struct("chunk_ord", "first.pass", "first.at", "first.pos", "e")).alias("ord"))
    none = F.array().cast("array<string>")
    return of.join(apart(entity_types(triples)), ["doc", "e"], "left").select("doc", "e", "m.*", "ord", F.coalesce("types", none).alias("types"))


def numbered(rows: DataFrame) -> DataFrame:
    """ord as a number within the document."""
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("doc").orderBy("ord"))).drop("ord")


def _sides(rows: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select(*(F.col(c).alias(f"{c}{side}") if c != "doc" else F.col(c) for c in ("doc", *cols))) for side in "12")


def similar_labels(rows: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """Pairs l1 <= l2 of distinct lower-cased labels of a document, with their similarity, from the threshold on. Lengths block first."""
    labels = rows.select("doc", F.lower("label").alias("l")).where("l <> ''").distinct()
    # A label meets those of its length or up to a bound longer; the join is on the length, so it isn't a product.
    longest = F.floor(F.length("l") * (200 - threshold) / threshold + 1e-6)
    a = labels.select("doc", F.col("l").alias("x"), F.explode(F.sequence(F.length("l").cast("long"), longest)).alias("n"))
    b = labels.select("doc", F.col("l").alias("y"), F.length("l").cast("long").alias("n"))
    pairs = a.join(apart(b), ["doc", "n"]).where((F.length("x") < F.length("y")) | (F.col("x") <= F.col("y"))).where(lengths_allow(F.col("x"), F.col("y"), threshold))
    return pairs.select("doc", F.least("x", "y").alias("l1"), F.greatest("x", "y").alias("l2"), ratio_of(F.col("x"), F.col("y")).alias("ratio")).where(F.col("ratio") >= threshold)


def _candidates(rows: DataFrame, cols: list[str], threshold: float) -> DataFrame:
    """Pairs i1 < i2 that share a lower-cased local name, or whose labels are similar (ratio)."""
    rows = rows.withColumn("name", F.lower("local_name")).withColumn("l", F.lower("label"))
    a, b = _sides(rows, "i", "name", "l", *cols)
    same = a.join(apart(b), (a.doc == b.doc) & (a.name1 == b.name2) & (a.i1 < b.i2)).drop(b.doc).withColumn("ratio", F.lit(None).cast("double"))
    near = _near(a, b, _both_ways(similar_labels(rows, threshold)), [])
    return same.unionByName(near.select(same.columns)).where("ratio is null or name1 <> name2")


def _both_ways(labels: DataFrame) -> DataFrame:
    return labels.unionByName(labels.where("l1 <> l2").select("doc", F.col("l2").alias("l1"), F.col("l1").alias("l2"), "ratio"))


def _near(a: DataFrame, b: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """Pairs i1 < i2 with similar labels, and equal in what else is given."""
    near = a.join(apart(labels.withColumnRenamed("l1", "x1")), (a.doc == labels.doc) & (F.col("l1") == F.col("x1"))).drop(labels.doc)
    other = b.withColumnsRenamed({"doc": "d2", **{c: f"{c}_2" for c in on}})
    return near.withColumnRenamed("l2", "x2").join(apart(other), [F.col("doc") == F.col("d2"), F.col("l2") == F.col("x2"), F.col("i1") < F.col("i2"), *(F.col(c) == F.col(f"{c}_2") for c in on)]).drop("d2", "x1", "x2", *(f"{c}_2" for c in on))


def entity_edges(meta: DataFrame, similar: float = SIMILAR, strict: float = STRICT) -> DataFrame:
    """Pairs i1 < i2 of entities that are alike: their types don't conflict and their names are the same, or the labels similar, more so if they
    share a type. Types are part of the join's key, so what they keep apart never meets."""
    rows = meta.select("doc", "i", F.lower("local_name").alias("name"), F.lower("label").alias("l"), F.when(F.size("types") > 0, F.col("types")).otherwise(F.array(F.lit(""))).alias("t"))
    typed = rows.select("doc", "i", "name", "l", F.explode("t").alias("t"))
    bare = rows.where(F.col("t")[0] == "").select("doc", "i", "name", "l")
    labels = _both_ways(similar_labels(meta, min(similar, strict)))
    found = []
    # With a type in common; one without types with any other.
    for left, right, on, least in ((typed.where("t <> ''"), typed.where("t <> ''"), ["t"], strict), (bare, rows.drop("t"), [], similar), (rows.drop("t"), bare, [], similar)):
        a = left.select("doc", *on, *(F.col(c).alias(f"{c}1") for c in ("i", "name", "l")))
        b = right.select("doc", *on, *(F.col(c).alias(f"{c}2") for c in ("i", "name", "l")))
        same = a.withColumn("name", F.col("name1")).join(apart(b.withColumn("name", F.col("name2"))), ["doc", "name", *on]).where("i1 < i2")
        found += [same.select("doc", "i1", "i2"), _near(a, b, labels.where(F.col("ratio") >= least), on).select("doc", "i1", "i2")]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def entity_classes(meta: DataFrame) -> DataFrame:
    """doc, i, rep: entities that have every edge in common stand for one another, the first of them for all. These share their types and name, or,
    where a name occurs once, types and label."""
    rows = meta.select("doc", "i", F.lower("local_name").alias("name"), F.nullif(F.lower("label"), F.lit("")).alias("l"), F.array_sort("types").alias("t"))
    name = F.when(F.count("*").over(Window.partitionBy("doc", "name")) > 1, F.col("name"))
    rows = rows.withColumn("shared", name).withColumn("own", F.when(F.col("shared").isNull() & F.col("l").isNull(), F.col("i")))
    first = rows.groupBy("doc", "shared", "l", "t", "own").agg(F.min("i").alias("rep"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("shared", "l", "own")]
    return rows.alias("a").join(apart(first.alias("b")), [F.col("a.doc") == F.col("b.doc"), F.col("a.t") == F.col("b.t"), *same]).select("a.doc", "i", "rep")


def entity_clusters(meta: DataFrame, similar: float = SIMILAR, strict: float = STRICT) -> DataFrame:
    """leaders() of the edges of all entities, found by those of one entity of each class: copies make no pairs."""
    of = written(entity_classes(meta), "entity-classes")
    reps = meta.join(apart(of.where("i = rep").select("doc", "i")), ["doc", "i"], "left_semi")
    led = leaders(entity_edges(reps, similar, strict)).withColumnsRenamed({"i": "rep"})
    many = of.groupBy("doc", "rep").agg(F.count("*").alias("n"))
    out = of.join(apart(many), ["doc", "rep"]).join(apart(led), ["doc", "rep"], "left").where("leader is not null or n > 1")
    return out.select("doc", "i", F.coalesce("leader", "rep").alias("leader"))


def predicate_info(triples: DataFrame) -> DataFrame:
    """A row for each predicate of each chunk: label, comment (literals), domain, range, whether it is declared a property."""
    used = triples.groupBy("doc", "chunk_ord", F.col("p").alias("pred")).agg(F.min("triple_ord").alias("at"))
    m = triples.select("doc", "chunk_ord", F.col("s").alias("pred"), "p", "o", "o_kind", "triple_ord")
    last = lambda p, ok: F.max_by(F.when((F.col("p") == p) & ok, F.col("o")), F.when((F.col("p") == p) & ok, F.col("triple_ord")))
    lit, any_ = F.col("o_kind") == "literal", F.lit(True)
    return used.join(apart(m), ["doc", "chunk_ord", "pred"], "left").groupBy("doc", "chunk_ord", "pred", "at").agg(
        last(LABEL, lit).alias("label"),
        last(COMMENT, lit).alias("comment"),
        last(DOMAIN_OF, any_).alias("domain"),
        last(RANGE, any_).alias("range"),
        F.coalesce(F.bool_or((F.col("p") == TYPE) & (F.col("o") == PROPERTY)), F.lit(False)).alias("is_explicit"),
    )


def _longest(c: str, order: Column) -> Column:
    """The longest value, of equals the first."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.length(c), -order))).alias(c)


def predicate_meta(info: DataFrame) -> DataFrame:
    """Over all chunks: of each field the longest value, the first of equals; explicit if it is so anywhere."""
    order = F.col("chunk_ord").cast("long")
    out = info.groupBy("doc", "pred").agg(*(_longest(c, order) for c in ("label", "comment", "domain", "range")), F.bool_or("is_explicit").alias("is_explicit"), F.min(F.struct("chunk_ord", "at", "pred")).alias("ord"))
    return out.withColumn("local_name", ids.local_name("pred"))


def predicate_edges(meta: DataFrame, similar: float = SIMILAR) -> DataFrame:
    c = _candidates(meta, ["domain", "range"], similar)
    fits = lambda x: F.col(f"{x}1").isNull() | F.col(f"{x}2").isNull() | (F.col(f"{x}1") == F.col(f"{x}2"))
    return c.where(fits("domain") & fits("range")).select("doc", "i1", "i2").distinct()


def leaders(edges: DataFrame) -> DataFrame:
    """Greedy clusters: doc, i, leader of every node that leads or is led. A node leads if no lesser neighbour does; one that doesn't
    belongs to its least neighbour that leads. In rounds: what has no lesser undecided neighbour leads, and its
    greater neighbours don't. Members aren't compared with each other, so these aren't components."""
    edges = written(edges, "similar")
    open_ = edges.select("doc", F.col("i1").alias("i")).unionByName(edges.select("doc", F.col("i2").alias("i"))).distinct()
    todo, lead = edges, None
    while open_.limit(1).count():
        now = written(open_.join(apart(todo.select("doc", F.col("i2").alias("i")).distinct()), ["doc", "i"], "left_anti"), "leaders")
        lead = now if lead is None else lead.unionByName(now)
        claimed = edges.join(apart(now.withColumnRenamed("i", "i1")), ["doc", "i1"], "left_semi").select("doc", F.col("i2").alias("i"))
        decided = now.unionByName(claimed).distinct()
        open_ = written(open_.join(apart(decided), ["doc", "i"], "left_anti"), "undecided")
        for side in ("i1", "i2"):
            todo = todo.join(apart(open_.withColumnRenamed("i", side)), ["doc", side], "left_semi")
        todo = written(todo.select("doc", "i1", "i2"), "undecided-edges")
    lead = open_ if lead is None else lead
    led = edges.join(apart(lead.withColumnRenamed("i", "i1")), ["doc", "i1"], "left_semi").groupBy("doc", F.col("i2").alias("i")).agg(F.min("i1").alias("leader"))
    heads = led.select("doc", F.col("leader").alias("i")).distinct()
    return heads.withColumn("leader", F.col("i")).unionByName(led)


def best_labels(meta: DataFrame, clusters: DataFrame) -> DataFrame:
    """Of each cluster: the local name and label of the member with the longest label, of equals the first."""
    order = F.col("i").cast("long")
    rank = F.struct(F.coalesce(F.length("label"), F.lit(0)), -order)
    m = meta.join(apart(clusters), ["doc", "i"])
    return m.groupBy("doc", "leader").agg(F.max_by("local_name", rank).alias("local_name"), F.nullif(F.max_by(F.coalesce("label", F.lit("")), rank), F.lit("")).alias("label"), F.array_distinct(F.flatten(F.collect_list("types"))).alias("types"))


def most_complete(meta: DataFrame, clusters: DataFrame) -> DataFrame:
    """Of each cluster of predicates: the local name of the member with most fields set, and the longest value of each."""
    order = F.col("i").cast("long")
    filled = sum((F.coalesce(F.col(c), F.lit("")) != "").cast("int") for c in ("label", "comment", "domain", "range"))
    m = meta.join(apart(clusters), ["doc", "i"])
    return m.groupBy("doc", "leader").agg(F.max_by("local_name", F.struct(filled, -order)).alias("local_name"), *(_longest(c, order) for c in ("label", "comment", "domain", "range")), F.bool_or("is_explicit").alias("is_explicit"))


def canonical(groups: DataFrame, doc_ns: Column) -> DataFrame:
    """canonical: the namespace and clean name; the second group of one name gets _1, and so on. Names that such a suffix makes and another group has
    by itself are suffixed again until all are different."""
    out = groups.withColumn("base", F.concat(doc_ns, ids.clean_local_name("local_name")))
    of = Window.partitionBy("doc", "base").orderBy("leader")
    out = out.withColumn("n", F.row_number().over(of) - 1).withColumn("canonical", F.when(F.col("n") > 0, F.concat("base", F.lit("_"), F.col("n").cast("string"))).otherwise(F.col("base")))
    while True:
        again = Window.partitionBy("doc", "canonical").orderBy("leader")
        out = out.withColumn("k", F.row_number().over(again) - 1)
        if not out.where("k > 0").limit(1).count():
            return out.drop("n", "k", "base")
        out = written(out.withColumn("canonical", F.when(F.col("k") > 0, F.concat("canonical", F.lit("_"), F.col("k").cast("string"))).otherwise(F.col("canonical"))).drop("k"), "canonical")


def mapping(meta: DataFrame, clusters: DataFrame, named: DataFrame, key: str) -> DataFrame:
    return clusters.join(apart(named.select("doc", "leader", "canonical")), ["doc", "leader"]).join(apart(meta.select("doc", "i", F.col(key).alias("original"))), ["doc", "i"]).select("doc", "original", "canonical")


def rewritten(triples: DataFrame, entities: DataFrame, predicates: DataFrame, chunk: Column) -> DataFrame:
    """Terms by their canonical IRIs; literals stay, and triples about the chunk itself go."""
    e, p = entities, predicates
    t = triples.withColumn("chunk", chunk).where("s <> chunk")
    t = t.join(apart(e.select("doc", F.col("original").alias("s"), F.col("canonical").alias("s2"))), ["doc", "s"], "left")
    t = t.join(p.select("doc", F.col("original").alias("p"), F.col("canonical").alias("p2")), ["doc", "p"], "left")
    # By what stands there, literals too: as nulls all of a document's would meet in one task.
    t = t.join(apart(e.select("doc", F.col("original").alias("o"), F.lit("iri").alias("o_kind"), F.col("canonical").alias("o2"))), ["doc", "o", "o_kind"], "left")
    return t.select("doc", "chunk_ord", "chunk", F.coalesce("s2", "s").alias("s"), "s_kind", F.coalesce("p2", "p").alias("p"), F.coalesce("o2", "o").alias("o"), "o_kind", "o_dt", "o_lang")


def _rows(doc: str, s: Column, p: Column | str, o: Column, kind: str, df: DataFrame) -> DataFrame:
    p = F.lit(p) if isinstance(p, str) else p
    none = F.lit(None).cast("string")
    return df.select(doc, s.alias("s"), F.lit("iri").alias("s_kind"), p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), none.alias("o_dt"), none.alias("o_lang")).where("s is not null and o is not null")


def lineage(new: DataFrame, chunks: DataFrame, doc_ns: Column) -> DataFrame:
    """Each chunk is an entity and a part of its document; what stands as a subject in the document's namespace was made from its chunk."""
    rows = [_rows("doc", F.col("chunk"), TYPE, F.lit(PROV + "Entity"), "iri", chunks), _rows("doc", F.col("chunk"), PROV + "wasPartOf", F.regexp_replace(doc_ns, "[#/]+$", ""), "iri", chunks)]
    made = new.where("s_kind = 'iri'").where(F.startswith(F.col("s"), doc_ns))
    return rows[0].unionByName(rows[1]).unionByName(_rows("doc", F.col("s"), PROV + "wasGeneratedBy", F.col("chunk"), "iri", made)).distinct()


def aggregated(triples: DataFrame, doc_ns: Column, chunk: Column) -> DataFrame:
    """One graph for each document out of those of its chunks. doc_ns (with its '/') and chunk are expressions over the keys doc and hid."""
    meta = written(numbered(entity_meta(triples)), "entities")
    pmeta = written(numbered(predicate_meta(predicate_info(triples))), "predicates")
    ec, pc = entity_clusters(meta), leaders(predicate_edges(pmeta))
    groups = written(canonical(best_labels(meta, ec), doc_ns), "entity-groups")
    pgroups = written(canonical(most_complete(pmeta, pc), doc_ns), "predicate-groups")
    em, pm = written(mapping(meta, ec, groups, "e"), "entity-map"), written(mapping(pmeta, pc, pgroups, "pred"), "predicate-map")
    new = rewritten(triples, em, pm, chunk)
    chunks = triples.withColumn("chunk", chunk).select("doc", "chunk").distinct()
    alone = meta.join(apart(em.select("doc", F.col("original").alias("e"))), ["doc", "e"], "left_anti")
    palone = pmeta.join(apart(pm.select("doc", F.col("original").alias("pred"))), ["doc", "pred"], "left_anti").where(F.startswith(F.col("pred"), doc_ns))
    pall = pgroups.select("doc", F.col("canonical").alias("pred"), "label", "comment", "domain", "range", "is_explicit").unionByName(palone.select("doc", "pred", "label", "comment", "domain", "range", "is_explicit"))
    set_ = lambda c: F.nullif(F.col(c), F.lit(""))
    parts = [
        _rows("doc", F.col("canonical"), LABEL, set_("label"), "literal", groups),
        _rows("doc", F.col("canonical"), TYPE, F.col("t"), "iri", groups.withColumn("t", F.explode("types"))),
        _rows("doc", F.col("e"), LABEL, F.col("label"), "literal", alone),
        _rows("doc", F.col("e"), TYPE, F.col("t"), "iri", alone.withColumn("t", F.explode("types"))),
        _rows("doc", F.col("pred"), LABEL, set_("label"), "literal", pall),
        _rows("doc", F.col("pred"), COMMENT, set_("comment"), "literal", pall),
        _rows("doc", F.col("pred"), DOMAIN_OF, set_("domain"), "iri", pall),
        _rows("doc", F.col("pred"), RANGE, set_("range"), "iri", pall),
        _rows("doc", F.col("pred"), TYPE, F.lit(PROPERTY), "iri", pall.where("is_explicit")),
        lineage(new, chunks, doc_ns),
        new.select("doc", *TRIPLE),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.dropDuplicates(["doc", *TRIPLE])
