"""Graphs as rows of triples: set operations, the split of facts and ontology, namespaces, connectivity, validation.

A graph is a set: what makes one ends in dropDuplicates over the term columns and its keys. Keys (doc, chunk) are columns, so every operator
works on all graphs of a table at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import ids
from graphloom.functions.vocab import COMMENT, DOMAIN, DOMAIN_OF, LABEL, NO_IRI, NO_ONTOLOGY, PROPERTY, PROV, RANGE, SCHEMA, TRIPLE, TYPE
from graphloom.session import written

KEYS = ["doc", "chunk_ord", "hid"]


def union(a: DataFrame, b: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The set union of graphs with the same keys."""
    return a.select(*keys, *TRIPLE).unionByName(b.select(*keys, *TRIPLE)).dropDuplicates([*keys, *TRIPLE])


def is_fact(domain: str = DOMAIN) -> Column:
    """A triple with a term of the domain is a fact; literals that look like one don't count, and neither do blank nodes."""
    of = lambda c: F.startswith(F.col(c), F.lit(domain))
    return (of("s") & (F.col("s_kind") == "iri")) | of("p") | (of("o") & (F.col("o_kind") == "iri"))


def split(triples: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """One scan gives both graphs: is_fact tells them apart."""
    return triples.withColumn("is_fact", F.coalesce(is_fact(domain), F.lit(False)))


def one_prefix_each(namespaces: DataFrame) -> DataFrame:
    """Of the prefixes of a URI in a graph, the shortest, then the first in the alphabet."""
    of = Window.partitionBy("graph_id", "uri").orderBy(F.length("prefix"), "prefix")
    return namespaces.withColumn("k", F.row_number().over(of)).where("k = 1").drop("k")


def without_chunk_prefixes(namespaces: DataFrame, pattern: str = "/chunk/") -> DataFrame:
    return namespaces.where(~F.contains(F.col("uri"), F.lit(pattern)))


def normalized(curies: DataFrame, namespaces: DataFrame, column: str = "uri") -> DataFrame:
    """The first prefix that begins the URI is replaced wherever it stands in it; adds full and local."""
    n = namespaces.select("prefix", F.col("uri").alias("ns"), "ord")
    # A prefix holds no colon, so it's what stands before the first one.
    hit = curies.select(column).distinct().where(F.contains(column, F.lit(":"))).withColumn("prefix", F.substring_index(column, ":", 1)).join(n, "prefix")
    best = hit.groupBy(column).agg(F.min_by(F.struct("prefix", "ns"), "ord").alias("b"))
    full = F.when(F.col("b").isNotNull(), F.replace(F.col(column), F.concat("b.prefix", F.lit(":")), F.col("b.ns"))).otherwise(F.col(column))
    return curies.join(best, column, "left").withColumn("full", full).withColumn("local", ids.local_name("full")).drop("b")


def entities(triples: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """IRIs that stand as subject or object."""
    s = triples.where("s_kind = 'iri'").select(*keys, F.col("s").alias("e"))
    return s.unionByName(triples.where("o_kind = 'iri'").select(*keys, F.col("o").alias("e"))).distinct()


def adjacency(triples: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Edges u, v of the undirected graph of IRIs, each in both directions."""
    e = triples.where("s_kind = 'iri' and o_kind = 'iri'")
    return e.select(*keys, F.explode(F.array(F.struct(F.col("s").alias("u"), F.col("o").alias("v")), F.struct(F.col("o").alias("u"), F.col("s").alias("v")))).alias("x")).select(*keys, "x.u", "x.v").distinct()


def components(triples: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """e, and component: the least entity it is connected with. Alternating stars: each round every node
    points its larger neighbours, then its smaller ones, to the least of them, until nothing moves; rounds grow with the logarithm of the size, and
    each is written, so that a lost executor costs a task, not the rounds before."""
    every = entities(triples, keys)
    edges = written(adjacency(triples, keys).where("u > v"), "edges")
    before = _sum(edges, keys)
    while True:
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*keys, "u"]).select(*keys, F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = written(small.where("u <> v").distinct(), "edges")
        now = _sum(after, keys)
        if now == before:
            break
        edges, before = after, now
    return every.join(after.select(*keys, F.col("u").alias("e"), F.col("v").alias("component")), [*keys, "e"], "left").withColumn("component", F.coalesce("component", "e"))


def _sum(edges: DataFrame, keys: list[str]) -> tuple:
    """Tells whether two sets of edges are the same, in one scan of each."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64(*keys, "u", "v")), F.bit_xor(F.xxhash64("v", "u", *keys))).first())


def connectivity(members: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """A row for each graph: is it connected, how many components and entities, the largest, how many are alone."""
    size = members.groupBy(*keys, "component").agg(F.count("*").alias("n"))
    out = size.groupBy(*keys).agg(F.count("*").alias("num_components"), F.sum("n").alias("total_entities"), F.max("n").alias("largest_size"), F.sum((F.col("n") == 1).cast("bigint")).alias("isolated"))
    return out.withColumn("is_fully_connected", F.col("num_components") <= 1)


def isolated(members: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    alone = members.groupBy(*keys, "component").agg(F.count("*").alias("n"), F.first("e").alias("e")).where("n = 1")
    return alone.select(*keys, "e")


def degrees(triples: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Triples that an entity stands in as subject or object; one that it stands in twice counts once. has_label: it has a label or comment."""
    loop = (F.col("s") == F.col("o")) & (F.col("o_kind") == "iri")
    own = triples.where("s_kind = 'iri'").select(*keys, F.col("s").alias("e"), F.lit(1).alias("d"), F.col("p").isin(LABEL, COMMENT).alias("named"))
    other = triples.where((F.col("o_kind") == "iri") & ~loop).select(*keys, F.col("o").alias("e"), F.lit(1).alias("d"), F.lit(False).alias("named"))
    return own.unionByName(other).groupBy(*keys, "e").agg(F.sum("d").alias("degree"), F.bool_or("named").alias("has_label"))


def representatives(members: DataFrame, degree: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Of each component, an entity with a label before one without, then of the highest degree, then the first IRI."""
    of = Window.partitionBy(*keys, "component").orderBy(F.desc("has_label"), F.desc("degree"), "e")
    return members.join(degree, [*keys, "e"]).withColumn("k", F.row_number().over(of)).where("k = 1").select(*keys, "component", "e")


def hub_triples(reps: DataFrame, chunk: Column, keys: list[str] = KEYS) -> DataFrame:
    """For graphs of several components: the chunk as a hub with type and label, which has the representatives as parts."""
    many = reps.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    iri, lit = F.lit("iri"), F.lit("literal")
    none = F.lit(None).cast("string")
    triple = lambda s, p, o, kind: F.struct(s.alias("s"), iri.alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), kind.alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))
    head = many.select(*keys, F.explode(F.array(triple(chunk, TYPE, F.lit(SCHEMA + "TextDigitalDocument"), iri), triple(chunk, LABEL, F.concat(F.lit("Chunk "), F.substring_index(chunk, "/", -1)), lit))).alias("t"))
    arms = reps.join(many, keys).select(*keys, F.explode(F.array(triple(chunk, SCHEMA + "hasPart", F.col("e"), iri), triple(F.col("e"), PROV + "wasQuotedFrom", chunk, iri))).alias("t"))
    return head.unionByName(arms).select(*keys, "t.*")


def connected(triples: DataFrame, chunk: Column, keys: list[str] = KEYS) -> DataFrame:
    """Each graph with its hub, if it needs one."""
    reps = representatives(components(triples, keys), degrees(triples, keys), keys)
    return union(triples, hub_triples(reps, chunk, keys), keys)


def declared(triples: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Of each predicate used: label, and the last domain and range that the graph gives it."""
    used = triples.select(*keys, "p").distinct()
    last = lambda p: F.max_by(F.when(F.col("mp") == p, F.col("mo")), F.when(F.col("mp") == p, F.col("ord")))
    meta = triples.select(*keys, F.col("s").alias("p"), F.col("p").alias("mp"), F.col("o").alias("mo"), F.col("triple_ord").alias("ord"))
    return used.join(meta, [*keys, "p"], "left").groupBy(*keys, "p").agg(
        F.count(F.when(F.col("mp") == LABEL, 1)).alias("labels"),
        F.count(F.when(F.col("mp") == DOMAIN_OF, 1)).alias("domains"),
        F.count(F.when(F.col("mp") == RANGE, 1)).alias("ranges"),
        last(DOMAIN_OF).alias("domain"),
        last(RANGE).alias("range"),
    )


def predicate_stats(triples: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Counts of declarations: a predicate of two labels counts twice."""
    d = declared(triples, keys)
    return d.groupBy(*keys).agg(F.count("*").alias("total_predicates"), F.sum("labels").alias("with_labels"), F.sum("domains").alias("with_domains"), F.sum("ranges").alias("with_ranges"))


def first_types(triples: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    t = triples.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri"))
    return t.groupBy(*keys, F.col("s").alias("e")).agg(F.min_by("o", "triple_ord").alias("type"))


def violations(triples: DataFrame, side: str, keys: list[str] = KEYS) -> DataFrame:
    """Uses of a predicate whose subject's (side 'domain') or object's ('range') first type isn't the declared one; without a type there is
    none."""
    term = "s" if side == "domain" else "o"
    use = triples.where(f"{term}_kind = 'iri'").select(*keys, "s", "p", "o", F.col(term).alias("e"))
    rule = declared(triples, keys).where(F.col(side).isNotNull()).select(*keys, "p", F.col(side).alias("expected"))
    return use.join(rule, [*keys, "p"]).join(first_types(triples, keys), [*keys, "e"]).where("type <> expected").select(*keys, "s", "p", "o", "expected", F.col("type").alias("found"))


def is_property() -> Column:
    return (F.col("p") == TYPE) & (F.col("o") == PROPERTY)


NAMESPACES = "graph_id string, ord int, prefix string, uri string"


def merged_namespaces(bindings: DataFrame, extra: dict[str, str]) -> DataFrame:
    """One binding table of each graph_id out of those of its parts in order (ord): the first binding of a prefix stays; another URI under
    it gets prefix_n, where n is how many are bound by then. A URI that is bound already isn't bound again; extra is bound last, over all. The fold is
    over a graph's prefixes, so it stays in one group."""

    def fold(df):
        bound: dict[str, str] = {}
        for prefix, uri in zip(*(df.sort_values(["ord", "prefix", "uri"])[c] for c in ("prefix", "uri")), strict=True):
            if prefix not in bound:
                bound[prefix] = uri
            elif bound[prefix] != uri and uri not in bound.values():
                bound[f"{prefix}_{len(bound)}"] = uri
        bound |= extra
        return df.iloc[[0] * len(bound)][["graph_id"]].assign(ord=range(len(bound)), prefix=list(bound), uri=list(bound.values()))

    return bindings.select("graph_id", "ord", "prefix", "uri").groupBy("graph_id").applyInPandas(fold, NAMESPACES)


def prefix_of(ontologies: DataFrame, namespaces: DataFrame) -> DataFrame:
    """The first prefix that is bound to an ontology's IRI, which both parts of a split graph bind again."""
    n = namespaces.groupBy(F.col("uri").alias("iri")).agg(F.min_by("prefix", "ord").alias("prefix"))
    return ontologies.join(n, "iri", "left")


def selected(names: DataFrame, ontologies: DataFrame) -> DataFrame:
    """names (short_name and other columns) with the iri of the first ontology of that name (by ord); an unknown or null name is that of no ontology."""
    first = ontologies.groupBy("short_name").agg(F.min_by("iri", "ord").alias("iri"))
    out = names.join(first, "short_name", "left")
    return out.withColumns({"short_name": F.when(F.col("iri").isNull(), F.lit(NO_ONTOLOGY)).otherwise(F.col("short_name")), "iri": F.coalesce("iri", F.lit(NO_IRI))})


def merged_ontologies(left: DataFrame, right: DataFrame, heads: DataFrame) -> DataFrame:
    """The union of two ontologies' triples for each short_name, with the heads of the right one (short_name and what else it has)."""
    both = left.unionByName(right).distinct()
    return both.join(heads, "short_name")


def updated(registry: DataFrame, short_name: str, triples: DataFrame) -> DataFrame:
    """The registry's triples (short_name and terms) with those added to the ontology of that name, which must be there."""
    if not registry.where(F.col("short_name") == short_name).limit(1).count():
        raise KeyError(short_name)
    return union(registry, triples.withColumn("short_name", F.lit(short_name)), ["short_name"])
