"""Every operator as a query over the given tables, and the SQL that gives the same rows.

The tables hold no graphs, so views make triples of them, once here and once in SQL (VIEWS): parts are entities of documents (one a type, a chunk a
size), customers, segments and suppliers a graph for each nation, nations predicates that two chunks declare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import ids
from graphloom.functions import vocab as V
from graphloom.functions.similarity import ratio_of
from graphloom.operators import chunking, entities, graph
from graphloom.plans import workflow
from graphloom.session import written
from graphloom.sources import files, jsonmd, turtle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

D, VOC = V.DOMAIN, V.DOMAIN + "/voc#"
DOCS = f"{D}/doc/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that a task makes triples of, while there are fewer than so many tasks: a file of a few megabytes holds millions of rows, and their triples take a hundred times its bytes.
ROWS, TASKS = 100_000, 200


def spread(df: DataFrame) -> DataFrame:
    """df in parts of about ROWS rows, if it has more. Few partitions, so that the one task that reads a file sorts nothing to part it."""
    n = min(-(-df.count() // ROWS), TASKS)
    return df.repartition(n, *df.columns) if n > 1 else df


def triples(df: DataFrame, keys: dict[str, Column], rows: list[tuple]) -> DataFrame:
    """rows: (order, s, p, o, o_kind, o_dt) as columns for each row of df; those without an o are left out."""
    c = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    each = F.array(*(F.struct(o.cast("bigint").alias("triple_ord"), c(s).alias("s"), F.lit("iri").alias("s_kind"), c(p).alias("p"), c(v).alias("o"), F.lit(k).alias("o_kind"), c(dt).alias("o_dt"), c(None).alias("o_lang")) for o, s, p, v, k, dt in rows))
    return spread(df).select(*(v.alias(k) for k, v in keys.items()), F.explode(each).alias("t")).select(*keys, "t.*").where("o is not null")


def keys_of(doc: Column, chunk: Column, hid: Column) -> dict[str, Column]:
    return {"doc": doc, "chunk_ord": chunk.cast("int"), "hid": hid}


def chunk_of() -> Column:
    return F.concat(F.lit(DOCS), "doc", F.lit("/chunk/"), "hid")


def doc_ns() -> Column:
    return F.concat(F.lit(DOCS), "doc", F.lit("/"))


def t_part(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    doc, hid = F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), F.concat(F.lit("c"), F.col("p_size").cast("string"))
    s = F.concat(F.lit(DOCS), doc, F.lit("/chunk/"), hid, F.lit("/part"), F.col("p_partkey").cast("string"))
    n = F.col("p_partkey") * 3
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint").cast("string")
    return triples(p, keys_of(doc, F.col("p_size"), hid), [(n, s, V.LABEL, F.col("p_name"), "literal", None), (n + 1, s, V.TYPE, F.concat(F.lit(VOC), F.replace("p_brand", F.lit("#"), F.lit(""))), "iri", None), (n + 2, s, VOC + "price", cents, "literal", V.XSD + "integer")])


def t_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Parts, and the brands as an ontology with a comment that only looks like an IRI of a chunk."""
    b = table(spark, sf, "part").select("p_brand").distinct()
    s = F.concat(F.lit(VOC), F.replace("p_brand", F.lit("#"), F.lit("")))
    n = F.lit(-1)
    onto = triples(b, keys_of(F.lit("voc"), F.lit(0), F.lit("v")), [(n, s, V.LABEL, F.col("p_brand"), "literal", None), (n, s, V.TYPE, F.lit(V.RDFS + "Class"), "iri", None), (n, s, V.COMMENT, F.lit(DOCS + "x"), "literal", None)])
    return t_part(spark, sf).unionByName(onto)


def _geo(nation: str) -> tuple[dict[str, Column], Callable[[str, Column], Column]]:
    hid = F.concat(F.lit("n"), F.col(nation).cast("string"))
    base = F.concat(F.lit(f"{DOCS}geo/chunk/"), hid, F.lit("/"))
    return keys_of(F.lit("geo"), F.col(nation), hid), lambda kind, k: F.concat(base, F.lit(kind), k.cast("string"))


def t_geo(spark: SparkSession, sf: str) -> DataFrame:
    keys, iri = _geo("c_nationkey")
    n, s = F.col("c_custkey") * 10, iri("customer", F.col("c_custkey"))
    c = triples(table(spark, sf, "customer"), keys, [(n, s, V.LABEL, F.col("c_name"), "literal", None), (n + 1, s, VOC + "segment", iri("seg", F.col("c_mktsegment")), "iri", None)])
    keys, iri = _geo("s_nationkey")
    s = triples(table(spark, sf, "supplier"), keys, [(F.col("s_suppkey") * 10 + 1_000_000_000, iri("supplier", F.col("s_suppkey")), V.LABEL, F.col("s_name"), "literal", None)])
    return c.unionByName(s)


def t_val(spark: SparkSession, sf: str) -> DataFrame:
    """t_geo with types, and in each chunk the declaration of the predicate segment."""
    keys, iri = _geo("c_nationkey")
    c = table(spark, sf, "customer")
    kind = F.when(F.col("c_acctbal") >= 0, F.lit(VOC + "Customer")).otherwise(F.lit(VOC + "Debtor"))
    t = triples(c, keys, [(F.col("c_custkey") * 10 + 2, iri("customer", F.col("c_custkey")), V.TYPE, kind, "iri", None)])
    seg = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("k"))
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(VOC + "Branch")).otherwise(F.lit(VOC + "Segment"))
    g = triples(seg, keys, [(F.col("k") * 10 + 3, iri("seg", F.col("c_mktsegment")), V.TYPE, kind, "iri", None)])
    keys, _ = _geo("n_nationkey")
    n, p = F.col("n_nationkey") * 10 + 3_000_000_000, VOC + "segment"
    d = triples(table(spark, sf, "nation"), keys, [(n, p, V.TYPE, F.lit(V.PROPERTY), "iri", None), (n + 1, p, V.DOMAIN_OF, F.lit(VOC + "Customer"), "iri", None), (n + 2, p, V.RANGE, F.lit(VOC + "Segment"), "iri", None), (n + 3, p, V.LABEL, F.lit("segment"), "literal", None)])
    return t_geo(spark, sf).unionByName(t).unionByName(g).unionByName(d)


def t_pred(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").withColumn("c", F.explode(F.array(F.lit(0), F.lit(1))))
    doc, hid = F.concat(F.lit("p"), F.col("n_regionkey").cast("string")), F.concat(F.lit("c"), F.col("c").cast("string"))
    base = F.concat(F.lit(DOCS), doc, F.lit("/chunk/"), hid, F.lit("/"))
    p, k = F.concat(base, F.replace(F.lower("n_name"), F.lit(" "), F.lit("_"))), F.col("n_nationkey") * 10
    label = F.when(F.col("c") == 1, F.concat(F.lower("n_name"), F.lit("s"))).otherwise(F.col("n_name"))
    first = F.col("c") == 0
    return triples(
        n,
        keys_of(doc, F.col("c"), hid),
        [
            (k, F.concat(base, F.lit("n"), F.col("n_nationkey").cast("string")), p, F.concat(base, F.lit("r")), "iri", None),
            (k + 1, p, V.LABEL, label, "literal", None),
            (k + 2, p, V.DOMAIN_OF, F.when(first, F.concat(F.lit(VOC + "R"), F.col("n_regionkey").cast("string"))), "iri", None),
            (k + 3, p, V.RANGE, F.lit(VOC + "N"), "iri", None),
            (k + 4, p, V.TYPE, F.when(first & (F.col("n_nationkey") % 2 == 0), F.lit(V.PROPERTY)), "iri", None),
        ],
    )


def namespaces(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    own = p.select(F.concat(F.lit("g"), (F.col("page_id") % 7).cast("string")).alias("graph_id"), F.concat(F.lit("p"), (F.col("page_id") % 11).cast("string")).alias("prefix"), F.concat(F.lit("http://"), host, F.lit("/")).alias("uri")).distinct()
    chunks = t_part(spark, sf).select("doc", "hid").distinct().select(F.col("doc").alias("graph_id"), F.col("hid").alias("prefix"), F.concat(F.lit(DOCS), "doc", F.lit("/chunk/"), "hid", F.lit("/")).alias("uri"))
    return own.unionByName(chunks)


def _t(s: str, p: str, o: str, kind: str, order: str, dt: str = "null", keys: str = "doc, chunk_ord, hid") -> str:
    return f"select {keys}, ({order})::bigint as triple_ord, {s} as s, 'iri' as s_kind, {p} as p, {o} as o, '{kind}' as o_kind, {dt}::varchar as o_dt, null::varchar as o_lang"


VIEWS = f"""with recursive part_k as (
    select *, replace(lower(p_type), ' ', '_') as doc, p_size as chunk_ord, 'c' || p_size as hid, '{DOCS}' || replace(lower(p_type), ' ', '_') || '/chunk/c' || p_size || '/part' || p_partkey as s0 from part
), t_part as materialized (
    {_t("s0", f"'{V.LABEL}'", "p_name", "literal", "p_partkey * 3")} from part_k
    union all {_t("s0", f"'{V.TYPE}'", f"'{VOC}' || replace(p_brand, '#', '')", "iri", "p_partkey * 3 + 1")} from part_k
    union all {_t("s0", f"'{VOC}price'", "round(p_retailprice * 100)::bigint::varchar", "literal", "p_partkey * 3 + 2", f"'{V.XSD}integer'")} from part_k
), brand as (select distinct p_brand, 'voc' as doc, 0 as chunk_ord, 'v' as hid, '{VOC}' || replace(p_brand, '#', '') as s0 from part
), t_mixed as (
    from t_part
    union all {_t("s0", f"'{V.LABEL}'", "p_brand", "literal", "-1")} from brand
    union all {_t("s0", f"'{V.TYPE}'", f"'{V.RDFS}Class'", "iri", "-1")} from brand
    union all {_t("s0", f"'{V.COMMENT}'", f"'{DOCS}x'", "literal", "-1")} from brand
), cust as (
    select *, 'geo' as doc, c_nationkey as chunk_ord, 'n' || c_nationkey as hid, '{DOCS}geo/chunk/n' || c_nationkey || '/' as base from customer
), t_geo as materialized (
    {_t("base || 'customer' || c_custkey", f"'{V.LABEL}'", "c_name", "literal", "c_custkey * 10")} from cust
    union all {_t("base || 'customer' || c_custkey", f"'{VOC}segment'", "base || 'seg' || c_mktsegment", "iri", "c_custkey * 10 + 1")} from cust
    union all {_t(f"'{DOCS}geo/chunk/n' || s_nationkey || '/supplier' || s_suppkey", f"'{V.LABEL}'", "s_name", "literal", "s_suppkey * 10 + 1000000000", keys="'geo' as doc, s_nationkey as chunk_ord, 'n' || s_nationkey as hid")} from supplier
), nat as (select *, 'geo' as doc, n_nationkey as chunk_ord, 'n' || n_nationkey as hid from nation
), t_val as (
    from t_geo
    union all {_t("base || 'customer' || c_custkey", f"'{V.TYPE}'", f"case when c_acctbal >= 0 then '{VOC}Customer' else '{VOC}Debtor' end", "iri", "c_custkey * 10 + 2")} from cust
    union all {_t("base || 'seg' || c_mktsegment", f"'{V.TYPE}'", f"case when c_mktsegment = 'MACHINERY' then '{VOC}Branch' else '{VOC}Segment' end", "iri", "min(c_custkey) * 10 + 3")} from cust group by doc, chunk_ord, hid, base, c_mktsegment
    union all {_t(f"'{VOC}segment'", f"'{V.TYPE}'", f"'{V.PROPERTY}'", "iri", "n_nationkey * 10 + 3000000000")} from nat
    union all {_t(f"'{VOC}segment'", f"'{V.DOMAIN_OF}'", f"'{VOC}Customer'", "iri", "n_nationkey * 10 + 3000000001")} from nat
    union all {_t(f"'{VOC}segment'", f"'{V.RANGE}'", f"'{VOC}Segment'", "iri", "n_nationkey * 10 + 3000000002")} from nat
    union all {_t(f"'{VOC}segment'", f"'{V.LABEL}'", "'segment'", "literal", "n_nationkey * 10 + 3000000003")} from nat
), nat2 as (
    select *, 'p' || n_regionkey as doc, c as chunk_ord, 'c' || c as hid, '{DOCS}p' || n_regionkey || '/chunk/c' || c || '/' as base, base || replace(lower(n_name), ' ', '_') as p0 from nation, (values (0), (1)) as v(c)
), t_pred as (
    {_t("base || 'n' || n_nationkey", "p0", "base || 'r'", "iri", "n_nationkey * 10")} from nat2
    union all {_t("p0", f"'{V.LABEL}'", "case when c = 1 then lower(n_name) || 's' else n_name end", "literal", "n_nationkey * 10 + 1")} from nat2
    union all {_t("p0", f"'{V.DOMAIN_OF}'", f"'{VOC}R' || n_regionkey", "iri", "n_nationkey * 10 + 2")} from nat2 where c = 0
    union all {_t("p0", f"'{V.RANGE}'", f"'{VOC}N'", "iri", "n_nationkey * 10 + 3")} from nat2
    union all {_t("p0", f"'{V.TYPE}'", f"'{V.PROPERTY}'", "iri", "n_nationkey * 10 + 4")} from nat2 where c = 0 and n_nationkey % 2 = 0
), namespaces as (
    select distinct 'g' || page_id % 7 as graph_id, 'p' || page_id % 11 as prefix, 'http://' || regexp_extract(url, '^[a-z]+://([^/]+)', 1) || '/' as uri from pages
    union all select distinct doc, hid, '{DOCS}' || doc || '/chunk/' || hid || '/' from t_part
), geo_e as (
    select distinct doc, chunk_ord, hid, e from (select doc, chunk_ord, hid, s as e from t_geo union all select doc, chunk_ord, hid, o from t_geo where o_kind = 'iri')
), geo_c as materialized (
    select doc, chunk_ord, hid, e, least(e, coalesce((select min(t.s) from t_geo t where t.o = coalesce(g.seg, geo_e.e) and t.o_kind = 'iri'), e), coalesce(g.seg, e)) as component
    from geo_e left join (select s, o as seg from t_geo where o_kind = 'iri') g on g.s = geo_e.e
), geo_size as (select doc, chunk_ord, hid, component, count(*) as n, min(e) as e from geo_c group by all
), geo_d as (
    select doc, chunk_ord, hid, e, count(*) as degree, bool_or(named) as has_label from (
        select doc, chunk_ord, hid, s as e, p in ('{V.LABEL}', '{V.COMMENT}') as named from t_geo
        union all select doc, chunk_ord, hid, o, false from t_geo where o_kind = 'iri' and o <> s) group by all
), geo_r as (
    select doc, chunk_ord, hid, component, e from (select *, row_number() over (partition by doc, chunk_ord, component order by has_label desc, degree desc, e) as k from geo_c join geo_d using (doc, chunk_ord, hid, e)) where k = 1
), val_d as materialized (
    select doc, chunk_ord, hid, u.p, count(*) filter (m.p = '{V.LABEL}') as labels, count(*) filter (m.p = '{V.DOMAIN_OF}') as domains, count(*) filter (m.p = '{V.RANGE}') as ranges,
        max_by(m.o, m.triple_ord) filter (m.p = '{V.DOMAIN_OF}') as domain, max_by(m.o, m.triple_ord) filter (m.p = '{V.RANGE}') as range
    from (select distinct doc, chunk_ord, hid, p from t_val) u left join (select doc, chunk_ord, hid, s, p, o, triple_ord from t_val) m using (doc, chunk_ord, hid) where m.s = u.p or m.s is null group by all
    union all select doc, chunk_ord, hid, p, 0, 0, 0, null, null from (select distinct doc, chunk_ord, hid, p from t_val) u where not exists (from t_val m where m.s = u.p and m.hid = u.hid)
), val_t as (select doc, chunk_ord, hid, s as e, min_by(o, triple_ord) as type from t_val where p = '{V.TYPE}' group by all
), part_m as materialized (
    select doc, e, local_name, label, comment, types, row_number() over (partition by doc order by chunk_ord, pass, place, pos, e) as i from (
        select doc, s0 as e, 'part' || p_partkey as local_name, p_name as label, null::varchar as comment, ['{VOC}' || replace(p_brand, '#', '')] as types, chunk_ord, 0 as pass, p_partkey * 3 as place, 0 as pos from part_k
        union all select doc, '{VOC}' || replace(p_brand, '#', ''), replace(p_brand, '#', ''), null, null, [], min(chunk_ord), 1, min_by(p_partkey, (chunk_ord, p_partkey)) * 3 + 1, 1 from part_k group by all)
), part_lab as materialized (select distinct doc, lower(label) as l from part_m where label is not null
), part_class as materialized (
    select doc, i, min(i) over (partition by doc, case when many > 1 then lower(local_name) end, nullif(lower(label), ''), types, case when many = 1 and nullif(lower(label), '') is null then i end) as rep
    from (select *, count(*) over (partition by doc, lower(local_name)) as many from part_m)
), part_sim as materialized (
    select x.doc, x.l as l1, y.l as l2, 200.0::double * list_reduce(regexp_extract_all(x.l, '(?s).'), lambda row, ca: [list_max([greatest(row[k], case when k > 1 then row[k - 1] + (substr(y.l, k - 1, 1) = ca)::int else 0 end) for k in range(1, j + 1)]) for j in range(1, len(row) + 1)], [0 for _ in range(length(y.l) + 1)])[-1] / (length(x.l) + length(y.l)) as ratio
    from part_lab x join part_lab y on x.doc = y.doc and x.l <= y.l
), part_pair as materialized (
    select a.doc, a.i as i1, b.i as i2, lower(a.local_name) = lower(b.local_name) as same, list_has_any(a.types, b.types) as share, least(lower(a.label), lower(b.label)) as l1, greatest(lower(a.label), lower(b.label)) as l2, a.label is not null and b.label is not null as labelled
    from part_m a join part_m b on a.doc = b.doc and a.i < b.i where len(a.types) = 0 or len(b.types) = 0 or list_has_any(a.types, b.types)
), part_edge as materialized (
    select doc, i1, i2 from part_pair left join part_sim using (doc, l1, l2) where same or (labelled and ratio >= case when share then 90 else 85 end)
), part_adj as materialized (select doc, i2 as i, list(i1) as lower_ones from part_edge group by all
), part_lead as (
    select doc, 0::bigint as i, []::bigint[] as leaders from (select distinct doc from part_m)
    union all select l.doc, l.i + 1, case when list_has_any(coalesce(a.lower_ones, []), l.leaders) then l.leaders else list_append(l.leaders, l.i + 1) end
    from part_lead l left join part_adj a on a.doc = l.doc and a.i = l.i + 1 where l.i < (select max(i) from part_m m where m.doc = l.doc)
), part_leader as (select doc, unnest(max_by(leaders, i)) as i from part_lead group by doc
), part_led as (select e.doc, i2 as i, min(i1) as leader from part_edge e join part_leader l on l.doc = e.doc and l.i = e.i1 group by all
), part_cluster as materialized (from part_led union all select distinct doc, leader, leader from part_led
), part_group as materialized (
    select doc, leader, '{DOCS}' || doc || '/' || max_by(local_name, (coalesce(length(label), 0), -i)) as base, max_by(coalesce(label, ''), (coalesce(length(label), 0), -i)) as label from part_m join part_cluster using (doc, i) group by doc, leader
), part_to as materialized (
    select m.doc, m.e, m.types, g.base from part_m m join part_cluster c using (doc, i) join part_group g on g.doc = c.doc and g.leader = c.leader
), part_new as materialized (
    select t.doc, hid, coalesce(x.base, t.s) as s, p, coalesce(y.base, t.o) as o, o_kind, o_dt from t_part t left join part_to x on x.doc = t.doc and x.e = t.s left join part_to y on y.doc = t.doc and y.e = t.o and t.o_kind = 'iri'
), emb as (
    select label::varchar as doc, vec_id as ord, embedding, 1 - array_cosine_similarity(embedding::double[64], (lead(embedding) over w)::double[64]) as distance from embeddings window w as (partition by label order by vec_id)
), dist as (from emb where distance is not null
), grad as (
    select *, case when a is null then b - distance when b is null then distance - a else (b - a) / 2 end as gradient from (select *, lag(distance) over w as a, lead(distance) over w as b from dist window w as (partition by doc order by ord))
), conv as (select conv_id::varchar as doc, turn as ord, text as sentence from conversations)
"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = VIEWS + sql if "from " in sql else sql
        return f

    return add


KEYS = ["doc", "chunk_ord", "hid"]
ALL = [*KEYS, *V.TRIPLE]


@query("doc_identity", f"select doc_id, substr(sha256(text), 1, 12) as hid, '{DOCS}' || substr(sha256(text), 1, 12) as iri, '{DOCS}' || substr(sha256(text), 1, 12) || '/' as ns from documents")
def doc_identity(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", ids.text_hash("text").alias("hid"))
    return d.withColumn("iri", ids.doc_iri("hid")).withColumn("ns", ids.namespace("iri"))


@query("chunk_iris", f"select conv_id, turn, '{DOCS}' || substr(sha256(conv_id::varchar), 1, 12) || '/chunk/' || substr(sha256(text), 1, 12) as iri, iri || '/' as ns from conversations")
def chunk_iris(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", ids.chunk_iri(ids.doc_iri(ids.text_hash(F.col("conv_id").cast("string"))), ids.text_hash("text")).alias("iri")).withColumn("ns", ids.namespace("iri"))


@query("local_name", "select page_id, case when contains(url, '#') then split_part(url, '#', -1) when contains(url, '/') then split_part(url, '/', -1) else url end as local_name from pages")
def local_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", ids.local_name("url").alias("local_name"))


@query("clean_local_name", r"select page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(url, '[^\pL\pN\pM\p{Pc}\-.]', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'entity') as name from pages")
def clean_local_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", ids.clean_local_name("url").alias("name"))


@query("normalize_curie", f"select p_partkey, uri, replace(uri, 'voc:', '{VOC}') as full, case when contains(uri, '#') then split_part(uri, '#', -1) when starts_with(uri, 'voc:') then split_part(replace(uri, 'voc:', '{VOC}'), '#', -1) else uri end as local from (select p_partkey, case when p_size < 25 then 'voc:' || replace(p_brand, '#', '') else 'other:' || p_name end as uri from part)")
def normalize_curie(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") < 25, F.concat(F.lit("voc:"), F.replace("p_brand", F.lit("#"), F.lit("")))).otherwise(F.concat(F.lit("other:"), "p_name")).alias("uri"))
    ns = spark.createDataFrame([("g", i, p, u) for i, (p, u) in enumerate([("voc", VOC), *V.PREFIXES.items()])], "graph_id string, ord int, prefix string, uri string")
    return graph.normalized(p, ns).select("p_partkey", "uri", "full", "local")


@query("ext_dispatch", "select event_id, path, case when suffix in ('.pdf', '.ppt', '.pptx') then 'office' when suffix = '.json' then 'json' when suffix = '.txt' then 'txt' else 'unsupported' end as kind from (select event_id, path, lower(regexp_extract(path, '.(\\.[^./]+)$', 1)) as suffix from (select event_id, 'in/' || event_type || '/' || user_id || ['.pdf', '.PPTX', '.json', '.txt', '.md', ''][event_id % 6 + 1] as path from events))")
def ext_dispatch(spark, sf):
    e = table(spark, sf, "events")
    end = F.element_at(F.array(*map(F.lit, [".pdf", ".PPTX", ".json", ".txt", ".md", ""])), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("event_id", F.concat(F.lit("in/"), "event_type", F.lit("/"), F.col("user_id").cast("string"), end).alias("path")).withColumn("kind", files.kind_of("path"))


@query("facts_filename", "select page_id, 'facts_' || array_to_string(list_filter(string_split(url, '/')[-2:], lambda x: x <> ''), '_') || '.ttl' as file from pages")
def facts_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", ids.facts_filename("url").alias("file"))


_FACT = f"(starts_with(s, '{DOCS}') or starts_with(p, '{DOCS}') or (o_kind = 'iri' and starts_with(o, '{DOCS}')))"


@query("split_facts", f"select {_FACT} as is_fact, p, count(*) as n from t_mixed group by all")
def split_facts(spark, sf):
    return graph.split(t_mixed(spark, sf), DOCS).groupBy("is_fact", "p").agg(F.count("*").alias("n"))


@query("split_ontology", f"select {', '.join(ALL)} from t_mixed where not {_FACT}")
def split_ontology(spark, sf):
    return graph.split(t_mixed(spark, sf), DOCS).where("not is_fact").select(ALL)


@query("prefix_dedupe", "select graph_id, prefix, uri from (select *, row_number() over (partition by graph_id, uri order by length(prefix), prefix) as k from namespaces) where k = 1")
def prefix_dedupe(spark, sf):
    return graph.one_prefix_each(namespaces(spark, sf))


@query("drop_chunk_prefixes", "from namespaces where not contains(uri, '/chunk/')")
def drop_chunk_prefixes(spark, sf):
    return graph.without_chunk_prefixes(namespaces(spark, sf))


@query(
    "namespace_union",
    """, n as (select graph_id, prefix, uri, row_number() over (partition by graph_id order by prefix, uri) as k, count(*) over (partition by graph_id) as many from namespaces), f as (
    select graph_id, 0::bigint as k, []::varchar[] as ps, []::varchar[] as us from (select distinct graph_id from n)
    union all select f.graph_id, n.k, case when not list_contains(ps, prefix) then list_append(ps, prefix) when us[list_position(ps, prefix)] <> uri and not list_contains(us, uri) then list_append(ps, prefix || '_' || len(ps)) else ps end,
        case when not list_contains(ps, prefix) or us[list_position(ps, prefix)] <> uri and not list_contains(us, uri) then list_append(us, uri) else us end
    from f join n on n.graph_id = f.graph_id and n.k = f.k + 1
), g as (select graph_id, max_by(ps, k) as ps, max_by(us, k) as us from f group by graph_id)
select graph_id, unnest(ps) as prefix, unnest(us) as uri, unnest(range(len(ps)))::int as ord from g""",
)
def namespace_union(spark, sf):
    """Many a prefix is bound to several URIs in a graph, so that later ones get another name."""
    order = F.row_number().over(graph.Window.partitionBy("graph_id").orderBy("prefix", "uri")).alias("ord")
    return graph.merged_namespaces(namespaces(spark, sf).select("graph_id", order, "prefix", "uri"), {})


@query("ontology_prefix", f"select r_regionkey, '{VOC}' || r_name as iri, case when r_regionkey < 3 then 'r' || r_regionkey end as prefix from region")
def ontology_prefix(spark, sf):
    r = table(spark, sf, "region").withColumn("iri", F.concat(F.lit(VOC), "r_name"))
    ns = r.where("r_regionkey < 3").select(F.lit("g").alias("graph_id"), F.col("r_regionkey").alias("ord"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("prefix"), F.col("iri").alias("uri"))
    return graph.prefix_of(r.select("r_regionkey", "iri"), ns)


@query("graph_union", f"select distinct {', '.join(ALL)} from t_mixed")
def graph_union(spark, sf):
    return graph.union(t_mixed(spark, sf), t_part(spark, sf))


@query("ontology_merge", f"select 'o' || n_regionkey as short_name, count(*) as triples, '2.0.' || n_regionkey as version from (select distinct n_regionkey, n_name as o from nation union select r_regionkey, r_name from region) group by all")
def ontology_merge(spark, sf):
    """The union of two graphs of a name; name and version come from the right one."""
    onto = lambda df, k, o: df.select(F.concat(F.lit("o"), F.col(k).cast("string")).alias("short_name"), F.lit(VOC).alias("s"), F.lit(V.LABEL).alias("p"), F.col(o).alias("o"))
    left, right = onto(table(spark, sf, "nation"), "n_regionkey", "n_name"), onto(table(spark, sf, "region"), "r_regionkey", "r_name")
    heads = right.select("short_name", F.concat(F.lit("2.0."), F.substring("short_name", 2, 9)).alias("version")).distinct()
    return graph.merged_ontologies(left, right, heads).groupBy("short_name", "version").agg(F.count("*").alias("triples"))


@query("ontology_lookup", f"select event_id, coalesce(case when event_type in ('click', 'view') then event_type end, '{V.NO_ONTOLOGY}') as short_name, coalesce(case when event_type in ('click', 'view') then '{VOC}' || event_type end, '{V.NO_IRI}') as iri from events")
def ontology_lookup(spark, sf):
    known = spark.createDataFrame([(n, VOC + n, i) for i, n in enumerate(("click", "view"))], "short_name string, iri string, ord int")
    return graph.selected(table(spark, sf, "events").select("event_id", F.col("event_type").alias("short_name")), known)


@query("all_entities", "from geo_e")
def all_entities(spark, sf):
    return graph.entities(t_geo(spark, sf))


@query("adjacency", "select distinct doc, chunk_ord, hid, u, v from (select doc, chunk_ord, hid, s as u, o as v from t_geo where o_kind = 'iri' union all select doc, chunk_ord, hid, o, s from t_geo where o_kind = 'iri')")
def adjacency(spark, sf):
    return graph.adjacency(t_geo(spark, sf))


@query("connected_components", "from geo_c")
def connected_components(spark, sf):
    return graph.components(t_geo(spark, sf))


@query("component_report", "select doc, chunk_ord, hid, count(*) as num_components, sum(n)::bigint as total_entities, max(n) as largest_size, count(*) filter (n = 1) as isolated, count(*) <= 1 as is_fully_connected from geo_size group by doc, chunk_ord, hid")
def component_report(spark, sf):
    return graph.connectivity(graph.components(t_geo(spark, sf)))


@query("isolated_entities", "select doc, chunk_ord, hid, e from geo_size where n = 1")
def isolated_entities(spark, sf):
    return graph.isolated(graph.components(t_geo(spark, sf)))


@query("degree", "from geo_d")
def degree(spark, sf):
    return graph.degrees(t_geo(spark, sf))


@query("representative", "from geo_r")
def representative(spark, sf):
    t = t_geo(spark, sf)
    return graph.representatives(graph.components(t), graph.degrees(t))


_HUB = f"'{DOCS}' || doc || '/chunk/' || hid"


@query(
    "hub_bridge",
    f""", many as (select doc, chunk_ord, hid from geo_r group by all having count(*) > 1)
select distinct {", ".join(ALL)} from (
    from t_geo select {", ".join(ALL)}
    union all select doc, chunk_ord, hid, {_HUB}, 'iri', '{V.TYPE}', '{V.SCHEMA}TextDigitalDocument', 'iri', null, null from many
    union all select doc, chunk_ord, hid, {_HUB}, 'iri', '{V.LABEL}', 'Chunk ' || hid, 'literal', null, null from many
    union all select doc, chunk_ord, hid, {_HUB}, 'iri', '{V.SCHEMA}hasPart', e, 'iri', null, null from geo_r semi join many using (doc, chunk_ord, hid)
    union all select doc, chunk_ord, hid, e, 'iri', '{V.PROV}wasQuotedFrom', {_HUB}, 'iri', null, null from geo_r semi join many using (doc, chunk_ord, hid))""",
)
def hub_bridge(spark, sf):
    return graph.connected(t_geo(spark, sf), chunk_of())


@query("predicate_stats", "select doc, chunk_ord, hid, count(*) as total_predicates, sum(labels)::bigint as with_labels, sum(domains)::bigint as with_domains, sum(ranges)::bigint as with_ranges from val_d group by all")
def predicate_stats(spark, sf):
    return graph.predicate_stats(t_val(spark, sf))


@query("missing_labels", "select doc, chunk_ord, hid, p from val_d where labels = 0")
def missing_labels(spark, sf):
    return graph.declared(t_val(spark, sf)).where("labels = 0").select(*KEYS, "p")


def _violations(side: str) -> str:
    e = "s" if side == "domain" else "o"
    return f"select doc, chunk_ord, hid, t.s, t.p, t.o, d.{side} as expected, k.type as found from t_val t join val_d d using (doc, chunk_ord, hid, p) join val_t k using (doc, chunk_ord, hid) where k.e = t.{e} and t.{e}_kind = 'iri' and d.{side} <> k.type"


@query("domain_violations", _violations("domain"))
def domain_violations(spark, sf):
    return graph.violations(t_val(spark, sf), "domain")


@query("range_violations", _violations("range"))
def range_violations(spark, sf):
    return graph.violations(t_val(spark, sf), "range")


@query("entity_labels", f"select doc, chunk_ord, s0 as e, 'part' || p_partkey as local_name, p_name as label, null as comment from part_k union all select distinct doc, chunk_ord, '{VOC}' || replace(p_brand, '#', ''), replace(p_brand, '#', ''), null, null from part_k")
def entity_labels(spark, sf):
    return entities.entity_labels(t_part(spark, sf)).drop("first")


@query("entity_types", f"select doc, s as e, list_sort(list(distinct o)) as types from t_part where p = '{V.TYPE}' group by all")
def entity_types(spark, sf):
    return entities.entity_types(t_part(spark, sf))


_INFO = f"""select doc, chunk_ord, p as pred, min(triple_ord) as place, max(label) as label, max(comment) as comment, max(domain) as domain, max(range) as range, coalesce(bool_or(explicit), false) as is_explicit from t_pred t left join (
    select s, hid as h, max_by(o, triple_ord) filter (p = '{V.LABEL}') as label, max_by(o, triple_ord) filter (p = '{V.COMMENT}') as comment, max_by(o, triple_ord) filter (p = '{V.DOMAIN_OF}') as domain, max_by(o, triple_ord) filter (p = '{V.RANGE}') as range, bool_or(p = '{V.TYPE}' and o = '{V.PROPERTY}') as explicit from t_pred group by all) m on m.s = t.p and m.h = t.hid group by all"""


@query("predicate_info", f"select * exclude (place) from ({_INFO})")
def predicate_info(spark, sf):
    return entities.predicate_info(t_pred(spark, sf)).drop("at")


def _long(c: str) -> str:
    return f"max_by({c}, (length({c}), -chunk_ord)) filter ({c} is not null) as {c}"


@query("predicate_merge", f"select doc, pred, {', '.join(map(_long, ('label', 'comment', 'domain', 'range')))}, bool_or(is_explicit) as is_explicit from ({_INFO}) group by doc, pred")
def predicate_merge(spark, sf):
    return entities.predicate_meta(entities.predicate_info(t_pred(spark, sf))).drop("ord", "local_name")


_PM = f"""(select *, split_part(pred, case when contains(pred, '#') then '#' else '/' end, -1) as local_name, row_number() over (partition by doc order by c, place, pred) as i from (
    select doc, pred, min(chunk_ord) as c, min_by(place, chunk_ord) as place, {', '.join(map(_long, ('label', 'comment', 'domain', 'range')))} from ({_INFO}) group by doc, pred))"""
_LCS = "list_reduce(regexp_extract_all({a}, '(?s).'), lambda row, ca: [list_max([greatest(row[k], case when k > 1 then row[k - 1] + (substr({b}, k - 1, 1) = ca)::int else 0 end) for k in range(1, j + 1)]) for j in range(1, len(row) + 1)], [0 for _ in range(length({b}) + 1)])[-1]"


@query(
    "predicate_edges",
    f""", m as materialized (from {_PM}), pair as (
    select a.doc, a.i as i1, b.i as i2, lower(a.local_name) = lower(b.local_name) as same, lower(a.label) as x, lower(b.label) as y from m a join m b on a.doc = b.doc and a.i < b.i
    where (a.domain is null or b.domain is null or a.domain = b.domain) and (a.range is null or b.range is null or a.range = b.range))
select doc, i1, i2 from pair where same or (x is not null and y is not null and 200.0 * {_LCS.format(a="x", b="y")} / (length(x) + length(y)) >= 85)""",
)
def predicate_edges(spark, sf):
    return entities.predicate_edges(entities.numbered(entities.predicate_meta(entities.predicate_info(t_pred(spark, sf)))))


@query("lcs_ratio", "select doc, l1, l2, round(ratio, 6) as ratio from part_sim")
def lcs_ratio(spark, sf):
    """Of all pairs of distinct labels of a document."""
    labels = t_part(spark, sf).where(F.col("p") == V.LABEL).select("doc", F.lower("o").alias("l")).distinct()
    pairs = labels.withColumnRenamed("l", "l1").join(labels.withColumnRenamed("l", "l2"), "doc").where("l1 <= l2")
    return pairs.withColumn("ratio", F.round(ratio_of(F.col("l1"), F.col("l2")), 6))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return written(entities.numbered(entities.entity_meta(t_part(spark, sf))), "entities")


@query("entity_edges", """select doc, i1, i2, 'similar' as kind from part_edge e semi join part_class x on x.doc = e.doc and x.i = e.i1 and x.i = x.rep semi join part_class y on y.doc = e.doc and y.i = e.i2 and y.i = y.rep
union all select doc, rep, i, 'copy' from part_class where i <> rep""")
def entity_edges(spark, sf):
    """Pairs of the first entities of classes, and which others these stand for."""
    m = _parts(spark, sf)
    c = written(entities.entity_classes(m), "entity-classes")
    e = entities.entity_edges(m.join(c.where("i = rep").select("doc", "i"), ["doc", "i"], "left_semi"))
    return e.select("doc", "i1", "i2", F.lit("similar").alias("kind")).unionByName(c.where("i <> rep").select("doc", F.col("rep").alias("i1"), F.col("i").alias("i2"), F.lit("copy").alias("kind")))


@query("entity_clusters", "select doc, i, leader from part_cluster")
def entity_clusters(spark, sf):
    return entities.entity_clusters(_parts(spark, sf))


@query("best_label", "select doc, leader, label from part_group")
def best_label(spark, sf):
    m = _parts(spark, sf)
    return entities.best_labels(m, entities.entity_clusters(m)).select("doc", "leader", F.coalesce("label", F.lit("")).alias("label"))


def _named(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = _parts(spark, sf)
    c = entities.entity_clusters(m)
    return m, c, entities.canonical(entities.best_labels(m, c), doc_ns())


@query("canonical_iri", "select doc, leader, base as canonical from part_group")
def canonical_iri(spark, sf):
    return _named(spark, sf)[2].select("doc", "leader", "canonical")


@query("canonical_suffix", "select doc, leader, canonical || case when n > 0 then '_' || n else '' end as canonical from (select *, row_number() over (partition by doc, canonical order by leader) - 1 as n from (select 'p' as doc, p_partkey as leader, 'https://example.com/doc/p/' || coalesce(nullif(trim(regexp_replace(p_name, '[^\\pL\\pN_\\-.]+', '_', 'g'), '_'), ''), 'entity') as canonical from part))")
def canonical_suffix(spark, sf):
    p = table(spark, sf, "part").select(F.lit("p").alias("doc"), F.col("p_partkey").alias("leader"), F.col("p_name").alias("local_name"))
    return entities.canonical(p, doc_ns()).select("doc", "leader", "canonical")


@query(
    "rewrite_triples",
    f"select t.doc, t.chunk_ord, '{DOCS}' || t.doc || '/chunk/' || t.hid as chunk, coalesce(g.base, t.s) as s, s_kind, p, o, o_kind, o_dt, o_lang from t_part t left join part_m m on m.doc = t.doc and m.e = t.s left join part_cluster c on c.doc = m.doc and c.i = m.i left join part_group g on g.doc = c.doc and g.leader = c.leader",
)
def rewrite_triples(spark, sf):
    m, c, g = _named(spark, sf)
    none = spark.createDataFrame([], "doc string, original string, canonical string")
    return entities.rewritten(t_part(spark, sf), entities.mapping(m, c, g, "e"), none, chunk_of())


@query("lineage", f"select distinct doc, s, 'iri' as s_kind, p, o, 'iri' as o_kind, null::varchar as o_dt, null::varchar as o_lang from (select doc, '{DOCS}' || doc || '/chunk/' || hid as s, '{V.TYPE}' as p, '{V.PROV}Entity' as o from t_part union all select doc, '{DOCS}' || doc || '/chunk/' || hid, '{V.PROV}wasPartOf', '{DOCS}' || doc from t_part union all select doc, s, '{V.PROV}wasGeneratedBy', '{DOCS}' || doc || '/chunk/' || hid from t_part)")
def lineage(spark, sf):
    t = t_part(spark, sf).withColumn("chunk", chunk_of())
    return entities.lineage(t, t.select("doc", "chunk").distinct(), doc_ns())


@query(
    "aggregate_graph",
    f"""select distinct doc, s, 'iri' as s_kind, p, o, o_kind, o_dt, null::varchar as o_lang from (
    select doc, s, p, o, o_kind, o_dt from part_new
    union all select doc, base, '{V.LABEL}', label, 'literal', null from part_group where label <> ''
    union all select doc, base, '{V.TYPE}', unnest(types), 'iri', null from part_to
    union all select doc, e, '{V.LABEL}', label, 'literal', null from part_m m where label is not null and not exists (from part_to x where x.doc = m.doc and x.e = m.e)
    union all select doc, e, '{V.TYPE}', unnest(types), 'iri', null from part_m m where not exists (from part_to x where x.doc = m.doc and x.e = m.e)
    union all select doc, '{DOCS}' || doc || '/chunk/' || hid, '{V.TYPE}', '{V.PROV}Entity', 'iri', null from t_part
    union all select doc, '{DOCS}' || doc || '/chunk/' || hid, '{V.PROV}wasPartOf', '{DOCS}' || doc, 'iri', null from t_part
    union all select doc, s, '{V.PROV}wasGeneratedBy', '{DOCS}' || doc || '/chunk/' || hid, 'iri', null from part_new where starts_with(s, '{DOCS}' || doc || '/'))""",
)
def aggregate_graph(spark, sf):
    return entities.aggregated(t_part(spark, sf), doc_ns(), chunk_of())


def _led(edges: str, nodes: str, name: str) -> str:
    """Greedy leaders of numbered nodes, and who is led by whom: {name}_cluster (doc, i, leader)."""
    return f"""{name}_adj as materialized (select doc, i2 as i, list(i1) as lower_ones from {edges} group by all
), {name}_lead as (
    select doc, 0::bigint as i, []::bigint[] as leaders from (select distinct doc from {nodes})
    union all select l.doc, l.i + 1, case when list_has_any(coalesce(a.lower_ones, []), l.leaders) then l.leaders else list_append(l.leaders, l.i + 1) end
    from {name}_lead l left join {name}_adj a on a.doc = l.doc and a.i = l.i + 1 where l.i < (select max(i) from {nodes} m where m.doc = l.doc)
), {name}_led as (select e.doc, i2 as i, min(i1) as leader from {edges} e join (select doc, unnest(max_by(leaders, i)) as i from {name}_lead group by doc) l on l.doc = e.doc and l.i = e.i1 group by all
), {name}_cluster as materialized (from {name}_led union all select distinct doc, leader, leader from {name}_led)"""


def _name_of(iri: str) -> str:
    return f"split_part({iri}, case when contains({iri}, '#') then '#' else '/' end, -1)"


_RATIO = "200.0 * " + _LCS.format(a="x", b="y") + " / (length(x) + length(y))"
_AGGREGATED = f""", e_seen as (
    select doc, chunk_ord, e, min([triple_ord, pos]) as place from (select doc, chunk_ord, triple_ord, s as e, 0 as pos from t_pred union all select doc, chunk_ord, triple_ord, o, 1 from t_pred where o_kind = 'iri') group by all
), e_named as (
    select doc, chunk_ord, s as e, max_by(o, triple_ord) filter (p = '{V.LABEL}') as label, min(triple_ord) as named_at from t_pred where o_kind = 'literal' and p in ('{V.LABEL}', '{V.COMMENT}') group by all
), e_type as (select doc, s as e, list_sort(list(distinct o)) as types from t_pred where p = '{V.TYPE}' and o_kind = 'iri' group by all
), e_m as materialized (
    select doc, e, {_name_of("e")} as local_name, label, types, row_number() over (partition by doc order by ord, e) as i from (
        select doc, e, nullif(max_by(coalesce(label, ''), chunk_ord), '') as label, coalesce(any_value(types), []) as types,
            min([chunk_ord, (named_at is null)::int, coalesce(named_at, place[1]), case when named_at is null then place[2] else 0 end]) as ord
        from e_seen left join e_named using (doc, chunk_ord, e) left join e_type using (doc, e) group by doc, e)
), e_pair as (
    select a.doc, a.i as i1, b.i as i2, lower(a.local_name) = lower(b.local_name) as same, list_has_any(a.types, b.types) as share, lower(a.label) as x, lower(b.label) as y
    from e_m a join e_m b on a.doc = b.doc and a.i < b.i where len(a.types) = 0 or len(b.types) = 0 or list_has_any(a.types, b.types)
), e_edge as materialized (
    select doc, i1, i2 from e_pair where same or (x is not null and y is not null and {_RATIO} >= case when share then 90 else 85 end)
), {_led("e_edge", "e_m", "e")}, e_group as materialized (
    select doc, leader, '{DOCS}' || doc || '/' || max_by(local_name, (coalesce(length(label), 0), -i)) as base, max_by(coalesce(label, ''), (coalesce(length(label), 0), -i)) as label from e_m join e_cluster using (doc, i) group by doc, leader
), e_to as materialized (select m.doc, e, types, base from e_m m join e_cluster c using (doc, i) join e_group g on g.doc = c.doc and g.leader = c.leader
), p_m as materialized (
    select *, {_name_of("pred")} as local_name, row_number() over (partition by doc order by c, place, pred) as i from (
        select doc, pred, min(chunk_ord) as c, min_by(place, chunk_ord) as place, {', '.join(map(_long, ('label', 'comment', 'domain', 'range')))}, bool_or(is_explicit) as is_explicit from ({_INFO}) group by doc, pred)
), p_pair as (
    select a.doc, a.i as i1, b.i as i2, lower(a.local_name) = lower(b.local_name) as same, lower(a.label) as x, lower(b.label) as y from p_m a join p_m b on a.doc = b.doc and a.i < b.i
    where (a.domain is null or b.domain is null or a.domain = b.domain) and (a.range is null or b.range is null or a.range = b.range)
), p_edge as materialized (select doc, i1, i2 from p_pair where same or (x is not null and y is not null and {_RATIO} >= 85)
), {_led("p_edge", "p_m", "p")}, p_group as materialized (
    select doc, leader, '{DOCS}' || doc || '/' || max_by(local_name, ((label is not null)::int + (comment is not null)::int + (domain is not null)::int + (range is not null)::int, -i)) as base,
        {', '.join(f"max_by({c}, (length({c}), -i)) filter ({c} is not null) as {c}" for c in ('label', 'comment', 'domain', 'range'))}, bool_or(is_explicit) as is_explicit
    from p_m join p_cluster using (doc, i) group by doc, leader
), p_to as materialized (select m.doc, pred, base from p_m m join p_cluster c using (doc, i) join p_group g on g.doc = c.doc and g.leader = c.leader
), p_all as materialized (
    select doc, base as pred, label, comment, domain, range, is_explicit from p_group
    union all select doc, pred, label, comment, domain, range, is_explicit from p_m m where starts_with(pred, '{DOCS}' || doc || '/') and not exists (from p_to x where x.doc = m.doc and x.pred = m.pred)
), fresh as materialized (
    select t.doc, hid, coalesce(x.base, t.s) as s, coalesce(z.base, t.p) as p, coalesce(y.base, t.o) as o, o_kind from t_pred t
    left join e_to x on x.doc = t.doc and x.e = t.s left join e_to y on y.doc = t.doc and y.e = t.o and t.o_kind = 'iri' left join p_to z on z.doc = t.doc and z.pred = t.p
)
select distinct doc, s, 'iri' as s_kind, p, o, o_kind, null::varchar as o_dt, null::varchar as o_lang from (
    select doc, s, p, o, o_kind from fresh
    union all select doc, base, '{V.LABEL}', label, 'literal' from e_group where label <> ''
    union all select doc, base, '{V.TYPE}', unnest(types), 'iri' from e_to
    union all select doc, e, '{V.LABEL}', label, 'literal' from e_m m where label is not null and not exists (from e_to x where x.doc = m.doc and x.e = m.e)
    union all select doc, e, '{V.TYPE}', unnest(types), 'iri' from e_m m where not exists (from e_to x where x.doc = m.doc and x.e = m.e)
    union all select doc, pred, '{V.LABEL}', label, 'literal' from p_all
    union all select doc, pred, '{V.COMMENT}', comment, 'literal' from p_all
    union all select doc, pred, '{V.DOMAIN_OF}', domain, 'iri' from p_all
    union all select doc, pred, '{V.RANGE}', range, 'iri' from p_all
    union all select doc, pred, '{V.TYPE}', '{V.PROPERTY}', 'iri' from p_all where is_explicit
    union all select doc, '{DOCS}' || doc || '/chunk/' || hid, '{V.TYPE}', '{V.PROV}Entity', 'iri' from t_pred
    union all select doc, '{DOCS}' || doc || '/chunk/' || hid, '{V.PROV}wasPartOf', '{DOCS}' || doc, 'iri' from t_pred
    union all select doc, s, '{V.PROV}wasGeneratedBy', '{DOCS}' || doc || '/chunk/' || hid, 'iri' from fresh where starts_with(s, '{DOCS}' || doc || '/'))
where o is not null"""


@query("aggregate_predicates", _AGGREGATED)
def aggregate_predicates(spark, sf):
    """Predicates of two chunks are merged and renamed wherever they stand, as predicates, subjects and objects."""
    return entities.aggregated(t_pred(spark, sf), doc_ns(), chunk_of())


@query("predicate_clusters", _AGGREGATED[: _AGGREGATED.index("), p_group as")] + ") select doc, i, leader from p_cluster")
def predicate_clusters(spark, sf):
    return entities.leaders(entities.predicate_edges(written(entities.numbered(entities.predicate_meta(entities.predicate_info(t_pred(spark, sf)))), "predicates")))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").alias("ord"), F.col("text").alias("sentence"))


@query("context_window", "select doc, ord, sentence, coalesce(lag(sentence, 2) over w, '') || coalesce(lag(sentence) over w, '') || sentence || coalesce(' ' || lead(sentence) over w, '') || coalesce(' ' || lead(sentence, 2) over w, '') as combined from conv window w as (partition by doc order by ord)")
def context_window(spark, sf):
    return chunking.with_context(conversations(spark, sf), 2)


def dist(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.distances(table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("doc"), F.col("vec_id").alias("ord"), "embedding")).drop("embedding")


@query("cosine_distances", "select doc, ord, round(distance, 6) as distance from dist")
def cosine_distances(spark, sf):
    return dist(spark, sf).withColumn("distance", F.round("distance", 6))


def _limit(name: str, kind: str, sql: str, source: str = "dist") -> None:
    query(name, f"select doc, round({sql}, 6) as threshold from {source} group by doc")(lambda spark, sf: chunking.thresholds(dist(spark, sf), kind).withColumn("threshold", F.round("threshold", 6)))


_limit("bp_percentile", "percentile", "quantile_cont(distance, 0.95)")
_limit("bp_stddev", "standard_deviation", "avg(distance) + 3 * stddev_pop(distance)")
_limit("bp_iqr", "interquartile", "avg(distance) + 1.5 * (quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25))")
_limit("bp_gradient", "gradient", "quantile_cont(gradient, 0.95)", "grad")


@query("bp_clusters", "select doc, round(d[lo + 1] + (x - lo) * (d[least(lo + 2, n)] - d[lo + 1]), 6) as threshold from (select *, floor(x)::bigint as lo from (select doc, list_sort(list(distance)) as d, count(*) as n, greatest(n - 5, 0)::double as x from dist group by doc))")
def bp_clusters(spark, sf):
    return chunking.threshold_for_chunks(dist(spark, sf), 5).withColumn("threshold", F.round("threshold", 6))


@query("breakpoints", "select doc, ord from dist join (select doc, quantile_cont(distance, 0.95) as t from dist group by doc) using (doc) where distance > t")
def breakpoints(spark, sf):
    d = dist(spark, sf)
    return chunking.breakpoints(d, chunking.thresholds(d))


@query(
    "size_merge_chunks",
    """, n as (select doc, row_number() over (partition by doc order by ord) as k, count(*) over (partition by doc) as many, sentence, ord % 2 = 1 as cut from conv
), f as (
    select doc, k, many, 0 as chunk, sentence as held, (cut and length(sentence) >= 200) or k = many as done from n where k = 1
    union all select n.doc, n.k, n.many, f.chunk + f.done::int, case when f.done then n.sentence else f.held || ' ' || n.sentence end as h, (n.cut and length(h) >= 200) or n.k = n.many from f join n on n.doc = f.doc and n.k = f.k + 1
) select doc, chunk as chunk_ord, held as text from f where done""",
)
def size_merge_chunks(spark, sf):
    c = conversations(spark, sf)
    return chunking.slices(c, c.where("ord % 2 = 1"), 200)


@query("chunk_start_index", "select doc, ord as chunk_ord, sentence as text, coalesce(sum(length(sentence)) over (partition by doc order by ord rows between unbounded preceding and 1 preceding), 0)::bigint as start_index from conv")
def chunk_start_index(spark, sf):
    return chunking.start_indices(conversations(spark, sf).select("doc", F.col("ord").alias("chunk_ord"), F.col("sentence").alias("text")))


@query("chunk_head", "select doc, ord, sentence from (select *, row_number() over (partition by doc order by ord) as k from conv) where k <= 3")
def chunk_head(spark, sf):
    """The first three chunks of each document, in its order."""
    return chunking.head(conversations(spark, sf), 3, "ord")


@query("excerpt", "select doc_id, substr(text, 1, 1000) || ' ...' as excerpt from documents")
def excerpt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ids.excerpt("text").alias("excerpt"))


@query("sentence_split", r"select doc_id::varchar as doc, unnest(p) as sentence, unnest(range(len(p)))::int as ord from (select doc_id, list_transform(string_split(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) as p0, list_filter(p0, lambda x: x <> '') as p from documents)")
def sentence_split(spark, sf):
    """Ordinals count what is left, from 0."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text")
    return chunking.sentences(d, chunking.PLAIN)


@query("json_text", "select conv_id, turn, case when turn % 2 = 0 then text else '# JSON Data' || chr(10) || chr(10) || '**conv**: ' || conv_id || chr(10) || '**turn**: ' || turn || chr(10) || '**role**: ' || replace(role, '*', '-') || chr(10) || chr(10) end as text from conversations")
def json_text(spark, sf):
    """Documents with a text, and without one but with fields."""
    c = table(spark, sf, "conversations")
    doc = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("text", "role"))).otherwise(F.to_json(F.struct(F.col("conv_id").alias("conv"), "turn", "role")))
    return c.select("conv_id", "turn", jsonmd.text_of(doc).alias("text"))


@query("json_to_md", "select event_id, '# JSON Data' || chr(10) || chr(10) || '**k**: ' || json_extract_string(props, '$.k') || chr(10) || chr(10) as md from events")
def json_to_md(spark, sf):
    return table(spark, sf, "events").select("event_id", jsonmd.of_json(F.col("props")).alias("md"))


@query("turtle_roundtrip", f"select doc, chunk_ord, {', '.join(V.TRIPLE)} from t_part")
def turtle_roundtrip(spark, sf):
    t = turtle.rendered(t_part(spark, sf), "doc", "chunk_ord")
    return turtle.triples_of(t, "turtle").select("doc", "chunk_ord", *V.TRIPLE)


@query("graph_sizes", f"select doc, chunk_ord, count(*) filter ({_FACT}) as facts, count(*) filter (not {_FACT}) as ontology from t_mixed group by doc, chunk_ord")
def graph_sizes(spark, sf):
    """Sizes of the two graphs of each chunk."""
    t = graph.split(t_mixed(spark, sf), DOCS)
    return t.groupBy("doc", "chunk_ord").agg(F.count(F.when(F.col("is_fact"), 1)).alias("facts"), F.count(F.when(~F.col("is_fact"), 1)).alias("ontology"))


@query("semantic_chunks")
def semantic_chunks(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text")
    return chunking.chunk_documents(d, chunking.Chunking(max_size=2000, min_size=400))


@query("workflow_run")
def workflow_run(spark, sf):
    c = conversations(spark, sf).select("doc", F.col("ord").cast("int").alias("chunk_ord"), F.col("sentence").alias("text"))
    return workflow.run(c, {"base": []})
