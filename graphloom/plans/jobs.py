"""Whole jobs: a folder of documents to graphs, run states to a report, files to Markdown or chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import ids
from graphloom.functions.vocab import DOMAIN, PREFIXES, PROV
from graphloom.operators import graph
from graphloom.operators.chunking import Chunking, Hashed, chunk_documents
from graphloom.operators.entities import aggregated
from graphloom.plans import workflow
from graphloom.plans.models import Model, Rules
from graphloom.session import written
from graphloom.sources import files, jsonmd, turtle

VERSION = "0.1.0"


@dataclass(frozen=True)
class Config:
    """What a job is made of: limits, and the parts that can be exchanged: model, converter of office files, embedder of texts, folder of ontologies."""

    domain: str = DOMAIN
    max_visits: int = 3
    max_chunks: int | None = None
    chunking: Chunking = field(default_factory=Chunking)
    model: Callable[[], Model] = Rules
    converter: Callable[[bytes], str | None] = files.no_converter
    embed: Callable = field(default_factory=Hashed)
    ontology_folder: str | None = None
    run: str = "current"


class Result(NamedTuple):
    """Triples of the aggregated graph of each document, the log of its run, and what it added to ontologies (doc, short_name and triples)."""

    graphs: DataFrame
    log: DataFrame
    added: DataFrame


def process(docs: DataFrame, cfg: Config = Config(), registry: dict[str, list[tuple]] | None = None) -> Result:  # noqa: B008
    """Documents (text) through the workflow, once; each chunk's facts are connected by a hub where they need one, and aggregated. Equal texts are one document."""
    docs = docs.select(ids.text_hash("text").alias("doc"), "text").where("text is not null").dropDuplicates(["doc"])
    chunks = written(chunk_documents(docs, cfg.chunking, cfg.max_chunks, cfg.embed), "chunks")
    done = written(workflow.run_all(chunks, registry, cfg.model, cfg.max_visits, cfg.domain), "run")
    none = F.lit(None).cast("string")
    facts = workflow.of_kind(done, "facts").withColumns({"o_dt": none, "o_lang": none})
    chunk = ids.chunk_iri(ids.doc_iri("doc", cfg.domain), "hid")
    reps = graph.representatives(graph.components(facts), graph.degrees(facts))
    hubs = graph.hub_triples(reps, chunk).withColumn("triple_ord", F.lit(1 << 40))  # after all that the model said
    t = written(facts.unionByName(hubs.select(facts.columns)), "triples")
    graphs = aggregated(t, F.concat(ids.doc_iri("doc", cfg.domain), F.lit("/")), chunk)
    return Result(graphs, workflow.of_kind(done, "log"), workflow.of_kind(done, "added"))


def registry_of(spark: SparkSession, store: files.GraphStore) -> tuple[DataFrame, dict[str, list[tuple]]]:
    """The ontologies' heads, and their triples as models are shown them; so they fit a driver."""
    heads, triples = store.ontologies(spark)
    named = triples.join(heads.select("path", "short_name"), "path").select("short_name", "triple_ord", "s", "s_kind", "p", "o", "o_kind")
    registry: dict[str, list[tuple]] = {}
    for r in named.orderBy("short_name", "triple_ord").collect():
        registry.setdefault(r[0], []).append(tuple(r)[2:])
    return heads, registry


def prefixes_of(heads: DataFrame, domain: str) -> dict[str, str]:
    """What Turtle of a run binds: a prefix for each ontology, its name, and those of provenance and the domain."""
    of = graph.Window.partitionBy("graph_id").orderBy("short_name", "iri")
    bound = heads.select(F.lit("run").alias("graph_id"), F.regexp_replace("short_name", r"[^A-Za-z0-9_]", "_").alias("prefix"), F.col("iri").alias("uri"), "short_name", "iri")
    bound = graph.one_prefix_each(graph.without_chunk_prefixes(bound)).withColumn("ord", F.row_number().over(of))
    merged = graph.merged_namespaces(bound, {})
    return PREFIXES | {r.prefix: r.uri for r in merged.collect()} | {"prov": PROV, "cd": f"{domain}/"}


def run_batch(spark: SparkSession, folder: str, out: str, cfg: Config = Config(), ontology_folder: str | None = None) -> None:  # noqa: B008
    """Files of a folder to Turtle and Parquet: facts of each document, and every ontology that the run used or made, with what it added."""
    first = files.FolderStore(out, ontology_folder or cfg.ontology_folder)
    heads, registry = registry_of(spark, first)
    store = files.FolderStore(out, first.ontology_folder, cfg.run, prefixes_of(heads, cfg.domain))
    found = files.converted(files.crawl(spark, folder, (*files.OFFICE, ".json", ".txt")), cfg.converter)
    result = process(found.where("status = 'success'"), cfg, registry)
    store.write_facts(result.graphs, ids.namespace(ids.doc_iri("doc", cfg.domain)))
    store.write_ontology(ontologies_after(heads, registry, result.added))
    result.log.write.mode("overwrite").parquet(f"{out}/log")
    found.where("status <> 'success'").select("path", "status").write.mode("overwrite").parquet(f"{out}/failed")


def ontologies_after(heads: DataFrame, registry: dict[str, list[tuple]], added: DataFrame) -> DataFrame:
    """short_name, version and triples of the registry's ontologies together with what documents added to them, and of new ones (version 0.0.0)."""
    spark = added.sparkSession
    before = spark.createDataFrame([(k, *t) for k, ts in registry.items() for t in ts], "short_name string, s string, s_kind string, p string, o string, o_kind string")
    none = F.lit(None).cast("string")
    both = before.unionByName(added.select(before.columns)).distinct().withColumns({"o_dt": none, "o_lang": none})
    return both.join(heads.groupBy("short_name").agg(F.min("version").alias("version")), "short_name", "left").withColumn("version", F.coalesce("version", F.lit("0.0.0")))


def respond(requests: DataFrame, cfg: Config = Config(), registry: dict[str, list[tuple]] | None = None) -> DataFrame:  # noqa: B008
    """code and the JSON answer to each request (content_type, body): Turtle of the facts and of the ontology's additions, or the error: 400 for a type that isn't read,
    500 for a body without a text. The models run once over all requests."""
    asked = written(files.bodies(requests).withColumn("id", F.monotonically_increasing_id()), "requests")
    read = files.converted(asked.where("code = 200").withColumn("path", F.concat(F.col("id").cast("string"), F.lit("/"), "path")), cfg.converter)
    read = written(read.withColumn("id", F.substring_index("path", "/", 1).cast("bigint")).withColumn("doc", ids.text_hash("text")), "read")
    result = process(read, cfg, registry)
    facts = turtle.rendered(result.graphs, "doc").withColumnRenamed("turtle", "facts")
    none = F.lit(None).cast("string")
    onto = turtle.rendered(result.added.withColumns({"o_dt": none, "o_lang": none}), "doc").withColumnRenamed("turtle", "ontology")
    ok = read.where("text is not null").join(facts, "doc", "left").join(onto, "doc", "left").withColumns({"facts": F.coalesce("facts", F.lit("")), "ontology": F.coalesce("ontology", F.lit("")), "waiting": F.lit(0)})
    ok = ok.select("id", F.lit(200).alias("code"), F.to_json(F.struct("status", F.struct("facts", "ontology").alias("data"), F.struct("status", F.col("waiting").alias("chunks_processed")).alias("metadata"))).alias("json"))
    bad = asked.where("code = 400").select("id", "code", files.failed(F.lit("unsupported content type"), F.lit("ContentType")).alias("json"))
    bad = bad.unionByName(read.where("text is null").select("id", F.lit(500).alias("code"), files.failed(F.lit("no text"), F.lit("KeyError")).alias("json")))
    return ok.unionByName(bad).select("code", "json")


def pdfs_to_markdown(spark: SparkSession, folder: str, out: str, convert: Callable[[bytes], str | None], prefix: str = "") -> None:
    """The PDF files of a folder as JSON files of their Markdown."""
    files.write_files(files.pdf_to_markdown(files.crawl(spark, folder, (".pdf",), prefix), convert), out)


def split_chunks(spark: SparkSession, folder: str, out: str, cfg: Config = Config(), prefix: str = "") -> None:  # noqa: B008
    """The JSON files of a folder as JSON files of their semantic chunks. A file with neither a text nor more than two fields is an error."""
    found = files.crawl(spark, folder, (".json",), prefix).withColumn("raw", F.decode("content", "UTF-8"))
    text = F.coalesce(jsonmd.text_of(F.col("raw")), F.raise_error(F.concat(F.lit("neither text nor fields: "), "path")).cast("string"))
    docs = found.select(F.concat(ids.stem("path"), F.lit(".json")).alias("doc"), text.alias("text"))
    chunks = chunk_documents(docs, cfg.chunking, cfg.max_chunks, cfg.embed)
    files.write_files(files.chunk_json(chunks), out, "doc")


def compare_runs(spark: SparkSession, folder: str) -> DataFrame:
    return files.compared(files.states(spark, folder))


def diagram() -> str:
    """The workflow as Mermaid text."""
    name = lambda n: n.title().replace(" ", "") if n else "[*]"
    lines = ["stateDiagram-v2", f"    [*] --> {name(workflow.NODES[0])}"]
    for node, (ok, again) in workflow.EDGES.items():
        lines.append(f"    {name(node)} --> {name(ok)}" + (": success" if again != ok else ""))
        if again != ok:
            lines.append(f"    {name(node)} --> {name(again)}: failure")
    return "\n".join(lines) + "\n"


def health() -> dict:
    return {"status": "healthy"}


def info() -> dict:
    return {"name": "graphloom", "version": VERSION, "input": ["application/json", *files.OFFICE], "output": ["turtle", "parquet"], "capabilities": ["chunking", "facts", "ontology", "aggregation", "streaming"]}
