"""Files in and out: crawling, conversion by suffix, ontologies, run states; Turtle, JSON and Parquet sinks."""

from __future__ import annotations

import os
from abc import ABC, abstractmethod
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.functions import ids
from graphloom.functions.vocab import LABEL, OWL, TYPE
from graphloom.sources import jsonmd, turtle

OFFICE = (".pdf", ".ppt", ".pptx")
_CHUNK = "struct<text:string, hid:string, doc_iri:string, graph:string, processed:boolean>"
_ONTOLOGY = "struct<short_name:string, title:string, description:string, version:string, iri:string, graph:string>"
STATE = f"input_text string, current_domain string, doc_hid string, files map<string, string>, current_chunk {_CHUNK}, chunks array<{_CHUNK}>, chunks_processed array<{_CHUNK}>, current_ontology {_ONTOLOGY}, aggregated_facts string, ontology_addendum {_ONTOLOGY}, failure_stage string, failure_reason string, success_score double, status string, node_visits map<string, int>, max_visits int, max_chunks int"


def crawl(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """path, length, content of files below path, in the order of path: the suffix matches in case, the stem begins with prefix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return of_kind(files, suffixes, prefix).orderBy("path")


def of_kind(files: DataFrame, suffixes: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    ok = F.startswith(ids.stem("path"), F.lit(prefix))
    return files.where(ok & ids.suffix("path").isin(*suffixes) if suffixes else ok)


def kind_of(path: Column | str) -> Column:
    """What a file is converted by: office, json, txt, or unsupported (which fails)."""
    s = F.lower(ids.suffix(path))
    return F.when(s.isin(*OFFICE), "office").when(s == ".json", "json").when(s == ".txt", "txt").otherwise("unsupported")


def no_converter(content: bytes) -> str | None:
    """The default for office files: there is no converter here, so they are refused."""
    return None


def converted(files: DataFrame, convert: Callable[[bytes], str | None] = no_converter) -> DataFrame:
    """path, text, status: JSON gives its field text, else all of it as Markdown; .txt files hold a JSON string; office files, and only their bytes, go through
    convert. What gives no text has status failed, null content too."""
    raw, kind = F.decode("content", "UTF-8"), kind_of("path")
    office = F.udf(lambda b: None if b is None else convert(bytes(b)), "string", useArrow=True)(F.when(kind == "office", F.col("content")))
    text = F.when(kind == "json", jsonmd.text_of(raw)).when(kind == "txt", F.get_json_object(F.concat(F.lit('{"t":'), raw, F.lit("}")), "$.t")).when(kind == "office", office)
    return files.select("path", text.alias("text")).withColumn("status", F.when(F.col("text").isNull(), "failed").otherwise("success"))


def pdf_to_markdown(files: DataFrame, convert: Callable[[bytes], str | None]) -> DataFrame:
    """name (of a JSON file) and json, {"text": ...}, of PDF files; another suffix is an error."""
    pdf = F.lower(ids.suffix("path")) == ".pdf"
    checked = files.withColumn("path", F.when(pdf, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("not a PDF: "), "path"))))
    text = converted(checked, convert)
    return text.select(F.concat(ids.stem("path"), F.lit(".json")).alias("name"), F.to_json(F.struct("text"), {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


def write_files(rows: DataFrame, folder: str, name: str = "name", value: str = "json") -> None:
    """A text file for each row. Tasks write them side by side, and again with the same content when they are run again."""
    at = folder if "://" in folder else os.path.abspath(folder)

    def put(part) -> None:
        fs, root = pafs.FileSystem.from_uri(at)
        fs.create_dir(root, recursive=True)
        for n, v in part:
            with fs.open_output_stream(f"{root}/{n}") as f:
                f.write((v or "").encode())

    rows.select(name, value).foreachPartition(put)


def ontologies(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Ontologies of the *.ttl files of a folder, by name, and their triples; a file that can't be read is left out. Title, version and IRI come from
    the ontology's own triples."""
    files = spark.read.option("pathGlobFilter", "*.ttl").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    t = turtle.triples_of(files, "value")
    return summaries(t, "path"), t


def summaries(triples: DataFrame, key: str) -> DataFrame:
    """short_name, title, description, version, iri of each graph, from the subject that is an owl:Ontology; version 0.0.0 unless it has one."""
    head = triples.where((F.col("p") == TYPE) & (F.col("o") == OWL + "Ontology")).groupBy(key).agg(F.min_by("s", "triple_ord").alias("iri"))
    of = triples.join(head, key).where(F.col("s") == F.col("iri"))
    first = lambda *p: F.min_by(F.when(F.col("p").isin(*p), F.col("o")), F.when(F.col("p").isin(*p), F.col("triple_ord")))
    dc = "http://purl.org/dc/terms/"
    return of.groupBy(key, "iri").agg(first(LABEL, dc + "title").alias("title"), first(dc + "description", LABEL.replace("label", "comment")).alias("description"), F.coalesce(first(OWL + "versionInfo"), F.lit("0.0.0")).alias("version")).withColumn("short_name", ids.local_name(F.regexp_replace("iri", "[#/]+$", "")))


def described(ontologies: DataFrame) -> Column:
    """A line each for name, description and IRI."""
    return F.concat_ws("\n", F.concat(F.lit("name: "), "short_name"), F.concat(F.lit("about: "), F.coalesce("description", "title", F.lit(""))), F.concat(F.lit("iri: "), "iri"))


def descriptions(ontologies: DataFrame) -> DataFrame:
    """One text of all, a blank line between two, by name."""
    each = F.array_sort(F.collect_list(F.struct("short_name", described(ontologies).alias("d"))))
    return ontologies.agg(F.array_join(F.transform(each, lambda x: x["d"]), "\n\n").alias("descriptions"))


def states(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Run states of a folder, a row each; a file that isn't JSON is skipped."""
    s = spark.read.schema(STATE).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", glob).json(path)
    return s.withColumn("file", F.col("_metadata.file_path"))


def save_states(states: DataFrame, folder: str, name: Column | str = "doc_hid") -> None:
    """A JSON file for each run state, which states() reads again."""
    fields = [f.name for f in StructType.fromDDL(STATE).fields if f.name in states.columns]
    rows = states.select(F.concat(ids.col(name), F.lit(".json")).alias("name"), F.to_json(F.struct(*fields), {"pretty": "true"}).alias("json"))
    write_files(rows, folder)


def compared(states: DataFrame) -> DataFrame:
    """For each state file the sizes of its graphs and its score, by the number that its name ends with."""
    n = lambda c: F.coalesce(F.size(turtle.parsed(F.col(c), escapes=True)), F.lit(0))
    return states.select("file", ids.trailing_number("file").alias("number"), n("current_chunk.graph").alias("facts"), n("current_ontology.graph").alias("ontology"), n("ontology_addendum.graph").alias("addendum"), F.col("success_score")).orderBy("number", "file")


class GraphStore(ABC):
    """Where ontologies and facts go."""

    @abstractmethod
    def ontologies(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]: ...

    @abstractmethod
    def write_facts(self, triples: DataFrame, spec: Column | None = None) -> None: ...

    @abstractmethod
    def write_ontology(self, triples: DataFrame) -> None: ...


class FolderStore(GraphStore):
    """Each graph as a Turtle file of its name, and all as Parquet: facts and ontologies in folders of their own, by run, so that a run that is repeated
    replaces its own triples and nothing else."""

    def __init__(self, folder: str, ontology_folder: str | None = None, run: str = "current", prefixes: dict[str, str] | None = None):
        self.folder, self.ontology_folder, self.run, self.prefixes = folder.rstrip("/"), ontology_folder, run, prefixes

    def ontologies(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        if self.ontology_folder is None:
            none = spark.createDataFrame([], "path string, triple_ord bigint, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string")
            return summaries(none, "path"), none
        return ontologies(spark, self.ontology_folder)

    def _write(self, triples: DataFrame, kind: str) -> None:
        out = f"{self.folder}/{kind}"
        triples.withColumn("run", F.lit(self.run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(out)
        back = triples.sparkSession.read.parquet(out).where(F.col("run") == self.run)  # made once, whatever it costs
        write_files(turtle.rendered(back, "file", prefixes=self.prefixes), self.folder, "file", "turtle")

    def write_facts(self, triples: DataFrame, spec: Column | None = None) -> None:
        self._write(triples.withColumn("file", ids.facts_filename(F.lit(None).cast("string") if spec is None else spec)), "facts")

    def write_ontology(self, triples: DataFrame) -> None:
        self._write(triples.withColumn("file", ids.ontology_filename("short_name", "version")), "ontologies")


def chunk_json(chunks: DataFrame) -> DataFrame:
    """doc and a JSON text of its chunks in order."""
    c = F.transform(F.array_sort(F.collect_list(F.struct("chunk_ord", "text"))), lambda x: x["text"])
    return chunks.groupBy("doc").agg(F.to_json(F.struct(c.alias("chunks"))).alias("json"))


def response(results: DataFrame) -> DataFrame:
    """The JSON answer to a document: Turtle of facts and ontology, status, and chunks_processed, which counts those still waiting."""
    data = F.struct(F.col("facts"), F.col("ontology"))
    meta = F.struct("status", F.col("waiting").alias("chunks_processed"))
    return results.select("doc", F.to_json(F.struct("status", data.alias("data"), meta.alias("metadata"))).alias("json"))


def failed(error: Column | str, kind: Column | str) -> Column:
    """The JSON answer when a document can't be processed."""
    return F.to_json(F.struct(F.lit("error").alias("status"), ids.col(error).alias("error"), ids.col(kind).alias("error_type")))


def bodies(requests: DataFrame) -> DataFrame:
    """Rows of content_type, body (and name, of a part of a form) as files: path, content, and code, 400 for any other type."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    ok = kind.isin("application/json", "multipart/form-data")
    path = F.when(kind == "application/json", F.lit("input.json")).when(ok, F.coalesce("name", F.lit("input.json")))
    return requests.withColumns({"path": path, "content": F.when(ok, F.col("body")), "code": F.when(ok, F.lit(200)).otherwise(F.lit(400))}).drop("body")
