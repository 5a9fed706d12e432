"""Documents as a stream: files that arrive are converted, chunked and split, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions import ids
from graphloom.operators.chunking import Chunking, chunk_documents
from graphloom.sources import files


def arriving(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below path as they come: path, length, content."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)


def chunked(batch: DataFrame, cfg: Chunking = Chunking(), max_chunks: int | None = None) -> DataFrame:  # noqa: B008
    """Chunks of a batch of files, with their identities."""
    docs = files.converted(batch).where("status = 'success'").select(ids.text_hash("text").alias("doc"), "text").dropDuplicates(["doc"])
    c = chunk_documents(docs, cfg, max_chunks).withColumn("hid", ids.text_hash("text"))
    return c.withColumn("chunk_iri", ids.chunk_iri(ids.doc_iri("doc"), "hid"))


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, cfg: Chunking = Chunking(), glob: str = "*", then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:  # noqa: B008
    """Starts a query that appends chunks of new files to out, then stops when all that is there is done. A batch that is run again
    overwrites its own partition."""

    def write(batch: DataFrame, n: int) -> None:
        made = chunked(batch, cfg).withColumn("batch", F.lit(n))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)
        if then:
            then(spark.read.parquet(out).where(F.col("batch") == n), n)

    return arriving(spark, path, glob).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
