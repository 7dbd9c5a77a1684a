"""Incremental ingest: new TEI files become chunks of their papers, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import embedding_text
from ..operators.chunking import chunk_documents, sections_of
from ..operators.store import replace_chunks
from ..sources.clients import embedded
from ..sources.tei import paragraph_rows, parsed


def tei_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder as they arrive, ``<paper id>.tei.xml``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.tei.xml").load(folder)
    return files.select(F.regexp_extract("path", r"(\d+)\.tei\.xml$", 1).cast("long").alias("paper_id"), F.decode("content", "UTF-8").alias("xml"), F.struct("modificationTime", "path").alias("version"))


def chunk_rows(files: DataFrame, embed=None) -> DataFrame:
    """Chunks with vectors of ``(paper_id, xml)``."""
    documents = files.where("paper_id is not null").select("paper_id", parsed(F.col("xml")).alias("d")).select("paper_id", "d.*").where("error is null")
    paragraphs = paragraph_rows(documents, "paper_id").withColumn("para_id", F.lit(0).cast("long"))
    chunks = chunk_documents(sections_of(paragraphs), documents.select("paper_id", "abstract"))
    text = embedding_text("section", "content")
    return chunks.withColumn("embedding", embedded(text, embed) if embed else embedded(text))


def ingest_available(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Chunks all files that arrived since the last run and ends; rerunning a batch replaces the same partitions."""

    def write(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("paper_id").agg(F.max_by("xml", "version").alias("xml"))  # the file changed last, of equals the last by path
        replace_chunks(chunk_rows(latest), target)

    return tei_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
