"""Landing folder to chunk table: chunking keeps no state, so the batch expressions run on the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.operators.chunking import chunk_documents
from skein.sources.readers import MARKDOWN, decoded

LANDED = "path string, modificationTime timestamp, length bigint, content binary"


def landed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming chunks ``(source_key, chunk_index, text_content, section_heading)`` of text files that arrive."""
    files = spark.readStream.format("binaryFile").schema(LANDED).option("recursiveFileLookup", "true").load(folder)
    markdown = F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1)).isin(MARKDOWN)
    texts = files.select(F.col("path").alias("source_key"), decoded(F.col("content")).alias("text"), markdown.alias("md"))
    return chunk_documents(texts, "source_key", "text", F.col("md"))


def run_once(chunks: DataFrame, table: str, checkpoint: str) -> None:
    """Append everything that has landed since the last run."""
    chunks.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
