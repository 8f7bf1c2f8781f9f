"""Validation of uploads and the rows an accepted upload leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skein.config import DEFAULTS, Settings


def validate_uploads(uploads: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds ``problem`` (NULL when accepted) to ``uploads(source_id, file_name, size, metadata)``."""
    parsed = F.try_parse_json("metadata")
    problem = (
        F.when(F.coalesce("file_name", F.lit("")) == "", "missing file name")
        .when(F.col("size") > settings.upload_max_bytes, "file too large")
        .when(F.col("size") == 0, "empty file")
        .when(F.col("metadata").isNotNull() & parsed.isNull(), "metadata is not valid JSON")
        .when(F.col("metadata").isNotNull() & ~F.schema_of_variant(parsed).startswith("OBJECT"), "metadata must be a JSON object")
    )
    return uploads.withColumn("problem", problem)


def accepted(uploads: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """``(sources, jobs)`` rows of the uploads that pass: a pending source and its ingest job."""
    good = validate_uploads(uploads, settings).filter("problem IS NULL")
    key = F.concat(F.lit("sources/"), F.col("source_id").cast("string"))
    sources = good.select(
        "source_id", key.alias("storage_key"), "file_name", F.col("size").alias("file_size"),
        F.lit("pending").alias("status"), "metadata")
    jobs = good.select(
        "source_id", F.lit("ingest_document").alias("job_type"),
        F.concat(F.lit('{"source_id": "'), F.col("source_id").cast("string"), F.lit('", "storage_key": "'), key, F.lit('"}')).alias("payload"),
        F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(settings.worker_max_retries).alias("max_retries"))
    return sources, jobs
