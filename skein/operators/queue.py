"""The job queue as state transitions over a job table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skein.config import DEFAULTS
from skein.operators.ranking import page


def enqueue(job_id: Column, job_type: Column, payload: Column, target: Column, at: Column,
            scheduled_at: Column | None = None) -> list[Column]:
    """Columns of a fresh job row."""
    return [
        job_id.alias("job_id"), job_type.alias("job_type"), target.alias("target_entity_id"), payload.alias("payload"),
        F.lit("pending").alias("status"),
        (F.lit(None).cast("timestamp_ntz") if scheduled_at is None else scheduled_at).alias("scheduled_at"),
        F.lit(0).alias("attempts"), F.lit(DEFAULTS.worker_max_retries).alias("max_retries"), at.alias("created_at"),
    ]


def claimable(jobs: DataFrame) -> DataFrame:
    return jobs.filter((F.col("status") == "pending") & (F.col("attempts") <= F.col("max_retries")))


def claim_order() -> list[Column]:
    """Unscheduled first, then by schedule, then by age. A schedule in the future does not hold a job back."""
    return [F.col("scheduled_at").asc_nulls_first(), F.col("created_at"), F.col("job_id")]


def claim_next(jobs: DataFrame, n: int, worker_id: str, now: Column | None = None) -> DataFrame:
    """The next ``n`` jobs, marked as processing: a top-n heap per partition, no global sort."""
    taken = page(claimable(jobs), claim_order(), 0, n, n)
    return taken.withColumns({"status": F.lit("processing"), "worker_id": F.lit(worker_id),
                              "claimed_at": now if now is not None else F.localtimestamp()})


def complete(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.withColumns({"status": F.lit("completed"), "completed_at": now})


def release(jobs: DataFrame) -> DataFrame:
    """Back to pending without counting an attempt."""
    return jobs.withColumns({"status": F.lit("pending"), "claimed_at": F.lit(None).cast("timestamp_ntz"),
                             "worker_id": F.lit(None).cast("string")})


def fail(jobs: DataFrame, error: Column) -> DataFrame:
    """One more attempt; retried while attempts do not exceed the retries, so 3 retries allow 4 runs."""
    attempts = F.col("attempts") + 1
    again = attempts <= F.col("max_retries")
    cleared = {c: F.when(~again, F.col(c)) for c in ("claimed_at", "worker_id") if c in jobs.columns}
    return jobs.withColumns({"status": F.when(again, "pending").otherwise("failed"), "attempts": attempts,
                             "error_message": error, **cleared})


def coalesce_entity_jobs(jobs: DataFrame) -> DataFrame:
    """Pending synthesis jobs per entity folded into the first: ``(target_entity_id, job_id, source_id, duplicates)``.

    One row per (entity, source), aggregated on the map side, so a hot entity never becomes one long list.
    """
    pending = jobs.filter((F.col("job_type") == "synthesize_entity") & (F.col("status") == "pending"))
    head = pending.groupBy("target_entity_id").agg(
        F.min(F.struct("created_at", "job_id"))["job_id"].alias("job_id"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    ids = F.from_json(F.get_json_object("payload", "$.source_ids"), "array<string>")
    told = pending.select("target_entity_id", F.explode_outer(ids).alias("source_id")).distinct()
    return told.join(head, "target_entity_id").select("target_entity_id", "job_id", "source_id", "duplicates")


def after_coalescing(jobs: DataFrame, now: Column) -> DataFrame:
    """Job table once duplicates are completed: every pending entity job but the first of its entity."""
    mine = (F.col("job_type") == "synthesize_entity") & (F.col("status") == "pending")
    head = jobs.filter(mine).groupBy("target_entity_id").agg(
        F.min(F.struct("created_at", "job_id"))["job_id"].alias("_head"))
    return _complete_duplicates(jobs.join(head, "target_entity_id", "left"), mine, now)


def after_source_cancel(jobs: DataFrame, now: Column) -> DataFrame:
    """Pending source summaries of one source: the first stays, the others are completed."""
    source = F.get_json_object("payload", "$.source_id")
    mine = (F.col("job_type") == "synthesize_source_summary") & (F.col("status") == "pending") & source.isNotNull()
    keyed = jobs.withColumn("_source", source)
    head = keyed.filter(mine).groupBy("_source").agg(F.min(F.struct("created_at", "job_id"))["job_id"].alias("_head"))
    return _complete_duplicates(keyed.join(head, "_source", "left").drop("_source"), mine, now)


def _complete_duplicates(jobs: DataFrame, mine: Column, now: Column) -> DataFrame:
    dup = F.coalesce(mine & (F.col("job_id") != F.col("_head")), F.lit(False))
    return jobs.withColumns({"completed_at": F.when(dup, now), "status": F.when(dup, "completed").otherwise(F.col("status"))}).drop("_head")
