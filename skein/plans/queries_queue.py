"""Queue transitions over the whole job table."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import queue as Q
from skein.plans.oracles import cte, iso
from skein.plans.registry import query
from skein.session import staging_path, tune
from skein.sources.bridge import Tables
from skein.streaming import coalesce
from skein.streaming.worker import JOB_SCHEMA
from skein.operators.wiki import iso as iso_col

NOW = "2024-03-01 00:00:00"


def now():
    return F.expr(f"TIMESTAMP_NTZ'{NOW}'")


def big(*cols: str):
    return [F.col(c).cast("bigint").alias(c) for c in cols]


@query("queue_claim_order", f"""
SELECT job_id, job_type, 'processing' AS status, 'worker-1' AS worker_id, '2024-03-01T00:00:00' AS claimed_at, {iso('created_at')} AS created_at
FROM jobs WHERE status = 'pending' AND attempts <= max_retries ORDER BY scheduled_at NULLS FIRST, jobs.created_at, job_id LIMIT 50""")
def queue_claim_order(t: Tables):
    taken = Q.claim_next(t.jobs(), 50, "worker-1", now())
    return taken.select("job_id", "job_type", "status", "worker_id", iso_col(F.col("claimed_at")).alias("claimed_at"), iso_col(F.col("created_at")).alias("created_at"))


@query("queue_claimable", "SELECT job_id, CAST(attempts AS BIGINT) AS attempts FROM jobs WHERE status = 'pending' AND attempts <= max_retries")
def queue_claimable(t: Tables):
    return Q.claimable(t.jobs()).select("job_id", *big("attempts"))


@query("queue_enqueue", f"""
SELECT event_id AS job_id, 'ingest_document' AS job_type, 'pending' AS status, CAST(0 AS BIGINT) AS attempts, CAST(3 AS BIGINT) AS max_retries,
  '{{"file": "' || event_id || '"}}' AS payload, {iso('ts')} AS created_at FROM events""")
def queue_enqueue(t: Tables):
    payload = F.concat(F.lit('{"file": "'), F.col("event_id"), F.lit('"}'))
    rows = t.raw("events").select(*Q.enqueue(F.col("event_id"), F.lit("ingest_document"), payload, F.lit(None).cast("bigint"), F.col("ts")))
    return rows.select("job_id", "job_type", "status", *big("attempts", "max_retries"), "payload", iso_col(F.col("created_at")).alias("created_at"))


@query("queue_fail_transition", """
SELECT job_id, CASE WHEN attempts + 1 <= max_retries THEN 'pending' ELSE 'failed' END AS status, CAST(attempts + 1 AS BIGINT) AS attempts, 'boom' AS error_message
FROM jobs WHERE status = 'processing'""")
def queue_fail_transition(t: Tables):
    return Q.fail(t.jobs().filter("status = 'processing'"), F.lit("boom")).select("job_id", "status", *big("attempts"), "error_message")


@query("queue_complete_release", f"""
SELECT job_id, 'completed' AS status, '2024-03-01T00:00:00' AS completed_at, CAST(attempts AS BIGINT) AS attempts FROM jobs WHERE status = 'processing' AND job_type = 'ingest_document'
UNION ALL SELECT job_id, 'pending', NULL, CAST(attempts AS BIGINT) FROM jobs WHERE status = 'processing' AND job_type <> 'ingest_document'""")
def queue_complete_release(t: Tables):
    """Ingest jobs complete, the others go back to pending without losing an attempt."""
    busy = t.jobs().filter("status = 'processing'")
    done = Q.complete(busy.filter("job_type = 'ingest_document'"), now()).select("job_id", "status", iso_col(F.col("completed_at")).alias("completed_at"), *big("attempts"))
    back = Q.release(busy.filter("job_type <> 'ingest_document'")).select("job_id", "status", F.lit(None).cast("string").alias("completed_at"), *big("attempts"))
    return done.unionByName(back)


cte("entity_heads", """
SELECT target_entity_id, arg_min(job_id, (created_at, job_id)) AS job_id, count(*) - 1 AS duplicates
FROM jobs WHERE job_type = 'synthesize_entity' AND status = 'pending' GROUP BY target_entity_id""")
cte("source_heads", """
SELECT source_key, arg_min(job_id, (created_at, job_id)) AS job_id
FROM jobs WHERE job_type = 'synthesize_source_summary' AND status = 'pending' GROUP BY source_key""")


COALESCED = """
SELECT DISTINCT h.target_entity_id, h.job_id, j.source_key AS source_id, h.duplicates FROM entity_heads h
JOIN jobs j ON j.target_entity_id = h.target_entity_id AND j.job_type = 'synthesize_entity' AND j.status = 'pending'"""


@query("queue_coalesce_entity", COALESCED)
def queue_coalesce_entity(t: Tables):
    return Q.coalesce_entity_jobs(t.jobs())


@query("queue_coalesce_stream", COALESCED)
def queue_coalesce_stream(t: Tables):
    """All jobs delivered as files, every tenth of them twice, and folded by keyed state, some files to a batch."""
    spark = tune(t.spark)
    arrivals, state, checkpoint = (staging_path(spark, f"coalesce-{x}") for x in ("arrivals", "state", "checkpoint"))
    jobs = t.jobs().select(*spark.createDataFrame([], JOB_SCHEMA).columns)
    for part in (jobs, jobs.filter("job_id % 10 = 0")):
        part.write.mode("append").parquet(arrivals)
    coalesce.start(spark, arrivals, state, checkpoint, maxFilesPerTrigger=4).awaitTermination()
    return coalesce.coalesced(spark, state)


@query("queue_bursts", f"""
SELECT target_entity_id, {iso('min(created_at)')} AS started, {iso("max(created_at) + INTERVAL '30' MINUTE")} AS ended, count(*) AS jobs FROM (
  SELECT target_entity_id, created_at, sum(fresh) OVER (PARTITION BY target_entity_id ORDER BY created_at, job_id ROWS UNBOUNDED PRECEDING) AS burst FROM (
    SELECT *, CASE WHEN created_at <= lag(created_at) OVER (PARTITION BY target_entity_id ORDER BY created_at, job_id) + INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS fresh
    FROM jobs WHERE target_entity_id IS NOT NULL AND created_at IS NOT NULL))
GROUP BY target_entity_id, burst""")
def queue_bursts(t: Tables):
    found = coalesce.job_bursts(t.jobs())
    return found.select("target_entity_id", *[iso_col(F.col(c).cast("timestamp_ntz")).alias(c) for c in ("started", "ended")], "jobs")


@query("queue_after_coalescing", """
SELECT j.job_id, CASE WHEN dup THEN 'completed' ELSE status END AS status FROM (
  SELECT j.*, coalesce(j.job_type = 'synthesize_entity' AND j.status = 'pending' AND h.job_id <> j.job_id, false) AS dup
  FROM jobs j LEFT JOIN entity_heads h ON h.target_entity_id = j.target_entity_id) j""")
def queue_after_coalescing(t: Tables):
    return Q.after_coalescing(t.jobs(), now()).select("job_id", "status")


@query("queue_cancel_source", """
SELECT j.job_id, CASE WHEN dup THEN 'completed' ELSE status END AS status, CASE WHEN dup THEN '2024-03-01T00:00:00' END AS completed_at FROM (
  SELECT j.*, coalesce(j.job_type = 'synthesize_source_summary' AND j.status = 'pending' AND h.job_id <> j.job_id, false) AS dup
  FROM jobs j LEFT JOIN source_heads h ON h.source_key = j.source_key) j""")
def queue_cancel_source(t: Tables):
    return Q.after_source_cancel(t.jobs(), now()).select("job_id", "status", iso_col(F.col("completed_at")).alias("completed_at"))


@query("queue_payload_filter", "SELECT job_id FROM jobs WHERE source_key = '7'")
def queue_payload_filter(t: Tables):
    return t.jobs().filter(F.get_json_object("payload", "$.source_id") == "7").select("job_id")
