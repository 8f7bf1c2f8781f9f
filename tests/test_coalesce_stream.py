"""Keyed streaming state against the batch operators."""

import datetime as dt

from skein.operators import queue as Q
from skein.streaming import coalesce as C
from skein.streaming.worker import JOB_SCHEMA

T0 = dt.datetime(2024, 1, 1)


def job(i, entity, minutes, sources='["a"]', kind="synthesize_entity", status="pending"):
    payload = None if sources is None else f'{{"source_ids": {sources}}}'
    return (i, kind, entity, payload, status, None, 0, 3, None if minutes is None else T0 + dt.timedelta(minutes=minutes))


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, JOB_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def told(rows):
    return sorted(((r.target_entity_id, r.job_id, r.source_id, r.duplicates) for r in rows.collect()), key=str)


def test_stream_equals_batch(spark, tmp_path):
    arrivals, state, checkpoint = (str(tmp_path / x) for x in ("in", "state", "cp"))
    first = [job(5, 1, 50), job(6, 1, 60, '["a", "b"]'), job(7, 2, 10, None), job(8, 2, 20, "[]"), job(9, 3, 5, kind="other"), job(10, 3, 5, status="completed")]
    second = [job(2, 1, -9000), *first[:3], job(11, 2, 30, '["c", null]'), job(12, 4, None, '["x"]'), job(13, 4, 1)]  # one very late, three repeated
    deliver(spark, arrivals, first)
    C.start(spark, arrivals, state, checkpoint).awaitTermination()
    assert told(C.coalesced(spark, state)) == told(Q.coalesce_entity_jobs(spark.createDataFrame(first, JOB_SCHEMA)))
    deliver(spark, arrivals, second)
    C.start(spark, arrivals, state, checkpoint).awaitTermination()  # from its checkpoint
    whole = spark.createDataFrame(first + second, JOB_SCHEMA).dropDuplicates(["job_id"])
    assert told(C.coalesced(spark, state)) == told(Q.coalesce_entity_jobs(whole))
    C.start(spark, arrivals, state, checkpoint).awaitTermination()  # nothing new
    assert told(C.coalesced(spark, state)) == told(Q.coalesce_entity_jobs(whole))


def test_hot_entity_over_many_batches(spark, tmp_path):
    arrivals, state, checkpoint = (str(tmp_path / x) for x in ("in", "state", "cp"))
    rows = [job(i, 7 if i % 3 else i, (i * 37) % 100, f'["s{i % 40}"]') for i in range(300)]
    for part in range(3):
        deliver(spark, arrivals, rows[part::3] + rows[:10])
    C.start(spark, arrivals, state, checkpoint, maxFilesPerTrigger=1).awaitTermination()
    assert told(C.coalesced(spark, state)) == told(Q.coalesce_entity_jobs(spark.createDataFrame(rows, JOB_SCHEMA)))


def test_bursts(spark, tmp_path):
    rows = [job(1, 1, 0), job(2, 1, 29), job(3, 1, 60), job(4, 1, 88), job(5, 2, 3), job(6, None, 3), job(7, 2, None)]
    found = {(r.target_entity_id, (r.started - T0).seconds // 60, (r.ended - T0).seconds // 60, r.jobs)
             for r in C.job_bursts(spark.createDataFrame(rows, JOB_SCHEMA)).selectExpr("target_entity_id", "started::timestamp_ntz", "ended::timestamp_ntz", "jobs").collect()}
    assert found == {(1, 0, 59, 2), (1, 60, 118, 2), (2, 3, 33, 1)}
    arrivals = str(tmp_path / "in")
    deliver(spark, arrivals, rows)
    deliver(spark, arrivals, [job(8, 3, 600)])  # moves the watermark past all others
    stream = C.job_bursts(spark.readStream.schema(JOB_SCHEMA).option("maxFilesPerTrigger", 1).parquet(arrivals), lateness="10 minutes")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert {(r.target_entity_id, r.jobs) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 2), (2, 1)}
