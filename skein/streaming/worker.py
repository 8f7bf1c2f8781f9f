"""The queue worker as a Structured Streaming query.

Job arrivals are a file stream; ``foreachBatch`` is the only writer of the open-job table, which takes
the place of row locks. Every micro-batch reads the snapshot of the batch before it and writes its own,
so a batch replayed after a failure gives the same snapshot.
"""

from __future__ import annotations

from collections.abc import Callable
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.config import DEFAULTS
from skein.operators import queue as Q
from skein.session import stage

JOB_SCHEMA = (
    "job_id bigint, job_type string, target_entity_id bigint, payload string, status string, scheduled_at timestamp_ntz, "
    "attempts int, max_retries int, created_at timestamp_ntz"
)
OUTCOME = "job_id bigint, error string, released boolean"


class Worker:
    """``handlers`` map a job type to a function of the claimed jobs that returns ``(job_id, error, released)``.

    A job without an outcome row completes; an ``error`` counts as a failed attempt; ``released`` puts
    the job back untouched. Job types without a handler fail.
    """

    def __init__(self, spark: SparkSession, arrivals: str, state: str, handlers: dict[str, Callable[[DataFrame], DataFrame]],
                 claim: int = 1000, name: str = "worker"):
        self.spark, self.arrivals, self.state, self.handlers, self.claim, self.name = spark, arrivals, state, handlers, claim, name

    def start(self, checkpoint: str, once: bool = False):
        stream = self.spark.readStream.schema(JOB_SCHEMA).parquet(self.arrivals)
        writer = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint)
        trigger = {"availableNow": True} if once else {"processingTime": f"{DEFAULTS.worker_poll_seconds} seconds"}
        return writer.trigger(**trigger).start()

    def open_jobs(self, epoch: int) -> DataFrame:
        """Jobs the epoch left open, after the last ``drain`` if there was one; none before the first epoch.

        A snapshot that can't be read is an error, not an empty queue.
        """
        if epoch < 0:
            return self.spark.createDataFrame([], JOB_SCHEMA)
        return self.spark.read.schema(JOB_SCHEMA).parquet(f"{self.state}/open/epoch={epoch}/version={self._version(epoch)}")

    def _version(self, epoch: int) -> int:
        """The newest whole snapshot of an epoch: 0 by its batch, one more by each ``drain``. One without success mark was broken off."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.state}/open/epoch={epoch}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in files.listStatus(path)] if files.exists(path) else []
        whole = [p.getName() for p in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max((int(n.removeprefix("version=")) for n in whole), default=0)

    def closed_jobs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.state}/closed")

    def _batch(self, arrived: DataFrame, epoch: int) -> None:
        jobs = self.open_jobs(epoch - 1).unionByName(arrived.select(self.open_jobs(-1).columns))
        self._work_off(jobs, epoch, "", 0)

    def drain(self) -> None:
        """Work off what the newest epoch left open, for times without arrivals; not beside a running query.

        The snapshot it reads stays; the new one stands beside it and counts once it is whole.
        """
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.state}/open")
        names = [s.getPath().getName() for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)]
        epoch = max(int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch="))
        self._work_off(self.open_jobs(epoch), epoch, f"drain-{uuid.uuid4().hex}-", self._version(epoch) + 1)

    def _work_off(self, jobs: DataFrame, epoch: int, prefix: str, version: int) -> None:
        """Turns of at most ``claim`` jobs until nothing can be claimed. Released jobs wait for the next batch, and every other
        claim closes a job or uses up an attempt, so the turns end."""
        parked, turn, busy = None, 0, True
        while busy:
            jobs, closed, back, busy = self._turn(jobs)
            closed.write.mode("overwrite").parquet(f"{self.state}/closed/epoch={epoch}/turn={prefix}{turn}")
            parked = back if parked is None else stage(parked.unionByName(back), "parked")
            turn += 1
        stage(jobs.unionByName(parked), "open").write.mode("overwrite").parquet(f"{self.state}/open/epoch={epoch}/version={version}")

    def _turn(self, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
        """Claim, run, fold outcomes: (still open, closed, released, whether anything was claimed)."""
        jobs = stage(jobs, "jobs")
        claimed = stage(Q.claim_next(jobs, self.claim, self.name), "claimed")
        outcome = self.spark.createDataFrame([], OUTCOME)
        for kind, handler in self.handlers.items():
            outcome = outcome.unionByName(handler(claimed.filter(F.col("job_type") == kind)).select("job_id", "error", "released"))
        unknown = claimed.filter(~F.col("job_type").isin(*self.handlers)).select(
            "job_id", F.concat(F.lit("unknown job type: "), "job_type").alias("error"), F.lit(False).alias("released"))
        told = stage(claimed.join(outcome.unionByName(unknown), "job_id", "left").withColumn(
            "released", F.coalesce("released", F.lit(False))), "outcome")
        back = Q.release(told.filter("released"))
        failed = Q.fail(told.filter("NOT released AND error IS NOT NULL").withColumnRenamed("error", "_error"), F.col("_error"))
        done = Q.complete(told.filter("NOT released AND error IS NULL"), F.localtimestamp())
        columns = jobs.columns
        waiting = jobs.join(claimed.select("job_id"), "job_id", "left_anti")
        still = waiting.select(columns).unionByName(failed.filter("status = 'pending'").select(columns))
        closed = done.select(*columns, F.lit(None).cast("string").alias("error_message")).unionByName(
            failed.filter("status = 'failed'").select(*columns, "error_message"))
        return stage(still, "open"), closed, stage(back.select(columns), "released"), not claimed.isEmpty()
