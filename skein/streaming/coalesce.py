"""Coalescing of synthesis jobs as they arrive, by keyed state, and bursts of jobs as session windows.

A stream of job rows is folded per target entity: the first job (by age, then id) stays the head, the others count as its
duplicates, and each source id is told once. Sources are a map state, so a hot entity never becomes one long value. Every
micro-batch writes the increments of the entities it touched to a folder of its own, overwritten if the batch is replayed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skein.session import ship
from skein.streaming.worker import JOB_SCHEMA

REPEATS = "7 days"
GAP = "30 minutes"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
INCREMENT = "target_entity_id bigint, jobs bigint, job_id bigint, is_source boolean, source_id string"


class Fold(StatefulProcessor):
    """State of one entity: head (age, id) and number of jobs as a value, source ids as a map. An entity that is null is one of its own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "age bigint, job_id bigint, jobs bigint")
        self.sources = handle.getMapState("sources", "source string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        known = self.head.get() if self.head.exists() else None
        first, jobs, new = (tuple(known[:2]), known[2], []) if known else (None, 0, [])
        for batch in rows:
            jobs += len(batch)
            least = min(zip(batch["age"].tolist(), batch["job_id"].tolist()))
            first = least if first is None else min(first, least)
            for source in dict.fromkeys(s for told in batch["told"] for s in told):
                if not self.sources.containsKey((source,)):
                    self.sources.updateValue((source,), (True,))
                    new.append(source[1:] if source[0] == "s" else None)
        self.head.update((*first, jobs))
        n = len(new)
        yield pd.DataFrame({
            "target_entity_id": pd.array([None if pd.isna(key[0]) else key[0]] * (n + 1), "Int64"), "jobs": jobs, "job_id": first[1],
            "is_source": [False] + [True] * n, "source_id": [None, *new]})

    def close(self) -> None:
        pass


def fold_stream(jobs: DataFrame, repeats: str = REPEATS) -> DataFrame:
    """Increments of a stream of job rows; pending jobs of entities only.

    A job delivered again within ``repeats`` of its first arrival counts once. The watermark runs on arrival, which the offset log
    keeps for replays, so a job is never too late, however old it is.
    """
    mine = jobs.filter("job_type = 'synthesize_entity' AND status = 'pending'").withColumn("arrived", F.current_timestamp())
    once = mine.withWatermark("arrived", repeats).dropDuplicatesWithinWatermark(["job_id"])
    ids = F.from_json(F.get_json_object("payload", "$.source_ids"), "array<string>")
    marked = F.transform(ids, lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("n")))  # a source id without value is told as null
    told = F.when(F.size(ids) > 0, marked).otherwise(F.array(F.lit("n")))
    age = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 63)))
    rows = once.select("target_entity_id", "job_id", age.alias("age"), told.alias("told"))
    return rows.groupBy("target_entity_id").transformWithStateInPandas(Fold(), INCREMENT, "Append", "None")


def start(spark: SparkSession, arrivals: str, state: str, checkpoint: str, repeats: str = REPEATS, once: bool = True, **options):
    """Run the fold over the job files in ``arrivals``; what is there now (``once``) or as it comes. ``state`` takes the increments."""
    ship(spark)
    jobs = spark.readStream.schema(JOB_SCHEMA).options(**options).parquet(arrivals)

    def write(increments: DataFrame, epoch: int) -> None:
        increments.write.mode("overwrite").parquet(f"{state}/epoch={epoch}")

    writer = fold_stream(jobs, repeats).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS_DB)  # this stream's own copy of the session keeps it
    try:
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(STATE_STORE, before)


def coalesced(spark: SparkSession, state: str) -> DataFrame:
    """What ``coalesce_entity_jobs`` gives for all jobs that came so far: ``(target_entity_id, job_id, source_id, duplicates)``.

    The count of an entity only grows, so its newest head is the one with the highest count.
    """
    rows = spark.read.schema(INCREMENT).parquet(state)
    heads = rows.filter("NOT is_source").groupBy("target_entity_id").agg(F.max_by("job_id", "jobs").alias("job_id"), (F.max("jobs") - 1).alias("duplicates"))
    told = rows.filter("is_source").select(F.col("target_entity_id").alias("entity"), "source_id")
    return told.join(heads, F.col("entity") == F.col("target_entity_id")).select("target_entity_id", "job_id", "source_id", "duplicates")


def job_bursts(jobs: DataFrame, gap: str = GAP, lateness: str | None = None) -> DataFrame:
    """Jobs per entity in sessions, which end where more than ``gap`` has none: ``(target_entity_id, started, ended, jobs)``.

    For a stream give ``lateness``: a session is told once, when the watermark has passed its end. Jobs without entity or time take no part.
    """
    timed = jobs.filter("target_entity_id IS NOT NULL AND created_at IS NOT NULL").withColumn("at", F.col("created_at").cast("timestamp"))
    timed = timed.withWatermark("at", lateness) if lateness else timed
    bursts = timed.groupBy("target_entity_id", F.session_window("at", gap).alias("burst")).agg(F.count(F.lit(1)).alias("jobs"))
    return bursts.select("target_entity_id", F.col("burst.start").alias("started"), F.col("burst.end").alias("ended"), "jobs")
