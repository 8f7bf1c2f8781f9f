"""The log of query plans: appended by run, partitioned by day, expired by whole partitions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.session import delete_path

TTL_DAYS = 30  # fixed value


class PlanLog:
    """``<root>/day=<date>/run=<id>`` holds the plans that one run appended on a day.

    A run that is appended again, as a retry does, replaces its own partition, so nothing doubles. Plans below the least confidence
    (``rejected``) are refused to the asker and not logged.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, plans: DataFrame, run: str, at: datetime, ttl_days: int = TTL_DAYS) -> None:
        """Log ``plans`` (as ``planning.classify`` gives them) under ``run`` as of ``at``; to be called before retrieval."""
        kept = plans.where("not rejected").drop("rejected")
        stamped = kept.withColumn("created_at", F.lit(at).cast("timestamp_ntz")).withColumn("ttl_days", F.lit(ttl_days))
        stamped.write.mode("overwrite").parquet(f"{self.root}/day={at.date().isoformat()}/run={run}")

    def read(self) -> DataFrame:
        """All plans that were logged and not expired yet, with ``day`` and ``run``."""
        return self.spark.read.option("basePath", self.root).parquet(self.root).withColumn("run", F.col("run").cast("string"))

    def live(self, now: datetime) -> DataFrame:
        """Plans whose time is not over at ``now``."""
        return self.read().where(F.date_add(F.col("created_at").cast("date"), F.col("ttl_days")) > F.lit(now.date()))

    def expire(self, now: datetime) -> int:
        """Drop the partitions in which every plan's time is over at ``now``; how many. Rows are never rewritten."""
        ends = self.read().groupBy("day", "run").agg(F.max(F.date_add(F.col("created_at").cast("date"), F.col("ttl_days"))).alias("over"))
        gone = ends.where(F.col("over") <= F.lit(now.date())).select(F.col("day").cast("string").alias("day"), "run").collect()  # names of partitions
        for day, run in gone:
            delete_path(self.spark, f"{self.root}/day={day}/run={run}")
        return len(gone)
