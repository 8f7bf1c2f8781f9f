"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots. Bytes are added up for each slot, and a versioned table maps slots to shards:
version 0 deals slots round robin, and each rebalancing edits the map and writes the next version. The table has one row for
each slot, whatever the corpus holds, so the edit itself is a small computation beside the job.

The main path is DataFrame functions only.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skein.session import stage, staging_root

SLOTS = 4096
SHARDS = 40
ROW_BYTES = 16
REPEATS = 65_536  # equal rows that are numbered off at once


def record_slots(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``__size``, ``__crc`` and ``__slot``. The slot follows from id and text, so rows without an id spread too."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (docs.withColumn("__size", (F.octet_length(text) + ROW_BYTES).cast("long"))
            .withColumn("__crc", F.crc32(F.encode(text, "UTF-8")))
            .withColumn("__slot", F.pmod(F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col))), F.lit(slots)).cast("int")))


def slot_bytes(records: DataFrame) -> DataFrame:
    return records.groupBy("__slot").agg(F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(slots: int, shards: int) -> dict[int, int]:
    return {slot: slot % shards for slot in range(slots)}


def rebalance(owner: dict[int, int], weight: dict[int, int], shards: int) -> dict[int, int]:
    """The edited map: heavy slots first, a slot stays with its shard while that shard has room, else it goes to the lightest.

    ``weight`` has bytes by slot. Works on the fixed number of slots, never on records.
    """
    fair = sum(weight.values()) / shards
    load = [0] * shards
    moved: list[int] = []
    edited = dict(owner)
    for slot in sorted(weight, key=lambda s: (-weight[s], s)):
        home = owner[slot]
        if home < shards and load[home] + weight[slot] <= fair:
            load[home] += weight[slot]
        else:
            moved.append(slot)
    light = [(b, shard) for shard, b in enumerate(load)]
    heapq.heapify(light)
    for slot in moved:
        b, shard = heapq.heappop(light)
        edited[slot] = shard
        heapq.heappush(light, (b + weight[slot], shard))
    return edited


def write_map(spark: SparkSession, owner: dict[int, int], version: int, path: str) -> None:
    rows = [(version, slot, shard) for slot, shard in sorted(owner.items())]
    spark.createDataFrame(rows, "version int, slot int, shard int").coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    maps = spark.read.schema("version int, slot int, shard int").parquet(path)
    return maps.where(F.col("version") == version).select(F.col("slot").alias("__mapped"), "shard")


def newest_map(spark: SparkSession, path: str) -> tuple[int, dict[int, int] | None]:
    """The newest version and its map (one row for each fixed slot), or None where no map was stored yet."""
    try:
        maps = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1, None
    version = maps.agg(F.max("version")).first()[0]
    return version, {r["__mapped"]: r.shard for r in read_map(spark, path, version).collect()}


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text",
                    map_path: str | None = None) -> DataFrame:
    """Every row of ``docs`` with its place: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot.

    The law is ``bytes``: the sizes of the shards are near equal, as far as single records allow. ``slot`` counts the rows of
    a shard from 0 without gaps; ``virtual_slot`` is the fixed hash slot. ``grown_shard`` is null, as this law has none. Null
    texts have no bytes; repeated rows each keep a place of their own, the first at its hash slot and the others spread; an empty table gives no rows.
    A map stored at ``map_path`` is read and edited, so records move only as far as the balance asks.
    """
    spark = docs.sparkSession
    base = record_slots(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), slots, "__id", "__text")
    # equal rows are counted first and told apart by number, so that a large group of them goes to many slots
    equal = base.groupBy(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), "__slot",
                         F.xxhash64("__text").alias("__hash")).agg(F.count(F.lit(1)).alias("__rows"))
    batch = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__rows") - 1) / REPEATS)))
    cut = equal.withColumn("__batch", batch).withColumn("__first", F.col("__batch") * REPEATS)
    each = cut.withColumn("__number", F.explode(F.sequence("__first", F.least(F.col("__first") + REPEATS, "__rows") - 1)))
    repeated = F.pmod(F.xxhash64("doc_id", "__hash", "__number"), F.lit(slots)).cast("int")
    base = stage(each.select("doc_id", "size", "text_crc32", F.when(F.col("__number") == 0, F.col("__slot")).otherwise(repeated).alias("__slot")), "shard-records")
    sums = stage(slot_bytes(base.withColumnRenamed("size", "__size")), "slot-bytes")
    weight = {r["__slot"]: r.bytes for r in sums.collect()}  # one row for each of the fixed slots
    path = map_path or f"{staging_root(spark)}/slot-map-{uuid.uuid4().hex}"
    version, owner = newest_map(spark, path)
    if owner is None:
        version, owner = 0, first_map(slots, shards)
        write_map(spark, owner, version, path)
    write_map(spark, rebalance(owner, weight, shards), version + 1, path)
    owned = read_map(spark, path, version + 1)
    before = Window.partitionBy("shard").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.join(F.broadcast(owned), F.col("__slot") == F.col("__mapped")).select(
        F.col("__slot").alias("__s"), "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__slot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    # both small tables have one row for each of the fixed slots
    placed = base.withColumn("__n", F.row_number().over(inside) - 1).join(F.broadcast(starts), F.col("__slot") == F.col("__s"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                         (F.col("__before") + F.col("__n")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                         F.col("__slot").alias("virtual_slot"))
