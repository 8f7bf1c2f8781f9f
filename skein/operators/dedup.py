"""Greedy near-duplicate removal: keep a row if it is below the threshold to every row kept before it.

The rule is order dependent. Equal vectors are collapsed first (a later copy of a non-zero vector is
always dropped), which takes hot groups of copies out before any shuffle of vectors. What is left of
a group is handled in one task only while it fits a block; larger groups run block after block, each
block compared in parallel with the rows kept so far.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from skein.config import DEFAULTS, Settings
from skein.operators.ranking import numbers
from skein.session import fan_out, stage


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.where(norms > 0, vectors / np.where(norms > 0, norms, 1.0), 0.0)


def _matrix(table: pa.Table, rows: np.ndarray, dim: int) -> np.ndarray:
    flat = table["embedding"].take(pa.array(rows)).combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(rows), dim).astype(np.float64)


def far_apart(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """The greedy choice among rows in order: whether a vector is below the threshold to every one kept before it."""
    unit = _unit(vectors)
    close = np.tril(unit @ unit.T >= threshold, -1)
    kept = ~close.any(axis=1)
    for i in np.flatnonzero(~kept):
        kept[i] = not (close[i] & kept).any()
    return kept


def _greedy(threshold: float, order: list[str]):
    """Kept rows of one block: a row is dropped when a kept earlier row of equal length is too close."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([(c, "ascending") for c in order])
        keep = np.zeros(block.num_rows, dtype=bool)
        lengths = pc.list_value_length(block["embedding"]).to_numpy()
        for dim in np.unique(lengths):
            rows = np.flatnonzero(lengths == dim)
            keep[rows[far_apart(_matrix(block, rows, int(dim)), threshold)]] = True
        return block.filter(pa.array(keep))

    return run


def _drop_close(threshold: float, columns: list[str]):
    """Rows of a block that are close to some row of a piece of the kept set."""

    def run(block: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(block), dtype=bool)
        if len(block) and len(kept):
            len_b, len_k = block["embedding"].map(len).to_numpy(), kept["embedding"].map(len).to_numpy()
            for dim in np.intersect1d(len_b, len_k):
                rows = np.flatnonzero(len_b == dim)
                a = _unit(np.stack(block["embedding"].iloc[rows].to_numpy()).astype(np.float64))
                b = _unit(np.stack(kept["embedding"][len_k == dim].to_numpy()).astype(np.float64))
                hit[rows] = (a @ b.T >= threshold).any(axis=1)
        return block.loc[hit, columns]

    return run


def collapse_copies(df: DataFrame, keys: list[str], copy_key: str, zero: str, order: list[str]) -> DataFrame:
    """First row of every set of equal non-zero vectors; ``copy_key`` identifies equal vectors."""
    rest = [c for c in df.columns if c not in (*keys, copy_key)]
    first = df.filter(~F.col(zero)).groupBy(*keys, copy_key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, copy_key, "r.*")
    return first.unionByName(df.filter(F.col(zero)))


def greedy_dedup(df: DataFrame, keys: list[str], order: list[str], id_col: str, vectors: DataFrame,
                 settings: Settings = DEFAULTS) -> DataFrame:
    """Rows of ``df`` that survive, per group of ``keys`` in ascending ``order`` (last column unique).

    ``df`` carries no vectors; ``vectors`` maps ``id_col`` to ``embedding``. Run ``collapse_copies``
    first. ``df`` should be a staged table: its group sizes are read before it is used.
    """
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    loaded = df.join(vectors.select(id_col, "embedding"), id_col).filter(F.col("embedding").isNotNull())
    if largest <= settings.dedup_block_rows:
        return greedy_groups(loaded, keys, order, settings).select(df.columns)
    return _greedy_in_blocks(loaded, keys, order, id_col, settings).select(df.columns)


def greedy_groups(loaded: DataFrame, keys: list[str], order: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """``greedy_dedup`` of rows that carry their ``embedding``, each group of them in one task: only for groups that fit a block."""
    return fan_out(loaded, *keys).groupBy(*keys).applyInArrow(_greedy(settings.dedup_threshold, order), loaded.schema)


def _blocks(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """Number runs of ``limit`` consecutive rows per group, whatever the order columns hold.

    Rows are dealt out by ranges of (group, order), and only ranges are counted up, so no group is ever ranked in one task.
    The order's last column is unique, which keeps even rows of equal leading columns apart.
    """
    ranges = stage(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "dedup-ranges")
    counts = ranges.groupBy(*keys, "_range").count()
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    placed = ranges.withColumn("_at", F.row_number().over(inside) - 1).join(starts, [*keys, "_range"])
    return placed.withColumn("_block", F.floor((F.col("_start") + F.col("_at")) / limit).cast("int")).drop("_range", "_at", "_start")


def _greedy_in_blocks(loaded: DataFrame, keys: list[str], order: list[str], id_col: str,
                      settings: Settings) -> DataFrame:
    limit = settings.dedup_block_rows
    work = stage(_blocks(loaded, keys, order, limit), "dedup-blocks", "_block")
    last = work.agg(F.max("_block")).first()[0]
    kept: DataFrame | None = None
    for number in range(last + 1):
        block = work.filter(F.col("_block") == number).drop("_block")
        if kept is not None:
            split = F.pmod(F.xxhash64(id_col), F.lit(number)).alias("_piece")
            candidates = block.select("*", F.explode(numbers(number)).alias("_piece"))
            hit = candidates.groupBy(*keys, "_piece").cogroup(kept.select("*", split).groupBy(*keys, "_piece")).applyInPandas(
                _drop_close(settings.dedup_threshold, [*keys, id_col]),
                ", ".join(f"{c} {loaded.schema[c].dataType.simpleString()}" for c in (*keys, id_col)))
            block = block.join(hit.distinct(), [*keys, id_col], "left_anti").select(block.columns)
        fresh = block.groupBy(*keys).applyInArrow(_greedy(settings.dedup_threshold, order), block.schema)
        fresh = stage(fresh, "dedup-kept")
        kept = fresh if kept is None else kept.unionByName(fresh)
        if number % 16 == 15:  # keeps the plan short when there are many blocks
            kept = stage(kept, "dedup-kept")
    return kept
