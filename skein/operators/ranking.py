"""Ordered selection inside groups: top-k, budget prefix, keep-one.

All of them put a ``row_number() <= bound`` filter right on the window, so Spark trims each group
on the map side (``WindowGroupLimit``) and a hot group reaches the final task as at most
``bound`` rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of every group; ``rank`` names a 1-based position column to keep."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1)


def budget_prefix(df: DataFrame, keys: list[str], order: list[Column], cost: str, budget: Column,
                  max_budget: int) -> DataFrame:
    """Longest prefix of each group whose running cost fits the budget.

    Costs are at least 1, so stopping at the first overflow equals ``running sum <= budget`` and no
    group can keep more than ``max_budget`` rows: that bound trims groups before the running sum.
    """
    ordered = Window.partitionBy(*keys).orderBy(*order)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.withColumn("_rank", F.row_number().over(ordered)).filter(F.col("_rank") <= max(1, max_budget))
        .withColumn("_spent", F.sum(cost).over(running)).filter(F.col("_spent") <= budget)
        .drop("_rank", "_spent")
    )


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 20, max_limit: int = 100) -> DataFrame:
    """One page of a list: a global top-k, which Spark runs as per-partition heaps."""
    return df.orderBy(*order).offset(offset).limit(min(limit, max_limit))


def numbers(n: int) -> Column:
    """``array(0 .. n-1)`` of BIGINT, to copy a row into every one of n blocks."""
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
