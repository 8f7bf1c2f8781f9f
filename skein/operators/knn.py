"""Exact nearest neighbours: what lies at distance 0 by a join, all else on a grid of blocks.

Equal vectors are searched once, and no more than the k least ids of an equal base vector can be among the k best. Vectors at a
distance that rounds to 0 fall into one cell of a lattice over a few random directions, or next to its border, so an equi-join
finds them; a query with k of them is done. For the other queries both sides are cut into hash blocks of bounded size and every
(query block, base block) cell is one numpy matrix product that emits only its k best rows per query. A window then merges the
cells. No side is broadcast or collected and no pair of vectors becomes a row unless it shares a lattice cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from skein.config import DEFAULTS, Settings
from skein.functions import vectors as V
from skein.operators.ranking import numbers, top_k
from skein.session import stage

_SLICE_VALUES = 4_000_000
# lattice: directions, and for a metric the width of a cell and more than the length of a step whose distance rounds to 0
_DIRECTIONS, _WIDTH, _STEP = 6, {"cosine": 0.03, "l2": 1e-3}, {"cosine": 1.1e-3, "l2": 1e-6}


def _approximate(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances of a slice by one matrix product, right to about 1e-6 for L2."""
    if metric == "l2":
        squares = np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2.0 * (q @ b.T)
        return np.sqrt(np.maximum(squares, 0.0))
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return np.where(norms > 0, 1.0 - (q @ b.T) / np.where(norms > 0, norms, 1.0), 0.0)


def _best(q: np.ndarray, b: np.ndarray, k: int, metric: str, max_distance: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, column, distance)`` of the k best columns per row by (rounded distance, column)."""
    d = _approximate(q, b, metric)
    # squared norms cancel near zero: L2 candidates are taken with a margin and measured again
    margin = 1e-3 * (1.0 + np.abs(b).max(initial=0.0)) if metric == "l2" else 1e-6
    n = min(k, len(b))
    limit = np.partition(d, n - 1, axis=1)[:, n - 1] + margin
    if max_distance is not None:
        limit = np.minimum(limit, max_distance + margin)
    rows, cols = np.nonzero(d <= limit[:, None])
    exact = np.sqrt(((q[rows] - b[cols]) ** 2).sum(axis=1)) if metric == "l2" else d[rows, cols]
    if max_distance is not None:
        near = exact <= max_distance
        rows, cols, exact = rows[near], cols[near], exact[near]
    order = np.lexsort((cols, np.round(exact, 6), rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[first], cols[first], exact[first]


def _cell(k: int, metric: str, max_distance: float | None):
    def run(queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        found = []
        sizes_q, sizes_b = queries["qvec"].map(len), base["bvec"].map(len)
        for dim in set(sizes_q) & set(sizes_b):
            qs = queries[sizes_q == dim]
            bs = base[sizes_b == dim].sort_values("base_id")
            b = np.stack(bs["bvec"].to_numpy()).astype(np.float64)
            ids = bs["base_id"].to_numpy()
            step = max(1, _SLICE_VALUES // len(b))
            for at in range(0, len(qs), step):
                part = qs.iloc[at:at + step]
                rows, cols, d = _best(np.stack(part["qvec"].to_numpy()).astype(np.float64), b, k, metric, max_distance)
                found.append(pd.DataFrame({
                    "query_id": part["query_id"].to_numpy()[rows], "base_id": ids[cols], "distance": d}))
        if not found:
            return pd.DataFrame({"query_id": [], "base_id": [], "distance": []}).astype(
                {"query_id": "int64", "base_id": "int64", "distance": "float64"})
        return pd.concat(found)

    return run


def grid(n_query: int, n_base: int, rows: int, cells: int) -> tuple[int, int]:
    """Block counts: cells of at most ``rows`` x ``rows``, at least ``cells`` of them, least copying."""
    q_blocks, b_blocks = max(1, -(-n_query // rows)), max(1, -(-n_base // rows))
    while q_blocks * b_blocks < cells and n_query * n_base > cells * 10_000:
        if n_query * b_blocks <= n_base * q_blocks:
            b_blocks *= 2
        else:
            q_blocks *= 2
    return q_blocks, b_blocks


def _lattice(metric: str, around: bool):
    """Rows with the key of their lattice cell; with ``around`` also the cells that a step from the vector can reach."""
    width, step = _WIDTH[metric], _STEP[metric]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["vec"].map(len)
            for dim in sorted(set(sizes)):
                part = batch[sizes == dim]
                v = np.stack(part["vec"].to_numpy()).astype(np.float64)
                if metric == "cosine":
                    v = v / np.linalg.norm(v, axis=1)[:, None]
                signs = np.random.default_rng(dim).choice([-1.0, 1.0], size=(dim, _DIRECTIONS))
                at = v @ signs / np.sqrt(dim) / width
                slack = step / width + 1e-12 * np.abs(at)
                low, high = (np.floor(at - slack), np.floor(at + slack)) if around else (np.floor(at), np.floor(at))
                rows, keys = [], []
                for side in product((False, True), repeat=_DIRECTIONS if around else 0):
                    upper = np.array(side or [False] * _DIRECTIONS)
                    new = np.flatnonzero(((high > low) | ~upper).all(axis=1))
                    rows.append(new)
                    keys.extend(f"{dim}:" + ",".join(map(str, cell)) for cell in np.where(upper, high[new], low[new]).tolist())
                yield pd.DataFrame({"id": part["id"].to_numpy()[np.concatenate(rows)], "vec": part["vec"].to_numpy()[np.concatenate(rows)], "cell": keys})

    return run


def _at_zero(queries: DataFrame, base: DataFrame, metric: str) -> DataFrame:
    """Pairs ``(query_id, base_id, distance)`` of fit vectors whose distance rounds to 0."""
    def cells(df: DataFrame, ident: str, vector: str, around: bool) -> DataFrame:
        rows = df.filter("fit").select(F.col(ident).alias("id"), F.col(vector).alias("vec"))
        return rows.mapInPandas(_lattice(metric, around), f"id bigint, vec {df.schema[vector].dataType.simpleString()}, cell string")

    asked = cells(queries, "query_id", "qvec", True).select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"), "cell")
    near = cells(base, "base_id", "bvec", False).select(F.col("id").alias("base_id"), F.col("vec").alias("bvec"), "cell")
    measure = V.cosine_distance if metric == "cosine" else V.l2
    both = asked.join(near, "cell").select("query_id", "base_id", measure(F.col("qvec"), F.col("bvec")).alias("distance"))
    return both.filter(F.round("distance", 6) == 0)


def _gridded(queries: DataFrame, base: DataFrame, k: int, metric: str, max_distance: float | None, settings: Settings) -> DataFrame:
    """``(query_id, base_id, distance)``: the k best of each block of ``base(base_id, bvec)`` for ``queries(query_id, qvec)``."""
    q_blocks, b_blocks = grid(queries.count(), base.count(), settings.knn_block_rows,
                               base.sparkSession.sparkContext.defaultParallelism)
    q_side = queries.select(
        "query_id", "qvec", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).alias("qb"), F.explode(numbers(b_blocks)).alias("bb"))
    b_side = base.select(
        "base_id", "bvec", F.pmod(F.xxhash64("base_id"), F.lit(b_blocks)).alias("bb"), F.explode(numbers(q_blocks)).alias("qb"))
    # one task per cell: cells are small in bytes but heavy to compute, so they must not be coalesced
    cells = q_blocks * b_blocks
    q_side, b_side = q_side.repartition(cells, "qb", "bb"), b_side.repartition(cells, "qb", "bb")
    return q_side.groupBy("qb", "bb").cogroup(b_side.groupBy("qb", "bb")).applyInPandas(
        lambda left, right: _cell(k, metric, max_distance)(left, right) if len(left) and len(right)
        else _cell(k, metric, max_distance)(left.iloc[:0], right.iloc[:0]),
        "query_id bigint, base_id bigint, distance double")


def nearest(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", max_distance: float | None = None,
            settings: Settings = DEFAULTS) -> DataFrame:
    """``(query_id, rank, base_id, distance)``: k nearest by (distance rounded to 6 places, id).

    ``queries`` is ``(query_id, embedding)`` and ``base`` ``(base_id, embedding)``, both BIGINT keyed.
    NULL vectors never match; vectors of different length are never compared.
    """
    def vectors(df: DataFrame, ident: str) -> DataFrame:
        return df.filter(F.col("embedding").isNotNull()).select(ident, "embedding")

    def fit(v: str):
        """Neither null nor non-finite components, and not of length zero: all others are compared on the grid."""
        x = F.transform(v, lambda c: c.cast("double"))
        return F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(1e150))) & F.exists(x, lambda c: F.abs(c) > F.lit(1e-150))

    few = top_k(vectors(base, "base_id"), ["embedding"], [F.col("base_id")], k)
    few = stage(few.select("base_id", F.col("embedding").alias("bvec"), fit("embedding").alias("fit")), "knn-base")
    # each different vector is searched under a number of its own
    members = vectors(queries, "query_id").withColumnRenamed("query_id", "asked_id")
    classes = stage(members.select("embedding").distinct().select(
        F.monotonically_increasing_id().alias("query_id"), F.col("embedding").alias("qvec"), fit("embedding").alias("fit")), "knn-queries")
    zero = _at_zero(classes, few, metric)
    odd = few.filter("NOT fit")
    if not odd.isEmpty():  # vectors of length zero are at cosine distance 0 of all
        zero = zero.unionByName(_gridded(classes.filter("fit"), odd, k, metric, max_distance, settings).filter(F.round("distance", 6) == 0))
    zero = stage(top_k(zero, ["query_id"], [F.col("base_id")], k), "knn-zero")
    done = zero.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    best = zero.join(done.select("query_id"), "query_id", "left_semi")
    rest = classes.join(done, "query_id", "left_anti")
    if not rest.isEmpty():
        best = best.unionByName(_gridded(rest, few, k, metric, max_distance, settings))
    best = top_k(best, ["query_id"], [F.round("distance", 6), F.col("base_id")], k)
    named = members.join(classes.select("query_id", F.col("qvec").alias("embedding")), "embedding").select("asked_id", "query_id")
    found = named.join(best, "query_id").select(F.col("asked_id").alias("query_id"), "base_id", "distance")
    return top_k(found, ["query_id"], [F.round("distance", 6), F.col("base_id")], k, "rank").select(
        "query_id", "rank", "base_id", "distance")
