from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.config import DEFAULTS
from skein.operators.dedup import collapse_copies, greedy_dedup
from skein.operators.knn import grid, nearest
from skein.operators.retrieval import find_seeds
from skein.session import stage


def vectors(n, dims, seed, copies=0):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(n, dims)).astype(np.float32)
    if copies:
        out[rng.integers(0, n, copies)] = out[0]
    return out


@pytest.mark.parametrize("metric,limit", [("cosine", None), ("l2", 4.0)])
@pytest.mark.parametrize("block", [7, 20_000])
def test_nearest_is_exact_for_anygrid(spark, metric, limit, block):
    base, asked = vectors(60, 8, 1, copies=20), vectors(9, 8, 2)
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)] + [(99, None), (98, [1.0])], "base_id long, embedding array<float>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<float>")
    got = nearest(q, b, 4, metric, limit, replace(DEFAULTS, knn_block_rows=block)).collect()
    found = {(r.query_id, r.rank): r.base_id for r in got}
    want = {}
    for i, x in enumerate(asked.astype(float)):
        y = base.astype(float)
        d = np.linalg.norm(y - x, axis=1) if metric == "l2" else 1 - (y @ x) / np.linalg.norm(x) / np.linalg.norm(y, axis=1)
        order = [j for j in np.lexsort((np.arange(60), np.round(d, 6))) if limit is None or d[j] <= limit][:4]
        want.update({(i, k + 1): j for k, j in enumerate(order)})
    assert found == want


def test_grid_bounds_cells():
    assert grid(10, 10, 20, 8) == (1, 1)
    q, b = grid(1_000_000, 1_000, 20_000, 100)
    assert q >= 50 and q * b >= 100


def test_seed_order_and_quality(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "entity_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    rows = sorted(find_seeds(q, e).collect(), key=lambda r: r.rank)
    assert [(r.entity_id, r.seed_quality) for r in rows] == [(1, "high"), (2, "low"), (3, "poor")]
    assert rows[0].score == pytest.approx(0.0)


def naive(items, threshold=0.92):
    kept = []
    for ident, v in items:
        n = np.linalg.norm(v)
        close = False
        for _, k in kept:
            m = np.linalg.norm(k)
            if len(k) == len(v) and n > 0 and m > 0 and v @ k / n / m >= threshold:
                close = True
                break
        if not close:
            kept.append((ident, v))
    return [i for i, _ in kept]


@pytest.mark.parametrize("limit", [10, 4096])
def test_greedy_dedup_equals_the_loop(spark, limit):
    """A hot group with copies, near copies, a zero vector twice and another length, in blocks and at once."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    rows, plain = [], []
    for i in range(150):
        v = (centres[rng.integers(0, 12)] + rng.normal(scale=0.25, size=6)) if i % 3 else centres[0]
        v = np.zeros(6) if i in (40, 90) else v[:5] if i == 60 else v
        v = v.astype(np.float32)
        key = "z" if not v.any() else v.tobytes().hex()
        sim = float(np.round(rng.uniform(-1, 1), 3)) if i % 3 else 0.5
        rows.append((1, i % 2 if i % 3 else 0, -sim, i, key, not v.any(), v.tolist()))
        plain.append(((i % 2 if i % 3 else 0, -sim, i), v.astype(float)))
    rows += [(2, 0, 0.0, 1000, "a", False, [1.0, 0.0]), (2, 0, 0.1, 1001, "b", False, [1.0, 0.01])]
    df = spark.createDataFrame(rows, "query_id long, tier int, neg_sim double, chunk_id long, copy_key string, is_zero boolean, embedding array<float>")
    want = {(1, k[2]) for k in naive([(k, v) for k, v in sorted(plain, key=lambda p: p[0])])} | {(2, 1000)}
    order = ["tier", "neg_sim", "chunk_id"]
    collapsed = stage(collapse_copies(df.drop("embedding"), ["query_id"], "copy_key", "is_zero", order).drop("copy_key", "is_zero"), "t")
    got = greedy_dedup(collapsed, ["query_id"], order, "chunk_id", df.select("chunk_id", "embedding"), replace(DEFAULTS, dedup_block_rows=limit))
    assert {(r.query_id, r.chunk_id) for r in got.collect()} == want


def test_dedup_blocks_of_equal_rows_are_bounded(spark):
    """Rows that agree in all leading order columns still fall into runs of the limit."""
    from skein.operators import dedup

    df = spark.range(1000).select(F.lit(1).alias("query_id"), F.lit(0).alias("tier"), F.lit(-0.5).alias("neg_sim"), F.col("id").alias("chunk_id"))
    sizes = {r["_block"]: (r.n, r.lo, r.hi) for r in dedup._blocks(df, ["query_id"], ["tier", "neg_sim", "chunk_id"], 100).groupBy("_block").agg(
        F.count("*").alias("n"), F.min("chunk_id").alias("lo"), F.max("chunk_id").alias("hi")).collect()}
    assert sizes == {i: (100, 100 * i, 100 * i + 99) for i in range(10)}


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_queries_with_enough_copies_stay_off_the_grid(spark, monkeypatch, metric):
    """A query that k base vectors equal, or all but equal, is answered by a join: the grid sees the others only."""
    from skein.operators import knn
    seen = []
    whole = knn._gridded
    monkeypatch.setattr(knn, "_gridded", lambda queries, *rest: seen.append(queries.count()) or whole(queries, *rest))
    own = vectors(40, 8, 3)
    close = own.astype(np.float64) * (1 + 1e-9)
    rows = [(i, own[i % 40].tolist()) for i in range(80)] + [(80 + i, close[i].tolist()) for i in range(40)] + [(500, own[0].tolist())]
    b = spark.createDataFrame(rows, "base_id long, embedding array<double>")
    asked = [(i, own[i % 40].tolist()) for i in range(100)] + [(7, own[7].tolist()), (100, vectors(1, 8, 9)[0].tolist()), (101, None)]
    got = nearest(spark.createDataFrame(asked, "query_id long, embedding array<double>"), b, 3, metric).collect()
    found = {(r.query_id, r.rank): r.base_id for r in got}
    assert seen == [1]
    for i in range(100):
        want = [i % 40] * 2 + [i % 40 + 40] if i == 7 else [i % 40 + 40 * j for j in range(3)]
        assert [found[i, k] for k in (1, 2, 3)] == want
    assert len([k for k in found if k[0] == 100]) == 3 and not [k for k in found if k[0] == 101]


def test_zero_vectors_are_at_cosine_distance_zero_of_all(spark):
    b = spark.createDataFrame([(5, [1.0, 0.0]), (6, [1.0, 0.0]), (2, [0.0, 0.0]), (9, [0.0, 0.0]), (1, [0.0, 1.0])], "base_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, embedding array<double>")
    found = {(r.query_id, r.rank): r.base_id for r in nearest(q, b, 2).collect()}
    assert found == {(1, 1): 2, (1, 2): 5, (2, 1): 1, (2, 2): 2}
