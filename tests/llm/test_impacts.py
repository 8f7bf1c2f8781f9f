"""Exact top-k search against scoring every pair."""

import math
import random

import numpy as np
import pytest

from skein.llm import impacts, queries

SF = "/root/testdata/sf0.001"


def brute(rows, k=20, step=20, scale=64):
    taking = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) and abs(scale * x) < 1 << 24 for x in v)]
    out = []
    for at, (query_id, q) in enumerate(taking):
        if query_id % step == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for n, (i, v) in enumerate(taking) if n != at)
            out += [(query_id, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def table(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("spread", [0.15, 3.0])
def test_block_search_is_exact_and_stops_early(spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32))
    vectors = np.floor(16 * (centres[rng.integers(0, 60, 3000)] + spread * rng.normal(size=(3000, 32)))).astype(np.int32)
    block = impacts.Block(impacts.build_index(vectors), 3000)
    queries_ = vectors[::150]
    every = queries_.astype(np.int64) @ vectors.T.astype(np.int64)
    best = np.sort(every, axis=1)[:, -10]
    for floors in (np.full(20, -np.inf), np.sort(every, axis=1)[:, -30].astype(float)):
        rows, at, scores, read = block.search(queries_, 10, floors)
        assert set(zip(*np.nonzero(every >= np.maximum(best, floors)[:, None]))) <= set(zip(rows, at))
        assert (scores == every[rows, at]).all()
        assert read < len(block.levels)


@pytest.mark.parametrize("vector", [[0, 0, 0], [5, 0, 0], [-1, 1, 1]])
def test_zero_and_sparse_queries(vector):
    vectors = np.array([[0, 0, 0], [1, 2, 3], [-4, 0, 4], [1, 2, 3], [-1, -1, -1]], np.int32)
    block = impacts.Block(impacts.build_index(vectors), 5)
    _, at, scores, _ = block.search(np.array([vector]), 2, np.array([-np.inf]))
    every = vectors.astype(int) @ np.array(vector)
    assert set(np.flatnonzero(every >= np.sort(every)[-2])) <= set(at.tolist())
    assert (scores == every[at]).all()


KINDS = "vec_id long, embedding array<float>, label int, class_id long, v int, block int, score string"


def test_awkward_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(150)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(200, 300)]  # a very common vector
    rows += [(20, [0.5, 0.5, 0.5, 0.5]), (20, [0.5, 0.5, 0.5, 0.5]), (40, [1.0, -1.0, 0.0, 0.0]), (None, [1.0] * 4), (60, None), (-40, [0.1, -0.01, 0.0, 0.3]),
             (80, [float("nan"), 1.0, 1.0, 1.0]), (100, [float("inf"), 1.0, 1.0, 1.0]), (120, [None, 1.0, 1.0, 1.0]), (140, [1e30, 1.0, 1.0, 1.0]), (160, [0.0] * 4)]
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4, "x") for i, v in rows], KINDS)
    wanted = brute(rows)
    assert table(impacts.exact_top_k(df)) == wanted
    assert table(impacts.exact_top_k(df, block=40)) == wanted
    assert table(impacts.exact_top_k(df, k=3, query_step=7, scale=10, block=25)) == brute(rows, 3, 7, 10)


def test_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], 1, 2, 3, 4, "x")], KINDS)
    assert table(impacts.exact_top_k(one)) == []
    assert table(impacts.exact_top_k(one.limit(0))) == []
    short = [(0, [1.0, 2.0]), (1, [1.0]), (2, [])]
    assert table(impacts.exact_top_k(spark.createDataFrame([(i, v, 1, 2, 3, 4, "x") for i, v in short], KINDS))) == [(0, 1, 1, 4096), (0, 2, 2, 0)]


def test_query_on_given_vectors(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert table(queries.QUERIES["op12_exact_top_k"](spark, SF)) == brute(rows)


def test_index_moves_once_for_each_share_of_queries(spark, monkeypatch):
    """Rows that hold an index block grow with the blocks, not with blocks times chunks of queries; cells stay bounded."""
    moved, fan_out = [], impacts.fan_out

    def counting(df, *keys):
        if "postings" in df.columns:
            moved.append(df.count())
        return fan_out(df, *keys)

    monkeypatch.setattr(impacts, "fan_out", counting)
    monkeypatch.setattr(impacts, "CHUNK", 8)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 2)]) for i in range(640)]
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4, "x") for i, v in rows], KINDS)
    assert table(impacts.exact_top_k(df, k=3, query_step=2, block=20)) == brute(rows, 3, 2)
    assert moved and max(moved) <= 32  # 32 blocks, which 40 chunks of queries meet
    for queries_, blocks, tasks in ((31_000, 150, 16), (31_000, 150, 1000), (10, 1, 64), (0, 1, 16), (1 << 18, 3, 8)):
        groups, shares = impacts.cells_of(queries_, blocks, tasks)
        assert -(-blocks // groups) <= impacts.CELL_BLOCKS and -(-queries_ // shares) <= impacts.CELL_QUERIES and groups <= blocks
