"""Threshold self-join against all pairs, and findings on hand-made pages."""

import datetime
import math
import random

import numpy as np
import pytest

from skein.operators import closepairs, lint


def alike(rows, threshold):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    return {(a, b): round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 6) for a, x in ok for b, y in ok
            if a < b and len(x) == len(y) and round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 6) >= threshold}


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    return [(i, (centres[rng.integers(12)] + 0.2 * rng.normal(size=16)).tolist()) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"pivots": 12, "block": 40}])
def test_all_close_pairs(spark, options):
    rows = clustered(1, 300) + [(1000, [1.0, 2.0]), (1001, [2.0, 4.1]), (1002, None), (1003, [0.0, 0.0]), (1004, [float("nan"), 1.0]), (None, [1.0, 2.0]), (1005, [None, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, embedding array<double>, v string, cell int")
    close = closepairs.close_pairs(df, 0.95, **options)
    found = {(r["a"], r["b"]): r["similarity"] for r in close.pairs.collect()}
    assert found == alike(rows, 0.95) and len(found) > 100
    work = close.work.first()
    assert not options or work["compared"] < 0.6 * work["possible"]


def test_equal_vectors_are_compared_once(spark):
    rows = [(i, [1.0, 0.0]) for i in range(5, 60)] + [(1, [0.0, 1.0]), (2, [1.0, 0.001])]
    close = closepairs.close_pairs(spark.createDataFrame(rows, "id long, embedding array<double>"), 0.9)
    assert [(r["a"], r["b"]) for r in close.pairs.collect()] == [(2, 5)]
    assert {r["id"]: r["representative"] for r in close.members.collect()} == {i: 5 if i >= 5 else i for i, _ in rows}
    assert closepairs.close_pairs(spark.createDataFrame([], "id long, embedding array<double>"), 0.9).pairs.count() == 0


def test_findings(spark):
    at = datetime.datetime(2024, 1, 1)
    later = at + datetime.timedelta(days=1)
    pages = spark.createDataFrame(
        [(1, 11, "a", "see [[b]] and [[a]] and [[gone]] [[gone]] [[open", "published", at), (2, 12, "b", "[[a", "published", later),
         (3, None, "c", "[[b]]", "published", at), (4, None, "d", "[[c]]", "pending_review", at), (5, None, "e", None, "published", at)],
        "page_id long, entity_id long, slug string, content string, status string, synthesized_at timestamp")
    chunks = spark.createDataFrame([(1, later), (2, at)], "chunk_id long, created_at timestamp")
    links = spark.createDataFrame([(1, 11), (2, 11), (1, 12)], "chunk_id long, entity_id long")
    entities = spark.createDataFrame([(11, "person", [1.0, 0.0]), (12, "person", [1.0, 0.01]), (13, "place", [1.0, 0.0]), (14, "place", [0.0, 1.0]), (15, "person", [1.0, 0.0]),
                                      (16, "place", None)], "entity_id long, entity_type string, embedding array<double>")
    found = sorted((tuple(r) for r in lint.lint(pages, entities, chunks, links).collect()), key=repr)
    assert found == sorted([("orphan", 1, 11, "a"), ("orphan", 3, None, "c"), ("orphan", 5, None, "e"), ("missing_link", 1, None, "gone"), ("stale", 1, 11, "1 newer chunks"),
                            ("duplicate", None, 12, "11"), ("duplicate", None, 15, "11")], key=repr)


def test_vectors_are_dealt_to_cells_in_bounded_frames():
    """At a low threshold every vector goes to every cell; a task holds ``DEAL`` such rows at once, not a whole batch times the cells."""
    import pandas as pd
    rng = np.random.default_rng(4)
    v = rng.normal(size=(4096, 8))
    centres = {8: closepairs._units(pd.Series(list(v[:64])))}
    batch = pd.DataFrame({"representative": np.arange(4096), "v": list(v)})
    frames = list(closepairs._deal(centres, 2.0)(iter([batch])))
    assert max(map(len, frames)) <= 16_384 and sum(map(len, frames)) == 4096 * 64
    assert sum(int(f["own"].sum()) for f in frames) == 4096


@pytest.mark.parametrize("block", [2048, 3])
def test_pairs_of_all_rows(spark, block):
    """Copies pair with each other and with all that is close to them; rows that repeat, or share an id, each count."""
    rng = np.random.default_rng(7)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(5, 15)] + [(1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [1.0, 0.01, 0.0]), (9, [0.0, 1.0, 0.0]), (7, [1.0, 0.0, 0.0])]
    rows += [(2, [0.0, 1.0, 0.01]), (2, [0.0, 1.0, 0.02])] + [(100 + i, rng.normal(size=3).tolist()) for i in range(20)]
    close = closepairs.close_pairs(spark.createDataFrame(rows, "id long, embedding array<double>"), 0.9)
    wanted = sorted((a, b, round(float(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y))), 6)) for a, x in rows for b, y in rows if a < b)
    assert sorted(tuple(r) for r in close.all_pairs(block).collect()) == [w for w in wanted if w[2] >= 0.9]
    none = closepairs.close_pairs(spark.createDataFrame(rows, "id long, embedding array<double>"), 1.1)
    assert none.all_pairs().count() == 0


def test_the_query_tells_pairs_of_equal_vectors(spark, tmp_path):
    from skein.plans.registry import QUERIES, load
    load()
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.1]), (4, [0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted((r["a"], r["b"]) for r in QUERIES["close_entity_vectors"](spark, str(tmp_path)).collect()) == [(1, 2), (1, 3), (2, 3)]
