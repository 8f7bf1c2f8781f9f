"""Runs become visible whole, the latest one by default, and old or lost ones are removed."""

import os

import pytest

from skein import session
from skein.sources.runs import RunStore


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x int")


def values(df):
    return sorted(r["x"] for r in df.collect())


def test_visibility_and_retention(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    with pytest.raises(LookupError):
        store.read("a")
    first = store.save({"a": rows(spark, 1), "b": rows(spark, 10)})
    second = store.save({"a": rows(spark, 2, 3)})
    half = store.start()
    store.write(half, "a", rows(spark, 4))
    assert values(store.read("a")) == [2, 3] and values(store.read("b")) == [10] and values(store.read("a", first)) == [1]
    assert store.completed() == [first, second]
    assert sorted((r["run"], r["x"]) for r in store.history("a").collect()) == [(first, 1), (second, 2), (second, 3)]
    with pytest.raises(LookupError):
        store.read("a", half)
    store.write(half, "a", rows(spark, 5))  # written again after a crash
    store.commit(half, ["a"])
    store.commit(half, ["a"])
    assert values(store.read("a")) == [5]
    lost = store.start()
    store.write(lost, "a", rows(spark, 6))
    assert store.retain(1, open_for=3600) == [first, second]
    assert store.completed() == [half] and os.path.isdir(tmp_path / "runs" / "a" / f"run={lost}")
    assert store.retain(1, open_for=0) == [lost] and values(store.read("a")) == [5]
    with pytest.raises(ValueError):
        store.retain(0)


def test_release_deletes_what_was_staged(spark):
    df = session.stage(rows(spark, 1, 2), "released")
    bucketed = session.stage_bucketed(rows(spark, 1, 2), "released", "x")
    folders = [os.path.dirname(f.removeprefix("file:").replace("///", "/")) for d in (df, bucketed) for f in d.inputFiles()]
    assert all(map(os.path.isdir, folders))
    assert session.release_staged(spark) >= 2
    assert not any(map(os.path.isdir, folders)) and session.release_staged(spark) == 0
