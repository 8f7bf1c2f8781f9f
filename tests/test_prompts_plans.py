"""Prompt columns, the plan log and the worker's snapshots."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skein.functions import prompts as P
from skein.sources.planlog import PlanLog

ENTITY = ("name string, entity_type string, description string, existing string, edges array<struct<label: string, target_slug: string>>, "
          "chunks array<struct<source_file: string, index: int, text: string>>, known array<struct<slug: string, name: string>>")


def entity_prompts(spark, *rows):
    df = spark.createDataFrame(list(rows), ENTITY)
    return [r[0] for r in df.select(P.entity_page_prompt(*[F.col(c) for c in df.columns])).collect()]


def test_entity_prompts(spark):
    new, old = entity_prompts(
        spark, ("E", "concept", None, None, [], None, []),
        ("TestEntity", "concept", "A test", "Some existing content", [("knows", "bob-1234")], [("doc.txt", 0, "Some content")], [("bob-1234", "Bob")]))
    assert "# E\n" in new and "create a new wiki page" in new and "Relationships" in new and "1. **Chunks only.**" in new and "2. **No citation fabrication.**" in new
    assert "# TestEntity" in old and "update an existing wiki page" in old and "Some existing content" in old and "knows: [[bob-1234]]" in old
    assert "[doc.txt:0] Some content" in old and "[[bob-1234]] Bob" in old


def test_source_and_resolution_prompts(spark):
    df = spark.createDataFrame([("doc.txt", "2024-01-01", [(0, "text")], [("a-1", "A")], [("a-1", "cites", "b-2")]), ("empty.txt", None, None, [], None)],
                               "f string, at string, c array<struct<index: int, text: string>>, t array<struct<slug: string, name: string>>, "
                               "r array<struct<source_slug: string, label: string, target_slug: string>>")
    full, bare = [r[0] for r in df.select(P.source_page_prompt(*[F.col(c) for c in df.columns])).collect()]
    assert "# doc.txt" in full and P.CURATOR in full and "[0] text" in full and "[[a-1]] cites [[b-2]]" in full and "Passages: 1" in full
    assert "# empty.txt" in bare and bare.count("(none)") == 3
    one = spark.createDataFrame([(("Ann", "person", "x"), [(7, "Anne", "person", None)])],
                                "m struct<name: string, entity_type: string, description: string>, c array<struct<entity_id: long, name: string, entity_type: string, description: string>>")
    assert "- id 7: Anne (person): " in one.select(P.resolution_prompt(F.col("m"), F.col("c"))).first()[0]


def test_plan_log(spark, tmp_path):
    log = PlanLog(spark, str(tmp_path / "plans"))
    plans = spark.createDataFrame([(1, "What is a?", False), (2, "odd", True)], "query_id long, raw_query string, rejected boolean")
    now = datetime(2024, 3, 1, 10)
    for _ in range(2):  # a retry
        log.append(plans, "a", now)
    log.append(plans, "b", now, ttl_days=1)
    log.append(plans, "c", now - timedelta(days=40))
    assert sorted((r["run"], r["query_id"]) for r in log.read().collect()) == [("a", 1), ("b", 1), ("c", 1)]
    assert sorted(r["run"] for r in log.live(now).collect()) == ["a", "b"]
    assert log.expire(now) == 1 and log.expire(now) == 0
    assert log.expire(now + timedelta(days=1)) == 1 and [r["run"] for r in log.read().collect()] == ["a"]
