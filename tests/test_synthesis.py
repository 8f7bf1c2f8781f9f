"""Pending entity jobs worked off by one operator, with a writer that fails, a missing entity and folded jobs."""

import datetime as dt

from pyspark.sql import functions as F

from skein.operators.synthesis import synthesize
from skein.sources.memo import AnswerMemo, ColumnModel
from skein.sources.runs import RunStore

T0 = dt.datetime(2024, 1, 1)
NOW = "TIMESTAMP_NTZ'2024-03-01 00:00:00'"


def job(n, kind, target, sources, status="pending", attempts=0):
    return (n, kind, target, '{"source_ids": [%s]}' % ", ".join(f'"{s}"' for s in sources), status, None, attempts, 3, T0 + dt.timedelta(seconds=n))


def run(spark, jobs, write=None):
    entities = spark.createDataFrame([(1, "Apple", "organization", "maker"), (2, "Target", "person", None), (3, "Pear", "product", "fruit")],
                                     "entity_id long, name string, entity_type string, description string")
    relations = spark.createDataFrame([(1, 1, 2, "employs", 10)], "relation_id long, source_entity_id long, target_entity_id long, relation_type string, chunk_id long")
    chunks = spark.createDataFrame([(10, 5, 0, "Apple likes a pear.", None, T0), (11, 6, 0, "Apple again", None, T0)],
                                   "chunk_id long, source_id long, chunk_index int, text_content string, embedding array<float>, created_at timestamp_ntz")
    links = spark.createDataFrame([(10, 1), (10, 3), (11, 1), (10, 2)], "chunk_id long, entity_id long")
    sources = spark.createDataFrame([(5, "a.txt", None, T0), (6, "b.txt", None, T0)],
                                    "source_id long, file_name string, metadata string, created_at timestamp_ntz")
    pages = spark.createDataFrame([(7, 3, "Pear", "pear", "old pear"), (8, None, "a.txt", "a-txt", "summary")],
                                  "page_id long, entity_id long, title string, slug string, content string")
    table = spark.createDataFrame(jobs, "job_id long, job_type string, target_entity_id long, payload string, status string, "
                                  "scheduled_at timestamp_ntz, attempts int, max_retries int, created_at timestamp_ntz")
    return synthesize(table, entities, relations, chunks, links, sources, pages, lambda e: -e, F.expr(NOW), write)


JOBS = [
    job(1, "synthesize_entity", 1, [5]), job(2, "synthesize_entity", 1, [6]), job(3, "synthesize_entity", 3, [5], attempts=3),
    job(4, "synthesize_entity", 99, [5]), job(5, "synthesize_entity", None, [5]), job(6, "synthesize_entity", 2, [5], "completed"),
    job(7, "ingest_document", None, []), job(8, "synthesize_entity", 2, [5], "processing"),
]


def test_jobs_are_folded_and_closed(spark):
    done = run(spark, JOBS)
    pages = {r["page_id"]: r for r in done.pages.collect()}
    assert set(pages) == {7, 8, -1} and pages[8]["content"] == "summary"
    # both jobs of the entity give one page over both sources; a known page keeps its id
    assert "[a.txt:0]" in pages[-1]["content"] and "[b.txt:0]" in pages[-1]["content"]
    assert pages[7]["content"].startswith("# Pear\n") and pages[7]["slug"] == "pear"
    assert sorted((r["page_id"], r["entity_id"]) for r in done.backlinks.collect()) == [(-1, 1), (-1, 2), (7, 3)]
    jobs = {r["job_id"]: (r["status"], r["attempts"], r["error_message"]) for r in done.jobs.collect()}
    assert jobs == {
        1: ("completed", 0, None), 2: ("completed", 0, None), 3: ("completed", 3, None), 4: ("pending", 1, "entity not found"),
        5: ("pending", 1, "no target entity"), 6: ("completed", 0, None), 7: ("pending", 0, None), 8: ("processing", 0, None)}


def test_a_failing_writer_leaves_the_page(spark, tmp_path):
    memo = AnswerMemo(RunStore(spark, str(tmp_path / "memo")))
    writer = ColumnModel("writer", lambda text: F.when(~text.startswith("# Pear"), F.concat(F.lit("!"), text)))
    done = run(spark, JOBS, memo.ask(writer))
    pages = {r["page_id"]: r["content"] for r in done.pages.collect()}
    assert pages[7] == "old pear" and pages[-1].startswith("!# Apple")
    assert {r["page_id"] for r in done.backlinks.collect()} == {-1}
    jobs = {r["job_id"]: (r["status"], r["attempts"], r["error_message"]) for r in done.jobs.collect()}
    assert jobs[1] == jobs[2] == ("completed", 0, None)
    assert jobs[3] == ("failed", 4, "no answer")  # its last attempt


def test_nothing_to_do(spark):
    done = run(spark, JOBS[5:])
    assert done.written.count() == 0 and done.backlinks.count() == 0
    assert {r["page_id"]: r["content"] for r in done.pages.collect()} == {7: "old pear", 8: "summary"}
    assert sorted(r["status"] for r in done.jobs.collect()) == ["completed", "pending", "processing"]
