import datetime as dt

import pytest
from pyspark.sql import functions as F

from skein.operators import browse, merge, planning, queue as Q, resolution as X
from skein.sources.uploads import accepted


def merges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "from_id long, into_id long")


def test_merge_can_make_a_loop_and_dedups(spark):
    rel = spark.createDataFrame([(1, 2, 1, "t", 9), (2, 1, 1, "t", 9), (3, 5, 6, "t", 9), (4, 5, 6, "t", 9)],
                                "relation_id long, source_entity_id long, target_entity_id long, relation_type string, chunk_id long")
    got = merge.merge_relations(rel, merges(spark, (2, 1)))
    assert {(r.relation_id, r.source_entity_id, r.target_entity_id) for r in got.collect()} == {(1, 1, 1), (3, 5, 6)}
    again = merge.merge_relations(got, merges(spark, (2, 1)))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_merge_links_pages_and_entities(spark):
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "chunk_id long, entity_id long")
    assert {tuple(r) for r in merge.merge_links(links, merges(spark, (2, 1))).collect()} == {(1, 1), (2, 1)}
    pages = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, None)], "page_id long, entity_id long")
    got = {r.page_id: r.entity_id for r in merge.merge_pages(pages, merges(spark, (2, 1), (3, 4))).collect()}
    assert got == {10: 1, 11: None, 12: 4, 13: None}


def test_chains_follow_and_cycles_raise(spark):
    got = merge.resolve_chains(merges(spark, (1, 2), (2, 3), (3, 4), (4, 5), (9, 9)))
    assert {r.from_id: r.into_id for r in got.collect()} == {1: 5, 2: 5, 3: 5, 4: 5}
    with pytest.raises(ValueError, match="cycle"):
        merge.resolve_chains(merges(spark, (1, 2), (2, 3), (3, 1)))


def test_upsert_keeps_title_and_adds_new(spark):
    old = spark.createDataFrame([(1, 7, "old", "a"), (2, None, "src", "b")], "page_id long, entity_id long, title string, content string")
    new = spark.createDataFrame([(50, 7, "new", "A"), (51, 8, "fresh", "B")], old.schema)
    got = {tuple(r) for r in merge.upsert(old, new, "entity_id", ["content"]).collect()}
    assert got == {(1, 7, "old", "A"), (2, None, "src", "b"), (51, 8, "fresh", "B")}


JOB = "job_id long, job_type string, target_entity_id long, payload string, status string, scheduled_at timestamp_ntz, attempts int, max_retries int, created_at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def test_queue_order_and_retry(spark):
    later = T0 + dt.timedelta(days=900)
    jobs = spark.createDataFrame([(1, "a", None, None, "pending", later, 0, 3, T0), (2, "a", None, None, "pending", None, 0, 3, T0),
                                  (3, "a", None, None, "pending", None, 4, 3, T0), (4, "a", None, None, "done", None, 0, 3, T0)], JOB)
    assert [r.job_id for r in Q.claim_next(jobs, 1, "w").collect()] == [2]
    assert {r.job_id for r in Q.claim_next(jobs, 9, "w").collect()} == {1, 2}
    failed = Q.fail(jobs.withColumn("attempts", F.when(F.col("job_id") == 3, 3).otherwise(0)), F.lit("x"))
    assert {r.job_id: (r.status, r.attempts) for r in failed.collect()}[3] == ("failed", 4)
    assert {r.job_id: (r.status, r.attempts) for r in failed.collect()}[1] == ("pending", 1)


def test_coalescing_unions_sources(spark):
    rows = [(i, "synthesize_entity", 5, '{"source_ids": ["%s"]}' % s, "pending", None, 0, 3, T0 + dt.timedelta(seconds=i)) for i, s in enumerate("abca")]
    jobs = spark.createDataFrame(rows, JOB)
    got = Q.coalesce_entity_jobs(jobs).collect()
    assert {r.source_id for r in got} == {"a", "b", "c"} and {(r.job_id, r.duplicates) for r in got} == {(0, 3)}
    state = {r.job_id: r.status for r in Q.after_coalescing(jobs, F.localtimestamp()).collect()}
    assert state == {0: "pending", 1: "completed", 2: "completed", 3: "completed"}


@pytest.mark.parametrize("text,kind,confidence", [
    ("What is X?", "factual_lookup", 0.9), ("Define Y", "factual_lookup", 0.9), ("Who is Z", "factual_lookup", 0.9),
    ("How does X relate to Y?", "relationship_query", 0.9), ("connect A and B", "relationship_query", 0.9), ("Summarize X", "summarization", 0.9),
    ("Compare X and Y", "comparison", 0.9), ("A vs B", "comparison", 0.9), ("hello there", "factual_lookup", 0.3),
    ("what is the difference", "factual_lookup", 0.9)])
def test_question_rules(spark, text, kind, confidence):
    row = planning.classify(spark.createDataFrame([(1, text)], "query_id long, text string")).first()
    assert (row.classified_type, row.confidence, row.rejected) == (kind, confidence, confidence < 0.5)


def test_given_type_and_model_answers(spark):
    q = spark.createDataFrame([(1, "x", "comparison"), (2, " Maybe ", None), (3, "broken what is", None)], "query_id long, text string, query_type string")
    a = spark.createDataFrame([("maybe", '{"type": "summarization", "confidence": 0.6}'), ("broken what is", "not json")], "question_key string, answer string")
    got = {r.query_id: r for r in planning.classify(q, a).collect()}
    assert (got[1].classification_source, got[1].confidence, got[1].rejected) == ("explicit", 1.0, False)
    assert (got[2].retrieval_depth, got[2].seed_count, got[2].termination_condition) == ("deep", 5, "escalated: mid-confidence 0.6")
    assert got[3].classification_source == "rule"


@pytest.mark.parametrize("name,parser", [("a.pdf", "pdf"), ("a.md", "simple"), ("a.TXT", "simple"), ("a.html", "unstructured"), ("a.xyz", "unstructured"), ("a", "unstructured")])
def test_ingest_plan(spark, name, parser):
    df = spark.createDataFrame([(1, name, "k", 10, None)], "source_id long, file_name string, storage_key string, file_size long, metadata string")
    row = planning.plan_sources(df).first()
    assert row.selected_parser == parser and row.rationale.endswith("density=small")


def test_parser_override(spark):
    df = spark.createDataFrame([(1, "a.txt", "k", 10, '{"parser": "ocr"}')], "source_id long, file_name string, storage_key string, file_size long, metadata string")
    row = planning.plan_sources(df).first()
    assert (row.selected_parser, row.pdf_mode) == ("pdf", "with_ocr")
    odd = planning.plan_sources(df.withColumn("metadata", F.lit('{"parser": "nosuch"}'))).first()
    assert odd.selected_parser == "nosuch"  # fails its source when it is parsed, not the table of plans


def test_lists_and_lookups(spark):
    df = spark.createDataFrame([(i, f"Name_{i}", "p" if i % 2 else "q", T0 + dt.timedelta(seconds=i)) for i in range(30)], "entity_id long, name string, status string, created_at timestamp_ntz")
    page, total = browse.listing(browse.matching(df, {"name": "name_"}, status="p"), "entity_id", 2, 5)
    assert [r.entity_id for r in page.collect()] == [25, 23, 21, 19, 17] and total.first()["total"] == 15
    assert browse.matching(df, {"name": "N%2_"}).count() == 10  # wildcards stay active: N…2 and one more character
    with pytest.raises(browse.NotFound):
        browse.get_by_id(df, "entity_id", 99)
    with pytest.raises(ValueError):
        browse.entity_relations(df, 1, "sideways")


def test_resolution_groups_mentions_and_isolates_bad_chunks(spark):
    found = spark.createDataFrame([(1, 0, "Apple", "concept", "Named Apple"), (1, 1, "APPLE", "concept", "Named APPLE"), (2, 0, "Apple", "concept", "Named Apple"),
                                   (2, 1, "Pear", "concept", "Named Pear")], "chunk_id long, idx int, canonical_name string, entity_type string, description string")
    rel = spark.createDataFrame([(1, 0, 0, 1, "t"), (2, 0, 0, 1, "t"), (2, 1, 0, 9, "t")], "chunk_id long, n int, source_idx int, target_idx int, relation_type string")
    from skein.functions.vectors import hash_embedding
    known = spark.createDataFrame([(77, "pear", "concept")], "entity_id long, name string, entity_type string").withColumn("embedding", hash_embedding(F.lit("Pear Named Pear"), 64))
    got = X.resolve(found, rel, known)
    ids = {r.name_key: (r.entity_id, r.decision) for r in got.mentions.collect()}
    assert ids["pear"] == (77, "merge") and ids["apple"][1] == "new"
    assert got.new_entities.count() == 1
    assert {(r.chunk_id, r.source_entity_id, r.target_entity_id) for r in got.relations.collect()} == {(1, ids["apple"][0], ids["apple"][0])}
    assert [r.chunk_id for r in got.errors.collect()] == [2]
    assert got.links.count() == 3


def test_uploads(spark):
    rows = spark.createDataFrame([(1, "a", 10, None), (2, "", 10, None), (3, "a", 0, None), (4, "a", 10**9, None), (5, "a", 1, "[1]"), (6, "a", 1, "{"), (7, "a", 1, "{}")],
                                 "source_id long, file_name string, size long, metadata string")
    sources, jobs = accepted(rows)
    assert {r.source_id for r in sources.collect()} == {1, 7} == {r.source_id for r in jobs.collect()}


def test_merge_cycle_is_found_early(spark):
    import time

    start = time.time()
    with pytest.raises(ValueError, match="merge cycle"):
        merge.resolve_chains(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "from_id long, into_id long"))
    assert time.time() - start < 20
    chain = merge.resolve_chains(spark.createDataFrame([(i, i + 1) for i in range(40)], "from_id long, into_id long"))
    assert {r.into_id for r in chain.collect()} == {40}
