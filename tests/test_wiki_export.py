import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from skein.operators import export as E, wiki as W
from skein.operators.mentions import occurrences
from skein.sources import sinks

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def world(spark):
    entities = spark.createDataFrame([(1, "Apple Inc", "organization", "maker"), (2, "Target", "person", None), (3, "Pear", "product", "fruit")],
                                     "entity_id long, name string, entity_type string, description string")
    relations = spark.createDataFrame([(1, 1, 2, "employs", 10)], "relation_id long, source_entity_id long, target_entity_id long, relation_type string, chunk_id long")
    chunks = spark.createDataFrame([(10, 5, 0, "Apple Inc likes a pear.\nmore", None, T0), (11, 6, 0, "Apple Inc again", None, T0)],
                                   "chunk_id long, source_id long, chunk_index int, text_content string, embedding array<float>, created_at timestamp_ntz")
    links = spark.createDataFrame([(10, 1), (10, 3), (11, 1), (10, 2)], "chunk_id long, entity_id long")
    sources = spark.createDataFrame([(5, "a.txt", '{"reingest_count": 2, "previous_ingested_at": "x"}', T0), (6, "b.txt", None, T0)],
                                    "source_id long, file_name string, metadata string, created_at timestamp_ntz")
    pages = spark.createDataFrame([], "page_id long, entity_id long, content string")
    return entities, relations, chunks, links, sources, pages


def test_entity_context(spark, world):
    entities, relations, chunks, links, sources, pages = world
    wanted = spark.createDataFrame([(1, 5), (1, 6)], "entity_id long, source_id long")
    got = W.entity_context(wanted, entities, relations, chunks, links, sources, pages)
    assert [(e.label, e.target_slug) for e in got.edges.collect()] == [("employs", "target-2")]
    assert {c.chunk_id for c in got.chunks.collect()} == {10, 11}
    # the neighbour first, then names found in the text: the entity itself and Pear
    known = sorted(got.known.collect(), key=lambda r: (r.o.tier, r.o.at))
    assert [k.known_id for k in known] == [2, 1, 3]
    assert got.budget.first().room == 5300
    page = W.render_entity_pages(got, entities, chunks).first()
    assert page.synthesized_from_sources == ["5", "6"] and page.slug == "apple-inc-1"
    for part in ("# Apple Inc\n", "## Relations\n- employs: [[target-2]]", "## Contradictions\n*No contradictions detected.*", "## Sources\n- [a.txt:0] a.txt"):
        assert part in page.content


def test_existing_page_takes_budget(spark, world):
    entities, relations, chunks, links, sources, _ = world
    pages = spark.createDataFrame([(1, 1, "old")], "page_id long, entity_id long, content string")
    wanted = spark.createDataFrame([(1, 5)], "entity_id long, source_id long")
    got = W.entity_context(wanted, entities, relations, chunks, links, sources, pages)
    assert got.budget.first().room == 4500 and [c.chunk_id for c in got.chunks.collect()] == [10]


def test_source_context_and_page(spark, world):
    entities, relations, chunks, links, sources, _ = world
    got = W.source_context(sources, entities, relations, chunks, links)
    head = {r.source_id: (r.chunk_count, r.reingest_count, r.previous_ingested_at) for r in got.head.collect()}
    assert head == {5: (1, 2, "x"), 6: (1, 0, None)}
    assert [(r.source_slug, r.label, r.target_slug) for r in got.relations.collect()] == [("apple-inc-1", "employs", "target-2")]
    page = {r.source_id: r.content for r in W.render_source_pages(got).collect()}
    assert "- Re-ingest number: 2" in page[5] and "Re-ingest" not in page[6]
    assert "- [a.txt:0] — Apple Inc likes a pear." in page[5]


def test_occurrences_equal_plain_search(spark):
    import random
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("ab c") for _ in range(30))) for i in range(40)]
    names = [(i, "".join(rng.choice("ab c") for _ in range(rng.randrange(0, 5)))) for i in range(60)]
    got = occurrences(spark.createDataFrame(texts, "text_id long, haystack string"), spark.createDataFrame(names, "entity_id long, needle string"))
    assert {tuple(r) for r in got.collect()} == {(t, n) for t, x in texts for n, y in names if y in x}


def pages_of(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, entity_id long, title string, slug string, content string, status string, "
                                 "synthesized_from_sources array<string>, synthesized_at timestamp_ntz")


def test_links_outside_code_are_rewritten(spark):
    pages = pages_of(spark, (1, None, "t", "s", "see [[a-1]], `[[a-1]]` and [[nope]]", "published", [], T0))
    names = spark.createDataFrame([("a-1", "Alpha")], "slug string, display string")
    assert E.rewrite_links(pages, names).first().body == "see [Alpha](../entities/a-1.md), `[[a-1]]` and [nope](../entities/nope.md)"


def test_bundle_round_trip(spark, world, tmp_path):
    entities, _, _, _, sources, _ = world
    root = str(tmp_path / "bundle")
    os.makedirs(root)
    first = pages_of(spark, (1, 1, "Apple Inc", "apple-inc-1", "# Apple\n[[target-2]]", "published", ["5"], T0),
                     (2, None, "a.txt", "a-txt-5", "First paragraph.\n\nrest", "published", ["5"], T0),
                     (3, 3, "Pear", "pear-3", "hidden", "pending_review", [], T0))
    args = (entities, sources, root, "http://h/api/")
    assert sinks.export_bundle(first, *args, "run1", "2024-01-01 00:00:00 UTC") == 2
    page = open(f"{root}/entities/apple-inc-1.md").read()
    assert page.startswith("---\ntype: organization\ntitle: Apple Inc\ndescription: maker\ntimestamp: \"2024-01-01T00:00:00\"\npage_kind: entity\n"
                           "resource: \"http://h/api/entities/1\"\n---\n\n# Apple\n[target-2](../entities/target-2.md)\n")
    assert "description: First paragraph." in open(f"{root}/sources/a-txt-5.md").read()
    assert "- [Apple Inc](entities/apple-inc-1.md) — maker" in open(f"{root}/index.md").read()
    assert "- [a.txt](a-txt-5.md) — First paragraph." in open(f"{root}/sources/index.md").read()
    manifest = {r.path: r.content_hash for r in sinks.load_manifest(spark, root).collect()}
    assert set(manifest) == {"entities/apple-inc-1.md", "sources/a-txt-5.md"} and all(len(v) == 64 for v in manifest.values())
    log = open(f"{root}/log.md").read()
    assert "- **added** `entities/apple-inc-1.md` — Apple Inc" in log
    assert sinks.export_bundle(first, *args, "run2", "2024-01-02 00:00:00 UTC") == 0
    assert open(f"{root}/log.md").read() == log
    second = first.filter("page_id = 1").withColumn("content", F.lit("# Apple\nnew"))
    assert sinks.export_bundle(second, *args, "run3", "2024-01-03 00:00:00 UTC") == 1
    assert not os.path.exists(f"{root}/sources/a-txt-5.md")
    log = open(f"{root}/log.md").read()
    assert "## 2024-01-03 00:00:00 UTC" in log and "- **removed** `sources/a-txt-5.md` — a-txt-5" in log and "**modified**" in log


def test_missing_or_broken_manifest_is_empty(spark, tmp_path):
    assert sinks.load_manifest(spark, str(tmp_path)).count() == 0
    sinks.write_text(str(tmp_path), f"{sinks.MANIFEST}/current", "nowhere")
    assert sinks.load_manifest(spark, str(tmp_path)).count() == 0


def test_slug_names_and_backlinks(spark, world):
    entities, relations, _, _, sources, _ = world
    pages = pages_of(spark, (1, 1, "x", "apple-inc-1", "c", "published", [], T0), (2, None, "x", "s5", "c", "published", ["5"], T0),
                     (3, None, "x", "s9", "c", "published", ["nine"], T0))
    assert {tuple(r) for r in E.slug_names(pages, entities, sources).collect()} == {("apple-inc-1", "Apple Inc"), ("s5", "a.txt"), ("s9", "s9")}
    assert {tuple(r) for r in W.page_backlinks(pages, relations, entities).collect()} == {(1, 1), (1, 2)}


def test_names_are_sought_in_texts_of_their_own_sources_only(spark, monkeypatch):
    """No text meets names of other sources, whatever the number of entities; nameless entities are never mentioned."""
    from skein.operators import mentions
    monkeypatch.setattr(mentions, "_scan", None)  # the grid of all names and all texts has no part in it
    monkeypatch.setattr(mentions, "grid", None)
    entities = spark.createDataFrame([(1, "Apple"), (2, "Pear"), (3, "Plum"), (4, "pear"), (5, None), (6, "a.txt:0")], "entity_id long, name string")
    chunks = spark.createDataFrame([(10, 5, 0, "pear and plum", T0), (11, 6, 0, "plum", T0)],
                                   "chunk_id long, source_id long, chunk_index int, text_content string, created_at timestamp_ntz")
    links = spark.createDataFrame([(10, 1), (10, 2), (10, 4), (10, 5), (10, 6), (11, 3)], "chunk_id long, entity_id long")
    sources = spark.createDataFrame([(5, "a.txt"), (6, "b.txt")], "source_id long, file_name string")
    wanted = spark.createDataFrame([(1, 5), (3, 6)], "entity_id long, source_id long")
    chosen = spark.createDataFrame([(1, 10), (3, 11)], "entity_id long, chunk_id long")
    got = W.mentioned(wanted, chosen, entities, chunks, links, sources)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2), (1, 4), (1, 6), (3, 3)]


def test_entry_costs_move_lengths_and_equal_those_of_the_entries(spark):
    import datetime as dt
    from pyspark.sql import functions as F
    from skein.functions import text as T
    from skein.operators import wiki as W
    at = dt.datetime(2024, 1, 1)
    rows = [(1, 5, 0, "x" * 41, at), (2, 5, 1, None, None), (3, 9, 2, "é\U0001F600y", at), (4, None, 3, "", at), (5, 5, None, "abc", at), (None, 5, 4, "z" * 9, at)]
    chunks = spark.createDataFrame(rows, "chunk_id long, source_id long, chunk_index int, text_content string, created_at timestamp_ntz")
    sources = spark.createDataFrame([(5, "f5.txt")], "source_id long, file_name string")
    costs = W.entry_costs(chunks, sources)
    entries = W.chunk_entries(chunks, sources).withColumn("cost", T.estimate_tokens(F.col("entry"))).drop("entry", "text")
    assert sorted(map(repr, costs.collect())) == sorted(map(repr, entries.select(costs.columns).collect())) and set(costs.columns) == set(entries.columns)
    plan = costs.select("chunk_id", "cost")._jdf.queryExecution().optimizedPlan().toString()
    assert "text_content" not in plan.split("Join")[0]
