import datetime as dt
from dataclasses import replace
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skein.config import DEFAULTS
from skein.operators import retrieval as R
from skein.operators.ranking import budget_prefix
from skein.sources.bridge import Tables, numbered

T0 = dt.datetime(2024, 1, 1)


def unit(i, n=4):
    return [1.0 if j == i else 0.0 for j in range(n)]


@pytest.fixture(scope="module")
def data(spark):
    """A -> B, A -> C with one chunk each, a second copy of A's chunk, and a page for A."""
    entities = spark.createDataFrame([(1, "A", "person", "a", unit(0)), (2, "B", "person", None, unit(1)), (3, "C", "place", "c", unit(2))],
                                     "entity_id long, name string, entity_type string, description string, embedding array<float>")
    relations = spark.createDataFrame([(1, 1, 2, "knows", 10), (2, 1, 3, "visits", 11)],
                                      "relation_id long, source_entity_id long, target_entity_id long, relation_type string, chunk_id long")
    relations = relations.withColumn("confidence_tag", F.lit("INFERRED"))
    chunks = spark.createDataFrame(
        [(10, 5, 0, "about A", unit(0), T0), (11, 5, 1, "about B", unit(1), T0), (12, 6, 0, "about C", unit(2), T0), (13, 6, 1, "copy of A", unit(0), T0),
         (14, 99, 0, "odd length", [1.0], T0)],
        "chunk_id long, source_id long, chunk_index int, text_content string, embedding array<float>, created_at timestamp_ntz")
    links = spark.createDataFrame([(10, 1), (11, 2), (11, 1), (12, 3), (13, 1), (14, 3)], "chunk_id long, entity_id long")
    pages = spark.createDataFrame([(100, 1, "# A\nprose\n\n## Sources\ns", ["5"])],
                                  "page_id long, entity_id long, content string, synthesized_from_sources array<string>")
    sources = spark.createDataFrame([(5, "f5.txt"), (6, "f6.txt")], "source_id long, file_name string")
    return R.Graph(entities, relations, chunks, links, pages, sources)


def question(spark, **extra):
    row = {"query_id": 1, "text": "What is A", "embedding": unit(0), **extra}
    types = {"query_id": "long", "text": "string", "embedding": "array<float>", "budget": "int", "seed_entity_ids": "array<long>"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {types[k]}" for k in row))


def test_given_seed_walks_to_its_neighbours(spark, data):
    got = R.retrieve_single(question(spark, seed_entity_ids=[1, 77]), data)
    seed = got.seeds.collect()
    assert [(s.entity_id, s.score, s.seed_quality, s.degree, s.relation_summary) for s in seed] == [
        (1, 1.0, "high", 2, "Connected to 1 Person, 1 Place")]
    assert {(n.entity_id, n.hop) for n in got.nodes.collect()} == {(2, 1), (3, 1)}
    assert {e.line for e in got.edges.collect()} == {"[A] --knows--> [B] (hop 1)", "[A] --visits--> [C] (hop 1)"}
    chunks = {(c.chunk_id, c.tier, c.entity_id) for c in got.chunks.collect()}
    # 13 copies 10, 14 has another vector length, 11 is linked to the seed as well
    assert chunks == {(10, 0, 1), (11, 0, 1), (12, 1, 3)}
    s = got.summary.first()
    assert (s.chunks_fetched, s.chunks_after_dedup, s.entities_traversed, s.entities_after_truncation) == (5, 3, 3, 2)
    assert s.total == s.anchor + s.subgraph + s.wiki_page + s.seed_chunks + s.hop_chunks + s.instruction <= s.budget == 3600
    assert s.utilization == round(s.total / s.budget, 4)
    wiki = got.wiki.first()
    assert wiki.content == "# A\nprose\n\n\n## Sources\ns" and wiki.sections_included == "entity_prose,sources" and not wiki.was_truncated
    text = {r.chunk_id: r.source_file for r in R.with_chunk_text(got.chunks, data).collect()}
    assert text == {10: "f5.txt", 11: "f5.txt", 12: "f6.txt"}


def test_vector_seeds_and_small_budget(spark, data):
    got = R.retrieve_single(question(spark, budget=40), data)
    assert [s.entity_id for s in got.seeds.orderBy("rank").collect()] == [1, 2, 3]
    s = got.summary.first()
    assert (s.seed_chunks, s.hop_chunks, s.chunks_fetched, s.chunks_after_dedup) == (0, 0, 0, 0)


def test_comparison_merges_parts(spark, data):
    got = R.retrieve_comparison(question(spark, seed_entity_ids=[2, 3, 77], budget=3000), data)
    s = got.summary.first()
    assert s.budget == 1000 and s.instruction == 2 * R.INSTRUCTION_TOKENS
    assert {x.entity_id for x in got.seeds.collect()} == {2, 3}
    edges = [(e.source_name, e.relation_type, e.target_name) for e in got.edges.collect()]
    assert sorted(edges) == [("A", "knows", "B"), ("A", "visits", "C")]
    assert s.utilization == pytest.approx(s.total / 1000)
    alone = R.retrieve_comparison(question(spark, seed_entity_ids=[77]), data)
    assert alone.summary.first().entities_traversed == 0


def test_gate_and_dispatch(spark, data):
    q = question(spark).unionByName(question(spark).withColumns({"query_id": F.lit(2), "text": F.lit("Compare A and B")})).unionByName(
        question(spark).withColumns({"query_id": F.lit(3), "text": F.lit("nothing")}))
    got = {r.query_id: r.classified_type for r in R.retrieve(q.withColumn("query_id", F.col("query_id").cast("long")), data).collect()}
    assert got == {1: "factual_lookup", 2: "comparison"}


def test_context_text_and_answer(spark, data):
    got = R.retrieve_single(question(spark, seed_entity_ids=[1]), data)
    lines = [r.line for r in R.context_blocks(got, data).orderBy("block", "pos", "id").collect()]
    assert lines[0] == "- A (person): a [degree=2, centrality=low]" and lines[-1] == "- about C"
    assert R.extractive_answers(got, data).first().answer == "about A"


def test_sections_over_budget_are_dropped_by_priority(spark):
    page = spark.createDataFrame([(1, 1, "# A\n" + "p" * 3000 + "\n## Sources\n" + "s" * 2000 + "\n## Relations\nr", ["1"])],
                                 "page_id long, entity_id long, content string, synthesized_from_sources array<string>")
    got = R.wiki_slot(page).first()
    assert (got.sections_included, got.sections_dropped, got.was_truncated) == ("entity_prose,relationships", "sources", True)


@pytest.mark.parametrize("costs,budget,kept", [([3, 3, 3], 9, 3), ([3, 3, 3], 8, 2), ([5, 1], 4, 0), ([4], 4, 1)])
def test_budget_prefix_stops_at_first_overflow(spark, costs, budget, kept):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(costs)], "q long, i int, cost int")
    assert budget_prefix(df, ["q"], [F.col("i")], "cost", F.lit(budget), budget).count() == kept


def test_hot_entity_is_complete_in_any_block_size(spark, data):
    """One entity holds a third of all chunk links; block-wise dedup gives the counters of the single block."""
    import numpy as np
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 4))
    rows = [(1000 + i, 5, i, f"text {i}", (base[i % 40] + rng.normal(scale=0.02, size=4)).tolist(), T0) for i in range(300)]
    chunks = spark.createDataFrame(rows, data.chunks.schema)
    links = spark.createDataFrame([(1000 + i, 1 if i % 3 == 0 else 2 + i % 2) for i in range(300)], "chunk_id long, entity_id long")
    hot = replace(data, chunks=chunks, chunk_entities=links)
    one = R.retrieve_single(question(spark, seed_entity_ids=[1]), hot).summary.first()
    many = R.retrieve_single(question(spark, seed_entity_ids=[1]), hot, replace(DEFAULTS, dedup_block_rows=25)).summary.first()
    assert one == many and one.chunks_fetched == 300 and 1 < one.chunks_after_dedup < 300


def test_questions_of_any_turn(spark, tmp_path):
    """More turns than a range holds, turns without a number and very large conversation ids: every question gets an id of its own."""
    for name in ("documents", "embeddings"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    rows = [(1, i, "user", f"text {i}") for i in range(1500)] + [(2, i, "user", "more") for i in (0, 999, 1000, 10**6)]
    rows += [(1, None, "user", "no turn"), (2, None, "user", "none"), (None, 5, "user", "no conversation"), (None, None, "user", "neither"),
             (1 << 61, 3, "user", "large"), (3, -1, "user", "before")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    t = Tables(spark, str(tmp_path))
    asked = t.asked().collect()
    assert len(asked) == len(rows) == len({r.query_id for r in asked}) and all(r.embedding is not None for r in asked)
    inside = [r for r in asked if r.conv_id in (1, 2) and r.turn is not None and r.turn < 1000]
    assert len(inside) == 1002 and all(r.query_id == r.conv_id * 1000 + r.turn for r in inside)
    assert sum(r.query_id < 0 for r in asked) == len(rows) - 1002
    for name in ("seeds_by_id", "query_plan_escalation", "retrieve_single"):
        found = entry.queries()[name](spark, str(tmp_path)).collect()
        assert name == "seeds_by_id" or {r.query_id for r in found} == {r.query_id for r in asked}


def test_part_ids(spark):
    rows = [(p, n) for p in (None, -1, 0, 7, 8, (1 << 63) - 1) for n in (None, -1, 0, 1, 999_999, 1_000_000, 1 << 40)]
    out = spark.createDataFrame(rows, "p long, n long").select("p", "n", numbered(F.col("p"), F.col("n"), 1_000_000).alias("id"))
    nested = {r.id: r for r in out.withColumn("sub", numbered(F.col("id"), F.lit(1), 10)).collect()}
    assert len(nested) == len(rows) == len({r["sub"] for r in nested.values()})
    assert all(i == r.p * 1_000_000 + r.n and r["sub"] == i * 10 + 1 for i, r in nested.items() if i >= 0)


def test_equal_questions_are_worked_out_once(spark, data, monkeypatch):
    asked = []
    anchor_rows = R.anchor_rows
    monkeypatch.setattr(R, "anchor_rows", lambda seeds, d: asked.extend(r.query_id for r in seeds.select("query_id").distinct().collect()) or anchor_rows(seeds, d))
    rows = [(1, unit(0), None), (2, unit(0), None), (3, unit(0), 40), (4, unit(1), None), (5, unit(1), None), (5, unit(1), None), (6, unit(0), None)]
    got = R.retrieve_single(spark.createDataFrame(rows, "query_id long, embedding array<float>, budget int"), data)
    assert sorted(asked) == [1, 3, 4, 5]  # 5 comes twice and stands for itself
    for part in (got.seeds, got.nodes, got.edges, got.wiki, got.chunks, got.summary):
        of = {i: sorted(map(str, part.where(F.col("query_id") == i).drop("query_id").collect())) for i in (1, 2, 3, 4, 6)}
        assert of[1] == of[2] == of[6]
    assert {r.query_id: r.budget for r in got.summary.collect()} == {1: 3600, 2: 3600, 3: 40, 4: 3600, 5: 3600, 6: 3600}


def awkward_links(spark):
    """Questions, nodes, links and chunks with copies, vectors of length zero, of other lengths and without numbers, and lost rows."""
    import random
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(30)] + [[0.0] * 4, [1.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 1e-7], [2.0, 0.0, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [1.0], []]
    chunks = [(i, 5, 0, "x" * rng.randint(0, 90) if i % 11 else None, rng.choice(base) if i % 13 else None, T0) for i in range(-20, 280)]
    links = [(rng.randint(-30, 290), rng.randint(0, 40)) for _ in range(700)] + [(None, 3), (4, None)]
    links += links[:50]
    asked = [(q, rng.choice(base) if q != 7 else None, rng.randint(0, 120), rng.randint(0, 120)) for q in range(30)]
    asked += [(50, base[0], 40, 40), (50, base[0], 40, 40)]
    seeds = [(q, rng.randint(0, 40)) for q, *_ in asked for _ in range(2) if q != 9] + [(60, 1)]
    nodes = [(q, rng.randint(0, 60), h) for q, *_ in asked for h in (1, 1, 2) if q != 9]
    return [spark.createDataFrame(rows, schema) for rows, schema in (
        (asked, "query_id long, embedding array<float>, seed_budget int, hop_budget int"), (seeds, "query_id long, entity_id long"),
        (nodes, "query_id long, entity_id long, hop int"), (links, "chunk_id long, entity_id long"),
        (chunks, "chunk_id long, source_id long, chunk_index int, text_content string, embedding array<float>, created_at timestamp_ntz"))]


def test_chunks_chosen_in_shares_equal_those_chosen_by_rows(spark, data, monkeypatch):
    from skein.operators import contexts
    asked, seeds, nodes, links, chunks = awkward_links(spark)
    graph = replace(data, chunks=chunks, chunk_entities=links)
    fixed = asked.withColumn("elastic", F.col("seed_budget") + F.col("hop_budget"))
    once = asked.groupBy("query_id").count().where("count = 1").select("query_id")
    own = [df.join(once, "query_id", "left_semi") for df in (seeds, nodes, asked, fixed)]
    chosen, counts = R._choose_by_rows(*own, graph, DEFAULTS)
    rooms = asked.withColumnsRenamed({"seed_budget": "seed_room", "hop_budget": "hop_room"})
    staged, stage = {}, contexts.stage

    def counting(df, name, *rest):
        out = stage(df, name, *rest)
        staged[name] = out.count()
        return out

    def rows(df):
        return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.collect())

    monkeypatch.setattr(contexts, "stage", counting)
    pairs = R.linked_chunks(seeds, nodes, links).count()
    for limits in ({}, {"SHARE_PAIRS": 64, "LEAST_PAIRS": 16, "SLICE_PAIRS": 20}, {"HELD_VALUES": 64, "LEAST_PAIRS": 8}):
        with monkeypatch.context() as m:
            for name, value in limits.items():
                m.setattr(contexts, name, value)
            found = contexts.choose_chunks(rooms, R.node_members(seeds, nodes), links, chunks, R.chunk_vectors(chunks))
        assert rows(found[0]) == rows(chosen) and rows(found[1]) == rows(counts.select("query_id", "fetched", "survived"))
        assert [r.query_id for r in found[2].collect()] == [50]  # it comes twice
    assert chosen.count() > 50 and max(staged.values()) < pairs / 2, (staged, pairs)  # no row for each pair


def test_questions_of_many_links_and_repeated_chunks_go_by_rows(spark):
    from skein.operators import contexts
    asked, seeds, nodes, links, chunks = awkward_links(spark)
    rooms = asked.withColumnsRenamed({"seed_budget": "seed_room", "hop_budget": "hop_room"})
    members = R.node_members(seeds, nodes)
    told = [contexts.choose_chunks(rooms, members, links, c, R.chunk_vectors(c), replace(DEFAULTS, dedup_block_rows=n)) for c, n in ((chunks, 90), (chunks.unionByName(chunks.limit(5)), 4096))]
    some, every = [{r.query_id for r in rest.collect()} for _, _, rest in told]
    assert {50} < some < every and told[0][1].count() > 0 and told[1][1].count() == 0
    assert not some & {r.query_id for r in told[0][1].collect()}


@pytest.mark.parametrize("x", [0.1234565, -0.1234565, 0.5, 0.0000005, 0.0000004999, 1.0, -0.9999995, 0.3333335, 2 / 3])
def test_rounds_like_the_engine(spark, x):
    import numpy as np
    from skein.operators.contexts import _rounded
    assert _rounded(np.array([x]))[0] == spark.range(1).select(F.round(F.lit(x), 6)).first()[0]
