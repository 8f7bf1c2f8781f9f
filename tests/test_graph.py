import random
from dataclasses import replace

import pytest

from skein.config import DEFAULTS
from skein.operators import graph


def relations(spark, edges):
    return spark.createDataFrame([(i, a, b, "knows") for i, (a, b) in enumerate(edges)],
                                 "relation_id long, source_entity_id long, target_entity_id long, relation_type string")


def seeds(spark, *pairs):
    return spark.createDataFrame(list(pairs), "query_id long, entity_id long")


def hops(df):
    return {(r.query_id, r.entity_id): r.hop for r in df.collect()}


def test_two_hop_chain(spark):
    rel = relations(spark, [(1, 2), (2, 3), (3, 4)])
    assert hops(graph.reach(seeds(spark, (0, 1)), rel)) == {(0, 1): 0, (0, 2): 1, (0, 3): 2}
    nodes = graph.traverse(seeds(spark, (0, 1)), rel)
    assert hops(nodes) == {(0, 2): 1, (0, 3): 2}
    edges = graph.induced_edges(seeds(spark, (0, 1)), nodes, rel).collect()
    assert {(e.relation_id, e.hop) for e in edges} == {(0, 1), (1, 2)}


def test_lonely_seed_and_incoming_edge(spark):
    rel = relations(spark, [(5, 6)])
    assert graph.traverse(seeds(spark, (0, 1)), rel).count() == 0
    assert hops(graph.traverse(seeds(spark, (0, 6)), rel)) == {(0, 5): 1}


@pytest.mark.parametrize("spokes,per_hop,kept", [(5, 10, 5), (15, 10, 10), (60, 100, 50)])
def test_star_caps(spark, spokes, per_hop, kept):
    rel = relations(spark, [(0, i) for i in range(1, spokes + 1)])
    nodes = graph.traverse(seeds(spark, (0, 0)), rel, replace(DEFAULTS, max_neighbors_per_hop=per_hop))
    assert nodes.count() == kept
    assert graph.induced_edges(seeds(spark, (0, 0)), nodes, rel).count() == kept


def test_seed_to_seed_edges_need_a_kept_node(spark):
    rel = relations(spark, [(1, 2), (1, 1), (3, 3), (2, 3)])
    s = seeds(spark, (0, 1), (0, 2))
    nodes = graph.traverse(s, rel)
    assert hops(nodes) == {(0, 3): 1}
    assert {e.relation_id for e in graph.induced_edges(s, nodes, rel).collect()} == {2, 3}


@pytest.mark.parametrize("lists", [1, 3, 64])
def test_capped_walk_around_hubs_is_exact(spark, lists):
    """Hubs hold most edges; however short the neighbour lists are cut, the result stays the brute-force one."""
    rng = random.Random(3)
    edges = [(rng.choice([0, 1, rng.randrange(60)]), rng.randrange(60)) for _ in range(200)] + [(0, i) for i in range(60)]
    k = 4
    degree, near = {}, {}
    for a, b in edges:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    asked = {q: [rng.randrange(60) for _ in range(1 + q % 3)] for q in range(12)}
    want = set()
    for q, start in asked.items():
        seen, front = set(start), set(start)
        for hop in (1, 2):
            front = {n for f in front for n in near.get(f, ())} - seen
            seen |= front
            want |= {(q, n, hop) for n in sorted(front, key=lambda n: (-degree[n], n))[:k]}
    rel = relations(spark, edges)
    got = graph.traverse(seeds(spark, *[(q, e) for q, es in asked.items() for e in es]), rel,
                         replace(DEFAULTS, max_neighbors_per_hop=k, frontier_list_rows=lists))
    assert {(r.query_id, r.entity_id, r.hop) for r in got.collect()} == want


def test_degree_counts_a_loop_twice_and_summary(spark):
    rel = relations(spark, [(1, 1), (1, 2), (3, 1)])
    assert {r.node: r.degree for r in graph.degrees(rel).collect()} == {1: 4, 2: 1, 3: 1}
    ents = spark.createDataFrame([(1, "person"), (2, "person"), (3, "work-place"), (4, "x")], "entity_id long, entity_type string")
    told = {r.entity_id: r.relation_summary for r in graph.relation_summaries(rel, ents).collect()}
    assert told == {1: "Connected to 3 Person, 1 Work-Place", 2: "Connected to 1 Person", 3: "Connected to 1 Person", 4: "No relations"}


def test_links_show_direction(spark):
    rel = relations(spark, [(1, 2)])
    slugs = spark.createDataFrame([(1, "one"), (2, "two")], "id long, slug string")
    got = {(r.entity_id, r.label, r.target_slug) for r in graph.one_hop_links(rel, slugs).collect()}
    assert got == {(1, "knows", "two"), (2, "← knows", "one")}


def test_induced_edges_around_hubs_make_no_row_for_every_two_nodes(spark):
    """Hubs with loops, parallel relations, both directions and null ends: as by brute force, and no join of a query's nodes with each other."""
    rng = random.Random(5)
    edges = [(rng.choice([0, 1, rng.randrange(40)]), rng.randrange(40)) for _ in range(150)] + [(i, 0) for i in range(40)] + [(None, 3), (4, None)]
    starts = {q: {rng.randrange(40) for _ in range(2)} for q in range(8)}
    rel = relations(spark, edges)
    s = seeds(spark, *[(q, e) for q, es in starts.items() for e in es])
    nodes = graph.traverse(s, rel)
    hop = {(q, e): 0 for q, es in starts.items() for e in es} | hops(nodes)
    want = {(q, i, min(hop[q, a], hop[q, b]) + 1) for q in starts for i, (a, b) in enumerate(edges)
            if (q, a) in hop and (q, b) in hop and hop[q, a] + hop[q, b] > 0}
    got = graph.induced_edges(s, nodes, rel)
    rows = [(r.query_id, r.relation_id, r.hop) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("limits", [{}, {"REACH_PAIRS": 40, "REACH_MARKS": 50}])
def test_last_hop_meets_all_where_the_neighbours_are(spark, monkeypatch, limits):
    """Against a walk in memory, with hubs, self-loops, lost seeds and small batches; no exchange after the last hop's rows exist."""
    import random
    for name, value in limits.items():
        monkeypatch.setattr(graph, name, value)
    rng = random.Random(4)
    ends = [(i, 0 if i % 3 else 1) for i in range(2, 120)] + [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(60)] + [(5, 5), (-7, 3), (None, 4), (4, None)]
    seeds = [(q, rng.randint(-10, 150)) for q in range(40) for _ in range(2)] + [(-3, 0), (-3, 0), (99, 10_000), (98, 5), (97, None)]
    near = {}
    for a, b in ends:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    wanted = {}
    for q, e in seeds:
        wanted[q, e] = 0
    for hop in (1, 2):
        for (q, e), h in list(wanted.items()):
            for n in near.get(e, ()) if h == hop - 1 else ():
                wanted.setdefault((q, n), hop)
    asked = spark.createDataFrame(seeds, "query_id long, entity_id long")
    relations = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "relation_id long, source_entity_id long, target_entity_id long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in (before, "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            found = graph.reach(asked, relations)
            got = [((r.query_id, r.entity_id), r.hop) for r in found.collect()]
            assert len(got) == len(wanted) and dict(got) == wanted
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "LeftAnti" not in plan
