"""Graph analysis on hand-made and planted graphs, against sequential versions."""

from collections import Counter, defaultdict
import random

import pytest

from skein.operators import analysis

E, R = "entity_id long, status string", "source_entity_id long, target_entity_id long, status string"


def view_of(spark, ids, pairs, status="published"):
    return analysis.graph_view(spark.createDataFrame([(i, status) for i in ids], E), spark.createDataFrame([(a, b, "published") for a, b in pairs], R))


def power(ids, pairs, damping=0.85, tolerance=1e-6, rounds=100):
    weight = Counter((a, b) for a, b in pairs if a != b)
    out = Counter()
    for (a, _), w in weight.items():
        out[a] += w
    n = len(ids)
    rank = {i: 1 / n for i in ids}
    for _ in range(rounds):
        lost = sum(rank[i] for i in ids if i not in out)
        new = {i: (1 - damping) / n + damping * lost / n for i in ids}
        for (a, b), w in weight.items():
            new[b] += damping * rank[a] * w / out[a]
        change = sum(abs(new[i] - rank[i]) for i in ids)
        rank = new
        if change < n * tolerance:
            break
    return rank


def modularity(part, pairs):
    m = len(pairs)
    k, inner, tot = Counter(), Counter(), Counter()
    for a, b in pairs:
        k[a] += 1
        k[b] += 1
        inner[part[a]] += part[a] == part[b]
    for i, d in k.items():
        tot[part[i]] += d
    return sum(inner[c] / m - (tot[c] / (2 * m)) ** 2 for c in tot)


def sequential(ids, pairs):
    """Modularity communities by moving one node at a time, then contracting."""
    m2 = 2 * len(pairs)
    graph, part = defaultdict(Counter), {i: i for i in ids}
    for a, b in pairs:
        graph[a][b] += 1
        graph[b][a] += 1
    loops = Counter()
    while True:
        k = {i: sum(graph[i].values()) + loops[i] for i in set(part.values())}
        label, tot, moved = {i: i for i in k}, dict(k), False
        again = True
        while again:
            again = False
            for i in sorted(label):
                near = Counter()
                for j, w in graph[i].items():
                    near[label[j]] += w
                tot[label[i]] -= k[i]
                best = max(sorted({*near, label[i]}), key=lambda c: near[c] - k[i] * tot[c] / m2)
                if near[best] - k[i] * tot[best] / m2 <= near[label[i]] - k[i] * tot[label[i]] / m2 + 1e-12:
                    best = label[i]
                tot[best] += k[i]
                if best != label[i]:
                    label[i], again, moved = best, True, True
        if not moved:
            return part
        part = {i: label[c] for i, c in part.items()}
        new, inner = defaultdict(Counter), Counter()
        for a in list(graph):
            for b, w in graph[a].items():
                if label[a] == label[b]:
                    inner[label[a]] += w
                else:
                    new[label[a]][label[b]] += w
        for i, w in loops.items():
            inner[label[i]] += w
        graph, loops = new, inner


def planted(seed, groups, size, inside, outside):
    rng = random.Random(seed)
    ids = list(range(groups * size))
    pairs = [(a, b) for a in ids for b in ids if a < b and rng.random() < (inside if a // size == b // size else outside)]
    return ids, pairs


def test_view(spark):
    entities = spark.createDataFrame([(1, "published"), (2, "published"), (3, "pending_review"), (4, "published")], E)
    relations = spark.createDataFrame([(1, 2, "published"), (1, 2, "published"), (2, 1, "published"), (1, 1, "published"), (1, 3, "published"),
                                       (2, 4, "pending_review"), (None, 1, "published"), (9, 1, "published")], R)
    view = analysis.graph_view(entities, relations)
    assert sorted(r[0] for r in view.nodes.collect()) == [1, 2, 4]
    assert sorted(map(tuple, view.directed.collect())) == [(1, 2, 2), (2, 1, 1)]
    assert [tuple(r) for r in view.undirected.collect()] == [(1, 2)]


@pytest.mark.parametrize("hub_edges", [100_000, 3])
def test_pagerank_equals_power_iteration(spark, hub_edges):
    rng = random.Random(4)
    ids = list(range(60))
    pairs = [(rng.randrange(60), int(rng.random() ** 3 * 60)) for _ in range(200)] + [(7, i) for i in range(30)]  # parallel edges, loops, a hub
    found = {r[0]: r[1] for r in analysis.pagerank(view_of(spark, ids, pairs), hub_edges=hub_edges).collect()}
    wanted = power(ids, pairs)
    assert found.keys() == wanted.keys() and all(abs(found[i] - wanted[i]) < 1e-12 for i in ids)


def test_pagerank_of_a_star_and_of_nothing(spark):
    n = 100_000
    spokes = spark.range(1, n + 1)
    view = analysis.graph_view(spark.range(0, n + 1).selectExpr("id entity_id", "'published' status"),
                               spokes.selectExpr("id source_entity_id", "0L target_entity_id", "'published' status"))
    found = {r[0]: r[1] for r in analysis.pagerank(view, tolerance=0, max_rounds=5).where("entity_id < 3").collect()}
    wanted = power(range(n + 1), [(i, 0) for i in range(1, n + 1)], tolerance=0, rounds=5)
    assert all(abs(found[i] / wanted[i] - 1) < 1e-9 for i in (0, 1, 2))
    assert analysis.pagerank(view_of(spark, [], [])).count() == 0


@pytest.mark.parametrize("case", [(1, 6, 20, 0.5, 0.02), (2, 10, 12, 0.6, 0.03)])
def test_communities_near_sequential_modularity(spark, case):
    ids, pairs = planted(*case)
    view = view_of(spark, [*ids, 5000, 5001], pairs)
    found = {r[0]: r[1] for r in analysis.communities(view).collect()}
    assert found[5000] == 5000 and found[5001] == 5001 and len(found) == len(ids) + 2
    assert all(found[c] == c and c <= i for i, c in found.items())
    ours, theirs = modularity(found, pairs), modularity(sequential(ids, pairs), pairs)
    assert ours >= 0.98 * theirs
    members = spark.createDataFrame(list(found.items()), "entity_id long, community_id long")
    assert abs(analysis.modularity(members, view.undirected).first()[0] - ours) < 1e-12


def test_communities_again_with_hubs_and_without_edges(spark):
    ids, pairs = planted(3, 4, 10, 0.7, 0.05)
    pairs += [(0, i) for i in range(100, 160)]
    view = view_of(spark, [*ids, *range(100, 160)], pairs)
    first, second = (sorted(map(tuple, analysis.communities(view, hub_edges=h).collect())) for h in (100_000, 8))
    assert first == second and dict(first)[120] == dict(first)[0]
    assert sorted(map(tuple, analysis.communities(view_of(spark, [3, 4], [(3, 3)])).collect())) == [(3, 3), (4, 4)]
    assert analysis.communities(view_of(spark, [], [])).count() == 0


def test_cohesion_and_surprise(spark):
    view = view_of(spark, range(1, 7), [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3)])
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)], "entity_id long, community_id long")
    assert sorted(map(tuple, analysis.cohesion(members, view.undirected).collect())) == [(1, 3, 3, 1.0), (4, 2, 1, 1.0), (6, 1, 0, 0.0)]
    loose = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 3), (6, 6)], "entity_id long, community_id long")
    ranks = analysis.pagerank(view)
    found = analysis.surprising_connections(view, ranks, loose, 3).collect()
    rank = power(range(1, 7), [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3)])
    part, dense = {1: 1, 2: 1, 3: 3, 4: 4, 5: 3, 6: 6}, {1: 1.0, 3: 1.0, 4: 0.0, 6: 0.0}
    wanted = sorted(((-round(rank[a] * rank[b] * (1 - (dense[part[a]] + dense[part[b]]) / 2), 15), a, b)
                     for a, b in [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3)] if part[a] != part[b]))[:3]
    assert [(-r["surprise"], r["src"], r["dst"]) for r in found] == wanted and [r["place"] for r in found] == [1, 2, 3]
    assert found[0]["reason"] == f"bridge between community {part[found[0]['src']]} and community {part[found[0]['dst']]}"
