"""Graph analysis over the published graph. The surveyed system only specifies these; the rules are those of its specification."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.operators import analysis
from skein.plans.oracles import cte
from skein.plans.registry import query
from skein.session import staging_root
from skein.sources.bridge import Tables
from skein.sources.runs import RunStore


def view_of(t: Tables) -> analysis.View:
    return analysis.graph_view(t.entities(), t.relations())


cte("view_nodes", "SELECT entity_id AS node FROM entities WHERE entity_type <> 'concept'")
cte("view_directed", """
SELECT source_entity_id AS src, target_entity_id AS dst, count(*) AS weight FROM relations
WHERE source_entity_id <> target_entity_id AND source_entity_id IN (SELECT node FROM view_nodes) AND target_entity_id IN (SELECT node FROM view_nodes)
GROUP BY 1, 2""")
cte("view_undirected", "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM view_directed")
cte("view_shares", "SELECT src, dst, CAST(weight AS DOUBLE) / sum(weight) OVER (PARTITION BY src) AS share FROM view_directed")
cte("view_count", "SELECT CAST(count(*) AS DOUBLE) AS n FROM view_nodes")
cte("rank_rounds", """
SELECT 0 AS round, node, 1.0 / n AS rank, CAST(1e9 AS DOUBLE) AS change FROM view_nodes, view_count
UNION ALL
SELECT round, node, new, sum(abs(new - rank)) OVER () FROM (
  SELECT p.round + 1 AS round, p.node, p.rank, p.change, 0.15 / n + 0.85 * lost / n + 0.85 * coalesce(got, 0) AS new
  FROM rank_rounds p CROSS JOIN view_count
  LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM view_shares JOIN rank_rounds ON src = node GROUP BY dst) ON dst = p.node
  CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM rank_rounds WHERE node NOT IN (SELECT src FROM view_shares)))
WHERE change >= (SELECT n FROM view_count) * 1e-6 AND round <= 100""")
cte("ranks", "SELECT node, rank FROM rank_rounds WHERE round = (SELECT max(round) FROM rank_rounds)")
cte("typed_members", "SELECT entity_id, entity_type AS community_id FROM entities WHERE entity_type <> 'concept'")
cte("typed_cohesion", """
SELECT community_id, n_members, coalesce(n_edges, 0) AS n_edges,
  CASE WHEN n_members > 1 THEN 2.0 * coalesce(n_edges, 0) / (n_members * (n_members - 1)) ELSE 0 END AS cohesion
FROM (SELECT community_id, count(*) AS n_members FROM typed_members GROUP BY 1)
LEFT JOIN (SELECT x.community_id, count(*) AS n_edges FROM view_undirected JOIN typed_members x ON x.entity_id = a JOIN typed_members y ON y.entity_id = b
           WHERE x.community_id = y.community_id GROUP BY 1) USING (community_id)""")


@query("graph_view_directed", "SELECT src, dst, weight FROM view_directed")
def graph_view_directed(t: Tables):
    return view_of(t).directed


@query("graph_view_undirected", "SELECT a, b FROM view_undirected")
def graph_view_undirected(t: Tables):
    return view_of(t).undirected


@query("pagerank", "SELECT node AS entity_id, round(rank, 9) AS rank FROM ranks")
def pagerank(t: Tables):
    return analysis.pagerank(view_of(t)).select("entity_id", F.round("rank", 9).alias("rank"))


def _by_type(t: Tables):
    return t.entities().where("status = 'published'").select("entity_id", F.col("entity_type").alias("community_id"))


@query("cohesion_by_type", "SELECT community_id, n_members, n_edges, round(cohesion, 12) AS cohesion FROM typed_cohesion")
def cohesion_by_type(t: Tables):
    """Cohesion of a given membership, here the entity types."""
    return analysis.cohesion(_by_type(t), view_of(t).undirected).withColumn("cohesion", F.round("cohesion", 12))


@query("surprising_by_type", """
SELECT place, src, dst, round(surprise * 1e6, 6) AS surprise, reason FROM (
  SELECT CAST(row_number() OVER (ORDER BY surprise DESC, src, dst) AS INTEGER) AS place, * FROM (
    SELECT src, dst, round(x.rank * y.rank * (1.0 - (cx.cohesion + cy.cohesion) / 2), 15) AS surprise,
      'bridge between community ' || mx.community_id || ' and community ' || my.community_id AS reason
    FROM view_directed JOIN ranks x ON x.node = src JOIN ranks y ON y.node = dst
    JOIN typed_members mx ON mx.entity_id = src JOIN typed_members my ON my.entity_id = dst
    JOIN typed_cohesion cx ON cx.community_id = mx.community_id JOIN typed_cohesion cy ON cy.community_id = my.community_id
    WHERE mx.community_id <> my.community_id)) WHERE place <= 50""")
def surprising_by_type(t: Tables):
    """Surprising connections between given groups, here the entity types."""
    view = view_of(t)
    return analysis.surprising_connections(view, analysis.pagerank(view), _by_type(t)).withColumn("surprise", F.round(F.col("surprise") * 1e6, 6))


@query("communities")
def communities(t: Tables):
    return analysis.communities(view_of(t))


@query("graph_analysis")
def graph_analysis(t: Tables):
    """Members of a whole analysis run with their rank and the cohesion of their community."""
    run = analysis.analyse(t.entities(), t.relations())
    return run["community_members"].join(run["community_summaries"], "community_id").select("entity_id", "community_id", "pagerank_score", "n_members", "cohesion")


@query("latest_run", "SELECT community_id, n_members, n_edges, round(cohesion, 12) AS cohesion FROM typed_cohesion")
def latest_run(t: Tables):
    """The latest committed run of a snapshot table, after a superseded one was removed and beside one that was never committed."""
    store = RunStore(t.spark, f"{staging_root(t.spark)}/runs-{uuid.uuid4().hex}")
    view, members = view_of(t), _by_type(t)
    store.save({"summaries": analysis.cohesion(members, view.undirected.limit(0))})
    store.save({"summaries": analysis.cohesion(members, view.undirected)})
    store.write(store.start(), "summaries", analysis.cohesion(members.limit(0), view.undirected))
    store.retain(1)
    return store.read("summaries").withColumn("cohesion", F.round("cohesion", 12))
