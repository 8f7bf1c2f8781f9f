"""Graph walks, look-ups and snapshot maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.config import DEFAULTS
from skein.functions import vectors as V
from skein.operators import browse, graph, merge, retrieval as R
from skein.operators.knn import nearest
from skein.operators.ranking import page
from skein.plans.oracles import cosine, cte, iso
from skein.plans.registry import query
from skein.sources.bridge import CHUNKS_PER_SOURCE, Tables, numbered
from skein.operators.wiki import iso as iso_col


def big(*cols: str):
    return [F.col(c).cast("bigint").alias(c) for c in cols]


# --- degrees and adjacency -------------------------------------------------------------------------
@query("degree_centrality", """
SELECT entity_id, degree, relative_centrality FROM anchors""")
def degree_centrality(t: Tables):
    degree = F.coalesce("degree", F.lit(0)).cast("bigint")
    return t.entities().select("entity_id").join(graph.degrees(t.relations()).withColumnRenamed("node", "entity_id"), "entity_id", "left").select(
        "entity_id", degree.alias("degree"), V.relative_centrality(degree).alias("relative_centrality"))


@query("relation_summary", "SELECT entity_id, relation_summary FROM anchors")
def relation_summary(t: Tables):
    return graph.relation_summaries(t.relations(), t.entities().select("entity_id", "entity_type"))


@query("structural_anchors", """
SELECT entity_id, name, entity_type, description, degree, relative_centrality, relation_summary FROM anchors""")
def structural_anchors(t: Tables):
    return graph.anchors(t.entities(), t.relations())


@query("adjacency", "SELECT node, nbr, count(*) AS n, CAST(sum(CAST(outgoing AS INT)) AS BIGINT) AS outgoing FROM adj GROUP BY node, nbr")
def adjacency(t: Tables):
    return graph.adjacency(t.relations()).groupBy("node", "nbr").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outgoing")).alias("outgoing"))


cte("trade", """
SELECT l_partkey AS source_entity_id, l_suppkey + 1000000000000 AS target_entity_id, l_returnflag AS relation_type, l_orderkey AS chunk_id,
  l_orderkey * 10 + l_linenumber AS relation_id FROM lineitem
UNION ALL
SELECT o_custkey + 2000000000000, l_partkey, 'ordered', l_orderkey, l_orderkey * 10 + l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")


def trade(t: Tables):
    """A large relation log with repeats: part -> supplier and customer -> part for every order line."""
    line = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    ident = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("relation_id")
    supply = line.select(F.col("l_partkey").alias("source_entity_id"), (F.col("l_suppkey") + 1_000_000_000_000).alias("target_entity_id"),
                         F.col("l_returnflag").alias("relation_type"), F.col("l_orderkey").alias("chunk_id"), ident)
    bought = line.join(t.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("o_custkey") + 2_000_000_000_000).alias("source_entity_id"), F.col("l_partkey").alias("target_entity_id"),
        F.lit("ordered").alias("relation_type"), F.col("l_orderkey").alias("chunk_id"), ident)
    return supply.unionByName(bought)


@query("relation_keep_one", """
SELECT source_entity_id, target_entity_id, relation_type, chunk_id, min(relation_id) AS relation_id FROM trade GROUP BY ALL""")
def relation_keep_one(t: Tables):
    return merge.keep_first(trade(t), ["source_entity_id", "target_entity_id", "relation_type", "chunk_id"], "relation_id")


@query("degree_trade", """
SELECT node, count(*) AS degree FROM (SELECT source_entity_id AS node FROM trade UNION ALL SELECT target_entity_id FROM trade) GROUP BY node""")
def degree_trade(t: Tables):
    return graph.degrees(trade(t))


# --- walks -----------------------------------------------------------------------------------------
@query("bfs_2hop", """
SELECT query_id, entity_id, CAST(min(hop) AS BIGINT) AS hop FROM (
  SELECT query_id, entity_id, 0 AS hop FROM single_hop0 UNION ALL SELECT query_id, entity_id, 1 FROM single_hop1
  UNION ALL SELECT query_id, entity_id, 2 FROM single_hop2) GROUP BY ALL""")
def bfs_2hop(t: Tables):
    seeds = R.find_seeds(t.questions(), t.entities())
    return graph.reach(seeds, t.relations()).select("query_id", "entity_id", *big("hop"))


@query("bfs_capped", "SELECT query_id, entity_id, CAST(hop AS BIGINT) AS hop, entity_degree FROM single_nodes")
def bfs_capped(t: Tables):
    seeds = R.find_seeds(t.questions(), t.entities())
    return graph.traverse(seeds, t.relations()).select("query_id", "entity_id", *big("hop", "entity_degree"))


cte("wide_nodes", """
SELECT query_id, entity_id, hop, degree AS entity_degree FROM (
  SELECT *, 1 AS hop FROM single_hop1 UNION ALL SELECT *, 2 FROM single_hop2) JOIN degrees ON node = entity_id
QUALIFY row_number() OVER (PARTITION BY query_id, hop ORDER BY degree DESC, entity_id) <= 100""")


@query("bfs_total_ceiling", """
SELECT query_id, entity_id, CAST(hop AS BIGINT) AS hop FROM wide_nodes
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, entity_degree DESC, entity_id) <= 50""")
def bfs_total_ceiling(t: Tables):
    """With 100 nodes per hop the ceiling of 50 nodes binds."""
    from dataclasses import replace
    wide = replace(DEFAULTS, max_neighbors_per_hop=100)
    return graph.traverse(R.find_seeds(t.questions(), t.entities()), t.relations(), wide).select("query_id", "entity_id", *big("hop"))


@query("subgraph_edges", """
SELECT query_id, relation_id, source_name, source_type, relation_type, target_name, target_type, CAST(hop AS BIGINT) AS hop, confidence_tag, line FROM single_edges""")
def subgraph_edges(t: Tables):
    from skein.session import stage
    seeds = stage(R.find_seeds(t.questions(), t.entities()), "seeds")
    nodes = stage(graph.traverse(seeds, t.relations()), "nodes")
    rows = R.edge_rows(graph.induced_edges(seeds, nodes, t.relations()), t.entities())
    return rows.select("query_id", "relation_id", "source_name", "source_type", "relation_type", "target_name", "target_type",
                       *big("hop"), "confidence_tag", "line")


@query("seeds_by_id", """
SELECT 1000 * q.query_id + w.rank AS pick, q.query_id, w.entity_id, CAST(1.0 AS DOUBLE) AS score, 'high' AS seed_quality
FROM questions q, LATERAL (SELECT 1 AS rank, q.query_id % 997 AS entity_id UNION ALL SELECT 2, q.query_id * 3 + 1) w
WHERE w.entity_id IN (SELECT entity_id FROM entities)""")
def seeds_by_id(t: Tables):
    """Two wanted ids per question; ids that are no entity drop out."""
    wanted = t.questions().select("query_id", F.posexplode(F.array(F.col("query_id") % 997, F.try_add(F.try_multiply(F.col("query_id"), F.lit(3)), F.lit(1)))).alias("rank", "entity_id"))
    found = R.seeds_by_id(wanted.withColumn("rank", F.col("rank") + 1), t.entities())
    return found.select(numbered(F.col("query_id"), F.col("rank"), 1000).alias("pick"), "query_id", "entity_id", "score", "seed_quality")


@query("one_hop_links", """
SELECT a.node AS entity_id, a.relation_id, CASE WHEN outgoing THEN relation_type ELSE '← ' || relation_type END AS label, e.slug AS target_slug
FROM adj a JOIN entities e ON e.entity_id = a.nbr""")
def one_hop_links(t: Tables):
    return graph.one_hop_links(t.relations(), t.named_slug()).select("entity_id", "relation_id", "label", "target_slug")


@query("connected_entities", """
SELECT entity_id, entity_id AS connected_id FROM entities UNION SELECT node, nbr FROM adj""")
def connected_entities(t: Tables):
    return graph.connected(t.relations(), t.entities())


@query("l2_candidates", """
SELECT vec_id AS query_id, entity_id, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 6), entity_id) AS rank, round(d, 4) AS distance
FROM (SELECT q.vec_id, e.entity_id, list_distance(q.v, b.v) AS d FROM vecs q, entities e JOIN vecs b ON b.vec_id = e.vec_id)
WHERE d <= 0.6 QUALIFY rank <= 5""")
def l2_candidates(t: Tables):
    asked = t.raw("embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    base = t.entities().select(F.col("entity_id").alias("base_id"), "embedding")
    found = nearest(asked, base, DEFAULTS.resolution_top_k, "l2", DEFAULTS.resolution_distance)
    return found.select("query_id", F.col("base_id").alias("entity_id"), *big("rank"), F.round("distance", 4).alias("distance"))


@query("l2_wide", """
SELECT vec_id AS query_id, base_id, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 6), base_id) AS rank, round(d, 4) AS distance
FROM (SELECT q.vec_id, b.vec_id AS base_id, list_distance(q.v, b.v) AS d FROM vecs q, vecs b) WHERE d <= 1.2 QUALIFY rank <= 5""")
def l2_wide(t: Tables):
    v = t.raw("embeddings")
    found = nearest(v.select(F.col("vec_id").alias("query_id"), "embedding"), v.select(F.col("vec_id").alias("base_id"), "embedding"), 5, "l2", 1.2)
    return found.select("query_id", "base_id", *big("rank"), F.round("distance", 4).alias("distance"))


@query("chunk_similarity", f"""
SELECT chunk_id, round({cosine('a.v', 'b.v')}, 4) AS similarity, round(1 - {cosine('a.v', 'b.v')}, 4) AS distance
FROM chunks c JOIN vecs a ON a.vec_id = c.vec_id JOIN entities e ON e.entity_id = c.source_id JOIN vecs b ON b.vec_id = e.vec_id""")
def chunk_similarity(t: Tables):
    about = t.entities().select(F.col("entity_id").alias("source_id"), F.col("embedding").alias("e"))
    both = t.chunks().select("chunk_id", "source_id", "embedding").join(about, "source_id")
    return both.select("chunk_id", F.round(V.cosine_batch("embedding", "e"), 4).alias("similarity"),
                       F.round(V.cosine_distance(F.col("embedding"), F.col("e")), 4).alias("distance"))


# --- lists and look-ups ------------------------------------------------------------------------------
NO_VEC = "entity_id, name, entity_type, description, status"


@query("list_entities_page", f"""
SELECT {NO_VEC}, {iso('created_at')} AS created_at, (SELECT count(*) FROM entities WHERE status = 'published' AND entity_type = 'person' AND name ILIKE '%an%') AS total
FROM entities WHERE status = 'published' AND entity_type = 'person' AND name ILIKE '%an%' ORDER BY entities.created_at DESC, entity_id LIMIT 20 OFFSET 10""")
def list_entities_page(t: Tables):
    rows = browse.matching(browse.without_vectors(t.entities()), {"name": "an"}, status="published", entity_type="person")
    found, total = browse.listing(rows, "entity_id", 10, 20)
    return found.withColumn("created_at", iso_col(F.col("created_at"))).withColumn("total", F.lit(total.first()["total"]))


@query("list_sources_filtered", f"""
SELECT source_id, storage_key, file_name, file_type, CAST(file_size AS BIGINT) AS file_size, status, metadata, {iso('created_at')} AS created_at
FROM sources WHERE status = 'processed' AND file_name ILIKE '%_1%' ORDER BY sources.created_at DESC, source_id LIMIT 100""")
def list_sources_filtered(t: Tables):
    found, _ = browse.listing(browse.matching(t.sources(), {"file_name": "_1"}, status="processed"), "source_id", 0, 500)
    return found.withColumn("created_at", iso_col(F.col("created_at"))).withColumn("file_size", F.col("file_size").cast("bigint"))


@query("list_jobs_page", f"""
SELECT job_id, job_type, target_entity_id, status, CAST(attempts AS BIGINT) AS attempts, {iso('created_at')} AS created_at
FROM jobs WHERE status = 'pending' AND job_type = 'synthesize_entity' ORDER BY jobs.created_at DESC, job_id LIMIT 20""")
def list_jobs_page(t: Tables):
    found, _ = browse.listing(browse.matching(t.jobs(), status="pending", job_type="synthesize_entity"), "job_id")
    return found.select("job_id", "job_type", "target_entity_id", "status", *big("attempts"), iso_col(F.col("created_at")).alias("created_at"))


@query("list_relations_page", f"""
SELECT relation_id, source_entity_id, target_entity_id, relation_type, confidence_tag, {iso('created_at')} AS created_at
FROM relations WHERE relation_type = 'cites' ORDER BY relations.created_at DESC, relation_id LIMIT 50""")
def list_relations_page(t: Tables):
    found, _ = browse.listing(browse.matching(t.relations(), relation_type="cites"), "relation_id", 0, 50)
    return found.select("relation_id", "source_entity_id", "target_entity_id", "relation_type", "confidence_tag", iso_col(F.col("created_at")).alias("created_at"))


@query("list_totals", """
SELECT 'entities' AS listing, count(*) AS total FROM entities UNION ALL SELECT 'published', count(*) FROM entities WHERE status = 'published'
UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'relations', count(*) FROM relations
UNION ALL SELECT 'pending_jobs', count(*) FROM jobs WHERE status = 'pending'""")
def list_totals(t: Tables):
    def total(name, df):
        return df.agg(F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("listing"), "total")
    return (total("entities", t.entities()).unionByName(total("published", browse.matching(t.entities(), status="published")))
            .unionByName(total("chunks", t.chunks())).unionByName(total("relations", t.relations()))
            .unionByName(total("pending_jobs", browse.matching(t.jobs(), status="pending"))))


@query("source_chunks_page", """
SELECT chunk_id, source_id, CAST(chunk_index AS BIGINT) AS chunk_index, md5(text_content) AS text_md5 FROM chunks
WHERE source_id = (SELECT source_id FROM chunks GROUP BY source_id ORDER BY count(*) DESC, source_id LIMIT 1) ORDER BY chunk_index LIMIT 20 OFFSET 5""")
def source_chunks_page(t: Tables):
    """Second page of the chunks of the longest source, in order."""
    sizes = t.chunks().groupBy("source_id").count()
    longest = page(sizes, [F.col("count").desc(), F.col("source_id")], 0, 1)
    rows = browse.without_vectors(t.chunks()).join(longest.select("source_id"), "source_id", "left_semi")
    return page(rows, [F.col("chunk_index")], 5, 20).select("chunk_id", "source_id", *big("chunk_index"), F.md5(F.col("text_content").cast("binary")).alias("text_md5"))


@query("chunk_listing", """
SELECT chunk_id, source_id, CAST(chunk_index AS BIGINT) AS chunk_index, 'text' AS chunk_type, md5(text_content) AS text_md5 FROM chunks""")
def chunk_listing(t: Tables):
    return t.chunks().select("chunk_id", "source_id", *big("chunk_index"), F.lit("text").alias("chunk_type"), F.md5(F.col("text_content").cast("binary")).alias("text_md5"))


def _busiest(t: Tables):
    """Id of the entity with the most relation ends: one top-1 row."""
    return page(graph.degrees(t.relations()), [F.col("degree").desc(), F.col("node")], 0, 1).first()["node"]


BUSY = "(SELECT node FROM degrees ORDER BY degree DESC, node LIMIT 1)"
for _direction, _cond in {"outgoing": f"source_entity_id = {BUSY}", "incoming": f"target_entity_id = {BUSY}",
                          "both": f"source_entity_id = {BUSY} OR target_entity_id = {BUSY}"}.items():
    def _listed(t: Tables, direction=_direction):
        return browse.entity_relations(t.relations(), _busiest(t), direction).select(
            "relation_id", "source_entity_id", "target_entity_id", "relation_type")
    query(f"entity_relations_{_direction}", f"SELECT relation_id, source_entity_id, target_entity_id, relation_type FROM relations WHERE {_cond}")(_listed)


@query("page_by_slug", f"""
SELECT page_id, entity_id, title, slug, status FROM wiki_pages WHERE lower(slug) = (SELECT lower(slug) FROM entities WHERE entity_id = {BUSY})""")
def page_by_slug(t: Tables):
    slug_of = browse.get_by_id(t.named_slug(), "id", _busiest(t)).first()["slug"]
    return browse.page_by_slug(t.wiki_pages(), slug_of.upper()).select("page_id", "entity_id", "title", "slug", "status")


@query("entity_wiki_page", f"SELECT page_id, entity_id, title, slug FROM wiki_pages WHERE entity_id = {BUSY}")
def entity_wiki_page(t: Tables):
    known = browse.get_by_id(t.entities(), "entity_id", _busiest(t)).select("entity_id")
    return t.wiki_pages().join(known, "entity_id", "left_semi").select("page_id", "entity_id", "title", "slug")


@query("page_mentions", """
SELECT p.page_id, e.entity_id, e.name, e.entity_type FROM wiki_pages p JOIN (SELECT entity_id AS owner, entity_id AS other FROM entities UNION SELECT node, nbr FROM adj) c
  ON c.owner = p.entity_id JOIN entities e ON e.entity_id = c.other""")
def page_mentions(t: Tables):
    from skein.operators.wiki import page_backlinks
    return browse.page_mentions(page_backlinks(t.wiki_pages(), t.relations(), t.entities()), t.entities())


# --- merges ------------------------------------------------------------------------------------------
# equal normalised name and type: the least id survives; a second rule chains ids three apart
cte("same_name", """
SELECT entity_id AS from_id, min(entity_id) OVER (PARTITION BY lower(name), entity_type) AS into_id FROM entities
QUALIFY from_id <> into_id""")


def same_name(t: Tables):
    named = t.entity_names().select("entity_id", F.lower("name").alias("k"), "entity_type")
    least = named.groupBy("k", "entity_type").agg(F.min("entity_id").alias("into_id"))
    return named.join(least, ["k", "entity_type"]).filter("entity_id <> into_id").select(F.col("entity_id").alias("from_id"), "into_id")


cte("merged_relations", """
SELECT source_entity_id, target_entity_id, relation_type, chunk_id, min(relation_id) AS relation_id FROM (
  SELECT relation_id, coalesce(a.into_id, source_entity_id) AS source_entity_id, coalesce(b.into_id, target_entity_id) AS target_entity_id, relation_type, chunk_id
  FROM relations LEFT JOIN same_name a ON a.from_id = source_entity_id LEFT JOIN same_name b ON b.from_id = target_entity_id) GROUP BY ALL""")


@query("entity_merge_relations", "SELECT * FROM merged_relations")
def entity_merge_relations(t: Tables):
    rel = t.relations().select("relation_id", "source_entity_id", "target_entity_id", "relation_type", "chunk_id")
    return merge.merge_relations(rel, same_name(t))


@query("entity_merge_entities", "SELECT entity_id, name FROM entities WHERE entity_id NOT IN (SELECT from_id FROM same_name)")
def entity_merge_entities(t: Tables):
    return merge.merge_entities(t.entities().select("entity_id", "name"), same_name(t))


@query("entity_merge_log", """
SELECT from_id AS merged_from_id, into_id AS merged_into_id, CAST(NULL AS BIGINT) AS chunk_id, CAST(NULL AS BIGINT) AS job_id, 'same name and type' AS reason FROM same_name""")
def entity_merge_log(t: Tables):
    return merge.merge_log(same_name(t), F.lit("same name and type"))


cte("chained", """
SELECT from_id, into_id FROM same_name UNION ALL
SELECT into_id, into_id - 3 FROM (SELECT DISTINCT into_id FROM same_name) WHERE into_id >= 3 AND into_id NOT IN (SELECT from_id FROM same_name)""")
cte("chain_walk", """
SELECT from_id, into_id FROM chained UNION ALL SELECT w.from_id, c.into_id FROM chain_walk w JOIN chained c ON c.from_id = w.into_id""")


@query("entity_merge_chains", "SELECT from_id, min(into_id) AS into_id FROM chain_walk GROUP BY from_id")
def entity_merge_chains(t: Tables):
    """Survivors of merges that feed into further merges (ids only decrease, so there is no cycle)."""
    first = same_name(t)
    heads = first.select("into_id").distinct().join(first.select(F.col("from_id").alias("into_id")), "into_id", "left_anti")
    more = heads.filter("into_id >= 3").select(F.col("into_id").alias("from_id"), (F.col("into_id") - 3).alias("into_id"))
    return merge.resolve_chains(first.unionByName(more))


@query("chunk_link_merge", "SELECT DISTINCT chunk_id, coalesce(into_id, entity_id) AS entity_id FROM links LEFT JOIN same_name ON from_id = entity_id")
def chunk_link_merge(t: Tables):
    return merge.merge_links(t.chunk_entities(), same_name(t))


@query("entity_merge_pages", """
SELECT page_id, CASE WHEN row_number() OVER (PARTITION BY target ORDER BY moved, page_id) = 1 THEN target END AS entity_id, slug FROM (
  SELECT page_id, slug, coalesce(into_id, entity_id) AS target, into_id IS NOT NULL AS moved FROM wiki_pages LEFT JOIN same_name ON from_id = entity_id)""")
def entity_merge_pages(t: Tables):
    return merge.merge_pages(t.wiki_pages().select("page_id", "entity_id", "slug"), same_name(t))


@query("entity_merge_page_links", """
SELECT DISTINCT p.page_id, coalesce(m.into_id, c.other) AS entity_id FROM wiki_pages p JOIN (SELECT entity_id AS owner, entity_id AS other FROM entities UNION SELECT node, nbr FROM adj) c
  ON c.owner = p.entity_id LEFT JOIN same_name m ON m.from_id = c.other""")
def entity_merge_page_links(t: Tables):
    from skein.operators.wiki import page_backlinks
    return merge.merge_page_entities(page_backlinks(t.wiki_pages(), t.relations(), t.entities()), same_name(t))


# every document of the largest collection is withdrawn
cte("doomed", """
SELECT doc_id AS source_id FROM documents WHERE source = (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)""")


@query("source_cascade_delete", """
SELECT 'sources' AS tbl, source_id AS id, CAST(NULL AS BIGINT) AS other FROM sources WHERE source_id NOT IN (SELECT source_id FROM doomed)
UNION ALL SELECT 'chunks', chunk_id, source_id FROM chunks WHERE source_id NOT IN (SELECT source_id FROM doomed)
UNION ALL SELECT 'chunk_entities', chunk_id, entity_id FROM links WHERE chunk_id // 1000000 NOT IN (SELECT source_id FROM doomed)
UNION ALL SELECT 'relations', relation_id, chunk_id FROM relations WHERE chunk_id // 1000000 NOT IN (SELECT source_id FROM doomed)
UNION ALL SELECT 'entity_merge_log', from_id, CASE WHEN from_id NOT IN (SELECT source_id FROM doomed) THEN from_id * 1000000 END FROM same_name""")
def source_cascade_delete(t: Tables):
    docs = t.raw("documents").select("doc_id", "source")
    largest = page(docs.groupBy("source").count(), [F.col("count").desc(), F.col("source")], 0, 1)
    doomed = docs.join(largest, "source", "left_semi").select(F.col("doc_id").alias("source_id"))
    log = same_name(t).withColumn("chunk_id", numbered(F.col("from_id"), F.lit(0), CHUNKS_PER_SOURCE))
    left = merge.delete_sources(doomed, t.sources(), t.chunks(), t.chunk_entities(), t.relations(), log)
    null = F.lit(None).cast("bigint")
    parts = {"sources": ("source_id", null), "chunks": ("chunk_id", F.col("source_id")), "chunk_entities": ("chunk_id", F.col("entity_id")),
             "relations": ("relation_id", F.col("chunk_id")), "entity_merge_log": ("from_id", F.col("chunk_id"))}
    rows = [left[k].select(F.lit(k).alias("tbl"), F.col(i).alias("id"), o.alias("other")) for k, (i, o) in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("insert_ignore_links", """
SELECT DISTINCT chunk_id, m.into_id AS entity_id FROM links JOIN same_name m ON m.from_id = entity_id
EXCEPT SELECT chunk_id, entity_id FROM links""")
def insert_ignore_links(t: Tables):
    moved = t.chunk_entities().join(same_name(t), F.col("entity_id") == F.col("from_id")).select("chunk_id", F.col("into_id").alias("entity_id"))
    return merge.insert_ignore(t.chunk_entities(), moved, ["chunk_id", "entity_id"])
