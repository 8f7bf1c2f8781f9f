"""Vector search, context slots and whole retrievals."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.config import DEFAULTS
from skein.functions.text import estimate_tokens
from skein.operators import graph, retrieval as R
from skein.operators.contexts import choose_chunks
from skein.operators.dedup import greedy_dedup
from skein.operators.ranking import budget_prefix
from skein.plans.oracles import _context, cte, tokens
from skein.plans.registry import graph_of, query
from skein.session import stage
from skein.sources.bridge import Tables


def big(*cols: str):
    return [F.col(c).cast("bigint").alias(c) for c in cols]


def casts(*cols: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols)


@query("cosine_topk", """
SELECT query_id, rank, entity_id, round(score, 4) AS score,
  CASE WHEN score < 0.2 THEN 'high' WHEN score <= 0.4 THEN 'low' ELSE 'poor' END AS seed_quality FROM knn""")
def cosine_topk(t: Tables):
    seeds = R.find_seeds(t.questions(), t.entities())
    return seeds.select("query_id", *big("rank"), "entity_id", F.round("score", 4).alias("score"), "seed_quality")


SUMMARY = ["anchor", "subgraph", "wiki_page", "seed_chunks", "hop_chunks", "instruction", "total", "budget",
           "entities_traversed", "entities_after_truncation", "chunks_fetched", "chunks_after_dedup"]


@query("retrieve_single", f"""
SELECT query_id, {casts(*SUMMARY)}, round(total / budget, 4) AS utilization FROM single_summary""")
def retrieve_single(t: Tables):
    out = R.retrieve_single(t.questions(), graph_of(t)).summary
    return out.select("query_id", *big(*SUMMARY), "utilization")


@query("retrieve_chunks", f"""
SELECT query_id, {casts('tier')}, chunk_id, entity_id, {casts('hop')}, round(similarity, 4) AS similarity, {casts('cost')} FROM single_chosen""")
def retrieve_chunks(t: Tables):
    out = R.retrieve_single(t.questions(), graph_of(t)).chunks
    return out.select("query_id", *big("tier"), "chunk_id", "entity_id", *big("hop"),
                      F.round("similarity", 4).alias("similarity"), *big("cost"))


@query("wiki_slot", """
SELECT entity_id, md5(content) AS content_md5, sections_included, sections_dropped, was_truncated FROM wiki_slot""")
def wiki_slot(t: Tables):
    cut = R.wiki_slot(t.wiki_pages().filter("entity_id IS NOT NULL"))
    return cut.select("entity_id", F.md5(F.col("content").cast("binary")).alias("content_md5"), "sections_included", "sections_dropped", "was_truncated")


def _walked(t: Tables):
    seeds = stage(R.find_seeds(t.questions(), t.entities()), "seeds")
    return seeds, stage(graph.traverse(seeds, t.relations()), "nodes")


@query("budget_prefix", f"""
SELECT query_id, relation_id, CAST(spent AS BIGINT) AS spent FROM (
  SELECT query_id, relation_id, sum({tokens('line')}) OVER (PARTITION BY query_id ORDER BY hop, relation_id ROWS UNBOUNDED PRECEDING) AS spent FROM single_edges)
WHERE spent <= 400""")
def budget_prefix_query(t: Tables):
    """Edge lines that fit the subgraph slot, with the running cost."""
    from pyspark.sql import Window
    seeds, nodes = _walked(t)
    lines = R.edge_rows(graph.induced_edges(seeds, nodes, t.relations()), t.entities()).withColumn("cost", estimate_tokens(F.col("line")))
    order = [F.col("hop"), F.col("relation_id")]
    kept = budget_prefix(lines, ["query_id"], order, "cost", F.lit(DEFAULTS.subgraph_budget_tokens), DEFAULTS.subgraph_budget_tokens)
    running = Window.partitionBy("query_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return kept.select("query_id", "relation_id", F.sum("cost").over(running).cast("bigint").alias("spent"))


cte("all_linked", """
SELECT query_id, chunk_id, m[1] AS tier, m[2] AS entity_id, m[3] AS hop FROM (
  SELECT query_id, chunk_id, min([CAST(hop > 0 AS BIGINT), entity_id, hop]) AS m FROM single_ends JOIN links USING (entity_id) GROUP BY ALL)""")


@query("linked_chunks", f"SELECT query_id, chunk_id, {casts('tier')}, entity_id, {casts('hop')} FROM all_linked")
def linked_chunks(t: Tables):
    seeds, nodes = _walked(t)
    return R.linked_chunks(seeds, nodes, t.chunk_entities()).select("query_id", "chunk_id", *big("tier"), "entity_id", *big("hop"))


@query("score_chunks", """
SELECT l.query_id, l.chunk_id, round(list_cosine_similarity(cv.v, qv.v), 4) AS similarity FROM all_linked l JOIN chunks c USING (chunk_id)
JOIN questions q USING (query_id) JOIN vecs cv ON cv.vec_id = c.vec_id JOIN vecs qv ON qv.vec_id = q.vec_id""")
def score_chunks(t: Tables):
    seeds, nodes = _walked(t)
    pairs = R.linked_chunks(seeds, nodes, t.chunk_entities())
    return R.score_chunks(pairs, t.questions(), t.chunks()).select("query_id", "chunk_id", F.round("similarity", 4).alias("similarity"))


@query("dedup_greedy", f"SELECT query_id, chunk_id, {casts('tier')} FROM single_kept")
def dedup_greedy(t: Tables):
    seeds, nodes = _walked(t)
    asked = t.questions().select("query_id", "embedding", F.lit(0).alias("seed_room"), F.lit(0).alias("hop_room"))
    kept, _, rest = choose_chunks(asked, R.node_members(seeds, nodes), t.chunk_entities(), t.chunks(), R.chunk_vectors(t.chunks()), whole=True)
    rest = stage(rest, "rest")
    if not rest.isEmpty():
        pairs = R.distinct_vectors(R.linked_chunks(seeds, nodes, t.chunk_entities()).join(rest, "query_id", "left_semi"), t.chunks())
        scored = stage(R.score_chunks(pairs, t.questions(), t.chunks()), "scored")
        more = greedy_dedup(scored, ["query_id"], ["tier", "neg_sim", "chunk_id"], "chunk_id", R.chunk_vectors(t.chunks()))
        kept = kept.select("query_id", "chunk_id", "tier").unionByName(more.select("query_id", "chunk_id", "tier"))
    return kept.select("query_id", "chunk_id", *big("tier"))


# --- comparison -----------------------------------------------------------------------------------------
cte("cmp_parts", """
SELECT query_id || '/' || rank AS query_id, k.query_id AS parent_id, rank AS part, entity_id, 3600 // count(*) OVER (PARTITION BY k.query_id) AS budget, vec_id
FROM knn k JOIN questions USING (query_id)""")
cte("cmp_seeds", "SELECT query_id, 1 AS rank, entity_id FROM cmp_parts")
cte("cmp_budget", "SELECT query_id, budget, vec_id FROM cmp_parts")
_context("cmp", "cmp_seeds", "cmp_budget")
MERGED = ["anchor", "subgraph", "wiki_page", "seed_chunks", "hop_chunks", "instruction", "total", "entities_traversed",
          "entities_after_truncation", "chunks_fetched"]
cte("cmp_merged", f"""
SELECT parent_id AS query_id, {', '.join(f'sum({c}) AS {c}' for c in MERGED)}, max(s.budget) AS budget,
  (SELECT count(DISTINCT chunk_id) FROM cmp_chosen c JOIN cmp_parts q ON q.query_id = c.query_id WHERE q.parent_id = p.parent_id) AS chunks_after_dedup
FROM cmp_summary s JOIN cmp_parts p ON p.query_id = s.query_id GROUP BY parent_id""")


@query("retrieve_comparison", f"SELECT query_id, {casts(*SUMMARY)}, round(total / budget, 4) AS utilization FROM cmp_merged")
def retrieve_comparison(t: Tables):
    """Every question as a comparison of its three nearest entities."""
    out = R.retrieve_comparison(t.questions(), graph_of(t)).summary
    return out.select("query_id", *big(*SUMMARY), F.round("utilization", 4).alias("utilization"))


@query("merge_results", f"""
SELECT 'edge' AS kind, parent_id AS query_id, relation_id AS id, {casts('hop')} FROM cmp_edges e JOIN cmp_parts p ON p.query_id = e.query_id
QUALIFY row_number() OVER (PARTITION BY parent_id, source_name, relation_type, target_name ORDER BY part, hop, relation_id) = 1
UNION ALL SELECT CASE WHEN tier = 0 THEN 'seed_chunk' ELSE 'hop_chunk' END, parent_id, chunk_id, {casts('hop')} FROM cmp_chosen c JOIN cmp_parts p ON p.query_id = c.query_id
QUALIFY row_number() OVER (PARTITION BY parent_id, tier, chunk_id ORDER BY part) = 1
UNION ALL SELECT DISTINCT 'seed', parent_id, entity_id, CAST(0 AS BIGINT) FROM cmp_parts
UNION ALL SELECT 'wiki', parent_id, entity_id, CAST(0 AS BIGINT) FROM cmp_parts p JOIN wiki_slot w USING (entity_id) QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY part) = 1""")
def merge_results(t: Tables):
    out = R.retrieve_comparison(t.questions(), graph_of(t))

    def rows(kind, df, ident, hop):
        return df.select(kind.alias("kind"), "query_id", F.col(ident).alias("id"), hop.cast("bigint").alias("hop"))

    tier = F.when(F.col("tier") == 0, "seed_chunk").otherwise("hop_chunk")
    return (rows(F.lit("edge"), out.edges, "relation_id", F.col("hop")).unionByName(rows(tier, out.chunks, "chunk_id", F.col("hop")))
            .unionByName(rows(F.lit("seed"), out.seeds, "entity_id", F.lit(0))).unionByName(rows(F.lit("wiki"), out.wiki, "entity_id", F.lit(0))))


@query("retrieve", f"""
SELECT query_id, {casts(*SUMMARY)}, classified_type FROM (
  SELECT s.*, r.type AS classified_type FROM single_summary s JOIN rules r USING (query_id) WHERE r.type <> 'comparison' AND r.confidence >= 0.5
  UNION ALL BY NAME SELECT c.*, r.type AS classified_type FROM cmp_merged c JOIN rules r USING (query_id) WHERE r.type = 'comparison')""")
def retrieve(t: Tables):
    """Plan, gate by confidence, then single pass or comparison."""
    out = R.retrieve(t.questions(), graph_of(t))
    return out.select("query_id", *big(*SUMMARY), "classified_type")


# --- prompt text ----------------------------------------------------------------------------------------
cte("context_lines", f"""
SELECT query_id, CAST(1 AS BIGINT) AS block, k.entity_id AS id, '- ' || name || ' (' || entity_type || '): ' || description || ' [degree=' || degree || ', centrality=' || relative_centrality || ']' AS line
FROM knn k JOIN anchors USING (entity_id)
UNION ALL SELECT query_id, 2, relation_id, '- ' || line FROM single_edges
UNION ALL SELECT query_id, 3, k.entity_id, content FROM knn k JOIN wiki_slot w USING (entity_id) WHERE rank = 1
UNION ALL SELECT query_id, 4 + tier, chunk_id, '- ' || text_content FROM single_chosen JOIN chunks USING (chunk_id)""")


@query("context_text", "SELECT query_id, block, id, md5(line) AS line_md5 FROM context_lines")
def context_text(t: Tables):
    data = graph_of(t)
    blocks = R.context_blocks(R.retrieve_single(t.questions(), data), data)
    return blocks.select("query_id", *big("block"), "id", F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query("answers", """
SELECT query_id, chunk_id, 'doc_' || source_id || '.txt' AS source_file, md5(text_content) AS text_md5 FROM single_chosen JOIN chunks USING (chunk_id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier, round(similarity, 6) DESC, chunk_id) = 1""")
def answers(t: Tables):
    """Extractive stand-in for the answer writer: the best chunk of the context."""
    data = graph_of(t)
    best = R.extractive_answers(R.retrieve_single(t.questions(), data), data)
    return best.select("query_id", "chunk_id", "source_file", F.md5(F.col("answer").cast("binary")).alias("text_md5"))
