"""DuckDB statements that answer the registered queries independently, over the same tables.

Every statement is put together from named common table expressions; ``statement`` pulls in what a
final SELECT needs. The rules are written relationally (window sections, recursive packing, recursive
greedy dedup), not as copies of the Spark plans.
"""

from __future__ import annotations

import re

WS_CHARS = "||".join(f"chr({c})" for c in range(0x3001) if chr(c).isspace())
NL = "chr(10)"
HALF = "chr(10)||chr(10)"


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


def tokens(x: str) -> str:
    return f"greatest(1, length({x}) // 4)"


def slug(name: str, ident: str) -> str:
    words = f"regexp_replace(lower({strip(name)}), '[^a-z0-9]+', '-', 'g')"
    return f"trim({words}, '-') || '-' || CAST({ident} AS VARCHAR)"


def at_second(x: str) -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + to_seconds({x}))"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}, {b})"


CAPS = r"(length(line) BETWEEN 4 AND 99 AND regexp_matches(line, '\p{Lu}') AND NOT regexp_matches(line, '[\p{Ll}\p{Lt}]'))"

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


cte("n_vec", "SELECT count(*) AS n FROM embeddings")
cte("n_doc", "SELECT count(*) AS n FROM documents")
cte("vecs", "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings")

# --- text -> sections -> chunks ---------------------------------------------------------------
cte("lines", f"""
SELECT doc_id, pos, {strip('raw_line')} AS line FROM (
  SELECT doc_id, unnest(parts) AS raw_line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split({strip('text')}, {NL}) AS parts FROM documents))""")
cte("flagged", f"""
SELECT doc_id, pos, line,
  coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 2, false)
  OR {CAPS} OR line LIKE '%:' AS opens
FROM lines WHERE line <> ''""")
cte("sections", f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) AS n, string_agg(line, {NL} ORDER BY pos) AS text
FROM (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM flagged)
GROUP BY doc_id, sec""")
cte("packing", """
SELECT doc_id, n, 1 AS grp, CASE WHEN length(text) > 2048 THEN 0 ELSE length(text) END AS open
FROM sections WHERE n = 1
UNION ALL
SELECT s.doc_id, s.n,
  CASE WHEN length(s.text) <= 2048 AND p.open > 0 AND p.open + length(s.text) + 2 <= 2048 THEN p.grp ELSE p.grp + 1 END,
  CASE WHEN length(s.text) > 2048 THEN 0
       WHEN p.open > 0 AND p.open + length(s.text) + 2 <= 2048 THEN p.open + length(s.text) + 2
       ELSE length(s.text) END
FROM packing p JOIN sections s ON s.doc_id = p.doc_id AND s.n = p.n + 1""")
cte("raw_chunks", f"""
SELECT doc_id, grp, 0 AS part, string_agg(text, {HALF} ORDER BY n) AS text,
  string_split(arg_min(text, n), {NL})[1] AS heading
FROM packing JOIN sections USING (doc_id, n) GROUP BY doc_id, grp HAVING max(length(text)) <= 2048
UNION ALL
SELECT doc_id, grp, i, substr(text, i + 1, 2048), CASE WHEN i = 0 THEN substr(text, 1, least(80, length(text) // 4)) END
FROM (SELECT doc_id, grp, text, unnest(range(0, length(text), 1792)) AS i
      FROM packing JOIN sections USING (doc_id, n) WHERE length(text) > 2048)""")
cte("overlapped", """
SELECT doc_id, idx, CASE WHEN idx = 0 THEN text ELSE right(prev, 256) || text END AS body, heading
FROM (SELECT doc_id, text, heading, row_number() OVER w - 1 AS idx, lag(text) OVER w AS prev
      FROM raw_chunks WINDOW w AS (PARTITION BY doc_id ORDER BY grp, part))""")
cte("chunks", f"""
SELECT doc_id * 1000000 + idx AS chunk_id, doc_id AS source_id, idx AS chunk_index, body AS text_content,
  CASE WHEN idx = 0 THEN coalesce(heading, '') ELSE coalesce(nullif(heading, ''), body) END AS section_heading,
  (doc_id * 7 + idx * 31) % (SELECT n FROM n_vec) AS vec_id, {at_second('doc_id')} AS created_at
FROM overlapped""")

# --- sources, entities, relations ---------------------------------------------------------------
cte("sources", f"""
SELECT doc_id AS source_id, 'sources/' || doc_id AS storage_key, 'doc_' || doc_id || '.txt' AS file_name,
  'text/plain' AS file_type, n_chars AS file_size, CASE WHEN lang = 'es' THEN 'pending' ELSE 'processed' END AS status,
  '{{"lang": "' || lang || '", "source": "' || source || '"}}' AS metadata, {at_second('doc_id')} AS created_at
FROM documents""")
cte("names", rf"""
SELECT doc_id AS entity_id, array_to_string(string_split(w, ' ')[1:2], ' ') AS name,
  CASE lang WHEN 'en' THEN 'person' WHEN 'fr' THEN 'organization' WHEN 'de' THEN 'location' WHEN 'es' THEN 'concept'
  ELSE 'product' END AS entity_type
FROM (SELECT doc_id, lang, regexp_replace({strip('text')}, '[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g') AS w
      FROM documents)""")
cte("entities", f"""
SELECT entity_id, name, entity_type, 'About ' || name AS description, entity_id % (SELECT n FROM n_vec) AS vec_id,
  CASE WHEN entity_type = 'concept' THEN 'pending_review' ELSE 'published' END AS status, {at_second('entity_id')} AS created_at,
  {slug('name', 'entity_id')} AS slug
FROM names""")
cte("relations", f"""
SELECT chunk_id * 10 AS relation_id, source_id AS source_entity_id,
  (source_id * 31 + chunk_index * 17 + 7) % (SELECT n FROM n_doc) AS target_entity_id,
  ['mentions', 'cites', 'extends'][chunk_index % 3 + 1] AS relation_type, chunk_id,
  CASE WHEN chunk_index % 3 = 1 THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence_tag, {at_second('source_id')} AS created_at
FROM chunks
UNION ALL
SELECT chunk_id * 10 + 1, source_id, f.first_id, 'published_with', chunk_id, 'INFERRED', {at_second('source_id')}
FROM chunks JOIN documents d ON d.doc_id = source_id
JOIN (SELECT source, min(doc_id) AS first_id FROM documents GROUP BY source) f ON f.source = d.source
WHERE chunk_index = 0""")
cte("links", """
SELECT chunk_id, source_entity_id AS entity_id FROM relations WHERE relation_type <> 'published_with'
UNION SELECT chunk_id, target_entity_id FROM relations WHERE relation_type <> 'published_with'""")
cte("adj", """
SELECT source_entity_id AS node, target_entity_id AS nbr, relation_id, relation_type, true AS outgoing FROM relations
UNION ALL SELECT target_entity_id, source_entity_id, relation_id, relation_type, false FROM relations""")
cte("degrees", "SELECT node, count(*) AS degree FROM adj GROUP BY node")
cte("anchors", f"""
SELECT e.entity_id, e.name, e.entity_type, e.description, coalesce(d.degree, 0) AS degree,
  CASE WHEN coalesce(d.degree, 0) > 20 THEN 'high' WHEN coalesce(d.degree, 0) >= 5 THEN 'medium' ELSE 'low' END AS relative_centrality,
  coalesce('Connected to ' || s.parts, 'No relations') AS relation_summary
FROM entities e LEFT JOIN degrees d ON d.node = e.entity_id
LEFT JOIN (SELECT node, string_agg(n || ' ' || upper(entity_type[1]) || entity_type[2:], ', ' ORDER BY n DESC, entity_type) AS parts
           FROM (SELECT node, entity_type, count(*) AS n FROM adj JOIN entities ON nbr = entity_id GROUP BY ALL)
           GROUP BY node) s ON s.node = e.entity_id""")

# --- pages, jobs, questions ---------------------------------------------------------------------
cte("own_relations", f"""
SELECT r.source_entity_id AS doc_id, string_agg('- ' || r.relation_type || ': [[' || t.slug || ']]', {NL} ORDER BY relation_id) AS bullets,
  string_agg('- [[' || s.slug || ']] → ' || r.relation_type || ' → [[' || t.slug || ']]', {NL} ORDER BY relation_id) AS arrows
FROM relations r JOIN entities t ON t.entity_id = r.target_entity_id JOIN entities s ON s.entity_id = r.source_entity_id
GROUP BY r.source_entity_id""")
cte("pages_made", f"""
SELECT d.doc_id, e.name, e.slug, 'doc_' || d.doc_id || '.txt' AS file_name, d.text, coalesce(o.bullets, '') AS bullets,
  coalesce(o.arrows, '') AS arrows, {HALF} || '## Contradictions' || {NL} || '*No contradictions detected.*' AS nothing
FROM documents d JOIN entities e ON e.entity_id = d.doc_id LEFT JOIN own_relations o ON o.doc_id = d.doc_id""")
cte("wiki_pages", f"""
SELECT *, CASE WHEN page_id % 7 = 0 THEN 'pending_review' ELSE 'published' END AS status, {at_second('doc_id')} AS synthesized_at FROM (
  SELECT doc_id * 2 AS page_id, doc_id AS entity_id, name AS title, slug, doc_id,
    '# ' || name || {NL} || text || {HALF} || '## Relations' || {NL} || bullets || nothing || {HALF} || '## Sources' || {NL}
    || '- [' || file_name || ':0]' AS content FROM pages_made
  UNION ALL
  SELECT doc_id * 2 + 1, NULL, file_name, {slug('file_name', 'doc_id')}, doc_id,
    '# ' || file_name || {NL} || text || {HALF} || '## Pages created or updated' || {NL} || '- [[' || slug || ']] — ' || name
    || {HALF} || '## Key relations introduced' || {NL} || arrows || nothing FROM pages_made)""")
cte("jobs", """
SELECT event_id AS job_id, kind AS job_type, CASE WHEN kind = 'synthesize_entity' THEN user_id END AS target_entity_id, k AS source_key,
  CASE WHEN value < 5 THEN 'completed' WHEN value < 8 THEN 'processing' ELSE 'pending' END AS status,
  CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR END AS scheduled_at, CAST(event_id % 6 AS INT) AS attempts,
  3 AS max_retries, ts AS created_at
FROM (SELECT *, json_extract_string(props, '$.k') AS k,
        CASE event_type WHEN 'signup' THEN 'ingest_document' WHEN 'purchase' THEN 'synthesize_source_summary'
        ELSE 'synthesize_entity' END AS kind FROM events)""")
cte("questions", """
SELECT conv_id * 1000 + turn AS query_id,
  coalesce(['What is ', 'How does this relate to ', 'Summarize ', 'Compare '][turn % 5 + 1], '') || text AS text,
  (conv_id * 13 + turn * 7) % (SELECT n FROM n_vec) AS vec_id
FROM conversations WHERE role = 'user'""")

# --- retrieval ----------------------------------------------------------------------------------
cte("knn", f"""
SELECT query_id, entity_id, d AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 6), entity_id) AS rank
FROM (SELECT q.query_id, e.entity_id, 1 - {cosine('qv.v', 'ev.v')} AS d
      FROM questions q JOIN vecs qv USING (vec_id), entities e JOIN vecs ev USING (vec_id))
QUALIFY rank <= 3""")
cte("pairs", "SELECT DISTINCT node, nbr FROM adj WHERE node <> nbr")


def _walk(prefix: str, seeds: str) -> None:
    """CTEs of the capped neighbourhood and its edges for the seed relation ``seeds(query_id, rank, entity_id)``."""
    cte(f"{prefix}_hop0", f"SELECT DISTINCT query_id, entity_id FROM {seeds}")
    cte(f"{prefix}_hop1", f"""
SELECT DISTINCT query_id, nbr AS entity_id FROM {prefix}_hop0 JOIN pairs ON node = entity_id
EXCEPT SELECT query_id, entity_id FROM {prefix}_hop0""")
    cte(f"{prefix}_hop2", f"""
SELECT DISTINCT query_id, nbr AS entity_id FROM {prefix}_hop1 JOIN pairs ON node = entity_id
EXCEPT (SELECT * FROM {prefix}_hop0 UNION SELECT * FROM {prefix}_hop1)""")
    cte(f"{prefix}_nodes", f"""
SELECT query_id, entity_id, hop, degree AS entity_degree FROM (
  SELECT *, 1 AS hop FROM {prefix}_hop1 UNION ALL SELECT *, 2 FROM {prefix}_hop2)
JOIN degrees ON node = entity_id
QUALIFY row_number() OVER (PARTITION BY query_id, hop ORDER BY degree DESC, entity_id) <= 10""")
    cte(f"{prefix}_ends", f"""
SELECT query_id, entity_id, 0 AS hop FROM {prefix}_hop0 UNION ALL SELECT query_id, entity_id, hop FROM {prefix}_nodes""")
    cte(f"{prefix}_pairs", f"""
SELECT a.query_id, a.entity_id AS source_id, b.entity_id AS target_id, least(a.hop, b.hop) + 1 AS hop
FROM {prefix}_ends a JOIN {prefix}_ends b ON b.query_id = a.query_id WHERE a.hop > 0 OR b.hop > 0""")
    cte(f"{prefix}_edges", f"""
SELECT p.query_id, r.relation_id, r.source_entity_id, r.target_entity_id, r.relation_type, r.confidence_tag,
  p.hop, s.name AS source_name, s.entity_type AS source_type, t.name AS target_name, t.entity_type AS target_type,
  '[' || s.name || '] --' || r.relation_type || '--> [' || t.name || '] (hop ' || p.hop || ')' AS line
FROM {prefix}_pairs p JOIN relations r ON r.source_entity_id = p.source_id AND r.target_entity_id = p.target_id
JOIN entities s ON s.entity_id = r.source_entity_id JOIN entities t ON t.entity_id = r.target_entity_id""")


def prefix_chars(rows: str, order: str, budget: int) -> str:
    """Characters of the joined lines that fit a token budget, per query."""
    return f"""
SELECT query_id, sum(length(line)) + count(*) - 1 AS chars FROM (
  SELECT query_id, line, sum({tokens('line')}) OVER (PARTITION BY query_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS spent
  FROM {rows}) WHERE spent <= {budget} GROUP BY query_id"""


cte("page_lines", f"""
SELECT page_id, entity_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
FROM (SELECT page_id, entity_id, string_split(content, {NL}) AS parts FROM wiki_pages WHERE entity_id IS NOT NULL)""")
cte("page_sections", f"""
SELECT page_id, entity_id, sec, string_agg(line, {NL} ORDER BY pos) AS text,
  CASE WHEN sec = 0 THEN 'entity_prose' ELSE
  CASE lower(trim(substr(arg_min(line, pos), 4))) WHEN 'relations' THEN 'relationships' WHEN 'contradictions' THEN 'contradictions'
  WHEN 'sources' THEN 'sources' ELSE 'other' END END AS tag
FROM (SELECT *, sum(CAST(line LIKE '## %' AS INT)) OVER (PARTITION BY page_id ORDER BY pos) AS sec FROM page_lines)
GROUP BY page_id, entity_id, sec""")
cte("page_cut", f"""
SELECT *, sum({tokens('text')}) OVER (PARTITION BY page_id ORDER BY prio, sec ROWS UNBOUNDED PRECEDING) <= 1000 AS fits
FROM (SELECT *, list_position(['entity_prose', 'relationships', 'contradictions', 'sources', 'other'], tag) AS prio FROM page_sections)""")
cte("wiki_slot", f"""
SELECT entity_id, coalesce(string_agg(text, {HALF} ORDER BY prio, sec) FILTER (fits), '') AS content,
  coalesce(string_agg(tag, ',' ORDER BY prio, sec) FILTER (text IN_KEPT), '') AS sections_included,
  coalesce(string_agg(tag, ',' ORDER BY prio, sec) FILTER (NOT text IN_KEPT), '') AS sections_dropped,
  NOT bool_and(fits) AS was_truncated
FROM (SELECT c.*, k.kept FROM page_cut c LEFT JOIN (
        SELECT page_id, list(text) FILTER (fits) AS kept FROM page_cut GROUP BY page_id) k USING (page_id))
GROUP BY entity_id""".replace("NOT text IN_KEPT", "NOT coalesce(list_contains(kept, text), false)").replace(
    "text IN_KEPT", "coalesce(list_contains(kept, text), false)"))


def _context(prefix: str, seeds: str, budget: str) -> None:
    """CTEs of the context slots. ``seeds(query_id, rank, entity_id)``, ``budget(query_id, budget, vec_id)``."""
    _walk(prefix, seeds)
    cte(f"{prefix}_anchor", f"""
SELECT s.query_id, s.rank, '- ' || name || ' (' || entity_type || '): ' || description || ' | degree=' || degree
  || ' centrality=' || relative_centrality || ' | ' || relation_summary AS line
FROM {seeds} s JOIN anchors USING (entity_id)""")
    cte(f"{prefix}_slots", f"""
SELECT *, CAST(floor(elastic * 0.6) AS BIGINT) AS seed_budget, elastic - CAST(floor(elastic * 0.6) AS BIGINT) AS hop_budget FROM (
  SELECT *, greatest(0, budget - anchor - subgraph - wiki_page - instruction) AS elastic FROM (
    SELECT b.query_id, b.budget, b.vec_id, greatest(1, coalesce(a.chars, 0) // 4) AS anchor,
      greatest(1, coalesce(g.chars, 0) // 4) AS subgraph,
      CASE WHEN w.content IS NULL THEN 0 ELSE {tokens('w.content')} END AS wiki_page,
      length('Use the provided context — including entity metadata, graph relations, wiki pages, and source chunks — to answer the user''s question accurately.') // 4 AS instruction
    FROM {budget} b
    LEFT JOIN ({prefix_chars(f'{prefix}_anchor', 'rank', 200)}) a USING (query_id)
    LEFT JOIN ({prefix_chars(f'{prefix}_edges', 'hop, relation_id', 400)}) g USING (query_id)
    LEFT JOIN {seeds} s ON s.query_id = b.query_id AND s.rank = 1
    LEFT JOIN wiki_slot w ON w.entity_id = s.entity_id))""")
    cte(f"{prefix}_linked", f"""
SELECT query_id, chunk_id, m[1] AS tier, m[2] AS entity_id, m[3] AS hop FROM (
  SELECT query_id, chunk_id, min([tier, entity_id, hop]) AS m FROM (
    SELECT query_id, entity_id, CAST(hop > 0 AS BIGINT) AS tier, hop FROM {prefix}_ends)
  JOIN links USING (entity_id) JOIN {prefix}_slots USING (query_id) WHERE elastic > 0 GROUP BY ALL)""")
    cte(f"{prefix}_scored", f"""
SELECT l.*, c.vec_id, {tokens('c.text_content')} AS cost, {cosine('cv.v', 'qv.v')} AS similarity
FROM {prefix}_linked l JOIN chunks c USING (chunk_id) JOIN {prefix}_slots b USING (query_id)
JOIN vecs cv ON cv.vec_id = c.vec_id JOIN vecs qv ON qv.vec_id = b.vec_id""")
    cte(f"{prefix}_ordered", f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, round(similarity, 6) DESC, chunk_id) AS n FROM {prefix}_scored""")
    cte(f"{prefix}_greedy", f"""
SELECT query_id, n, [vec_id] AS kept, true AS keep FROM {prefix}_ordered WHERE n = 1
UNION ALL
SELECT o.query_id, o.n,
  CASE WHEN hit THEN kept ELSE list_append(kept, o.vec_id) END, NOT hit
FROM (SELECT o.query_id, o.n, o.vec_id, g.kept,
        EXISTS (SELECT 1 FROM close_pairs c WHERE c.a = o.vec_id AND list_contains(g.kept, c.b)) AS hit
      FROM {prefix}_greedy g JOIN {prefix}_ordered o ON o.query_id = g.query_id AND o.n = g.n + 1) o""")
    cte(f"{prefix}_kept", f"""
SELECT o.* FROM {prefix}_ordered o JOIN {prefix}_greedy g USING (query_id, n) WHERE g.keep""")
    cte(f"{prefix}_chosen", f"""
SELECT query_id, tier, chunk_id, entity_id, hop, similarity, cost FROM (
  SELECT k.*, sum(cost) OVER (PARTITION BY query_id, tier ORDER BY n ROWS UNBOUNDED PRECEDING) AS spent FROM {prefix}_kept k)
JOIN {prefix}_slots USING (query_id) WHERE spent <= CASE WHEN tier = 0 THEN seed_budget ELSE hop_budget END""")
    cte(f"{prefix}_summary", f"""
SELECT query_id, anchor, subgraph, wiki_page, seed_chunks, hop_chunks, instruction,
  anchor + subgraph + wiki_page + seed_chunks + hop_chunks + instruction AS total, budget,
  entities_after_truncation + n_seeds AS entities_traversed, entities_after_truncation, chunks_fetched, chunks_after_dedup
FROM (SELECT s.*, coalesce(c.seed_chunks, 0) AS seed_chunks, coalesce(c.hop_chunks, 0) AS hop_chunks,
        coalesce(n.c, 0) AS entities_after_truncation, coalesce(z.c, 0) AS n_seeds, coalesce(l.c, 0) AS chunks_fetched,
        coalesce(k.c, 0) AS chunks_after_dedup
      FROM {prefix}_slots s
      LEFT JOIN (SELECT query_id, coalesce(sum(cost) FILTER (tier = 0), 0) AS seed_chunks, coalesce(sum(cost) FILTER (tier = 1), 0) AS hop_chunks
                 FROM {prefix}_chosen GROUP BY query_id) c USING (query_id)
      LEFT JOIN (SELECT query_id, count(*) AS c FROM {prefix}_nodes GROUP BY query_id) n USING (query_id)
      LEFT JOIN (SELECT query_id, count(*) AS c FROM {prefix}_hop0 GROUP BY query_id) z USING (query_id)
      LEFT JOIN (SELECT query_id, count(*) AS c FROM {prefix}_linked GROUP BY query_id) l USING (query_id)
      LEFT JOIN (SELECT query_id, count(*) AS c FROM {prefix}_kept GROUP BY query_id) k USING (query_id))""")


cte("close_pairs", f"""
SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a, vecs b WHERE {cosine('a.v', 'b.v')} >= 0.92""")
cte("single_seeds", "SELECT query_id, rank, entity_id FROM knn")
cte("single_budget", "SELECT query_id, 3600 AS budget, vec_id FROM questions")
_context("single", "single_seeds", "single_budget")


_SHARED = re.compile("knn|pairs|single_hop[0-2]|single_nodes|single_ends")  # used several times: to be computed once


def statement(final: str) -> str:
    """The final SELECT preceded by every CTE it needs, in dependency order."""
    order: list[str] = []

    def visit(sql: str, inside: str | None = None) -> None:
        for name in CTES:
            if name != inside and name not in order and re.search(rf"\b{name}\b(?!\s*\()", _tables_only(sql)):
                visit(CTES[name], name)
                if name not in order:
                    order.append(name)

    visit(final)
    if not order:
        return final
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'MATERIALIZED ' * bool(_SHARED.fullmatch(n))}({CTES[n]})" for n in order) + "\n" + final


def _tables_only(sql: str) -> str:
    """What follows FROM, JOIN or a comma in a FROM list: the places where a CTE can be named."""
    return " ".join(re.findall(r"(?:FROM|JOIN|,)\s+([a-z_0-9]+)", sql))
