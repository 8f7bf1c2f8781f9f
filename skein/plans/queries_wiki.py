"""Wiki contexts, pages, upserts and the export bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import export as E, merge, queue as Q, wiki as W
from skein.operators.resolution import synthesis_jobs
from skein.operators.synthesis import synthesize
from skein.plans.oracles import HALF, NL, cosine, cte, iso, slug, tokens
from skein.plans.queries_ingest import _hash_sql
from skein.plans.registry import query
from skein.session import stage, staging_path
from skein.sources.bridge import API_BASE_URL, Tables, at_second
from skein.sources.memo import AnswerMemo, ColumnModel
from skein.sources.runs import RunStore


def big(*cols: str):
    return [F.col(c).cast("bigint").alias(c) for c in cols]


def h(c):
    return F.md5(c.cast("binary"))


# --- entity context -----------------------------------------------------------------------------------
# every entity is due, with every source that links to it
cte("wanted", "SELECT DISTINCT entity_id, chunk_id // 1000000 AS source_id FROM links")
cte("entity_targets", f"SELECT entity_id, {_hash_sql('description')} AS v FROM entities WHERE entity_id IN (SELECT entity_id FROM wanted)")
cte("entity_pairs", f"""
SELECT l.entity_id AS query_id, l.chunk_id, c.vec_id, {cosine('e.v', 'cv.v')} AS similarity,
  '---' || {NL} || '[doc_' || c.source_id || '.txt:' || c.chunk_index || '] (source: doc_' || c.source_id || '.txt, ingested: ' || {iso('c.created_at')} || ')' || {NL} || c.text_content AS entry
FROM links l JOIN chunks c USING (chunk_id) JOIN vecs cv ON cv.vec_id = c.vec_id JOIN entity_targets e USING (entity_id)""")
cte("entity_ordered", "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 6) DESC, chunk_id) AS n FROM entity_pairs")
cte("entity_greedy", """
SELECT query_id, n, [vec_id] AS kept, true AS keep FROM entity_ordered WHERE n = 1
UNION ALL
SELECT query_id, n, CASE WHEN hit THEN kept ELSE list_append(kept, vec_id) END, NOT hit
FROM (SELECT o.query_id, o.n, o.vec_id, g.kept, EXISTS (SELECT 1 FROM close_pairs c WHERE c.a = o.vec_id AND list_contains(g.kept, c.b)) AS hit
      FROM entity_greedy g JOIN entity_ordered o ON o.query_id = g.query_id AND o.n = g.n + 1)""")
cte("entity_chosen", f"""
SELECT query_id AS entity_id, chunk_id, similarity, cost, entry FROM (
  SELECT o.*, {tokens('entry')} AS cost, sum({tokens('entry')}) OVER (PARTITION BY query_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS spent
  FROM entity_ordered o JOIN entity_greedy g USING (query_id, n) WHERE g.keep) WHERE spent <= 4500""")
cte("mentions_found", """
SELECT DISTINCT s.entity_id, k.entity_id AS known_id FROM entity_chosen s JOIN wanted w ON w.entity_id = s.entity_id
JOIN wanted m ON m.source_id = w.source_id JOIN entities k ON k.entity_id = m.entity_id
WHERE contains(lower(s.entry), lower(k.name))""")
cte("known_order", """
SELECT entity_id, known_id, min([tier, at_id]) AS o FROM (
  SELECT node AS entity_id, nbr AS known_id, CAST(NOT outgoing AS BIGINT) AS tier, relation_id AS at_id FROM adj WHERE node IN (SELECT entity_id FROM wanted)
  UNION ALL SELECT entity_id, known_id, 2, known_id FROM mentions_found) GROUP BY ALL""")
cte("known_cut", f"""
SELECT entity_id, known_id, slug, name FROM (
  SELECT *, sum(cost) OVER (PARTITION BY entity_id ORDER BY o, known_id ROWS UNBOUNDED PRECEDING) AS spent FROM (
    SELECT k.entity_id, k.known_id, k.o, e.slug, e.name, {tokens("'- [[' || e.slug || ']] — ' || e.name")} AS cost
    FROM known_order k JOIN entities e ON e.entity_id = k.known_id))
JOIN (SELECT t.entity_id, 4500 - coalesce(sum(cost), 0) AS room FROM entity_targets t LEFT JOIN entity_chosen USING (entity_id) GROUP BY t.entity_id) USING (entity_id)
WHERE spent <= room""")


def wanted(t: Tables):
    return t.chunk_entities().join(t.chunks().select("chunk_id", "source_id"), "chunk_id").select("entity_id", "source_id").distinct()


def context(t: Tables) -> W.EntityContext:
    return W.entity_context(stage(wanted(t), "wanted"), t.entities(), t.relations(), t.chunks(), t.chunk_entities(), t.sources(), t.wiki_pages())


@query("entity_context_chunks", "SELECT entity_id, chunk_id, CAST(cost AS BIGINT) AS cost FROM entity_chosen")
def entity_context_chunks(t: Tables):
    return context(t).chunks.select("entity_id", "chunk_id", *big("cost"))


@query("entity_context_known", "SELECT entity_id, known_id, slug, name FROM known_cut")
def entity_context_known(t: Tables):
    return context(t).known.select("entity_id", "known_id", "slug", "name")


@query("mention_scan", "SELECT entity_id, known_id FROM mentions_found")
def mention_scan(t: Tables):
    due = stage(wanted(t), "wanted")
    ctx = W.entity_context(due, t.entities(), t.relations(), t.chunks(), t.chunk_entities(), t.sources(), t.wiki_pages())
    return W.mentioned(due, ctx.chunks, t.entities(), t.chunks(), t.chunk_entities(), t.sources())


cte("entity_pages_made", f"""
SELECT e.entity_id, e.name AS title, e.slug, coalesce('# ' || e.name || {NL} || p.prose || {HALF} || '## Relations' || {NL} || coalesce(b.bullets, '')
  || {HALF} || '## Contradictions' || {NL} || '*No contradictions detected.*' || {HALF} || '## Sources' || {NL} || p.refs,
  '# ' || e.name || {HALF} || '*Synthesis produced no content.*') AS content
FROM entities e JOIN entity_targets USING (entity_id)
LEFT JOIN (SELECT s.entity_id, string_agg(summary || ' ' || cite, {NL} ORDER BY round(similarity, 6) DESC, chunk_id) AS prose,
             string_agg('- ' || cite || ' ' || file_name, {NL} ORDER BY chunk_id) AS refs
           FROM entity_chosen s JOIN chunk_lines USING (chunk_id) GROUP BY s.entity_id) p USING (entity_id)
LEFT JOIN (SELECT entity_id, string_agg('- ' || label || ': [[' || slug || ']]', {NL} ORDER BY label, slug) AS bullets FROM (
             SELECT DISTINCT a.node AS entity_id, CASE WHEN outgoing THEN relation_type ELSE '← ' || relation_type END AS label, k.slug
             FROM adj a JOIN known_cut k ON k.entity_id = a.node AND k.known_id = a.nbr) GROUP BY entity_id) b USING (entity_id)""")
cte("chunk_lines", f"""
SELECT chunk_id, source_id, chunk_index, CASE WHEN length(l) > 80 THEN left(l, 77) || '...' ELSE l END AS summary, 'doc_' || source_id || '.txt' AS file_name,
  '[doc_' || source_id || '.txt:' || chunk_index || ']' AS cite FROM (SELECT chunk_id, source_id, chunk_index, string_split(text_content, {NL})[1] AS l FROM chunks)""")


@query("synthesize_pages", "SELECT entity_id, title, slug, md5(content) AS content_md5, length(content) AS n_chars FROM entity_pages_made")
def synthesize_pages(t: Tables):
    pages = W.render_entity_pages(context(t), t.entities(), t.chunks())
    return pages.select("entity_id", "title", "slug", h(F.col("content")).alias("content_md5"), F.length("content").cast("bigint").alias("n_chars"))


# --- source context -----------------------------------------------------------------------------------
@query("source_summary_context", f"""
SELECT s.source_id, file_name, {iso('created_at')} AS ingested_at, (SELECT count(*) FROM chunks c WHERE c.source_id = s.source_id) AS chunk_count,
  CAST(0 AS BIGINT) AS reingest_count, CAST(NULL AS VARCHAR) AS previous_ingested_at FROM sources s""")
def source_summary_context(t: Tables):
    return W.source_context(t.sources(), t.entities(), t.relations(), t.chunks(), t.chunk_entities()).head


@query("touched_entities", """
SELECT DISTINCT chunk_id // 1000000 AS source_id, e.entity_id, e.slug, e.name FROM links JOIN entities e USING (entity_id)""")
def touched_entities(t: Tables):
    return W.source_context(t.sources(), t.entities(), t.relations(), t.chunks(), t.chunk_entities()).touched.select("source_id", "entity_id", "slug", "name")


@query("source_relations", """
SELECT chunk_id // 1000000 AS source_id, relation_id, a.slug AS source_slug, relation_type AS label, b.slug AS target_slug
FROM relations JOIN entities a ON a.entity_id = source_entity_id JOIN entities b ON b.entity_id = target_entity_id""")
def source_relations(t: Tables):
    return W.source_context(t.sources(), t.entities(), t.relations(), t.chunks(), t.chunk_entities()).relations


@query("chunk_summaries", "SELECT source_id, chunk_id, CAST(chunk_index AS BIGINT) AS chunk_index, summary FROM chunk_lines")
def chunk_summaries(t: Tables):
    rows = W.source_context(t.sources(), t.entities(), t.relations(), t.chunks(), t.chunk_entities()).chunks
    return rows.select("source_id", "chunk_id", *big("chunk_index"), "summary")


cte("source_pages_made", f"""
SELECT s.source_id, s.file_name AS title, {slug('s.file_name', 's.source_id')} AS slug,
  '# ' || s.file_name || {NL} || coalesce(f.summary || ' [' || s.file_name || ':0]', '') || {HALF} || '## Pages created or updated' || {NL} || coalesce(t.lines, '')
  || {HALF} || '## Key relations introduced' || {NL} || coalesce(r.lines, '') || {HALF} || '## Contradictions' || {NL} || '*No contradictions detected.*'
  || {HALF} || '## Ingest history' || {NL} || '- Ingested: ' || {iso('s.created_at')} || {HALF} || '## Chunks' || {NL} || coalesce(c.lines, '') AS content
FROM sources s LEFT JOIN chunk_lines f ON f.source_id = s.source_id AND f.chunk_index = 0
LEFT JOIN (SELECT source_id, string_agg('- [[' || slug || ']] — ' || name, {NL} ORDER BY entity_id) AS lines FROM (
  SELECT DISTINCT chunk_id // 1000000 AS source_id, e.entity_id, e.slug, e.name FROM links JOIN entities e USING (entity_id)) GROUP BY source_id) t ON t.source_id = s.source_id
LEFT JOIN (SELECT chunk_id // 1000000 AS source_id, string_agg('- [[' || a.slug || ']] → ' || relation_type || ' → [[' || b.slug || ']]', {NL} ORDER BY relation_id) AS lines
  FROM relations JOIN entities a ON a.entity_id = source_entity_id JOIN entities b ON b.entity_id = target_entity_id GROUP BY ALL) r ON r.source_id = s.source_id
LEFT JOIN (SELECT source_id, string_agg('- ' || cite || ' — ' || summary, {NL} ORDER BY chunk_index) AS lines FROM chunk_lines GROUP BY source_id) c ON c.source_id = s.source_id""")


@query("synthesize_sources", "SELECT source_id, title, slug, md5(content) AS content_md5 FROM source_pages_made")
def synthesize_sources(t: Tables):
    pages = W.render_source_pages(W.source_context(t.sources(), t.entities(), t.relations(), t.chunks(), t.chunk_entities()))
    return pages.select("source_id", "title", "slug", h(F.col("content")).alias("content_md5"))


# --- upserts ------------------------------------------------------------------------------------------
@query("upsert_source_pages", f"""
SELECT coalesce(w.page_id, -1 - m.source_id) AS page_id, coalesce(w.slug, m.slug) AS slug, coalesce(w.title, m.title) AS title, md5(coalesce(m.content, w.content)) AS content_md5
FROM (SELECT * FROM wiki_pages WHERE status = 'published') w FULL JOIN source_pages_made m ON m.slug = w.slug""")
def upsert_source_pages(t: Tables):
    """New summaries over the published pages: known slugs keep page id and title, others are added."""
    made = W.render_source_pages(W.source_context(t.sources(), t.entities(), t.relations(), t.chunks(), t.chunk_entities())).select(
        (F.lit(-1) - F.col("source_id")).alias("page_id"), "slug", "title", "content")
    old = E.published(t.wiki_pages()).select("page_id", "slug", "title", "content")
    return merge.upsert(old, made, "slug", ["content"]).select("page_id", "slug", "title", h(F.col("content")).alias("content_md5"))


@query("upsert_entity_pages", f"""
SELECT coalesce(w.page_id, -1 - m.entity_id) AS page_id, coalesce(w.entity_id, m.entity_id) AS entity_id, coalesce(w.slug, m.slug) AS slug, md5(coalesce(m.content, w.content)) AS content_md5
FROM (SELECT * FROM wiki_pages WHERE status = 'published') w FULL JOIN entity_pages_made m ON m.entity_id = w.entity_id""")
def upsert_entity_pages(t: Tables):
    made = W.render_entity_pages(context(t), t.entities(), t.chunks()).select(
        (F.lit(-1) - F.col("entity_id")).alias("page_id"), "entity_id", "slug", "content")
    old = E.published(t.wiki_pages()).select("page_id", "entity_id", "slug", "content")
    return merge.upsert(old, made, "entity_id", ["content"]).select("page_id", "entity_id", "slug", h(F.col("content")).alias("content_md5"))


@query("synthesis_end_to_end", f"""
SELECT u.*, coalesce(b.n, 0) AS n_backlinks, coalesce(j.n, 0) AS n_jobs FROM (
  SELECT coalesce(w.page_id, -1 - m.entity_id) AS page_id, coalesce(w.entity_id, m.entity_id) AS entity_id, coalesce(w.slug, m.slug) AS slug, md5(coalesce(m.content, w.content)) AS content_md5
  FROM wiki_pages w FULL JOIN entity_pages_made m ON m.entity_id = w.entity_id) u
LEFT JOIN (SELECT owner, count(*) AS n FROM (SELECT entity_id AS owner, entity_id AS other FROM entities UNION SELECT node, nbr FROM adj)
  WHERE owner IN (SELECT entity_id FROM entity_pages_made) GROUP BY owner) b ON b.owner = u.entity_id
LEFT JOIN (SELECT entity_id, count(*) AS n FROM wanted GROUP BY entity_id) j ON j.entity_id = u.entity_id""")
def synthesis_end_to_end(t: Tables):
    """The jobs an ingest of all documents leaves, worked off; every page after it, with its backlinks and completed jobs."""
    jobs = synthesis_jobs(t.chunks(), t.chunk_entities()).select(
        *Q.enqueue(F.xxhash64("job_type", "source_id", "target_entity_id"), F.col("job_type"), F.col("payload"), F.col("target_entity_id"),
                   at_second(F.col("source_id"))))
    memo = AnswerMemo(RunStore(t.spark, staging_path(t.spark, "memo-pages")))
    done = synthesize(
        stage(jobs, "synthesis-jobs"), t.entities(), t.relations(), t.chunks(), t.chunk_entities(), t.sources(), t.wiki_pages(),
        lambda entity: F.lit(-1) - entity, F.expr("TIMESTAMP_NTZ'2024-06-01 00:00:00'"), memo.ask(ColumnModel("as-drawn", lambda text: text)))
    n = F.count(F.lit(1))
    links = done.backlinks.groupBy("page_id").agg(n.alias("n_backlinks"))
    closed = done.jobs.filter("status = 'completed'").groupBy(F.col("target_entity_id").alias("entity_id")).agg(n.alias("n_jobs"))
    return done.pages.select("page_id", "entity_id", "slug", h(F.col("content")).alias("content_md5")).join(
        links, "page_id", "left").join(closed, "entity_id", "left").na.fill(0, ["n_backlinks", "n_jobs"])


@query("page_backlinks", """
SELECT p.page_id, c.other AS entity_id FROM wiki_pages p JOIN (SELECT entity_id AS owner, entity_id AS other FROM entities UNION SELECT node, nbr FROM adj) c ON c.owner = p.entity_id""")
def page_backlinks(t: Tables):
    return W.page_backlinks(t.wiki_pages(), t.relations(), t.entities())


# --- export -------------------------------------------------------------------------------------------
cte("slug_names", """
SELECT p.slug, coalesce(e.name, s.file_name, p.slug) AS display FROM wiki_pages p LEFT JOIN entities e USING (entity_id) LEFT JOIN sources s ON s.source_id = p.doc_id
WHERE p.status = 'published'""")


@query("slug_name_map", "SELECT slug, display FROM slug_names")
def slug_name_map(t: Tables):
    return E.slug_names(t.wiki_pages(), t.entities(), t.sources())


# the page is cut at "[[": each further piece starts with a slug up to its "]]"
cte("link_parts", """
SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i
FROM (SELECT page_id, string_split(content, '[[') AS parts FROM wiki_pages WHERE status = 'published')""")
cte("linked_bodies", """
SELECT page_id, string_agg(CASE WHEN i = 1 THEN part ELSE '[' || coalesce(n.display, s) || '](../entities/' || s || '.md)' || substr(part, strpos(part, ']]') + 2) END, '' ORDER BY i) AS body
FROM (SELECT *, CASE WHEN i > 1 THEN left(part, strpos(part, ']]') - 1) END AS s FROM link_parts) LEFT JOIN slug_names n ON n.slug = s GROUP BY page_id""")


@query("rewrite_links", "SELECT page_id, md5(body) AS body_md5, length(body) AS n_chars FROM linked_bodies")
def rewrite_links(t: Tables):
    pages = E.published(t.wiki_pages())
    return E.rewrite_links(pages, E.slug_names(t.wiki_pages(), t.entities(), t.sources())).select(
        "page_id", h(F.col("body")).alias("body_md5"), F.length("body").cast("bigint").alias("n_chars"))


def _yaml_sql(key: str, v: str) -> str:
    special = """regexp_matches(%s, '[:#{}\\[\\],>|"''%%@`]')""" % v
    return f"""'{key}: ' || CASE WHEN contains({v}, {NL}) THEN '|' || {NL} || '  ' || replace(rtrim({v}, {NL}), {NL}, {NL} || '  ')
  WHEN {special} THEN '"' || replace(replace({v}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' ELSE {v} END"""


cte("exported", f"""
SELECT *, CASE WHEN entity_id IS NULL THEN excerpt ELSE about END AS description, CASE WHEN entity_id IS NULL THEN 'sources/' ELSE 'entities/' END || slug || '.md' AS path FROM (
  SELECT p.*, e.entity_type, e.description AS about, b.body,
    CASE WHEN length(para) <= 200 THEN para ELSE CASE WHEN strpos(reverse(left(para, 200)), ' ') BETWEEN 1 AND 199
      THEN left(para, 200 - strpos(reverse(left(para, 200)), ' ')) ELSE left(para, 200) END || '...' END AS excerpt
  FROM (SELECT *, trim(string_split(content, {HALF})[1], ' ' || {NL}) AS para FROM wiki_pages WHERE status = 'published') p
  JOIN linked_bodies b USING (page_id) LEFT JOIN entities e USING (entity_id))""")
cte("fronts", f"""
SELECT page_id, path, title, concat_ws({NL}, '---', {_yaml_sql('type', "CASE WHEN entity_id IS NULL THEN 'source-summary' ELSE entity_type END")}, {_yaml_sql('title', 'title')},
  CASE WHEN description <> '' THEN {_yaml_sql('description', 'description')} END, {_yaml_sql('timestamp', iso('synthesized_at'))},
  'page_kind: ' || CASE WHEN entity_id IS NULL THEN 'source_summary' ELSE 'entity' END,
  'resource: "{API_BASE_URL}/' || CASE WHEN entity_id IS NULL THEN 'sources/' || doc_id ELSE 'entities/' || entity_id END || '"', '---') AS head, body FROM exported""")
cte("bundle", f"SELECT page_id, path, title, head || {HALF} || body || {NL} AS rendered, sha256(head || {HALF} || body || {NL}) AS content_hash FROM fronts")


@query("front_matter", "SELECT page_id, path, md5(head) AS head_md5 FROM fronts")
def front_matter(t: Tables):
    base = E.described(t.wiki_pages(), t.entities())
    return base.select("page_id", "path", h(E.front_matter(base, API_BASE_URL)).alias("head_md5"))


def rendered(t: Tables):
    return E.render(t.wiki_pages(), t.entities(), t.sources(), API_BASE_URL)


@query("export_render_hash", "SELECT page_id, path, title, content_hash FROM bundle")
def export_render_hash(t: Tables):
    return rendered(t).select("page_id", "path", "title", "content_hash")


# the previous export: some pages did not exist, some had other content, some are gone since
cte("previous", """
SELECT path, CASE WHEN contains(rendered, 'extends') THEN md5(content_hash) ELSE content_hash END AS content_hash FROM bundle WHERE length(rendered) <= 2500
UNION ALL SELECT 'entities/gone-' || doc_id || '.md', sha256(text) FROM documents WHERE lang = 'de'""")
cte("diffed", """
SELECT path, CASE WHEN o.content_hash IS NULL THEN 'added' WHEN n.content_hash IS NULL THEN 'removed' WHEN o.content_hash <> n.content_hash THEN 'modified' ELSE 'unchanged' END AS action,
  n.content_hash FROM previous o FULL JOIN (SELECT path, content_hash FROM bundle) n USING (path)""")


def _diff(t: Tables):
    """Against an earlier export that lacked the long pages, had other text where pages now say "extends", and had more files."""
    new = stage(rendered(t).select("path", "title", "content_hash", F.contains("rendered", F.lit("extends")).alias("other"),
                                   F.length("rendered").alias("n")), "bundle")
    changed = F.when(F.col("other"), h(F.col("content_hash"))).otherwise(F.col("content_hash"))
    old = new.filter("n <= 2500").select("path", changed.alias("content_hash"))
    gone = t.raw("documents").filter("lang = 'de'").select(
        F.concat(F.lit("entities/gone-"), F.col("doc_id"), F.lit(".md")).alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return E.manifest_diff(old.unionByName(gone), new), new


@query("export_manifest_diff", "SELECT path, action, content_hash FROM diffed")
def export_manifest_diff(t: Tables):
    return _diff(t)[0]


@query("export_counts", "SELECT action, count(*) AS n FROM diffed GROUP BY action")
def export_counts(t: Tables):
    return _diff(t)[0].groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("export_log", """
SELECT path, action, '- **' || action || '** `' || path || '` — ' || CASE WHEN action = 'removed' THEN regexp_extract(path, '([^/]+)\\.md$', 1) ELSE b.title END AS entry
FROM diffed LEFT JOIN bundle b USING (path) WHERE action <> 'unchanged'""")
def export_log(t: Tables):
    diff, new = _diff(t)
    return E.log_entries(diff, new)


@query("export_index", """
SELECT f AS index_file, CASE WHEN entity_id IS NULL THEN 2 ELSE 1 END AS section, slug, '- [' || title || '](' || CASE WHEN f = 'index.md' THEN path ELSE slug || '.md' END || ')'
  || CASE WHEN description <> '' THEN ' — ' || description ELSE '' END AS line
FROM (SELECT *, unnest(['index.md', CASE WHEN entity_id IS NULL THEN 'sources/index.md' ELSE 'entities/index.md' END]) AS f FROM exported)""")
def export_index(t: Tables):
    return E.index_lines(t.wiki_pages(), t.entities())
