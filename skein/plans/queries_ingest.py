"""Extraction, resolution and what follows an ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.functions.text import lock_key
from skein.operators import resolution as X
from skein.operators.ingest import Models, ingest
from skein.plans.oracles import cte
from skein.plans.registry import query
from skein.providers import HashEmbedder
from skein.session import spread, stage, staging_path
from skein.sources import html
from skein.sources.bridge import CHUNKS_PER_SOURCE, Tables, numbered
from skein.sources.memo import AnswerMemo, ColumnModel
from skein.sources.runs import RunStore
from skein.sources.uploads import validate_uploads


def big(*cols: str):
    return [F.col(c).cast("bigint").alias(c) for c in cols]


# --- extraction --------------------------------------------------------------------------------------
cte("words", r"""
SELECT chunk_id, name, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) - 1 AS idx FROM (
  SELECT chunk_id, name, min(pos) AS pos FROM (
    SELECT chunk_id, unnest(w) AS name, generate_subscripts(w, 1) AS pos FROM (
      SELECT chunk_id, regexp_extract_all(text_content, '\p{Lu}\p{Ll}+') AS w FROM chunks)) GROUP BY chunk_id, name)""")


@query("extract_candidates", "SELECT chunk_id, idx, name AS canonical_name, 'concept' AS entity_type, 'Named ' || name AS description FROM words")
def extract_candidates(t: Tables):
    return X.candidates(X.extract(t.chunks())).select("chunk_id", *big("idx"), "canonical_name", "entity_type", "description")


@query("extract_relations", """
SELECT chunk_id, idx - 1 AS source_idx, idx AS target_idx, 'next_to' AS relation_type FROM words WHERE idx > 0""")
def extract_relations(t: Tables):
    return X.named_relations(X.extract(t.chunks())).select("chunk_id", *big("source_idx", "target_idx"), "relation_type")


@query("extract_errors", """
SELECT event_id AS chunk_id, ['empty text', 'no tool call', 'invalid JSON', 'answer does not match the schema', NULL][event_id % 5 + 1] AS error FROM events""")
def extract_errors(t: Tables):
    """Every way an answer can fail, over answers derived from the events table."""
    n = F.col("event_id") % 5
    good = F.concat(F.lit('{"entities": [{"surface_form": "a", "canonical_name": "a", "entity_type": "'), F.col("event_type"),
                    F.lit('", "description": "d"}], "relations": []}'))
    answer = F.when(n == 2, F.lit('{"entities": [')).when(n == 3, F.concat(F.lit('{"entities": ['), F.col("props"), F.lit('], "relations": []}'))).when(n != 1, good)
    read = t.raw("events").select(F.col("event_id").alias("chunk_id"), F.when(n == 0, "").otherwise(F.col("event_type")).alias("text_content"), answer.alias("answer"))
    return X.parse_answers(read).select("chunk_id", "error")


@query("merge_decision_valid", """
SELECT event_id, coalesce((kind = 'merge' AND target IS NOT NULL) OR (kind = 'new' AND target IS NULL), false) AS valid FROM (
  SELECT event_id, ['merge', 'new', 'maybe'][event_id % 3 + 1] AS kind, CASE WHEN event_id % 2 = 0 THEN user_id END AS target FROM events)""")
def merge_decision_valid(t: Tables):
    kind = F.get(F.array(F.lit("merge"), F.lit("new"), F.lit("maybe")), (F.col("event_id") % 3).cast("int"))
    return t.raw("events").select("event_id", X.valid_decision(kind, F.when(F.col("event_id") % 2 == 0, F.col("user_id"))).alias("valid"))


# --- resolution: documents against the graph an earlier ingest of the benchmark passages left -----------
def _hash_sql(text: str) -> str:
    return f"""list_transform(range(0, 64), lambda i: CAST(CAST(CAST('0x' || substr(sha256({text}), (i % 32) * 2 + 1, 2) AS INT) / 127.5 - 1.0 AS FLOAT) AS DOUBLE))"""


cte("earlier", rf"""
SELECT CAST(CAST('0x' || substr(md5('earlier|' || name), 1, 16) AS UBIGINT) % 9223372036854775807 AS BIGINT) AS entity_id, name, 'concept' AS entity_type FROM (
  SELECT DISTINCT unnest(regexp_extract_all(text, '\p{{Lu}}\p{{Ll}}+')) AS name FROM benchmark)""")
cte("mention_groups", """
SELECT lower(name) AS name_key, min(name) AS name, min(chunk_id) AS chunk_id, count(*) AS uses FROM words GROUP BY lower(name)""")
cte("mention_vecs", f"""SELECT name_key, name, {_hash_sql("name || ' Named ' || name")} AS v FROM mention_groups""")
cte("earlier_vecs", f"""SELECT entity_id, name, {_hash_sql("name || ' Named ' || name")} AS v FROM earlier""")
cte("merged_mentions", """
SELECT m.name_key, min(e.entity_id) AS into_id FROM mention_vecs m JOIN earlier_vecs e ON lower(e.name) = m.name_key
WHERE list_distance(m.v, e.v) <= 0.6 GROUP BY m.name_key""")
cte("resolved_mentions", f"""
SELECT g.name_key, g.chunk_id, coalesce(m.into_id, CAST(CAST('0x' || substr(md5(g.name_key || '|concept'), 1, 16) AS UBIGINT) % 9223372036854775807 AS BIGINT)) AS entity_id,
  CASE WHEN m.into_id IS NULL THEN 'new' ELSE 'merge' END AS decision
FROM mention_groups g LEFT JOIN merged_mentions m USING (name_key)""")


def _earlier(t: Tables):
    words = t.raw("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}+"), F.lit(0))).alias("name")).distinct()
    return words.select(lock_key(F.concat(F.lit("earlier|"), "name")).alias("entity_id"), "name",
                        F.lit("concept").alias("entity_type"),
                        V.hash_embedding(F.concat("name", F.lit(" Named "), "name"), 64).alias("embedding"))


def _resolution(t: Tables) -> X.Resolution:
    read = stage(X.extract(t.chunks()), "extracted")
    return X.resolve(X.candidates(read), X.named_relations(read), _earlier(t))


@query("resolve_mentions", "SELECT name_key, 'concept' AS entity_type, entity_id, decision FROM resolved_mentions")
def resolve_mentions(t: Tables):
    return _resolution(t).mentions


@query("resolve_links", """
SELECT DISTINCT w.chunk_id, r.entity_id FROM words w JOIN resolved_mentions r ON r.name_key = lower(w.name)""")
def resolve_links(t: Tables):
    return _resolution(t).links


@query("resolve_relations", """
SELECT a.chunk_id, a.idx AS n, ra.entity_id AS source_entity_id, rb.entity_id AS target_entity_id, 'next_to' AS relation_type, 'INFERRED' AS confidence_tag
FROM words a JOIN words b ON b.chunk_id = a.chunk_id AND b.idx = a.idx + 1
JOIN resolved_mentions ra ON ra.name_key = lower(a.name) JOIN resolved_mentions rb ON rb.name_key = lower(b.name)""")
def resolve_relations(t: Tables):
    return _resolution(t).relations.select("chunk_id", *big("n"), "source_entity_id", "target_entity_id", "relation_type", "confidence_tag")


# --- after the chunks ----------------------------------------------------------------------------------
cte("bad_chunks", r"SELECT chunk_id FROM chunks WHERE NOT regexp_matches(text_content, '\p{Lu}\p{Ll}')")


def _failing(t: Tables):
    """Chunks without a single capitalised word count as failed here, to exercise isolation."""
    bad = t.chunks().filter(~F.regexp_like("text_content", F.lit(r"\p{Lu}\p{Ll}"))).select("chunk_id")
    return X.chunk_status(t.chunks().select("chunk_id", "source_id"), bad)


@query("chunk_status", "SELECT chunk_id, source_id, CASE WHEN chunk_id IN (SELECT chunk_id FROM bad_chunks) THEN 'failed' ELSE 'processed' END AS status FROM chunks")
def chunk_status(t: Tables):
    return _failing(t).select("chunk_id", "source_id", "status")


@query("source_status", """
SELECT source_id, count(*) FILTER (NOT bad) AS succeeded, count(*) FILTER (bad) AS failed, CASE WHEN bool_and(bad) THEN 'failed' ELSE 'processed' END AS status
FROM (SELECT source_id, chunk_id IN (SELECT chunk_id FROM bad_chunks) AS bad FROM chunks) GROUP BY source_id""")
def source_status(t: Tables):
    return X.source_status(_failing(t))


@query("synthesis_fan_out", """
SELECT DISTINCT chunk_id // 1000000 AS source_id, 'synthesize_entity' AS job_type, entity_id AS target_entity_id, '{"source_ids": ["' || chunk_id // 1000000 || '"]}' AS payload FROM links
UNION ALL SELECT DISTINCT source_id, 'synthesize_source_summary', CAST(NULL AS BIGINT), '{"source_id": "' || source_id || '"}' FROM chunks""")
def synthesis_fan_out(t: Tables):
    return X.synthesis_jobs(t.chunks(), t.chunk_entities())


# --- all of it ----------------------------------------------------------------------------------------
@query("ingest_end_to_end", """
SELECT s.source_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_vectors, 0) AS n_vectors, coalesce(n_entities, 0) AS n_entities,
  coalesce(n_new, 0) AS n_new, coalesce(n_relations, 0) AS n_relations, coalesce(n_entities, 0) + CASE WHEN n_chunks > 0 THEN 1 ELSE 0 END AS n_jobs,
  CASE WHEN n_chunks > 0 THEN 'processed' ELSE 'failed' END AS status
FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n_chunks, count(DISTINCT text_content) AS n_vectors FROM chunks GROUP BY source_id) c ON c.source_id = s.source_id
LEFT JOIN (SELECT w.chunk_id // 1000000 AS source_id, count(DISTINCT r.entity_id) AS n_entities, count(DISTINCT r.entity_id) FILTER (r.decision = 'new') AS n_new,
    count(*) FILTER (w.idx > 0) AS n_relations FROM words w JOIN resolved_mentions r ON r.name_key = lower(w.name) GROUP BY ALL) e ON e.source_id = s.source_id""")
def ingest_end_to_end(t: Tables):
    """Every document ingested into the earlier graph, models asked through memos; one row per source says what it left."""
    def memo(name: str, kind: str) -> AnswerMemo:
        return AnswerMemo(RunStore(t.spark, staging_path(t.spark, f"memo-{name}")), kind)

    models = Models(embed=memo("vectors", "array<float>").ask(ColumnModel("hash", HashEmbedder().embed)),
                    read=memo("answers", "string").ask(ColumnModel("offline", X.offline_reader)))
    docs = spread(t.raw("documents").select(F.col("doc_id").alias("source_id"), "text"))
    done = ingest(docs, _earlier(t), models, lambda source, n: numbered(source, n, CHUNKS_PER_SOURCE))
    where = done.chunks.select("chunk_id", "source_id")
    n = F.count(F.lit(1))
    told = done.links.join(where, "chunk_id").select("source_id", "entity_id").distinct().join(
        done.entities.select("entity_id", F.lit(1).alias("_new")), "entity_id", "left")
    counts = [
        done.chunks.groupBy("source_id").agg(n.alias("n_chunks"), F.countDistinct("embedding").alias("n_vectors")),
        told.groupBy("source_id").agg(n.alias("n_entities"), F.count("_new").alias("n_new")),
        done.relations.join(where, "chunk_id").groupBy("source_id").agg(n.alias("n_relations")),
        done.jobs.groupBy("source_id").agg(n.alias("n_jobs")),
    ]
    out = done.sources.select("source_id", "status")
    for part in counts:
        out = out.join(part, "source_id", "left")
    return out.na.fill(0)


@query("candidate_block", """
SELECT query_id, rank || '. ID=' || k.entity_id || ' name=''' || name || '''' AS line FROM knn k JOIN entities USING (entity_id)""")
def candidate_block(t: Tables):
    from skein.operators.retrieval import find_seeds
    found = find_seeds(t.questions(), t.entities()).join(t.entity_names(), "entity_id")
    return found.select("query_id", X.candidate_line(F.col("rank"), F.col("entity_id"), F.col("name")).alias("line"))


@query("upload_validation", """
SELECT source_id, CASE WHEN file_name IS NULL OR file_name = '' THEN 'missing file name' WHEN size > 104857600 THEN 'file too large' WHEN size = 0 THEN 'empty file'
  WHEN kind = 1 THEN 'metadata is not valid JSON' WHEN kind = 2 THEN 'metadata must be a JSON object' END AS problem
FROM (SELECT doc_id AS source_id, CASE WHEN doc_id % 13 <> 0 THEN 'f.txt' END AS file_name, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE n_chars * 20000 END AS size, doc_id % 5 AS kind FROM documents)""")
def upload_validation(t: Tables):
    n = F.col("doc_id")
    meta = F.when(n % 5 == 1, '{"a": ').when(n % 5 == 2, "[1, 2]").when(n % 5 == 3, F.lit(None).cast("string")).otherwise('{"a": 1}')
    rows = t.raw("documents").select(n.alias("source_id"), F.when(n % 13 != 0, "f.txt").alias("file_name"),
                                     F.when(n % 17 == 0, 0).otherwise(F.col("n_chars") * 20000).alias("size"), meta.alias("metadata"))
    return validate_uploads(rows).select("source_id", "problem")


# --- HTML ----------------------------------------------------------------------------------------------
@query("html_elements")
def html_elements(t: Tables):
    pages = spread(t.raw("pages").select(F.col("page_id").alias("source_id"), "html"))
    return html.elements(pages)


@query("html_chunks")
def html_chunks(t: Tables):
    pages = spread(t.raw("pages").select(F.col("page_id").alias("source_id"), "html"))
    return html.html_chunks(pages).drop("image_data")
