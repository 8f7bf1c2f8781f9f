"""Scalar text functions, sections, chunking, plans and vector expressions."""

from __future__ import annotations

from datetime import datetime, timedelta
import uuid

from pyspark.sql import Column, functions as F

from skein.config import DEFAULTS
from skein.functions import text as T, vectors as V
from skein.operators import planning
from skein.operators.chunking import chunk_documents, explode_chunks, pack_sections
from skein.plans.oracles import CAPS, HALF, NL, WS_CHARS, cte, slug, strip, tokens
from skein.plans.registry import query
from skein.session import spread, staging_root
from skein.sources.bridge import Tables
from skein.sources.planlog import TTL_DAYS, PlanLog


def docs(t: Tables):
    return spread(t.raw("documents").select("doc_id", "text"))


def h(c: Column) -> Column:
    return F.md5(c.cast("binary"))


@query("token_estimate", f"SELECT doc_id, CAST({tokens('text')} AS BIGINT) AS tokens FROM documents")
def token_estimate(t: Tables):
    return docs(t).select("doc_id", T.estimate_tokens(F.col("text")).cast("bigint").alias("tokens"))


@query("slugify", f"""
SELECT 'part' AS kind, p_partkey AS id, {slug('p_name', 'p_partkey')} AS slug FROM part
UNION ALL SELECT 'customer', c_custkey, {slug('c_name', 'c_custkey')} FROM customer
UNION ALL SELECT 'document', doc_id, {slug('text', 'doc_id')} FROM documents""")
def slugify(t: Tables):
    part = t.raw("part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("n"))
    cust = t.raw("customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("n"))
    doc = docs(t).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("n"))
    return part.unionByName(cust).unionByName(doc).select("kind", "id", T.slug(F.col("n"), F.col("id")).alias("slug"))


@query("excerpt", f"""
SELECT page_id, CASE WHEN length(p) <= 200 THEN p ELSE
  CASE WHEN strpos(reverse(left(p, 200)), ' ') BETWEEN 1 AND 199 THEN left(p, 200 - strpos(reverse(left(p, 200)), ' ')) ELSE left(p, 200) END || '...' END AS excerpt
FROM (SELECT page_id, {strip(f"string_split(content, {HALF})[1]")} AS p FROM wiki_pages)""")
def excerpt(t: Tables):
    return t.wiki_pages().select("page_id", T.excerpt(F.col("content")).alias("excerpt"))


@query("first_line_summary", f"""
SELECT doc_id, CASE WHEN length(l) > 80 THEN left(l, 77) || '...' ELSE l END AS summary
FROM (SELECT doc_id, string_split(text, {NL})[1] AS l FROM documents)""")
def first_line_summary(t: Tables):
    return docs(t).select("doc_id", T.first_line_summary(F.col("text")).alias("summary"))


@query("advisory_key", """
SELECT entity_id, CAST(CAST('0x' || substr(md5(name), 1, 16) AS UBIGINT) % 9223372036854775807 AS BIGINT) AS lock_key FROM names""")
def advisory_key(t: Tables):
    return t.entity_names().select("entity_id", T.lock_key(F.col("name")).alias("lock_key"))


@query("title_case", r"""
SELECT kind, id, array_to_string(list_transform(regexp_extract_all(n, '\p{L}+|[^\p{L}]+'), lambda r: upper(r[1]) || lower(r[2:])), '') AS title
FROM (SELECT 'part' AS kind, p_partkey AS id, p_name AS n FROM part UNION ALL SELECT 'customer', c_custkey, c_mktsegment || '-' || c_name FROM customer)""")
def title_case(t: Tables):
    part = t.raw("part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("n"))
    cust = t.raw("customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"),
                                    F.concat("c_mktsegment", F.lit("-"), "c_name").alias("n"))
    return part.unionByName(cust).select("kind", "id", T.title_case(F.col("n")).alias("title"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(t: Tables):
    return docs(t).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


@query("head_truncation", "SELECT page_id, md5(left(content, 3200)) AS head_md5 FROM wiki_pages")
def head_truncation(t: Tables):
    limit = DEFAULTS.synthesis_existing_page_tokens * DEFAULTS.chars_per_token
    return t.wiki_pages().select("page_id", h(F.substring("content", 1, limit)).alias("head_md5"))


# --- sections ------------------------------------------------------------------------------------
@query("txt_sections", "SELECT doc_id, n - 1 AS pos, md5(text) AS section_md5 FROM sections")
def txt_sections(t: Tables):
    return docs(t).select("doc_id", F.posexplode(T.txt_sections(F.col("text"))).alias("pos", "s")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), h(F.col("s")).alias("section_md5"))


cte("md_lines", f"""
SELECT page_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
FROM (SELECT page_id, string_split({strip('content')}, {NL}) AS parts FROM wiki_pages)""")
cte("md_sections", rf"""
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY sec) AS n, string_agg(line, {NL} ORDER BY pos) AS text
FROM (SELECT *, sum(CAST(regexp_matches({strip('line')}, '^#{{1,6}}\s') AS INT)) OVER (PARTITION BY page_id ORDER BY pos) AS sec FROM md_lines)
GROUP BY page_id, sec""")


@query("md_sections", "SELECT page_id, n - 1 AS pos, md5(text) AS section_md5 FROM md_sections")
def md_sections(t: Tables):
    return t.wiki_pages().select("page_id", F.posexplode(T.md_sections(F.col("content"))).alias("pos", "s")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), h(F.col("s")).alias("section_md5"))


@query("wiki_sections_priority", """
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY prio, sec) - 1 AS pos, tag, md5(text) AS section_md5, CAST(fits AS INT) AS fits
FROM page_cut""")
def wiki_sections_priority(t: Tables):
    tagged = F.transform(T.wiki_sections(F.col("content")), lambda s, i: F.struct(
        T.section_priority(s["tag"]).alias("prio"), i.alias("sec"), s["tag"].alias("tag"), s["text"].alias("text")))
    rows = t.wiki_pages().filter("entity_id IS NOT NULL").select("page_id", F.posexplode(F.array_sort(tagged)).alias("pos", "s"))
    # pages are whole rows, so the running cost of a page's sections stays inside one small window
    from pyspark.sql import Window
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), F.col("s.tag").alias("tag"),
                       h(F.col("s.text")).alias("section_md5"),
                       (F.sum(T.estimate_tokens(F.col("s.text"))).over(w) <= DEFAULTS.wiki_page_budget_tokens).cast("int").alias("fits"))


# --- chunks --------------------------------------------------------------------------------------
@query("chunk_documents", """
SELECT source_id AS doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, length(text_content) AS n_chars, md5(text_content) AS text_md5,
  md5(section_heading) AS heading_md5 FROM chunks""")
def chunk_documents_query(t: Tables):
    return _hashed(chunk_documents(docs(t), "doc_id"), "doc_id")


def _hashed(chunks, key: str):
    return chunks.select(key, F.col("chunk_index").cast("bigint").alias("chunk_index"), F.length("text_content").cast("bigint").alias("n_chars"),
                         h(F.col("text_content")).alias("text_md5"), h(F.col("section_heading")).alias("heading_md5"))


def _packed(prefix: str, sections: str, key: str) -> str:
    """CTEs that pack ``sections(key, n, text)`` into chunks with all three kinds of pieces."""
    cte(f"{prefix}_paras", f"""
SELECT {key}, n, sub, CASE WHEN long THEN CASE WHEN length(text) <= 2048 THEN 1 ELSE 2 END ELSE 0 END AS kind, text FROM (
  SELECT {key}, n, 0 AS sub, false AS long, text FROM {sections} WHERE length(text) <= 2048
  UNION ALL
  SELECT {key}, n, generate_subscripts(paras, 1), true, unnest(paras) FROM (
    SELECT {key}, n, CASE WHEN len(p) > 0 THEN p ELSE [text] END AS paras FROM (
      SELECT {key}, n, text, list_filter(list_transform(string_split(text, {HALF}), lambda x: trim(x, ws)), lambda x: x <> '') AS p
      FROM {sections}, (SELECT {WS_CHARS} AS ws) WHERE length(text) > 2048)))""")
    cte(f"{prefix}_pieces", f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n, sub) AS i FROM {prefix}_paras")
    cte(f"{prefix}_fold", f"""
SELECT {key}, i, 1 AS grp, CASE WHEN kind = 2 THEN 0 ELSE length(text) END AS open FROM {prefix}_pieces WHERE i = 1
UNION ALL
SELECT p.{key}, p.i, CASE WHEN p.kind = 0 AND f.open > 0 AND f.open + length(p.text) + 2 <= 2048 THEN f.grp ELSE f.grp + 1 END,
  CASE WHEN p.kind = 2 THEN 0 WHEN p.kind = 0 AND f.open > 0 AND f.open + length(p.text) + 2 <= 2048 THEN f.open + length(p.text) + 2
  ELSE length(p.text) END
FROM {prefix}_fold f JOIN {prefix}_pieces p ON p.{key} = f.{key} AND p.i = f.i + 1""")
    cte(f"{prefix}_raw", f"""
SELECT {key}, grp, 0 AS part, string_agg(text, {HALF} ORDER BY i) AS text, string_split(arg_min(text, i), {NL})[1] AS heading
FROM {prefix}_fold JOIN {prefix}_pieces USING ({key}, i) WHERE kind < 2 GROUP BY {key}, grp
UNION ALL
SELECT {key}, grp, off, substr(text, off + 1, 2048), CASE WHEN off = 0 THEN substr(text, 1, least(80, length(text) // 4)) END
FROM (SELECT {key}, grp, text, unnest(range(0, length(text), 1792)) AS off FROM {prefix}_fold JOIN {prefix}_pieces USING ({key}, i) WHERE kind = 2)""")
    cte(f"{prefix}_chunks", f"""
SELECT {key}, idx, body, CASE WHEN idx = 0 THEN coalesce(heading, '') ELSE coalesce(nullif(heading, ''), body) END AS heading FROM (
  SELECT {key}, idx, CASE WHEN idx = 0 THEN text ELSE right(prev, 256) || text END AS body, heading
  FROM (SELECT {key}, text, heading, row_number() OVER w - 1 AS idx, lag(text) OVER w AS prev
        FROM {prefix}_raw WINDOW w AS (PARTITION BY {key} ORDER BY grp, part)))""")


def _hashed_sql(prefix: str, key: str) -> str:
    return f"""SELECT {key}, idx AS chunk_index, length(body) AS n_chars, md5(body) AS text_md5, md5(heading) AS heading_md5 FROM {prefix}_chunks"""


cte("line_sections", f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, line AS text FROM lines WHERE line <> ''""")
_packed("byline", "line_sections", "doc_id")
_packed("mdpage", "md_sections", "page_id")


@query("chunk_lines_packed", _hashed_sql("byline", "doc_id"))
def chunk_lines_packed(t: Tables):
    """Every line its own section: exercises the packing of small sections."""
    lines = F.filter(F.transform(F.split(T.strip(F.col("text")), "\n"), T.strip), lambda x: x != "")
    return _hashed(explode_chunks(docs(t), pack_sections(lines), ["doc_id"]), "doc_id")


@query("chunk_markdown", _hashed_sql("mdpage", "page_id"))
def chunk_markdown(t: Tables):
    pages = spread(t.wiki_pages().select("page_id", "content"))
    return _hashed(chunk_documents(pages, "page_id", "content", F.lit(True)), "page_id")


@query("chunk_overlap", """
SELECT source_id AS doc_id, count(*) AS n_chunks, max(length(text_content)) AS longest,
  sum(length(text_content)) AS total_chars, CAST(sum(CASE WHEN length(text_content) > 2048 THEN 1 ELSE 0 END) AS BIGINT) AS over_max
FROM chunks GROUP BY source_id""".replace("sum(length(text_content))", "CAST(sum(length(text_content)) AS BIGINT)"))
def chunk_overlap(t: Tables):
    n = F.length("text_content").cast("bigint")
    return t.chunks().groupBy(F.col("source_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.max(n).alias("longest"), F.sum(n).alias("total_chars"),
        F.count_if(n > DEFAULTS.chunk_max_chars).alias("over_max"))


# --- plans ---------------------------------------------------------------------------------------
cte("upload_names", """
SELECT doc_id AS source_id, 'upload_' || doc_id || ['.txt', '.MD', '.pdf', '.html', '.docx', '.xyz', ''][doc_id % 7 + 1] AS file_name,
  n_chars * 1000 AS file_size, CASE WHEN doc_id % 11 = 0 THEN ['ocr', 'simple', 'unstructured', 'pdf'][doc_id % 4 + 1] END AS parser FROM documents""")


def upload_names(t: Tables):
    exts = F.array(*[F.lit(x) for x in (".txt", ".MD", ".pdf", ".html", ".docx", ".xyz", "")])
    parsers = F.array(*[F.lit(x) for x in ("ocr", "simple", "unstructured", "pdf")])
    parser = F.when(F.col("doc_id") % 11 == 0, F.get(parsers, (F.col("doc_id") % 4).cast("int")))
    return t.raw("documents").select(
        F.col("doc_id").alias("source_id"), F.concat(F.lit("sources/"), F.col("doc_id")).alias("storage_key"),
        F.concat(F.lit("upload_"), F.col("doc_id"), F.get(exts, (F.col("doc_id") % 7).cast("int"))).alias("file_name"),
        (F.col("n_chars") * 1000).alias("file_size"), F.to_json(F.struct(parser.alias("parser"))).alias("metadata"))


@query("ingest_plan", """
SELECT source_id,
  CASE WHEN parser = 'ocr' THEN 'pdf' WHEN parser IS NOT NULL THEN parser ELSE mime END AS detected_type,
  CASE WHEN parser IN ('ocr', 'pdf') THEN 'structured' WHEN parser = 'simple' THEN 'semi-structured' WHEN parser IS NOT NULL THEN 'unstructured'
       WHEN mime = 'application/pdf' THEN 'structured' WHEN mime IN ('text/plain', 'text/markdown') THEN 'semi-structured' ELSE 'unstructured' END AS detected_structure,
  CASE WHEN parser = 'ocr' THEN 'pdf' WHEN parser IS NOT NULL THEN parser WHEN mime = 'application/pdf' THEN 'pdf'
       WHEN mime IN ('text/plain', 'text/markdown') THEN 'simple' ELSE 'unstructured' END AS selected_parser,
  CASE WHEN parser = 'ocr' THEN 'with_ocr' WHEN parser IS NULL AND mime = 'application/pdf' THEN 'standard' END AS pdf_mode,
  'section' AS chunking_strategy, CAST(1.0 AS DOUBLE) AS confidence, 'simple' AS fallback_parser,
  CASE WHEN parser IS NOT NULL THEN 'explicit override in metadata: ' || parser ELSE 'mime=' || mime || ' structure=' ||
    CASE WHEN mime = 'application/pdf' THEN 'structured' WHEN mime IN ('text/plain', 'text/markdown') THEN 'semi-structured' ELSE 'unstructured' END
    || ' density=' || CASE WHEN file_size >= 10485760 THEN 'large' ELSE 'small' END END AS rationale, '1.0.0' AS planner_version
FROM (SELECT *, CASE lower(regexp_extract(file_name, '\\.([^./]+)$', 1)) WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'pdf' THEN 'application/pdf'
        WHEN 'html' THEN 'text/html' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
        ELSE 'application/octet-stream' END AS mime FROM upload_names)""")
def ingest_plan(t: Tables):
    return planning.plan_sources(upload_names(t))


B = r"(^|[^\p{L}\p{N}_])"


def _plan_sql(rows: str) -> str:
    """Plan columns from ``rows(query_id, raw_query, type, confidence, rationale, source)``."""
    return f"""
SELECT query_id, md5(raw_query) AS query_md5, type AS classified_type,
  CASE WHEN mid OR type IN ('relationship_query', 'summarization') THEN 'deep' ELSE 'shallow' END AS retrieval_depth,
  CAST(CASE WHEN mid THEN greatest(seeds, 3) ELSE seeds END AS BIGINT) AS seed_count,
  CASE WHEN mid THEN 'escalated: mid-confidence ' || confidence ELSE ['top-3 seeds found', 'graph depth 2 reached', 'top-10 chunks aggregated', 'all entities resolved'][kind] END AS termination_condition,
  confidence, source AS classification_source, rationale, confidence < 0.5 AS rejected
FROM (SELECT *, confidence >= 0.5 AND confidence < 0.8 AS mid, [1, 2, 5, 0][kind] AS seeds
      FROM (SELECT *, list_position(['factual_lookup', 'relationship_query', 'summarization', 'comparison'], type) AS kind FROM ({rows})))"""


cte("rules", rf"""
SELECT query_id, text AS raw_query, ['factual_lookup', 'relationship_query', 'summarization', 'comparison', 'factual_lookup'][rule] AS type,
  CASE WHEN rule < 5 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS confidence,
  CASE WHEN rule < 5 THEN 'keyword match: ' || ['(?i)\b(what is|define|who is)', '(?i)\b(how\b.*\brelate|connect|relationship)',
    '(?i)\b(summar|overview|give me an overview)', '(?i)\b(compare|difference|versus|vs)'][rule]
  ELSE 'no keyword match, defaulting to factual_lookup' END AS rationale, 'rule' AS source
FROM (SELECT *, CASE WHEN regexp_matches(text, '(?i){B}(what is|define|who is)') THEN 1
  WHEN regexp_matches(text, '(?i){B}(how($|[^\p{{L}}\p{{N}}_].*[^\p{{L}}\p{{N}}_]relate|[^\p{{L}}\p{{N}}_]relate)|connect|relationship)') THEN 2
  WHEN regexp_matches(text, '(?i){B}(summar|overview)') THEN 3
  WHEN regexp_matches(text, '(?i){B}(compare|difference|versus|vs)') THEN 4 ELSE 5 END AS rule FROM questions)""")
# a model's answer per question, as it would come back: fenced JSON, sometimes broken or of an unknown type
cte("model_answers", """
SELECT query_id, text, turn, (conv_id + turn) % 10 AS tenth, CASE WHEN turn % 3 = 2 THEN 'poetry' ELSE ['comparison', 'summarization'][turn % 2 + 1] END AS type
FROM (SELECT conv_id * 1000 + turn AS query_id, conv_id, turn FROM conversations WHERE role = 'user') JOIN questions USING (query_id)""")


def _plan_rows(plans):
    return plans.select("query_id", h(F.col("raw_query")).alias("query_md5"), "classified_type", "retrieval_depth",
                        F.col("seed_count").cast("bigint").alias("seed_count"), "termination_condition", "confidence",
                        "classification_source", "rationale", "rejected")


@query("query_plan_rules", _plan_sql("SELECT * FROM rules"))
def query_plan_rules(t: Tables):
    return _plan_rows(planning.classify(t.questions().select("query_id", "text")))


@query("query_plan_escalation", _plan_sql("""
SELECT r.query_id, r.raw_query, CASE WHEN ok THEN a.type ELSE r.type END AS type,
  CASE WHEN ok THEN a.tenth / CAST(10 AS DOUBLE) ELSE r.confidence END AS confidence,
  CASE WHEN ok THEN 'because' ELSE r.rationale END AS rationale, CASE WHEN ok THEN 'llm' ELSE r.source END AS source
FROM rules r JOIN (SELECT *, type <> 'poetry' AND tenth <> 9 AS ok FROM model_answers
  QUALIFY row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY query_id) = 1) a
ON lower(trim(a.text)) = lower(trim(r.raw_query))"""))
def query_plan_escalation(t: Tables):
    asked = t.asked().select("query_id", "text", "conv_id", "turn")
    turn, conv = [F.coalesce(F.col(c), F.lit(0)) for c in ("turn", "conv_id")]
    kind = F.when(turn % 3 == 2, "poetry").otherwise(F.when(turn % 2 == 0, "comparison").otherwise("summarization"))
    tenth = (conv + turn) % 10
    body = F.concat(F.lit('```json\n{"type": "'), kind, F.lit('", "confidence": '), (tenth / 10).cast("string"),
                    F.lit(', "rationale": "because"'), F.when(tenth == 9, "").otherwise("}"), F.lit("\n```"))
    first = asked.groupBy(planning.question_key(F.col("text")).alias("question_key")).agg(
        F.min(F.struct("query_id", body.alias("answer")))["answer"].alias("answer"))
    return _plan_rows(planning.classify(asked.select("query_id", "text"), first))


@query("plan_log", _plan_sql("SELECT * FROM rules WHERE confidence >= 0.5"))
def plan_log(t: Tables):
    """Plans in the log after a run was appended twice and an older one expired."""
    log = PlanLog(t.spark, f"{staging_root(t.spark)}/plans-{uuid.uuid4().hex}")
    plans = planning.classify(t.questions().select("query_id", "text"))
    now = datetime(2024, 6, 30, 12)
    log.append(plans, "old", now - timedelta(days=TTL_DAYS))
    for _ in range(2):
        log.append(plans, "new", now)
    log.expire(now)
    return _plan_rows(log.live(now).withColumn("rejected", F.lit(False)))


# --- vectors -------------------------------------------------------------------------------------
cte("hash_bytes", """
SELECT entity_id, list_transform(range(0, 64), lambda i: CAST(CAST('0x' || substr(d, (i % 32) * 2 + 1, 2) AS INT) / 127.5 - 1.0 AS FLOAT)) AS v
FROM (SELECT entity_id, sha256(description) AS d FROM entities)""")


@query("hash_embedding", """
SELECT entity_id, round(CAST(v[1] AS DOUBLE), 4) AS first, round(CAST(v[33] AS DOUBLE), 4) AS again, len(v) AS dims,
  round(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE))), 3) AS total,
  md5(array_to_string(list_transform(v, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT) AS VARCHAR)), ',')) AS digest FROM hash_bytes""")
def hash_embedding(t: Tables):
    made = t.entities().select("entity_id", V.hash_embedding(F.col("description"), 64).alias("v"))
    return made.select("entity_id", F.round(F.get("v", F.lit(0)).cast("double"), 4).alias("first"),
                       F.round(F.get("v", F.lit(32)).cast("double"), 4).alias("again"), F.size("v").cast("bigint").alias("dims"),
                       F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 3).alias("total"),
                       F.md5(F.array_join(F.transform("v", lambda x: F.round(x.cast("double") * 10000).cast("bigint").cast("string")), ",")).alias("digest"))


@query("pad_vectors", """
SELECT vec_id, CAST(3072 AS BIGINT) AS dims, round(list_sum(list_transform(v, lambda x: x * x)), 4) AS norm2 FROM vecs""")
def pad_vectors(t: Tables):
    wide = t.raw("embeddings").select("vec_id", V.pad_to(F.col("embedding"), 3072).alias("v"))
    return wide.select("vec_id", F.size("v").cast("bigint").alias("dims"),
                       F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm2"))
