"""Full-text search and linting. The surveyed system names both and builds neither."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skein.operators import lint as L, search as S
from skein.operators.closepairs import close_pairs
from skein.plans.oracles import cte
from skein.plans.registry import query
from skein.sources.bridge import Tables


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{S.UPPER}', '{S.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def names_asked(t: Tables) -> DataFrame:
    """Every distinct entity name as a query, numbered by its first entity."""
    return t.entities().groupBy(F.col("name").alias("text")).agg(F.min("entity_id").alias("query_id"))


def found(t: Tables) -> S.Found:
    return S.search(names_asked(t), S.index_documents(t.raw("documents").select("doc_id", "text")))


cte("asked_names", "SELECT min(entity_id) AS query_id, name AS text FROM entities GROUP BY name")
cte("asked_terms", f"SELECT DISTINCT query_id, unnest({_words('text')}) AS term FROM asked_names")
cte("doc_words", f"SELECT doc_id, {_words('text')} AS w FROM documents")
cte("doc_terms", "SELECT doc_id, term, len(w) AS len, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM doc_words) GROUP BY 1, 2, 3, w")
cte("doc_sizes", "SELECT count(*) AS docs, sum(len(w)) / CAST(count(*) AS DOUBLE) AS mean FROM doc_words")
cte("term_df", "SELECT term, count(*) AS df FROM doc_terms GROUP BY term")
cte("bm25", f"""
SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * {S.K1 + 1} / (tf + {S.K1} * (1 - {S.B} + {S.B} * len / mean))), 9) AS score
FROM asked_terms JOIN term_df USING (term) JOIN doc_terms USING (term), doc_sizes GROUP BY 1, 2""")


@query("search_documents", """
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm25) WHERE rank <= 10""")
def search_documents(t: Tables):
    """The ten best documents of every entity name."""
    return found(t).hits.withColumn("score", F.round("score", 6))


@query("search_work")
def search_work(t: Tables):
    """How many posting blocks each search met and read."""
    return found(t).work


# --- lint ------------------------------------------------------------------------------------------
cte("lint_pages", "SELECT page_id, entity_id, slug, content, synthesized_at FROM wiki_pages WHERE status = 'published'")
cte("lint_pieces", "SELECT page_id, unnest(string_split(content, '[[')[2:]) AS piece FROM lint_pages")
cte("lint_links", "SELECT DISTINCT page_id, string_split(piece, ']]')[1] AS slug FROM lint_pieces WHERE contains(piece, ']]')")
cte("lint_alike", """
SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a, vecs b WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.92""")
_ORPHANS = """
SELECT 'orphan' AS kind, page_id, entity_id, slug AS detail FROM lint_pages p
WHERE NOT EXISTS (SELECT 1 FROM lint_links l WHERE l.slug = p.slug AND l.page_id <> p.page_id)"""
_MISSING = """
SELECT 'missing_link', page_id, CAST(NULL AS BIGINT), slug FROM lint_links WHERE slug NOT IN (SELECT slug FROM lint_pages)"""
_STALE = """
SELECT 'stale', p.page_id, p.entity_id, count(*) || ' newer chunks' FROM lint_pages p JOIN links k ON k.entity_id = p.entity_id
JOIN chunks c ON c.chunk_id = k.chunk_id JOIN sources s ON s.source_id = c.source_id WHERE s.created_at > p.synthesized_at GROUP BY 2, 3"""
_DUPLICATES = """
SELECT 'duplicate', CAST(NULL AS BIGINT), x.entity_id, CAST(min(y.entity_id) AS VARCHAR) FROM entities x
JOIN lint_alike ON a = x.vec_id JOIN entities y ON y.vec_id = b AND y.entity_type = x.entity_type WHERE y.entity_id < x.entity_id GROUP BY 3"""


@query("lint", " UNION ALL ".join((_ORPHANS, _MISSING, _STALE, _DUPLICATES)))
def lint_wiki(t: Tables):
    return L.lint(t.wiki_pages(), t.entities(), t.chunks(), t.chunk_entities())


@query("close_entity_vectors", """
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM vecs a, vecs b
WHERE a.vec_id < b.vec_id AND round(list_cosine_similarity(a.v, b.v), 6) >= 0.4""")
def close_entity_vectors(t: Tables):
    """All pairs of given vectors that are alike by a low threshold, so that there are some."""
    return close_pairs(t.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding"), 0.4).all_pairs()
