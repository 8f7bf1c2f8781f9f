"""Contexts for wiki pages and the pages themselves.

Contexts are long tables keyed by the entity or source; what enters a page is bounded by its token
budget before anything is folded into one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from skein.config import DEFAULTS, Settings
from skein.functions import text as T, vectors as V
from skein.operators import graph
from skein.operators.dedup import greedy_dedup
from skein.operators.ranking import budget_prefix
from skein.operators.retrieval import chunk_vectors, distinct_vectors, score_chunks
from skein.session import stage


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


@dataclass
class EntityContext:
    edges: DataFrame  # entity_id, relation_id, label, target_slug, outgoing
    chunks: DataFrame  # entity_id, chunk_id, source_file, chunk_index, ingested_at, text, cost, pos columns
    known: DataFrame  # entity_id, known_id, slug, name
    budget: DataFrame  # entity_id, room, used


def entity_context(wanted: DataFrame, entities: DataFrame, relations: DataFrame, chunks: DataFrame, links: DataFrame,
                   sources: DataFrame, pages: DataFrame, settings: Settings = DEFAULTS) -> EntityContext:
    """Context of every ``wanted(entity_id, source_id)``: relations, scored chunks of those sources, linkable names."""
    ids = wanted.select("entity_id").distinct()
    target = entities.join(ids, "entity_id", "left_semi")
    base = settings.synthesis_budget_tokens - settings.synthesis_metadata_tokens - settings.synthesis_relations_tokens
    has_page = pages.filter("entity_id IS NOT NULL AND content <> ''").select("entity_id").distinct().withColumn("_page", F.lit(True))
    room = target.select("entity_id").join(has_page, "entity_id", "left").select("entity_id", F.when(
        F.col("_page"), base - settings.synthesis_existing_page_tokens).otherwise(base).cast("bigint").alias("room"))

    slugs = entities.select(F.col("entity_id").alias("id"), "name", T.slug(F.col("name"), F.col("entity_id")).alias("slug"))
    edges = graph.one_hop_links(relations, slugs).join(ids, "entity_id", "left_semi")

    files = chunks.select("chunk_id", "source_id")
    pairs = links.join(files, "chunk_id").join(wanted, ["entity_id", "source_id"], "left_semi").select(
        F.col("entity_id").alias("query_id"), "chunk_id", F.lit(0).alias("tier"))
    meaning = target.select(F.col("entity_id").alias("query_id"), V.hash_embedding(
        F.coalesce(F.when(F.col("description") != "", F.col("description")), "name"),
        settings.embedding_dimensions).alias("embedding"))
    scored = stage(score_chunks(distinct_vectors(pairs, chunks, settings), meaning, chunks, settings), "wiki-scored")
    kept = greedy_dedup(scored.drop("cost"), ["query_id"], ["neg_sim", "chunk_id"], "chunk_id",
                        chunk_vectors(chunks, settings), settings).select(
        F.col("query_id").alias("entity_id"), "chunk_id", "neg_sim")
    ordered = budget_prefix(kept.join(entry_costs(chunks, sources), "chunk_id").join(room, "entity_id"), ["entity_id"], [F.col("neg_sim"), F.col("chunk_id")],
                            "cost", F.col("room"), base)
    chosen = stage(ordered.drop("room"), "wiki-chunks")

    used = chosen.groupBy("entity_id").agg(F.sum("cost").alias("used"))
    budget = stage(room.join(used, "entity_id", "left").na.fill(0, ["used"]), "wiki-budget")
    known = known_entities(wanted, chosen, budget, entities, slugs, relations, chunks, links, base, sources)
    return EntityContext(edges, chosen, known, budget)


def _named_chunks(chunks: DataFrame, sources: DataFrame, *more: Column) -> DataFrame:
    """``(chunk_id, source_id, source_file, chunk_index, ingested_at, ...)`` and what opens a chunk's entry as ``head``."""
    named = chunks.select("chunk_id", "source_id", "chunk_index", *more, F.coalesce(iso(F.col("created_at")), F.lit("")).alias("ingested_at")).join(
        sources.select("source_id", "file_name"), "source_id", "left").withColumn(
        "source_file", F.coalesce("file_name", F.lit("unknown"))).drop("file_name")
    return named.withColumn("head", F.concat(
        F.lit("---\n["), F.col("source_file"), F.lit(":"), F.col("chunk_index").cast("string"), F.lit("] (source: "),
        F.col("source_file"), F.lit(", ingested: "), F.col("ingested_at"), F.lit(")\n")))


def chunk_entries(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks as citable entries: ``(chunk_id, source_id, source_file, chunk_index, ingested_at, text, entry)``."""
    named = _named_chunks(chunks, sources, F.coalesce("text_content", F.lit("")).alias("text"))
    return named.withColumn("entry", F.concat("head", "text")).drop("head")


def entry_costs(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """``chunk_entries`` with the tokens of the entry as ``cost`` instead of the texts, of which only the lengths move."""
    named = _named_chunks(chunks, sources, F.length(F.coalesce("text_content", F.lit(""))).alias("chars"))
    return named.withColumn("cost", T.tokens_of(F.length("head") + F.col("chars"))).drop("head", "chars")


def mentioned(wanted: DataFrame, chosen: DataFrame, entities: DataFrame, chunks: DataFrame, links: DataFrame,
              sources: DataFrame) -> DataFrame:
    """``(entity_id, known_id)``: entities of the same sources whose name occurs in a chosen entry."""
    texts = chunk_entries(chunks.join(chosen.select("chunk_id").distinct(), "chunk_id", "left_semi"), sources).select(
        "chunk_id", F.lower("entry").alias("haystack"))
    names = entities.select(F.col("entity_id").alias("known_id"), F.lower("name").alias("needle"))
    # a name is looked for only in the entries of pages that share a source with it, never in every text
    member = links.join(chunks.select("chunk_id", "source_id"), "chunk_id").select(F.col("entity_id").alias("known_id"), "source_id").distinct()
    near = stage(wanted.select("entity_id", "source_id").distinct().join(member, "source_id").select("entity_id", "known_id").distinct()
                 .join(names, "known_id"), "wiki-near")
    asked = near.select("entity_id", "needle").distinct().join(chosen.select("entity_id", "chunk_id"), "entity_id")
    said = asked.join(texts, "chunk_id").filter(F.col("haystack").contains(F.col("needle"))).select("entity_id", "needle").distinct()
    return near.join(said, ["entity_id", "needle"]).select("entity_id", "known_id")


def known_entities(wanted: DataFrame, chosen: DataFrame, budget: DataFrame, entities: DataFrame, slugs: DataFrame,
                   relations: DataFrame, chunks: DataFrame, links: DataFrame, max_budget: int, sources: DataFrame) -> DataFrame:
    """Linkable names in the room the chunks leave: neighbours in order of their relations, then mentions."""
    ids = wanted.select("entity_id").distinct()
    near = graph.adjacency(relations).withColumnRenamed("node", "entity_id").join(ids, "entity_id", "left_semi").groupBy(
        "entity_id", F.col("nbr").alias("known_id")).agg(
        F.min(F.struct((~F.col("outgoing")).cast("int").alias("tier"), F.col("relation_id").alias("at"))).alias("o"))
    said = mentioned(wanted, chosen, entities, chunks, links, sources).join(
        near.select("entity_id", "known_id"), ["entity_id", "known_id"], "left_anti").select(
        "entity_id", "known_id", F.struct(F.lit(2).alias("tier"), F.col("known_id").alias("at")).alias("o"))
    named = near.unionByName(said).join(slugs.withColumnRenamed("id", "known_id"), "known_id").withColumn(
        "line", F.concat(F.lit("- [["), F.col("slug"), F.lit("]] — "), F.col("name"))).withColumn(
        "cost", T.estimate_tokens(F.col("line")))
    left = budget.select("entity_id", (F.col("room") - F.col("used")).alias("left"))
    return budget_prefix(named.join(left, "entity_id"), ["entity_id"], [F.col("o.tier"), F.col("o.at"), F.col("known_id")],
                         "cost", F.col("left"), max_budget).select("entity_id", "known_id", "slug", "name", "cost", "o")


@dataclass
class SourceContext:
    chunks: DataFrame  # source_id, chunk_id, chunk_index, summary
    touched: DataFrame  # source_id, entity_id, slug, name
    relations: DataFrame  # source_id, relation_id, source_slug, label, target_slug
    head: DataFrame  # source_id, file_name, ingested_at, chunk_count, reingest_count, previous_ingested_at


def source_context(sources: DataFrame, entities: DataFrame, relations: DataFrame, chunks: DataFrame,
                   links: DataFrame) -> SourceContext:
    """Context of every source: its chunks, the entities it touches, the relations it introduced."""
    slugs = entities.select("entity_id", "name", T.slug(F.col("name"), F.col("entity_id")).alias("slug"))
    where = chunks.select("chunk_id", "source_id")
    listed = chunks.join(sources.select("source_id"), "source_id", "left_semi").select(
        "source_id", "chunk_id", "chunk_index", T.first_line_summary(F.coalesce("text_content", F.lit(""))).alias("summary"))
    touched = links.join(where, "chunk_id").select("source_id", "entity_id").distinct().join(slugs, "entity_id")
    ends = slugs.select(F.col("entity_id").alias("source_entity_id"), F.col("slug").alias("source_slug"))
    other = slugs.select(F.col("entity_id").alias("target_entity_id"), F.col("slug").alias("target_slug"))
    drawn = relations.join(where, "chunk_id").join(ends, "source_entity_id").join(other, "target_entity_id").select(
        "source_id", "relation_id", "source_slug", F.col("relation_type").alias("label"), "target_slug")
    counts = listed.groupBy("source_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    head = sources.join(counts, "source_id", "left").select(
        "source_id", "file_name", F.coalesce(iso(F.col("created_at")), F.lit("")).alias("ingested_at"),
        F.coalesce("chunk_count", F.lit(0)).cast("bigint").alias("chunk_count"),
        F.coalesce(F.get_json_object("metadata", "$.reingest_count").cast("bigint"), F.lit(0)).alias("reingest_count"),
        F.get_json_object("metadata", "$.previous_ingested_at").alias("previous_ingested_at"))
    return SourceContext(listed, touched, drawn, head)


NO_CONTRADICTIONS = "*No contradictions detected.*"


def _lines(df: DataFrame, key: str, order: list[Column], line: Column, name: str) -> DataFrame:
    """One text per key from its ordered lines; only for groups a budget or a document bounds."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line"))))
    return df.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias(name))


def render_entity_pages(context: EntityContext, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """Deterministic stand-in for the page writer: cited first lines, links to known entities only, sources.

    ``(entity_id, title, slug, content, synthesized_from_sources)``
    """
    cite = F.concat(F.lit("["), F.col("source_file"), F.lit(":"), F.col("chunk_index").cast("string"), F.lit("]"))
    texts = chunks.select("chunk_id", T.first_line_summary(F.coalesce("text_content", F.lit(""))).alias("summary"))
    cited = context.chunks.join(texts, "chunk_id")
    prose = _lines(cited, "entity_id", [F.col("neg_sim"), F.col("chunk_id")],
                   F.concat(F.col("summary"), F.lit(" "), cite), "prose")
    refs = _lines(cited, "entity_id", [F.col("chunk_id")], F.concat(F.lit("- "), cite, F.lit(" "), F.col("source_file")), "refs")
    links = context.edges.select("entity_id", "label", F.col("target_slug").alias("slug")).distinct().join(
        context.known.select("entity_id", "slug"), ["entity_id", "slug"], "left_semi")
    bullets = _lines(links, "entity_id", [F.col("label"), F.col("slug")],
                     F.concat(F.lit("- "), F.col("label"), F.lit(": [["), F.col("slug"), F.lit("]]")), "bullets")
    used = cited.groupBy("entity_id").agg(F.array_sort(F.collect_set(F.col("source_id").cast("string"))).alias("ids"))
    page = context.budget.select("entity_id").join(entities.select("entity_id", "name"), "entity_id")
    for part in (prose, refs, bullets, used):
        page = page.join(part, "entity_id", "left")
    blank = F.lit("")
    body = F.concat(
        F.lit("# "), F.col("name"), F.lit("\n"), F.col("prose"), F.lit("\n\n## Relations\n"), F.coalesce("bullets", blank),
        F.lit(f"\n\n## Contradictions\n{NO_CONTRADICTIONS}\n\n## Sources\n"), F.coalesce("refs", blank))
    empty = F.concat(F.lit("# "), F.col("name"), F.lit("\n\n*Synthesis produced no content.*"))
    return page.select(
        "entity_id", F.col("name").alias("title"), T.slug(F.col("name"), F.col("entity_id")).alias("slug"),
        F.coalesce(body, empty).alias("content"),
        F.coalesce("ids", F.expr("array()").cast("array<string>")).alias("synthesized_from_sources"))


def render_source_pages(context: SourceContext) -> DataFrame:
    """Deterministic source summaries: ``(source_id, title, slug, content, synthesized_from_sources)``."""
    head = context.head
    listing = _lines(context.chunks.join(head.select("source_id", "file_name"), "source_id"), "source_id", [F.col("chunk_index")],
                     F.concat(F.lit("- ["), F.col("file_name"), F.lit(":"), F.col("chunk_index").cast("string"), F.lit("] — "),
                              F.col("summary")), "listing")
    touched = _lines(context.touched, "source_id", [F.col("entity_id")],
                     F.concat(F.lit("- [["), F.col("slug"), F.lit("]] — "), F.col("name")), "touched")
    arrows = _lines(context.relations, "source_id", [F.col("relation_id")],
                    F.concat(F.lit("- [["), F.col("source_slug"), F.lit("]] → "), F.col("label"), F.lit(" → [["),
                             F.col("target_slug"), F.lit("]]")), "arrows")
    lead = context.chunks.filter("chunk_index = 0").select("source_id", F.col("summary").alias("lead"))
    page = head
    for part in (listing, touched, arrows, lead):
        page = page.join(part, "source_id", "left")
    blank = F.lit("")
    history = F.concat(F.lit("- Ingested: "), F.col("ingested_at"), F.when(F.col("reingest_count") > 0, F.concat(
        F.lit("\n- Re-ingest number: "), F.col("reingest_count").cast("string"), F.lit("\n- Previous ingest: "),
        F.coalesce("previous_ingested_at", blank))).otherwise(blank))
    content = F.concat(
        F.lit("# "), F.col("file_name"), F.lit("\n"), F.coalesce(F.concat("lead", F.lit(" ["), "file_name", F.lit(":0]")), blank),
        F.lit("\n\n## Pages created or updated\n"), F.coalesce("touched", blank),
        F.lit("\n\n## Key relations introduced\n"), F.coalesce("arrows", blank),
        F.lit(f"\n\n## Contradictions\n{NO_CONTRADICTIONS}\n\n## Ingest history\n"), history,
        F.lit("\n\n## Chunks\n"), F.coalesce("listing", blank))
    return page.select(
        "source_id", F.col("file_name").alias("title"), T.slug(F.col("file_name"), F.col("source_id")).alias("slug"), content.alias("content"),
        F.array(F.col("source_id").cast("string")).alias("synthesized_from_sources"))


def page_backlinks(pages: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """``(page_id, entity_id)``: every entity page names its entity and all entities related to it."""
    own = pages.filter("entity_id IS NOT NULL").select("page_id", "entity_id")
    return own.join(graph.connected(relations, entities), "entity_id").select("page_id", F.col("connected_id").alias("entity_id"))
