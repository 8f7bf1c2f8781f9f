"""Linting of a wiki: duplicate entities, orphan pages, missing links and stale pages, as rows ``(kind, page_id, entity_id, detail)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skein.config import DEFAULTS, Settings
from skein.operators.closepairs import close_pairs
from skein.session import stage


def _no_id(name: str) -> Column:
    return F.lit(None).cast("bigint").alias(name)


def page_links(pages: DataFrame) -> DataFrame:
    """``(page_id, slug)`` of the links in page texts, distinct: a link stands between ``[[`` and the next ``]]``."""
    pieces = F.slice(F.split("content", r"\[\["), 2, 1 << 30)
    closed = F.filter(pieces, lambda p: p.contains("]]"))
    slugs = F.transform(closed, lambda p: F.substring_index(p, "]]", 1))
    return pages.select("page_id", F.explode(F.array_distinct(slugs)).alias("slug"))


def orphan_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages that no other page links to; a page's links to itself don't count."""
    linked = links.join(pages.select(F.col("page_id").alias("to_page"), "slug"), "slug").where("page_id <> to_page").select(F.col("to_page").alias("page_id"))
    return pages.join(linked, "page_id", "left_anti").select(F.lit("orphan").alias("kind"), "page_id", "entity_id", F.col("slug").alias("detail"))


def missing_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Links to slugs that no page has."""
    lost = links.join(pages.select("slug"), "slug", "left_anti")
    return lost.select(F.lit("missing_link").alias("kind"), "page_id", _no_id("entity_id"), F.col("slug").alias("detail"))


def stale_pages(pages: DataFrame, chunks: DataFrame, chunk_entities: DataFrame) -> DataFrame:
    """Entity pages that were written before the newest chunk that mentions their entity; the detail counts the newer chunks."""
    told = chunk_entities.join(chunks.select("chunk_id", "created_at"), "chunk_id").join(pages.where("entity_id is not null").select("entity_id", "page_id", "synthesized_at"), "entity_id")
    late = told.where("created_at > synthesized_at").groupBy("page_id", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    return late.select(F.lit("stale").alias("kind"), "page_id", "entity_id", F.concat(F.col("n").cast("string"), F.lit(" newer chunks")).alias("detail"))


def duplicate_entities(entities: DataFrame, threshold: float) -> DataFrame:
    """Entities of one type whose vectors are ``threshold`` alike or equal, one row for each, with the smallest such entity as detail.

    Compared are classes of equal vectors; of a link between classes every member is told, with the smallest member of the other or own class.
    """
    typed = entities.select(F.col("entity_id").alias("id"), "embedding", "entity_type")
    close = close_pairs(typed, threshold)
    of = close.members.join(typed.select("id", "entity_type"), "id")
    # the smallest member of each type in a class
    firsts = stage(of.groupBy("representative", "entity_type").agg(F.min("id").alias("first")), "lint-firsts")
    both = close.pairs.select("a", "b").unionByName(close.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.unionByName(firsts.select(F.col("representative").alias("a"), F.col("representative").alias("b")).distinct())
    best = links.join(firsts.withColumnRenamed("representative", "b"), "b").groupBy(F.col("a").alias("representative"), "entity_type").agg(F.min("first").alias("smallest"))
    rows = of.join(best, ["representative", "entity_type"]).where("smallest < id")
    return rows.select(F.lit("duplicate").alias("kind"), _no_id("page_id"), F.col("id").alias("entity_id"), F.col("smallest").cast("string").alias("detail"))


def lint(pages: DataFrame, entities: DataFrame, chunks: DataFrame, chunk_entities: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """All findings over published pages; duplicates are as alike as ``dedup_threshold``."""
    shown = pages.where("status = 'published'")
    links = stage(page_links(shown), "lint-links")
    out = orphan_pages(shown, links)
    for part in (missing_links(shown, links), stale_pages(shown, chunks, chunk_entities), duplicate_entities(entities, settings.dedup_threshold)):
        out = out.unionByName(part)
    return out
