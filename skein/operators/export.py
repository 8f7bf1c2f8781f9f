"""Rendering of the export bundle and the difference to the previous export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skein.functions import text as T
from skein.operators.wiki import iso

LINK = r"(?<!`)\[\[([^\]]+)\]\]"


def published(pages: DataFrame) -> DataFrame:
    return pages.filter("status = 'published'")


def slug_names(pages: DataFrame, entities: DataFrame, sources: DataFrame) -> DataFrame:
    """``(slug, display)``: entity name, else the first source's file name, else the slug itself."""
    first = F.try_element_at("synthesized_from_sources", F.lit(1))
    named = entities.select("entity_id", F.col("name").alias("_name"))
    files = sources.select(F.col("source_id").cast("string").alias("_source"), F.col("file_name").alias("_file"))
    rows = published(pages).select("slug", "entity_id", first.alias("_first"))
    return rows.join(named, "entity_id", "left").join(files, F.col("_first") == F.col("_source"), "left").select(
        "slug", F.coalesce("_name", "_file", "slug").alias("display"))


def rewrite_links(pages: DataFrame, names: DataFrame) -> DataFrame:
    """``(page_id, body)``: every ``[[slug]]`` outside inline code becomes a Markdown link.

    Only the links of a page travel to the names, not the names to the pages.
    """
    found = pages.select("page_id", F.explode(F.array_distinct(
        F.regexp_extract_all("content", F.lit(LINK), F.lit(1)))).alias("slug"))
    labels = found.join(names, "slug").groupBy("page_id").agg(
        F.map_from_entries(F.collect_list(F.struct("slug", "display"))).alias("labels"))
    parts = F.split("content", LINK)
    slugs = F.regexp_extract_all("content", F.lit(LINK), F.lit(1))

    def link(slug: Column) -> Column:
        label = F.coalesce(F.try_element_at("labels", slug), slug)
        return F.concat(F.lit("["), label, F.lit("](../entities/"), slug, F.lit(".md)"))

    woven = F.zip_with(parts, slugs, lambda p, s: F.concat(p, F.coalesce(link(s), F.lit(""))))
    return pages.join(labels, "page_id", "left").select("page_id", F.array_join(woven, "").alias("body"))


def page_kind(entity_id: Column) -> Column:
    return F.when(entity_id.isNotNull(), "entity").otherwise("source_summary")


def page_path(slug: Column, kind: Column) -> Column:
    return F.concat(F.when(kind == "entity", "entities/").otherwise("sources/"), slug, F.lit(".md"))


def described(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """Published pages with entity type, description, kind and bundle path."""
    known = entities.select("entity_id", F.col("entity_type").alias("_type"), F.col("description").alias("_about"), F.lit(True).alias("_known"))
    kind = page_kind(F.col("entity_id"))
    return published(pages).join(known, "entity_id", "left").withColumns({
        "page_kind": kind, "path": page_path(F.col("slug"), kind),
        "description": F.when(F.col("_known"), F.coalesce("_about", F.lit(""))).otherwise(T.excerpt(F.col("content")))})


def front_matter(described_pages: DataFrame, api_base_url: str, source_summary_type: str = "source-summary") -> Column:
    """YAML block of six fields; fields without a value are left out."""
    base = F.lit(api_base_url.rstrip("/"))
    known = F.col("_known").isNotNull()
    kind = F.when(known, "entity").otherwise("source_summary")
    first = F.try_element_at("synthesized_from_sources", F.lit(1))
    resource = F.when(known, F.concat(base, F.lit("/entities/"), F.col("entity_id").cast("string"))).otherwise(
        F.concat(base, F.lit("/sources/"), first))
    type_name = F.when(known, F.coalesce(F.when(F.col("_type") != "", F.col("_type")), F.lit("unknown"))).otherwise(
        F.lit(source_summary_type))

    def optional(key: str, value: Column) -> Column:
        return F.when(value != "", T.yaml_field(key, value))

    return F.concat_ws(
        "\n", F.lit("---"), T.yaml_field("type", type_name), T.yaml_field("title", F.col("title")),
        optional("description", F.col("description")), optional("timestamp", iso(F.col("synthesized_at"))),
        T.yaml_field("page_kind", kind), optional("resource", resource), F.lit("---"))


def render(pages: DataFrame, entities: DataFrame, sources: DataFrame, api_base_url: str) -> DataFrame:
    """``(page_id, path, title, rendered, content_hash)`` of every published page."""
    base = described(pages, entities)
    heads = base.select("page_id", "path", "title", front_matter(base, api_base_url).alias("head"))
    bodies = rewrite_links(published(pages), slug_names(pages, entities, sources))
    return heads.join(bodies, "page_id").withColumn(
        "rendered", F.concat("head", F.lit("\n\n"), "body", F.lit("\n"))).select(
        "page_id", "path", "title", "rendered", F.sha2(F.col("rendered").cast("binary"), 256).alias("content_hash"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer join of manifests ``(path, content_hash)``: ``(path, action, content_hash)``."""
    o = old.select("path", F.col("content_hash").alias("_old"))
    both = o.join(new.select("path", "content_hash"), "path", "full_outer")
    action = (
        F.when(F.col("_old").isNull(), "added").when(F.col("content_hash").isNull(), "removed")
        .when(F.col("_old") != F.col("content_hash"), "modified").otherwise("unchanged"))
    return both.select("path", action.alias("action"), "content_hash")


def log_entries(diff: DataFrame, titles: DataFrame) -> DataFrame:
    """Change-log lines; removed pages are titled by their file stem."""
    stem = F.regexp_extract("path", r"([^/]+)\.md\z", 1)
    told = diff.filter("action <> 'unchanged'").join(titles.select("path", "title"), "path", "left")
    title = F.when(F.col("action") == "removed", stem).otherwise(F.col("title"))
    return told.select("path", "action", F.concat(
        F.lit("- **"), F.col("action"), F.lit("** `"), F.col("path"), F.lit("` — "), title).alias("entry"))


def index_lines(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """Bullets of the three index files as ordered rows ``(index_file, section, slug, line)``; order by section, slug."""
    base = described(pages, entities)
    about = F.when(F.col("description") != "", F.concat(F.lit(" — "), F.col("description"))).otherwise(F.lit(""))
    entity = F.col("page_kind") == "entity"
    section = F.when(entity, 1).otherwise(2)

    def bullet(target: Column) -> Column:
        return F.concat(F.lit("- ["), F.col("title"), F.lit("]("), target, F.lit(")"), about)

    files = F.array(
        F.struct(F.lit("index.md").alias("index_file"), bullet(F.col("path")).alias("line")),
        F.struct(F.when(entity, "entities/index.md").otherwise("sources/index.md").alias("index_file"),
                 bullet(F.concat("slug", F.lit(".md"))).alias("line")))
    return base.select(section.alias("section"), "slug", F.explode(files).alias("f")).select(
        "f.index_file", "section", "slug", "f.line")
