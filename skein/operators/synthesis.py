"""Entity synthesis as one operator: pending jobs folded, contexts built, pages written and upserted, backlinks made, jobs closed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from skein.config import DEFAULTS, Settings
from skein.operators import merge, queue as Q, wiki as W
from skein.session import stage


@dataclass
class Synthesis:
    pages: DataFrame  # the next snapshot of pages
    backlinks: DataFrame  # page_id, entity_id of the pages written
    jobs: DataFrame  # the next snapshot of jobs, with error_message and completed_at
    written: DataFrame  # entity_id, title, slug, content, synthesized_from_sources

    def tables(self) -> dict[str, DataFrame]:
        return dict(vars(self))


def synthesize(jobs: DataFrame, entities: DataFrame, relations: DataFrame, chunks: DataFrame, links: DataFrame, sources: DataFrame,
               pages: DataFrame, page_id: Callable[[Column], Column], now: Column,
               write: Callable[[DataFrame], DataFrame] | None = None, settings: Settings = DEFAULTS) -> Synthesis:
    """Work off every pending entity job of ``jobs``.

    All jobs of an entity are one page over the union of their sources; the first is its head, the others are completed with no work.
    ``write(id, text) -> (id, answer, error)`` turns the drawn-up page into the final one, by default it stays as drawn up. Where that
    fails, or the entity does not exist, the head counts one more attempt and the page stays as it was. ``pages`` holds at
    most one page per entity; ``page_id`` makes the id of a new one from the entity's id.
    """
    due = stage(Q.coalesce_entity_jobs(jobs).filter("target_entity_id IS NOT NULL").select(
        F.col("target_entity_id").alias("entity_id"), F.col("source_id").try_cast("bigint").alias("source_id")).distinct(), "synthesis-due")
    context = W.entity_context(due, entities, relations, chunks, links, sources, pages, settings)
    drawn = stage(W.render_entity_pages(context, entities, chunks), "synthesis-drawn")
    told = drawn.withColumn("error", F.lit(None).cast("string"))
    if write is not None:
        answers = write(drawn.select(F.col("entity_id").alias("id"), F.col("content").alias("text"))).select(
            F.col("id").alias("entity_id"), F.col("answer").alias("_answer"), "error")
        told = stage(drawn.join(answers, "entity_id", "left").withColumn("content", F.col("_answer")).drop("_answer"), "synthesis-told")
    written = told.filter("error IS NULL AND content IS NOT NULL").drop("error")
    lost = due.select("entity_id").distinct().join(told.select("entity_id", "content", "error", F.lit(True).alias("_found")), "entity_id", "left")
    errors = stage(lost.select("entity_id", F.when(F.col("_found").isNull(), "entity not found").when(
        F.col("content").isNull() | F.col("error").isNotNull(), F.coalesce("error", F.lit("no page"))).alias("_error")), "synthesis-errors")

    made = written.withColumns({"page_id": page_id(F.col("entity_id")), "status": F.lit("published"), "synthesized_at": now})
    fresh = [c for c in ("content", "synthesized_from_sources", "synthesized_at") if c in pages.columns]
    after = stage(merge.upsert(pages, made, "entity_id", fresh), "synthesis-pages")
    return Synthesis(
        pages=after, written=written, jobs=_closed(jobs, errors, now),
        backlinks=W.page_backlinks(after.join(written.select("entity_id"), "entity_id", "left_semi"), relations, entities))


def _closed(jobs: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    """Heads end as their entity did, other pending jobs of the entity are completed; a job without entity fails like a head."""
    told = Q.after_coalescing(jobs, now).join(errors.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id", "left")
    mine = (F.col("job_type") == "synthesize_entity") & (F.col("status") == "pending")
    told = told.withColumn("_error", F.when(F.col("target_entity_id").isNull(), "no target entity").otherwise(F.col("_error")))
    told = told.withColumn("_way", F.when(~F.coalesce(mine, F.lit(False)), "other").when(F.col("_error").isNull(), "done").otherwise("failed"))
    parts = [told.filter("_way = 'other'"), Q.complete(told.filter("_way = 'done'"), now),
             Q.fail(told.filter("_way = 'failed'"), F.col("_error"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.drop("_error", "_way")
