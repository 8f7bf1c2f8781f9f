"""Sources to graph in one operator: chunks, vectors, answers, resolution, states, and the jobs that follow."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from skein.config import DEFAULTS, Settings
from skein.operators import resolution as X
from skein.operators.chunking import chunk_documents
from skein.session import stage

Answering = Callable[[DataFrame], DataFrame]  # requests(id, text) -> (id, text, answer, error)


@dataclass
class Models:
    """What an ingest asks of models; ``AnswerMemo.ask`` makes one of these from a model and a memo."""

    embed: Answering  # answers are vectors
    read: Answering  # answers are JSON of ``ANSWER_SCHEMA``
    decide: Answering | None = None  # answers are JSON decisions; without one, equal name and type merge


@dataclass
class Ingest:
    chunks: DataFrame  # chunk_id, source_id, chunk_index, text_content, section_heading, embedding, status
    sources: DataFrame  # source_id, succeeded, failed, status
    entities: DataFrame
    links: DataFrame
    relations: DataFrame
    merge_log: DataFrame
    errors: DataFrame  # chunk_id, error
    jobs: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        """By name, as ``RunStore.save`` commits them together."""
        return dict(vars(self))


def ingest(sources: DataFrame, entities: DataFrame, models: Models, chunk_id: Callable[[Column, Column], Column],
           markdown: Column | None = None, settings: Settings = DEFAULTS) -> Ingest:
    """Ingest ``sources(source_id, text)`` into the graph of ``entities``.

    ``chunk_id`` makes an id from source id and chunk number. A chunk fails if it has no vector, no valid answer or a broken relation
    or decision; its links and relations are not written and the other chunks go on. A source fails if no chunk of it
    succeeded, so one without text fails too, and no jobs follow it. Source ids are taken to be unique and not null.
    """
    kept = sources.select("source_id", "text", *([markdown.alias("_markdown")] if markdown is not None else []))
    cut = chunk_documents(kept, "source_id", markdown=None if markdown is None else F.col("_markdown"), settings=settings)
    chunks = stage(cut.withColumn("chunk_id", chunk_id(F.col("source_id"), F.col("chunk_index"))), "ingest-chunks")
    asked = chunks.select(F.col("chunk_id").alias("id"), F.col("text_content").alias("text"))
    vectors = stage(models.embed(asked).select(F.col("id").alias("chunk_id"), F.col("answer").alias("embedding"), "error"), "ingest-vectors")
    read = stage(models.read(asked), "ingest-answers")
    parsed = stage(X.parse_answers(read.select(F.col("id").alias("chunk_id"), F.col("text").alias("text_content"), "answer")), "ingest-parsed")
    no_vector = vectors.filter("embedding IS NULL").select("chunk_id", F.concat(F.lit("no vector: "), F.coalesce("error", F.lit(""))).alias("error"))
    # where the model said why it gave no answer, that is the reason
    said = read.filter("answer IS NULL").select(F.col("id").alias("chunk_id"), F.col("error").alias("_said"))
    unread = parsed.filter("error IS NOT NULL").join(said, "chunk_id", "left").select("chunk_id", F.coalesce("_said", "error").alias("error"))
    broken = stage(no_vector.unionByName(unread), "ingest-broken")
    whole = parsed.join(broken.select("chunk_id"), "chunk_id", "left_anti")
    found = X.resolve(X.candidates(whole), X.named_relations(whole), entities, settings, models.decide)
    errors = stage(broken.unionByName(found.errors), "ingest-errors")

    def good(rows: DataFrame) -> DataFrame:
        return rows.join(found.errors.select("chunk_id").distinct(), "chunk_id", "left_anti")

    done = stage(X.chunk_status(chunks, errors), "ingest-status")
    states = sources.select("source_id").join(X.source_status(done), "source_id", "left").select(
        "source_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("succeeded", "failed")], F.coalesce("status", F.lit("failed")).alias("status"))
    links = good(found.links)
    followed = chunks.select("chunk_id", "source_id").join(states.filter("status = 'processed'").select("source_id"), "source_id", "left_semi")
    return Ingest(
        chunks=done.join(vectors.select("chunk_id", "embedding"), "chunk_id", "left"), sources=states,
        # an entity that only failed chunks name is not added
        entities=found.new_entities.join(links.select("entity_id").distinct(), "entity_id", "left_semi"),
        links=links, relations=good(found.relations), merge_log=found.merge_log, errors=errors, jobs=X.synthesis_jobs(followed, links))
