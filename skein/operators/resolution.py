"""Chunks to graph: extraction answers, validation, set-oriented entity resolution, relation rows.

The reading of a text is a pluggable expression that returns a model's JSON answer; the default is a
deterministic offline reader. Resolution handles all mentions at once: equal mentions are grouped
first, so a word that fills a third of the corpus is one row before any vector is compared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from skein.config import DEFAULTS, Settings
from skein.functions import vectors as V
from skein.functions.text import lock_key, strip
from skein.operators.knn import nearest
from skein.session import stage

ANSWER_SCHEMA = (
    "entities array<struct<surface_form:string,canonical_name:string,entity_type:string,description:string>>, "
    "relations array<struct<source_idx:int,target_idx:int,relation_type:string>>"
)


def offline_reader(text: Column) -> Column:
    """Stand-in for a model: capitalised words are concepts, neighbours in order of first use are related."""
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{Lu}\p{Ll}+"), F.lit(0)))

    def answer(found: Column) -> Column:
        entities = F.transform(found, lambda w: F.struct(
            w.alias("surface_form"), w.alias("canonical_name"), F.lit("concept").alias("entity_type"),
            F.concat(F.lit("Named "), w).alias("description")))
        links = F.transform(F.slice(found, 2, 1 << 30), lambda _, i: F.struct(
            i.alias("source_idx"), (i + 1).alias("target_idx"), F.lit("next_to").alias("relation_type")))
        return F.to_json(F.struct(entities.alias("entities"), links.alias("relations")))

    # the lambda binds the words, so the text is scanned once
    return F.get(F.transform(F.array(words), answer), F.lit(0))


def extract(chunks: DataFrame, reader: Callable[[Column], Column] = offline_reader) -> DataFrame:
    """``(chunk_id, result, error)``: the parsed answer, or why the chunk failed. Failing rows stay rows."""
    text = F.col("text_content")
    read = chunks.select("chunk_id", text, F.when(text != "", reader(text)).alias("answer"))
    return parse_answers(read)


def parse_answers(read: DataFrame) -> DataFrame:
    read = read.withColumn("parsed", F.from_json("answer", ANSWER_SCHEMA))
    complete = (
        F.col("parsed.entities").isNotNull() & F.col("parsed.relations").isNotNull()
        & ~F.exists("parsed.entities", lambda e: e["surface_form"].isNull() | e["canonical_name"].isNull()
                    | e["entity_type"].isNull() | e["description"].isNull())
        & ~F.exists("parsed.relations", lambda r: r["source_idx"].isNull() | r["target_idx"].isNull()
                    | r["relation_type"].isNull())
    )
    error = (
        F.when(F.coalesce("text_content", F.lit("")) == "", "empty text")
        .when(F.col("answer").isNull(), "no tool call")
        .when(complete, F.lit(None).cast("string"))
        .when(F.try_parse_json("answer").isNull(), "invalid JSON")
        .otherwise("answer does not match the schema")
    )
    judged = read.select("chunk_id", "parsed", error.alias("error"))
    return judged.select("chunk_id", F.when(F.col("error").isNull(), F.col("parsed")).alias("result"), "error")


def candidates(extracted: DataFrame) -> DataFrame:
    """``(chunk_id, idx, canonical_name, entity_type, description)``."""
    return extracted.filter("error IS NULL").select("chunk_id", F.posexplode("result.entities").alias("idx", "e")).select(
        "chunk_id", "idx", "e.canonical_name", "e.entity_type", "e.description")


def named_relations(extracted: DataFrame) -> DataFrame:
    return extracted.filter("error IS NULL").select("chunk_id", F.posexplode("result.relations").alias("n", "r")).select(
        "chunk_id", "n", "r.source_idx", "r.target_idx", "r.relation_type")


def valid_decision(decision: Column, merged_into: Column) -> Column:
    """A merge needs a target, a new entity must not have one."""
    return F.coalesce(((decision == "merge") & merged_into.isNotNull()) | ((decision == "new") & merged_into.isNull()),
                      F.lit(False))


def candidate_line(rank: Column, ident: Column, name: Column) -> Column:
    return F.concat(rank.cast("string"), F.lit(". ID="), ident.cast("string"), F.lit(" name='"), name, F.lit("'"))


def similar_entities(mentions: DataFrame, entities: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Up to ``resolution_top_k`` entities within the L2 threshold of each mention ``(query_id, embedding)``."""
    return nearest(mentions, entities.select(F.col("entity_id").alias("base_id"), "embedding"),
                   settings.resolution_top_k, "l2", settings.resolution_distance, settings)


@dataclass
class Resolution:
    mentions: DataFrame  # name_key, entity_type -> entity_id, decision
    new_entities: DataFrame
    links: DataFrame
    relations: DataFrame
    errors: DataFrame
    merge_log: DataFrame


DECISION_SCHEMA = "decision string, merged_into_id bigint, reasoning string"


def decision_requests(mentions: DataFrame, near: DataFrame, entities: DataFrame) -> DataFrame:
    """``(id, text, offered)``: each mention that has similar entities, with them as numbered lines, ``resolution_top_k`` at most."""
    names = entities.select(F.col("entity_id").alias("base_id"), F.col("name").alias("_known"))
    lines = near.join(names, "base_id").groupBy(F.col("query_id").alias("mention_id")).agg(F.array_sort(F.collect_list(F.struct(
        "rank", "base_id", candidate_line(F.col("rank"), F.col("base_id"), F.col("_known")).alias("line")))).alias("_near"))
    listed = F.array_join(F.transform("_near", lambda r: r["line"]), "\n")
    return mentions.join(lines, "mention_id").select(
        F.col("mention_id").alias("id"),
        F.to_json(F.struct("name", "entity_type", "description", listed.alias("candidates"))).alias("text"),
        F.transform("_near", lambda r: r["base_id"]).alias("offered"))


def decisions(requests: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(mention_id, into_id, reason, error)``: what the model decided; a merge must be into an offered entity."""
    told = decide(requests.select("id", "text")).select("id", "answer", F.col("error").alias("_said"))
    told = requests.select("id", "offered").join(told, "id", "left").withColumn("d", F.from_json("answer", DECISION_SCHEMA))
    into = F.col("d.merged_into_id")
    fits = valid_decision(F.col("d.decision"), into) & (into.isNull() | F.array_contains("offered", into))
    error = F.when(F.col("answer").isNull(), F.coalesce("_said", F.lit("no merge decision"))).when(
        ~fits, "merge decision does not match the schema")
    return told.select(F.col("id").alias("mention_id"), F.when(error.isNull(), into).alias("into_id"),
                       F.col("d.reasoning").alias("reason"), error.alias("error"))


def resolve(found: DataFrame, relations: DataFrame, entities: DataFrame, settings: Settings = DEFAULTS,
            decide: Callable[[DataFrame], DataFrame] | None = None) -> Resolution:
    """Resolve all candidates against the graph and each other.

    A mention merges into the nearest similar entity of the same normalised name and type; other
    mentions become one new entity per (normalised name, type), with an id derived from both.
    With ``decide(id, text) -> (id, answer, error)`` a model chooses among the similar entities of each mention instead;
    a mention without a valid decision fails the chunks that hold it.
    """
    key = [strip(F.lower("canonical_name")).alias("name_key"), F.col("entity_type")]
    grouped = found.groupBy(*key).agg(
        F.min("canonical_name").alias("name"), F.min("description").alias("description"), F.min("chunk_id").alias("chunk_id"))
    mentions = stage(grouped.withColumns({
        "mention_id": lock_key(F.concat("name_key", F.lit("|"), "entity_type")),
        "embedding": V.hash_embedding(F.concat("name", F.lit(" "), "description"), settings.embedding_dimensions)}), "mentions")
    known = entities.select(F.col("entity_id").alias("base_id"), strip(F.lower("name")).alias("name_key"), "entity_type")
    if decide is None:
        # only a mention that shares its name and type with some entity can merge: the others need no search
        asking = stage(mentions.join(known, ["name_key", "entity_type"], "left_semi").select(F.col("mention_id").alias("query_id"), "embedding"), "asking")
        near = similar_entities(asking, entities, settings)
        target = (
            near.withColumnRenamed("query_id", "mention_id").join(known, "base_id")
            .join(mentions.select("mention_id", "name_key", "entity_type"), ["mention_id", "name_key", "entity_type"])
            .groupBy("mention_id").agg(F.min(F.struct("rank", "base_id"))["base_id"].alias("into_id"))
            .withColumns({"reason": F.lit("same name and type"), "error": F.lit(None).cast("string")})
        )
    else:
        near = similar_entities(mentions.select(F.col("mention_id").alias("query_id"), "embedding"), entities, settings)
        target = stage(decisions(stage(decision_requests(mentions, near, entities), "decision-requests"), decide), "decisions")
    decided = stage(mentions.join(target, "mention_id", "left").withColumns({
        "decision": F.when(F.col("into_id").isNotNull(), "merge").otherwise("new"),
        "entity_id": F.coalesce("into_id", "mention_id")}), "decided")
    placed = found.select("chunk_id", "idx", *key).join(
        decided.select("name_key", "entity_type", "entity_id", "error"), ["name_key", "entity_type"]).select("chunk_id", "idx", "entity_id", "error")
    placed = stage(placed, "placed")
    undecided = placed.filter("error IS NOT NULL").groupBy("chunk_id").agg(F.min("error").alias("error"))
    decided, placed = decided.filter("error IS NULL"), placed.filter("error IS NULL")

    def end(name: str) -> DataFrame:
        return placed.select("chunk_id", F.col("idx").alias(f"{name}_idx"), F.col("entity_id").alias(f"{name}_entity_id"))

    drawn = relations.join(end("source"), ["chunk_id", "source_idx"], "left").join(end("target"), ["chunk_id", "target_idx"], "left")
    broken = F.col("source_entity_id").isNull() | F.col("target_entity_id").isNull()
    unresolved = drawn.filter(broken).select("chunk_id", F.lit("relation references unresolved entity index").alias("error")).distinct()
    bad_chunks = unresolved if decide is None else unresolved.join(undecided, "chunk_id", "left_anti").unionByName(undecided)
    return Resolution(
        mentions=decided.select("name_key", "entity_type", "entity_id", "decision"),
        new_entities=decided.filter("decision = 'new'").select(
            "entity_id", "name", "entity_type", "description", "embedding", F.lit("published").alias("status")),
        links=placed.select("chunk_id", "entity_id").distinct(),
        # one bad index fails the chunk: none of its relations are written
        relations=drawn.join(bad_chunks, "chunk_id", "left_anti").select(
            "chunk_id", "n", "source_entity_id", "target_entity_id", "relation_type", F.lit("published").alias("status"),
            F.lit("INFERRED").alias("confidence_tag")),
        errors=bad_chunks,
        merge_log=decided.filter("decision = 'merge'").select(
            F.col("mention_id").alias("merged_from_id"), F.col("into_id").alias("merged_into_id"), "chunk_id",
            F.lit(None).cast("bigint").alias("job_id"), "reason"),
    )


def chunk_status(chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """Chunks with ``processed`` or ``failed``; one failing chunk leaves the others alone."""
    bad = errors.select("chunk_id").distinct().withColumn("_bad", F.lit(True))
    return chunks.join(bad, "chunk_id", "left").withColumn(
        "status", F.when(F.col("_bad"), "failed").otherwise("processed")).drop("_bad")


def source_status(chunks: DataFrame) -> DataFrame:
    """``(source_id, succeeded, failed, status)``: a source fails only if no chunk succeeded."""
    ok = F.count_if(F.col("status") == "processed")
    return chunks.groupBy("source_id").agg(ok.alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed")).withColumn(
        "status", F.when(F.col("succeeded") > 0, "processed").otherwise("failed"))


def synthesis_jobs(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """Fan-out after ingest: one job per (source, entity) and one summary job per source."""
    touched = links.join(chunks.select("chunk_id", "source_id"), "chunk_id").select("source_id", "entity_id").distinct()
    per_entity = touched.select(
        "source_id", F.lit("synthesize_entity").alias("job_type"), F.col("entity_id").alias("target_entity_id"),
        F.concat(F.lit('{"source_ids": ["'), F.col("source_id"), F.lit('"]}')).alias("payload"))
    per_source = chunks.select("source_id").distinct().select(
        "source_id", F.lit("synthesize_source_summary").alias("job_type"), F.lit(None).cast("bigint").alias("target_entity_id"),
        F.concat(F.lit('{"source_id": "'), F.col("source_id"), F.lit('"}')).alias("payload"))
    return per_entity.unionByName(per_source)
