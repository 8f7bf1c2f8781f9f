"""Ingest plans per source and query plans per question, as column rules."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, functions as F

from skein.config import DEFAULTS, Settings
from skein.functions.text import json_payload, strip

# Keyword rules in order, their confidence, and what each question type asks of retrieval.
KEYWORD_RULES = [
    (r"(?i)\b(what is|define|who is)", "factual_lookup"),
    (r"(?i)\b(how\b.*\brelate|connect|relationship)", "relationship_query"),
    (r"(?i)\b(summar|overview|give me an overview)", "summarization"),
    (r"(?i)\b(compare|difference|versus|vs)", "comparison"),
]
RULE_CONFIDENCE = 0.9
DEFAULT_CONFIDENCE = 0.3
RETRIEVAL_DEPTH = {
    "factual_lookup": ("shallow", 1, "top-3 seeds found"),
    "relationship_query": ("deep", 2, "graph depth 2 reached"),
    "summarization": ("deep", 5, "top-10 chunks aggregated"),
    "comparison": ("shallow", 0, "all entities resolved"),
}
# MIME types by file extension (the standard table, with those it lacks), and parser and structure by MIME type
# or parser name.
MIME_BY_EXTENSION = {e.lstrip("."): kind for e, kind in mimetypes.MimeTypes().types_map[True].items()} | {
    "md": "text/markdown", "markdown": "text/markdown", "csv": "text/csv",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
PARSER_BY_MIME = {"application/pdf": "pdf", "text/plain": "simple", "text/markdown": "simple"}
STRUCTURE_BY_MIME = {"application/pdf": "structured", "text/plain": "semi-structured", "text/markdown": "semi-structured"}
STRUCTURE_BY_PARSER = {"pdf": "structured", "simple": "semi-structured", "unstructured": "unstructured",
                       "mineru": "structured"}


def lookup(key: Column, table: dict[str, str], default: str | None) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def plan_sources(sources: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``sources(source_id, file_name, storage_key, file_size, metadata)`` with its parsing plan.

    A string ``parser`` in the metadata overrides the MIME rule; an unknown parser
    name stays in the plan, and its source fails when it is parsed.
    """
    override = F.get_json_object("metadata", "$.parser")
    path = F.coalesce("file_name", "storage_key")
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))
    mime = lookup(extension, MIME_BY_EXTENSION, "application/octet-stream")
    given_parser = F.when(override == "ocr", "pdf").otherwise(override)
    by_mime = lookup(mime, PARSER_BY_MIME, "unstructured")
    has = override.isNotNull()
    parser = F.when(has, given_parser).otherwise(by_mime)
    structure = F.when(has, lookup(given_parser, STRUCTURE_BY_PARSER, "unstructured")).otherwise(
        lookup(mime, STRUCTURE_BY_MIME, "unstructured"))
    density = F.when(F.col("file_size") >= settings.planner_large_file_bytes, "large").otherwise("small")
    return sources.select(
        "source_id",
        F.when(has, F.when(override == "ocr", "pdf").otherwise(given_parser)).otherwise(mime).alias("detected_type"),
        structure.alias("detected_structure"), parser.alias("selected_parser"),
        F.when(has, F.when(override == "ocr", "with_ocr")).otherwise(F.when(by_mime == "pdf", "standard")).alias("pdf_mode"),
        F.lit("section").alias("chunking_strategy"), F.lit(1.0).alias("confidence"), F.lit("simple").alias("fallback_parser"),
        F.when(has, F.concat(F.lit("explicit override in metadata: "), override)).otherwise(F.concat(
            F.lit("mime="), mime, F.lit(" structure="), structure, F.lit(" density="), density)).alias("rationale"),
        F.lit(settings.planner_version).alias("planner_version"),
    )


def _by_rules(text: Column) -> Column:
    expr = F.struct(F.lit("factual_lookup").alias("type"), F.lit(DEFAULT_CONFIDENCE).alias("confidence"),
                    F.lit("no keyword match, defaulting to factual_lookup").alias("rationale"), F.lit("rule").alias("source"))
    for pattern, kind in reversed(KEYWORD_RULES):
        expr = F.when(F.regexp_like(text, F.lit(pattern)), F.struct(
            F.lit(kind).alias("type"), F.lit(RULE_CONFIDENCE).alias("confidence"),
            F.lit(f"keyword match: {pattern}").alias("rationale"), F.lit("rule").alias("source"))).otherwise(expr)
    return expr


def question_key(text: Column) -> Column:
    """Questions that differ in case or outer blanks share one classification."""
    return strip(F.lower(text))


def classify(questions: DataFrame, answers: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Query plans for ``questions(query_id, text[, query_type])``.

    Order: given type, a model's answer ``answers(question_key, answer)`` if it parses, keyword rules.
    ``rejected`` marks plans below the least confidence (given types are never rejected).
    """
    q = questions.withColumn("question_key", question_key(F.col("text")))
    given = F.col("query_type") if "query_type" in questions.columns else F.lit(None).cast("string")
    explicit = F.when(given.isNotNull(), F.struct(
        given.alias("type"), F.lit(1.0).alias("confidence"),
        F.concat(F.lit("explicit type override: "), given).alias("rationale"), F.lit("explicit").alias("source")))
    choice = [explicit]
    if answers is not None:
        parsed = F.from_json(json_payload(F.col("answer")), "type string, confidence double, rationale string")
        valid = parsed["type"].isin(*RETRIEVAL_DEPTH) & parsed["confidence"].isNotNull()
        told = answers.groupBy("question_key").agg(F.min("answer").alias("answer")).select(
            "question_key", F.when(valid, F.struct(
                parsed["type"].alias("type"), parsed["confidence"].alias("confidence"),
                F.coalesce(parsed["rationale"], F.lit("")).alias("rationale"), F.lit("llm").alias("source"))).alias("told"))
        q = q.join(told, "question_key", "left")
        choice.append(F.col("told"))
    chosen = q.withColumn("c", F.coalesce(*choice, _by_rules(F.col("text"))))
    kind, confidence = F.col("c.type"), F.col("c.confidence")
    middle = (confidence >= settings.planner_confidence_low) & (confidence < settings.planner_confidence_high)
    seeds = lookup(kind, {k: str(v[1]) for k, v in RETRIEVAL_DEPTH.items()}, None).cast("int")
    return chosen.select(
        "query_id", F.col("text").alias("raw_query"), kind.alias("classified_type"),
        F.when(middle, "deep").otherwise(lookup(kind, {k: v[0] for k, v in RETRIEVAL_DEPTH.items()}, None)).alias("retrieval_depth"),
        F.when(middle, F.greatest(seeds, F.lit(3))).otherwise(seeds).alias("seed_count"),
        F.when(middle, F.concat(F.lit("escalated: mid-confidence "), confidence.cast("string"))).otherwise(
            lookup(kind, {k: v[2] for k, v in RETRIEVAL_DEPTH.items()}, None)).alias("termination_condition"),
        confidence.alias("confidence"), F.col("c.source").alias("classification_source"),
        F.col("c.rationale").alias("rationale"), F.lit(settings.planner_version).alias("planner_version"),
        ((confidence < settings.planner_confidence_minimum) & given_is_null(questions)).alias("rejected"),
    )


def given_is_null(questions: DataFrame) -> Column:
    return F.col("query_type").isNull() if "query_type" in questions.columns else F.lit(True)
