"""Prompt texts for model calls as column expressions, one prompt in one cell of its row.

The wording is this library's own. Lists come in as array columns whose order is kept; nulls count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CURATOR = "You are a knowledge wiki curator."
RULES = (
    "1. **Chunks only.** State what the passages below say and nothing else.\n"
    "2. **No citation fabrication.** Cite a passage as [file:index] and only if it is listed.\n"
    "3. **Links.** Write [[slug]] for a known entity, never for any other.\n"
    "4. **Conflicts.** Where passages disagree, say so under Contradictions with both citations."
)
CLASSIFY = (
    "Name the kind of the question: factual_lookup, relationship_query, summarization or comparison. "
    'Answer with JSON only: {"type": ..., "confidence": 0 to 1, "rationale": ...}.'
)
EXTRACT = (
    "List the entities and relations that the passage states. Answer with JSON only: "
    '{"entities": [{"canonical_name": ..., "entity_type": ..., "description": ...}], '
    '"relations": [{"source": ..., "target": ..., "relation_type": ..., "confidence": 0 to 1}]}.'
)


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _listed(items: Column, line, empty: str) -> Column:
    lines = F.array_join(F.transform(items, line), "\n")
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, lines).otherwise(F.lit(empty))


def resolution_prompt(mention: Column, candidates: Column) -> Column:
    """Ask which of ``candidates array<struct<entity_id, name, entity_type, description>>`` the ``mention struct<name, entity_type, description>`` is."""
    each = lambda c: F.concat(F.lit("- id "), _text(c["entity_id"]), F.lit(": "), _text(c["name"]), F.lit(" ("), _text(c["entity_type"]), F.lit("): "), _text(c["description"]))
    return F.concat(F.lit("Is the mention one of the entities on the list?\n\nMention: "), _text(mention["name"]), F.lit(" ("), _text(mention["entity_type"]), F.lit("): "),
                    _text(mention["description"]), F.lit("\n\nEntities:\n"), _listed(candidates, each, "(none)"),
                    F.lit('\n\nAnswer with JSON only: {"decision": "merge" or "new", "entity_id": ... or null, "reason": ...}.'))


def entity_page_prompt(name: Column, entity_type: Column, description: Column, existing: Column, edges: Column, chunks: Column, known: Column) -> Column:
    """Ask for the page of an entity.

    ``edges array<struct<label, target_slug>>``, ``chunks array<struct<source_file, index, text>>``, ``known array<struct<slug, name>>``;
    ``existing`` is the page to update, or null for a new one.
    """
    task = F.when(existing.isNull(), "Your task is to create a new wiki page.").otherwise("Your task is to update an existing wiki page.")
    before = F.when(existing.isNull(), "").otherwise(F.concat(F.lit("\n\n## Page so far\n"), _text(existing)))
    return F.concat(
        F.lit(f"{CURATOR} "), task, F.lit(f"\n\n{RULES}\n\n# "), _text(name), F.lit("\nType: "), _text(entity_type), F.lit("\nDescription: "), _text(description), before,
        F.lit("\n\n## Relationships\n"), _listed(edges, lambda e: F.concat(F.lit("- "), _text(e["label"]), F.lit(": [["), _text(e["target_slug"]), F.lit("]]")), "(none)"),
        F.lit("\n\n## Passages\n"), _listed(chunks, lambda c: F.concat(F.lit("["), _text(c["source_file"]), F.lit(":"), _text(c["index"]), F.lit("] "), _text(c["text"])), "(none)"),
        F.lit("\n\n## Known entities\n"), _listed(known, lambda k: F.concat(F.lit("- [["), _text(k["slug"]), F.lit("]] "), _text(k["name"])), "(none)"))


def source_page_prompt(file_name: Column, ingested_at: Column, chunks: Column, touched: Column, relations: Column) -> Column:
    """Ask for the summary page of a source: ``chunks array<struct<index, text>>``, ``touched array<struct<slug, name>>``,
    ``relations array<struct<source_slug, label, target_slug>>``."""
    return F.concat(
        F.lit(f"{CURATOR} Your task is to summarise one source.\n\n{RULES}\n\n# "), _text(file_name), F.lit("\nIngested: "), _text(ingested_at),
        F.lit("\nPassages: "), F.coalesce(F.size(chunks), F.lit(0)).cast("string"), F.lit("\n\n## Text\n"),
        _listed(chunks, lambda c: F.concat(F.lit("["), _text(c["index"]), F.lit("] "), _text(c["text"])), "(none)"),
        F.lit("\n\n## Entities of this source\n"), _listed(touched, lambda k: F.concat(F.lit("- [["), _text(k["slug"]), F.lit("]] "), _text(k["name"])), "(none)"),
        F.lit("\n\n## Relations of this source\n"),
        _listed(relations, lambda r: F.concat(F.lit("- [["), _text(r["source_slug"]), F.lit("]] "), _text(r["label"]), F.lit(" [["), _text(r["target_slug"]), F.lit("]]")), "(none)"))
