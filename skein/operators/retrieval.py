"""Question to context for a whole table of questions in one job.

Vector seeds, bounded graph walk, token-budgeted slots (anchors, edges, wiki page, seed chunks, hop
chunks). Results are long tables keyed by ``query_id`` plus one summary row per question, so no list
that can grow with the graph is ever packed into a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from skein.config import DEFAULTS, Settings
from skein.functions import text as T, vectors as V
from skein.operators import graph
from skein.operators.contexts import choose_chunks
from skein.operators.dedup import collapse_copies, greedy_dedup, greedy_groups
from skein.operators.knn import nearest
from skein.operators.planning import classify
from skein.operators.ranking import budget_prefix, keep_one
from skein.session import stage

# Fixed value: the instruction that closes every context; only its token cost enters the budget.
INSTRUCTION = (
    "Use the provided context — including entity metadata, graph relations, "
    "wiki pages, and source chunks — to answer the user's question accurately."
)
INSTRUCTION_TOKENS = max(1, len(INSTRUCTION) // DEFAULTS.chars_per_token)


@dataclass
class Graph:
    """The snapshot tables a retrieval reads."""

    entities: DataFrame
    relations: DataFrame
    chunks: DataFrame
    chunk_entities: DataFrame
    pages: DataFrame
    sources: DataFrame


@dataclass
class Retrieval:
    """Results, all keyed by ``query_id``."""

    seeds: DataFrame
    nodes: DataFrame
    edges: DataFrame
    wiki: DataFrame
    chunks: DataFrame
    summary: DataFrame


def _tokens(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / DEFAULTS.chars_per_token)).cast("bigint")


def _joined_chars(length: Column) -> Column:
    """Characters of the rows' texts joined by newlines."""
    return F.sum(length) + F.count(F.lit(1)) - 1


def find_seeds(questions: DataFrame, entities: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Nearest entities per question: ``(query_id, rank, entity_id, score, seed_quality)``; score is a distance."""
    base = entities.select(F.col("entity_id").alias("base_id"), "embedding")
    found = nearest(questions.select("query_id", "embedding"), base, settings.seed_count, "cosine", settings=settings)
    return found.select("query_id", "rank", F.col("base_id").alias("entity_id"), F.col("distance").alias("score"),
                        V.seed_quality(F.col("distance")).alias("seed_quality"))


def seeds_by_id(wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """Given seeds ``(query_id, rank, entity_id)``: score 1, quality high; unknown ids drop out."""
    known = entities.select("entity_id")
    return wanted.join(known, "entity_id", "left_semi").select(
        "query_id", "rank", "entity_id", F.lit(1.0).alias("score"), F.lit("high").alias("seed_quality"))


def anchor_rows(seeds: DataFrame, data: Graph) -> DataFrame:
    """Seeds with their structural anchor and its context line; only relations that touch a seed are read."""
    ids = seeds.select("entity_id").distinct()
    entities = data.entities.join(ids, "entity_id", "left_semi")
    touching = graph.adjacency(data.relations).join(ids, F.col("node") == F.col("entity_id"), "left_semi")
    pairs = touching.groupBy("node", "nbr").agg(F.count(F.lit(1)).alias("n"))
    types = data.entities.select(F.col("entity_id").alias("nbr"), F.col("entity_type").alias("nbr_type"))
    per_type = pairs.join(types, "nbr", "left").groupBy("node", "nbr_type").agg(F.sum("n").alias("n"))
    part = F.when(F.col("nbr_type").isNotNull(), F.struct(
        (-F.col("n")).alias("o"), F.col("nbr_type").alias("t"),
        F.concat(F.col("n").cast("string"), F.lit(" "), T.title_case(F.col("nbr_type"))).alias("s")))
    told = per_type.groupBy("node").agg(
        F.sum("n").alias("degree"),
        F.concat(F.lit("Connected to "), F.array_join(
            F.transform(F.array_sort(F.collect_list(part)), lambda p: p["s"]), ", ")).alias("relation_summary"))
    degree = F.coalesce("degree", F.lit(0)).cast("bigint")
    anchored = entities.join(told, F.col("entity_id") == F.col("node"), "left").select(
        "entity_id", "name", "entity_type", F.coalesce("description", F.lit("")).alias("description"),
        degree.alias("degree"), V.relative_centrality(degree).alias("relative_centrality"),
        F.coalesce("relation_summary", F.lit("No relations")).alias("relation_summary"))
    line = F.concat(
        F.lit("- "), F.col("name"), F.lit(" ("), F.col("entity_type"), F.lit("): "), F.col("description"),
        F.lit(" | degree="), F.col("degree").cast("string"), F.lit(" centrality="), F.col("relative_centrality"),
        F.lit(" | "), F.col("relation_summary"))
    return seeds.join(anchored, "entity_id").withColumn("line", line)


def edge_rows(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with names and types on both ends and their context line."""
    def named(end: str) -> DataFrame:
        return entities.select(F.col("entity_id").alias(f"{end}_entity_id"), F.col("name").alias(f"{end}_name"),
                               F.col("entity_type").alias(f"{end}_type"))

    unknown = F.lit("?")
    out = edges.join(named("source"), "source_entity_id", "left").join(named("target"), "target_entity_id", "left")
    out = out.withColumns({c: F.coalesce(c, unknown) for c in ("source_name", "source_type", "target_name", "target_type")})
    return out.withColumn("line", F.concat(
        F.lit("["), F.col("source_name"), F.lit("] --"), F.col("relation_type"), F.lit("--> ["), F.col("target_name"),
        F.lit("] (hop "), F.col("hop").cast("string"), F.lit(")")))


def wiki_slot(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Pages cut to the wiki budget, whole sections by priority, inside the row of the page.

    ``(entity_id, content, original_tokens, sections_included, sections_dropped, was_truncated, source_count)``
    """
    tagged = F.transform(
        T.wiki_sections(F.col("content")),
        lambda s, i: F.struct(
            F.when(F.col("entity_id").isNotNull(), T.section_priority(s["tag"]))
            .otherwise(T.section_priority(s["tag"], T.SOURCE_SECTION_ORDER)).alias("prio"),
            i.alias("pos"), s["tag"].alias("tag"), s["text"].alias("text"),
            T.estimate_tokens(s["text"]).alias("cost")))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("spent"), F.lit(True).alias("open"))

    def step(acc: Column, s: Column) -> Column:
        fits = acc["open"] & (acc["spent"] + s["cost"] <= settings.wiki_page_budget_tokens)
        return F.struct((acc["n"] + fits.cast("int")).alias("n"),
                        F.when(fits, acc["spent"] + s["cost"]).otherwise(acc["spent"]).alias("spent"), fits.alias("open"))

    def tags(keep: Column) -> Column:
        return F.array_join(F.transform(keep, lambda s: s["tag"]), ",")

    cut = pages.withColumn("sections", F.array_sort(tagged)).withColumn(
        "n", F.aggregate("sections", zero, step, lambda acc: acc["n"])).withColumn(
        "chosen", F.transform(F.slice("sections", F.lit(1), F.col("n")), lambda s: s["text"]))
    inside = F.filter("sections", lambda s: F.array_contains(F.col("chosen"), s["text"]))
    outside = F.filter("sections", lambda s: ~F.array_contains(F.col("chosen"), s["text"]))
    return cut.select(
        "page_id", "entity_id", F.array_join("chosen", "\n\n").alias("content"),
        T.estimate_tokens(F.col("content")).alias("original_tokens"),
        tags(inside).alias("sections_included"), tags(outside).alias("sections_dropped"),
        (F.col("n") < F.size("sections")).alias("was_truncated"),
        F.coalesce(F.size("synthesized_from_sources"), F.lit(0)).alias("source_count"))


def chunk_vectors(chunks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(chunk_id, embedding)``; a chunk without a vector but with text is embedded on the fly."""
    text = F.coalesce("text_content", F.lit(""))
    made = F.when(text != "", V.hash_embedding(text, settings.embedding_dimensions))
    return chunks.select("chunk_id", F.coalesce("embedding", made).alias("embedding")).filter(F.col("embedding").isNotNull())


def distinct_vectors(pairs: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``pairs(query_id, chunk_id, tier, ...)`` reduced to the first chunk per distinct vector, plus ``cost``.

    Copies score the same and all but the first are duplicates, so they leave before vectors move.
    """
    cost = chunks.select("chunk_id", T.estimate_tokens(F.coalesce("text_content", F.lit(""))).alias("cost"))
    keys = chunk_vectors(chunks, settings).select(
        "chunk_id", F.struct(F.xxhash64("embedding"), F.xxhash64(F.reverse("embedding"))).alias("copy_key"), V.is_zero(F.col("embedding")).alias("is_zero"))
    keyed = pairs.join(keys.join(cost, "chunk_id"), "chunk_id")
    return collapse_copies(keyed, ["query_id"], "copy_key", "is_zero", ["tier", "chunk_id"]).drop("copy_key", "is_zero")


def score_chunks(pairs: DataFrame, vectors: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS, keep_as: str | None = None) -> DataFrame:
    """Cosine of ``pairs(query_id, chunk_id, ...)`` against ``vectors(query_id, embedding)``.

    Vectors of another length are skipped. Adds ``similarity`` and the sort key ``neg_sim``; ``keep_as`` names a column for the chunk's vector.
    """
    own = chunk_vectors(chunks, settings).withColumnRenamed("embedding", "_vec")
    asked = vectors.select("query_id", F.col("embedding").alias("_query"))
    both = pairs.join(own, "chunk_id").join(asked, "query_id").filter(F.size("_vec") == F.size("_query"))
    both = both.withColumn("similarity", V.cosine_batch("_query", "_vec")).drop("_query").withColumn("neg_sim", -F.round("similarity", 6))
    return both.withColumnRenamed("_vec", keep_as) if keep_as else both.drop("_vec")


def _kept_chunks(pairs: DataFrame, passes: DataFrame, chunks: DataFrame, settings: Settings) -> DataFrame:
    """``pairs`` scored and without near duplicates. A question's rows take their vectors along to the greedy choice, unless they exceed a block."""
    keys, order = ["query_id"], ["tier", "neg_sim", "chunk_id"]
    pairs = stage(distinct_vectors(pairs, chunks, settings), "distinct")
    largest = pairs.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    repeated = not chunks.groupBy("chunk_id").count().where("count > 1").isEmpty()
    if repeated or largest > settings.dedup_block_rows:
        scored = stage(score_chunks(pairs, passes, chunks, settings), "scored")
        return greedy_dedup(scored, keys, order, "chunk_id", chunk_vectors(chunks, settings), settings)
    scored = score_chunks(pairs, passes, chunks, settings, "embedding")
    return greedy_groups(scored, keys, order, settings).drop("embedding")


def node_members(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(query_id, entity_id, tier, hop)`` of seeds and nodes."""
    return seeds.select("query_id", "entity_id", F.lit(0).alias("tier"), F.lit(0).alias("hop")).unionByName(
        nodes.select("query_id", "entity_id", F.lit(1).alias("tier"), "hop"))


def linked_chunks(seeds: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Chunks of the nodes of each question, once each: ``(query_id, chunk_id, tier, entity_id, hop)``.

    A chunk linked to a seed belongs to tier 0; ties go to the least entity id. Aggregated map-side.
    """
    best = node_members(seeds, nodes).join(links, "entity_id").groupBy("query_id", "chunk_id").agg(
        F.min(F.struct("tier", "entity_id", "hop")).alias("m"))
    return best.select("query_id", "chunk_id", "m.*")


def repeated_passes(passes: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(query_id, asked_id)`` of the passes that equal another one in vector, budget and seeds; ``asked_id`` is the least of them.

    Passes without an id, or whose id repeats, equal none.
    """
    told = seeds.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "entity_id", "score", "seed_quality"))).alias("told"))
    once = passes.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.any_value("embedding").alias("embedding"), F.any_value("budget").alias("budget")).where("n = 1").drop("n")
    once = once.join(told, "query_id", "left")
    first = once.groupBy("embedding", "budget", "told").agg(F.min("query_id").alias("asked_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same = [once[c].eqNullSafe(first[c]) for c in ("embedding", "budget", "told")]
    return once.join(first, same).where("query_id <> asked_id").select("query_id", "asked_id")


def assemble(passes: DataFrame, seeds: DataFrame, data: Graph, settings: Settings = DEFAULTS) -> Retrieval:
    """Context of every pass ``(query_id, embedding, budget)`` from its seeds; equal passes are worked out once."""
    seeds = stage(seeds, "found")
    again = stage(repeated_passes(passes, seeds), "repeated")
    first = [df.join(again.select("query_id"), "query_id", "left_anti").select(df.columns) for df in (passes, seeds)]
    found = _assemble(*first, data, settings)

    def told(df: DataFrame) -> DataFrame:
        copies = df.withColumnRenamed("query_id", "asked_id").join(again, "asked_id")
        return df.unionByName(copies.select(df.columns))

    return Retrieval(*[told(getattr(found, f)) for f in Retrieval.__dataclass_fields__])


def _choose_by_rows(seeds: DataFrame, nodes: DataFrame, passes: DataFrame, fixed: DataFrame, data: Graph, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Chosen chunks and counts as ``choose_chunks`` tells them, with a row for each pair of question and chunk."""
    pairs = stage(linked_chunks(seeds, nodes, data.chunk_entities), "linked")
    fetched = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("fetched"))
    kept = stage(_kept_chunks(pairs, passes, data.chunks, settings), "kept")
    survived = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("survived"))
    budgets = fixed.select("query_id", F.explode(F.array(
        F.struct(F.lit(0).alias("tier"), F.col("seed_budget").alias("room")),
        F.struct(F.lit(1).alias("tier"), F.col("hop_budget").alias("room")))).alias("b")).select("query_id", "b.*")
    # no tier can hold more rows than tokens of the largest budget asked for
    widest = fixed.agg(F.max("elastic")).first()[0] or 0
    chosen = budget_prefix(kept.join(budgets, ["query_id", "tier"]), ["query_id", "tier"],
                           [F.col("neg_sim"), F.col("chunk_id")], "cost", F.col("room"), int(widest))
    chosen = stage(chosen.select("query_id", "tier", "chunk_id", "entity_id", "hop", "similarity", "cost"), "chosen")
    return chosen, fetched.join(survived, "query_id", "left").na.fill(0, ["survived"])


def _assemble(passes: DataFrame, seeds: DataFrame, data: Graph, settings: Settings) -> Retrieval:
    seeds = stage(anchor_rows(seeds, data), "seeds")
    nodes = stage(graph.traverse(seeds, data.relations, settings), "nodes")
    induced = graph.induced_edges(seeds, nodes, data.relations, settings)
    edges = stage(edge_rows(induced, data.entities), "edges")

    anchored = budget_prefix(
        seeds.select("query_id", "rank", F.length("line").alias("chars"), T.estimate_tokens(F.col("line")).alias("cost")),
        ["query_id"], [F.col("rank")], "cost", F.lit(settings.anchor_budget_tokens), settings.anchor_budget_tokens,
    ).groupBy("query_id").agg(_joined_chars(F.col("chars")).alias("anchor_chars"))
    drawn = budget_prefix(
        edges.select("query_id", "hop", "relation_id", F.length("line").alias("chars"),
                     T.estimate_tokens(F.col("line")).alias("cost")),
        ["query_id"], [F.col("hop"), F.col("relation_id")], "cost", F.lit(settings.subgraph_budget_tokens),
        settings.subgraph_budget_tokens,
    ).groupBy("query_id").agg(_joined_chars(F.col("chars")).alias("edge_chars"))
    lead = seeds.filter("rank = 1").select("query_id", "entity_id")
    lead_pages = data.pages.filter(F.col("entity_id").isNotNull()).join(
        lead.select("entity_id").distinct(), "entity_id", "left_semi")
    wiki = lead.join(wiki_slot(lead_pages, settings), "entity_id")

    fixed = passes.select("query_id", F.col("budget").cast("bigint").alias("budget")).join(
        anchored, "query_id", "left").join(drawn, "query_id", "left").join(
        wiki.select("query_id", T.estimate_tokens(F.col("content")).cast("bigint").alias("wiki_page")), "query_id", "left")
    fixed = fixed.select(
        "query_id", "budget", _tokens(F.coalesce("anchor_chars", F.lit(0))).alias("anchor"),
        _tokens(F.coalesce("edge_chars", F.lit(0))).alias("subgraph"),
        F.coalesce("wiki_page", F.lit(0)).alias("wiki_page"), F.lit(INSTRUCTION_TOKENS).cast("bigint").alias("instruction"))
    elastic = F.greatest(F.lit(0), F.col("budget") - F.col("anchor") - F.col("subgraph") - F.col("wiki_page") - F.col("instruction"))
    fixed = fixed.withColumn("elastic", elastic).withColumn(
        "seed_budget", F.floor(F.col("elastic") * settings.seed_chunk_share).cast("bigint")).withColumn(
        "hop_budget", F.col("elastic") - F.col("seed_budget"))
    fixed = stage(fixed, "slots")

    asked = fixed.filter("elastic > 0").join(passes.select("query_id", "embedding"), "query_id").select(
        "query_id", "embedding", F.col("seed_budget").alias("seed_room"), F.col("hop_budget").alias("hop_room"))
    chosen, counts_of, rest = choose_chunks(asked, node_members(seeds, nodes), data.chunk_entities, data.chunks, chunk_vectors(data.chunks, settings), settings)
    rest = stage(rest, "rest")
    if not rest.isEmpty():
        more, more_counts = _choose_by_rows(*[df.join(rest, "query_id", "left_semi") for df in (seeds, nodes, passes, fixed)], data, settings)
        chosen, counts_of = chosen.unionByName(more), counts_of.unionByName(more_counts)
    spent = chosen.groupBy("query_id").agg(
        F.sum(F.when(F.col("tier") == 0, F.col("cost"))).alias("seed_chunks"),
        F.sum(F.when(F.col("tier") == 1, F.col("cost"))).alias("hop_chunks"))
    counts = nodes.groupBy("query_id").agg(F.count(F.lit(1)).alias("entities_after_truncation"))
    seeded = seeds.groupBy("query_id").agg(F.countDistinct("entity_id").alias("n_seeds"))
    summary = fixed
    for part in (spent, counts, seeded, counts_of.withColumnsRenamed({"fetched": "chunks_fetched", "survived": "chunks_after_dedup"})):
        summary = summary.join(part, "query_id", "left")
    zero = F.lit(0).cast("bigint")
    summary = summary.na.fill(0, ["seed_chunks", "hop_chunks", "entities_after_truncation", "n_seeds",
                                  "chunks_fetched", "chunks_after_dedup"])
    total = F.col("anchor") + F.col("subgraph") + F.col("wiki_page") + F.col("seed_chunks") + F.col("hop_chunks") + F.col("instruction")
    summary = summary.select(
        "query_id", "anchor", "subgraph", "wiki_page", "seed_chunks", "hop_chunks", "instruction",
        total.alias("total"), "budget",
        F.when(F.col("budget") > 0, F.round(total / F.col("budget"), 4)).otherwise(F.lit(0.0)).alias("utilization"),
        (F.col("entities_after_truncation") + F.col("n_seeds")).alias("entities_traversed"),
        "entities_after_truncation", F.coalesce("chunks_fetched", zero).alias("chunks_fetched"), "chunks_after_dedup")
    return Retrieval(seeds, nodes, edges, wiki, chosen, summary)


def with_chunk_text(chosen: DataFrame, data: Graph) -> DataFrame:
    """Chosen chunks with text, file name and ingest time; a missing source is ``unknown``."""
    files = data.sources.select("source_id", F.col("file_name").alias("source_file"))
    return chosen.join(data.chunks.select("chunk_id", "source_id", "text_content", "created_at"), "chunk_id").join(
        files, "source_id", "left").withColumn("source_file", F.coalesce("source_file", F.lit("unknown")))


def retrieve_single(questions: DataFrame, data: Graph, settings: Settings = DEFAULTS) -> Retrieval:
    """One pass per question. ``questions`` is ``(query_id, embedding[, budget][, seed_entity_ids])``."""
    passes = _passes(questions, settings)
    seeds = find_seeds(passes, data.entities, settings)
    if "seed_entity_ids" in questions.columns:
        given = questions.select("query_id", F.posexplode("seed_entity_ids").alias("rank", "entity_id")).withColumn(
            "rank", F.col("rank") + 1)
        chosen = given.select("query_id").distinct()
        seeds = seeds.join(chosen, "query_id", "left_anti").unionByName(seeds_by_id(given, data.entities))
    return assemble(passes, seeds, data, settings)


def _passes(questions: DataFrame, settings: Settings) -> DataFrame:
    default = F.lit(settings.total_budget_tokens)
    budget = F.coalesce("budget", default) if "budget" in questions.columns else default
    return questions.select("query_id", "embedding", budget.alias("budget"))


def retrieve_comparison(questions: DataFrame, data: Graph, settings: Settings = DEFAULTS) -> Retrieval:
    """One pass per compared entity, all passes of all questions in one job, merged per question.

    The entities are the given ids or the vector seeds; each gets an equal share of the budget and ids
    that do not exist are left out. A question without any known entity runs as a single pass.
    """
    passes = _passes(questions, settings)
    wanted = find_seeds(passes, data.entities, settings).select("query_id", "rank", "entity_id")
    if "seed_entity_ids" in questions.columns:
        given = questions.select("query_id", F.posexplode("seed_entity_ids").alias("rank", "entity_id"))
        wanted = wanted.join(given.select("query_id").distinct(), "query_id", "left_anti").unionByName(given)
    shares = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    known = wanted.join(data.entities.select("entity_id"), "entity_id", "left_semi")
    part = F.concat(F.col("query_id").cast("string"), F.lit("/"), F.col("rank").cast("string"))
    split = stage(known.join(shares, "query_id").join(passes, "query_id").select(
        part.alias("query_id"), F.col("query_id").alias("parent_id"), F.col("rank").alias("part"), "entity_id", "embedding",
        F.floor(F.col("budget") / F.col("n")).cast("bigint").alias("budget")), "parts")
    seeds = seeds_by_id(split.select("query_id", F.lit(1).alias("rank"), "entity_id"), data.entities)
    merged = merge_results(assemble(split, seeds, data, settings), split.select("query_id", "parent_id", "part"))
    rest = questions.join(split.select(F.col("parent_id").alias("query_id")).distinct(), "query_id", "left_anti")
    if rest.isEmpty():
        return merged
    alone = retrieve_single(rest, data, settings)
    return Retrieval(*[getattr(merged, f).unionByName(getattr(alone, f), allowMissingColumns=True)
                       for f in Retrieval.__dataclass_fields__])


def merge_results(parts: Retrieval, members: DataFrame) -> Retrieval:
    """Merge partial results ``members(query_id, parent_id, part)``; the first part wins on duplicates."""
    def lifted(df: DataFrame) -> DataFrame:
        return df.join(members, "query_id").drop("query_id").withColumnRenamed("parent_id", "query_id")

    def first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
        return keep_one(lifted(df), ["query_id", *key], [F.col("part"), *[F.col(c) for c in order]])

    seeds = first(parts.seeds, ["entity_id"], ["rank"]).withColumn("rank", F.col("part")).drop("part")
    edges = first(parts.edges, ["source_name", "relation_type", "target_name"], ["hop", "relation_id"]).drop("part")
    nodes = first(parts.nodes, ["entity_id"], ["hop"]).drop("part")
    wiki = keep_one(lifted(parts.wiki), ["query_id"], [F.col("part")]).drop("part")
    chunks = first(parts.chunks, ["tier", "chunk_id"], ["chunk_id"]).drop("part")
    distinct_chunks = chunks.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("chunks_after_dedup"))
    sums = ["anchor", "subgraph", "wiki_page", "seed_chunks", "hop_chunks", "instruction", "total"]
    tail = ["entities_traversed", "entities_after_truncation", "chunks_fetched"]
    summary = lifted(parts.summary).groupBy("query_id").agg(
        *[F.sum(c).alias(c) for c in (*sums, *tail)], F.max("budget").alias("budget")).join(
        distinct_chunks, "query_id", "left").select(
        "query_id", *sums, "budget",
        F.when(F.col("budget") > 0, F.col("total") / F.col("budget")).otherwise(F.lit(0.0)).alias("utilization"),
        *tail, F.coalesce("chunks_after_dedup", F.lit(0)).alias("chunks_after_dedup"))
    return Retrieval(seeds, nodes, edges, wiki, chunks, summary)


def retrieve(questions: DataFrame, data: Graph, plans: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Summary per question ``(query_id, text, embedding, ...)`` with its type; rejected plans get no retrieval.

    Comparisons run per entity, every other type as a single pass.
    """
    plans = classify(questions, settings=settings) if plans is None else plans
    kinds = stage(plans.filter("NOT rejected").select("query_id", "classified_type"), "plans")
    compared = kinds.filter("classified_type = 'comparison'")
    single = retrieve_single(questions.join(kinds.filter("classified_type <> 'comparison'").select("query_id"), "query_id", "left_semi"), data, settings)
    parts = retrieve_comparison(questions.join(compared.select("query_id"), "query_id", "left_semi"), data, settings)
    return single.summary.unionByName(parts.summary).join(kinds, "query_id")


def context_blocks(result: Retrieval, data: Graph) -> DataFrame:
    """Prompt context as lines ``(query_id, block, pos, id, line)``, to be read by block and position.

    Blocks are seed entities, edges, wiki page, seed chunks and hop chunks; empty blocks are absent.
    """
    seed = result.seeds.select("query_id", F.lit(1).alias("block"), F.col("rank").cast("double").alias("pos"), F.col("entity_id").alias("id"), F.concat(
        F.lit("- "), F.col("name"), F.lit(" ("), F.col("entity_type"), F.lit("): "), F.col("description"),
        F.lit(" [degree="), F.col("degree").cast("string"), F.lit(", centrality="), F.col("relative_centrality"),
        F.lit("]")).alias("line"))
    edge = result.edges.select("query_id", F.lit(2).alias("block"), F.col("hop").cast("double").alias("pos"), F.col("relation_id").alias("id"),
                               F.concat(F.lit("- "), F.col("line")).alias("line"))
    wiki = result.wiki.select("query_id", F.lit(3).alias("block"), F.lit(0.0).alias("pos"), F.col("entity_id").alias("id"),
                              F.col("content").alias("line"))
    chunk = with_chunk_text(result.chunks, data).select(
        "query_id", (F.col("tier") + 4).alias("block"), (-F.round("similarity", 6)).alias("pos"), F.col("chunk_id").alias("id"),
        F.concat(F.lit("- "), F.col("text_content")).alias("line"))
    return seed.unionByName(edge).unionByName(wiki).unionByName(chunk)


def extractive_answers(result: Retrieval, data: Graph) -> DataFrame:
    """``(query_id, chunk_id, source_file, answer)``: the text of the best chunk, seed chunks first."""
    best = keep_one(result.chunks, ["query_id"], [F.col("tier"), -F.round("similarity", 6), F.col("chunk_id")])
    return with_chunk_text(best, data).select("query_id", "chunk_id", "source_file", F.col("text_content").alias("answer"))
