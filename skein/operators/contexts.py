"""Chunks of many questions chosen in shares of questions: links, scores, greedy choice and budget within a task.

A question's pairs with chunks are as many as its nodes have links, and only a few of them enter its context. So neither pairs nor
their vectors move: questions are dealt to shares, those with a node in common together as far as they go, and a share gets the links of
its nodes once each and every different vector of their chunks once. Pairs exist in slices within the task. A question whose nodes
have more links than a block is for ``retrieval`` to work out, block by block; the same holds where ids repeat.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from skein.config import DEFAULTS, Settings
from skein.functions import text as T, vectors as V
from skein.operators.dedup import far_apart
from skein.session import fan_out, stage

SHARE_PAIRS, LEAST_PAIRS, SLICE_PAIRS = 1 << 22, 1 << 15, 1 << 17  # pairs of a share at most, of one that is worth a task, and held at once
NO_CHUNK = -(1 << 63)  # a link without chunk counts as fetched
HELD_VALUES = 1 << 26  # components of vectors that a share may hold


def _rounded(x: np.ndarray) -> np.ndarray:
    """``x`` rounded to six digits like ``F.round``: by its decimal digits, halves away from zero."""
    scaled = np.abs(x) * 1e6
    out = np.floor(scaled + 0.5) / 1e6
    tied = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4)
    out[tied] = [float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in np.abs(x[tied]).tolist()]
    return np.copysign(out, x)


def _lists(column: pa.ChunkedArray, *fields: str) -> tuple[np.ndarray, ...]:
    """Length of each list of structs, and the fields of all their structs in a row; a null is -1, or the least number for a chunk."""
    column = column.combine_chunks()
    flat = column.flatten()
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    return (sizes, *(flat.field(f).fill_null(NO_CHUNK if f == "chunk_id" else -1).to_numpy(zero_copy_only=False) for f in fields))


def _matrices(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the numbers of the vectors that have it and their matrix, filled piece by piece."""
    sizes = [piece.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) for piece in vectors.chunks]
    every = np.concatenate([np.zeros(0, np.int64), *sizes])
    out = {}
    for dim in np.unique(every[every >= 0]):
        at = np.flatnonzero(every == dim)
        matrix, filled = np.empty((len(at), dim), np.float32 if vectors.type.value_type == pa.float32() else np.float64), 0
        for piece, n in zip(vectors.chunks, sizes):
            own = np.flatnonzero(n == dim)
            values = (piece if len(own) == len(piece) else piece.take(pa.array(own))).flatten()
            matrix[filled:filled + len(own)] = values.to_numpy(zero_copy_only=False).reshape(len(own), dim)
            filled += len(own)
        out[int(dim)] = at, matrix
    return out


def _slices(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of questions with at most ``SLICE_PAIRS`` pairs, or one with more."""
    cuts, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > SLICE_PAIRS:
            cuts.append((start, i))
            start, held = i, 0
        held += n
    return [*cuts, (start, len(sizes))] if len(sizes) else cuts


def _first(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it in any key."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _choose(threshold: float, whole: bool, schema: pa.Schema):
    """Chosen chunks of each question of a share and a row with its counts (tier -1); with ``whole`` all that the greedy choice keeps."""

    def run(asked: pa.Table, told: pa.Table) -> pa.Table:
        out = [schema.empty_table()]
        links = told.filter(told["links"].is_valid())
        n_links, chunk, cost, code = _lists(links["links"], "chunk_id", "cost", "class_id")
        entities = links["entity_id"].to_numpy()
        by = np.argsort(entities)
        starts = np.cumsum(n_links) - n_links
        vectors = told.filter(told["embedding"].is_valid())
        numbers, zero = vectors["class_id"].to_numpy(), vectors["is_zero"].to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(numbers)
        place = np.full(len(code), -1)
        if len(order):
            place = order[np.minimum(np.searchsorted(numbers, code, sorter=order), len(order) - 1)]
            place[(code < 0) | (numbers[place] != code)] = -1
        size = np.zeros(len(numbers), np.int64)
        row = np.zeros(len(numbers), np.int64)
        held = _matrices(vectors["embedding"])
        for dim, (at, _) in held.items():
            size[at], row[at] = dim, np.arange(len(at))
        questions = _matrices(asked["embedding"])
        q_size, q_row = np.full(len(asked), -1), np.zeros(len(asked), np.int64)
        for dim, (at, _) in questions.items():
            q_size[at], q_row[at] = dim, np.arange(len(at))
        n_members, m_entity, m_tier, m_hop = _lists(asked["members"], "entity_id", "tier", "hop")
        rooms = np.stack([asked[c].to_numpy() for c in ("seed_room", "hop_room")])
        m_query = np.repeat(np.arange(len(asked)), n_members)
        if len(by):
            m_at = by[np.minimum(np.searchsorted(entities, m_entity, sorter=by), len(by) - 1)]
            m_links = np.where(entities[m_at] == m_entity, n_links[m_at], 0)
        else:
            m_at, m_links = np.zeros(len(m_entity), np.int64), np.zeros(len(m_entity), np.int64)
        ends = np.cumsum(n_members)
        per_query = np.bincount(m_query, m_links, len(asked)).astype(np.int64)

        for first, last in _slices(per_query):
            rows = np.arange(ends[first] - n_members[first], ends[last - 1])
            n = m_links[rows]
            link = np.repeat(starts[m_at[rows]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            q, tier, entity, hop = (np.repeat(x[rows], n) for x in (m_query, m_tier, m_entity, m_hop))
            # a chunk once for each question, by the least (tier, entity, hop)
            by_chunk = np.lexsort((hop, entity, tier, chunk[link], q))
            keep = by_chunk[_first(q[by_chunk], chunk[link][by_chunk])]
            link, q, tier, entity, hop = (x[keep] for x in (link, q, tier, entity, hop))
            fetched = np.bincount(q - first, minlength=last - first)
            # the first chunk of equal vectors; those of length zero are no copies
            at = place[link]
            has = at >= 0
            link, q, tier, entity, hop, at = (x[has] for x in (link, q, tier, entity, hop, at))
            by_vector = np.lexsort((chunk[link], tier, np.where(zero[at], -1 - np.arange(len(at)), at), q))
            keep = by_vector[_first(q[by_vector], np.where(zero[at], -1 - np.arange(len(at)), at)[by_vector])]
            keep = keep[size[at[keep]] == q_size[q[keep]]]
            link, q, tier, entity, hop, at = (x[keep] for x in (link, q, tier, entity, hop, at))
            similarity = np.full(len(q), np.nan)
            for dim in np.unique(size[at]):
                some = np.flatnonzero(size[at] == dim)
                for cut in range(0, len(some), 1 << 16):
                    part = some[cut:cut + (1 << 16)]
                    x = questions[dim][1][q_row[q[part]]].astype(np.float64)
                    y = held[dim][1][row[at[part]]].astype(np.float64)
                    norm = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
                    dots = np.einsum("ij,ij->i", x, y)
                    similarity[part] = np.where(norm > 0, dots / np.where(norm > 0, norm, 1.0), 0.0)
            neg = np.where(np.isnan(similarity), np.inf, -_rounded(np.nan_to_num(similarity)) + 0.0)
            ordered = np.lexsort((chunk[link], neg, tier, q))
            link, q, tier, entity, hop, at, similarity, neg = (x[ordered] for x in (link, q, tier, entity, hop, at, similarity, neg))
            kept = np.zeros(len(q), bool)
            new = np.flatnonzero(_first(q))
            for low, high in zip(new, np.append(new[1:], len(q))):
                kept[low:high] = far_apart(held[size[at[low]]][1][row[at[low:high]]].astype(np.float64), threshold)
            survived = np.bincount(q[kept] - first, minlength=last - first)
            chosen = np.flatnonzero(kept)
            if not whole:
                # within a tier by similarity, one that is no number first
                chosen = chosen[np.lexsort((chunk[link[chosen]], np.where(np.isinf(neg[chosen]), -np.inf, neg[chosen]), tier[chosen], q[chosen]))]
                spent = np.cumsum(cost[link[chosen]].astype(np.int64))
                begins = _first(q[chosen], tier[chosen])
                base = (spent - cost[link[chosen]])[begins][np.cumsum(begins) - 1] if len(chosen) else spent
                chosen = chosen[spent - base <= rooms[tier[chosen], q[chosen]]]
            every = np.arange(first, last)
            none = np.full(len(every), -1)
            ids = asked["query_id"].combine_chunks()
            out.append(pa.table({
                "query_id": ids.take(pa.array(np.concatenate([q[chosen], every]))),
                "tier": np.concatenate([tier[chosen], none]), "chunk_id": np.concatenate([chunk[link[chosen]], none]), "entity_id": np.concatenate([entity[chosen], none]),
                "hop": np.concatenate([hop[chosen], none]), "similarity": pa.array(np.concatenate([similarity[chosen], np.zeros(len(every))]), from_pandas=True),
                "cost": np.concatenate([cost[link[chosen]], none]), "fetched": np.concatenate([np.zeros(len(chosen), np.int64), fetched]),
                "survived": np.concatenate([np.zeros(len(chosen), np.int64), survived])}).cast(schema))
        return pa.concat_tables(out)

    return run


def chunk_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(class_id, embedding, is_zero)`` of the different vectors of ``vectors (chunk_id, embedding)``, and ``(chunk_id, class_id)``."""
    key = [F.xxhash64("embedding").alias("k"), F.xxhash64(F.reverse("embedding")).alias("r")]
    classes = stage(vectors.groupBy(*key).agg(F.first("embedding").alias("embedding")).select(
        F.monotonically_increasing_id().alias("class_id"), "k", "r", "embedding", V.is_zero(F.col("embedding")).alias("is_zero")).where("is_zero is not null"), "chunk-classes")
    return classes.select("class_id", "embedding", "is_zero"), vectors.select("chunk_id", *key).join(classes.select("k", "r", "class_id"), ["k", "r"]).select("chunk_id", "class_id")


def choose_chunks(asked: DataFrame, members: DataFrame, links: DataFrame, chunks: DataFrame, vectors: DataFrame, settings: Settings = DEFAULTS,
                  whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(chosen, counts, rest)`` for questions ``asked (query_id, embedding, seed_room, hop_room)`` with nodes ``members (query_id, entity_id, tier, hop)``.

    ``vectors (chunk_id, embedding)`` has the chunks' vectors. ``chosen (query_id, tier, chunk_id, entity_id, hop, similarity, cost)`` fits
    the rooms, with ``whole`` it is all that is left without near duplicates; ``counts (query_id, fetched, survived)`` are of linked chunks and of
    those without near duplicates. ``rest (query_id)`` are the questions that are not answered here.
    """
    spark = asked.sparkSession
    members = members.join(asked.select("query_id"), "query_id", "left_semi")
    ids = [links.schema["chunk_id"], links.schema["entity_id"], members.schema["entity_id"], chunks.schema["chunk_id"]]
    plain = all(f.dataType.simpleString() == "bigint" for f in ids) and chunks.groupBy("chunk_id").count().where("count > 1").isEmpty()
    declared = (f"query_id {asked.schema['query_id'].dataType.simpleString()}, tier int, chunk_id bigint, entity_id bigint, hop int, similarity double, cost int, "
                "fetched bigint, survived bigint")
    none = spark.createDataFrame([], declared)
    chosen, counts = none.columns[:7], ["query_id", *none.columns[7:]]
    if not plain:
        return none.select(chosen), none.select(counts), members.select("query_id").distinct()

    limit = settings.dedup_block_rows
    held = links.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    once = asked.groupBy("query_id").count().where("count = 1").select("query_id")
    # a hash of its nodes, the least of a question: questions with much in common agree in it
    sums = stage(members.join(held, "entity_id").groupBy("query_id").agg(
        F.sum("n").alias("n"), F.min(F.xxhash64("entity_id")).alias("least")), "share-sums")
    sized = stage(sums.where(F.col("n") <= limit).join(once, "query_id", "left_semi"), "share-sizes")
    total = sized.agg(F.sum("n")).first()[0] or 0
    classes, of = chunk_classes(vectors)
    components = classes.agg(F.sum(F.size("embedding")), F.max(F.size("embedding"))).first()
    widest = max(components[1] or 1, 1)
    most = SHARE_PAIRS if (components[0] or 0) <= HELD_VALUES else max(LEAST_PAIRS, HELD_VALUES // widest)
    pairs = min(most, max(LEAST_PAIRS, -(-total // (4 * spark.sparkContext.defaultParallelism))))
    lots = sized.groupBy("least").agg(F.sum("n").alias("lot")).where(F.col("lot") > pairs // 4)
    parts = F.ceil(F.col("lot") / pairs)
    dealt = sized.join(lots, "least", "left").select(
        "query_id", F.when(F.col("lot").isNotNull(), F.col("least")).otherwise(0).alias("share"),
        F.when(F.col("lot").isNotNull(), F.pmod(F.xxhash64("query_id"), parts)).otherwise(F.pmod(F.xxhash64("least"), F.lit(max(1, -(-total // pairs))))).cast("int").alias("part"))
    keys = ["share", "part"]
    packed = members.groupBy("query_id").agg(F.collect_list(F.struct("entity_id", F.col("tier").cast("int").alias("tier"), F.col("hop").cast("int").alias("hop"))).alias("members"))
    left = stage(dealt.join(packed, "query_id").join(asked.select("query_id", "embedding", F.col("seed_room").cast("bigint").alias("seed_room"), F.col("hop_room").cast("bigint").alias("hop_room")),
                                                     "query_id"), "share-questions")
    facts = chunks.select("chunk_id", T.estimate_tokens(F.coalesce("text_content", F.lit(""))).alias("cost")).join(of, "chunk_id", "left")
    few = links.join(held.where(F.col("n") <= limit).select("entity_id"), "entity_id", "left_semi")
    own = stage(few.join(facts, "chunk_id", "left").groupBy("entity_id").agg(F.collect_list(F.struct("chunk_id", "cost", "class_id")).alias("links")), "share-links")
    met = stage(left.select(*keys, F.explode("members.entity_id").alias("entity_id")).distinct(), "share-nodes").join(own, "entity_id")
    seen = met.select(*keys, F.explode(F.array_distinct("links.class_id")).alias("class_id")).distinct().join(classes, "class_id")
    told = met.select(*keys, "entity_id", "links").unionByName(seen, allowMissingColumns=True)
    found = fan_out(left, *keys).groupBy(*keys).cogroup(fan_out(told, *keys).groupBy(*keys)).applyInArrow(
        _choose(settings.dedup_threshold, whole, to_arrow_schema(none.schema)), none.schema)
    if not whole:
        found = stage(found, "share-chosen")
    rest = sums.select("query_id").join(sized, "query_id", "left_anti")
    return found.where("tier >= 0").select(chosen), found.where("tier < 0").select(counts), rest
