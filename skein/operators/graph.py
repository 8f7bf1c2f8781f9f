"""Graph operators over a relation table ``(relation_id, source_entity_id, target_entity_id, ...)``.

Edges are walked in both directions, so every operator starts from the symmetric adjacency: an
equi-join replaces the two-way OR condition. All walks carry ``query_id`` and answer many seed sets
at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skein.config import DEFAULTS, Settings
from skein.functions.text import title_case
from skein.functions.vectors import relative_centrality
from skein.operators.ranking import top_k
from skein.session import fan_out, stage

REACH_PAIRS, REACH_MARKS = 1 << 20, 1 << 21  # pairs of a cell, and (question, neighbour) marks or neighbours that a task holds


def adjacency(relations: DataFrame) -> DataFrame:
    """Both directions of every relation, self-loops twice: ``(node, nbr, relation_id, relation_type, outgoing)``."""
    ends = F.array(
        F.struct(F.col("source_entity_id").alias("node"), F.col("target_entity_id").alias("nbr"), F.lit(True).alias("outgoing")),
        F.struct(F.col("target_entity_id").alias("node"), F.col("source_entity_id").alias("nbr"), F.lit(False).alias("outgoing")),
    )
    carried = [c for c in ("relation_id", "relation_type") if c in relations.columns]
    return relations.select(*carried, F.explode(ends).alias("e")).select("e.node", "e.nbr", *carried, "e.outgoing")


def degrees(relations: DataFrame) -> DataFrame:
    """``(node, degree)``; a self-loop counts twice."""
    return adjacency(relations).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def neighbours(relations: DataFrame) -> DataFrame:
    """Distinct neighbour pairs with the neighbour's degree: ``(node, nbr, nbr_degree)``."""
    pairs = adjacency(relations).filter("node <> nbr").select("node", "nbr").distinct()
    return pairs.join(degrees(relations).select(F.col("node").alias("nbr"), F.col("degree").alias("nbr_degree")), "nbr")


def neighbour_types(relations: DataFrame, entity_types: DataFrame) -> DataFrame:
    """``(node, entity_type, n)``: how many relation ends lead to each type.

    Equal (node, neighbour) pairs are added up before the join, so parallel edges of a hub cost one row.
    """
    pairs = adjacency(relations).groupBy("node", "nbr").agg(F.count(F.lit(1)).alias("n"))
    typed = pairs.join(entity_types.select(F.col("entity_id").alias("nbr"), "entity_type"), "nbr")
    return typed.groupBy("node", "entity_type").agg(F.sum("n").alias("n"))


def relation_summaries(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """``(entity_id, relation_summary)``: ``Connected to 3 Person, 1 Location`` or ``No relations``."""
    per_type = neighbour_types(relations, entities)
    part = F.struct((-F.col("n")).alias("o"), F.col("entity_type").alias("t"),
                    F.concat(F.col("n").cast("string"), F.lit(" "), title_case(F.col("entity_type"))).alias("s"))
    text = F.concat(F.lit("Connected to "), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["s"]), ", "))
    told = per_type.groupBy("node").agg(text.alias("relation_summary"))
    return entities.select("entity_id").join(told, F.col("entity_id") == F.col("node"), "left").select(
        "entity_id", F.coalesce("relation_summary", F.lit("No relations")).alias("relation_summary"))


def anchors(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Structural anchor of every entity: name, type, description, degree, centrality, relation summary."""
    degree = F.coalesce(F.col("degree"), F.lit(0)).cast("bigint")
    return (
        entities.select("entity_id", "name", "entity_type", F.coalesce("description", F.lit("")).alias("description"))
        .join(degrees(relations).withColumnRenamed("node", "entity_id"), "entity_id", "left")
        .join(relation_summaries(relations, entities), "entity_id")
        .select("entity_id", "name", "entity_type", "description", degree.alias("degree"),
                relative_centrality(degree).alias("relative_centrality"), "relation_summary")
    )


def _met_in_cells(hop: int):
    """Rows of cells, adjacency first and then by question, to what each question newly meets in a cell: (query_id, entity_id, hop)."""

    def cell_of(node: np.ndarray, nbr: np.ndarray):
        targets, at = np.unique(nbr, return_inverse=True)
        order = np.argsort(node, kind="stable")
        nodes, starts = np.unique(node[order], return_index=True)
        return nodes, starts, np.diff(np.append(starts, len(node))), at[order], targets

    def answer(cell, query: np.ndarray, kind: np.ndarray, node: np.ndarray, nbr: np.ndarray) -> Iterator[pa.RecordBatch]:
        nodes, starts, sizes, at, targets = cell
        ids, q = np.unique(query, return_inverse=True)
        room = max(1, REACH_MARKS // len(targets))
        for first in range(0, len(ids), room):
            low, high = np.searchsorted(q, [first, first + room])
            marks = np.zeros((min(room, len(ids) - first), len(targets)), bool)
            asks = np.flatnonzero(kind[low:high] == 2) + low
            place = np.searchsorted(nodes, node[asks])
            n = sizes[place]
            # a bounded number of neighbours at once
            for cut in np.split(np.arange(len(asks)), np.flatnonzero(np.diff(np.cumsum(n) // REACH_MARKS)) + 1):
                m = n[cut]
                link = np.repeat(starts[place[cut]] - np.cumsum(m) + m, m) + np.arange(m.sum())
                marks[np.repeat(q[asks[cut]] - first, m), at[link]] = True
            seen = np.flatnonzero(kind[low:high] == 1) + low
            where = np.minimum(np.searchsorted(targets, nbr[seen]), len(targets) - 1)
            fine = targets[where] == nbr[seen]
            marks[q[seen[fine]] - first, where[fine]] = False
            who, what = np.nonzero(marks)
            yield pa.record_batch([pa.array(ids[first + who]), pa.array(targets[what]), pa.array(np.full(len(who), hop, np.int32))], ["query_id", "entity_id", "hop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cell, pieces, rest = None, None, [], None
        for batch in batches:
            rows = np.stack([batch.column(c).fill_null(0).cast(pa.int64()).to_numpy() for c in ("cell", "kind", "query_id", "node", "nbr")])
            for part in np.split(rows, np.flatnonzero(np.diff(rows[0])) + 1, axis=1):
                if not part.shape[1]:
                    continue
                if part[0, 0] != number:
                    if rest is not None:
                        yield from answer(cell, rest[2], rest[1], rest[3], rest[4])
                    number, cell, pieces, rest = part[0, 0], None, [], None
                own = part[1] == 0
                if own.any():
                    pieces.append(part[3:, own])
                asked = part[:, ~own]
                if not asked.shape[1]:
                    continue
                if cell is None and pieces:
                    cell, pieces = cell_of(*np.concatenate(pieces, axis=1)), []
                if cell is None:  # nobody's neighbours are here
                    continue
                rest = asked if rest is None else np.concatenate([rest, asked], axis=1)
                # the last question may go on in the next batch
                done = np.searchsorted(rest[2], rest[2, -1])
                if done:
                    yield from answer(cell, rest[2, :done], rest[1, :done], rest[3, :done], rest[4, :done])
                rest = rest[:, done:]
        if rest is not None:
            yield from answer(cell, rest[2], rest[1], rest[3], rest[4])

    return run


def _last_reach(frontier: DataFrame, visited: DataFrame, pairs: DataFrame, hop: int) -> DataFrame:
    """What the last hop newly meets, found where the neighbours are: the pairs of question and neighbour, which are most rows, never move.

    Neighbours are dealt to cells; a question goes to a cell once for each node of its frontier that has neighbours there.
    """
    cells = max(2 * pairs.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() // REACH_PAIRS))

    def cell(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(cells)).cast("int").alias("cell")

    none = F.lit(None).cast("bigint")
    near = pairs.select(cell("nbr"), F.lit(0).alias("kind"), none.alias("query_id"), "node", "nbr")
    asks = frontier.join(pairs.select("node", cell("nbr")).distinct(), F.col("entity_id") == F.col("node")).select("cell", F.lit(2).alias("kind"), "query_id", "node", none.alias("nbr"))
    seen = visited.select(cell("entity_id"), F.lit(1).alias("kind"), "query_id", none.alias("node"), F.col("entity_id").alias("nbr"))
    rows = fan_out(near.unionByName(asks).unionByName(seen), "cell").sortWithinPartitions("cell", F.col("kind") > 0, "query_id")
    return rows.mapInArrow(_met_in_cells(hop), "query_id long, entity_id long, hop int")


def reach(seeds: DataFrame, relations: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Unbounded walk: ``(query_id, entity_id, hop)`` with the least hop, up to ``max_hops``.

    One equi-join per hop, distinct before the anti-join with what was visited; the last hop, which holds most rows, moves none of its own.
    """
    pairs = stage(adjacency(relations).filter("node <> nbr").select("node", "nbr").distinct(), "pairs")
    visited = stage(seeds.select("query_id", "entity_id").distinct(), "seeds").withColumn("hop", F.lit(0))
    numbers = all(df.schema[c].dataType.simpleString() == "bigint" for df, c in ((visited, "query_id"), (visited, "entity_id"), (pairs, "node"), (pairs, "nbr")))
    numbers = numbers and visited.where("query_id is null").isEmpty()
    frontier = visited
    for hop in range(1, settings.max_hops + 1):
        if hop == settings.max_hops and numbers:
            return visited.unionByName(_last_reach(frontier, visited, pairs, hop))
        step = stage(
            frontier.join(pairs, F.col("entity_id") == F.col("node"))
            .select("query_id", F.col("nbr").alias("entity_id")).distinct()
            .join(visited, ["query_id", "entity_id"], "left_anti").withColumn("hop", F.lit(hop)), "reached")
        visited = visited.unionByName(step)
        frontier = step
    return visited


def _best_first() -> list[Column]:
    return [F.col("entity_degree").desc(), F.col("entity_id")]


def _last_hop(frontier: DataFrame, visited: DataFrame, lists: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Top ``k`` unvisited neighbours of each query's frontier by (degree desc, id), without expanding hubs.

    Neighbour lists are cut to their best entries first. Everything ranked above the worst entry of
    every cut list is complete; queries that find ``k`` such nodes (or meet no cut list) are done.
    The others, if any, expand their whole frontier, so the result is exact.
    """
    met = frontier.join(lists, F.col("entity_id") == F.col("node")).select(
        "query_id", F.col("nbr").alias("entity_id"), F.col("nbr_degree").alias("entity_degree"), "cut")
    limit = met.filter("cut").groupBy("query_id").agg(
        F.min(F.struct((-F.col("entity_degree")).alias("d"), F.col("entity_id").alias("i"))).alias("limit"))
    fresh = met.select("query_id", "entity_id", "entity_degree").distinct().join(
        visited, ["query_id", "entity_id"], "left_anti")
    key = F.struct((-F.col("entity_degree")).alias("d"), F.col("entity_id").alias("i"))
    sure = top_k(fresh.join(limit, "query_id", "left").filter(F.col("limit").isNull() | (key <= F.col("limit"))),
                 ["query_id"], _best_first(), k)
    found = sure.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = limit.join(found, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < k).select("query_id")
    whole = (
        frontier.join(short, "query_id", "left_semi").join(pairs, F.col("entity_id") == F.col("node"))
        .select("query_id", F.col("nbr").alias("entity_id"), F.col("nbr_degree").alias("entity_degree")).distinct()
        .join(visited, ["query_id", "entity_id"], "left_anti")
    )
    done = sure.join(short, "query_id", "left_anti").select("query_id", "entity_id", "entity_degree")
    return done.unionByName(top_k(whole, ["query_id"], _best_first(), k))


def traverse(seeds: DataFrame, relations: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Capped neighbourhood: ``(query_id, entity_id, hop, entity_degree)`` of the kept non-seed nodes.

    Per hop the ``max_neighbors_per_hop`` nodes of highest degree, then ``max_total_nodes`` overall by
    (hop, degree desc, id). Inner hops are expanded whole, because later hops start from them.
    """
    k = settings.max_neighbors_per_hop
    pairs = stage(neighbours(relations), "neighbours")
    m = max(settings.frontier_list_rows, k)
    ranked = top_k(pairs, ["node"], [F.col("nbr_degree").desc(), F.col("nbr")], m + 1, "pos")
    lists = ranked.withColumn("cut", F.col("pos") == m + 1)
    frontier = stage(seeds.select("query_id", "entity_id").distinct(), "seeds")
    visited, kept = frontier, []
    for hop in range(1, settings.max_hops + 1):
        if hop == settings.max_hops:
            best = _last_hop(frontier, visited, lists, pairs, k)
        else:
            step = stage(
                frontier.join(pairs, F.col("entity_id") == F.col("node"))
                .select("query_id", F.col("nbr").alias("entity_id"), F.col("nbr_degree").alias("entity_degree")).distinct()
                .join(visited, ["query_id", "entity_id"], "left_anti"), "frontier")
            best = top_k(step, ["query_id"], _best_first(), k)
            frontier = step.select("query_id", "entity_id")
            visited = visited.unionByName(frontier)
        kept.append(best.withColumn("hop", F.lit(hop)))
    nodes = reduce(DataFrame.unionByName, kept)
    if k * settings.max_hops > settings.max_total_nodes:
        nodes = top_k(nodes, ["query_id"], [F.col("hop"), *_best_first()], settings.max_total_nodes)
    return nodes.select("query_id", "entity_id", "hop", "entity_degree")


def induced_edges(seeds: DataFrame, kept: DataFrame, relations: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Relations that touch a kept node and end in a kept node or a seed: ``(query_id, relation_id, ..., hop)``.

    Kept nodes are hubs by construction, so each pair of related nodes is met from its end of smaller degree: a hub holds only its
    pairs with larger hubs, and a query makes as many rows as its nodes hold, not one for every two of its nodes.
    """
    degree = degrees(relations)
    of = {end: degree.select(F.col("node").alias(f"{end}_entity_id"), F.struct("degree", "node").alias(end)) for end in ("source", "target")}
    led = relations.join(of["source"], "source_entity_id").join(of["target"], "target_entity_id").withColumns(
        {"low": F.least("source", "target")["node"], "high": F.greatest("source", "target")["node"]})
    led = stage(led.select(
        "low", "high", "relation_id", "source_entity_id", "target_entity_id", "relation_type",
        *[c for c in ("confidence_tag", "confidence_score") if c in relations.columns]), "led-relations")
    ends = seeds.select("query_id", "entity_id").distinct().withColumn("hop", F.lit(0)).unionByName(
        kept.select("query_id", "entity_id", "hop"))
    low, high = [ends.select("query_id", F.col("entity_id").alias(end), F.col("hop").alias(f"{end}_hop")) for end in ("low", "high")]
    first = F.least("low_hop", "high_hop")
    met = low.join(led.select("low", "high").distinct(), "low").join(high, ["query_id", "high"]).where("low_hop > 0 or high_hop > 0").select(
        "query_id", "low", "high", (first + 1).alias("hop")).distinct()
    return met.join(led, ["low", "high"]).drop("low", "high").select(
        "query_id", *[c for c in led.columns if c not in ("low", "high")], "hop")


def one_hop_links(relations: DataFrame, slugs: DataFrame) -> DataFrame:
    """``(entity_id, relation_id, label, target_slug)``: outgoing types as they are, incoming with an arrow."""
    other = slugs.select(F.col("id").alias("nbr"), F.col("slug").alias("target_slug"))
    label = F.when(F.col("outgoing"), F.col("relation_type")).otherwise(F.concat(F.lit("← "), F.col("relation_type")))
    return adjacency(relations).join(other, "nbr").select(
        F.col("node").alias("entity_id"), "relation_id", label.alias("label"), "target_slug", "outgoing")


def connected(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """``(entity_id, connected_id)``: itself and both ends of its relations, distinct."""
    own = entities.select("entity_id", F.col("entity_id").alias("connected_id"))
    return own.unionByName(adjacency(relations).select(
        F.col("node").alias("entity_id"), F.col("nbr").alias("connected_id"))).distinct()
