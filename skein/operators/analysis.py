"""Graph analysis over a published graph: views, PageRank, communities, cohesion and surprising connections.

Iterations keep the edges where they are: they are staged in buckets by the end that is looked up, so a round moves the
vector of nodes only, and its sums are added up before they are shuffled. No node's edges, no community and no graph has to fit one
task: hubs are salted over several buckets. Every round is a staged table, so a lost executor costs one round at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.session import discard, stage, stage_bucketed

HUB_EDGES = 100_000  # edges of one node in one bucket; more are salted
DAMPING, TOLERANCE, MAX_ROUNDS = 0.85, 1e-6, 100
SURPRISING = 50


@dataclass(frozen=True)
class View:
    """``nodes (entity_id)``, ``directed (src, dst, weight)`` without loops, ``undirected (a, b)`` with a < b, once each."""

    nodes: DataFrame
    directed: DataFrame
    undirected: DataFrame


def graph_view(entities: DataFrame, relations: DataFrame) -> View:
    """The published graph: parallel relations add up to a weight, loops are dropped, isolated entities stay."""
    nodes = stage(entities.where("status = 'published'").select("entity_id").distinct(), "view-nodes")
    pairs = relations.where("status = 'published' and source_entity_id <> target_entity_id").groupBy(
        F.col("source_entity_id").alias("src"), F.col("target_entity_id").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    for end in ("src", "dst"):
        pairs = pairs.join(nodes.select(F.col("entity_id").alias(end)), end, "left_semi")
    directed = stage(pairs.select("src", "dst", "weight"), "view-directed")
    undirected = directed.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return View(nodes, directed, stage(undirected, "view-undirected"))


def _salted(edges: DataFrame, end: str, name: str, hub_edges: int) -> tuple[DataFrame, DataFrame]:
    """``edges`` in buckets by ``end``, those of a hub by a salt too, and ``(end, salts)`` of the hubs."""
    hubs = edges.groupBy(end).agg(F.ceil(F.count(F.lit(1)) / hub_edges).cast("int").alias("salts")).where("salts > 1")
    other = [c for c in edges.columns if c != end]
    salt = F.pmod(F.xxhash64(*other), F.coalesce("salts", F.lit(1))).cast("int")
    return stage_bucketed(edges.join(hubs, end, "left").withColumn("salt", salt).drop("salts"), name, end, "salt"), hubs


def pagerank(view: View, damping: float = DAMPING, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS, hub_edges: int = HUB_EDGES) -> DataFrame:
    """``(entity_id, rank)`` by power iteration over weighted directed edges; ranks of nodes without out-edges go to all nodes.

    Stops once a round changes all ranks together by less than ``tolerance`` times the number of nodes, or after ``max_rounds``.
    """
    n = view.nodes.count()
    if n == 0:
        return view.nodes.select("entity_id", F.lit(0.0).alias("rank"))
    out = view.directed.groupBy(F.col("src").alias("entity_id")).agg(F.sum("weight").alias("out"))
    shares = view.directed.join(out.withColumnRenamed("entity_id", "src"), "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share"))
    edges, hubs = _salted(shares, "src", "rank-edges", hub_edges)
    ranks = view.nodes.join(out, "entity_id", "left").join(hubs.withColumnRenamed("src", "entity_id"), "entity_id", "left").select(
        "entity_id", F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("before"), F.col("out").isNull().alias("dangling"), F.coalesce("salts", F.lit(1)).alias("salts"))
    ranks = stage(ranks, "ranks")
    lost = F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))
    mass = ranks.agg(lost).first()[0]
    for _ in range(max_rounds):
        going = ranks.where("not dangling").select(F.col("entity_id").alias("src"), "rank", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        got = edges.join(going, ["src", "salt"]).groupBy(F.col("dst").alias("entity_id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = F.lit((1 - damping) / n + damping * mass / n) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
        new = stage(ranks.join(got, "entity_id", "left").select("entity_id", rank.alias("rank"), F.col("rank").alias("before"), "dangling", "salts"), "ranks")
        discard(ranks)
        ranks = new
        mass, change = ranks.agg(lost, F.sum(F.abs(F.col("rank") - F.col("before")))).first()
        if change < n * tolerance:
            break
    discard(edges)
    return ranks.select("entity_id", "rank")


# --- communities -----------------------------------------------------------------------------------------------------------


def _proposals(edges: DataFrame, labels: DataFrame, double_m: float) -> DataFrame:
    """The best move of each node that gains: ``(node, com, k, to, gain, w_to, w_own, tot_to, tot_own)``; gains are those of modularity times m."""
    totals = labels.groupBy("com").agg(F.sum("k").alias("tot"))
    going = labels.select(F.col("node").alias("v"), F.col("com").alias("to"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    near = edges.join(going, ["v", "salt"]).groupBy(F.col("u").alias("node"), "to").agg(F.sum("w").alias("w"))
    own = labels.select("node", "com", "k").join(totals.select("com", F.col("tot").alias("tot_own")), "com")
    met = near.join(own, "node").join(totals.select(F.col("com").alias("to"), F.col("tot").alias("tot_to")), "to")
    score = F.when(F.col("to") != F.col("com"), F.struct(
        F.round(F.col("w") - F.col("k") * F.col("tot_to") / double_m, 9).alias("s"), (-F.col("to")).alias("t"), F.col("w").alias("w_to"), "tot_to"))
    best = met.groupBy("node", "com", "k", "tot_own").agg(F.max(score).alias("best"), F.coalesce(F.sum(F.when(F.col("to") == F.col("com"), F.col("w"))), F.lit(0.0)).alias("w_own"))
    gain = F.round(F.col("best.s") - F.col("w_own") + F.col("k") * (F.col("tot_own") - F.col("k")) / double_m, 9)
    return best.where("best is not null").select("node", "com", "k", (-F.col("best.t")).alias("to"), gain.alias("gain"), F.col("best.w_to").alias("w_to"), "w_own",
                                                 F.col("best.tot_to").alias("tot_to"), "tot_own").where(F.col("gain") > 1e-8)


def _settled(moves: DataFrame, double_m: float, turn: int) -> DataFrame:
    """The moves that raise modularity together: ``(node, to)``.

    Handshake: a community takes nodes in if the best move into it is better than the best out of it, else it gives nodes away; only
    moves from a giver to a taker stay. They have a common order: moves that are the best of both their communities, then classes of
    gain, then a hash whose first groups are few. A move is taken if it still gains after all of its own and earlier groups that join
    or leave the same communities; edges between nodes that move together can only add to that. So sums of groups suffice, some
    hundreds for a community, no round lowers modularity, and the best move of all is always taken.
    """
    ordered = stage(moves.withColumn("best", F.struct("gain", (-F.col("node")).alias("n"))), "moves")
    ends = F.array(F.struct(F.col("com").alias("c"), F.col("best").alias("out"), F.lit(None).cast("struct<gain:double,n:bigint>").alias("into")),
                   F.struct(F.col("to").alias("c"), F.lit(None).cast("struct<gain:double,n:bigint>").alias("out"), F.col("best").alias("into")))
    roles = ordered.select(F.explode(ends).alias("e")).groupBy("e.c").agg(F.max("e.out").alias("out"), F.max("e.into").alias("into"))
    takes = F.col("out").isNull() | (F.col("into") > F.col("out"))
    roles = roles.withColumn("takes", F.coalesce(takes, F.lit(False)))
    givers = roles.where("not takes").select(F.col("c").alias("com"), F.col("out").alias("best_out"))
    takers = roles.where("takes").select(F.col("c").alias("to"), F.col("into").alias("best_in"))
    first = (F.col("best") == F.col("best_out")) & (F.col("best") == F.col("best_in"))
    gain_class = F.greatest(F.lit(-30), F.least(F.lit(30), F.floor(F.log2("gain"))))
    luck = F.floor(F.log2(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) + 1))
    place = F.when(first, F.lit(-10_000)).otherwise(-gain_class * 32 + luck).cast("int")
    going = stage(ordered.join(givers, "com").join(takers, "to").withColumn("place", place), "moves")

    def until(key: str, out: str) -> DataFrame:
        sums = going.groupBy(key, "place").agg(F.sum("k").alias("k_sum"))
        return sums.select(key, "place", F.sum("k_sum").over(Window.partitionBy(key).orderBy("place")).alias(out))

    k = F.col("k")
    # the joiners and leavers of a move's own group count with it, but for the move itself
    still = F.col("w_to") - k * (F.col("tot_to") + F.col("joined") - k) / double_m - F.col("w_own") + k * (F.col("tot_own") - F.col("gone")) / double_m
    both = going.join(until("to", "joined"), ["to", "place"]).join(until("com", "gone"), ["com", "place"])
    return both.where(still > 1e-9).select("node", "to")


def _local_moving(edges: DataFrame, labels: DataFrame, double_m: float, rounds: int, least: float) -> DataFrame:
    for turn in range(rounds):
        moves = _settled(_proposals(edges, labels, double_m), double_m, turn)
        new = stage(labels.drop("moved").join(moves, "node", "left").select(
            "node", F.coalesce("to", "com").alias("com"), "k", "salts", F.col("to").isNotNull().alias("moved")), "labels")
        discard(labels)
        labels = new
        moved, n = labels.agg(F.count(F.when(F.col("moved"), 1)), F.count(F.lit(1))).first()
        if moved <= least * n:
            break
    return labels


def communities(view: View, rounds: int = 24, levels: int = 10, least: float = 0.02, hub_edges: int = HUB_EDGES) -> DataFrame:
    """``(entity_id, community_id)``: local moving for modularity, then contraction of communities to nodes, level after level.

    A level ends when no more than the share ``least`` of its nodes moved in a round, or after ``rounds``; the last level is one that
    merges nothing. A community is named by its smallest entity. Isolated entities stay alone. Reruns give equal rows.
    """
    members = view.nodes.select("entity_id", F.col("entity_id").alias("node"))
    edges = view.undirected.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"))
    edges = edges.select("e.u", "e.v", F.lit(1.0).alias("w"))
    weights = edges.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"))
    nodes = view.nodes.select(F.col("entity_id").alias("node")).join(weights, "node", "left").select("node", F.coalesce("k", F.lit(0.0)).alias("k"))
    double_m = nodes.agg(F.sum("k")).first()[0] or 0.0
    for _ in range(levels if double_m else 0):
        bucketed, hubs = _salted(edges, "v", "community-edges", hub_edges)
        start = nodes.join(hubs.withColumnRenamed("v", "node"), "node", "left").select("node", F.col("node").alias("com"), "k", F.coalesce("salts", F.lit(1)).alias("salts"))
        labels = _local_moving(bucketed, stage(start, "labels"), double_m, rounds, least)
        merged = labels.where("node <> com").limit(1).count()
        if not merged:
            discard(bucketed, labels)
            break
        members = stage(members.join(labels.select("node", "com"), "node").select("entity_id", F.col("com").alias("node")), "members")
        nodes = stage(labels.groupBy(F.col("com").alias("node")).agg(F.sum("k").alias("k")), "community-nodes")
        ends = [labels.select(F.col("node").alias(e), F.col("com").alias(f"c_{e}")) for e in ("u", "v")]
        edges = stage(edges.join(ends[0], "u").join(ends[1], "v").where("c_u <> c_v").groupBy(F.col("c_u").alias("u"), F.col("c_v").alias("v")).agg(F.sum("w").alias("w")),
                      "contracted")
        discard(bucketed, labels)
    named = members.groupBy("node").agg(F.min("entity_id").alias("community_id"))
    return members.join(named, "node").select("entity_id", "community_id")


def modularity(members: DataFrame, undirected: DataFrame) -> DataFrame:
    """One row ``modularity`` of a partition of the undirected graph; null without edges."""
    ends = undirected.select(F.explode(F.array("a", "b")).alias("entity_id")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("k"))
    totals = ends.join(members, "entity_id").groupBy("community_id").agg(F.sum("k").alias("tot"))
    inside = _inside(members, undirected).where("same").groupBy(F.col("community_a").alias("community_id")).agg(F.count(F.lit(1)).alias("inner"))
    m = undirected.count()
    part = F.coalesce("inner", F.lit(0)) / F.lit(m) - F.pow(F.col("tot") / F.lit(2 * m), 2)
    return totals.join(inside, "community_id", "left").agg(F.sum(part).alias("modularity"))


def _inside(members: DataFrame, undirected: DataFrame) -> DataFrame:
    ends = [members.select(F.col("entity_id").alias(e), F.col("community_id").alias(f"community_{e}")) for e in ("a", "b")]
    return undirected.join(ends[0], "a").join(ends[1], "b").withColumn("same", F.col("community_a") == F.col("community_b"))


def cohesion(members: DataFrame, undirected: DataFrame) -> DataFrame:
    """``(community_id, n_members, n_edges, cohesion)``: share of the possible inner edges that exist, 0 below two members."""
    sizes = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("n_members"))
    inner = _inside(members, undirected).where("same").groupBy(F.col("community_a").alias("community_id")).agg(F.count(F.lit(1)).alias("n_edges"))
    n = F.col("n_members")
    share = F.when(n > 1, F.lit(2.0) * F.col("n_edges") / (n * (n - 1))).otherwise(F.lit(0.0))
    return sizes.join(inner, "community_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0))).withColumn("cohesion", share)


def surprise(rank_u: Column, rank_v: Column, cohesion_u: Column, cohesion_v: Column) -> Column:
    return rank_u * rank_v * (F.lit(1.0) - (cohesion_u + cohesion_v) / 2)


def surprising_connections(view: View, ranks: DataFrame, members: DataFrame, k: int = SURPRISING) -> DataFrame:
    """The ``k`` directed edges between communities with the greatest surprise: ``(place, src, dst, surprise, reason)``.

    Surprise is rounded to 15 digits before it orders the edges, ties go to the smaller ids. Each partition keeps its best ``k`` first.
    """
    told = members.join(cohesion(members, view.undirected), "community_id").join(ranks, "entity_id")
    ends = [told.select(F.col("entity_id").alias(e), F.col("rank").alias(f"rank_{e}"), F.col("community_id").alias(f"community_{e}"), F.col("cohesion").alias(f"cohesion_{e}"))
            for e in ("src", "dst")]
    edges = view.directed.join(ends[0], "src").join(ends[1], "dst").where("community_src <> community_dst")
    value = F.round(surprise(*[F.col(c) for c in ("rank_src", "rank_dst", "cohesion_src", "cohesion_dst")]), 15)
    reason = F.concat(F.lit("bridge between community "), F.col("community_src"), F.lit(" and community "), F.col("community_dst"))
    best = edges.select("src", "dst", value.alias("surprise"), reason.alias("reason")).orderBy(F.col("surprise").desc(), "src", "dst").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.col("surprise").desc(), "src", "dst")).alias("place"), "src", "dst", "surprise", "reason")


def analyse(entities: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """One analysis run: ``community_members``, ``community_summaries``, ``surprising_connections``, each of them staged."""
    view = graph_view(entities, relations)
    ranks, members = pagerank(view), stage(communities(view), "members")
    return {
        "community_members": stage(members.join(ranks, "entity_id").select("entity_id", "community_id", F.col("rank").alias("pagerank_score")), "analysis"),
        "community_summaries": stage(cohesion(members, view.undirected), "analysis"),
        "surprising_connections": stage(surprising_connections(view, ranks, members), "analysis"),
    }
