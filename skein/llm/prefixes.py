"""Prefix trie of conversations: what they share from their first turn on, built as ternary search trees on range shards.

Turns are dictionary-encoded: each distinct (role, text) has a whole number. A conversation is a sequence of such numbers, equal
sequences are one with a count. Sequences are dealt in ranges of their order, and a task cuts its range into shards of bounded size. A
shard inserts its sequences into a ternary search tree, the median of a range first, so that the siblings of a node form a
balanced search tree; an iterative traversal gives the nodes in order and sums members, leaves and savings from the last one back.
A node inside a shard is complete; only those on the way to the shard's first and last sequence can go on in another shard. They are
merged by their key, and the merged ones add what they hold to the nodes above them.

Long conversations are cut into segments of ``SEGMENT`` turns, which are sequences below the node where the last segment ended;
deeper segments are worked off first and hang their sums on the end of the one above. So no row or shard grows with a conversation.
The key of a node is a digest of the numbers on its path.
"""

from __future__ import annotations

from collections.abc import Iterator
import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.llm.common import partitions, ready, running_start
from skein.session import stage

SEGMENT = 512  # turns of one sequence
SHARD_TURNS = 200_000  # turns of one shard's tree
ROOT = ""


def step(key: str, turn: int) -> str:
    """The key of the child that ``turn`` leads to."""
    return hashlib.md5(f"{key}/{turn}".encode()).hexdigest()


def _path_end(start: Column, turns: Column) -> Column:
    return F.aggregate(turns, start, lambda key, turn: F.md5(F.concat(key, F.lit("/"), turn.cast("string")).cast("binary")))


class TernaryTree:
    """Ternary search tree over sequences of whole numbers; ``after`` is the eq link, under it a search tree of the next numbers."""

    def __init__(self) -> None:
        self.turn, self.less, self.more, self.after, self.above = [-1], [-1], [-1], [-1], [-1]

    def _child(self, node: int, turn: int) -> int:
        at = self.after[node]
        if at < 0:
            self.after[node] = self._new(node, turn)
            return self.after[node]
        while self.turn[at] != turn:
            side = self.less if turn < self.turn[at] else self.more
            if side[at] < 0:
                side[at] = self._new(node, turn)
            at = side[at]
        return at

    def _new(self, above: int, turn: int) -> int:
        for values, value in ((self.turn, turn), (self.less, -1), (self.more, -1), (self.after, -1), (self.above, above)):
            values.append(value)
        return len(self.turn) - 1

    def insert(self, sequence: list[int]) -> int:
        """The node where ``sequence`` ends."""
        node = 0
        for turn in sequence:
            node = self._child(node, turn)
        return node

    def insert_sorted(self, sequences: list[list[int]]) -> list[int]:
        """Insert sorted sequences, the middle one of each range first; the end node of each."""
        ends = [0] * len(sequences)
        ranges = [(0, len(sequences))]
        while ranges:
            low, high = ranges.pop()
            if low < high:
                middle = (low + high) // 2
                ends[middle] = self.insert(sequences[middle])
                ranges += [(low, middle), (middle + 1, high)]
        return ends

    def in_order(self) -> list[int]:
        """All nodes, each before those below it, siblings by rising number."""
        order, stack = [], [(0, True)]
        while stack:
            node, opened = stack.pop()
            if node < 0:
                continue
            if opened and node:  # first what is less, then the node itself, then what is more
                stack += [(self.more[node], True), (node, False), (self.less[node], True)]
            else:
                order.append(node)
                stack.append((self.after[node], True))
        return order


_NODE = ("key string, parent_key string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, size long, shared boolean, path array<string>")


def _nodes_of(group: list[tuple], first_depth: int, shared_first: bool, shared_last: bool) -> Iterator[tuple]:
    """Node rows of one tree. ``group`` has equal starts: ``(start, turns, sizes, n, smallest, children, leaves, saved)``, in order of turns."""
    tree = TernaryTree()
    ends = tree.insert_sorted([row[1] for row in group])
    n = len(tree.turn)
    members, smallest, children, leaves, saved, size = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for node, row in zip(ends, group):
        # what hangs below the end of a segment: its further segments
        children[node], leaves[node], saved[node] = row[5], row[6], row[7]
        members[node], smallest[node] = row[3], row[4]
        for turn_size in reversed(row[2]):
            if size[node]:
                break
            size[node] = turn_size
            node = tree.above[node]
    shared = {0}
    for wanted, end in ((shared_first, ends[0]), (shared_last, ends[-1])):
        while wanted and end > 0:
            shared.add(end)
            end = tree.above[end]
    order = tree.in_order()
    for node in reversed(order[1:]):
        up = tree.above[node]
        members[up] += members[node]
        smallest[up] = smallest[node] if smallest[up] is None else min(smallest[up], smallest[node])
        if node not in shared:
            leaves[node] = leaves[node] or 1
            saved[node] += (members[node] - 1) * size[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    keys, depth, paths = [""] * n, [first_depth] * n, {}
    for node in order:
        up = tree.above[node]
        if node:
            keys[node], depth[node] = step(keys[up], tree.turn[node]), depth[up] + 1
        else:
            keys[0] = group[0][0]
        if node in shared:
            paths[node] = [*paths[up], keys[node]] if node else [keys[0]]
        yield (keys[node], keys[up] if node else None, depth[node], smallest[node], None if up < 0 or up in shared else smallest[up], members[node],
               children[node], leaves[node], saved[node], size[node], node in shared, paths.get(node))


def _shards(first_depth: int, shard_turns: int):
    columns = [c.split()[0] for c in _NODE.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        return out.astype({c: "Int64" for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size")})

    def solve(shard: list[tuple]) -> Iterator[pd.DataFrame]:
        at = 0
        while at < len(shard):  # sequences below one start are a tree
            end = at
            while end < len(shard) and shard[end][0] == shard[at][0]:
                end += 1
            rows = []
            for row in _nodes_of(shard[at:end], first_depth, at == 0, end == len(shard)):
                rows.append(row)
                if len(rows) == 10_000:
                    yield frame(rows)
                    rows = []
            yield frame(rows)
            at = end

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, turns = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                shard.append((r.start, r.turns.tolist(), r.sizes.tolist(), r.n, r.smallest, r.children, r.leaves, r.saved))
                turns += len(shard[-1][1]) + 1
                if turns >= shard_turns:
                    yield from solve(shard)
                    shard, turns = [], 0
        if shard:
            yield from solve(shard)

    return run


def _merge(nodes: DataFrame, level: int) -> DataFrame:
    """The shared nodes of a level, each once, with the sums of everything below it."""
    part = nodes.where("shared")
    once = part.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("size").alias("size"),
        F.max("path").alias("path"))
    once = stage(once, "prefix-shared")
    below = once.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("outer"))
    total = once.join(below, "key", "left").withColumn("n_children", F.col("inner") + F.coalesce("outer", F.lit(0)))
    # the top of a deeper segment is the end of the one above: counted there
    top = F.lit(level > 0) & F.col("parent_key").isNull()
    own = total.withColumn("leaves", F.when((F.col("n_children") == 0) & ~top, F.lit(1)).otherwise(F.col("leaves")))
    own = own.withColumn("saved", F.col("saved") + F.when(top, F.lit(0)).otherwise((F.col("n_convs") - 1) * F.col("size")))
    sums = own.select(F.explode("path").alias("key"), "leaves", "saved").groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    return stage(own.drop("leaves", "saved").join(sums, "key"), "prefix-merged")


def encode(conversations: DataFrame) -> DataFrame:
    """``(conv_id, at, turn_id, size)``: turns in order, numbered from 0 within their conversation, with dictionary numbers and code points."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    turns = ready(conversations).where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *text, F.lit(1).alias("one"))
    # the role's length tells where it ends
    name = F.sha2(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "UTF-8"), 256)
    placed = running_start(turns, ["conv_id"], ["turn", "role", "text"], "one", "at", "prefix-turns").select(
        "conv_id", F.col("at").cast("long").alias("at"), name.alias("name"), F.length("text").cast("long").alias("size"))
    placed = stage(placed, "prefix-placed")
    dictionary = stage(placed.groupBy("name").agg(F.first("size").alias("size")).withColumn("turn_id", F.monotonically_increasing_id()), "prefix-dictionary")
    return placed.join(dictionary.select("name", "turn_id"), "name").select("conv_id", "at", "turn_id", "size")


def graft(turns: DataFrame, prefix_of: Column, length: Column, longest: int) -> DataFrame:
    """Encoded turns of each conversation rebuilt: the first ``length`` turns of conversation ``prefix_of``, then its own after as many.

    Both are expressions of ``conv_id``; ``longest`` bounds ``length``. A conversation left without turns has one row with null turns.
    """
    turn = F.struct("at", "turn_id", "size")
    heads = turns.where(F.col("at") < longest).groupBy(F.col("conv_id").alias("head_id")).agg(F.sort_array(F.collect_list(turn)).alias("head"))
    convs = turns.where("at = 0").select("conv_id", prefix_of.alias("head_id"), length.alias("taken"))
    known = stage(convs.join(heads, "head_id", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("taken"))),
                  "prefix-heads")
    first = known.select("conv_id", F.explode_outer("head").alias("x")).select("conv_id", "x.at", "x.turn_id", "x.size")
    own = turns.join(known.select("conv_id", "taken", F.size("head").alias("before")), "conv_id").where(F.col("at") >= F.col("taken"))
    own = own.select("conv_id", (F.col("at") - F.col("taken") + F.col("before")).alias("at"), "turn_id", "size")
    return first.unionByName(own)


def _segments(turns: DataFrame, segment: int) -> DataFrame:
    """``(conv_id, level, turns, sizes)``; a conversation without turns has an empty one."""
    turn = F.struct("at", "turn_id", "size")
    level = F.coalesce(F.floor(F.col("at") / segment), F.lit(0)).cast("int")
    listed = turns.groupBy("conv_id", level.alias("level")).agg(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), turn))).alias("x"))
    return stage(listed.select("conv_id", "level", F.col("x.turn_id").alias("turns"), F.col("x.size").alias("sizes")), "prefix-segments")


def _ends_digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of comma-joined ids for each key, over rows in order of (key, id); only the running digest is held."""
    held, digest = None, None
    for batch in batches:
        out = []
        for key, conv_id in zip(batch["key"], batch["conv_id"]):
            if key != held:
                if held is not None:
                    out.append((held, digest.hexdigest()))
                held, digest = key, hashlib.sha256(str(conv_id).encode())
            else:
                digest.update(f",{conv_id}".encode())
        yield pd.DataFrame(out, columns=["key", "ends_sha256"])
    if held is not None:
        yield pd.DataFrame([(held, digest.hexdigest())], columns=["key", "ends_sha256"])


def prefix_trie(turns: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct prefix of the conversations in encoded ``turns`` (as ``encode`` or ``graft`` gives them).

    ``conv_id`` smallest member, ``depth``, ``parent_conv_id``, ``n_convs`` members, ``n_children``, ``n_leaves``, ``saved_tokens`` (code
    points that a cache of the shared turns saves in the subtree), ``ends_sha256`` over the members that end here. The root has depth 0 and
    no parent; an empty table has no nodes.
    """
    segments = _segments(turns, segment)
    levels = (segments.agg(F.max("level")).first()[0] or 0) + 1
    at, starts = [], segments.where("level = 0").select("conv_id", F.lit(ROOT).alias("start"))
    for level in range(levels):
        here = segments.where(F.col("level") == level).join(starts, "conv_id") if level else segments.where("level = 0").withColumn("start", F.lit(ROOT))
        at.append(stage(here.select("conv_id", "start", "turns", "sizes", _path_end(F.col("start"), F.col("turns")).alias("end")), "prefix-level"))
        starts = at[-1].where(F.size("turns") == segment).select("conv_id", F.col("end").alias("start"))
    found, below = [], None
    for level in reversed(range(levels)):
        distinct = at[level].groupBy("end").agg(F.first("start").alias("start"), F.first("turns").alias("turns"), F.first("sizes").alias("sizes"),
                                                F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("smallest"))
        hung = [F.coalesce(F.col(c), F.lit(0)).alias(out) for c, out in (("n_children", "children"), ("n_leaves", "leaves"), ("saved_tokens", "saved"))]
        joined = distinct.join(below, "end", "left") if below is not None else distinct.withColumns({c: F.lit(0).cast("long") for c in ("n_children", "n_leaves", "saved_tokens")})
        ordered = joined.select("start", "turns", "sizes", "n", "smallest", *hung).repartitionByRange(partitions(turns), "start", "turns").sortWithinPartitions("start", "turns")
        nodes = stage(ordered.mapInPandas(_shards(level * segment, shard_turns), _NODE), "prefix-nodes")
        merged = _merge(nodes, level)
        if level:
            below = merged.where("parent_key is null").select(F.col("key").alias("end"), "n_children", "n_leaves", "saved_tokens")
        found.append((nodes, merged, level))
    columns = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    out = None
    for nodes, merged, level in found:
        # parents that are shared, the ends of the segments above among them, are looked up by key
        inner = nodes.where("not shared").select("parent_key", *columns)
        outer = merged.where("parent_key is not null" if level else "true").withColumn("parent_conv_id", F.lit(None).cast("long")).select("parent_key", *columns)
        parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("__parent"))
        if level:  # the top of deeper segments stands for those that go on only
            ended = at[level - 1].where(F.size("turns") == segment).groupBy(F.col("end").alias("parent_key")).agg(F.min("conv_id").alias("__parent"))
            parents = parents.join(ended.select("parent_key"), "parent_key", "left_anti").unionByName(ended)
        rows = inner.unionByName(outer).join(parents, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "__parent")).select(*columns)
        out = rows if out is None else out.unionByName(rows)
    last = [rows.select("conv_id", F.col("end").alias("key")) for rows in (
        at[i].join(at[i + 1].select("conv_id"), "conv_id", "left_anti") if i + 1 < levels else at[i] for i in range(levels))]
    ends = last[0]
    for rows in last[1:]:
        ends = ends.unionByName(rows)
    digests = ends.repartition(partitions(turns), "key").sortWithinPartitions("key", "conv_id").mapInPandas(_ends_digest, "key string, ends_sha256 string")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)).drop("key")
