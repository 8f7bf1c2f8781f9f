"""Exact top-k inner products over an impact-ordered index, read score at a time.

Equal vectors are one class with its first ``k + 1`` rows, which is all a list of k can need. Classes are cut into blocks; the index of
a block holds postings (vector, component) in segments of equal quantised impact, the bit length of the component, and within such a
segment by dimension. A chunk of queries reads the segments of all dimensions from the greatest impact down. What is not read yet of a
vector adds at most its length without the components read, times the length of the query: that is the proof. Reading stops only once
the proof leaves few possible members, or once all is read; those are scored again exactly.

A query first searches the block of its own vector; the score of its last place there is the floor under which no other block needs to
prove anything. Every query meets every block: no vector is left out by a guess. They meet in cells of a few blocks and a share of the
queries, so an index moves once for each share and a query once for each few blocks, not once for each chunk and block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.llm.common import ready
from skein.session import fan_out, stage

BLOCK = 4096  # classes of one block
CHUNK = 256  # queries that are searched at once
CELL_BLOCKS, CELL_QUERIES = 16, 1 << 15  # blocks and queries that meet in one task
SHARE = 24  # reading stops once one in so many (query, vector) pairs is possible: scoring those is cheaper than reading on
LARGEST = 1 << 24  # whole numbers beyond this could overflow sums


def whole(embedding: Column, scale: int = 64) -> Column:
    """``floor(scale * x)`` of each component, or null for a vector that is null or holds a null, endless or huge component."""
    x = F.transform(embedding, lambda v: v.cast("double") * F.lit(float(scale)))
    # a comparison with NaN or null is never true of this range
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float(LARGEST))))
    return F.when(fit, F.transform(x, lambda v: F.floor(v).cast("int")))


def _bytes(vectors: np.ndarray) -> bytes:
    return np.ascontiguousarray(vectors, np.int32).tobytes()


def build_index(vectors: np.ndarray) -> dict[str, bytes]:
    """Postings of one block by falling quantised impact, then dimension; ``segments`` has (level, dimension, end) of each segment."""
    vec, dim = np.nonzero(vectors)
    value = vectors[vec, dim]
    level = np.frexp(np.abs(value).astype(np.float64))[1]  # bit length
    order = np.lexsort((vec, dim, -level))
    vec, dim, value, level = vec[order], dim[order], value[order], level[order]
    ends = np.flatnonzero(np.diff(level * (1 << 20) + dim, append=-1)) + 1 if len(level) else np.zeros(0, np.int64)
    return {"postings": _bytes(vec), "impacts": _bytes(value), "segments": _bytes(np.stack([level[ends - 1], dim[ends - 1], ends], axis=1)),
            "vectors": _bytes(vectors)}


class Block:
    """The index of one block, opened for searching."""

    def __init__(self, index: dict[str, bytes], n: int) -> None:
        self.n = n
        self.vectors = np.frombuffer(index["vectors"], np.int32).reshape(n, -1).astype(np.float64)
        postings, impacts = np.frombuffer(index["postings"], np.int32), np.frombuffer(index["impacts"], np.int32)
        segments = np.frombuffer(index["segments"], np.int32).reshape(-1, 3)
        dims = np.repeat(segments[:, 1], np.diff(segments[:, 2], prepend=0))
        self.levels, left = [], (self.vectors ** 2).sum(axis=1)
        start = 0
        for level in sorted(set(segments[:, 0].tolist()), reverse=True):
            end = int(segments[segments[:, 0] == level, 2].max())
            plane = np.zeros((n, self.vectors.shape[1]))
            plane[postings[start:end], dims[start:end]] = impacts[start:end]
            left = left - (plane ** 2).sum(axis=1)
            self.levels.append((plane, np.sqrt(np.maximum(left, 0))))
            start = end

    def search(self, queries: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """``(query numbers, vector numbers, exact scores, levels read)`` of all pairs that can be among a query's k best and reach its floor."""
        queries = queries.astype(np.float64)
        got = np.zeros((len(queries), self.n))
        lengths = np.sqrt((queries ** 2).sum(axis=1))[:, None]
        needed, possible, read = floors[:, None].astype(np.float64), np.ones(got.shape, bool), 0
        for plane, rest in self.levels:
            got += queries @ plane.T
            read += 1
            # Cauchy-Schwarz over the components not read yet; scores are whole numbers, so rounding is far below the slack
            left = lengths * rest[None, :] * (1 + 1e-9) + 1e-3
            if self.n > k:
                needed = np.maximum(needed, np.partition(got - left, self.n - k, axis=1)[:, self.n - k][:, None])
            possible = got + left >= needed
            if np.count_nonzero(possible) * SHARE <= possible.size:
                break
        rows, at = np.nonzero(possible)
        scores = np.empty(len(rows), np.int64)
        for cut in range(0, len(rows), 1 << 16):
            part = slice(cut, cut + (1 << 16))
            scores[part] = np.rint(np.einsum("ij,ij->i", queries[rows[part]], self.vectors[at[part]]))
        return rows, at, scores, read


_FOUND = "query_class long, class_id long, score long, read long"
_INDEX = "block int, classes array<long>, firsts array<long>, postings binary, impacts binary, segments binary, vectors binary"


def _search_cell(k: int, at_home: bool):
    """The k best classes of each query in a cell; with ``at_home`` queries meet the block they come from, else all others."""
    def run(queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        none = tuple(np.zeros(0, np.int64) for _ in range(4))  # query number, score, smallest id and class
        vectors = np.stack(queries["v"].to_numpy()) if len(queries) else None
        homes, floors = queries["home"].to_numpy(), queries["floor"].to_numpy(copy=True)
        chunks = [np.arange(start, min(start + CHUNK, len(queries))) for start in range(0, len(queries), CHUNK)]
        held, read = [none] * len(chunks), [0] * len(chunks)
        for row in index.itertuples(index=False) if chunks else ():
            block = Block(row._asdict(), len(row.classes))
            for i, chunk in enumerate(chunks):
                some = chunk[(homes[chunk] == row.block) == at_home]
                if not len(some):
                    continue
                rows, at, scores, levels = block.search(vectors[some], k, floors[some])
                reached = scores >= floors[some][rows]
                rows, at, scores = some[rows[reached]], at[reached], scores[reached]
                every = tuple(np.concatenate(x) for x in zip(held[i], (rows, scores, row.firsts[at], row.classes[at])))
                # a row among the k best is of a class among the k best by score and smallest id
                order = np.lexsort((every[2], -every[1], every[0]))
                place = np.arange(len(order)) - np.searchsorted(every[0][order], every[0][order])
                held[i] = tuple(x[order[place < k]] for x in every)
                last = order[place == k - 1]  # what a class of the blocks to come has to reach
                floors[every[0][last]] = np.maximum(floors[every[0][last]], every[1][last])
                read[i] += levels
        query, score, _, found = (np.concatenate(x) for x in zip(none, *held))
        return pd.DataFrame({"query_class": queries["class_id"].to_numpy()[query], "class_id": found, "score": score,
                             "read": np.repeat(np.array(read, np.int64), [len(h[0]) for h in held])})

    return run


def _index_block(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("class_id")
    return pd.DataFrame([{"block": group["block"].iloc[0], "classes": group["class_id"].tolist(), "firsts": group["first"].tolist(),
                          **build_index(np.stack(group["v"].to_numpy()).astype(np.int32))}])


def cells_of(queries: int, blocks: int, tasks: int) -> tuple[int, int]:
    """Groups of blocks and shares of queries: bounded cells, as many as keep ``tasks`` busy, with little copying."""
    groups, shares = -(-blocks // CELL_BLOCKS), max(1, -(-queries // CELL_QUERIES))
    while groups * shares < tasks:
        # an index block is about as large as 3 BLOCK queries
        if groups < blocks and queries * groups <= 3 * BLOCK * blocks * shares:
            groups = min(2 * groups, blocks)
        elif queries > shares * CHUNK:
            shares *= 2
        else:
            break
    return groups, shares


def _cells(queries: DataFrame, index: DataFrame, k: int, at_home: bool, name: str) -> DataFrame:
    """Search the (queries, blocks) cells, dealt over tasks by both."""
    keys = ["cell_group", "cell_share"]
    sides = [fan_out(df, *keys).groupBy(*keys) for df in (queries, index)]
    return stage(sides[0].cogroup(sides[1]).applyInPandas(_search_cell(k, at_home), _FOUND), name)


def exact_top_k(vectors: DataFrame, k: int = 20, query_step: int = 20, scale: int = 64, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row whose vec_id divides by ``query_step`` the k best of all other rows.

    Vectors that are null, or hold null, non-finite or huge (2^24 after scaling) components take no part, nor do rows without id.
    Shorter vectors count as filled up with zeros. Ties go to the smaller vec_id. Rows that repeat are candidates of their own, also
    for each other; a query leaves out one row of its own id and vector. A table of one row gives no rows. Other columns are not read.
    """
    rows = ready(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), scale).alias("v"))
    rows = stage(rows.where("vec_id is not null and v is not null"), "impact-rows")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(width) - F.size("v"))))
    asked = F.pmod("vec_id", F.lit(query_step)) == 0
    # of equal vectors only the first k + 1 rows can be in a list; the bounded window drops the rest before the shuffle
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    listed = ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asking = rows.groupBy("v").agg(F.max(asked).alias("asked"))
    classes = stage(listed.join(asking, "v").withColumn("class_id", F.monotonically_increasing_id()), "impact-classes")
    count, n_asked = classes.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    blocks = max(1, -(-count // block))
    placed = classes.withColumn("block", F.pmod(F.xxhash64("v", F.lit(11)), F.lit(blocks)).cast("int"))
    index = stage(placed.select("block", "class_id", F.col("ids")[0].alias("first"), "v").groupBy("block").applyInPandas(_index_block, _INDEX), "impact-index")
    queries = placed.where("asked").select("class_id", "v", F.col("block").alias("home"))

    own = [F.lit(0).alias("cell_share"), F.lit(float("-inf")).alias("floor")]
    home = _cells(queries.select("*", F.col("home").alias("cell_group"), *own), index.select("*", F.col("block").alias("cell_group"), own[0]), k + 1, True, "impact-near")
    # the floor of a query: the score that k + 1 rows of its own block reach
    counted = home.join(classes.select("class_id", F.size("ids").alias("n_rows")), "class_id")
    reach = Window.partitionBy("query_class").orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    floors = counted.withColumn("reach", F.sum("n_rows").over(reach)).where(F.col("reach") > k).groupBy(
        F.col("query_class").alias("class_id")).agg(F.max("score").cast("double").alias("floor"))
    known = queries.join(floors, "class_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    groups, shares = cells_of(n_asked, blocks, 2 * vectors.sparkSession.sparkContext.defaultParallelism)
    # every query meets every block; the one of its own, which it has met, is skipped
    met = known.select("*", F.pmod(F.xxhash64("v", F.lit(17)), F.lit(shares)).cast("int").alias("cell_share"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("cell_group"))
    spread = index.select("*", F.pmod("block", F.lit(groups)).alias("cell_group"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("cell_share"))
    found = home.unionByName(_cells(met, spread, k + 1, False, "impact-far")).select("query_class", "class_id", "score")
    exploded = found.join(classes.select("class_id", "ids"), "class_id").select("query_class", "class_id", "score", F.explode("ids").alias("vec_id"))
    by_score = Window.partitionBy("query_class").orderBy(F.col("score").desc(), "vec_id", "class_id")
    best = stage(exploded.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1), "impact-best")
    return _lists(rows.where(asked), classes, best, k)


def _lists(asking: DataFrame, classes: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """One list for each asking row out of its class's list, without one row of its own id and vector."""
    askers = asking.join(classes.select("v", F.col("class_id").alias("query_class")), "v").select(F.col("vec_id").alias("query_id"), "query_class")
    ordered = best.groupBy("query_class").agg(F.sort_array(F.collect_list(F.struct("n", "class_id", "score", "vec_id"))).alias("list"))

    def own(x: Column) -> Column:
        return (x["vec_id"] == F.col("query_id")) & (x["class_id"] == F.col("query_class"))

    marked = askers.join(ordered, "query_class").withColumn(
        "own", F.coalesce(F.array_min(F.transform(F.filter("list", own), lambda x: x["n"])), F.lit(k + 1)))
    kept = marked.select("query_id", F.posexplode(F.slice(F.filter("list", lambda x: x["n"] != F.col("own")), 1, k)).alias("at", "x"))
    return kept.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").cast("long").alias("score"))
