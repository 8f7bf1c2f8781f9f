"""Exact threshold self-join of vectors by cosine, in metric space.

Unit vectors of cosine >= t are at most r = sqrt(2 - 2t) apart. Vectors are dealt to cells around at most ``PIVOTS`` of them. If a vector
lies in its own cell at distance d, the triangle inequality leaves it partners only in cells whose pivot is within d + 2r of it, so it goes to
those as a guest. A cell is cut into blocks of its own vectors and chunks of all that came; a tile of both is one matrix product.
Equal vectors are a class, which is compared once; ``Close.all_pairs`` tells the pairs of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from skein.session import fan_out, stage

PIVOTS, BLOCK = 64, 2048
DEAL = 16_384  # rows that a task deals to cells at once: every vector can go to every cell
EPS = 1e-6


@dataclass(frozen=True)
class Close:
    """``pairs (a, b, similarity)`` of different vectors with a < b, by the smallest id of each, ``members (id, representative)``, and
    ``work (compared, possible)``; ``rows (class_id, id)`` are all rows, ``alike (ca, cb, similarity)`` the pairs of classes, each with itself too.
    """

    pairs: DataFrame
    members: DataFrame
    work: DataFrame
    rows: DataFrame
    alike: DataFrame

    def all_pairs(self, block: int = BLOCK) -> DataFrame:
        """``(a, b, similarity)`` of all rows with a < b, equal vectors among them.

        Rows of a class are dealt to blocks, so a class of many copies is paired block by block, in many tasks.
        """
        sizes = self.rows.groupBy("class_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
        rows = stage(self.rows.join(sizes, "class_id").select("class_id", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "id"), "close-members")
        tiles = self.alike
        for side in "ab":
            of = sizes.select(F.col("class_id").alias(f"c{side}"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(f"block_{side}"))
            tiles = tiles.join(of, f"c{side}")
        for side in "ab":
            of = rows.select(F.col("class_id").alias(f"c{side}"), F.col("block").alias(f"block_{side}"), F.col("id").alias(side))
            tiles = tiles.join(of, [f"c{side}", f"block_{side}"])
        # two rows of one class meet twice
        met = tiles.where("a < b or (a > b and ca <> cb)")
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def _units(vectors: pd.Series) -> np.ndarray:
    v = np.stack(vectors.to_numpy()).astype(np.float64)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _deal(centres: dict[int, np.ndarray], radius: float):
    """Rows of vectors to rows for each cell they go to, at most ``DEAL`` in a frame."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["v"].map(len)
            for d in sorted(set(sizes)):
                part = batch[sizes == d]
                if d not in centres:  # a dimension without a pivot is a cell of its own
                    yield pd.DataFrame({"representative": part["representative"], "v": part["v"], "cell": f"{d}", "own": True})
                    continue
                for piece in np.array_split(np.arange(len(part)), -(-len(part) * len(centres[d]) // DEAL)):
                    here = part.iloc[piece]
                    far = np.sqrt(np.maximum(2 - 2 * (_units(here["v"]) @ centres[d].T), 0))
                    home = far.argmin(axis=1)
                    at, cell = np.nonzero(far <= far.min(axis=1)[:, None] + 2 * radius + EPS)
                    yield pd.DataFrame({"representative": here["representative"].to_numpy()[at], "v": here["v"].to_numpy()[at],
                                        "cell": [f"{d}-{c}" for c in cell], "own": home[at] == cell})

    return run


def close_pairs(vectors: DataFrame, threshold: float, pivots: int = PIVOTS, block: int = BLOCK) -> Close:
    """All pairs of ``vectors (id, embedding)`` whose cosine, rounded to six digits, is ``threshold`` or more.

    Vectors that are null, of length zero, or hold a null or non-finite component have no partners, and vectors of different dimensions are
    none of each other. Copies are told by ``members``: a representative stands for itself and all its copies.
    """
    spark = vectors.sparkSession
    x = F.transform("embedding", lambda v: v.cast("double"))
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(1e150))) & F.exists(x, lambda v: v != 0)
    rows = vectors.where("id is not null").select("id", F.when(fit, x).alias("v")).where("v is not null")
    members = stage(rows.select("id", F.col("v").alias("key")), "close-rows")
    classes = stage(members.groupBy("key").agg(F.min("id").alias("representative")).select(
        F.monotonically_increasing_id().alias("class_id"), "representative", F.col("key").alias("v")), "close-classes")
    told = stage(members.join(classes, F.col("key") == F.col("v")).select("class_id", "id", "representative"), "close-told")
    radius = math.sqrt(max(0.0, 2 - 2 * (threshold - EPS))) + EPS
    # a bounded number of vectors, drawn by hash, for each dimension at most
    drawn: dict[int, list] = {}
    for (v,) in classes.orderBy(F.xxhash64("v"), "representative").select("v").limit(pivots).collect():
        drawn.setdefault(len(v), []).append(v)
    centres = {d: _units(pd.Series(vs)) for d, vs in drawn.items()}

    # a class goes by its number, because rows of one id may hold different vectors
    numbered_classes = classes.select(F.col("class_id").alias("representative"), "v")
    dealt = stage(numbered_classes.mapInPandas(_deal(centres, radius), "representative long, v array<double>, cell string, own boolean"), "close-cells")
    cells = stage(dealt.groupBy("cell").agg(F.ceil(F.count(F.when(F.col("own"), 1)) / block).cast("int").alias("blocks"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks"))
                  .where("blocks > 0"), "close-sizes")
    sized = dealt.join(cells, "cell")

    def numbered(df: DataFrame, side: str, own: str, other: str) -> DataFrame:
        share = F.pmod(F.xxhash64("representative"), F.col(own)).cast("int")
        return df.select(F.col("cell").alias(f"{side}_cell"), share.alias(f"{side}_{own}"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{side}_{other}"),
                         F.col("representative").alias("id"), F.col("v").alias("vector"))

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "similarity": [], "compared": []})
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        likeness = np.round(_units(left["vector"]) @ _units(right["vector"]).T, 6)
        # every pair meets in the cell of its smaller id
        i, j = np.nonzero((likeness >= threshold) & (ids[:, None] < others[None, :]))
        compared = pd.DataFrame({"a": [-1], "b": [-1], "similarity": [0.0], "compared": [len(ids) * len(others)]})
        return pd.concat([pd.DataFrame({"a": ids[i], "b": others[j], "similarity": likeness[i, j], "compared": 0}), compared])

    lefts, rights = numbered(sized.where("own"), "l", "blocks", "chunks"), numbered(sized, "r", "chunks", "blocks")
    keys = [[f"{side}_{c}" for c in ("cell", "blocks", "chunks")] for side in "lr"]
    found = stage(fan_out(lefts, *keys[0]).groupBy(*keys[0]).cogroup(fan_out(rights, *keys[1]).groupBy(*keys[1])).applyInPandas(
        tile, "a long, b long, similarity double, compared long"), "close-found")
    work = found.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared")).withColumn("possible", F.lit(classes.count() ** 2).cast("long"))
    alike = found.where("compared = 0").select(F.col("a").alias("ca"), F.col("b").alias("cb"), "similarity")
    first = {c: classes.select(F.col("class_id").alias(c), F.col("representative").alias(f"r{c}")) for c in ("ca", "cb")}
    named = alike.join(first["ca"], "ca").join(first["cb"], "cb").where("rca <> rcb")
    pairs = named.select(F.least("rca", "rcb").alias("a"), F.greatest("rca", "rcb").alias("b"), "similarity")
    itself = told.groupBy("class_id").count().where("count > 1").select(F.col("class_id").alias("ca"), F.col("class_id").alias("cb"), F.lit(1.0).alias("similarity"))
    return Close(pairs, told.select("id", "representative"), work, told.select("class_id", "id"), alike.unionByName(itself.where(F.col("similarity") >= threshold)))
