"""Mixing sources to target weights.

The words of a source, in the order of its documents, are packed into blocks of a fixed number of words. Every output shard
draws how many of its slots go to each source: the slots of a source fall on the shards by a multinomial draw, while their total
is what the source's target asks for. A source's slots run through its blocks in the order of a pseudorandom permutation of
their indexes, another one for each pass, so a block is never drawn twice before all others were drawn once. Slots and blocks are
joined by index. The last slot of a source is cut, so that the words taken meet the target.

Sums over a hot source never meet in one task: positions come from ranges of (source, document), and the sources' own table has
one row for each source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from skein.llm.common import partitions, ready, running_start
from skein.session import stage

WEIGHTS = (5, 2, 1)      # by the rank of a source, repeating
MOST = 3.0               # a target is at most so many times its source
BLOCK = 128              # words
SHARD_SLOTS = 1024
SEED = 20240601
# Fixed value: what stands between words.
GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size) to one row for each source with ``rank`` and ``target``.

    Sources are ranked by code point, null last. All words are shared by weight; what would exceed ``most`` times a source's
    size is shared again among the others. Each round asks for two sums only.
    """
    keyed = sizes.withColumn("__null", F.col("source").isNull()).withColumn("__one", F.lit(1).cast("long"))
    ranked = running_start(keyed, [], ["__null", "source"], "__one", "rank", "source-ranks")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stage(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most), "source-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, F.lit(False)
    while True:
        fixed, open_ = ranked.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)),
                                  F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        new = (total - fixed) / open_ if open_ else level
        if new <= level:
            break
        level = new
        capped = F.col("weight") * level > F.col("cap")
    target = F.when(capped, F.col("cap")).otherwise(F.col("weight") * level)
    return ranked.select("source", "source_size", "rank", target.cast("double").alias("target"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _feistel(x: np.ndarray, half: np.ndarray, key: np.ndarray, back: bool) -> np.ndarray:
    mask = (np.uint64(1) << half) - np.uint64(1)
    left, right = x >> half, x & mask
    for r in reversed(range(4)) if back else range(4):
        if back:
            left, right = right ^ (_mix(left + key * np.uint64(8) + np.uint64(r + 1)) & mask), left
        else:
            left, right = right, left ^ (_mix(right + key * np.uint64(8) + np.uint64(r + 1)) & mask)
    return (left << half) | right


def permuted(at: np.ndarray, size: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Place of ``at`` in the permutation of 0 to ``size`` - 1 chosen by ``key``; ``back`` inverts it. Values outside are walked on."""
    at, size, key = (np.asarray(a).astype(np.uint64) for a in np.broadcast_arrays(at, size, key))
    bits = np.ceil(np.log2(np.maximum(size.astype(float), 2))).astype(np.uint64)
    half = (bits + np.uint64(1)) // np.uint64(2)
    out = _feistel(at, half, key, back)
    while (outside := out >= size).any():
        out[outside] = _feistel(out[outside], half[outside], key[outside], back)
    return out.astype(np.int64)


def _key(rank, epoch, seed: int) -> np.ndarray:
    return _mix(np.asarray(rank).astype(np.uint64) * np.uint64(1_000_003) + np.asarray(epoch).astype(np.uint64) + np.uint64(seed))


def slot_plan(size: int, target: float, rank: int, block: int, seed: int) -> tuple[int, int]:
    """(number of slots of a source, words cut from the last one): whole passes, then blocks of one more pass until the target."""
    if size == 0:
        return 0, 0
    blocks, last = -(-size // block), size - (-(-size // block) - 1) * block
    wanted = round(target)
    passes, rest = divmod(wanted, size)
    if rest == 0:
        return passes * blocks, 0
    place = int(permuted([blocks - 1], [blocks], _key([rank], [passes], seed), back=True)[0])  # when the short block comes
    slots = -(-rest // block)
    words = slots * block - (block - last if place < slots else 0)
    if words < rest:
        slots += 1
        words += last if place == slots - 1 else block
    return passes * blocks + slots, words - rest


def draw_slots(targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(rank, shard, number, block, upto): every slot of the mix; ``upto`` is how many words of its block it takes."""
    spark = targets.sparkSession
    words = targets.agg(F.sum("target")).first()[0] or 0.0
    shards = max(1, round(words / block / shard_slots))

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                slots, cut = slot_plan(int(row.source_size), float(row.target), int(row.rank), block, seed)
                if slots:
                    rng = np.random.default_rng([seed, int(row.rank)])
                    drawn = rng.multinomial(slots, np.full(shards, 1 / shards))
                    some = np.flatnonzero(drawn)
                    first = np.cumsum(drawn)[some] - drawn[some]
                    for i in range(0, len(some), 10_000):
                        yield pd.DataFrame({"rank": row.rank, "source_size": row.source_size, "slots": slots, "cut": cut,
                                            "shard": some[i:i + 10_000], "first": first[i:i + 10_000], "n": drawn[some[i:i + 10_000]]})

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blocks = -(-batch["source_size"].to_numpy() // block)
            epoch, at = np.divmod(batch["number"].to_numpy(), np.maximum(blocks, 1))
            index = permuted(at, blocks, _key(batch["rank"].to_numpy(), epoch, seed)) if len(batch) else at
            upto = np.minimum(block, batch["source_size"].to_numpy() - index * block)
            upto = upto - np.where(batch["number"] == batch["slots"] - 1, batch["cut"], 0)
            yield batch[["rank", "shard", "number"]].assign(block=index, upto=upto)

    drawn = targets.select("rank", "source_size", "target").repartition(partitions(targets), "rank").mapInPandas(
        counts, "rank long, source_size long, slots long, cut long, shard long, first long, n long")
    spread = drawn.repartition(partitions(targets), "rank", "shard")
    each = spread.select("rank", "source_size", "slots", "cut", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("number"))
    return each.mapInPandas(places, "rank long, shard long, number long, block long, upto long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
        most: float = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces).

    ``rows``: doc_id, source, tie (a hash of the text), size, source_size, target, rank, start (word of the source's stream)
    for every row of ``docs``. ``pieces``: rank, start, shard, number, first, taken: which words of which row each slot takes.
    Null texts have size 0 and are never taken; null sources are a source of their own; repeated rows each have their words.
    """
    base = ready(docs).select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("tie"),
                       word_count(F.col(text_col)).alias("size"))
    base = stage(base, "mix-sizes")
    targets = stage(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets")
    known = targets.select(F.col("source").alias("__source"), "rank", "source_size", "target")
    ranked = base.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = stage(running_start(ranked, ["rank"], ["doc_id", "tie", "size"], "size", "start", "mix-rows"), "mix-starts")
    cuts = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    parts = rows.where("size > 0").select("rank", "start", "size", F.explode(cuts).alias("block"))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    parts = parts.select("rank", "start", "block", low.alias("low"), high.alias("high"))
    # the slots come from a small table and are many: no estimate may broadcast them
    met = parts.join(draw_slots(targets, block, shard_slots, seed).hint("merge"), ["rank", "block"])
    taken = F.least("high", "upto") - F.col("low")
    pieces = met.where(taken > 0).select("rank", "start", "shard", "number", (F.col("block") * block + F.col("low") - F.col("start")).alias("first"),
                                         taken.cast("long").alias("taken"))
    return rows, pieces


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken, draws (how often its first word was taken)."""
    rows, pieces = mix(docs, **options)
    found = pieces.groupBy(F.col("rank").alias("__rank"), F.col("start").alias("__start")).agg(
        F.sum("taken").alias("taken"), F.sum(F.when(F.col("first") == 0, 1).otherwise(0)).alias("draws"))
    out = rows.join(found, (F.col("rank") == F.col("__rank")) & (F.col("start") == F.col("__start")) & (F.col("size") > 0), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"),
                      F.coalesce("draws", zero).alias("draws"), "source", "tie")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with all its columns, each document as often as a slot took its first word: whole documents in the mix's shares."""
    report = mix_report(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("draws > 0")
    keys = report.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__src"), F.col("tie").alias("__tie")).agg(
        F.sum("draws").alias("__draws"))
    # equal rows are one here; their draws are summed
    once = docs.withColumn("__t", F.xxhash64(F.col(text_col))).dropDuplicates([id_col, source_col, "__t"])
    met = once.join(keys, F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__src")) & (F.col("__t") == F.col("__tie")))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__draws").cast("int"))).alias("__copy")).drop("__copy")
