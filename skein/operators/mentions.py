"""Which names occur inside which texts: exact substring search on a grid of blocks.

Names and texts are cut into bounded hash blocks; every cell scans its texts once with a multi-pattern
automaton, so the work is linear in the text and no (name, text) pair is tested on its own.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from skein.operators.knn import grid
from skein.operators.ranking import numbers

ROWS_PER_BLOCK = 100_000


def _scan(texts: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
    found: list[tuple[int, int]] = []
    by_name: dict[str, list[int]] = {}
    for ident, name in zip(names["entity_id"].tolist(), names["needle"].tolist()):
        by_name.setdefault(name, []).append(ident)
    everywhere = by_name.pop("", [])
    machine = ahocorasick.Automaton()
    for name in by_name:
        machine.add_word(name, name)
    if by_name:
        machine.make_automaton()
    for ident, text in zip(texts["text_id"].tolist(), texts["haystack"].tolist()):
        hits = {name for _, name in machine.iter(text)} if by_name else set()
        found.extend((ident, e) for name in hits for e in by_name[name])
        found.extend((ident, e) for e in everywhere)
    return pd.DataFrame(found, columns=["text_id", "entity_id"], dtype="int64")


def occurrences(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``(text_id, entity_id)`` for every ``names(entity_id, needle)`` contained in ``texts(text_id, haystack)``."""
    text_blocks, name_blocks = grid(texts.count(), names.count(), ROWS_PER_BLOCK, texts.sparkSession.sparkContext.defaultParallelism)
    left = texts.select("text_id", "haystack", F.pmod(F.xxhash64("text_id"), F.lit(text_blocks)).alias("tb"),
                        F.explode(numbers(name_blocks)).alias("nb"))
    right = names.select("entity_id", "needle", F.pmod(F.xxhash64("entity_id"), F.lit(name_blocks)).alias("nb"),
                         F.explode(numbers(text_blocks)).alias("tb"))
    cells = name_blocks * text_blocks
    left, right = left.repartition(cells, "tb", "nb"), right.repartition(cells, "tb", "nb")
    return left.groupBy("tb", "nb").cogroup(right.groupBy("tb", "nb")).applyInPandas(
        _scan, "text_id bigint, entity_id bigint")
