"""Line dedup within an edit bound of one character, by deletion neighbourhoods.

Equal lines are first made one by a 128-bit hash. Lines within one edit share their first or their last half (halves of the
shorter length), so only lines that share a half with another line go on; a second round does the same with eighths: all but
one eighth must be equal. For what is left every variant with one character deleted inside that eighth is hashed. Lines with equal
variants at the same place differ there at most; a line equal to another one's variant lacks that character. No pairs are made:
each group of equal variants only names its earliest line. That line is then checked by edit distance.

A line goes if an equal line, or one within the bound, stands earlier; order is (document id, line number), by first places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from skein.llm.common import ready
from skein.session import stage

MIN_CHARS = 16           # shorter lines must be equal
BROADCAST_KEYS = 4_000_000  # shared keys of 8 bytes: at most 32 MB go to every executor, beyond that the join shuffles
EMIT_ROWS = 200_000
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, no, line) of every line that is not blank; ``t`` tells rows of one id apart."""
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t"), F.split(F.col(text_col), "\n").alias("l"))
    flat = base.select("id", "t", F.posexplode_outer("l").alias("no", "line"))
    return flat.where("line is not null and trim(line) <> ''")


def _ident(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2")]


def _half_keys(line: Column) -> Column:
    """Hashes of the first and last half, for the line's own length and the one below; empty for short lines."""
    n = F.length(line)

    def key(side: str, size: Column) -> Column:
        part = F.substring(line, F.lit(1), size) if side == "first" else F.substring(line, n - size + 1, size)
        return F.xxhash64(F.lit(side), size, part)

    own, below = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    keys = F.array_distinct(F.array(*[key(side, size) for side in ("first", "last") for size in (own, below)]))
    return F.when(n >= MIN_CHARS, keys).otherwise(F.array().cast("array<bigint>"))


def _shared(keyed: DataFrame) -> DataFrame:
    """Keys that two different lines have. ``keyed``: key, h1."""
    both = keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b")
    return both.select(F.col("key").alias("__key"))


def _sharing(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows of ``lines`` (with ``key``) whose key is in the staged table ``shared``."""
    if shared.count() <= BROADCAST_KEYS:
        shared = F.broadcast(shared)
    return lines.join(shared, F.col("key") == F.col("__key"), "left_semi")


def _codes(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64)


def _spread(codes: np.ndarray) -> np.ndarray:
    x = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB)


def _sums(line: str) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2 to the 64, of which every part and every variant follows in constant time."""
    codes = _spread(_codes(line))
    powers = np.full(len(codes), _BASE, np.uint64)
    powers[:1] = 1
    powers = np.cumprod(powers)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers)])


def _borders(size: int, pieces: int) -> np.ndarray:
    return np.arange(pieces + 1) * size // pieces


def _power(n: np.ndarray) -> np.ndarray:
    """_BACK to the n, modulo 2 to the 64."""
    out, factor, n = np.ones(len(n), np.uint64), np.array([_BACK], np.uint64), n.astype(np.uint64)
    while n.any():
        out = np.where(n & np.uint64(1), out * factor, out)
        factor, n = factor * factor, n >> np.uint64(1)
    return out


def piece_keys(line: str, pieces: int) -> list[tuple[int, int, int]]:
    """(key, first, end): hash of all but one piece, and the places where a deletion stays in that piece.

    Made for the line's own length and the one below, so that a line and one with a character more meet.
    """
    sums, n, found = _sums(line), len(line), []
    for size in (n, n - 1):
        cuts = _borders(size, pieces)
        first, end = cuts[:-1], cuts[1:] + (n - size)
        tail = (sums[-1] - sums[end]) * _power(end)
        lead = sums[first] * np.uint64(0xD6E8FEB86659FD93)
        keys = (lead ^ (tail + np.uint64(size))) * np.uint64(_BASE) + np.arange(pieces, dtype=np.uint64)
        found += zip(keys.view(np.int64).tolist(), first.tolist(), end.tolist())
    return found


def variants(line: str, first: int, end: int) -> np.ndarray:
    """Hashes of the line without its i-th character, for i from ``first`` to ``end`` - 1."""
    sums = _sums(line)
    at = np.arange(first, end)
    return (sums[at] + (sums[-1] - sums[at + 1]) * np.uint64(_BACK)).view(np.int64)


def _near(lines: DataFrame, pieces: int) -> DataFrame:
    """(h1, h2, by): lines with an earlier line within one edit, which ``by`` names. ``lines``: h1, h2, first, line."""
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(h1, h2, *k) for h1, h2, line in zip(batch["h1"], batch["h2"], batch["line"]) for k in piece_keys(line, pieces)],
                               columns=["h1", "h2", "key", "a", "b"])

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for h1, h2, line, ranges in zip(batch["h1"], batch["h2"], batch["line"], batch["ranges"]):
                places = np.unique(np.concatenate([np.arange(a, b) for a, b in ranges]))
                marks = np.concatenate([_sums(line)[-1:].view(np.int64), variants(line, 0, len(line))[places]])
                held.append((np.full(len(marks), h1), np.full(len(marks), h2), np.append(-1, places), marks))
                size += len(marks)
                if size > EMIT_ROWS:
                    yield columns_of(held)
                    held, size = [], 0
            if held:
                yield columns_of(held)

    def columns_of(held: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(["h1", "h2", "place", "mark"], map(np.concatenate, zip(*held)))))

    keyed = stage(lines.select("h1", "h2", "line").mapInPandas(keys, "h1 long, h2 long, key long, a int, b int"), "line-pieces")
    shared = stage(_shared(keyed), "line-piece-keys")
    ranges = _sharing(keyed, shared).groupBy("h1", "h2").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    left = lines.join(ranges, ["h1", "h2"])
    plain = left.select("h1", "h2", "line", F.transform("ranges", lambda r: F.array(r["a"], r["b"])).alias("ranges"))
    marks = plain.mapInPandas(emit, "h1 long, h2 long, place int, mark long")
    marks = stage(marks.join(lines.select("h1", "h2", "first"), ["h1", "h2"]), "line-variants")
    who = F.struct("first", "h1", "h2")
    cut = marks.where("place >= 0")
    same = cut.join(cut.groupBy("place", "mark").agg(F.min(who).alias("by")), ["place", "mark"])
    whole = marks.where("place < 0").select("mark", who.alias("by"))
    longer = cut.join(whole, "mark")
    shorter = marks.where("place < 0").join(cut.groupBy("mark").agg(F.min(who).alias("by")), "mark")
    names = ["h1", "h2", "first", "by"]
    found = same.select(*names).unionAll(longer.select(*names)).unionAll(shorter.select(*names)).where(F.col("by.first") < F.col("first"))
    best = found.groupBy("h1", "h2").agg(F.min("by").alias("by"))
    text = lines.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("other"))
    checked = best.join(lines.select("h1", "h2", "line"), ["h1", "h2"]).join(
        text, (F.col("by.h1") == F.col("g1")) & (F.col("by.h2") == F.col("g2")))
    return checked.where(F.levenshtein("line", "other") <= 1).select("h1", "h2", "by")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: int = 8) -> DataFrame:
    """``docs`` with all its columns and the kept text: ``n_lines``, ``n_kept``, ``n_near``, ``kept_text`` (replaced if they clash).

    Lines are cut at line feeds. Blank lines always stay; a null text stays null and has no lines. Lines of fewer than
    ``MIN_CHARS`` characters go only for an equal one. Rows without an id come last in the order; rows equal in id and text
    count as one and all keep the same lines.
    """
    lines = _lines(ready(docs), id_col, text_col)
    first = F.struct(F.col("id").isNull().alias("late"), "id", "t", "no").alias("first")
    owned = stage(lines.select(*_ident(F.col("line")), first).groupBy("h1", "h2").agg(F.min("first").alias("first")), "line-owners")
    keyed = lines.select("line", *_ident(F.col("line")), F.explode_outer(_half_keys(F.col("line"))).alias("key")).where("key is not null")
    shared = stage(_shared(keyed.select("key", "h1")), "line-half-keys")
    close = _sharing(keyed, shared).groupBy("h1", "h2").agg(F.first("line").alias("line"))
    close = stage(close.join(owned, ["h1", "h2"]), "line-close")
    near = stage(_near(close, pieces), "line-near")
    marked = owned.join(near.select("h1", "h2", F.lit(True).alias("near")), ["h1", "h2"], "left")
    mine = marked.groupBy(F.col("first.id").alias("__id"), F.col("first.t").alias("__t")).agg(
        F.collect_list(F.when(F.col("near").isNull(), F.col("first.no"))).alias("__nos"),
        F.count("near").alias("__near"))
    kept = docs.drop(*[c for c in ("n_lines", "n_kept", "n_near", "kept_text") if c in docs.columns])
    out = kept.join(mine, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__t")), "left")
    out = out.withColumn("__l", F.split(F.col(text_col), "\n"))
    blank = F.filter(F.sequence(F.lit(0), F.size("__l") - 1), lambda i: F.trim(F.get("__l", i)) == "")
    stay = F.array_sort(F.concat(F.coalesce("__nos", F.array().cast("array<int>")), blank))
    out = out.withColumn("__stay", F.when(F.col("__l").isNotNull(), stay))
    return out.select(
        *[F.col(f"`{c}`") for c in kept.columns], F.coalesce(F.size("__l"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__stay"), F.lit(0)).cast("long").alias("n_kept"), F.coalesce("__near", F.lit(0)).cast("long").alias("n_near"),
        F.array_join(F.transform("__stay", lambda i: F.get("__l", i)), "\n").alias("kept_text"))
