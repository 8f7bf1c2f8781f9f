"""Periodic runs of words: maximal stretches with a smallest period, repeated often enough, found on tiles of several scales.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least ``least`` words and
``times`` periods long, that no neighbouring word extends. The work is dealt by scale: the octave of L takes the periods in
[L, 2L). A document is exploded into overlapping tiles for each octave, longer ones for longer periods, and every tile is solved
for itself: at boundaries spaced evenly over it, Z-functions to the right and to the left tell for all periods of the octave at
once how far the words agree with those q further. What a tile finds is a fragment, as a run may go beyond its tile.
Fragments are shuffled by (row, period) and stitched where they overlap by a period or more, which no two different runs do.
A stretch found under several periods has the smallest of them.

Why nothing is lost: a run with its period in the octave agrees with itself over at least 2q >= 2D places for D = max(L, 8)
(times >= 3 and least >= 24 are required for that), so one boundary has D agreeing places to its right, of which the first eight
select the candidates. Tiles overlap by 4D on both sides, at least q + 2D: an end of a run which lies in a tile that does not find the run is
inside the neighbour's overlap, and neighbours that both find it overlap by 8D >= q.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from skein.llm.common import ready
from skein.session import stage

LEAST, TIMES = 24, 3
TILE_BOUNDARIES = 512  # boundaries of one tile, but of long periods at least 16 and no more than go with TILE_WORDS words
TILE_WORDS = 1 << 21
GRAM = 8
DIRECT = 12  # so many periods of a tile are compared directly, more by Z-functions

Arrange = Callable[[int | None, list[bytes]], list[bytes]]


def z_function(a: list[int]) -> list[int]:
    """For each place the length of the longest stretch from there that equals the beginning; linear in the length."""
    n = len(a)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and a[k] == a[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _agreeing(x: np.ndarray, q: int, shortest: int) -> Iterator[tuple[int, int]]:
    """Maximal stretches of ``x`` with period ``q`` of ``shortest`` words or more."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (x[:-q] == x[q:]).view(np.int8), [0]))))
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if end + q - start >= shortest:
            yield start, end + q


def _merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pieces ``(period, start, end)`` joined where they overlap by a period or more."""
    out: list[tuple[int, int, int]] = []
    for q, start, end in sorted(found):
        if out and out[-1][0] == q and start <= out[-1][2] - q:
            if end > out[-1][2]:
                out[-1] = (q, out[-1][1], end)
        else:
            out.append((q, start, end))
    return out


def _at_boundary(x: np.ndarray, b: int, octave: int, step: int) -> Iterator[tuple[int, int, int]]:
    """Stretches around boundary ``b`` for all periods of the octave, inside a window of some steps, by two Z-functions."""
    low, high = max(0, b - 4 * step), min(len(x), b + 5 * step)
    right = z_function(x[b:high].tolist())
    last = min(2 * octave, high - b)
    before = x[low:b][::-1].tolist()
    left = z_function([*before, -1, *x[low:b + last][::-1].tolist()])
    for q in range(octave, last):
        ahead = right[q]
        behind = left[len(before) + 1 + last - q] if before else 0
        if ahead + behind >= min(q, GRAM):
            yield q, b - behind, b + q + ahead


def solve_tile(x: np.ndarray, grams: np.ndarray, core: int, core_end: int, octave: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """``(period, start, end)`` of the stretches that the boundaries in [core, core_end) find; places count from the tile's first word."""
    step = max(octave, GRAM)
    boundaries = np.arange(core, core_end, step)
    boundaries = boundaries[boundaries < len(grams)]
    at = boundaries[:, None] + np.arange(octave, 2 * octave)[None, :]
    inside = at < len(grams)
    same = (grams[np.minimum(at, len(grams) - 1)] == grams[boundaries][:, None]) & inside
    periods = np.flatnonzero(same.any(axis=0)) + octave
    if not len(periods):
        return []
    if len(periods) <= DIRECT:
        return [(q, s, e) for q in periods.tolist() for s, e in _agreeing(x, q, max(least, times * q))]
    pieces = [p for b in boundaries[same.any(axis=1)].tolist() for p in _at_boundary(x, b, octave, step)]
    return [(q, s, e) for q, s, e in _merged(pieces) if e - s >= max(least, times * q)]


def _grams(ids: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` words from each place on; it only selects what is compared, so collisions do no harm."""
    h = ids.astype(np.uint64) + np.uint64(1)
    for shift in (1, 2, 4):
        h = (h[:-shift] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[shift:] + (h[shift:] >> np.uint64(29)))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h


def tiles(n: int, times: int = TIMES, boundaries: int = TILE_BOUNDARIES) -> Iterator[tuple[int, int, int, int, int]]:
    """``(octave, tile start, core start, core end, tile end)`` over ``n`` words."""
    octave = 1
    while times * octave <= n:
        step = max(octave, GRAM)
        length = step * min(boundaries, max(16, TILE_WORDS // step))
        for core in range(0, n, length):
            core_end = min(n, core + length)
            yield octave, max(0, core - 4 * step), core, core_end, min(n, core_end + 4 * step)
        octave *= 2


def fragments(words: list[bytes], least: int = LEAST, times: int = TIMES, boundaries: int = TILE_BOUNDARIES) -> list[tuple[int, int, int]]:
    """``(period, start, end)`` found by the tiles of one document."""
    n = len(words)
    if n < least:
        return []
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    grams = _grams(ids)
    if len(known) == n or len(np.unique(grams)) == len(grams):  # a run repeats its first eight words
        return []
    found = []
    for octave, low, core, core_end, high in tiles(n, times, boundaries):
        for q, start, end in solve_tile(ids[low:high], grams[low:max(low, high - GRAM + 1)], core - low, core_end - low, octave, least, times):
            found.append((q, start + low, end + low))
    return found


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []  # bytes split at exactly these characters: space, \t, \n, \v, \f, \r


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run ``(start, length, period)`` contains after its first period, joined by single spaces."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept.tolist()) if k])


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_FOUND = "row_id long, doc_id long, text string, sha string, period long, start long, stop long"


def _search(least: int, times: int, arrange: Arrange | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                words = words_of(text)
                if arrange:
                    words = arrange(doc_id, words)
                pieces = fragments(words, least, times)
                whole = b" ".join(words)
                # the words stay with the document only where runs may have to be cut out of them
                rows.append((number, doc_id, whole.decode() if pieces else None, None if pieces else _sha(whole), None, None, None))
                rows += [(number, doc_id, None, None, *p) for p in pieces]
                number += 1
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")])
            yield frame.astype({c: "Int64" for c in ("row_id", "doc_id", "period", "start", "stop")})

    return run


def stitch(pieces: DataFrame) -> DataFrame:
    """``(row_id, start, stop, period)`` of whole runs from ``(row_id, period, start, stop)`` of fragments."""
    order = Window.partitionBy("row_id", "period").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = pieces.withColumn("__new", F.coalesce((F.col("start") > reach - F.col("period")).cast("int"), F.lit(1)))
    numbered = opened.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("row_id", "period", "__run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return joined.groupBy("row_id", "start", "stop").agg(F.min("period").alias("period"))


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, arrange: Arrange | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, runs)``: one staged row per document with a number of its own, and ``(row_id, start, length, period)`` of its runs.

    ``docs`` has ``doc_id`` and ``text``; a null text has no words, equal rows are documents of their own, other columns are
    not read. ``arrange`` may rearrange the words of a document before they are searched. ``rows`` holds ``text`` (the words with
    single spaces) where fragments were found, else ``sha``, the digest of that.
    """
    if least < 3 * GRAM or times < 3:
        raise ValueError("runs shorter than 24 words or three periods are not searched")
    source = ready(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stage(source.mapInPandas(_search(least, times, arrange), _FOUND), "period-tiles")
    runs = stitch(found.where("period is not null").select("row_id", "period", "start", "stop"))
    rows = found.where("period is null").select("row_id", "doc_id", "text", "sha")
    return rows, runs.select("row_id", "start", (F.col("stop") - F.col("start")).alias("length"), "period")


_REPORT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def _report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text, found in zip(batch["doc_id"], batch["text"], batch["runs"]):
            runs = sorted((int(r["start"]), int(r["length"]), int(r["period"])) for r in found) if found is not None else []
            best = None
            for start, length, period in runs:
                # exact comparison of length / period; the earlier start and shorter period stay on a tie
                if best is None or length * best[2] > best[1] * period:
                    best = (start, length, period)
            told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            text_runs = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
            rows.append((None if pd.isna(doc_id) else int(doc_id), len(runs), *told, _sha(text_runs.encode()), _sha(collapse(words_of(text), runs))))
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in _REPORT.split(", ")])
        yield frame.astype({c: "Int64" for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")})


def run_report(docs: DataFrame, least: int = LEAST, times: int = TIMES, arrange: Arrange | None = None) -> DataFrame:
    """One row per document: number of runs, the run with the greatest length / period, digests of all runs and of the collapsed text.

    A document without words, empty or null, has no run and the digests of empty texts; ties of the greatest run go to the
    smallest start, then period; repeated rows give repeated results; an empty table gives none.
    """
    rows, runs = find_runs(docs, least, times, arrange)
    listed = runs.groupBy("row_id").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    searched = rows.where("text is not null").join(listed, "row_id", "left").select("doc_id", "text", "runs").mapInPandas(_report, _REPORT)
    nothing = F.lit(None).cast("long")
    plain = rows.where("text is null").select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), *[nothing.alias(c) for c in ("start", "length", "period", "exponent_milli")],
        F.lit(_sha(b"")).alias("runs_sha256"), F.col("sha").alias("collapsed_sha256"))
    return plain.unionByName(searched)


def collapsed_texts(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with its runs cut down to their first period in ``text``; documents without runs keep their text as it is.

    The columns stay as they are. Rows are told apart by number, so repeated rows stay repeated.
    """
    columns = docs.columns
    kept = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "period-docs")
    rows, runs = find_runs(kept.select(F.col("__row").alias("doc_id"), "text"), least, times)
    listed = runs.groupBy("row_id").agg(F.collect_list(F.struct("start", "length", "period")).alias("__runs"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [collapse(words_of(t), [(int(r["start"]), int(r["length"]), int(r["period"])) for r in found]).decode()
                     for t, found in zip(batch["text"], batch["__runs"])]
            yield pd.DataFrame({"__row": batch["doc_id"], "__text": texts})

    changed = rows.where("text is not null").join(listed, "row_id").select("doc_id", "text", "__runs").mapInPandas(cut, "__row long, __text string")
    joined = kept.join(changed, "__row", "left").withColumn("text", F.coalesce("__text", "text"))
    return joined.select(*[f"`{c}`" for c in columns])
