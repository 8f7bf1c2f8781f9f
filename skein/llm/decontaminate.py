"""Benchmark decontamination by winnowed k-gram fingerprints.

A shared passage of ``window`` words holds ``window - k + 1`` k-grams. Both sides keep the smallest k-gram hash of every such
run, so a shared passage always shares a kept fingerprint. Fingerprints are joined, every hit is extended to the windows
around it, and these are compared word for word with the windows of the benchmark. Items shorter than a window are one
window each; their few lengths give whole-passage hashes that travel with the fingerprints.

Only DataFrame functions run here. The documents' text is not shuffled for the fingerprint join; the second reading joins
only documents that have a fingerprint hit.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from skein.llm.common import words_of
from skein.session import stage

K = 5
WINDOW = 10


def _each(values) -> Column:
    """One row for each element. The outer form: from the inner one the optimizer infers a filter on the array's size, which it
    then pushes below the arrays it is made of, so that these would be made again for each of their elements."""
    return F.explode_outer(values)


def _at(words: str, first: Column, n: int) -> list[Column]:
    return [F.element_at(words, first + j) for j in range(n)]


def _grams(hashes: str, n: int) -> Column:
    """Hash of every run of ``n`` words, by position."""
    count = F.size(hashes) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.lit(n), *_at(hashes, i, n)))).otherwise(
        F.array().cast("array<bigint>"))


def _winnow(grams: str, run: int) -> Column:
    """The smallest hash of every run of ``run`` k-grams."""
    count = F.size(grams) - run + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.least(*_at(grams, i, run)))).otherwise(
        F.array().cast("array<bigint>"))


def _raw(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__id``, ``__t`` (tells rows of one id apart) and ``__text``."""
    return df.select(F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__t"), F.col(text_col).alias("__text"))


def _hashed(raw: DataFrame) -> DataFrame:
    """The text's words in its place as ``__words``, and their hashes ``__h``."""
    base = raw.withColumn("__words", words_of(F.col("__text"))).drop("__text")
    return base.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))


def _fingerprints(df: DataFrame, k: int, window: int, short: list[int]) -> DataFrame:
    """Add ``__f``: winnowed k-gram hashes, and whole hashes of the short lengths."""
    grams = df.withColumn("__g", _grams("__h", k))
    kept = grams.withColumn("__f", _winnow("__g", window - k + 1))
    return kept.withColumn("__f", F.array_distinct(F.concat("__f", *[_grams("__h", n) for n in short])))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, n, passage): each window of each item; ``n`` is its number of words. A null item id counts as the id ''."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window)))
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.concat_ws(" ", F.slice("w", i, F.col("n"))))
    return items.select("item", "n", F.explode(F.array_distinct(cut)).alias("passage")).distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", k: int = K, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, windows).

    ``rows``: ``__id``, ``__t``, ``n_words`` for every document row. ``hits``: ``__id``, ``__t``, ``start`` (word, from 0),
    ``n``, ``passage`` for every benchmark window that stands in a document. ``windows``: the windows of the benchmark.
    Null and empty texts have no words and no hits; an empty benchmark hits nothing; repeated rows each keep their row.
    """
    spark = docs.sparkSession
    windows = stage(benchmark_windows(benchmark, item_col, item_text_col, window), "bench-windows")
    short = sorted(r.n for r in windows.where(F.col("n") < window).select("n").distinct().collect())  # at most window - 1 numbers
    passages = windows.select("n", "passage").distinct()
    items = _hashed(_raw(benchmark, item_col, item_text_col))
    marks = _fingerprints(items.where(F.size("__words") >= window), k, window, []).select(_each("__f").alias("mark"))
    for n in short:
        marks = marks.unionAll(items.where(F.size("__words") == n).select(_each(_grams("__h", n)).alias("mark")))
    marks = stage(marks.where("mark is not null").distinct(), "bench-marks")

    raw = _raw(docs, id_col, text_col)
    fingers = _fingerprints(_hashed(raw), k, window, short)
    # the null element carries the document itself through the join
    flat = fingers.select("__id", "__t", F.size("__words").cast("long").alias("n_words"),
                          _each(F.concat(F.array(F.lit(None).cast("bigint")), "__f")).alias("__mark"))
    met = flat.join(marks.withColumn("__met", F.lit(True)), F.col("__mark") == F.col("mark"), "left")
    met = stage(met.where("__mark is null or __met").select("__id", "__t", "n_words", "__mark"), "doc-marks")
    rows = met.where("__mark is null").select("__id", "__t", "n_words")
    found = met.where("__mark is not null").select(F.col("__id").alias("__i"), F.col("__t").alias("__u")).distinct()

    # texts are joined as they are, arrays are made of those that are left
    near = raw.join(found, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__t") == F.col("__u")), "left_semi")
    near = stage(near.dropDuplicates(["__id", "__t"]), "doc-near")
    places = None  # where a hash of the benchmark stands, by a join instead of a search in each row
    for n, size in [(window, k), *[(n, n) for n in short]]:
        grams = _hashed(near).select("__id", "__t", F.lit(n).alias("n"), F.posexplode_outer(_grams("__h", size)).alias("p", "g"))
        met = grams.join(marks, F.col("g") == F.col("mark"), "left_semi").select("__id", "__t", "n", "p")
        places = met if places is None else places.unionAll(met)
    first = F.when(F.col("n") == window, F.greatest(F.col("p") - (window - k), F.lit(0))).otherwise(F.col("p"))
    starts = places.select("__id", "__t", "n", F.explode(F.sequence(first, "p")).alias("start")).groupBy(
        F.col("__id").alias("__i"), F.col("__t").alias("__u")).agg(F.collect_set(F.struct("start", "n")).alias("__starts"))
    near = _hashed(near).join(starts, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__t") == F.col("__u")))
    cut = F.transform(F.filter("__starts", lambda x: x["start"] + x["n"] <= F.size("__words")), lambda x: F.struct(
        x["start"].alias("start"), x["n"].alias("n"), F.concat_ws(" ", F.slice("__words", x["start"] + 1, x["n"])).alias("passage")))
    spans = near.select("__id", "__t", _each(cut).alias("c")).where("c is not null").select("__id", "__t", "c.*")
    return rows, stage(spans.join(passages, ["n", "passage"], "left_semi"), "doc-hits"), windows


def decontaminate(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """One row for each document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``n_hit`` counts document words inside any benchmark window, ``items_sha256`` digests the sorted item ids. ``names`` are
    the column and method parameters of ``find_hits``.
    """
    rows, hits, windows = find_hits(docs, benchmark, **names)
    places = hits.groupBy("__id", "__t").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("p"))
    # sweep over the starts in order: words beyond the furthest end so far are new
    step = F.aggregate("p", F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")), lambda a, s: F.struct(
        F.greatest(a["end"], s["start"] + s["n"]).alias("end"),
        (a["hit"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["end"], s["start"]))).alias("hit")), lambda a: a["hit"])
    covered = places.select(F.col("__id").alias("__i"), F.col("__t").alias("__u"), step.cast("long").alias("n_hit"))
    pairs = hits.select("__id", "__t", "n", "passage").distinct().join(windows, ["n", "passage"]).select("__id", "__t", "item").distinct()
    items = pairs.groupBy(F.col("__id").alias("__j"), F.col("__t").alias("__v")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.join(covered, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__t") == F.col("__u")), "left")
    out = out.join(items, F.col("__id").eqNullSafe(F.col("__j")) & (F.col("__t") == F.col("__v")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("__id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``docs``, with all its columns, without the rows that hold a benchmark window."""
    _, hits, _ = find_hits(docs, benchmark, id_col=id_col, text_col=text_col, **names)
    bad = hits.select(F.col("__id").alias("__i"), F.col("__t").alias("__u")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__i")) & (F.xxhash64(F.col(text_col)) == F.col("__u")), "left_anti")
