"""Sections to overlapping chunks, inside the row of the document: no shuffle, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skein.config import DEFAULTS, Settings
from skein.functions import text as T

_CHUNK = "struct<text:string,heading:string>"


def _slices(para: Column, limit: int, overlap: int) -> Column:
    """Cut a long paragraph into windows of ``limit`` advancing by ``limit - overlap``."""
    stride = limit - overlap
    strides = F.regexp_extract_all(para, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
    following = F.concat(F.slice(strides, 2, 1 << 30), F.array(F.lit("")))
    windows = F.zip_with(strides, following, lambda a, b: F.concat(a, F.substring(b, 1, overlap)))
    heading = F.substring(para, F.lit(1), F.least(F.lit(80), F.floor(F.length(para) / 4).cast("int")))
    return F.transform(
        windows,
        lambda w, i: F.struct(F.lit(2).alias("kind"), w.alias("text"), F.when(i == 0, heading).alias("heading")),
    )


def _pieces(sections: Column, limit: int, overlap: int) -> Column:
    """Sections as pieces: 0 may join the open chunk, 1 opens a chunk, 2 is a finished slice."""

    def plain(kind: int, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.substring_index(text, "\n", 1).alias("heading"))

    def paragraph(p: Column) -> Column:
        return F.when(F.length(p) <= limit, F.array(plain(1, p))).otherwise(_slices(p, limit, overlap))

    def section(s: Column) -> Column:
        return F.when(F.length(s) <= limit, F.array(plain(0, s))).otherwise(
            F.flatten(F.transform(T.paragraphs(s), paragraph))
        )

    return F.flatten(F.transform(sections, section))


def pack_sections(sections: Column, settings: Settings = DEFAULTS) -> Column:
    """``array<struct<text,heading>>`` of chunks for an ``array<string>`` of sections.

    One fold over the pieces. The state is the open chunk, the tail of the last finished one
    (its overlap prefixes the next) and the finished chunks.
    """
    limit, overlap = settings.chunk_max_chars, settings.chunk_overlap_chars

    def emit(done: Column, tail: Column, text: Column, heading: Column) -> tuple[Column, Column]:
        body = F.concat(tail, text)
        first = F.size(done) == 0
        head = F.when(first, heading).otherwise(F.coalesce(F.when(heading != "", heading), body))
        chunk = F.struct(body.alias("text"), head.alias("heading"))
        return F.concat(done, F.array(chunk)), F.substring(text, -overlap, overlap)

    def step(acc: Column, piece: Column) -> Column:
        kind, text = piece["kind"], piece["text"]
        is_open = acc["open"] != ""
        joins = (kind == 0) & is_open & (F.length(acc["open"]) + F.length(text) + 2 <= limit)
        flushed, flushed_tail = emit(acc["done"], acc["tail"], acc["open"], acc["heading"])
        done = F.when(is_open, flushed).otherwise(acc["done"])
        tail = F.when(is_open, flushed_tail).otherwise(acc["tail"])
        sliced, sliced_tail = emit(done, tail, text, piece["heading"])

        def state(o: Column, h: Column, d: Column, t: Column) -> Column:
            return F.struct(o.alias("open"), h.alias("heading"), d.alias("done"), t.alias("tail"))

        return (
            F.when(joins, state(F.concat(acc["open"], F.lit("\n\n"), text), acc["heading"], acc["done"], acc["tail"]))
            .when(kind == 2, state(F.lit(""), F.lit(None).cast("string"), sliced, sliced_tail))
            .otherwise(state(text, piece["heading"], done, tail))
        )

    def finish(acc: Column) -> Column:
        flushed, _ = emit(acc["done"], acc["tail"], acc["open"], acc["heading"])
        return F.when(acc["open"] != "", flushed).otherwise(acc["done"])

    start = F.struct(
        F.lit("").alias("open"), F.lit(None).cast("string").alias("heading"),
        F.expr("array()").cast(f"array<{_CHUNK}>").alias("done"), F.lit("").alias("tail"),
    )
    return F.aggregate(_pieces(sections, limit, overlap), start, step, finish)


def explode_chunks(df: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    """One row per chunk with ``chunk_index``, ``text_content``, ``section_heading``."""
    return df.select(*keep, F.posexplode(chunks).alias("chunk_index", "chunk")).select(
        *keep, "chunk_index",
        F.col("chunk.text").alias("text_content"),
        F.coalesce(F.col("chunk.heading"), F.lit("")).alias("section_heading"),
    )


def chunk_documents(docs: DataFrame, id_col: str, text_col: str = "text", markdown: Column | None = None,
                    settings: Settings = DEFAULTS) -> DataFrame:
    """Chunk a table of texts; ``markdown`` marks the rows that follow Markdown section rules."""
    text = F.col(text_col)
    sections = T.txt_sections(text)
    if markdown is not None:
        sections = F.when(markdown, T.md_sections(text)).otherwise(sections)
    return explode_chunks(docs, pack_sections(sections, settings), [id_col])
