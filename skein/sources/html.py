"""HTML pages to chunks: a small tag reader per row, everything after it in the JVM."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from skein.operators.chunking import pack_sections

_ELEMENTS = "array<struct<kind:string,text:string>>"
# Tags whose text is not content, that open a heading, and that end a block of text.
_SKIPPED = {"script", "style", "head", "noscript", "template"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "header"}
_BLOCKS = {"p", "div", "li", "ul", "ol", "section", "article", "nav", "footer", "main", "blockquote", "pre", "body",
           "br", "hr", "tr", "td", "th", "dd", "dt", "figure", "figcaption", "aside", "form"}


class _Reader(HTMLParser):
    """Collects (kind, text): title, table, or plain text, one per block, blanks folded."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.words, self.kind, self.skip, self.table = [], [], "text", 0, 0

    def close_block(self, kind: str = "text"):
        text = " ".join("".join(self.words).split())
        if text:
            self.found.append((self.kind, text))
        self.words, self.kind = [], kind

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        elif tag == "table":
            if not self.table:
                self.close_block("table")
            self.table += 1
        elif self.table:
            self.words.append(" ")
        elif tag == "img":
            label = dict(attrs).get("alt")
            self.close_block("image")
            self.words.append(label or "")
            self.close_block()
        elif tag in _HEADINGS:
            self.close_block("title")
        elif tag in _BLOCKS:
            self.close_block()

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.table:
            self.table -= 1
            if not self.table:
                self.close_block()
        elif not self.table and (tag in _HEADINGS or tag in _BLOCKS):
            self.close_block()

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def _read(html: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.close_block()
    return [{"kind": k, "text": t} for k, t in reader.found]


def parsed(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``elements`` instead of the markup."""
    keep = [c for c in pages.columns if c != html_col]
    schema = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep) + f", elements {_ELEMENTS}"

    def read(batches):
        for batch in batches:
            out = batch[keep].copy()
            out["elements"] = batch[html_col].map(_read)
            yield pd.DataFrame(out)

    return pages.mapInPandas(read, schema)


def elements(pages: DataFrame) -> DataFrame:
    return parsed(pages).select("source_id", F.posexplode("elements").alias("pos", "e")).select("source_id", "pos", "e.kind", "e.text")


def element_sections(elements_col: Column) -> Column:
    """Titles open a section, tables and images close one; their own text is not part of a section."""
    body = F.filter(elements_col, lambda e: (e["text"] != "") & (e["kind"] != "skip"))
    # element texts hold no line breaks, so a blank line is a safe seam between sections
    pieces = F.transform(body, lambda e: F.when(e["kind"] == "title", F.concat(F.lit("\n"), e["text"])).when(
        e["kind"].isin("table", "image"), F.lit("\n")).otherwise(e["text"]))
    joined = F.regexp_replace(F.array_join(pieces, "\n"), r"\n{2,}", "\n\n")
    return F.filter(F.split(F.regexp_replace(joined, r"\A\n+|\n+\z", ""), "\n\n"), lambda s: s != "")


def html_chunks(pages: DataFrame) -> DataFrame:
    return element_chunks(parsed(pages))


def element_chunks(read: DataFrame) -> DataFrame:
    """Chunk rows of ``read(source_id, elements)``: tables first, then packed text, numbered in that order.

    Images without bytes of their own leave no chunk, as markup only refers to them.
    """
    own = F.transform(F.filter("elements", lambda e: e["kind"] == "table"), lambda e: F.struct(
        F.lit("table").alias("chunk_type"), e["text"].alias("text"), F.lit("").alias("heading")))
    text = F.transform(pack_sections(element_sections(F.col("elements"))), lambda c: F.struct(
        F.lit("text").alias("chunk_type"), c["text"].alias("text"), F.coalesce(c["heading"], F.lit("")).alias("heading")))
    return read.select("source_id", F.posexplode(F.concat(own, text)).alias("chunk_index", "c")).select(
        "source_id", "chunk_index", "c.chunk_type", F.col("c.text").alias("text_content"),
        F.col("c.heading").alias("section_heading"), F.lit(None).cast("binary").alias("image_data"))
