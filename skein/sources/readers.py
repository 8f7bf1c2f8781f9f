"""Files to chunks: blob listings, text, Markdown, HTML, DOCX and (when PyMuPDF is there) PDF."""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skein.functions import text as T
from skein.operators.chunking import explode_chunks, pack_sections
from skein.session import stage
from skein.sources import html as H

CHUNK_COLUMNS = ["source_id", "chunk_index", "chunk_type", "text_content", "section_heading", "image_data", "image_mime_type"]
# Extensions with Markdown section rules, size of a heading against body text, body size without text.
MARKDOWN = ["md", "markdown", "mdown"]
HEADING_FACTOR = 1.5
DEFAULT_BODY_SIZE = 11.0
OCR_BELOW_CHARS = 50


def safe_key(root: str, key: str) -> str:
    """Join and normalise; keys that leave the root are refused."""
    base = posixpath.normpath(root)
    path = posixpath.normpath(posixpath.join(base, key))
    if key.startswith("/") or (path != base and not path.startswith(base.rstrip("/") + "/")):
        raise ValueError(f"key leaves the storage root: {key}")
    return path


def list_blobs(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """``(key, path, length, modified, content)`` below the root; content is only read when selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    plain = F.regexp_replace("path", r"\A[a-z0-9+.-]+:/+", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/" if ":" in root else posixpath.abspath(root).rstrip("/") + "/"
    return reader.load(root).select(
        F.replace(plain, F.lit(base), F.lit("")).alias("key"), "path", "length", F.col("modificationTime").alias("modified"), "content")


def decoded(content: Column) -> Column:
    """UTF-8 text; broken bytes become the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def _extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)\z", 1))


def _text_rows(chunks: Column, df: DataFrame) -> DataFrame:
    return explode_chunks(df, chunks, ["source_id"]).select(
        "source_id", "chunk_index", F.lit("text").alias("chunk_type"), "text_content", "section_heading",
        F.lit(None).cast("binary").alias("image_data"), F.lit(None).cast("string").alias("image_mime_type"))


def parse_simple(files: DataFrame, by_extension: bool = True) -> DataFrame:
    """Text and Markdown ``files(source_id, file_name, content)``.

    ``by_extension=False`` treats Markdown as plain text, as happens to uploads stored without extension.
    """
    text = decoded(F.col("content"))
    sections = T.txt_sections(text)
    if by_extension:
        sections = F.when(_extension(F.col("file_name")).isin(MARKDOWN), T.md_sections(text)).otherwise(sections)
    return _text_rows(pack_sections(sections), files)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_elements(content: bytes) -> list[dict]:
    """Paragraphs and tables of a DOCX body in order; heading and title styles count as titles."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    found = []
    for node in body:
        text = "".join(t.text or "" for t in node.iter(f"{_W}t")).strip() if node.tag == f"{_W}p" else " ".join(
            "".join(t.text or "" for t in cell.iter(f"{_W}t")).strip() for cell in node.iter(f"{_W}tc"))
        style = node.find(f"{_W}pPr/{_W}pStyle")
        title = style is not None and style.get(f"{_W}val", "").lower().startswith(("heading", "title"))
        if text:
            found.append({"kind": "table" if node.tag == f"{_W}tbl" else "title" if title else "text", "text": " ".join(text.split())})
    return found


def read_elements(files: DataFrame) -> DataFrame:
    """``(source_id, elements, error)`` of HTML and DOCX files; other types are read as HTML-free text.

    A file that cannot be read has an error and no elements; it does not stop the others.
    """
    kind = _extension(F.col("file_name"))

    def one(content: bytes, kind: str) -> tuple[list[dict] | None, str | None]:
        try:
            return docx_elements(content) if kind == "docx" else H._read(content.decode("utf-8", "replace")), None
        except Exception as error:  # whatever a broken file makes its reader raise belongs to this file
            return None, f"{type(error).__name__}: {error}"

    def read(batches):
        for batch in batches:
            for i in range(len(batch)):  # a file may be large: one at a time leaves the task
                elements, error = one(batch["content"].iloc[i], batch["kind"].iloc[i])
                yield pd.DataFrame({"source_id": batch["source_id"].iloc[i:i + 1].to_numpy(), "elements": [elements], "error": [error]})

    return files.select("source_id", "content", kind.alias("kind")).mapInPandas(
        read, f"source_id {files.schema['source_id'].dataType.simpleString()}, elements {H._ELEMENTS}, error string")


def parse_unstructured(files: DataFrame) -> DataFrame:
    return _element_rows(read_elements(files))


def _element_rows(read: DataFrame) -> DataFrame:
    good = read.filter("error IS NULL").select("source_id", "elements")
    return H.element_chunks(good).withColumn("image_mime_type", F.lit(None).cast("string")).select(CHUNK_COLUMNS)


# --- PDF ---------------------------------------------------------------------------------------------
def body_size(sizes: Column) -> Column:
    """Upper median of the positive span sizes of a page."""
    ordered = F.array_sort(F.filter(sizes, lambda s: s > 0))
    return F.coalesce(F.get(ordered, F.floor(F.size(ordered) / 2).cast("int")), F.lit(DEFAULT_BODY_SIZE))


def page_sections(lines: Column, sizes: Column) -> Column:
    """Sections of one page of ``lines array<struct<size,text>>``: a line well above body size opens one."""
    body = body_size(sizes)
    marked = F.transform(lines, lambda x, i: F.struct(
        T.strip(x["text"]).alias("t"), ((i > 0) & (x["size"] >= body * HEADING_FACTOR) & (T.strip(x["text"]) != "")).alias("h")))
    # lines of a page may be empty, so the seam is a control character lines cannot hold after cleaning
    seam = "\x1e"
    joined = F.array_join(F.transform(marked, lambda m: F.concat(
        F.when(m["h"], seam).otherwise(""), F.replace(m["t"], F.lit(seam), F.lit(" ")))), "\n")
    return F.when(F.size(lines) > 0, F.split(joined, "\n" + seam)).otherwise(F.expr("array()").cast("array<string>"))


def image_mime(ext: Column) -> Column:
    return F.when(F.contains(ext, F.lit("/")), ext).otherwise(F.concat(F.lit("image/"), ext))


_PAGES = ("page int, sizes array<double>, lines array<struct<size:double,text:string>>, text string, "
          "tables array<string>, images array<struct<ext:string,data:binary>>")


def pdf_pages(files: DataFrame, ocr_only: bool = False) -> DataFrame:
    """One row per PDF page with its lines, tables and images. Needs PyMuPDF on the executors."""
    schema = f"source_id {files.schema['source_id'].dataType.simpleString()}, {_PAGES}"

    def ocr(page) -> str:
        try:
            return page.get_text(textpage=page.get_textpage_ocr())
        except Exception:
            return ""

    def read(batches):
        import fitz

        for batch in batches:
            rows = []
            for ident, content in zip(batch["source_id"], batch["content"]):
                with fitz.open(stream=bytes(content), filetype="pdf") as doc:
                    for number, page in enumerate(doc):
                        text = "" if ocr_only else page.get_text("text").strip()
                        recognised = ocr(page).strip() if len(text) < OCR_BELOW_CHARS else ""
                        used = len(recognised) >= OCR_BELOW_CHARS or ocr_only
                        spans = [] if ocr_only else [ln["spans"] for b in page.get_text("dict")["blocks"] if b["type"] == 0 for ln in b["lines"]]
                        images = [] if ocr_only else [page.parent.extract_image(i[0]) for i in page.get_images(full=True)]
                        rows.append({
                            "source_id": ident, "page": number, "text": recognised if used else text,
                            "sizes": [float(s["size"]) for ln in spans for s in ln],
                            "lines": [{"size": float(max((s["size"] for s in ln), default=0)), "text": "".join(s["text"] for s in ln)} for ln in spans],
                            "tables": [] if used else [t.to_markdown() for t in page.find_tables()],
                            "images": [{"ext": i["ext"], "data": i["image"]} for i in images if i]})
            yield pd.DataFrame(rows, columns=["source_id", *[c.split()[0] for c in _PAGES.split(", ") if " " in c and not c.startswith("text:")]])

    return files.select("source_id", "content").mapInPandas(read, schema)


def parse_document(files: DataFrame, plans: DataFrame, by_extension: bool = True) -> DataFrame:
    """Chunks of the readable ones of ``files(source_id, file_name, content)`` by the parser of their plan."""
    return parse_files(files, plans, by_extension)[0]


def parse_files(files: DataFrame, plans: DataFrame, by_extension: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chunks, errors): chunks of the readable files, and ``(source_id, error)`` of the others.

    Each parser is one branch over its own files. A broken file, an unknown parser or one that is not installed fails its source.
    """
    planned = files.join(plans.select("source_id", "selected_parser", "pdf_mode"), "source_id")
    simple = parse_simple(planned.filter("selected_parser = 'simple'"), by_extension)
    rich = stage(read_elements(planned.filter("selected_parser = 'unstructured'")), "elements")
    chunks = simple.select(CHUNK_COLUMNS).unionByName(_element_rows(rich))
    unknown = planned.filter("NOT coalesce(selected_parser, '') IN ('simple', 'unstructured', 'pdf')").select(
        "source_id", F.concat(F.lit("no parser named "), F.coalesce("selected_parser", F.lit("NULL"))).alias("error"))
    errors = unknown.unionByName(rich.filter("error IS NOT NULL").select("source_id", "error"))
    pdf = planned.filter("selected_parser = 'pdf'")
    try:
        import fitz  # noqa: F401
    except ImportError:
        return chunks, errors.unionByName(pdf.select("source_id", F.lit("PDF files need PyMuPDF").alias("error")))
    return chunks.unionByName(parse_pdf(pdf)), errors


def parse_pdf(files: DataFrame) -> DataFrame:
    """Images and tables page by page, then the packed text; OCR-only files are packed page by page."""
    from pyspark.sql import Window

    plain = pdf_pages(files.filter("coalesce(pdf_mode, '') <> 'with_ocr'"))
    scanned = pdf_pages(files.filter("pdf_mode = 'with_ocr'"), ocr_only=True)
    # a file is one row on the way in and its pages one bounded group on the way out
    sections = F.when(F.size("lines") > 0, page_sections(F.col("lines"), F.col("sizes"))).when(
        F.col("text") != "", F.array("text")).otherwise(F.expr("array()").cast("array<string>"))
    per_file = plain.groupBy("source_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("page", sections.alias("s")))), lambda p: p["s"])).alias("s"))
    text = _text_rows(pack_sections(F.col("s")), per_file).withColumn("part", F.lit(2)).withColumn("page", F.lit(0))
    ocr = scanned.filter("text <> ''").select("source_id", "page", F.posexplode(pack_sections(F.array("text"))).alias("chunk_index", "c")).select(
        "source_id", "chunk_index", F.lit("text").alias("chunk_type"), F.col("c.text").alias("text_content"),
        F.coalesce("c.heading", F.lit("")).alias("section_heading"), F.lit(None).cast("binary").alias("image_data"),
        F.lit(None).cast("string").alias("image_mime_type"), F.lit(2).alias("part"), "page")
    image = plain.select("source_id", "page", F.posexplode("images").alias("chunk_index", "i")).select(
        "source_id", "chunk_index", F.lit("image").alias("chunk_type"), F.lit(None).cast("string").alias("text_content"),
        F.lit("").alias("section_heading"), F.col("i.data").alias("image_data"), image_mime(F.col("i.ext")).alias("image_mime_type"),
        F.lit(0).alias("part"), "page")
    table = plain.select("source_id", "page", F.posexplode("tables").alias("chunk_index", "t")).select(
        "source_id", "chunk_index", F.lit("table").alias("chunk_type"), F.col("t").alias("text_content"), F.lit("").alias("section_heading"),
        F.lit(None).cast("binary").alias("image_data"), F.lit(None).cast("string").alias("image_mime_type"), F.lit(1).alias("part"), "page")
    rows = image.unionByName(table).unionByName(text).unionByName(ocr)
    order = Window.partitionBy("source_id").orderBy(F.when(F.col("part") == 2, 1).otherwise(0), "page", "part", "chunk_index")
    return rows.withColumn("chunk_index", F.row_number().over(order) - 1).select(CHUNK_COLUMNS)
