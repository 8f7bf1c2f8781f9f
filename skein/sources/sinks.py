"""Bundle writer: changed pages, index files, manifest table and log, on any file system Arrow knows."""

from __future__ import annotations

import posixpath
import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.operators import export as E
from skein.session import stage
from skein.sources.readers import safe_key

MANIFEST = ".export-manifest"
LOG = "log.md"
# Content type of a stored text by extension.
CONTENT_TYPES = {"md": "text/markdown", "json": "application/json", "txt": "text/plain", "html": "text/html"}
_INDEX_HEADS = {"index.md": "# Wiki Index\n", "entities/index.md": "# Entities\n", "sources/index.md": "# Source Summaries\n"}


def content_type(key: str) -> str:
    return CONTENT_TYPES.get(key.rsplit(".", 1)[-1].lower(), "application/octet-stream") + (
        "; charset=utf-8" if key.endswith((".md", ".txt", ".html")) else "")


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else "file://" + posixpath.abspath(root))


def write_text(root: str, key: str, content: str) -> None:
    files, base = _open(root)
    path = safe_key(base, key)
    files.create_dir(posixpath.dirname(path), recursive=True)
    with files.open_output_stream(path) as out:
        out.write(content.encode("utf-8"))


def read_text(root: str, key: str) -> str | None:
    from pyarrow.fs import FileType

    files, base = _open(root)
    path = safe_key(base, key)
    if files.get_file_info(path).type != FileType.File:
        return None
    with files.open_input_stream(path) as src:
        return src.read().decode("utf-8")


def delete_text(root: str, key: str) -> bool:
    """Delete one file of the bundle; a missing file is not an error."""
    files, base = _open(root)
    try:
        files.delete_file(safe_key(base, key))
        return True
    except FileNotFoundError:
        return False


def load_manifest(spark: SparkSession, root: str) -> DataFrame:
    """``(path, content_hash)`` of the last export; empty when missing or unreadable."""
    empty = spark.createDataFrame([], "path string, content_hash string")
    current = read_text(root, f"{MANIFEST}/current")
    if not current:
        return empty
    try:
        found = spark.read.parquet(f"{root}/{MANIFEST}/{current.strip()}")
        return found.select("path", "content_hash") if {"path", "content_hash"} <= set(found.columns) else empty
    except AnalysisException:
        return empty


def _each_file(df: DataFrame, act, name: str) -> int:
    """Run ``act(row)`` for every row inside the tasks and return how many files were touched."""
    def run(batches):
        for batch in batches:
            n = sum(bool(act(row)) for row in batch.itertuples(index=False))
            yield pd.DataFrame({"n": [n]})

    return df.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name)).first()[0]


def export_bundle(pages: DataFrame, entities: DataFrame, sources: DataFrame, root: str, api_base_url: str, run_id: str,
                  run_time: str) -> int:
    """Write what changed since the last export and return the number of added or modified pages.

    Files are written by the tasks that hold them. The manifest is a new table per run, and only the
    final switch of ``current`` makes it count, so an interrupted run is redone by the next one.
    """
    spark = pages.sparkSession
    rendered = stage(E.render(pages, entities, sources, api_base_url), "rendered")
    diff = stage(E.manifest_diff(load_manifest(spark, root), rendered), "diff")
    changed = rendered.join(diff.filter("action IN ('added', 'modified')").select("path"), "path", "left_semi")

    def put(row) -> bool:
        write_text(root, row.path, row.rendered)
        return True

    count = _each_file(changed.select("path", "rendered"), put, "written")
    _each_file(diff.filter("action = 'removed'").select("path"), lambda row: delete_text(root, row.path), "deleted")
    _write_index(E.index_lines(pages, entities), root)
    rendered.select("path", "content_hash").write.mode("overwrite").parquet(f"{root}/{MANIFEST}/{run_id}")
    _append_log(E.log_entries(diff, rendered), root, run_id, run_time)
    write_text(root, f"{MANIFEST}/current", run_id)
    return count


def _write_lines(rows: DataFrame, order: list, root: str, key: str, begin: str, keep: bool) -> None:
    """One text file of the rows' ``head`` and ``line`` in order, streamed by a single task that holds one batch at a time.

    ``head`` opens a block where it changes. With ``keep`` the file's earlier content comes first. The file is written beside
    its place and then moved there, so a task that runs again leaves no part twice.
    """
    def put(batches):
        files, base = _open(root)
        path = safe_key(base, key)
        files.create_dir(posixpath.dirname(path), recursive=True)
        attempt, last, n = f"{path}.{uuid.uuid4().hex}", None, 0
        with files.open_output_stream(attempt) as out:
            if keep:
                _copy_old(files, path, out)
            out.write(begin.encode("utf-8"))
            for batch in batches:
                for head, line in zip(batch["head"], batch["line"]):
                    if head != last:
                        out.write((("\n" if last is not None else "") + head).encode("utf-8"))
                        last = head
                    out.write((line + "\n").encode("utf-8"))
                    n += 1
        files.move(attempt, path)
        yield pd.DataFrame({"n": [n]})

    # sorted by many tasks, read by one: a single file has a single writer
    rows.orderBy(*order).select("head", "line").coalesce(1).mapInPandas(put, "n long").count()


def _copy_old(files, path: str, out) -> None:
    from pyarrow.fs import FileType

    if files.get_file_info(path).type != FileType.File:
        return
    last = b"\n"
    with files.open_input_stream(path) as old:
        while piece := old.read(1 << 20):
            out.write(piece)
            last = piece[-1:]
    if last != b"\n":
        out.write(b"\n")


def _write_index(lines: DataFrame, root: str) -> None:
    """The three index files, each whole."""
    lines = stage(lines, "index")
    present = {r["index_file"] for r in lines.select("index_file").distinct().collect()}  # at most three rows
    for name, head in _INDEX_HEADS.items():
        if name not in present:
            write_text(root, name, head)
            continue
        title = F.when(F.col("section") == 1, "## Entities\n\n").otherwise("## Source Summaries\n\n") if name == "index.md" else F.lit("")
        _write_lines(lines.filter(F.col("index_file") == name).withColumn("head", title), ["section", "slug"], root, name, head + "\n", False)


def _append_log(entries: DataFrame, root: str, run_id: str, run_time: str) -> None:
    """One headed block per run with changes, behind the blocks of earlier runs."""
    if entries.isEmpty():
        return
    order = [F.when(F.col("action") == "removed", 1).otherwise(0), F.col("path")]
    rows = entries.withColumn("head", F.lit("")).withColumnRenamed("entry", "line")
    _write_lines(rows, order, root, LOG, f"\n## {run_time}\n\n", True)
