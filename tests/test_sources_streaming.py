import datetime as dt
import io
import zipfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from skein import providers as P
from skein.operators.planning import plan_sources
from skein.sources import html as H, readers as RD, sinks
from skein.streaming.ingest import landed_chunks, run_once
from skein.streaming.worker import JOB_SCHEMA, Worker

T0 = dt.datetime(2024, 1, 1)


def test_html_elements_and_sections(spark):
    page = """<html><head><title>x</title></head><body><h1>Top &amp; more</h1><p>One<br>two</p><script>no</script>
    <table><tr><td>a</td><td>b</td></tr></table><h2>Next</h2><ul><li>item</li></ul><img alt="pic" src="p.png"></body></html>"""
    df = spark.createDataFrame([(1, page), (2, "")], "source_id long, html string")
    got = [(r.kind, r.text) for r in H.elements(df).orderBy("source_id", "pos").collect()]
    assert got == [("title", "Top & more"), ("text", "One"), ("text", "two"), ("table", "a b"), ("title", "Next"), ("text", "item"), ("image", "pic")]
    chunks = [(r.chunk_index, r.chunk_type, r.text_content) for r in H.html_chunks(df).orderBy("chunk_index").collect()]
    assert chunks == [(0, "table", "a b"), (1, "text", "Top & more\nOne\ntwo\n\nNext\nitem")]


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    return out.getvalue()


def test_documents_by_plan(spark, tmp_path):
    files = {"a.txt": b"HEAD\nbody \xff", "b.md": b"# One\nx\n## Two\ny", "c.html": b"<h1>T</h1><p>p</p>", "d.docx": docx(("Heading1", "Title"), ("Normal", "text"))}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    blobs = RD.list_blobs(spark, str(tmp_path))
    assert [r.key for r in blobs.select("key").orderBy("key").collect()] == sorted(files)
    ids = {n: i for i, n in enumerate(sorted(files))}
    rows = blobs.select(F.element_at(F.create_map(*[F.lit(x) for p in ids.items() for x in p]), F.col("key")).cast("long").alias("source_id"),
                        F.col("key").alias("file_name"), "content")
    plans = plan_sources(rows.select("source_id", "file_name", F.lit("k").alias("storage_key"), F.lit(1).alias("file_size"), F.lit(None).cast("string").alias("metadata")))
    got = {(r.source_id, r.chunk_index): (r.chunk_type, r.text_content) for r in RD.parse_document(rows, plans).collect()}
    assert got == {(0, 0): ("text", "HEAD\nbody �"), (1, 0): ("text", "# One\nx\n\n## Two\ny"), (2, 0): ("text", "T\np"),
                   (3, 0): ("table", "cell"), (3, 1): ("text", "Title\ntext")}
    flat = RD.parse_simple(rows.filter("file_name = 'b.md'"), by_extension=False).first()
    assert flat.text_content == "# One\nx\n## Two\ny"


def test_bad_files_fail_alone(spark):
    """A broken file, an unknown parser and a missing reader each fail their source; the others keep their chunks."""
    rows = spark.createDataFrame([(1, "a.docx", bytearray(b"no archive")), (2, "b.txt", bytearray(b"good")), (3, "c.html", bytearray(b"<p>fine</p>")), (4, "d.txt", bytearray(b"x")),
                                  (5, "e.docx", bytearray(docx(("Normal", "text"))))], "source_id long, file_name string, content binary")
    named = rows.select("source_id", "file_name", F.lit("k").alias("storage_key"), F.lit(1).alias("file_size"),
                        F.when(F.col("source_id") == 4, '{"parser": "nosuch"}').alias("metadata"))
    chunks, errors = RD.parse_files(rows, plan_sources(named))
    assert {r.source_id for r in chunks.collect()} == {2, 3, 5}
    found = {r.source_id: r.error for r in errors.collect()}
    assert found[4] == "no parser named nosuch" and found[1].startswith("BadZipFile") and set(found) == {1, 4}


def test_pdf_rules(spark):
    df = spark.range(1)
    assert df.select(RD.body_size(F.array(F.lit(9.0), F.lit(12.0), F.lit(0.0), F.lit(10.0), F.lit(30.0)))).first()[0] == 12.0
    assert df.select(RD.body_size(F.expr("array()").cast("array<double>"))).first()[0] == 11.0
    lines = spark.createDataFrame([([(10.0, "intro"), (18.0, " Head "), (10.0, "x"), (20.0, " ")],)], "l array<struct<size:double,text:string>>")
    assert lines.select(RD.page_sections(F.col("l"), F.array(F.lit(10.0)))).first()[0] == ["intro", "Head\nx\n"]
    assert df.select(RD.image_mime(F.lit("jpeg")), RD.image_mime(F.lit("image/png"))).first() == ("image/jpeg", "image/png")


def test_keys_stay_inside_the_root(tmp_path):
    assert RD.safe_key("/r", "a/../b.md") == "/r/b.md"
    for bad in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(ValueError):
            RD.safe_key("/r", bad)
    sinks.write_text(str(tmp_path), "x/y.md", "é")
    assert sinks.read_text(str(tmp_path), "x/y.md") == "é" and sinks.read_text(str(tmp_path), "none") is None
    assert sinks.delete_text(str(tmp_path), "x/y.md") and not sinks.delete_text(str(tmp_path), "x/y.md")
    assert sinks.content_type("a.md") == "text/markdown; charset=utf-8" and sinks.content_type("a.bin") == "application/octet-stream"


def test_providers(spark):
    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise P.ProviderError("busy")
        return x

    assert P.with_retries(flaky, sleep=waits.append)(5) == 5 and waits == [2.0, 4.0]
    with pytest.raises(P.ProviderError):
        P.with_retries(lambda: (_ for _ in ()).throw(P.ProviderError("down")), sleep=waits.append)()
    df = spark.createDataFrame([("ab",), ("",), (None,)], "t string").coalesce(1)
    got = df.select(P.BatchEmbedder(lambda texts: [[float(len(t))] for t in texts]).embed(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == [[2.0], None, None]
    read = df.select(P.BatchReader(lambda t: '{"x": 1}')(F.col("t")).alias("a")).collect()
    assert [r.a for r in read] == ['{"x": 1}', None, None]
    img = spark.sql("SELECT 'image' AS chunk_type, X'01' AS image_data, 'image/png' AS image_mime_type, CAST(NULL AS STRING) AS text_content")
    assert P.captioned(img).first().text_content == "image (image/png)"
    with pytest.raises(ValueError):
        P.get(P.EMBEDDERS, "nope")


def test_worker_completes_retries_and_fails(spark, tmp_path):
    arrivals, state = str(tmp_path / "in"), str(tmp_path / "state")
    rows = [(i, kind, None, None, "pending", None, 0, 3, T0) for i, kind in enumerate(["good", "bad", "later", "odd"])]
    spark.createDataFrame(rows, JOB_SCHEMA).coalesce(1).write.parquet(arrivals)

    def outcome(error, released):
        return lambda jobs: jobs.select("job_id", F.lit(error).cast("string").alias("error"), F.lit(released).alias("released"))

    worker = Worker(spark, arrivals, state, {"good": outcome(None, False), "bad": outcome("boom", False), "later": outcome(None, True)})
    worker.start(str(tmp_path / "cp"), once=True).awaitTermination()
    closed = {r.job_id: (r.status, r.attempts, r.error_message) for r in worker.closed_jobs().collect()}
    assert closed == {0: ("completed", 0, None), 1: ("failed", 4, "boom"), 3: ("failed", 4, "unknown job type: odd")}
    assert [(r.job_id, r.status, r.attempts) for r in worker.open_jobs(0).collect()] == [(2, "pending", 0)]
    spark.createDataFrame([(9, "good", None, None, "pending", None, 0, 3, T0)], JOB_SCHEMA).coalesce(1).write.mode("append").parquet(arrivals)
    worker.start(str(tmp_path / "cp"), once=True).awaitTermination()
    assert {r.job_id for r in worker.closed_jobs().collect()} == {0, 1, 3, 9}
    assert [r.job_id for r in worker.open_jobs(1).collect()] == [2]


def test_worker_leaves_no_job_undone(spark, tmp_path):
    """Far more jobs than one claim holds, some of them failing: all are closed by one batch."""
    arrivals, state = str(tmp_path / "in"), str(tmp_path / "state")
    rows = [(i, "bad" if i % 20 == 0 else "good", None, None, "pending", None, 0, 1, T0) for i in range(60)]
    spark.createDataFrame(rows, JOB_SCHEMA).coalesce(1).write.parquet(arrivals)

    def outcome(error):
        return lambda jobs: jobs.select("job_id", F.lit(error).cast("string").alias("error"), F.lit(False).alias("released"))

    worker = Worker(spark, arrivals, state, {"good": outcome(None), "bad": outcome("boom")}, claim=10)
    worker.start(str(tmp_path / "cp"), once=True).awaitTermination()
    closed = {r.job_id: r.status for r in worker.closed_jobs().collect()}
    assert closed == {i: "failed" if i % 20 == 0 else "completed" for i in range(60)} and worker.open_jobs(0).isEmpty()
    with pytest.raises(AnalysisException):
        worker.open_jobs(7)


def test_drain_without_arrivals(spark, tmp_path):
    arrivals, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([(1, "later", None, None, "pending", None, 0, 3, T0)], JOB_SCHEMA).coalesce(1).write.parquet(arrivals)

    def outcome(released):
        return lambda jobs: jobs.select("job_id", F.lit(None).cast("string").alias("error"), F.lit(released).alias("released"))

    Worker(spark, arrivals, state, {"later": outcome(True)}).start(str(tmp_path / "cp"), once=True).awaitTermination()
    worker = Worker(spark, arrivals, state, {"later": outcome(False)})
    assert worker.open_jobs(0).count() == 1
    worker.drain()
    assert worker.open_jobs(0).isEmpty() and [r.status for r in worker.closed_jobs().collect()] == ["completed"]


def test_landed_files_become_chunks_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ONE TITLE\nx")
    for _ in range(2):
        run_once(landed_chunks(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r.text_content for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["ONE TITLE\nx"]
