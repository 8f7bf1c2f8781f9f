from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from skein.operators.chunking import chunk_documents, pack_sections


def pack(spark, sections):
    df = spark.createDataFrame([(sections,)], "s array<string>")
    return [(c["text"], c["heading"]) for c in df.select(pack_sections(F.col("s")).alias("c")).first()["c"]]


def test_small_sections_join(spark):
    assert pack(spark, []) == []
    assert pack(spark, ["one\nline"]) == [("one\nline", "one")]
    assert pack(spark, ["a", "b", "c"]) == [("a\n\nb\n\nc", "a")]


def test_full_sections_stay_apart_and_overlap(spark):
    a, b = "a" * 1500, "b" * 1500
    got = pack(spark, [a, b])
    assert got == [(a, a), ("a" * 256 + b, b)]


def test_long_paragraph_is_sliced_with_stride(spark):
    text = "".join(chr(97 + i % 26) for i in range(5000))
    got = pack(spark, [text])
    assert [len(t) for t, _ in got] == [2048, 2304, 1672]
    assert got[0] == (text[:2048], text[:80])
    assert got[1][0] == text[:2048][-256:] + text[1792:3840]
    assert got[1][1] == got[1][0]


def test_paragraphs_of_a_long_section(spark):
    p = ["x" * 1200, "y" * 1200, "z"]
    got = pack(spark, ["\n\n".join(p), "tail"])
    # the last paragraph stays open and takes the next section
    assert [t[-len(q):] for (t, _), q in zip(got, ["x" * 1200, "y" * 1200, "z\n\ntail"])] == ["x" * 1200, "y" * 1200, "z\n\ntail"]
    assert len(got) == 3


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abc \n", min_size=1, max_size=40).map(lambda s: ("k" + s) * 20), min_size=1, max_size=8))
def test_chunks_without_overlap_rebuild_the_text(spark, sections):
    got = pack(spark, sections)
    assert all(len(t) <= 2048 + 256 for t, _ in got)
    bodies = [got[0][0]]
    for (prev, _), (text, _) in zip([(b, 0) for b in [got[0][0]]] + got[1:], got[1:]):
        bodies.append(text[min(256, len(bodies[-1])):])
    squeezed = "".join("".join(b.split()) for b in bodies)
    assert squeezed == "".join("".join(s.split()) for s in sections)


def test_whole_documents(spark):
    df = spark.createDataFrame([(1, "A TITLE\nbody"), (2, ""), (3, None)], "id long, text string")
    rows = chunk_documents(df, "id").collect()
    assert [(r.id, r.chunk_index, r.text_content, r.section_heading) for r in rows] == [(1, 0, "A TITLE\nbody", "A TITLE")]
