import pytest
from pyspark.sql import functions as F

from skein.functions import text as T, vectors as V


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["_"])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,tokens", [("", 1), ("abcd", 1), ("a" * 8, 2), ("é😀" * 4, 2)])
def test_tokens(spark, text, tokens):
    assert one(spark, T.estimate_tokens(F.col("t")), t=text) == tokens


@pytest.mark.parametrize("name,slug", [
    ("Acme Corp", "acme-corp"), ("NASA", "nasa"), ("C++ / Python", "c-python"), ("Hello   World!!", "hello-world"), ("---Leading---", "leading")])
def test_slug(spark, name, slug):
    ident = "12345678-aaaa-bbbb-cccc-1234567890ab"
    assert one(spark, T.slug(F.col("n"), F.col("i")), n=name, i=ident) == slug + "-12345678"


def test_strip_knows_unicode_blanks(spark):
    assert one(spark, T.strip(F.col("t")), t="   a b　\n\x1f") == "a b"


def test_excerpt_and_first_line(spark):
    long = "word " * 60
    cut = one(spark, T.excerpt(F.col("t")), t=long + "\n\nnext")
    assert cut.endswith("word...") and len(cut) <= 203
    assert one(spark, T.excerpt(F.col("t")), t="short\n\nnext") == "short"
    assert one(spark, T.excerpt(F.col("t")), t="x" * 300) == "x" * 200 + "..."
    assert one(spark, T.first_line_summary(F.col("t")), t="y" * 81 + "\nz") == "y" * 77 + "..."
    assert one(spark, T.first_line_summary(F.col("t")), t="") == ""


def test_title_case(spark):
    assert one(spark, T.title_case(F.col("t")), t="foo-bar baz_qux o'neil") == "Foo-Bar Baz_Qux O'Neil"


def test_txt_sections(spark):
    text = "INTRO\nabc\n\n\nnext  \n foo:\nbar\n\nsame"
    assert one(spark, T.txt_sections(F.col("t")), t=text) == ["INTRO\nabc", "next", "foo:\nbar\nsame"]
    assert one(spark, T.txt_sections(F.col("t")), t="ABC\nabcd") == ["ABC\nabcd"]
    assert one(spark, T.txt_sections(F.col("t")), t="x\n" + "A" * 100 + "\n" + "B" * 99) == ["x\n" + "A" * 100, "B" * 99]


def test_md_sections(spark):
    text = "# One\ntext\n\n  ## Two\nmore\n#no heading\n####### seven"
    assert one(spark, T.md_sections(F.col("t")), t=text) == ["# One\ntext\n", "  ## Two\nmore\n#no heading\n####### seven"]


def test_wiki_sections_and_priority(spark):
    content = "# E\nprose\n\n## Sources\ns\n## Relations\nr\n## Odd\no"
    parts = one(spark, T.wiki_sections(F.col("t")), t=content)
    assert [(p["tag"], p["text"]) for p in parts] == [
        ("entity_prose", "# E\nprose\n"), ("sources", "## Sources\ns"), ("relationships", "## Relations\nr"), ("other", "## Odd\no")]
    assert one(spark, T.section_priority(F.col("t")), t="other") == 4
    assert one(spark, T.section_priority(F.col("t")), t="pages_created") == 0
    assert one(spark, T.wiki_sections(F.col("t")), t="") == []


@pytest.mark.parametrize("value,line", [
    ("plain", "k: plain"), ("a: b", 'k: "a: b"'), ('say "x"', 'k: "say \\"x\\""'), ("a\\:b", 'k: "a\\\\:b"'), ("a\nb", "k: |\n  a\n  b")])
def test_yaml_field(spark, value, line):
    assert one(spark, T.yaml_field("k", F.col("v")), v=value) == line


def test_lock_key_is_positive(spark):
    import hashlib
    for name in ("abc", "Ünï", ""):
        want = int.from_bytes(hashlib.md5(name.encode()).digest()[:8], "big") % (2**63 - 1)
        assert one(spark, T.lock_key(F.col("n")), n=name) == want


def test_json_payload(spark):
    assert one(spark, T.json_payload(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.json_payload(F.col("t")), t=' {"a": 1} ') == '{"a": 1}'


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])],
                               "a array<float>, b array<float>")
    rows = df.select(V.cosine(F.col("a"), F.col("b")), V.cosine_batch("a", "b"), V.cosine_distance(F.col("a"), F.col("b")), V.l2(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows][0] == (1.0, 1.0, 0.0, 0.0)
    assert [r[0] for r in rows] == [1.0, 0.0, -1.0, 0.0] == [r[1] for r in rows]
    assert [r[2] for r in rows] == [0.0, 1.0, 2.0, 0.0]
    with pytest.raises(Exception, match="dimension mismatch"):
        spark.sql("SELECT array(1f) a, array(1f, 2f) b").select(V.cosine(F.col("a"), F.col("b"))).collect()
    assert spark.sql("SELECT array(1f) a, array(1f, 2f) b").select(V.cosine_batch("a", "b")).first()[0] is None


@pytest.mark.parametrize("d,q", [(0.15, "high"), (0.2, "low"), (0.3, "low"), (0.4, "low"), (0.41, "poor")])
def test_seed_quality(spark, d, q):
    assert one(spark, V.seed_quality(F.col("d")), d=d) == q


def test_hash_embedding_is_the_digest(spark):
    import hashlib
    got = one(spark, V.hash_embedding(F.col("t"), 70), t="abc")
    digest = hashlib.sha256(b"abc").digest()
    assert got == pytest.approx([digest[i % 32] / 127.5 - 1 for i in range(70)], abs=1e-6)


def test_slug_keeps_whole_numbers(spark):
    rows = spark.range(10**9, 10**9 + 51).select(T.slug(F.lit("Same Name"), F.col("id")).alias("s"))
    assert rows.distinct().count() == 51
    uuid = spark.range(1).select(T.slug(F.lit("A"), F.lit("12345678-9abc-def0-1234-56789abcdef0")).alias("s")).first().s
    assert uuid == "a-12345678"
