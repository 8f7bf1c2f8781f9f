"""The ingest operator with replaced models, and the memo of their answers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from skein.functions.vectors import hash_embedding
from skein.operators.ingest import Models, ingest
from skein.operators.resolution import offline_reader
from skein.providers import HashEmbedder, ProviderError
from skein.sources.memo import AnswerMemo, ColumnModel, PacedModel
from skein.sources.runs import RunStore


def recording(folder, answer, name="model", **options):
    """A model that leaves a file per text it is asked, in whatever process it runs."""
    os.makedirs(folder, exist_ok=True)

    def call(texts):
        import os
        import uuid
        for text in texts:
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
                out.write(text)
        return [answer(t) for t in texts]

    return PacedModel(name, call, **{"per_second": 1e6, "callers": 2, "pause": 0.0} | options)


def asked(folder):
    return sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder))


def requests(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")


def told(df):
    return {r["id"]: (r["answer"], r["error"]) for r in df.collect()}


def test_memo_asks_each_text_once(spark, tmp_path):
    memo = AnswerMemo(RunStore(spark, str(tmp_path / "memo")))
    model = recording(str(tmp_path / "calls"), lambda t: t.upper())
    rows = requests(spark, "a", "b", "a", "", None)
    expected = {0: ("A", None), 1: ("B", None), 2: ("A", None), 3: (None, "empty text"), 4: (None, "empty text")}
    assert told(memo.answers(rows, model)) == expected
    assert asked(tmp_path / "calls") == ["a", "b"]
    assert told(memo.answers(rows, model)) == expected and asked(tmp_path / "calls") == ["a", "b"]
    assert told(memo.answers(requests(spark, "b", "c"), model)) == {0: ("B", None), 1: ("C", None)}
    assert asked(tmp_path / "calls") == ["a", "b", "c"]
    memo.compact()
    assert len(memo.store.completed()) == 1 and told(memo.answers(rows, model)) == expected
    assert asked(tmp_path / "calls") == ["a", "b", "c"]
    # another model has other answers to the same texts
    other = ColumnModel("other", lambda text: F.concat(text, text))
    assert told(memo.answers(requests(spark, "a"), other)) == {0: ("aa", None)}
    assert memo.answers(rows.limit(0), model).count() == 0


def test_memo_forgets_failures_and_uncommitted_runs(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "memo"))
    memo = AnswerMemo(store)

    def flaky(texts):
        if "bad" in texts:
            raise ProviderError("down")
        return [None if t == "mute" else t for t in texts]

    rows = requests(spark, "good", "bad", "mute")
    model = PacedModel("m", flaky, per_second=1e6, callers=1, attempts=2, pause=0.0)
    assert told(memo.answers(rows, model)) == {0: ("good", None), 1: (None, "down"), 2: (None, "no answer")}
    mended = recording(str(tmp_path / "calls"), lambda t: t, "m")
    assert told(memo.answers(rows, mended)) == {0: ("good", None), 1: ("bad", None), 2: ("mute", None)}
    assert asked(tmp_path / "calls") == ["bad", "mute"]
    lost = store.start()
    store.write(lost, memo.TABLE, ColumnModel("m", F.upper).answer(memo.calls().limit(0).withColumn("text", F.lit("x")), "string"))
    assert lost not in store.completed() and memo.known().count() == 3


def test_batches_and_wrong_counts(spark, tmp_path):
    memo = AnswerMemo(RunStore(spark, str(tmp_path / "v")), "array<float>")
    model = PacedModel("vec", lambda texts: [[float(len(t)), 1.0] for t in texts], per_second=1e6, callers=1, batch=3)
    assert told(memo.answers(requests(spark, "a", "bb", "ccc", "dddd"), model)) == {i: ([i + 1.0, 1.0], None) for i in range(4)}
    short = PacedModel("short", lambda texts: [], per_second=1e6, callers=1)
    assert told(memo.answers(requests(spark, "a"), short)) == {0: (None, "the model returned another number of answers than texts")}


def test_calls_are_paced(spark, tmp_path):
    import time
    memo = AnswerMemo(RunStore(spark, str(tmp_path / "memo")))
    start = time.time()
    memo.answers(requests(spark, *"abcdef"), PacedModel("slow", lambda texts: texts, per_second=5, callers=1))
    assert time.time() - start >= 1.0


# --- ingest -------------------------------------------------------------------------------------------
def reader():
    """Capitalised words are entities, related in order; some texts get bad answers."""
    def answer(text):  # made inside, so that tasks get it by value
        import json
        if "garbled" in text:
            return "{"
        names = [w for w in text.split() if w[0].isupper()]
        ends = [(0, 9)] if "dangling" in text else [(i, i + 1) for i in range(len(names) - 1)]
        return json.dumps({
            "entities": [{"surface_form": n, "canonical_name": n, "entity_type": "concept", "description": n} for n in names],
            "relations": [{"source_idx": a, "target_idx": b, "relation_type": "to"} for a, b in ends]})

    return answer


@pytest.fixture
def graph(spark):
    return spark.createDataFrame([(1, "Alpha", "concept", "x")], "entity_id bigint, name string, entity_type string, description string").withColumn(
        "embedding", hash_embedding(F.lit("Alpha Alpha"), 64))


def run(spark, tmp_path, graph, texts, decide=None):
    sources = spark.createDataFrame(texts, "source_id bigint, text string")
    memo = {n: AnswerMemo(RunStore(spark, str(tmp_path / n)), kind) for n, kind in
            (("vectors", "array<float>"), ("read", "string"), ("decide", "string"))}
    models = Models(memo["vectors"].ask(ColumnModel("hash", HashEmbedder().embed)),
                    memo["read"].ask(recording(str(tmp_path / "calls"), reader(), "reader")),
                    memo["decide"].ask(recording(str(tmp_path / "decided"), decide, "decider")) if decide else None)
    return ingest(sources, graph, models, lambda source, n: source * 1000 + n)


TEXTS = [(1, "Alpha meets Beta"), (2, "Beta meets Gamma"), (3, "garbled"), (4, "Delta dangling"), (5, ""), (6, None), (7, "Alpha meets Beta")]


def test_ingest_isolates_failures_and_repeats_no_call(spark, tmp_path, graph):
    done = run(spark, tmp_path, graph, TEXTS)
    states = {r["source_id"]: r["status"] for r in done.sources.collect()}
    assert states == {1: "processed", 2: "processed", 3: "failed", 4: "failed", 5: "failed", 6: "failed", 7: "processed"}
    assert {r["chunk_id"]: r["error"] for r in done.errors.collect()} == {
        3000: "invalid JSON", 4000: "relation references unresolved entity index"}
    assert sorted(r["name"] for r in done.entities.collect()) == ["Beta", "Gamma"]  # Delta is named by a failed chunk only
    links = {}
    for r in done.links.collect():
        links.setdefault(r["chunk_id"], set()).add(r["entity_id"])
    assert set(links) == {1000, 2000, 7000} and 1 in links[1000] and links[1000] == links[7000]
    assert done.relations.count() == 3 and done.merge_log.collect()[0]["merged_into_id"] == 1
    jobs = sorted((r["source_id"], r["job_type"]) for r in done.jobs.collect())
    assert jobs == [(s, k) for s in (1, 2, 7) for k in ("synthesize_entity", "synthesize_entity", "synthesize_source_summary")]
    assert done.chunks.filter("embedding IS NULL").count() == 0
    # equal texts share a call, and a second run makes none
    assert asked(tmp_path / "calls") == ["Alpha meets Beta", "Beta meets Gamma", "Delta dangling", "garbled"]
    again = run(spark, tmp_path, graph, TEXTS)
    assert len(asked(tmp_path / "calls")) == 4
    for name, table in done.tables().items():
        columns = [c for c in table.columns if c != "embedding"]
        assert sorted(map(str, again.tables()[name].select(columns).collect())) == sorted(map(str, table.select(columns).collect())), name


def test_ingest_of_nothing(spark, tmp_path, graph):
    done = run(spark, tmp_path, graph, [(1, "")])
    assert [r["status"] for r in done.sources.collect()] == ["failed"]
    assert all(done.tables()[n].count() == 0 for n in ("chunks", "entities", "links", "relations", "jobs", "errors"))


def test_decider_chooses_among_offered(spark, tmp_path, graph):
    def decide(text):
        import json
        assert json.loads(text)["candidates"] == "1. ID=1 name='Alpha'"
        return json.dumps({"decision": "new", "reasoning": "other"})

    done = run(spark, tmp_path, graph, [(1, "Alpha meets Beta")], decide)
    assert sorted(r["name"] for r in done.entities.collect()) == ["Alpha", "Beta"] and done.merge_log.count() == 0
    assert len(asked(tmp_path / "decided")) == 1  # Beta has no similar entity, so nobody is asked


@pytest.mark.parametrize("answer", ['{"decision": "merge"}', '{"decision": "merge", "merged_into_id": 77}', "{", None])
def test_bad_decision_fails_its_chunks(spark, tmp_path, graph, answer):
    done = run(spark, tmp_path, graph, [(1, "Alpha meets Beta"), (2, "Gamma")], lambda text: answer)
    assert {r["source_id"]: r["status"] for r in done.sources.collect()} == {1: "failed", 2: "processed"}
    error = done.errors.collect()
    assert len(error) == 1 and error[0]["error"] == ("no answer" if answer is None else "merge decision does not match the schema")
    assert [r["name"] for r in done.entities.collect()] == ["Gamma"]


def test_merge_by_decision(spark, tmp_path, graph):
    done = run(spark, tmp_path, graph, [(1, "Alpha")], lambda text: '{"decision": "merge", "merged_into_id": 1, "reasoning": "same"}')
    assert [(r["merged_into_id"], r["reason"]) for r in done.merge_log.collect()] == [(1, "same")]
    assert done.entities.count() == 0 and [r["entity_id"] for r in done.links.collect()] == [1]


def test_offline_reader_is_a_column_model(spark, tmp_path):
    memo = AnswerMemo(RunStore(spark, str(tmp_path / "m")))
    found = told(memo.answers(requests(spark, "One Two"), ColumnModel("offline", offline_reader)))
    assert [e["canonical_name"] for e in json.loads(found[0][0])["entities"]] == ["One", "Two"]
