"""Periodic runs against a search over all periods and places."""

import hashlib
import random
import re
import time
from zlib import crc32

import pytest

from skein.llm import periods, queries

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=24, times=3):
    """``(start, length, period)``: maximal agreeing stretches of each period; one interval keeps its smallest period."""
    n, best = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in best.items())


def local_runs(words, **options):
    """Fragments of small tiles, stitched here as ``stitch`` does on Spark."""
    best = {}
    for q, s, e in periods._merged(periods.fragments(words, **options)):
        best[s, e] = min(q, best.get((s, e), q))
    return sorted((s, e - s, q) for (s, e), q in best.items())


def sample(seed):
    rng = random.Random(seed)
    out = []
    while len(out) < rng.randint(20, 700):
        kind = rng.random()
        if kind < 0.5:
            unit = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, rng.choice([3, 12, 70])))]
            out += (unit * rng.randint(2, 9))[:rng.randint(1, 400)]
        else:
            out += [b"x%d" % rng.randrange(1000) for _ in range(rng.randint(1, 40))]
    return out


@pytest.mark.parametrize("seed", range(60))
def test_tiles_find_all_runs(seed):
    words = sample(seed)
    wanted = brute_runs(words)
    assert local_runs(words) == wanted
    assert local_runs(words, boundaries=2) == wanted
    assert local_runs(words, boundaries=5) == wanted


def test_many_periods_go_through_z_functions(monkeypatch):
    monkeypatch.setattr(periods, "DIRECT", 0)
    for seed in range(60, 90):
        words = sample(seed)
        assert local_runs(words, boundaries=3) == brute_runs(words)


def test_other_bounds():
    words = sample(7) + [b"a", b"b"] * 40
    assert local_runs(words, least=40, times=5) == brute_runs(words, 40, 5)
    with pytest.raises(ValueError):
        periods.find_runs(None, least=10)


def test_z_function():
    a = [1, 1, 2, 1, 1, 2, 1, 3]
    assert periods.z_function(a) == [next((k for k in range(len(a) - i) if a[k] != a[i + k]), len(a) - i) for i in range(len(a))]
    assert periods.z_function([]) == []


def test_long_uniform_text_is_near_linear():
    start = time.time()
    assert local_runs([b"same"] * 60_000) == [(0, 60_000, 1)]
    period = [b"p%d" % i for i in range(3_001)]
    assert local_runs(period * 100) == [(0, 300_100, 3_001)]
    assert time.time() - start < 60


def expected(doc_id, text, arrange=True):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(words)
    h = crc32(str(doc_id).encode())
    if arrange and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words) if len(set(words)) < n else []
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return doc_id, len(runs), *told, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def table(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))
                   for r in df.collect()), key=repr)


ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "na " * 30), (5, "na " * 30), (6, "a\x1fb c " * 12 + "tail"), (None, "x y " * 20),
        (7, "　wide  é " * 25), (8, "k l m " * 9 + "k l m n " * 9), (9, " ".join(f"w{i}" for i in range(3000))), (10, "b " * 23), (11, "b " * 24)]


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in ROWS], "doc_id long, text string, period int, row_id int, sha string")
    assert table(periods.run_report(docs, arrange=queries.repeated_tail)) == sorted((expected(*r) for r in ROWS), key=repr)
    assert table(periods.run_report(docs.limit(0))) == []


def test_query_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    docs = [(r[0], r[1]) for r in docs if r[1] is None or len(r[1]) < 30_000]
    found = [r for r in table(queries.QUERIES["op13_periodic_runs"](spark, SF)) if r[0] in {d for d, _ in docs}]
    assert found == sorted((expected(*r) for r in docs), key=repr)


def test_collapsed_texts_keep_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in ROWS], "doc_id long, text string, sha string")
    out = periods.collapsed_texts(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    texts = sorted((r["text"] or "" for r in out.where("doc_id = 5 or doc_id = 8 or doc_id = 4").collect()))
    assert texts == ["k l m n", "na", "na", "one two"]
