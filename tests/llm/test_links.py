"""Near duplicates, near lines, token files and the pipeline, against brute force or an exact round trip."""

from collections import Counter, defaultdict
import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest

from skein.llm import linededup, neardup, queries, tokenfiles

SF = "/root/testdata/sf0.001"


def words(text):
    return [w.decode() for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())]


def weights(text):
    w = words(text)
    return Counter(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def probability_jaccard(a, b):
    keys = set(a) | set(b)
    if max(*a.values(), *b.values()) == 1:
        return len(set(a) & set(b)) / len(keys)
    return sum(1 / sum(max(a[k] / a[s], b[k] / b[s]) for k in keys) for s in a if s in b)


def brute_classes(rows):
    """Smallest id of the component of each row, comparing all pairs."""
    bags = {i: weights(t) for i, t in rows}
    at = {i: i for i, _ in rows}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(i for i in bags if bags[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if root(a) != root(b) and sum((bags[a] & bags[b]).values()) * 2 >= min(sum(bags[a].values()), sum(bags[b].values())):
                if probability_jaccard(bags[a], bags[b]) >= 0.8:
                    x, y = sorted((root(a), root(b)))
                    at[y] = x
    return {i: root(i) for i in at}


def planted():
    rng = random.Random(3)
    base = [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):  # a group of near copies, some of which are near to each other only through others
        copy = list(base if i < 30 else rows[-1][1].split())
        for _ in range(1 + i % 3):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    for i in range(60, 99):  # many changes, and copies of such copies, cut short or with a few more changes
        copy = list(base if i % 2 else rows[-1][1].split())
        for _ in range(4 + i % 5 if i % 2 else i % 3):
            copy[rng.randrange(len(copy))] = f"far{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy[:170 + i % 31] if i % 4 == 0 else copy)))
    rows += [(100 + i, rows[i % 7][1].upper().replace(" ", ",  ")) for i in range(40)]
    rows += [(200 + i, " ".join(f"u{rng.randrange(10**9)}" for _ in range(40))) for i in range(30)]
    rows += [(300, "same line\n" * 30), (301, "same line\n" * 29), (302, "same line\n" * 10 + "other line\n" * 10), (303, "few words"), (304, "Few, words")]
    return rows


def repeating():
    """The planted rows with a passage of their own repeated at the end of some, so that shingles weigh more than one."""
    return [(i, f"{t} {' '.join(t.split()[:12])} {' '.join(t.split()[:12])}" if 40 <= i < 99 and i % 3 == 0 else t) for i, t in planted()]


@pytest.mark.parametrize("small, rows", [(32, planted()), (2, planted()), (2, repeating()), (2, [(i, f"{t} {t}") for i, t in planted()])])
def test_near_classes(spark, monkeypatch, small, rows):
    monkeypatch.setattr(neardup, "SMALL_GROUP", small)
    expected = brute_classes(rows)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, label string")
    found = neardup.near_classes(docs).collect()
    assert {r.doc_id: r.class_id for r in found} == expected
    sizes = Counter(expected.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in found)
    free = neardup.near_free(docs)
    assert free.columns == docs.columns and {r.doc_id for r in free.collect()} == set(expected.values())


def test_pairs_of_a_large_group(spark, monkeypatch):
    """Copies with changes of their own, near and far from their center: compared pairs stay in proportion to the copies."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(600):
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    counted, verified = [], neardup._verified

    def counting(pairs, *rest):
        counted.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(neardup, "_verified", counting)
    found = {r.doc_id: r.class_id for r in neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_classes(rows)
    assert sum(counted) < 5 * len(rows), counted


def test_near_classes_on_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.class_id for r in queries.op2(spark, SF).collect()} == expected


def test_near_classes_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "?!"), (4, "a b c"), (4, "a b c"), (None, "a b c"), (None, "d"), (5, "x " * 40_000), (6, "x " * 40_000)]
    found = neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.kept) for r in found) == Counter([
        (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (4, 4, True), (None, 4, False), (None, None, True), (5, 5, True), (6, 5, False)])
    assert neardup.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similarity_and_signatures():
    rng = np.random.default_rng(5)
    for _ in range(8):
        a = rng.integers(0, 12, 60)
        b = np.where(rng.random(60) < 0.05, 99, a)
        bags = [Counter(tuple(x[i:i + 5]) for i in range(len(x) - 4)) for x in (a, b)]
        assert neardup.similarity(a, b) == pytest.approx(probability_jaccard(*bags))
    a = rng.integers(0, 1 << 40, 400)
    b = a.copy()
    b[::50] = -1
    doc, h, w = neardup.weighted(*neardup.shingles(np.concatenate([a, b]), np.array([400, 800])))
    owner = neardup.signatures(doc, h, w, 2, 2000)
    assert (owner[0] == owner[1]).mean() == pytest.approx(neardup.similarity(a, b), abs=0.04)


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute_lines(rows):
    """Kept text and number of near lines of each row, by comparing every line with all before it."""
    seen, out = [], {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        kept, near = [], 0
        for line in (text or "").split("\n") if text is not None else []:
            if not line.strip(" "):
                kept.append(line)
            elif line in seen:
                continue
            else:
                drop = len(line) >= linededup.MIN_CHARS and any(len(s) >= linededup.MIN_CHARS and within_one(s, line) for s in seen)
                seen.append(line)
                near += drop
                kept += [] if drop else [line]
        out[doc] = (None if text is None else "\n".join(kept), near)
    return out


@pytest.mark.parametrize("limit", [0, 10**6])
def test_lines(spark, monkeypatch, limit):
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", limit)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdeé 😀") for _ in range(n)).strip() + "." for n in (15, 16, 17, 20, 31, 64, 200, 15, 40, 41)]
    lines = list(base)
    for line in base:
        for _ in range(12):
            i = rng.randrange(len(line))
            lines.append(rng.choice([line[:i] + line[i + 1:], line[:i] + "Z" + line[i:], line[:i] + "Y" + line[i + 1:], line[:i] + "QQ" + line[i:]]))
    lines += ["aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaa", "", "  ", "short", "shorT", "short"]
    rng.shuffle(lines)
    rows = [(d, "\n".join(lines[d * 6:d * 6 + 6])) for d in range(len(lines) // 6 + 1)] + [(900, None), (901, ""), (902, "\n\n"), (903, "z" * 50_000)]
    docs = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id long, text string, n_lines int, line string")
    found = {r.doc_id: (r.kept_text, r.n_near) for r in linededup.line_dedup(docs).collect()}
    expected = brute_lines(rows)
    assert found == expected and sum(n for _, n in expected.values()) > 40
    assert linededup.line_dedup(docs.where("false")).count() == 0


def test_lines_on_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = {d: (hashlib.sha256((t or "").encode()).hexdigest(), n) for d, (t, n) in brute_lines(rows).items()}
    assert {r.doc_id: (r.kept_sha256, r.n_near) for r in queries.op3(spark, SF).collect()} == expected


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("size", [0, 1, 5, 1000])
def test_format_round_trip(bits, size):
    rng = np.random.default_rng(size)
    ids = rng.integers(0, 1 << 32, size, dtype=np.uint32)
    content = tokenfiles.encode_file(ids, [3, None], [size, 0], bits, block=64)
    file = tokenfiles.TokenFile(content)
    assert (file.ids() == ids).all() and file.documents["tokens"].tolist() == [size, 0] and file.documents["known"].tolist() == [1, 0]
    for a, b in ((0, 1), (10, 90), (64, 128), (990, 2000)):
        assert (file.ids(a, b) == ids[a:b]).all()


@pytest.mark.parametrize("file_ids", [40, 1 << 22])
def test_token_files(spark, file_ids):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = [(5, "Hello  WORLD,\tdon't"), (-2, "é é Σίσυφος İ  x y"), (3, None), (1, ""), (9, "<|endoftext|> a<|startoftext|>b"),
            (7, "word " * 5000), (7, "another of one id"), (None, "first of all"), (4, "\n \r\n tail "), (8, "x" * 20_000)]
    docs = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, part int, file string")
    found = sorted(tokenfiles.token_files(docs, path, file_ids=file_ids).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, -2, 1, 3, 4, 5, 7, 7, 8, 9]
    expected = Counter()
    for doc, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, tokenfiles.END_ID], "<u4")
        expected[doc, len(ids), crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == expected
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist()
    assert tokenfiles.token_files(docs.where("false"), path).count() == 0


def test_pieces_are_looked_up_once_and_encoded_as_in_whole_texts(monkeypatch):
    """Any mixture of cases, apostrophes, special tokens and other characters; capitals and punctuation make no new pieces."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, rng = Tokenizer.from_file(path), random.Random(3)
    parts = ["don't", "'tis", "'START", "rock'n'roll", "\"'s\"", "The", "\xc9COLE", "stra\xdfe", "\u0130stanbul", "\u039f\u0394\u039f\u03a3", "e\u0301te\u0301", "12", "3.14", "..",
             "\u2014", "<|endoftext|>", "<|STARTOFTEXT|>", "<", "\x1c", "\x85", "\xa0", "\t", "\r\n", " ", "\x7f", "\xb2", "\xb5", "\u6f22", "\xff", "\xd7", "'ll", "''", "ab,cd", "\x00", "\u200b", "\U0001f600"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(14))) for _ in range(2000)]
    for kept in (tokenfiles.PIECES_KEPT, 50):
        monkeypatch.setattr(tokenfiles, "PIECES_KEPT", kept)
        found = list(tokenfiles.Encoder(path).encode(texts))
        assert [f.tolist() for f in found] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    encoder = tokenfiles.Encoder(path)
    list(encoder.encode(["Word, word. WORD (word) w\xc4rd w\xe4rd"]))
    assert set(encoder.pieces.number) == {"word", ",", ".", "(", ")", "w\xe4rd"}


def test_pipeline(spark):
    """Each stage against what it may do to its own input."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, step in pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = step(spark, docs, SF)
        rows = out.collect()
        if name == "language_id":
            assert len(rows) >= 0.99 * len(before)
        if name == "near_dedup":
            assert {r.doc_id for r in rows} == set(brute_classes([(r.doc_id, r.text) for r in before.values()]).values())
        if name == "decontaminate":
            tests = {tuple(words(t)[i:i + 10]) for (t,) in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect() for i in range(len(words(t)) - 9)}
            bad = {d for d, r in before.items() if any(tuple(words(r.text)[i:i + 10]) in tests for i in range(len(words(r.text)) - 9))}
            assert {r.doc_id for r in rows} == set(before) - bad
        if name == "mix":
            copies = Counter(r.doc_id for r in rows)
            assert max(copies.values()) <= 3 and set(copies) <= set(before) and all(r == before[r.doc_id] for r in rows)
            words_of, taken = defaultdict(int), defaultdict(int)
            for r in rows:
                taken[r.source] += len(r.text.split())
            for r in before.values():
                words_of[r.source] += len(r.text.split())
            assert sum(taken.values()) == pytest.approx(sum(words_of.values()), rel=0.15)
        if name == "shard":
            assert Counter(r.doc_id for r in rows) == kept["mix"] and {r.shard for r in rows} <= set(range(40))
        else:
            assert out.columns == docs.columns
            kept[name] = Counter(r.doc_id for r in rows)
            docs = spark.createDataFrame(rows, docs.schema)


@pytest.mark.parametrize("most", [neardup.SHARE_TOKENS, 25])
def test_tokens_of_a_family_travel_as_arrays(spark, monkeypatch, most):
    """No row for each token of a family: only those that pass become rows, whatever the number of shares."""
    monkeypatch.setattr(neardup, "SHARE_TOKENS", most)
    members = [("m", f"m{i}", [j for j in range(60) if (i * 7 + j * j) % 11 < 3] + [1000 + i], [-j for j in range(1, 9) if (i + j) % 3]) for i in range(40)]
    count = Counter(t for *_, own, common in members for t in own + common)
    want = set()
    for main, node, own, common in members:
        placed = sorted(own + common, key=lambda t: (count[t], t))
        want |= {(main, node, t, i) for i, t in enumerate(placed) if count[t] > 1 and i <= 6}
    rows = [(m, n, o, [1] * len(o), c, [1] * len(c), 6.0) for m, n, o, c in members]
    sets = spark.createDataFrame(rows, "main string, node string, own array<long>, own_w array<long>, common array<long>, common_w array<long>, cap double")
    placed = neardup._placed(sets)
    assert {tuple(r) for r in placed.collect()} == want
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(own" not in plan and "explode(common" not in plan


def test_tokens_of_a_family_are_placed_rarest_first(spark):
    """Own and center tokens of several families in one order, weights ahead summed, tokens of one member left out: as by brute force."""
    rng = np.random.default_rng(4)
    members = []
    for main, size in (("m", 30), ("n", 2), ("o", 1)):
        for i in range(size):
            own, common = (sorted({int(x) for x in rng.integers(low, low + span, rng.integers(0, 12))}) for low, span in ((0, 60), (-9, 9)))
            weights = [[int(x) for x in rng.integers(1, 4, len(t))] for t in (own, common)]
            members.append((main, f"{main}{i}", own, weights[0], common, weights[1], float(rng.integers(0, 30))))
    count = {}
    for main, _, own, _, common, _, _ in members:
        for t in own + common:
            count[main, t] = count.get((main, t), 0) + 1
    want = set()
    for main, node, own, own_w, common, common_w, cap in members:
        before = 0
        for t, w in sorted(zip(own + common, own_w + common_w), key=lambda x: (count[main, x[0]], x[0])):
            if count[main, t] > 1 and before <= cap:
                want.add((main, node, t, before))
            before += w
    sets = spark.createDataFrame(members, "main string, node string, own array<long>, own_w array<long>, common array<long>, common_w array<long>, cap double")
    got = [tuple(r) for r in neardup._placed(sets).collect()]
    assert len(got) == len(want) and set(got) == want
