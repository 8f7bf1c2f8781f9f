"""Prefix trie of conversations against sets of prefixes in plain Python."""

from collections import defaultdict
import hashlib
import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from skein.llm import prefixes, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    """Turns of each conversation in order, rebuilt with the beginning of its hundred's first one."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        out[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += own
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node], sha(ends[node]))
                   for node, m in members.items()), key=repr)


def table(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(COLUMNS).collect()), key=repr)


def trie(df, **options):
    turns = prefixes.encode(df)
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    return prefixes.prefix_trie(prefixes.graft(turns, F.col("conv_id") - F.col("conv_id") % 100, taken, 5), **options)


def test_tree_is_a_balanced_search_tree():
    tree = prefixes.TernaryTree()
    ends = tree.insert_sorted([[i] for i in range(1023)])
    assert [tree.turn[n] for n in tree.in_order()[1:]] == list(range(1023)) and sorted(ends) == list(range(1, 1024))

    def height(node):
        return 0 if node < 0 else 1 + max(height(tree.less[node]), height(tree.more[node]))

    assert height(tree.after[0]) == 10


def awkward(seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a", "b", "é😀"])) for c in [*range(0, 40), *range(100, 130), 250, 399, -5, -120]
            for t in range(rng.choice([1, 2, 2, 3, 4, 9]))]
    rows += [(c, t, "user", f"same {t % 3}") for c in range(300, 340) for t in range(12)]  # a large group of equal ones
    rows += [(7, None, "user", "first"), (7, None, None, None), (None, 1, "user", "x"), (8, 2, None, "t"), (8, 2, "u", "ser"), (8, 2, "us", "er")]
    rows += [(60, t, "user", f"turn {t}") for t in range(60)] + [(61, t, "user", f"turn {t}") for t in range(45)]  # long ones
    rows += rows[:9]  # repeated rows
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"segment": 4, "shard_turns": 30}, {"segment": 7, "shard_turns": 1}])
def test_awkward_rows(spark, options):
    rows = awkward(len(options))
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, key string, at int")
    assert table(trie(df, **options)) == brute(sequences(rows))


def test_no_and_turnless_conversations(spark):
    kinds = "conv_id long, turn long, role string, text string"
    assert table(trie(spark.createDataFrame([], kinds))) == []
    lone = next(c for c in range(101, 200) if crc32(str(c).encode()) % 6 > 0)
    one = [(lone, 1, "user", "x")]  # its first turn is replaced by those of a conversation that is not there
    assert table(trie(spark.createDataFrame(one, kinds))) == brute(sequences(one)) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_query_on_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert table(queries.QUERIES["op11_prefix_trie"](spark, SF)) == brute(sequences(rows))
