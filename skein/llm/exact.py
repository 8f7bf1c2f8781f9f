"""Exact dedup with Patricia tries that own the texts of a partition.

Each map task first inserts its own texts into a trie, so that a text leaves a task once however often it is copied. Texts then
go to partitions by (length, content hash); a partition inserts the full byte strings into its trie, and the terminal nodes
keep the smallest identifier and the number of rows. A trie that outgrows its memory writes its largest subtree to a scratch
file of the task and goes on; each file is worked off later as a trie of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
import hashlib
import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skein.llm.common import partitions, ready
from skein.session import stage

# Fixed value: what counts as one space.
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
TRIE_BYTES = 256 << 20
_NODE_BYTES = 400


class Spilled:
    """A subtree in a scratch file of its task: pairs of (rest of the string, owner)."""

    def __init__(self, node: list):
        self.file = tempfile.TemporaryFile()  # noqa: SIM115  closed in items()
        for text, owner in walk(node):
            self.add(text, owner)

    def add(self, text: bytes, owner: tuple) -> None:
        pickle.dump((text, owner), self.file)

    def items(self, limit: int) -> Iterator[tuple[bytes, tuple]]:
        trie = PatriciaOwners(limit)
        with self.file as file:
            end = file.tell()
            file.seek(0)
            while file.tell() < end:
                trie.insert(*pickle.load(file))
        yield from trie.items()


class PatriciaOwners:
    """Compressed radix trie over byte strings; a terminal node owns (smallest id, rows).

    A node is a list [label, children by first byte, owner]; a child may be a ``Spilled`` subtree. ``items`` yields every
    string with its owner once and empties the trie.
    """

    def __init__(self, limit: int = TRIE_BYTES):
        self.limit, self.used = limit, 0
        self.root = [b"", {}, None]

    def insert(self, text: bytes, owner: tuple) -> None:
        node, at = self.root, 0
        while True:
            if at == len(text):
                node[2] = merged(node[2], owner)
                break
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:], {}, owner]
                self.used += len(text) - at + _NODE_BYTES
                break
            if isinstance(child, Spilled):
                child.add(text[at:], owner)
                break
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = common_prefix(label, text[at:at + len(label)])
            upper = [label[:shared], {label[shared]: child}, None]
            child[0] = label[shared:]
            node[1][text[at]] = upper
            self.used += _NODE_BYTES
            node, at = upper, at + shared
        if self.used > self.limit:
            self._spill()

    def _spill(self) -> None:
        """Write the largest subtree below the first fork; below it strings differ, so a file is always smaller than its trie."""
        node = self.root
        while node[2] is None and len(node[1]) == 1:
            only = next(iter(node[1].values()))
            if isinstance(only, Spilled):
                return
            node = only
        held = {first: subtree_bytes(child) for first, child in node[1].items() if not isinstance(child, Spilled)}
        if held:
            first = max(held, key=held.get)
            self.used -= held[first]
            node[1][first] = Spilled(node[1][first])

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        root, self.root, self.used = self.root, [b"", {}, None], 0
        yield from walk(root, self.limit)


def merged(a: tuple | None, b: tuple) -> tuple:
    """Owner of a string seen under both: the smallest id (None last), and the rows of both."""
    if a is None:
        return b
    ids = [x for x in (a[0], b[0]) if x is not None]
    return (min(ids) if ids else None, a[1] + b[1])


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def subtree_bytes(node: list) -> int:
    total, stack = 0, [node]
    while stack:
        node = stack.pop()
        if not isinstance(node, Spilled):
            total += len(node[0]) + _NODE_BYTES
            stack.extend(node[1].values())
    return total


def walk(node: list, limit: int = TRIE_BYTES) -> Iterator[tuple[bytes, tuple]]:
    stack = [(b"", node)]
    while stack:
        lead, node = stack.pop()
        if isinstance(node, Spilled):
            yield from ((lead + rest, owner) for rest, owner in node.items(limit))
            continue
        label, children, owner = node
        text = lead + label
        if owner is not None:
            yield text, owner
        stack.extend((text, c) for c in children.values())


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_PATTERN, " ")


def _tries(limit: int, last: bool):
    """Batches of (text, id, rows) to one row for each text of the partition; ``last`` adds the text's digest and drops the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, kind = PatriciaOwners(limit), None
        for batch in batches:
            kind = batch.schema.field(1).type
            for text, owner, rows in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                trie.insert(text.as_buffer().to_pybytes(), (owner, rows))
        out: list[tuple] = []
        held = 0
        for text, (owner, rows) in trie.items():
            out.append((hashlib.sha256(text).hexdigest() if last else text, owner, rows))
            held += len(out[-1][0])
            if held > 8 << 20:
                yield _batch(out, last, kind)
                out, held = [], 0
        if out:
            yield _batch(out, last, kind)

    return run


def _batch(rows: list[tuple], last: bool, kind: pa.DataType) -> pa.RecordBatch:
    names = ["sha", "keep_id", "group_size"] if last else ["bytes", "id", "rows"]
    kinds = [pa.string() if last else pa.binary(), kind, pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=names)


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(sha, keep_id, group_size) for each different normalised text; ``sha`` is the lowercase hex sha256 of its bytes."""
    kind = dict(ready(docs).dtypes)[id_col]
    rows = docs.select(F.encode(normalised(F.col(text_col)), "UTF-8").alias("bytes"), F.col(id_col).alias("id"),
                       F.lit(1).cast("long").alias("rows"))
    local = rows.mapInArrow(_tries(trie_bytes, False), f"bytes binary, id {kind}, rows bigint")
    dealt = local.repartition(partitions(docs), F.length("bytes"), F.xxhash64("bytes"))
    return dealt.mapInArrow(_tries(trie_bytes, True), f"sha string, keep_id {kind}, group_size bigint")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the smallest id stays; rows without an id come after all others, and if a text
    has no other rows its ``keep_id`` is null and all its rows are kept, as are repeated rows of the id that stays.
    """
    owned = stage(owners(docs, id_col, text_col, trie_bytes), "text-owners")
    shas = docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256).alias("text_sha256"))
    joined = shas.join(owned, F.col("text_sha256") == F.col("sha"), "left")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
