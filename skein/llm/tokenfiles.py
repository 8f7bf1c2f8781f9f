"""Token ids in bit-plane files.

A file holds fixed-size blocks of ids. Each block is written as bytes of equal weight together (plane 0 holds every id's lowest
byte), or as single bits, and each plane is compressed by itself with zstandard: high planes of small ids are nearly constant.
The end of a file lists its documents and where each chunk stands:

    planes of block 0, planes of block 1, ..., footer, length of the footer (8 bytes), magic (8 bytes)

Documents are in ascending order of their id: ranges of ids are the partitions, a partition writes files of a bounded number
of ids, and a manifest table gives each file's place in the whole sequence. Files go to the shared folder under the name of
their attempt and are then renamed, so a task that runs again only replaces its own files.
"""

from __future__ import annotations

from collections.abc import Iterator
import io
import json
import os
import re
import struct
import uuid
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
import zstandard

from skein.llm.common import partitions, ready
from skein.session import stage, staging_root

MAGIC = b"SKEINTOK"
END_ID = 2               # appended to every document
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 22       # a file ends after the document that reaches this
LEVEL = 3
PIECES_KEPT = 700_000
SLICE_CHARS = 1 << 20
# Latin text: letters that change by case only, and what can't be part of a letter run; no special token begins in it
_PLAIN = re.compile(r"[\x00-&(-;=-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
# a word with an apostrophe or any other character stays whole; else runs of letters and what stands between them
_LETTERS = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_PIECES = re.compile(rf"[\x00-\x08\x0e-\x1f!-&(-;=-~{_LETTERS[6:]}]*['<\x7f-\xbf\xd7\xf7Ā-\U0010ffff][^ \t-\r]*|[{_LETTERS}]+|[^{_LETTERS} \t-\r]+")
_BLANK = " \t\n\v\f\r"
# of bytes: white space, letters in lower case (beyond ASCII plain text has letters only), anything else
_KIND = np.full(256, 2, np.uint8)
_KIND[list(_BLANK.encode())], _KIND[97:123], _KIND[128:] = 0, 1, 1
_DOCUMENTS = np.dtype([("id", "<i8"), ("known", "<u1"), ("tokens", "<i8")])


# --- the format ------------------------------------------------------------------------------------------------------------

def planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Byte planes (or bit planes) of little-endian unsigned 32-bit ids, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(4)]
    spread = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(np.ascontiguousarray(spread[:, i])).tobytes() for i in range(32)]


def from_planes(parts: list[bytes], count: int) -> np.ndarray:
    if len(parts) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)
    else:
        spread = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=count) for p in parts], axis=1)
        raw = np.packbits(spread, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def encode_file(ids: np.ndarray, doc_ids: list, tokens: list[int], bits: bool = False, block: int = BLOCK_IDS) -> bytes:
    """``doc_ids`` may hold None; ``tokens`` are the ids of each document, in order."""
    out, chunks, press = io.BytesIO(), [], zstandard.ZstdCompressor(level=LEVEL)
    for first in range(0, len(ids), block):
        part = ids[first:first + block]
        row = [len(part)]
        for plane in planes(part, bits):
            packed = press.compress(plane)
            row += [out.tell(), len(packed)]
            out.write(packed)
        chunks.append(row)
    table = np.zeros(len(doc_ids), _DOCUMENTS)
    table["id"] = [0 if d is None else d for d in doc_ids]
    table["known"] = [d is not None for d in doc_ids]
    table["tokens"] = tokens
    head = json.dumps({"ids": len(ids), "docs": len(doc_ids), "planes": 32 if bits else 4, "chunks": chunks}).encode()
    footer = struct.pack("<q", len(head)) + head + press.compress(table.tobytes())
    out.write(footer + struct.pack("<q", len(footer)) + MAGIC)
    return out.getvalue()


class TokenFile:
    """Reads a file's documents, or the ids of any range, touching only the chunks of that range."""

    def __init__(self, content: bytes):
        if content[-8:] != MAGIC:
            raise ValueError("not a token file")
        self.content = content
        size = struct.unpack("<q", content[-16:-8])[0]
        footer = content[-16 - size:-16]
        head = struct.unpack("<q", footer[:8])[0]
        meta = json.loads(footer[8:8 + head])
        self.n_ids, self.n_planes, self.chunks = meta["ids"], meta["planes"], meta["chunks"]
        self.documents = np.frombuffer(zstandard.ZstdDecompressor().decompress(footer[8 + head:]), _DOCUMENTS, meta["docs"])

    def chunk(self, number: int) -> np.ndarray:
        count, *at = self.chunks[number]
        press = zstandard.ZstdDecompressor()
        return from_planes([press.decompress(self.content[a:a + n]) for a, n in zip(at[::2], at[1::2])], count)

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n_ids if end is None else end
        parts, first = [], 0
        for number, (count, *_) in enumerate(self.chunks):
            if first < end and first + count > start:
                parts.append(self.chunk(number)[max(start - first, 0):end - first])
            first += count
        return np.concatenate(parts) if parts else np.empty(0, "<u4")


# --- tokenising --------------------------------------------------------------------------------------------------------------

class Known:
    """Ids of strings seen before, as slices of one array. When it is full, strings not met again since they came are forgotten."""

    def __init__(self, most: int):
        self.most, self.number, self.used = most, {}, 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.first, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, bool)

    def missing(self, strings: set[str]) -> list[str]:
        """The strings not known yet; makes room for them."""
        fresh = strings.difference(self.number)
        if len(self.number) + len(fresh) > self.most:
            names = list(self.number)
            keep = np.flatnonzero(self.again[:len(names)])[-(self.most // 2):]
            ids, sizes = self.ids(keep), self.size[keep]
            self.number, self.used = {}, 0
            self.add([names[i] for i in keep], ids, sizes)
            fresh = strings.difference(self.number)
        return list(fresh)

    def add(self, strings: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        total, n = self.used + len(ids), len(self.number)
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(strings) > len(self.size):
            self.first, self.size, self.again = (np.concatenate([a, np.zeros_like(a)]) for a in (self.first, self.size, self.again))
        self.flat[self.used:total] = ids
        self.size[n:n + len(strings)] = sizes
        self.first[n:n + len(strings)] = self.used + np.cumsum(sizes) - sizes
        self.again[n:n + len(strings)] = False
        self.number.update(zip(strings, range(n, n + len(strings))))
        self.used = total

    def find(self, strings: list[str], older: int) -> np.ndarray:
        """Numbers of known strings; those below ``older`` count as met again."""
        at = np.fromiter(map(self.number.__getitem__, strings), np.int64, len(strings))
        self.again[at[at < older]] = True
        return at

    def ids(self, at: np.ndarray) -> np.ndarray:
        size = self.size[at]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.first[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of whole texts.

    With ``word_rules`` texts are cut at white space, and plain Latin words into runs of letters and what stands between them; texts that
    are plain throughout are put into lower case first. That is right for vocabularies that fold case, drop white space and never join
    letters with other characters; words with an apostrophe, a special token or other characters stay whole. Pieces are encoded once
    and kept. New ones go to the tokenizer as one text, with a special token between them, which it never joins with what stands beside
    it; runs of lower-case ASCII letters, which its normalizer leaves as they are and its pre-tokenizer whole, with blanks between them and
    without those two steps.
    """

    def __init__(self, path: str, word_rules: bool = True):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a worker for each core
        self.tokenizer, self.word_rules = Tokenizer.from_file(path), word_rules
        told = json.loads(self.tokenizer.to_str())
        steps = told["pre_tokenizer"] or {}
        steps = [p for p in steps.get("pretokenizers", [steps]) if p.get("type") == "ByteLevel"]
        told |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *steps]}}
        self.folded, suffix = Tokenizer.from_str(json.dumps(told)), told["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[n for t, n in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        special = {n: t.content for n, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.mark_id, self.mark = min(special.items()) if special else (None, None)
        self.pieces = Known(PIECES_KEPT)

    def _encoded_letters(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of runs of lower-case ASCII letters; the last token of each has the suffix of words."""
        ids = np.array(self.folded.encode_batch_fast([" ".join(strings)], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.ends_word[ids])
        if len(last) != len(strings) or last[-1] != len(ids) - 1:
            return self._encoded(strings)
        return ids, np.diff(np.concatenate([[-1], last]))

    def _encoded(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all strings, number of ids of each)."""
        if self.mark is None or any(self.mark in s for s in strings):
            found = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
            return np.array([i for e in found for i in e.ids], np.uint32), np.array([len(e.ids) for e in found])
        ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(strings)], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.flatnonzero(ids == self.mark_id)
        return np.delete(ids, marks), np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1

    def _learn(self, fresh: list[str]) -> None:
        odd = [p for p in fresh if self.mark and self.mark in p]
        rest = set(fresh).difference(odd) if odd else fresh
        folded, other = [], []
        for p in rest:
            (folded if p.isascii() and p.islower() and p.isalpha() else other).append(p)
        for group, encoded in ((folded, self._encoded_letters), (other, self._encoded), (odd, self._encoded)):
            if group:
                self.pieces.add(group, *encoded(group))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Texts are taken in slices of bounded length, so that unknown pieces go to the tokenizer many at a time."""
        slice_, chars = [], 0
        for text in texts:
            slice_.append(text)
            chars += len(text)
            if chars > SLICE_CHARS:
                yield from self._slice(slice_)
                slice_, chars = [], 0
        yield from self._slice(slice_)

    def _slice(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not texts:
            return
        if not self.word_rules:
            yield from (np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))
            return
        plain, rest, out = [], [], {}
        for i, text in enumerate(texts):
            (plain if _PLAIN.fullmatch(text) else rest).append(i)
        for group, cut in ((plain, _runs), (rest, _pieces)):
            if group:
                out.update(zip(group, self._ids(*cut([texts[i] for i in group]))))
        yield from map(out.__getitem__, range(len(texts)))

    def _ids(self, pieces: pa.Array, ends: np.ndarray) -> list[np.ndarray]:
        """Ids of texts from their pieces in a row; each different piece is looked up once."""
        coded = pieces.dictionary_encode()
        strings = pc.utf8_rtrim(coded.dictionary, _BLANK).to_numpy(zero_copy_only=False).tolist()
        fresh = self.pieces.missing(set(strings))
        older = len(self.pieces.number)
        if fresh:
            self._learn(fresh)
        at = self.pieces.find(strings, older)[coded.indices.to_numpy()]
        last = np.concatenate([[0], np.cumsum(self.pieces.size[at])])
        return np.split(self.pieces.ids(at), last[ends[:-1]])


def _runs(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """(pieces of plain texts with the white space after them, number of pieces up to each text's end), found on the bytes of all texts."""
    each = [t.lower().encode() for t in texts]
    whole = b"\n".join(each)
    kind = _KIND[np.frombuffer(whole, np.uint8)]
    starts = np.flatnonzero((kind != 0) & (kind != np.concatenate([[0], kind[:-1]])))
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(whole)).astype(np.int64)), pa.py_buffer(whole))
    return pieces, np.searchsorted(starts, np.cumsum([len(b) + 1 for b in each]))


def _pieces(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The same of any texts, by a regular expression."""
    cut = [_PIECES.findall(t) for t in texts]
    return pa.array([p for pieces in cut for p in pieces], pa.large_string()), np.cumsum([len(pieces) for pieces in cut])


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, word_rules: bool) -> Encoder:
    """One for each Python worker, kept from task to task."""
    key = (path, word_rules)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, word_rules)
    return _ENCODERS[key]


# --- writing and reading with Spark ------------------------------------------------------------------------------------------

def put(folder: str, name: str, content: bytes) -> None:
    """Write under a name of this attempt, then rename: readers see whole files only."""
    store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    store.create_dir(path, recursive=True)
    attempt = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as out:
        out.write(content)
    store.move(attempt, f"{path}/{name}")


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
                 word_rules: bool = True, bits: bool = False, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode and write all texts in ascending order of their id; return the manifest (file, part, shard, n_ids, n_docs).

    Null texts count as empty and hold only the end id. Rows without an id come first; repeated ids keep all their rows, in
    the order of their texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    parts = rows.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order, "text")
    parts = parts.withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, held, doc_ids, tokens, shard, part, total = encoder(tokenizer_path, word_rules), [], [], [], 0, 0, 0

        def close() -> dict:
            ids = np.concatenate(held)
            name = f"part-{part:06d}-{shard:06d}.tok"
            put(folder, name, encode_file(ids, doc_ids, tokens, bits))
            return {"file": name, "part": part, "shard": shard, "n_ids": len(ids), "n_docs": len(doc_ids)}

        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else part
            known = batch["doc_id"].notna().to_numpy()
            numbers = batch["doc_id"].fillna(0).astype("int64").to_numpy()
            done = []
            for ids, number, has in zip(encode.encode(batch["text"].tolist()), numbers, known):
                held.append(np.append(ids, np.uint32(END_ID)).astype(np.uint32))
                doc_ids.append(int(number) if has else None)
                tokens.append(len(held[-1]))
                total += tokens[-1]
                if total >= file_ids:
                    done.append(close())
                    held, doc_ids, tokens, shard, total = [], [], [], shard + 1, 0
            if done:
                yield pd.DataFrame(done)
        if held:
            yield pd.DataFrame([close()])

    return stage(parts.mapInPandas(run, "file string, part int, shard int, n_ids long, n_docs long"), "token-manifest")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file) of every document, from the files."""
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    places = manifest.select(F.col("file").alias("__file"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("__first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                file = TokenFile(bytes(content))
                ids, sizes = file.ids(), file.documents["tokens"]
                ends = np.cumsum(sizes)
                yield pd.DataFrame({
                    "doc_id": pd.arrays.IntegerArray(file.documents["id"].astype("int64"), file.documents["known"] == 0),
                    "local": ends - sizes, "n_tokens": sizes,
                    "ids_crc32": [crc32(ids[b - n:b].tobytes()) for b, n in zip(ends, sizes)],
                    "file": path.rsplit("/", 1)[-1]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tok").load(folder).select("path", "content")
    found = files.mapInPandas(run, "doc_id long, local long, n_tokens long, ids_crc32 long, file string")
    joined = found.join(places, F.col("file") == F.col("__file"))
    return joined.select("doc_id", (F.col("__first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "file")


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token files into a new folder and read them back; an empty table has no files and no rows."""
    spark = ready(docs).sparkSession
    folder = folder or f"{staging_root(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_tokens(docs, tokenizer_path, folder, **options)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    return read_tokens(spark, folder, manifest)
