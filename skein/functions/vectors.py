"""Vector expressions.

``cosine`` and ``l2`` stay in the JVM for single lookups; ``cosine_batch`` is the Arrow + numpy
form for many pairs of long vectors. Both return the same values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, strict: bool = True) -> Column:
    """Cosine similarity; 0 when a norm is 0. Unequal lengths raise, or give NULL if not strict."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    value = F.when(norm > 0, _dot(a, b) / norm).otherwise(F.lit(0.0))
    bad = F.raise_error(F.lit("embedding dimension mismatch")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(F.size(a) == F.size(b), value).otherwise(bad)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 0 when a norm is 0."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, 1.0 - _dot(a, b) / norm).otherwise(F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


@F.arrow_udf(DoubleType())
def cosine_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    """Row-wise cosine over Arrow batches; NULL on NULL input or unequal lengths."""
    out = np.full(len(a), np.nan)
    size_a, size_b = (pc.fill_null(pc.list_value_length(v), none).to_numpy(zero_copy_only=False) for v, none in ((a, -1), (b, -2)))
    for dim in np.unique(size_a[size_a == size_b]):
        rows = np.flatnonzero((size_a == dim) & (size_b == dim))
        x, y = (v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim) for v in (a, b))
        norm = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
        dots = np.einsum("ij,ij->i", x, y)
        out[rows] = np.where(norm > 0, dots / np.where(norm > 0, norm, 1.0), 0.0)
    return pa.array(out, from_pandas=True)


def is_zero(v: Column) -> Column:
    return ~F.exists(v, lambda x: x != 0)


def copy_key(v: Column) -> Column:
    """128-bit key that is equal for equal vectors, so copies can be grouped without shuffling vectors."""
    return F.concat_ws("/", F.xxhash64(v).cast("string"), F.xxhash64(F.reverse(v)).cast("string"))


def pad_to(v: Column, dims: int) -> Column:
    """Widen a vector with zeros."""
    return F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), F.lit(dims) - F.size(v))))


def hash_embedding(text: Column, dims: int) -> Column:
    """Deterministic offline embedding: the SHA-256 bytes of the text, repeated, scaled to [-1, 1]."""
    digest = F.sha2(text.cast("binary"), 256)
    octets = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda i: (F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1.0).cast("float"),
    )
    repeats = -(-dims // 32)
    return F.slice(F.flatten(F.array_repeat(octets, repeats)), 1, dims)


def seed_quality(distance: Column) -> Column:
    return F.when(distance < 0.2, "high").when(distance <= 0.4, "low").otherwise("poor")


def relative_centrality(degree: Column) -> Column:
    return F.when(degree > 20, "high").when(degree >= 5, "medium").otherwise("low")
