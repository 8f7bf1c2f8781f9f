"""Pluggable models: embedding, reading, captions. Defaults are deterministic and offline.

A provider is a factory of Column expressions, so a plan never depends on which one is used. Remote
models run inside Arrow UDFs; no network client is bundled.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from skein.config import DEFAULTS
from skein.functions.vectors import hash_embedding
from skein.operators.resolution import offline_reader


class ProviderError(RuntimeError):
    """A model call failed for good."""


def with_retries(call: Callable, attempts: int = 3, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep):
    """Wrap ``call`` so that provider errors are retried with a pause growing by ``pause`` per attempt."""
    def run(*args):
        for attempt in range(1, attempts + 1):
            try:
                return call(*args)
            except ProviderError:
                if attempt == attempts:
                    raise
                sleep(pause * attempt)

    return run


class HashEmbedder:
    """Vectors from SHA-256 bytes, computed in the JVM."""

    def __init__(self, dims: int = DEFAULTS.embedding_dimensions):
        self.dims = dims

    def embed(self, text: Column) -> Column:
        return hash_embedding(text, self.dims)


class BatchEmbedder:
    """Vectors from ``model(list of texts) -> list of vectors``, one call per Arrow batch."""

    def __init__(self, model: Callable[[list[str]], list[list[float]]], attempts: int = 3):
        self.model, self.attempts = model, attempts

    def embed(self, text: Column) -> Column:
        model = with_retries(self.model, self.attempts)

        @F.pandas_udf(ArrayType(FloatType()))
        def run(texts: pd.Series) -> pd.Series:
            asked = texts[texts.notna() & (texts != "")]
            found = model(asked.tolist()) if len(asked) else []
            if len(found) != len(asked):
                raise ProviderError("the model returned another number of vectors than texts")
            return pd.Series(found, index=asked.index, dtype=object).reindex(texts.index).where(lambda s: s.notna(), None)

        return run(text)


class BatchReader:
    """JSON answers from ``model(text) -> str | None``; a failing text yields NULL, not a failed job."""

    def __init__(self, model: Callable[[str], str | None], attempts: int = 3):
        self.model, self.attempts = model, attempts

    def __call__(self, text: Column) -> Column:
        model = with_retries(self.model, self.attempts)

        @F.pandas_udf(StringType())
        def run(texts: pd.Series) -> pd.Series:
            def one(value):
                try:
                    return model(value) if value else None
                except ProviderError:
                    return None

            return texts.map(one)

        return run(text)


def offline_caption(mime: Column) -> Column:
    return F.concat(F.lit("image ("), F.coalesce(mime, F.lit("unknown")), F.lit(")"))


def captioned(chunks, caption: Callable[[Column], Column] = offline_caption):
    """Image chunks take their caption as text before they are embedded."""
    is_image = (F.col("chunk_type") == "image") & F.col("image_data").isNotNull()
    return chunks.withColumn("text_content", F.when(is_image, caption(F.col("image_mime_type"))).otherwise(F.col("text_content")))


EMBEDDERS: dict[str, Callable] = {"hash": HashEmbedder}
READERS: dict[str, Callable] = {"offline": lambda: offline_reader}


def get(registry: dict[str, Callable], name: str):
    if name not in registry:
        raise ValueError(f"unknown provider {name!r}; known: {sorted(registry)}")
    return registry[name]()
