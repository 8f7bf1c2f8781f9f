"""Registered queries: name -> (function of (spark, sf_dir), SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.operators.retrieval import Graph
from skein.plans.oracles import statement
from skein.sources.bridge import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` is the final SELECT of its twin."""
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = statement(sql)
        return fn

    return wrap


def graph_of(t: Tables) -> Graph:
    return Graph(t.entities(), t.relations(), t.chunks(), t.chunk_entities(), t.wiki_pages(), t.sources())


def load() -> None:
    from skein.plans import (  # noqa: F401
        queries_text, queries_graph, queries_analysis, queries_ingest, queries_queue, queries_retrieval, queries_search, queries_wiki,
    )
