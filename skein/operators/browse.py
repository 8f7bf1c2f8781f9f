"""List, filter and look-up operators over the snapshot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skein.config import DEFAULTS
from skein.operators.ranking import page


class NotFound(LookupError):
    """The row asked for does not exist."""


def matching(df: DataFrame, contains: dict[str, str | None] | None = None, **equals) -> DataFrame:
    """Rows equal to every given value; ``contains`` is a case-insensitive ``%text%`` whose wildcards stay active."""
    for column, value in equals.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    for column, value in (contains or {}).items():
        if value is not None:
            df = df.filter(F.col(column).ilike(f"%{value}%"))
    return df


def listing(df: DataFrame, id_col: str, offset: int = 0, limit: int = DEFAULTS.page_limit_default,
            order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(page, total)`` newest first; ``total`` is a one-row count of the same filter."""
    order = order or [F.col("created_at").desc(), F.col(id_col)]
    return page(df, order, offset, limit, DEFAULTS.page_limit_max), df.agg(F.count(F.lit(1)).alias("total"))


def get_by_id(df: DataFrame, id_col: str, value) -> DataFrame:
    found = df.filter(F.col(id_col) == value).limit(2)
    if found.isEmpty():
        raise NotFound(f"{id_col}={value}")
    return found


def page_by_slug(pages: DataFrame, slug: str) -> DataFrame:
    return pages.filter(F.lower("slug") == slug.lower())


def entity_relations(relations: DataFrame, entity_id, direction: str = "both") -> DataFrame:
    source, target = F.col("source_entity_id") == entity_id, F.col("target_entity_id") == entity_id
    conditions = {"outgoing": source, "incoming": target, "both": source | target}
    if direction not in conditions:
        raise ValueError(f"direction must be one of {sorted(conditions)}")
    return relations.filter(conditions[direction])


def page_mentions(page_entities: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities named by each page: ``(page_id, entity_id, name, entity_type)``."""
    return page_entities.join(entities.select("entity_id", "name", "entity_type"), "entity_id").select(
        "page_id", "entity_id", "name", "entity_type")


def without_vectors(df: DataFrame) -> DataFrame:
    """What the outside sees of chunks and entities: everything but the embedding."""
    return df.drop("embedding")
