"""Snapshot maintenance: entity merges, conflict-ignoring inserts, upserts, cascading deletes.

Tables are immutable snapshots, so every change is a join that yields the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skein.session import stage


def resolve_chains(merges: DataFrame) -> DataFrame:
    """Final survivor per merged entity of ``merges(from_id, into_id)``; chains are followed by doubling.

    Each round halves the longest chain, which is no longer than there are merges: what has not ended by then, or has come
    back to its start, is a cycle, has no survivor and raises.
    """
    hops = stage(merges.filter("from_id <> into_id").groupBy("from_id").agg(F.min("into_id").alias("into_id")), "merges")
    for _ in range(hops.count().bit_length() + 1):
        nxt = hops.select(F.col("from_id").alias("into_id"), F.col("into_id").alias("_next"))
        joined = hops.join(nxt, "into_id", "left")
        if joined.filter("_next = from_id").limit(1).count():
            raise ValueError("merge cycle")
        if not joined.filter("_next IS NOT NULL").limit(1).count():
            return hops
        hops = stage(joined.select("from_id", F.coalesce("_next", "into_id").alias("into_id")), "merges")
    raise ValueError("merge cycle")


def repoint(df: DataFrame, columns: list[str], merges: DataFrame) -> DataFrame:
    """Replace merged ids by their survivor in every column, one left join each."""
    names = df.columns
    for column in columns:
        m = merges.select(F.col("from_id").alias("_from"), F.col("into_id").alias("_into"))
        df = df.join(m, F.col(column) == F.col("_from"), "left").withColumn(
            column, F.coalesce("_into", column)).drop("_from", "_into")
    return df.select(names)


def merge_relations(relations: DataFrame, merges: DataFrame) -> DataFrame:
    """Re-pointed relations, one per (source, target, type, chunk): the whole table is deduplicated."""
    moved = repoint(relations, ["source_entity_id", "target_entity_id"], merges)
    return keep_first(moved, ["source_entity_id", "target_entity_id", "relation_type", "chunk_id"], "relation_id")


def keep_first(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """The row of least id per key, aggregated on the map side; copies never reach one window task."""
    rest = [c for c in df.columns if c not in keys]
    if rest == [id_col]:  # a plain minimum is a hash aggregate; a struct needs a sorted one
        return df.groupBy(*keys).agg(F.min(id_col).alias(id_col)).select(df.columns)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(id_col)).alias("r")).select(
        *[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns])


def merge_links(links: DataFrame, merges: DataFrame) -> DataFrame:
    """Chunk links of merged entities move to the survivor unless it already has the chunk."""
    return repoint(links, ["entity_id"], merges).distinct()


def merge_pages(pages: DataFrame, merges: DataFrame) -> DataFrame:
    """Pages follow the merge; a survivor keeps one page, further pages lose their entity."""
    owner = F.struct((F.col("entity_id") != F.col("_target")).alias("moved"), F.col("page_id").alias("id"))
    m = merges.select(F.col("from_id").alias("_from"), F.col("into_id").alias("_into"))
    moved = pages.join(m, F.col("entity_id") == F.col("_from"), "left").withColumn(
        "_target", F.coalesce("_into", "entity_id")).drop("_from", "_into")
    winners = moved.filter("_target IS NOT NULL").groupBy("_target").agg(F.min(owner)["id"].alias("_winner"))
    return moved.join(winners, "_target", "left").withColumn(
        "entity_id", F.when(F.col("page_id") == F.col("_winner"), F.col("_target"))).select(pages.columns)


def merge_entities(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Merged entities leave; survivors keep their description and vector."""
    return entities.join(merges.select(F.col("from_id").alias("entity_id")), "entity_id", "left_anti").select(entities.columns)


def merge_log(merges: DataFrame, reason: Column, chunk_id: Column | None = None, job_id: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("bigint")
    return merges.select(
        F.col("from_id").alias("merged_from_id"), F.col("into_id").alias("merged_into_id"),
        (null if chunk_id is None else chunk_id).alias("chunk_id"), (null if job_id is None else job_id).alias("job_id"),
        reason.alias("reason"))


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: distinct new keys that do not exist yet."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti").select(new.columns)


def upsert(existing: DataFrame, new: DataFrame, key: str, replace: list[str]) -> DataFrame:
    """Next snapshot: known keys take the ``replace`` columns from ``new``, unknown keys are added whole.

    ``key`` must be unique in both; rows of ``existing`` with a NULL key pass through.
    """
    both = existing.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    updated, added = F.col(f"n.{key}").isNotNull(), F.col(f"o.{key}").isNull() & F.col(f"n.{key}").isNotNull()
    return both.select(*[
        F.when(updated if c in replace else added, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
        for c in existing.columns])


def delete_sources(doomed: DataFrame, sources: DataFrame, chunks: DataFrame, links: DataFrame, relations: DataFrame,
                   log: DataFrame) -> dict[str, DataFrame]:
    """Cascade: sources -> chunks -> links and relations; the merge log only forgets the chunk."""
    gone_chunks = chunks.join(doomed, "source_id", "left_semi").select("chunk_id")
    forgotten = log.join(gone_chunks.withColumnRenamed("chunk_id", "_gone"), F.col("chunk_id") == F.col("_gone"), "left")
    return {
        "sources": sources.join(doomed, "source_id", "left_anti"),
        "chunks": chunks.join(doomed, "source_id", "left_anti"),
        "chunk_entities": links.join(gone_chunks, "chunk_id", "left_anti"),
        "relations": relations.join(gone_chunks, "chunk_id", "left_anti"),
        "entity_merge_log": forgotten.withColumn("chunk_id", F.when(F.col("_gone").isNull(), F.col("chunk_id"))).drop("_gone"),
    }


def merge_page_entities(page_entities: DataFrame, merges: DataFrame) -> DataFrame:
    return repoint(page_entities, ["entity_id"], merges).distinct()


