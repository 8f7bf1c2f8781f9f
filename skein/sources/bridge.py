"""Domain tables derived from a folder of Parquet tables.

``Tables`` maps documents, vectors, events and conversations onto the schemas the operators work
on (sources, chunks, entities, relations, links, pages, jobs, questions). Every rule uses whole
tables. The chunk table and the graph tables made from it are staged once per application, the way
an ingest run would leave them behind; everything else is a lazy view.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skein.functions import text as T
from skein.operators.chunking import chunk_documents
from skein.session import spread, stage_once, tune

EPOCH = "2024-01-01 00:00:00"
CHUNKS_PER_SOURCE = 1_000_000
TURNS_PER_CONVERSATION = 1_000
STAGED_FROM = ("documents", "embeddings")  # what the staged tables are made of
API_BASE_URL = "http://localhost:8000/api/v1"

# The entity type of a document's subject by language, the relation type by chunk
# position and the job type of an event.
ENTITY_TYPES = {"en": "person", "fr": "organization", "de": "location", "es": "concept"}
RELATION_TYPES = ["mentions", "cites", "extends"]
JOB_TYPES = {"signup": "ingest_document", "purchase": "synthesize_source_summary"}
QUESTION_PREFIXES = ["What is ", "How does this relate to ", "Summarize ", "Compare "]


def at_second(seconds: Column) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{EPOCH}'") + F.make_dt_interval(secs=F.lit(1)) * seconds


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def numbered(parent: Column, number: Column, room: int) -> Column:
    """Id of a numbered part, for every parent and number, null among them.

    Parts numbered below ``room`` share out a range that starts at the parent's multiple; all others get a negative id, the
    hash of both (63 bits), so the two can't meet. Among negative ids the order of ids is not the order of numbers.
    """
    parent, number = parent.cast("bigint"), number.cast("bigint")
    hashed = F.xxhash64(parent.isNull(), parent, number.isNull(), number).bitwiseOR(F.lit(-1 << 63))
    fits = parent.between(0, (1 << 63) // room - 1) & number.between(0, room - 1)
    return F.when(fits, parent * room + number).otherwise(hashed)


def chosen(key: Column, options: dict[str, str], default: str) -> Column:
    expr = F.lit(default)
    for name, value in options.items():
        expr = F.when(key == name, value).otherwise(expr)
    return expr


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def _fingerprint(self) -> tuple:
        """Path, size and time of the input files: staged tables are reused only while these hold."""
        found = []
        for name in STAGED_FROM:
            files = self.raw(name).select("_metadata.file_path", "_metadata.file_size",
                                          F.col("_metadata.file_modification_time").cast("string").alias("at"))
            found += files.groupBy().agg(F.max("file_path"), F.sum("file_size"), F.max("at"), F.count(F.lit(1))).first()
        return (self.dir, *found)

    def _staged(self, name: str, build) -> DataFrame:
        return stage_once(self.spark, self._fingerprint, name, build)

    @cached_property
    def vector_count(self) -> int:
        return self.raw("embeddings").count()

    @cached_property
    def document_count(self) -> int:
        return self.raw("documents").count()

    def with_vector(self, df: DataFrame, key: Column) -> DataFrame:
        """Attach ``embedding`` of the vector numbered ``key`` modulo the number of vectors."""
        vectors = self.raw("embeddings").select(F.col("vec_id").alias("_vec"), "embedding")
        keyed = df.withColumn("_key", F.pmod(key, F.lit(self.vector_count)))
        return keyed.join(vectors, F.col("_key") == F.col("_vec"), "left").drop("_vec", "_key")

    # --- sources and chunks ------------------------------------------------
    def sources(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("doc_id").alias("source_id"),
            F.concat(F.lit("sources/"), F.col("doc_id")).alias("storage_key"),
            F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")).alias("file_name"),
            F.lit("text/plain").alias("file_type"),
            F.col("n_chars").alias("file_size"),
            F.when(F.col("lang") == "es", "pending").otherwise("processed").alias("status"),
            F.concat(F.lit('{"lang": "'), F.col("lang"), F.lit('", "source": "'), F.col("source"),
                     F.lit('"}')).alias("metadata"),
            at_second(F.col("doc_id")).alias("created_at"),
        )

    def chunks(self) -> DataFrame:
        def build() -> DataFrame:
            docs = spread(self.raw("documents").select("doc_id", "text"))
            cut = chunk_documents(docs, "doc_id").select(
                numbered(F.col("doc_id"), F.col("chunk_index"), CHUNKS_PER_SOURCE).alias("chunk_id"),
                F.col("doc_id").alias("source_id"), "chunk_index", "text_content", "section_heading",
            )
            return self.with_vector(cut, F.col("source_id") * 7 + F.col("chunk_index") * 31)

        return self._staged("chunks", build).withColumn("created_at", at_second(F.col("source_id")))

    # --- graph -------------------------------------------------------------
    def entity_names(self) -> DataFrame:
        words = F.split(T.strip(F.col("text")), rf"[{T.WHITESPACE}]+", 3)
        return spread(self.raw("documents").select("doc_id", "lang", "text")).select(
            F.col("doc_id").alias("entity_id"),
            F.array_join(F.slice(words, 1, 2), " ").alias("name"),
            chosen(F.col("lang"), ENTITY_TYPES, "product").alias("entity_type"),
        )

    def entities(self) -> DataFrame:
        def build() -> DataFrame:
            return self.with_vector(self.entity_names(), F.col("entity_id")).select(
                "entity_id", "name", "entity_type",
                F.concat(F.lit("About "), F.col("name")).alias("description"), "embedding",
                F.when(F.col("entity_type") == "concept", "pending_review").otherwise("published").alias("status"),
            )

        return self._staged("entities", build).withColumn("created_at", at_second(F.col("entity_id")))

    def relations(self) -> DataFrame:
        """One relation per chunk, and one from every document to the first of its collection."""
        def build() -> DataFrame:
            own = self.chunks().select("chunk_id", F.col("source_id").alias("source_entity_id"), "chunk_index")
            kinds = F.array(*[F.lit(t) for t in RELATION_TYPES])
            told = own.select(
                numbered(F.col("chunk_id"), F.lit(0), 10).alias("relation_id"), "source_entity_id",
                F.pmod(F.col("source_entity_id") * 31 + F.col("chunk_index") * 17 + 7,
                       F.lit(self.document_count)).alias("target_entity_id"),
                F.get(kinds, F.pmod("chunk_index", F.lit(len(RELATION_TYPES)))).alias("relation_type"),
                "chunk_id",
            )
            docs = self.raw("documents").select("doc_id", "source")
            first = docs.groupBy("source").agg(F.min("doc_id").alias("target_entity_id"))
            grouped = (
                own.filter("chunk_index = 0").join(docs, F.col("source_entity_id") == F.col("doc_id"))
                .join(first, "source")
                .select(numbered(F.col("chunk_id"), F.lit(1), 10).alias("relation_id"), "source_entity_id", "target_entity_id",
                        F.lit("published_with").alias("relation_type"), "chunk_id")
            )
            return told.unionByName(grouped).withColumns({
                "status": F.lit("published"),
                "confidence_tag": F.when(F.col("relation_type") == "cites", "EXTRACTED").otherwise("INFERRED"),
            })

        return self._staged("relations", build).withColumn("created_at", at_second(F.col("source_entity_id")))

    def chunk_entities(self) -> DataFrame:
        """A chunk mentions both ends of its relation; being published together is no mention."""
        ends = self.relations().filter("relation_type <> 'published_with'").select(
            "chunk_id", F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id"))
        return self._staged("chunk_entities", ends.distinct)

    def named_slug(self, prefix: str = "") -> DataFrame:
        """Slug and name of every entity, with a column prefix for use on both ends of a relation."""
        def build() -> DataFrame:
            named = self._staged("entity_names", self.entity_names)
            return named.withColumn("slug", T.slug(F.col("name"), F.col("entity_id")))

        return self._staged("slugs", build).select(
            F.col("entity_id").alias(f"{prefix}id"), F.col("name").alias(f"{prefix}name"),
            F.col("entity_type").alias(f"{prefix}type"), F.col("slug").alias(f"{prefix}slug"),
        )

    # --- wiki --------------------------------------------------------------
    def wiki_pages(self) -> DataFrame:
        """An entity page and a source page per document; relation lists follow the document's own chunks."""
        def build() -> DataFrame:
            rel = (
                self.relations().select("relation_id", "source_entity_id", "target_entity_id", "relation_type")
                .join(self.named_slug("t_"), F.col("target_entity_id") == F.col("t_id"))
                .groupBy("source_entity_id")
                .agg(F.array_sort(F.collect_list(F.struct("relation_id", "relation_type", "t_slug"))).alias("rels"))
            )
            docs = spread(self.raw("documents").select("doc_id", "text")).join(
                rel, F.col("doc_id") == F.col("source_entity_id"), "left")
            named = docs.join(self.named_slug(), F.col("doc_id") == F.col("id"))
            bullets = F.array_join(F.transform(
                "rels", lambda r: F.concat(F.lit("- "), r["relation_type"], F.lit(": [["), r["t_slug"], F.lit("]]"))), "\n")
            arrows = F.array_join(F.transform(
                "rels", lambda r: F.concat(F.lit("- [["), F.col("slug"), F.lit("]] → "), r["relation_type"],
                                           F.lit(" → [["), r["t_slug"], F.lit("]]"))), "\n")
            file_name = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt"))
            nothing = F.lit("\n\n## Contradictions\n*No contradictions detected.*")
            entity_page = F.struct(
                (F.col("doc_id") * 2).alias("page_id"), F.col("doc_id").alias("entity_id"), F.col("name").alias("title"),
                F.col("slug").alias("slug"),
                F.concat(F.lit("# "), F.col("name"), F.lit("\n"), F.col("text"), F.lit("\n\n## Relations\n"),
                         F.coalesce(bullets, F.lit("")), nothing, F.lit("\n\n## Sources\n- ["), file_name,
                         F.lit(":0]")).alias("content"),
            )
            source_page = F.struct(
                (F.col("doc_id") * 2 + 1).alias("page_id"), F.lit(None).cast("bigint").alias("entity_id"),
                file_name.alias("title"), T.slug(file_name, F.col("doc_id")).alias("slug"),
                F.concat(F.lit("# "), file_name, F.lit("\n"), F.col("text"),
                         F.lit("\n\n## Pages created or updated\n- [["), F.col("slug"), F.lit("]] — "), F.col("name"),
                         F.lit("\n\n## Key relations introduced\n"), F.coalesce(arrows, F.lit("")), nothing).alias("content"),
            )
            return named.select("doc_id", F.explode(F.array(entity_page, source_page)).alias("p")).select(
                "p.*",
                F.when((F.col("p.page_id") % 7) == 0, "pending_review").otherwise("published").alias("status"),
                F.array(F.col("doc_id").cast("string")).alias("synthesized_from_sources"),
                F.col("doc_id").alias("_at"),
            )

        return self._staged("wiki_pages", build).withColumn("synthesized_at", at_second(F.col("_at"))).drop("_at")

    # --- queue and questions -------------------------------------------------
    def jobs(self) -> DataFrame:
        kind = chosen(F.col("event_type"), JOB_TYPES, "synthesize_entity")
        key = F.get_json_object("props", "$.k")
        later = F.col("event_id") % 3 == 0
        return self.raw("events").select(
            F.col("event_id").alias("job_id"), kind.alias("job_type"),
            F.when(kind == "synthesize_entity", F.col("user_id")).alias("target_entity_id"),
            F.concat(F.lit('{"source_id": "'), key, F.lit('", "source_ids": ["'), key, F.lit('"]}')).alias("payload"),
            F.when(F.col("value") < 5, "completed").when(F.col("value") < 8, "processing").otherwise("pending").alias("status"),
            F.when(later, F.col("ts") + F.expr("INTERVAL '1' HOUR")).alias("scheduled_at"),
            (F.col("event_id") % 6).cast("int").alias("attempts"), F.lit(3).alias("max_retries"),
            F.col("ts").alias("created_at"),
        )

    def questions(self) -> DataFrame:
        """User turns as questions; the vector of a question is one of the given vectors."""
        return self.asked().drop("conv_id", "turn")

    def asked(self) -> DataFrame:
        """Questions with the conversation and turn they come from; a missing one counts as 0 for the vector, not for the id."""
        prefix = F.coalesce(F.get(F.array(*[F.lit(p) for p in QUESTION_PREFIXES]), F.pmod("turn", F.lit(5)).cast("int")),
                            F.lit(""))
        asked = self.raw("conversations").filter("role = 'user'").select(
            numbered(F.col("conv_id"), F.col("turn"), TURNS_PER_CONVERSATION).alias("query_id"),
            F.concat(prefix, F.col("text")).alias("text"), F.col("conv_id"), F.col("turn"),
        )
        conv, turn = [F.pmod(F.coalesce(F.col(c), F.lit(0)), F.lit(self.vector_count)) for c in ("conv_id", "turn")]
        return self.with_vector(asked, conv * 13 + turn * 7)
