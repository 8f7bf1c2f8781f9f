"""Registered corpus queries: thin calls of the operators over the given tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.llm import decontaminate, exact, impacts, langid, licenses, linededup, mixing, neardup, periods, pii, prefixes, shards, tokenfiles
from skein.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op1_decontaminate", f"""
with d as (select doc_id, {_WORDS} w from documents),
b as (select item_id, {_WORDS} w from benchmark),
bw as (select distinct item_id, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') p
       from b, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(i) where len(w) > 0),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') p from d, (select distinct n from bw) x, unnest(range(1, len(w) - n + 2)) t(i)),
hit as (select doc_id, i, dw.n, item_id from dw join bw on dw.p = bw.p and dw.n = bw.n),
covered as (select doc_id, count(distinct i + j) n_hit from hit, unnest(range(0, n)) t(j) group by 1),
items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items
          from (select distinct doc_id, cast(item_id as varchar) item from hit) group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join covered using (doc_id) left join items using (doc_id)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op4_exact_dedup", r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t from documents)
select doc_id, min(doc_id) over same keep_id, count(*) over same group_size, doc_id = min(doc_id) over same kept, sha256(t) text_sha256
from n window same as (partition by t)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir)).drop("spans")


@query("op8_personal_data")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find_personal_data(docs, pii.fit(docs))


@query("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs)).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query("op10_shard")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(documents(spark, sf_dir))


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfiles.token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_mix_sources")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir)).drop("source", "tie")


@query("op3_line_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_kept", "n_near", F.coalesce(F.length("kept_text"), F.lit(0)).cast("long").alias("kept_chars"),
                      F.sha2(F.encode(F.coalesce("kept_text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


@query("op2_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Of every tenth document by hash, the words from a place on repeat the first few of them."""
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_report(documents(spark, sf_dir), arrange=repeated_tail)


@query("op12_exact_top_k", """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) v from embeddings
           where embedding is not null and vec_id is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
s as (select q.vec_id query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) score
      from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, cast(rank as integer) rank, vec_id, score from r where rank <= 20""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op11_prefix_trie")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixes.encode(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    return prefixes.prefix_trie(prefixes.graft(turns, F.col("conv_id") - F.col("conv_id") % 100, taken, 5))
