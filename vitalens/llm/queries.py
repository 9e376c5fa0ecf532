"""The queries of the numbered operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalens.llm import ann, contamination, importance, langid, licenses, linedup, mixing, neardup, pieces, quality, runs, tokens, wrappers
from vitalens.llm.common import table
from vitalens.llm.sql import SQL as NEW_SQL

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_prefixes(table(spark, d, "documents"), BYTE_BPE, keep_prefixes=False).drop("prefix_steps")


def op2_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return pieces.encode(table(spark, d, "documents"), PIECE_BPE)


def op3_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, d, "documents")).drop("text_key")


def op4_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    out = langid.identified(docs, remainder != 1)
    return out.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op5_licenses(spark: SparkSession, d: str) -> DataFrame:
    base, every = F.array_distinct("places.label"), F.array_distinct(F.concat("places.label", "spans.label"))
    return licenses.scan(table(spark, d, "documents")).select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.get("places.word", F.lit(0)).alias("first_word"),
        F.get("places.word", F.size("places") - 1).alias("last_word"),
        F.concat_ws(",", F.array_sort(base)).alias("base_labels"),
        F.concat_ws(",", F.array_sort(every)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"),
    )


def op6_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = contamination.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_main_text(spark: SparkSession, d: str) -> DataFrame:
    found = wrappers.main_texts(table(spark, d, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op8_quality(spark: SparkSession, d: str) -> DataFrame:
    scored = quality.resampled(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels"))
    return scored.select(F.col("row.doc_id").alias("doc_id"), "log_weight", "gumbel_key", "keep")


def op9_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    done = linedup.dedup_lines(table(spark, d, "documents").select("doc_id", "text"), min_words=0)
    return done.select(F.col("row.doc_id").alias("doc_id"), "lines.n_lines", "lines.n_removed", F.col("lines.text").alias("text"))


def op10_nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op11_source_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = runs.periodic_runs(docs.select("doc_id", runs.repeated_tails(docs.text, docs.doc_id).alias("text")))
    every = F.col("periodic.runs")
    # Lengths per period are compared by products, exactly; runs come by start, then period, and the first of equals stays.
    none = F.struct(*[F.lit(None).cast("bigint").alias(c) for c in ("start", "length", "period")])
    best = F.aggregate(every, none, lambda a, r: F.when(a.length.isNull() | (r.length * a.period > a.length * r.period), r).otherwise(a))
    lines = F.array_join(F.transform(every, lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(every).cast("bigint").alias("n_runs"),
        best.start.alias("start"),
        best.length.alias("length"),
        best.period.alias("period"),
        F.call_function("div", best.length * 1000, best.period).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("periodic.collapsed"), 256).alias("collapsed_sha256"),
    )


def op13_importance_resampling(spark: SparkSession, d: str) -> DataFrame:
    drawn = importance.resampled(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_sentencepiece, op3_near_duplicates, op4_language, op5_licenses, op6_decontamination, op7_main_text, op8_quality, op9_line_dedup, op10_nearest_vectors, op11_source_mix, op12_periodic_runs, op13_importance_resampling)}

#: Places of windows by a join of word runs of each window's length, then the words they cover.
OP6_SQL = r"""
with split as (
  select 'd' as kind, row_number() over () as r, doc_id, null as item, text from documents
  union all
  select 'b', row_number() over (), null, cast(item_id as varchar), text from benchmark where item_id is not null
), worded as (
  select kind, r, doc_id, item, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from split
), windows as (
  select distinct item, size, list_aggregate(w[i : i + size - 1], 'string_agg', ' ') as run
  from (select item, w, least(10, len(w)) as size, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i
        from worded where kind = 'b' and len(w) > 0)
), runs as (
  select r, i, size, list_aggregate(w[i : i + size - 1], 'string_agg', ' ') as run
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) as i
        from worded, (select distinct size from windows) where kind = 'd')
), places as (
  select r, i, size, item from runs join windows using (size, run)
), hits as (
  select r, count(distinct pos) as n_hit
  from (select r, unnest(range(i, i + size)) as pos from (select distinct r, i, size from places)) group by r
), found as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct r, item from places) group by r
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from worded left join hits using (r) left join found using (r) where kind = 'd'
"""
SQL: dict[str, str] = {"op6_decontamination": OP6_SQL} | NEW_SQL
