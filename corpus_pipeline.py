"""From raw documents to encoded training text, in five written stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; its result is
written and read again as the next one's input.  The last returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalens.llm import contamination, linedup, neardup, pieces, quality
from vitalens.llm.common import saved, sorted_join, table
from vitalens.llm.queries import PIECE_BPE


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the resampled documents."""
    return quality.resampled(docs, table(spark, sf_dir, "labels")).where("keep").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated lines; a document that loses all of them is a copy and goes."""
    done = linedup.dedup_lines(docs, min_words=0).where("lines.n_removed < lines.n_lines or lines.n_lines = 0")
    done = done.select("row.*", F.col("lines.text").alias("_text"))
    return replaced(done, docs.columns, "_text")


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, linked from a similarity of 0.8 on, stays."""
    kept = neardup.near_duplicates(docs, percent=80).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    keyed = docs.withColumn("_text_key", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_text_key").eqNullSafe(F.col("_key"))
    return keyed.join(sorted_join(kept), same, "left_semi").dropDuplicates(["doc_id", "_text_key"]).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages; documents that are mostly benchmark go."""
    items = table(spark, sf_dir, "benchmark")
    return replaced(contamination.decontaminated(docs, items).withColumn("_text", F.col("text")), docs.columns, "_text")


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every document into pieces, and decode it back."""
    return pieces.encode(docs, PIECE_BPE)


def replaced(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The given columns with another text and its length."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("bigint")}
    return df.select(*[new[c].cast(df.schema[c].dataType).alias(c) if c in new else F.col(c) for c in columns])


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", duplicate_stage),
    ("decontamination", benchmark_stage),
    ("sentencepiece", piece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# Forward passes, automata and hashes have no SQL form; tests compare with brute force.
ORACLE_SQL = None
