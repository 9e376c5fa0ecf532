"""Quality by importance resampling.

Two generative models of hashed words and word pairs are counted: of target text, which
is labelled good, and of raw text, which is every document.  A document's log weight is
EFFECTIVE times its mean log ratio of the two, as if all documents had that many
features, so that long ones are not judged by length.  Documents are sampled without
replacement by Gumbel top-k: log weight plus Gumbel noise, of which the k largest stay.
k is the number of documents whose log weight reaches a level that parts good from bad
labels best.  The noise depends on id and text alone, so a rerun gives the same sample.

The models count every document.  Of the labels at most LABELS rows are used, those of
the smallest hashes of their ids; half of them fit the target, half set the level.
Documents without words (null, empty, white space) have no weight and are rejected.
Without labels of both kinds nothing is known, and all documents with words stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalens.llm.common import WordHashes, arrow_map, mixed, rolling, saved, slices, texts

BUCKETS = 1 << 16
LABELS = 20_000
EFFECTIVE = 100
SMOOTHING = 0.01  # share of a uniform model in each of the two
BIN = 0.25  # of log weight, where the level is sought
SHORT = 8  # features by which a short text is drawn to weight 0
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")


class Features:
    def __init__(self):
        self.hashes = WordHashes()

    def of(self, text: bytes) -> np.ndarray:
        """Buckets of the words and of the pairs of neighbours."""
        h = self.hashes.of(WORD.findall(text))
        return (np.concatenate([mixed(h), rolling(h, 2)]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """(bucket, target, raw): how often each feature occurs in docs (text, good)."""

    def work(batches):
        features = Features()
        target, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            for text, good in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                n = np.bincount(features.of(text), minlength=BUCKETS) if text else 0
                raw += n
                if good:
                    target += n
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(target[seen]), pa.array(raw[seen])], names=["bucket", "target", "raw"])

    return arrow_map(docs, work, "bucket bigint, target bigint, raw bigint").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratios(rows) -> np.ndarray:
    """The log ratio of the two models, for each bucket."""
    counts = np.zeros((2, BUCKETS))
    for r in rows:
        counts[:, r.bucket] = r.target, r.raw
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    target, raw = (1 - SMOOTHING) * share + SMOOTHING / BUCKETS
    return np.log(target / raw) if counts[0].any() else np.zeros(BUCKETS)


def weighted(rows: DataFrame, ratios: np.ndarray) -> DataFrame:
    """rows (row, text) as (row, log_weight)."""
    sent = rows.sparkSession.sparkContext.broadcast(ratios)

    def work(batches):
        features, ratio = Features(), sent.value
        for batch in slices(batches):
            out = []
            for text in texts(batch.column(1)):
                f = features.of(text)
                out.append(float(EFFECTIVE * ratio[f].sum() / (len(f) + SHORT)) if len(f) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["row", "log_weight"])

    return arrow_map(rows, work, f"row {rows.schema['row'].dataType.simpleString()}, log_weight double")


def level(bins) -> float:
    """The weight that parts good from bad best, each kind counting the same; without both kinds, none.

    bins: rows (at, good, n) of a histogram with BIN-wide steps."""
    good, bad = ({r.at: r.n for r in bins if r.good is kind} for kind in (True, False))
    if not good or not bad:
        return float("-inf")
    cuts = range(min([*good, *bad]), max([*good, *bad]) + 2)
    right = {c: sum(n for at, n in good.items() if at >= c) / sum(good.values()) + sum(n for at, n in bad.items() if at < c) / sum(bad.values()) for c in cuts}
    best = [c for c in cuts if right[c] >= max(right.values()) - 1e-12]
    return BIN * (best[0] + best[-1]) / 2


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column, narrowed down by histograms; no row moves."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low < high:
        width = (high - low) / 1024
        bins = F.least(F.floor((F.col(column) - low) / width), F.lit(1023))
        counts = {r.b: r for r in df.where(F.col(column).between(low, high)).groupBy(bins.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            if k <= counts[b].n:
                break
            k -= counts[b].n
        low, high = counts[b].lo, counts[b].hi
    return low


def resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", seed: int = 17) -> DataFrame:
    """One row per document: row (all columns), log_weight, gumbel_key, keep."""
    sample = labels.select(labels[id_col].cast("bigint").alias("label_id"), labels[quality_col].cast("int").alias("quality")).dropna()
    sample = sample.groupBy("label_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("label_id"), "label_id").limit(LABELS)
    sample = F.broadcast(saved(sample))  # at most LABELS rows
    fits = F.pmod(F.xxhash64(F.lit(seed), "label_id"), F.lit(2)) == 0
    base = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    labelled = base.join(sample, base.id == F.col("label_id"), "left")
    ratios = log_ratios(counted(labelled.select("text", (fits & (F.col("quality") == 1)).alias("good"))).collect())
    held = base.join(sample, base.id == F.col("label_id")).where(~fits).select(F.struct((F.col("quality") == 1).alias("good")).alias("row"), "text")
    tried = weighted(held, ratios).where("log_weight is not null")
    cut = level(tried.groupBy(F.floor(F.col("log_weight") / BIN).alias("at"), F.col("row.good").alias("good")).agg(F.count("*").alias("n")).collect())
    every = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].cast("string").alias("text"))
    uniform = (F.pmod(F.xxhash64(F.lit(seed), f"row.{id_col}", F.xxhash64(f"row.{text_col}")), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    scored = saved(weighted(every, ratios).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))))
    k = scored.where(F.col("log_weight") >= cut).count()
    bound = kth_largest(scored.where("log_weight is not null"), "gumbel_key", k) if k else float("inf")
    return scored.withColumn("keep", F.coalesce(F.col("gumbel_key") >= bound, F.lit(False)))
