"""Importance resampling towards a target distribution of words.

Two models of hashed word runs are counted: of target texts, and of the documents (raw).
The gain of a bucket is the log ratio of the two, with one added to every bucket, in
thousandths and rounded down; a document's weight is the sum of the gains of its features.
With Gumbel noise added, the documents of the largest scores are a sample without
replacement in proportion to exp(weight / 1000).  The noise depends on seed and id alone.

Texts are read by Arrow kernels: ascii_lower, split_pattern_regex, list_flatten and
dictionary_encode.  Dictionary indices, shifted against each other, form the runs of words;
distinct runs are hashed once a batch by CRC, their gains are taken by index and summed
within each document.

Counts cover all rows: tasks add up their buckets, of which there is a fixed number, and
only these sums meet.  The scored rows are put in order by a range-partitioned sort.

Null, empty and wordless texts have no features, weight 0, and are drawn only if `min_words`
is 0.  A null id takes part with the noise of an empty one and comes after equal
scores.  Repeated rows are documents of their own with equal scores.  Without target texts
or documents, all counts of that side are 0; an empty table of documents gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalens.llm.common import arrow_map, by_bytes, numbered, saved

BUCKETS, MAX_N, SEED, MIN_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(column: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many words each text of a column has, and all words in order, as a dictionary array."""
    # The kernels get buffers of their own: ascii_lower misreads those of a slice that was cast.
    own = column.take(pa.array(np.arange(len(column))))
    lowered = pc.ascii_lower(pc.fill_null(own, ""))
    lists = pc.split_pattern_regex(lowered, SEPARATORS)
    flat = pc.list_flatten(lists)
    held = pc.not_equal(flat, "")  # a separator at either end leaves an empty piece
    ends = np.r_[0, np.cumsum(held.to_numpy(zero_copy_only=False))]
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return np.diff(ends[bounds]), pc.dictionary_encode(flat.filter(held))


def features_of(column: pa.Array, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a column of texts: words of each text, and for all runs of 1 to max_n of their words
    the text and the bucket of each."""
    sizes, words = words_of(column)
    first = words.indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    spelled = [w.encode() for w in words.dictionary.to_pylist()]
    hashes = np.fromiter((zlib.crc32(w) % buckets for w in spelled), np.int64, len(spelled))
    owners, found = [owner], [hashes[first]]
    run, known = first, spelled
    for n in range(2, max_n + 1):
        # A run of n words is one of n - 1 and the word behind it, where the text goes on.
        inside = owner[: len(run) - 1] == owner[n - 1 :]
        pairs = run[:-1] * len(spelled) + first[n - 1 :]
        distinct, back = np.unique(np.where(inside, pairs, -1), return_inverse=True)
        known = [known[p // len(spelled)] + b" " + spelled[p % len(spelled)] if p >= 0 else b"" for p in distinct.tolist()]
        hashes = np.fromiter((zlib.crc32(w) % buckets for w in known), np.int64, len(known))
        owners.append(owner[: len(run) - 1][inside])
        found.append(hashes[back][inside])
        run = back
    return sizes, np.concatenate(owners), np.concatenate(found)


def counts_of(docs: DataFrame, text_col: str, max_n: int, buckets: int) -> np.ndarray:
    """How many features fall into each bucket; the driver gets at most `buckets` rows."""

    def work(batches):
        total = np.zeros(buckets, np.int64)
        for batch in by_bytes(batches, 0):
            total += np.bincount(features_of(batch.column(0), max_n, buckets)[2], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    texts = docs.select(docs[text_col].cast("string").alias("text"))
    for r in arrow_map(texts, work, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains_of(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1)(S + B) / ((s + 1)(T + B)))) for each bucket."""
    top = (target + 1.0) * (raw.sum() + len(raw))
    return np.floor(1000 * np.log(top / ((raw + 1.0) * (target.sum() + len(raw))))).astype(np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, max_n: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""
    sent, buckets = docs.sparkSession.sparkContext.broadcast(gains), len(gains)

    def work(batches):
        for batch in by_bytes(batches, 1):
            sizes, owner, bucket = features_of(batch.column(1), max_n, buckets)
            features = np.bincount(owner, minlength=len(sizes))
            weight = np.zeros(len(sizes), np.int64)
            order = owner if max_n == 1 else np.argsort(owner, kind="stable")
            gain = sent.value[bucket] if max_n == 1 else sent.value[bucket[order]]
            some = np.flatnonzero(features)
            if len(some):
                weight[some] = np.add.reduceat(gain, (np.cumsum(features) - features)[some])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(features.astype(np.int64)), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return arrow_map(rows, work, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    max_n: int = MAX_N,
    buckets: int = BUCKETS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank.

    Of the documents with at least min_words words, percent in a hundred (rounded down) are
    drawn; rank is their place by score, largest first, then by id; null for the others.
    """
    gains = gains_of(counts_of(target, target_col, max_n, buckets), counts_of(docs, text_col, max_n, buckets))
    noise = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(noise, 1, 8), 16, 10).cast("bigint") + 0.5) / F.lit(4294967296.0)
    score = F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("bigint")
    scored = saved(weighted(docs, gains, id_col, text_col, max_n).withColumn("score", score))
    fits = scored.where(F.col("n_words") >= min_words)
    drawn = percent * fits.count() // 100
    ranked = numbered(fits, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features"], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint")))
