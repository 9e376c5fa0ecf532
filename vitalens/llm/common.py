"""Helpers shared by the operators: saved tables, Arrow passes, words, hashes."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalens.session import checkpoint_folder

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Bytes to words: A-Z become a-z, ASCII other than digits and letters becomes a space.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back.

    Cuts the lineage, so a lost executor costs no recomputation beyond its tasks.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_join(df: DataFrame) -> DataFrame:
    """The table for a join by sorting both sides: a table that grows with the input is never gathered in the driver to be broadcast."""
    return df.hint("merge")


def numbered(df: DataFrame, order: list, name: str = "number") -> DataFrame:
    """The rows of df with their place, from 1, in a global order.

    A range-partitioned sort places a row within its partition; the partitions' sizes, one
    row for each, say how many rows come before it.  No task sees more than its share, and
    rows of equal keys are dealt apart by the place they came from.
    """
    spread = df.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*order, "_tie").drop("_tie")
    placed = saved(spread.withColumn("_place", F.monotonically_increasing_id()))
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    ahead = sizes.select("_part", before.alias("_before"))
    return placed.withColumn("_part", part).join(ahead, "_part").withColumn(name, F.col("_before") + within + 1).drop("_part", "_before", "_place")


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches of about `limit` bytes in a string column, or of one row that holds more."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    return df.mapInArrow(work, schema)


def remembered(key: tuple, make: Callable):
    """What make() gives, built once in a Python worker and kept for its later tasks.

    Code travels to workers by value, so its own module variables end with the task.
    """
    kept = sys.modules.setdefault("vitalens_remembered", types.ModuleType("vitalens_remembered")).__dict__
    return kept[key] if key in kept else kept.setdefault(key, make())


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, to bound what one step holds."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null reads as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that any bits of them may be used."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound (a cache, results do not depend on it)."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes; order matters."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mixed(h[j : j + n] + np.uint64(j))
    return mixed(out)


def row_key(id_col: str, text_col: str) -> list:
    """What identifies a document: its id and the hash of its text."""
    return [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key")]
