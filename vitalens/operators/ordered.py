"""Order-dependent operators that split hot keys by time.

A plain window puts all rows of a key into one task.  Here rows are windowed per
(key, time bucket); each bucket is also reduced to its last row, and a window
over these few rows carries state between buckets.  A key holding a third of all
rows is therefore spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds of a timestamp column, with or without time zone."""
    if dict(df.dtypes)[ts] == "timestamp":
        return F.unix_micros(ts)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))


def with_prior(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    payload: list[str],
    where: Column | None = None,
    strict: bool = False,
    bucket: str = "day",
    out: str = "prior",
) -> DataFrame:
    """Add ``out``: struct of ``payload`` from the last earlier row of the same key.

    ``where`` limits which rows can be that earlier row.  With ``strict`` rows of
    equal timestamp do not see each other; otherwise ``tie`` orders them.
    """
    value = F.struct(ts, tie, *[c for c in payload if c not in (ts, tie)])
    candidate = value if where is None else F.when(where, value)
    rows = df.withColumn("_bucket", F.date_trunc(bucket, F.col(ts))).withColumn(
        "_candidate", candidate
    )
    part = Window.partitionBy(*keys, "_bucket")
    if strict:
        inside = part.orderBy(micros(df, ts)).rangeBetween(Window.unboundedPreceding, -1)
    else:
        inside = part.orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.max("_candidate").over(inside))
    between = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        df.select(*keys, F.date_trunc(bucket, F.col(ts)).alias("_bucket"), candidate.alias("_candidate"))
        .groupBy(*keys, "_bucket")
        .agg(F.max("_candidate").alias("_last"))
        .withColumn("_carried", F.max("_last").over(between))
        .select(*keys, "_bucket", "_carried")
    )
    return (
        rows.join(carried, [*keys, "_bucket"], "left")
        .withColumn(out, F.coalesce("_inside", "_carried"))
        .drop("_bucket", "_candidate", "_inside", "_carried")
    )


def top_per_key(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of each key with their rank.

    The filter on ``row_number`` lets Spark drop all but ``k`` rows per key in
    every task before the shuffle, so hot keys stay small.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def salted_join(
    many: DataFrame,
    one: DataFrame,
    key: str,
    spread: list[str],
    how: str = "left",
    salts: int = 16,
    hot_rows: int = 100_000,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join rows to a table unique on ``key`` where some keys own very many rows.

    Keys with more than ``hot_rows`` rows are spread over ``salts`` tasks by a
    hash of the ``spread`` columns; only their single matching row is repeated.
    At most rows/``hot_rows`` keys can be hot, so that list stays small.  Keys are
    counted in ``counted``, a cheap table with as many rows per key as ``many``
    (default ``many`` itself).  Neither table is gathered in the driver for a broadcast, however
    small its files let Spark take it to be.
    """
    hot = (
        (many if counted is None else counted)
        .filter(F.col(key).isNotNull())
        .groupBy(key)
        .count()
        .filter(F.col("count") > hot_rows)
        .select(key, F.lit(True).alias("_hot"))
    )
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0))
    left = many.join(hot, key, "left").withColumn("_salt", salt.cast("int")).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    right = one.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast once a count has shown the table to be small; else a join that sorts both sides.

    The count runs when the plan is built and stops at the bound.  Beyond it Spark may not broadcast
    either, as it would by the size of the files it reads.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df.hint("merge")
