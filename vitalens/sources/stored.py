"""Stored reviews, documents and owners as tables bucketed and sorted by owner.

The buckets of all tables are cut alike, so filters on an owner open one bucket, joins and
groupings by owner need no exchange of the stored side, and rows of an owner are sorted.

A table is files under a folder and its description in the session's catalog; ``open_table``
describes files that an earlier session wrote.  Grouping or joining by owner and one more
column uses the buckets too if ``spark.sql.requireAllClusterKeysForCoPartition`` is off,
as in ``session.local_session``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitalens.session import exists

OWNER = "owner_id"
BUCKETS = 64


def open_table(
    spark: SparkSession,
    name: str,
    path: str,
    schema: str,
    partitions: tuple[str, ...] = (),
    order: tuple[str, ...] = (OWNER,),
    buckets: int = BUCKETS,
) -> DataFrame:
    """The table over the files under ``path``, described if the catalog does not know it yet."""
    parts = f"PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet {parts} "
        f"CLUSTERED BY ({OWNER}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    if partitions and exists(spark, path):
        spark.catalog.recoverPartitions(name)
    return spark.table(name)


def schema_of(df: DataFrame, partitions: tuple[str, ...] = ()) -> str:
    """Columns and types in DDL, the partition columns last."""
    last = [f for f in df.schema.fields if f.name in partitions]
    first = [f for f in df.schema.fields if f.name not in partitions]
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*first, *last])


def write_table(
    df: DataFrame,
    name: str,
    path: str,
    partitions: tuple[str, ...] = (),
    order: tuple[str, ...] = (OWNER,),
    buckets: int = BUCKETS,
) -> DataFrame:
    """Store rows; partitions that occur in them are replaced, others stay.

    Rows are sent to the task of their bucket first, so a partition gets one file per bucket.  An
    owner is in one bucket by definition: the hot one is a large file, which readers split.
    """
    open_table(df.sparkSession, name, path, schema_of(df, partitions), partitions, order, buckets)
    spark, mode = df.sparkSession, "spark.sql.sources.partitionOverwriteMode"
    rows = df.select(*[c for c in df.columns if c not in partitions], *partitions)
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")  # catalog tables take this from the session only
    try:
        rows.repartition(buckets, OWNER).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(mode, before)
    return spark.table(name)
