"""Repeated uploads, dropped as they arrive or in a batch.

An upload repeats another if the same owner sent the same text (by fingerprint) within a
period before it.  Repeats of a repeat count from the upload that was kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalens.streaming import throttle as th

KEYS = ("owner_id", "text_hash")


def _key(keys: tuple[str, ...]):
    return F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))


def distinct_uploads_stream(uploads: DataFrame, ts: str, period: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Uploads of a stream without repeats within ``period``, which is the watermark's delay too.

    The state holds one row per key and forgets it when the watermark has passed the kept
    upload by ``period``.  Of uploads out of order the one that arrives first is kept.  A repeat
    later than ``period`` is dropped as well if the state still holds its key, which it does until
    the batch after the watermark's passing; ``exact_uploads_stream`` lets it through.
    """
    return uploads.withWatermark(ts, period).dropDuplicatesWithinWatermark(list(keys))


def exact_uploads_stream(uploads: DataFrame, ts: str, upload_id: str, seconds: int, lateness: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(key, upload_id) of the uploads that ``distinct_uploads`` keeps, decided in event order.

    An upload is decided when the watermark passes it; the state of a key is the time of the kept
    one and the uploads within the lateness.  Needs the RocksDB state store.
    """
    decided = th.throttle_stream(uploads.withColumn("_key", _key(keys)), "_key", ts, upload_id, limit=1, window=seconds, lateness=lateness)
    return decided.filter("admitted").select("key", F.col("id").alias(upload_id))


def distinct_uploads(uploads: DataFrame, ts: str, upload_id: str, seconds: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The same for a table, by event time: at most one upload of a key is kept in ``seconds``."""
    decided = th.throttle(uploads.withColumn("_key", _key(keys)), "_key", ts, upload_id, limit=1, window=seconds, bucket="day")
    kept = decided.filter("admitted").select(F.col("id").alias(upload_id))
    return uploads.join(kept, upload_id, "left_semi")
