"""Uploads as a stream: ingest, score and store each micro-batch."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vitalens.plans import corpus
from vitalens.sources import ingest, sinks


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files arriving in a folder, as a stream of (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def score_uploads(
    files: DataFrame, target: str, checkpoint: str, today: date, available_now: bool = True
) -> StreamingQuery:
    """Store uploads, score the accepted ones and append reviews, scores and findings under ``target``.

    A batch is written under its own batch id, so a retried batch replaces what a
    lost attempt left behind.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        run = f"stream-{batch_id}"
        sinks.write_uploads(ingest.mark(batch), target, run)
        stored = sinks.read_uploads(batch.sparkSession, target, run).filter("accepted")
        reviews = corpus.score_corpus(ingest.accepted_of(stored), today)
        sinks.write_reviews(reviews, target, today, run_id=run)

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
