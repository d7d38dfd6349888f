"""Streams of product messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import STREAM_TOPIC


def topic_stream(spark: SparkSession, servers: str, topic: str = STREAM_TOPIC, rows_per_batch: int | None = None, **options) -> DataFrame:
    """Messages of a topic from its beginning, as ``value``. Offsets live in the checkpoint.

    ``rows_per_batch`` bounds a micro-batch; without it a batch takes what has arrived.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**options)
    )
    if rows_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", rows_per_batch)
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same from landed files with one message per line."""
    reader = spark.readStream.schema("value string").format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)

