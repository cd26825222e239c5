"""Change topics as streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kadence.schemas import TOPIC


@dataclass(frozen=True)
class KafkaTopic:
    servers: str
    topic: str


@dataclass(frozen=True)
class FileTopic:
    """A topic landed as parquet files with the broker's columns."""

    path: str
    schema: T.StructType = TOPIC


def read_change_stream(
    spark: SparkSession,
    source: KafkaTopic | FileTopic,
    *,
    records_per_trigger: int | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """``value, topic, partition, offset`` from the earliest offset on.

    A batch takes all that has arrived. ``records_per_trigger`` bounds it for a topic,
    ``files_per_trigger`` for landed files; what is left comes with the next batches.
    """
    if isinstance(source, FileTopic):
        reader = spark.readStream.schema(source.schema)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        return reader.parquet(source.path)
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", source.servers)
        .option("subscribe", source.topic)
        .option("startingOffsets", "earliest")
    )
    if records_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", records_per_trigger)
    return reader.load().select(
        F.col("value").cast("string").alias("value"), "topic", "partition", "offset"
    )
