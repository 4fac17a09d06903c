"""Event topics as an append-only table: publish and read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave import fixed

SCHEMA = "topic string, id string, timestamp timestamp, payload string"


def messages(rows: DataFrame, topic: str, id_col: str, time_col: str, *fields: str) -> DataFrame:
    """Rows as messages of a topic: id, time stamp and a JSON payload."""
    if topic not in fixed.TOPICS:
        raise ValueError(f"unknown topic {topic!r}")
    return rows.select(
        F.lit(topic).alias("topic"),
        F.col(id_col).cast("string").alias("id"),
        F.col(time_col).cast("timestamp").alias("timestamp"),
        F.to_json(F.struct(*fields)).alias("payload"),
    )


def publish(msgs: DataFrame, root: str) -> None:
    msgs.write.mode("append").partitionBy("topic").parquet(root)


def read(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(root)


def read_stream(spark: SparkSession, root: str, files_per_trigger: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(root)
    )


def consume(msgs: DataFrame, topic: str, count: int = 10) -> DataFrame:
    """The first messages of a topic in id order."""
    return msgs.where(F.col("topic") == topic).orderBy("id").limit(count)
