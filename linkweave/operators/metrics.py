"""Counters over an access log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions import web


def request_counts(log: DataFrame) -> DataFrame:
    """Requests and time spent per method, normalised path and status."""
    return (
        log.withColumn("path", web.normal_path("path"))
        .groupBy("method", "path", "status")
        .agg(F.count(F.lit(1)).alias("requests"), F.sum("duration").alias("seconds"))
    )


def path_durations(log: DataFrame) -> DataFrame:
    return (
        log.withColumn("path", web.normal_path("path"))
        .groupBy("path")
        .agg(F.sum("duration").alias("seconds"))
    )


def action_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("action").agg(F.count(F.lit(1)).alias("events"))


def hourly_counts(log: DataFrame) -> DataFrame:
    """Requests per hour and path (an addition of this library)."""
    return (
        log.withColumn("path", web.normal_path("path"))
        .groupBy(F.window("ts", "1 hour").alias("w"), "path")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(F.col("w.start").alias("hour"), "path", "requests")
    )
