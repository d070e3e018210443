"""Incremental forms of what the batch plans keep between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, identity_hash


def dedupe_stream(posts: DataFrame, horizon: str = "60 days", by_content: bool = False) -> DataFrame:
    """First sight of each post within the horizon; state older than the watermark is dropped. `posts` has created_ts."""
    key = content_hash(F.col("title"), F.col("body")) if by_content else identity_hash(F.col("id"), F.col("url"))
    timed = posts.withColumn("event_time", F.timestamp_seconds("created_ts")).withColumn("hash", key)
    return timed.withWatermark("event_time", horizon).dropDuplicatesWithinWatermark(["hash"])


def weekly_sizes(events: DataFrame, time_col: str, group_col: str, late: str = "1 day") -> DataFrame:
    """(cluster_id, week, size) by tumbling weeks, which begin on Monday; each is final once the watermark passes it."""
    week = F.window(F.col(time_col), "7 days", startTime="4 days")
    counted = events.withWatermark(time_col, late).groupBy(week.alias("w"), F.col(group_col).alias("cluster_id")).agg(F.count("*").alias("size"))
    return counted.select("cluster_id", F.col("w.start").alias("week"), "size")
