"""Histories between runs: clusters, dedupe hashes, weekly sizes, centroids and term frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, identity_hash

CLUSTERS = "date string, cluster_id int, title string, problem string, sector string, embedding array<double>"


def cluster_entries(clusters: DataFrame, date: str) -> DataFrame:
    """Rows of the cluster history for a run's clusters; those without a vector have nothing to compare."""
    return clusters.where(F.size("embedding") > 0).select(F.lit(date).alias("date"), "cluster_id", "title", "problem", "sector", "embedding")


def retain(history: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Entries of the last `days` days; dates are ISO text, so a partition by date is pruned."""
    return history.where(F.col("date") >= F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd"))


def history_stats(history: DataFrame) -> DataFrame:
    return history.agg(F.count("*").alias("total"), F.min("date").alias("oldest"), F.max("date").alias("newest"))


def history_sectors(history: DataFrame) -> DataFrame:
    return history.groupBy(F.coalesce("sector", F.lit("unknown")).alias("sector")).agg(F.count("*").alias("n"))


def dedupe_entries(posts: DataFrame, now: float) -> DataFrame:
    return posts.select(identity_hash(F.col("id"), F.col("url")).alias("hash"), content_hash(F.col("title"), F.col("body")).alias("content_hash"), F.substring("title", 1, 100).alias("title"), F.lit(float(now)).alias("timestamp"))


def merge_dedupe_history(history: DataFrame, entries: DataFrame, now: float, purge_days: int = 60) -> DataFrame:
    """Union without what is older than `purge_days`; the newest entry of a hash stays."""
    alive = history.where(F.col("timestamp") >= now - purge_days * 86400.0).unionByName(entries)
    return alive.groupBy("hash").agg(F.max_by(F.struct("content_hash", "title"), "timestamp").alias("last"), F.max("timestamp").alias("timestamp")).select("hash", "last.content_hash", "last.title", "timestamp")


def shift_weeks(history: DataFrame, sizes: DataFrame, keep: int = 12) -> DataFrame:
    """(week_offset, cluster_id, size): the weeks move back by one, this week's sizes become offset 1."""
    moved = history.withColumn("week_offset", F.col("week_offset") + 1).where(F.col("week_offset") <= keep)
    return moved.unionByName(sizes.select(F.lit(1).alias("week_offset"), "cluster_id", "size"))


def cap_centroids(history: DataFrame, new: DataFrame, limit: int = 100) -> DataFrame:
    """(seq, centroid): the newest `limit` of both."""
    return history.unionByName(new).orderBy(F.col("seq").desc()).limit(limit)


def merge_terms(history: DataFrame, current: DataFrame, max_terms: int = 10_000) -> DataFrame:
    """(term, freq): summed counts, the most frequent kept; ties by term."""
    total = history.unionByName(current).groupBy("term").agg(F.sum("freq").alias("freq"))
    return total.orderBy(F.col("freq").desc(), "term").limit(max_terms)


def weekly_lookback(weekly: DataFrame, weeks: int = 4) -> DataFrame:
    """(cluster_id, week, size, previous_mean) over the weeks before, from event data."""
    before = Window.partitionBy("cluster_id").orderBy("week").rowsBetween(-weeks, -1)
    return weekly.withColumn("previous_mean", F.avg("size").over(before))
