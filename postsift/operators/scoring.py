"""Scores of clusters, as column expressions on one row a cluster, and the aggregation that makes those rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import PAIN_KEYWORDS, keyword_count
from ..functions.text import half_even

# Default weights of the priority.
WEIGHTS = {"pain": 0.30, "traction": 0.25, "novelty": 0.15, "wtp": 0.20, "trend": 0.10}

# Phrases of a strong and of a moderate signal.
STRONG_WTP = ["currently paying", "willing to pay", "would pay", "subscription"]
MODERATE_WTP = ["expensive", "cost", "price", "budget"]


def _clamped(x: Column) -> Column:
    """Null stays null, which greatest and least pass over."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(10.0), x)))


def cluster_stats(posts: DataFrame, keywords: list[str] = PAIN_KEYWORDS) -> DataFrame:
    """One row a cluster: size, first_pos, avg/max of score and comments, avg_keywords, source_mix. One shuffle."""
    score, comments = F.coalesce(F.col("score"), F.lit(0)).cast("double"), F.coalesce(F.col("comments_count"), F.lit(0)).cast("double")
    return posts.groupBy("cluster_id").agg(
        F.count("*").alias("size"), F.min("pos").alias("first_pos"), F.avg(score).alias("avg_score"), F.avg(comments).alias("avg_comments"), F.max(score).alias("max_score"), F.max(comments).alias("max_comments"),
        F.avg(keyword_count(F.col("title"), keywords).cast("double")).alias("avg_keywords"), F.array_sort(F.collect_set("source")).alias("source_mix"),
    )


def heuristic_pain() -> Column:
    total = F.least(F.col("avg_score") / 10, F.lit(5.0)) + F.least(F.col("avg_comments") / 7, F.lit(3.0)) + F.least(F.col("avg_keywords") * 2, F.lit(2.0))
    return _clamped(half_even(total)).cast("int")


def traction() -> Column:
    total = F.least(F.col("avg_score") / 10, F.lit(5.0)) + F.least(F.col("avg_comments") / 4, F.lit(5.0))
    return half_even(F.least(total, F.lit(10.0)), 1)


def traction_v1() -> Column:
    peak = F.least(F.col("max_score") / 100 + F.col("max_comments") / 100, F.lit(3.0))
    size = F.when(F.col("size") >= 3, F.least((F.col("size") - 2) / 9, F.lit(2.0))).otherwise(0.0)
    return _clamped(F.least(F.col("avg_score") / 33.3, F.lit(3.0)) + F.least(F.col("avg_comments") / 25, F.lit(2.0)) + peak + size)


def novelty(alternatives: Column, size: Column) -> Column:
    n = F.coalesce(F.when(alternatives.isNotNull(), F.size(alternatives)), F.lit(0))
    bonus = F.when(n == 0, 4.0).when(n == 1, 2.0).when(n == 2, 1.0).otherwise(-1.0)
    crowd = F.when(size > 20, -2.0).when(size > 10, -1.0).otherwise(1.0)
    return half_even(_clamped(5.0 + bonus + crowd), 1)


def novelty_v1(alternatives: Column, signal: Column) -> Column:
    n = F.coalesce(F.when(alternatives.isNotNull(), F.size(alternatives)), F.lit(0))
    lowered = F.lower(F.coalesce(signal, F.lit("")))
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in words])
    market = F.when(n == 0, 6.0).when(n <= 2, 5.0).when(n <= 5, 3.0).otherwise(1.0)
    return _clamped(market + F.when(has(STRONG_WTP), 4.0).when(has(MODERATE_WTP), 2.0).when(lowered != "", 1.0).otherwise(0.0))


def source_bonus(sources: Column) -> Column:
    n = F.size(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    return F.when(n >= 3, 1.2).when(n == 2, 1.1).otherwise(1.0)


def priority_v1(pain_llm: Column, heuristic: Column, traction_score: Column, novelty_score: Column, sources: Column) -> Column:
    base = 0.45 * F.coalesce(pain_llm.cast("double"), F.lit(5.0)) + 0.25 * heuristic + 0.20 * traction_score + 0.10 * novelty_score
    return half_even(base * source_bonus(sources), 2)


def priority(pain_llm: Column, heuristic: Column, traction_score: Column, novelty_score: Column, wtp: Column | float = 0.0, trend: Column | float = 5.0, weights: dict[str, float] = WEIGHTS) -> Column:
    """Weights need not sum to 1; a sum of 0 counts as 1."""
    total = reduce(lambda a, b: a + b, weights.values()) or 1.0  # left to right; sum() compensates
    pain = pain_llm * 0.7 + heuristic * 0.3
    parts = {"pain": pain, "traction": traction_score, "novelty": novelty_score, "wtp": wtp, "trend": trend}
    value = reduce(lambda a, b: a + b, [parts[k] * F.lit(w / total) for k, w in weights.items()])
    return half_even(F.least(value, F.lit(10.0)), 2)


def combined_pain(llm: Column, heuristic: Column, weight: float = 0.6) -> Column:
    return F.coalesce(half_even(weight * llm + (1 - weight) * heuristic), heuristic).cast("int")


def final_pain(llm: Column, heuristic: Column) -> Column:
    """Cut, not rounded; a missing or zero model score counts as 5."""
    return (F.coalesce(F.nullif(llm.cast("double"), F.lit(0.0)), F.lit(5.0)) * 0.7 + heuristic * 0.3).cast("int")


def recency(posts: DataFrame, now: float, window_days: float = 7.0) -> DataFrame:
    """(cluster_id, recency): mean freshness x 10; no times: 5. Times after `now` are fresh."""
    age = (F.lit(now) - F.col("created_ts")) / 86400.0
    fresh = F.when(F.col("created_ts").isNotNull(), F.greatest(F.lit(0.0), 1 - F.greatest(age, F.lit(0.0)) / window_days))
    mean = posts.groupBy("cluster_id").agg(F.avg(fresh).alias("fresh"))
    return mean.select("cluster_id", F.coalesce(half_even(F.col("fresh") * 10, 1), F.lit(5.0)).alias("recency"))


def trend_growth(sizes: DataFrame, history: DataFrame, weeks: int = 4) -> DataFrame:
    """(cluster_id, trend) of `sizes` (cluster_id, size) against `history` (week_offset, cluster_id, size).

    The mean is over the weeks that exist, a cluster missing from one counting 0; no weeks: 5. From a mean of 0
    the growth is 2.
    """
    recent = history.where(F.col("week_offset").between(1, weeks))
    n = recent.agg(F.count_distinct("week_offset").alias("weeks"))  # one row
    sums = recent.groupBy(F.col("cluster_id").alias("h_id")).agg(F.sum("size").alias("past"))
    joined = sizes.join(sums, sizes["cluster_id"] == F.col("h_id"), "left").crossJoin(F.broadcast(n))
    mean = F.try_divide(F.coalesce("past", F.lit(0)).cast("double"), F.col("weeks"))
    growth = F.when(mean == 0, 2.0).otherwise(F.try_divide(F.col("size") - mean, mean))
    score = half_even(10 / (1 + F.exp(-2 * growth)), 1)
    return joined.select("cluster_id", F.when(F.col("weeks") == 0, 5.0).otherwise(score).alias("trend"))


def hybrid_trend(llm: Column, historical: Column) -> Column:
    """Model and history 7 : 3, the history at least 1; without a model score the history alone."""
    return F.coalesce(half_even(0.7 * llm + 0.3 * F.greatest(historical, F.lit(1.0)), 1), historical)


def term_counts(posts: DataFrame) -> DataFrame:
    """(cluster_id, term, n, first_at): terms of title and body, lower-cased, of over three characters."""
    from ..functions.text import terms

    words = F.concat(terms(F.col("title")), terms(F.col("body")))
    each = posts.select("cluster_id", "pos", F.posexplode(words).alias("at", "term"))
    # One number orders by pos, then at: rows of numbers are added up in a hash table, a struct would have all words sorted.
    place = F.col("pos").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("at").cast("decimal(10,0)")
    return each.groupBy("cluster_id", "term").agg(F.count("*").alias("n"), F.min(place).alias("first_at"))


def term_novelty(clusters: DataFrame, counts: DataFrame, history: DataFrame, top: int = 20) -> DataFrame:
    """(cluster_id, novelty): rarity in `history` (term, freq) of a cluster's most frequent terms; no terms: 5."""
    from pyspark.sql import Window

    order = Window.partitionBy("cluster_id").orderBy(F.col("n").desc(), "first_at")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = history.agg(F.coalesce(F.nullif(F.sum("freq"), F.lit(0)), F.lit(1)).alias("total"))
    rarity = 1 / (1 + F.coalesce("freq", F.lit(0)) / F.col("total") * 1000)
    means = best.join(history, "term", "left").crossJoin(F.broadcast(total)).groupBy("cluster_id").agg(F.avg(rarity).alias("rarity"))
    return clusters.select("cluster_id").join(means, "cluster_id", "left").select("cluster_id", F.coalesce(half_even(_clamped(F.col("rarity") * 10), 1), F.lit(5.0)).alias("novelty"))
