"""The engine's plans: prefilter, collect and scan, from posts to ranked, diversified insights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import wtp_score
from ..functions.text import half_even, post_text, truncate_to_tokens
from ..operators import cleaning, dedupe, ranking, scoring, vectors
from ..tables import Tables, spread
from . import providers


@dataclass(frozen=True)
class Settings:
    """Defaults of a run."""

    clusters: int = 10
    docs_per_cluster: int = 6
    input_tokens: int = 1200
    output_tokens: int = 400
    heavy_top_k: int = 5
    retention_days: int = 30
    penalty_factor: float = 0.3
    mmr_weight: float = 0.7
    mmr_k: int = 10
    per_sector: int = 2
    cost_warning_usd: float = 0.50


# USD for 1,000 tokens in and out.
PRICES = {
    "gpt-4o-mini": (0.00015, 0.0006),
    "gpt-4o": (0.0025, 0.01),
    "gpt-3.5-turbo": (0.0005, 0.0015),
    "text-embedding-3-small": (0.00002, 0.0),
    "text-embedding-3-large": (0.00013, 0.0),
}


def prefilter(posts: DataFrame, languages: list[str] | None = None, intents: tuple[str, ...] | None = None, with_signal: bool = False) -> DataFrame:
    """Language, intent and willingness-to-pay tags, then the filters asked for. One pass over enough partitions."""
    tagged = cleaning.filter_languages(cleaning.tag_language(spread(posts)), languages)
    tagged = cleaning.tag_intent(tagged)
    if intents:
        tagged = cleaning.filter_intents(tagged, intents)
    tagged = cleaning.enrich_wtp(tagged)
    return cleaning.filter_wtp(tagged) if with_signal else tagged


def collect_all(posts: DataFrame, languages: list[str] | None, intents: tuple[str, ...] | None, min_score: int, min_comments: int, history: DataFrame | None = None) -> DataFrame:
    """The collection's chain on the union of its sources: language, intent, score, comments, dedupe."""
    kept = cleaning.filter_comments(cleaning.filter_score(spread(posts), min_score), min_comments)  # numbers before texts
    kept = cleaning.filter_languages(cleaning.tag_language(kept), languages)
    kept = cleaning.tag_intent(kept)
    kept = cleaning.filter_intents(kept, intents) if intents else kept
    return dedupe.greedy_dedupe(kept, history, source=posts, made=("lang", "intent"))


def clean_run(posts: DataFrame) -> DataFrame:
    """What the batch run does before it embeds: clean and dedupe."""
    return dedupe.greedy_dedupe(cleaning.normalize_posts(posts))


def estimate(posts: DataFrame, prices: DataFrame, settings: Settings = Settings(), embed_model: str = "text-embedding-3-small", model: str = "gpt-4o-mini") -> DataFrame:
    """One row: posts, embedding tokens and the costs of embedding and of summaries of all clusters."""
    text = posts.select(post_text(F.col("title"), F.col("body")).alias("text"))
    embed = cleaning.token_cost(text, prices, embed_model).withColumnsRenamed({"tokens": "embed_tokens", "cost_usd": "embed_cost_usd"})
    price = prices.where(F.col("model") == model).select((settings.clusters * (settings.input_tokens / 1000.0 * F.col("input") + settings.output_tokens / 1000.0 * F.col("output"))).alias("summary_cost_usd"))
    return embed.crossJoin(price).withColumn("total_cost_usd", F.col("embed_cost_usd") + F.col("summary_cost_usd"))


class Steps:
    """Counts the rows of a plan's steps as they pass: nothing is run again to be counted."""

    def __init__(self):
        self._seen: list[Observation] = []

    def seen(self, rows: DataFrame, **steps: Column | None) -> DataFrame:
        """`rows`, observed: each step counts those that meet its condition, or all."""
        self._seen.append(Observation())
        return rows.observe(self._seen[-1], *[(F.count(F.lit(1)) if c is None else F.count_if(c)).alias(name) for name, c in steps.items()])

    def counts(self) -> dict[str, int]:
        """By step, after an action on what `seen` returned; waits for one that runs."""
        return {name: n for one in self._seen for name, n in one.get.items()}


def statistics(spark: SparkSession, counts: dict[str, int], embed_cost: float, summary_cost: float, weights: dict[str, float] = scoring.WEIGHTS) -> DataFrame:
    """One row about a run: rows after each step, costs to four digits, and the weights of the priority."""
    costs = {"embeddings_cost_usd": embed_cost, "summary_cost_usd": summary_cost, "total_cost_usd": embed_cost + summary_cost}
    row = [F.lit(n).cast("long").alias(k) for k, n in counts.items()] + [F.lit(round(v, 4)).alias(k) for k, v in costs.items()]
    return spark.range(1).select(*row, F.struct(*[F.lit(w).alias(k) for k, w in weights.items()]).alias("priority_weights"))


def score_clusters(posts: DataFrame, summary: DataFrame, trends: DataFrame | None = None, fits: DataFrame | None = None, sectors: DataFrame | None = None) -> DataFrame:
    """One row a cluster with every score. `posts` has cluster_id, pos and wtp_signals; `summary` one row a cluster."""
    stats = scoring.cluster_stats(posts)
    wtp = posts.groupBy("cluster_id").agg(half_even(F.avg(wtp_score(F.col("wtp_signals"))), 1).alias("wtp_score"))
    rows = stats.join(summary, "cluster_id").join(wtp, "cluster_id")
    for extra, column, default in ((trends, "trend_score", 5.0), (fits, "founder_fit_score", 5.0), (sectors, "sector", "other")):
        rows = rows.drop(column) if column in rows.columns else rows
        rows = rows.join(extra.select("cluster_id", column), "cluster_id", "left") if extra is not None else rows.withColumn(column, F.lit(None).cast("string" if column == "sector" else "double"))
        rows = rows.withColumn(column, F.coalesce(column, F.lit(default)))
    rows = rows.withColumns({"heuristic_score": scoring.heuristic_pain().cast("double"), "traction_score": scoring.traction(), "novelty_score": scoring.novelty(F.col("alternatives"), F.col("size"))})
    llm = F.coalesce(F.nullif(F.col("pain_score_llm").cast("double"), F.lit(0.0)), F.lit(5.0))
    return rows.withColumns({
        "priority_score": scoring.priority(llm, F.col("heuristic_score"), F.col("traction_score"), F.col("novelty_score"), F.col("wtp_score"), F.col("trend_score")),
        "pain_score_final": scoring.final_pain(F.col("pain_score_llm"), F.col("heuristic_score")),
    })


def summarize(posts: DataFrame, clusters: DataFrame, settings: Settings, heavy: providers.Complete, light: providers.Complete) -> DataFrame:
    """(cluster_id, summary fields): the first clusters by heuristic go to the heavy model, the rest to the light one."""
    shown = ranking.firsts(posts.select("cluster_id", "pos", post_text(F.col("title"), F.col("body")).alias("text")), "cluster_id", settings.docs_per_cluster)
    cut = cleaning.fit_texts(shown, settings.input_tokens)
    texts = cut.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_t")).withColumn("texts", F.transform("_t", lambda t: t["text"])).drop("_t")
    asked = clusters.select("cluster_id", "tier").join(texts, "cluster_id").withColumn("prompt", providers.prompt(F.col("texts"), "Summarise the problem that these posts share.")).drop("texts")
    answers = providers.complete(asked.where("tier = 'heavy'"), "prompt", heavy).union(providers.complete(asked.where("tier = 'light'"), "prompt", light))
    return providers.summaries(answers)


def scan(posts: DataFrame, settings: Settings = Settings(), heavy: providers.Complete = providers.extractive_stub, light: providers.Complete = providers.extractive_stub, history: DataFrame | None = None, diversify: bool = True, max_insights: int | None = None) -> DataFrame:
    """Insights of `posts` (POST schema and pos), ranked. `history` is (vector) of past centroids."""
    embedded = posts if "embedding" in posts.columns else vectors.embed_posts(posts)
    clustered = embedded if "cluster_id" in posts.columns else vectors.cluster(embedded, settings.clusters)
    tagged = Tables(posts.sparkSession, "scan").write(cleaning.enrich_wtp(spread(clustered), examples=False), "tagged")  # read by several plans below
    ordered = ranking.tiers(scoring.cluster_stats(tagged).withColumn("heuristic_score", scoring.heuristic_pain()), settings.heavy_top_k)
    scored = score_clusters(tagged, summarize(tagged, ordered, settings, heavy, light))
    insights = scored.join(vectors.centroids(tagged).select("cluster_id", F.col("centroid").alias("embedding")), "cluster_id").join(ranking.examples(tagged), "cluster_id")
    if history is not None:
        insights = vectors.penalized(insights, history, settings.penalty_factor, vector="embedding")
    else:
        insights = insights.withColumn("priority_score_adjusted", F.col("priority_score"))
    insights = insights.withColumn("keywords_matched", F.array().cast("array<string>"))
    if diversify:
        insights = ranking.mmr_by_sector(insights, settings.per_sector, settings.mmr_weight, "priority_score_adjusted")
        out = insights.withColumn("rank", F.col("mmr_rank"))
    else:
        out = ranking.rank_by(insights, "priority_score_adjusted").withColumn("mmr_rank", F.lit(None).cast("int"))
    return out.where(F.col("rank") <= max_insights) if max_insights else out
