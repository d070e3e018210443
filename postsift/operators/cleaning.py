"""Cleaning, language tags and the prefilter's row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import estimate_tokens, joined_text, normalize_whitespace, truncate_to_tokens

# Frequent words by language, for the built-in detector.
STOP_WORDS = {
    "en": "the of and to in is that it for with as was on are this".split(),
    "fr": "le la les de des et un une est que pour dans en du au".split(),
    "de": "der die das und ist nicht ein eine zu den mit von auf im".split(),
    "es": "el los las que y en un una es por con para del se no".split(),
}


def normalize_posts(posts: DataFrame, body_chars: int = 2000) -> DataFrame:
    """White space collapsed in title and body, the body cut; every other column is kept."""
    return posts.withColumns({"title": normalize_whitespace(F.col("title")), "body": F.substring(normalize_whitespace(F.coalesce("body", F.lit(""))), 1, body_chars)})


def detect_language(text: Column, stop_words: dict[str, list[str]] = STOP_WORDS) -> Column:
    """The language whose frequent words are most of the text, the first by name among equals; null for under ten
    characters and where none occurs. A detector of another kind can be given to tag_language."""
    words = F.split(normalize_whitespace(F.lower(F.coalesce(text, F.lit("")))), " ")

    def hits(own: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(own)))

    scores = [F.struct(hits(own).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, own) in enumerate(sorted(stop_words.items()))]
    best = F.array_max(F.array(*scores))
    return F.when((F.length(F.trim(text)) >= 10) & (best["n"] > 0), best["name"])


def tag_language(posts: DataFrame, detector=detect_language) -> DataFrame:
    return posts.withColumn("lang", F.coalesce(detector(joined_text(F.col("title"), F.col("body"))), F.lit("unknown")))


def filter_languages(posts: DataFrame, allowed: list[str] | None) -> DataFrame:
    return posts.where(F.col("lang").isin(*allowed)) if allowed else posts


def filter_score(posts: DataFrame, least: int) -> DataFrame:
    return posts.where(F.coalesce("score", F.lit(0)) >= least) if least > 0 else posts


def filter_comments(posts: DataFrame, least: int) -> DataFrame:
    return posts.where(F.coalesce("comments_count", F.lit(0)) >= least) if least > 0 else posts


def filter_keywords(posts: DataFrame, keywords: list[str]) -> DataFrame:
    return posts.where(lexicon.any_keyword(F.concat_ws(" ", "title", "body"), keywords))


def filter_since(posts: DataFrame, cutoff: float) -> DataFrame:
    """Rows without a time pass."""
    return posts.where(F.col("created_ts").isNull() | (F.col("created_ts") >= cutoff))


def tag_intent(posts: DataFrame, patterns: dict[str, list[str]] = lexicon.INTENT_PATTERNS, fallback: Column | None = None) -> DataFrame:
    """Rules, then `fallback` where they find nothing, then other."""
    rule = lexicon.rule_intent(joined_text(F.col("title"), F.col("body")), patterns)
    return posts.withColumn("intent", F.coalesce(rule, *([fallback] if fallback is not None else []), F.lit("other")))


def filter_intents(posts: DataFrame, allowed: tuple[str, ...] = lexicon.WANTED_INTENTS) -> DataFrame:
    return posts.where(F.col("intent").isin(*allowed))


def enrich_wtp(posts: DataFrame, patterns: dict[str, list[str]] = lexicon.WTP_PATTERNS, examples: bool = True) -> DataFrame:
    words = joined_text(F.col("title"), F.col("body"))
    matched = posts.withColumn("_matches", lexicon.wtp_matches(words, patterns))
    return matched.withColumn("wtp_signals", lexicon.wtp_signals(F.col("_matches"), words, examples, patterns)).drop("_matches")


def filter_wtp(posts: DataFrame) -> DataFrame:
    return posts.where("wtp_signals.has_wtp")


def wtp_rate(posts: DataFrame) -> DataFrame:
    """Share of posts with a signal in percent; no posts: null."""
    return posts.agg(F.count("*").alias("posts"), F.count_if(F.col("wtp_signals.has_wtp")).alias("with_signal"), (F.avg(F.col("wtp_signals.has_wtp").cast("double")) * 100).alias("rate"))


def frequencies(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """(value, n), most frequent first, ties by value."""
    found = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return found.limit(limit) if limit else found


def fit_texts(texts: DataFrame, max_tokens: int, reserve: int = 200, least: int = 50) -> DataFrame:
    """(cluster_id, pos, text): each text of a cluster cut to its share of the prompt."""
    n = F.count("*").over(Window.partitionBy("cluster_id"))
    share = F.greatest(F.floor((F.lit(max_tokens) - reserve) / n), F.lit(least))
    return texts.withColumn("text", truncate_to_tokens(F.col("text"), share))


def token_cost(texts: DataFrame, prices: DataFrame, model: str, default: str = "gpt-4o-mini") -> DataFrame:
    """(tokens, cost_usd) of embedding all texts; an unknown model has the default's price."""
    total = texts.agg(F.coalesce(F.sum(estimate_tokens(F.col("text"))), F.lit(0)).cast("long").alias("tokens"))
    price = prices.where(F.col("model").isin(model, default)).agg(F.coalesce(F.max(F.when(F.col("model") == model, F.col("input"))), F.max(F.when(F.col("model") == default, F.col("input")))).alias("input"))
    return total.crossJoin(price).select("tokens", (F.col("tokens") / 1000.0 * F.col("input")).alias("cost_usd"))
