"""Schemas of posts, insights and stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCES = ("reddit", "hn", "rss", "x", "ph", "se", "appstore", "play")

POST = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("source", T.StringType()),
    T.StructField("title", T.StringType(), False),
    T.StructField("body", T.StringType()),
    T.StructField("created_ts", T.DoubleType()),
    T.StructField("url", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("comments_count", T.LongType()),
    T.StructField("lang", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("raw", T.StringType()),
])

#: Older names of fields, read where the current one is missing.
ALIASES = {"body": "selftext", "created_ts": "created_utc", "url": "permalink", "comments_count": "num_comments"}

EXAMPLE = T.StructType([T.StructField(n, t) for n, t in [("id", T.StringType()), ("url", T.StringType()), ("title", T.StringType()), ("score", T.LongType()), ("comments_count", T.LongType()), ("source", T.StringType())]])

SUMMARY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "problem", "persona", "jtbd", "context")]
    + [T.StructField("monetizable", T.BooleanType()), T.StructField("mvp", T.StringType()), T.StructField("alternatives", T.ArrayType(T.StringType())), T.StructField("willingness_to_pay_signal", T.StringType()), T.StructField("pain_score_llm", T.IntegerType()), T.StructField("sector", T.StringType())]
)

RUNS = "id string, created_at timestamp, config_name string, mode string, nb_insights int, nb_clusters int, total_cost_usd double, embed_cost_usd double, summary_cost_usd double, csv_path string, json_path string, notes string"
INSIGHTS = (
    "id string, run_id string, rank int, mmr_rank int, cluster_id int, size int, sector string, title string, problem string, persona string, jtbd string, context string, mvp string, "
    "alternatives array<string>, willingness_to_pay_signal string, monetizable int, pain_score_llm double, pain_score_final double, heuristic_score double, traction_score double, novelty_score double, "
    "trend_score double, founder_fit_score double, priority_score double, priority_score_adjusted double, keywords_matched array<string>, source_mix array<string>, example_urls array<string>, created_at timestamp"
)
EXPLORATIONS = "id long, insight_id string, created_at timestamp, model_used string, exploration_text string, monetization_hypotheses array<string>, product_variants array<string>, validation_steps array<string>"


def as_posts(df: DataFrame) -> DataFrame:
    """`df` in the POST schema plus `pos`, if it has it: aliases coalesced, missing columns null, defaults filled."""
    have = {c.lower() for c in df.columns}

    def value(field: T.StructField) -> Column:
        names = [n for n in (field.name, ALIASES.get(field.name)) if n and n in have]
        if field.name == "raw" and "raw" in have and not isinstance(df.schema["raw"].dataType, T.StringType):
            return F.to_json("raw")
        return F.coalesce(*[F.col(n).cast(field.dataType) for n in names]) if names else F.lit(None).cast(field.dataType)

    defaults = {"source": F.lit("reddit"), "body": F.lit(""), "score": F.lit(0), "comments_count": F.lit(0)}
    columns = [(F.coalesce(value(f), defaults[f.name]) if f.name in defaults else value(f)).cast(f.dataType).alias(f.name) for f in POST]
    return df.select(*columns, *(["pos"] if "pos" in have else []))


def valid_post(df: DataFrame) -> Column:
    """Rows that a strict reader accepts."""
    return F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("source").isin(*SOURCES)
