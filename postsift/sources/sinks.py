"""Sinks: CSV and JSON forms of insights. Every writer is a distributed Spark write into a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    out = df.write.mode("overwrite")
    (out.partitionBy(partition_by) if partition_by else out).json(path)


def write_dumps(posts: DataFrame, folder: str, stamp: str) -> None:
    """Raw posts, one folder a source: `dump=posts_<source>_<stamp>.json`."""
    write_json(posts.withColumn("dump", F.concat(F.lit("posts_"), "source", F.lit(f"_{stamp}.json"))), folder, "dump")


def _joined(names: str, separator: str = ", ") -> Column:
    return F.array_join(F.filter(F.coalesce(F.col(names), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), separator)


def _blank_zero(column: Column, text: Column) -> Column:
    """Null and zero print as nothing."""
    return F.when(column.isNull() | (column == 0), F.lit("")).otherwise(text)


def _fixed(name: str, digits: int) -> Column:
    return _blank_zero(F.col(name), F.format_string(f"%.{digits}f", F.col(name).cast("double")))


def _whole(name: str) -> Column:
    return _blank_zero(F.col(name), F.col(name).cast("string"))


def _urls(separator: str, drop_empty: bool) -> Column:
    urls = F.transform(F.slice(F.col("examples"), 1, 3), lambda e: F.coalesce(e["url"], F.lit("")))
    return F.array_join(F.filter(urls, lambda u: u != "") if drop_empty else urls, separator)


def insights_csv(insights: DataFrame) -> DataFrame:
    """The 26 columns of the export, as text."""
    text = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n)
    return insights.select(
        text("rank"), _whole("mmr_rank").alias("mmr_rank"), F.format_string("%.2f", "priority_score").alias("priority_score"), _fixed("priority_score_adjusted", 2).alias("priority_score_adjusted"),
        text("cluster_id"), text("size"), text("sector"), text("title"), text("problem"), text("persona"), text("jtbd"), text("context"),
        F.when(F.col("monetizable"), "Yes").otherwise("No").alias("monetizable"), text("mvp"), _joined("alternatives").alias("alternatives"), text("willingness_to_pay_signal"),
        _whole("pain_score_llm").alias("pain_score_llm"), _whole("pain_score_final").alias("pain_score_final"),
        *[_fixed(n, 1).alias(n) for n in ("heuristic_score", "traction_score", "novelty_score", "trend_score", "founder_fit_score")],
        _urls(", ", True).alias("example_urls"), _joined("source_mix").alias("source_mix"), _joined("keywords_matched").alias("keywords_matched"),
    )


def enriched_csv(insights: DataFrame) -> DataFrame:
    """The 23 columns of the enriched export."""
    plain = lambda n: F.col(n).cast("string").alias(n)
    return insights.select(
        plain("rank"), plain("cluster_id"), plain("size"), plain("priority_score"), plain("title"), plain("problem"), plain("persona"), plain("jtbd"), plain("context"),
        F.initcap(F.col("monetizable").cast("string")).alias("monetizable"), plain("mvp"), F.array_join("alternatives", ", ").alias("alternatives"), plain("willingness_to_pay_signal"),
        *[_whole(n).alias(n) for n in ("pain_score_llm", "pain_score_final", "heuristic_score", "traction_score", "novelty_score", "trend_score", "founder_fit_score")],
        F.array_join("keywords_matched", ", ").alias("keywords_matched"), F.array_join("source_mix", ", ").alias("source_mix"), _urls(" | ", False).alias("example_urls"),
    )


def legacy_csv(insights: DataFrame) -> DataFrame:
    """The 11 columns of the first export; its source is always reddit."""
    return insights.select(
        "cluster_id", "size", "title", F.col("problem").alias("description"), F.initcap(F.col("monetizable").cast("string")).alias("monetizable"),
        F.concat(F.lit("Persona: "), "persona", F.lit(". Context: "), "context").alias("justification"), "mvp", _whole("pain_score_llm").alias("pain_score_llm"), _whole("pain_score_final").alias("pain_score_final"),
        _urls(" | ", False).alias("example_urls"), F.lit("reddit").alias("source"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Rows in rank order in one file: insights are one a cluster."""
    ordered = df.orderBy(F.col("rank").try_cast("int")) if "rank" in df.columns else df
    ordered.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


_SUMMARY = ("title", "problem", "persona", "jtbd", "context", "monetizable", "mvp", "alternatives", "willingness_to_pay_signal", "pain_score_llm", "size")
_SCORES = ("pain_score_final", "heuristic_score", "traction_score", "novelty_score", "trend_score", "founder_fit_score", "keywords_matched", "source_mix", "examples")


def insight_documents(insights: DataFrame) -> DataFrame:
    """(rank, document): an insight as nested JSON."""
    return insights.select("rank", F.to_json(F.struct("cluster_id", "rank", "priority_score", F.struct(*_SUMMARY).alias("summary"), *_SCORES)).alias("document"))


def legacy_documents(insights: DataFrame) -> DataFrame:
    summary = F.struct("title", F.col("problem").alias("description"), "monetizable", F.concat(F.lit("Persona: "), "persona", F.lit(". Context: "), "context").alias("justification"), "mvp", "pain_score_llm", "size")
    return insights.select("rank", F.to_json(F.struct("cluster_id", summary.alias("summary"), "pain_score_final", "examples")).alias("document"))


def results_document(documents: DataFrame, stats: DataFrame) -> DataFrame:
    """(value): one JSON text {statistics, insights[]}; insights are one a cluster, so they fit one row."""
    listed = documents.agg(F.array_sort(F.collect_list(F.struct("rank", "document"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["document"]), ",")
    return listed.crossJoin(F.broadcast(stats.select(F.to_json(F.struct("*")).alias("stats")).limit(1))).select(F.concat(F.lit('{"statistics":'), "stats", F.lit(',"insights":['), body, F.lit("]}")).alias("value"))


def summary_json(insights: DataFrame) -> DataFrame:
    """The eight fields of the run summary, in rank order."""
    return insights.select("rank", "mmr_rank", "title", "sector", "priority_score", "priority_score_adjusted", "trend_score", "founder_fit_score").orderBy("rank")


def save_embeddings(df: DataFrame, path: str) -> None:
    df.select("id", "embedding").write.mode("overwrite").parquet(f"{path}/embeddings")
    df.select("id", "url", "score", "comments_count", "title", "source").write.mode("overwrite").parquet(f"{path}/meta")
