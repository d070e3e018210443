"""The operators as queries over their whole tables, in the digest form of their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clusters, exact_dedup, html_extract, importance, language_id, lm_scoring, mixing, packing, quality, simhash, substring_dedup, topk, toxicity


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def fold(n: int) -> Column:
    """The contract's fold of a document: crc32 of its id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_passages(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_table(spark, sf_dir, "documents"), fold(5) == 0)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold(4) == 2)


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.centroid_clusters(_table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_neardup,
        op2_substring_dedup,
        op3_mixing,
        op4_html_extract,
        op5_exact_dedup,
        op6_packing,
        op7_language_id,
        op8_lm_scoring,
        op9_toxicity,
        op10_topk_search,
        op11_importance_resampling,
        op12_centroid_clustering,
        op13_quality_rules,
    )
}
#: The others (fingerprints by XXH64, DOM alignment, tokenizer ids, trained models) have no SQL form.
ORACLE_SQL = {
    "op2_substring_dedup": substring_dedup.SQL,
    "op3_mixing": mixing.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op8_lm_scoring": lm_scoring.SQL,
    "op10_topk_search": topk.SQL,
    "op11_importance_resampling": importance.SQL,
    "op12_centroid_clustering": centroid_clusters.SQL,
    "op13_quality_rules": quality.SQL,
}
