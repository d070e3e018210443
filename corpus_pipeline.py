"""A training-corpus pipeline over `documents`: five stages, each an operator of `postsift.llm`.

Every stage takes (spark, docs, sf_dir) and judges the rows its predecessor kept; all but the last return the
columns of documents. The near-dedup stage links 5-word shingle sets of similarity 0.8 or more; its candidates come from
the covering code of SimHash and, beyond its radius, from MinHash bands (`near_copies`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postsift.llm import exact_dedup, mixing, near_copies, packing, queries, toxicity
from postsift.llm.support import Tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored 0.3 or more go; labels of the held-out fold are not read."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, labels, queries.fold(4) == 2)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by similarity 0.8 of 5-word shingles the row with the smallest doc_id stays."""
    return near_copies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; documents too long for the rest of a budget do not end the draw."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: Toxicity, near copies and tokenizer ids have no SQL form; the stages are tested one by one against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Tables(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = tables.write(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            tables.drop(f"stage{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
