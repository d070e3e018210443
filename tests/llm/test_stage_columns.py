"""Stages on tables whose columns have the names that the stages use inside, with repeated rows and null ids."""

import pytest
from pyspark.sql import functions as F

from postsift.llm import exact_dedup, mixing, near_copies, simhash

NAMES = ["id", "sha", "kept", "nth", "t_id", "t_sha", "ID_", "key", "copies", "rows", "n", "_own", "_nth", "_id", "_sha", "_rows", "_copies", "row", "salt", "block"]
ROWS = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (3, "seven eight"), (None, "nine ten"), (None, None), (4, ""), (5, "w " * 400)]


@pytest.mark.parametrize("stage, left", [(exact_dedup.drop_exact_copies, [None, 1, 3, 4, 5]), (near_copies.drop_near_copies, [None, None, 1, 3, 4, 5]), (simhash.drop_near_copies, [None, None, 1, 3, 4, 5])])
def test_clashing_columns(spark, stage, left):
    docs = spark.createDataFrame([(*r, "a") for r in ROWS], "doc_id long, text string, source string").withColumns({n: F.lit("x") for n in NAMES}).withColumn("a map", F.create_map(F.lit(1), F.lit(2)))
    out = stage(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=lambda x: (x is not None, x)) == left


def test_mixing_with_clashing_columns(spark):
    docs = spark.createDataFrame([(*r, "a") for r in ROWS], "doc_id long, text string, source string").withColumns({n: F.lit("x") for n in NAMES})
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(docs).where("text <> ''").count() > 0
