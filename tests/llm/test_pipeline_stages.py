"""Each stage by itself on the documents: kept rows against the decisions of its operator, and what the next one gets."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from postsift.llm import exact_dedup, mixing, near_copies, queries, toxicity

SF = "/root/testdata/sf0.001"


def decisions(spark, name, docs):
    if name == "toxicity":
        labels = spark.read.parquet(f"{SF}/labels.parquet")
        return docs.join(toxicity.toxicity(docs, labels, queries.fold(4) == 2).where("predicted = 0"), "doc_id", "left_semi")
    if name == "exact dedup":
        return docs.join(exact_dedup.exact_dedup(docs).where("kept"), "doc_id", "left_semi")
    if name == "SimHash near-dedup":
        return docs.join(near_copies.near_components(docs).where("doc_id = component_id"), "doc_id", "left_semi")
    return docs.join(mixing.mix_sources(docs).where("copies > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "copies"))), "doc_id")


@pytest.mark.parametrize("name", ["toxicity", "exact dedup", "SimHash near-dedup", "mixing sources"])
def test_kept_rows(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in decisions(spark, name, docs).select("doc_id").collect())


def test_packing_takes_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = dict(corpus_pipeline.STAGES)["packing"](spark, docs, SF)
    assert {r.doc_id for r in rows.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
