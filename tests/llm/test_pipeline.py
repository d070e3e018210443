import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from postsift.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_by_their_operators(spark, tmp_path):
    """Each stage against the query of its operator on the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing sources", "packing"]
    from postsift.llm import exact_dedup, mixing, near_copies, toxicity

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {
        "toxicity": lambda d: d.join(toxicity.toxicity(d, labels, queries.fold(4) == 2).where("predicted = 0"), "doc_id", "left_semi"),
        "exact dedup": lambda d: d.join(exact_dedup.exact_dedup(d).where("kept"), "doc_id", "left_semi"),
        "SimHash near-dedup": lambda d: d.join(near_copies.near_components(d).where("doc_id = component_id"), "doc_id", "left_semi"),
        "mixing sources": lambda d: d.join(mixing.mix_sources(d).where("copies > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "copies"))), "doc_id"),
    }
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if name != "packing":
            assert out.columns == docs.columns
            want = sorted(r.doc_id for r in kept[name](docs).collect())
            assert sorted(r.doc_id for r in out.collect()) == want
        else:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
        docs = out
    assert docs.count() > 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert set(rows.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert rows.count() > 0


@pytest.mark.parametrize("stage", range(5))
def test_stage_on_an_empty_table(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, SF).count() == 0
