import corpus_pipeline
from pyspark.sql import functions as F

from postsift.llm import mixing


def lone_giant(spark):
    """Source c: half of its words in one document that is longer than the source's target of 25,000."""
    rows = [(i, 100, "c") for i in range(300)] + [(20_000, 30_000, "c")] + [(1_000 + i, 100, "a") for i in range(1000)] + [(3_000 + i, 100, "b") for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, words int, source string").select("doc_id", F.repeat(F.lit("w "), F.col("words")).alias("text"), "source")


def taken(rows):
    by = {}
    for r in rows:
        by[r.source] = by.get(r.source, 0) + r["size"]
    return by


def test_a_giant_does_not_end_the_draw(spark):
    for shift in range(3):  # other ids are other draws
        docs = lone_giant(spark).withColumn("doc_id", F.col("doc_id") + 50_000 * shift)
        targets = {r.source: r.target for r in mixing.mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").select("source", "target").distinct().collect()}
        out = corpus_pipeline.mix_sources(spark, docs, "").withColumn("size", F.regexp_count("text", F.lit("w")))
        got = taken(out.collect())
        assert all(abs(got[s] - t) <= 100 for s, t in targets.items())
