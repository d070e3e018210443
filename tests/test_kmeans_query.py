from pyspark.sql import functions as F

from postsift.operators import vectors
from postsift.plans import queries


def test_query_is_the_whole_job(spark, monkeypatch):
    """The registered query runs the operator's own number of seeds and iterations."""
    asked = []

    def fit(rows, k=10, seed=42, tries=10, iterations=300):
        asked.append((k, tries, iterations))
        return rows.withColumn("cluster_id", F.lit(0))

    assert vectors.cluster.__defaults__ == fit.__defaults__
    monkeypatch.setattr(vectors, "cluster", fit)
    queries.QUERIES["kmeans"](spark, "/root/testdata/sf0.001").collect()
    assert asked == [(10, 10, 300)]
