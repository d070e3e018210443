"""k-means: all starts in one pass, against a plain loop; embeddings against the formula; chunks in turn."""

import math
import re

import numpy as np
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from postsift.operators import vectors


def plain(data, sample, k, seed, tries, iterations, tolerance=1e-4):
    best = None
    for i in range(tries):
        centres = vectors.start_centres(sample, k, seed + i)
        for turn in range(iterations + 1):
            far = ((data[:, None, :] - centres[None]) ** 2).sum(2)
            near, cost = far.argmin(1), far.min(1).sum()
            moved = np.array([data[near == c].mean(0) if (near == c).any() else centres[c] for c in range(k)])
            if turn == iterations or ((moved - centres) ** 2).sum() <= tolerance * sample.var(0).mean():
                break
            centres = moved
        if best is None or cost < best[1]:
            best = centres, cost
    return best


def test_centres_and_cost_equal_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    data = np.concatenate([rng.normal(c, 0.6, (60, 3)) for c in range(0, 10, 2)])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(999, None)], "id long, embedding array<double>").repartition(5)
    order = [r.embedding for r in frame.where("embedding is not null").orderBy(F.xxhash64("embedding"), "embedding").collect()]
    for tries, iterations in ((1, 3), (4, 300), (3, 0)):
        want = plain(data, np.array(order), 5, 7, tries, iterations)
        centres, cost = vectors.fit_clusters(frame, 5, 7, tries, iterations)
        assert np.allclose(centres, want[0]) and math.isclose(cost, want[1], rel_tol=1e-9)
    rows = {r.id: r.cluster_id for r in vectors.cluster(frame, 5, 7, 4).collect()}
    centres = plain(data, np.array(order), 5, 7, 4, 300)[0]
    assert rows.pop(999) is None
    assert rows == {i: int(((v - centres) ** 2).sum(1).argmin()) for i, v in enumerate(data)}


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame([(1, [0.0]), (2, [5.0]), (3, [5.0])], "id long, embedding array<float>")
    found = {r.id: r.cluster_id for r in vectors.cluster(frame, 10).collect()}
    assert found[2] == found[3] != found[1]
    assert vectors.cluster(frame.limit(0)).count() == 0
    assert [r.cluster_id for r in vectors.cluster(frame.select("id", F.lit(None).cast("array<float>").alias("embedding"))).collect()] == [None] * 3


def test_embeddings_are_the_formula(spark):
    texts = ["alpha beta beta", "beta gamma", "", "delta alpha epsilon zeta"]
    frame = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "id int, title string, body string")
    at = HashingTF(numFeatures=32, inputCol="a", outputCol="b").indexOf
    words = [re.findall(r"\S+", t) for t in texts]
    own = [{at(w) for w in ws} for ws in words]
    idf = [math.log((len(texts) + 1) / (sum(b in o for o in own) + 1)) for b in range(32)]
    found = {r.id: r.embedding for r in vectors.embed_posts(frame, 32).collect()}
    for i, ws in enumerate(words):
        if not ws:
            continue
        v = np.zeros(32)
        for w in ws:
            v[at(w)] += idf[at(w)]
        length = np.linalg.norm(v)
        assert np.allclose(found[i], v / length if length else v, atol=1e-6)


def test_chunks_run_in_turn(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(40)], "id long, embedding array<double>")
    queries = rows.withColumnRenamed("id", "query_id")
    items = rows.select(F.col("id").alias("cluster_id"), F.col("embedding").alias("centroid"))
    past = rows.where("id % 3 = 0").select(F.col("embedding").alias("vector"))

    def both():
        return sorted(map(tuple, vectors.nearest(queries, rows, 2).collect())), sorted(map(tuple, vectors.max_similarity(items, past).collect()))

    whole = both()
    monkeypatch.setattr(vectors, "CHUNK_ROWS", 7)
    assert both() == whole
