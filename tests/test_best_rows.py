"""Nearest rows by matrix products have the distances and ties of sums in order."""

import numpy as np

from postsift.operators import vectors


def test_ties_and_exact_distances():
    rng = np.random.default_rng(3)
    e = rng.integers(0, 3, (300, 4)).astype(float) / 3
    q, ids = e[:20] + 0.1, np.arange(300)[::-1]
    at, row, distance = vectors.best_rows(q, e, ids, 7)
    for i in range(len(q)):
        want = sorted((float(vectors.exact_distances(q[i : i + 1], e[j : j + 1])[0]), int(ids[j])) for j in range(300))[:7]
        assert list(zip(distance[at == i].tolist(), ids[row[at == i]].tolist())) == want


def test_nulls_widths_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 3)
    rows = [(i, [float(i % 4), float(i // 4)]) for i in range(17)] + [(90, None), (91, [1.0]), (92, [1.0, None])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = df.where("id < 5 or id = 91").withColumnRenamed("id", "query_id")
    found = {(r.query_id, r["rank"], r.id) for r in vectors.nearest(queries, df, 2).collect()}
    want = {(91, 1, 91)}
    for n, v in rows[:5]:
        best = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, w in rows[:17])[:2]
        want |= {(n, r + 1, i) for r, (_, i) in enumerate(best)}
    assert found == want
