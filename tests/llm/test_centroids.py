"""Centroid clustering against a loop over Python integers."""

import hashlib
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from postsift.llm import centroid_clusters as cc

TOP = 2**63 - 1


def plain(rows, k, rounds, width, scale, seed):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    whole = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in sorted(kept, key=mark)]
    centres = [v for _, v in whole[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, v in whole:
            groups[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centres, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in whole]
    own = Counter()
    for _, c, d in found:
        own[c] += d
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    # Every distance is cut at the range of long before it is summed.
    own = Counter()
    for _, c, d in found:
        own[c] += min(d, TOP)
    return Counter((i, c, min(d, TOP), min(own[c], TOP), min(own.total(), TOP), marks[c]) for i, c, d in found)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 7, 8) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, rows int").repartition(3)


def test_equals_exact_integers(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)] + [(1000 + i, [0.5, -0.25, 0.0, 1e-30]) for i in range(80)]
    rows += [(2000, None), (2001, [1.0]), (2002, [1.0, None, 2.0, 3.0]), (2003, [1.0, float("nan"), 2.0, 3.0]), (2004, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.1, 0.2, 0.3, 0.4]), (5, [-1e-20, 0.0, 0.0, 0.0]), (5, [9.0, 9.0, 9.0, 9.0])]
    found = cc.centroid_clusters(frame(spark, rows), 5, 4, 4, 1024, 3)
    assert Counter(map(tuple, found.collect())) == plain(rows, 5, 4, 4, 1024, 3)


@pytest.mark.parametrize("big", [3e6, 2e9, 1e15, 1e300, 1.7e308])
def test_magnitudes_beyond_the_bounds(spark, big):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) * (big if i % 3 == 0 else 1)).clip(-1.7e308, 1.7e308).tolist()) for i in range(60)]
    found = cc.centroid_clusters(frame(spark, rows), 4, 3, 3, 1024, 3)
    assert Counter(map(tuple, found.collect())) == plain(rows, 4, 3, 3, 1024, 3)


def test_equal_starts_leave_a_cluster_empty(spark):
    rows = [(i, [1.0, 2.0]) for i in range(9)] + [(20, [5.0, 5.0])]
    found = cc.centroid_clusters(frame(spark, rows, "float"), 8, 10, 2, 1024, 3)
    assert Counter(map(tuple, found.collect())) == plain(rows, 8, 10, 2, 1024, 3)


def test_few_rows_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert Counter(map(tuple, cc.centroid_clusters(frame(spark, rows), 8, 10, 2).collect())) == plain(rows, 8, 10, 2, 1024, 3)
    assert cc.centroid_clusters(frame(spark, []), 8, 10, 2).count() == 0
    assert cc.centroid_clusters(frame(spark, [(1, [1.0])]), 8, 10, 2).count() == 0


def test_blocks_take_every_row(spark, monkeypatch):
    rows = [(i, [float(i % 17), float(i % 5)]) for i in range(9000)]
    found = cc.centroid_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1), 3, 2, 2)
    assert sorted(r.vec_id for r in found.collect()) == list(range(9000))
