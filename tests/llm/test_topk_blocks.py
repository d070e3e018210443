"""Top-k search: components close to whole numbers, order of blocks, and blocks that are never scored."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift.llm import topk


def exact(rows, asks, k):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    out = set()
    for q in whole:
        if asks(q):
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q)
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("query_bytes", [8 << 20, 48])
def test_floor_of_components_next_to_whole_numbers(spark, query_bytes):
    odd = [-1e-20, -0.0, 0.0, 1e-300, -1e-300, 1 / 256, -1 / 256, math.nextafter(1, 0), math.nextafter(-1, 0), math.nextafter(-1, -2), 2.0**45, -(2.0**44) - 1 / 256]
    rows = [(i, [1.0, x]) for i, x in enumerate(odd)] + [(20 + i, [1.0, 1.0]) for i in range(3)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, near int, asks int")
    found = topk.top_k(frame, F.col("vec_id") % 2 == 0, 4, query_bytes=query_bytes).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == exact(rows, lambda q: q % 2 == 0, 4)


def clustered(n=6000, width=16, groups=30):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(groups, width))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    return np.floor(256 * (centres[rng.integers(groups, size=n)] + 0.02 * rng.normal(size=(n, width))))


def blocks_of(vectors, order):
    return [(order[i : i + topk.BLOCK_ROWS].astype(np.int64), vectors[order[i : i + topk.BLOCK_ROWS]]) for i in range(0, len(order), topk.BLOCK_ROWS)]


def test_blocks_of_alike_documents_are_skipped():
    vectors = clustered()
    queries = np.arange(0, len(vectors), 50)
    pivots = vectors[:: len(vectors) // topk.PIVOTS]
    near = ((pivots**2).sum(1) / 2 - vectors @ pivots.T).argmin(1)
    shares = []
    for order in (np.arange(len(vectors)), np.lexsort((np.arange(len(vectors)), near))):
        search = topk._Search(queries, vectors[queries], 5)
        blocks = blocks_of(vectors, order)
        for i in range(0, len(blocks), topk.GROUP_BLOCKS):
            search.group(blocks[i : i + topk.GROUP_BLOCKS])
        shares.append(search.scored / search.offered)
        scores = (vectors[queries] @ vectors.T).astype(np.int64)
        for row, q in enumerate(queries):
            want = sorted(((-int(s), i) for i, s in enumerate(scores[row]) if i != q))[:5]
            assert [(int(s), int(i)) for s, i in zip(search.best[row], search.best_ids[row], strict=True)] == [(-s, i) for s, i in want]
    assert shares[1] < 0.25 and shares[1] < shares[0] / 2


def test_components_that_the_scale_takes_beyond_doubles(spark):
    rows = [(0, [1e306, 1.0]), (1, [1.0, 0.0]), (2, [-1.7e308, 3.0]), (3, [0.0, 2.0]), (4, [1.0, 1.0])]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 2 == 0, 5).collect()
    top = 2**63
    assert {(r.query_id, r.vec_id): r.score for r in found} == {
        (0, 1): top - 1, (0, 4): top - 1, (0, 3): 256 * 512, (0, 2): -top,
        (2, 3): 768 * 512, (2, 1): -top, (2, 4): -top, (2, 0): -top,
        (4, 0): top - 1, (4, 3): 256 * 512, (4, 1): 256 * 256, (4, 2): -top,
    }
