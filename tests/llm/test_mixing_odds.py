"""Pareto order with unequal probabilities: against the rule written out, and as frequencies over many draws."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift.llm import mixing


def plain_draw(docs, budget, number):
    """docs: (id, size); the ids drawn from one source, by the rule's definition."""
    room = math.floor(budget)
    open_ = [(i, s) for i, s in docs if 0 < s <= room]
    certain, rest, rate = [], sorted(open_, key=lambda d: -d[1]), 0.0
    while rest:
        top = [d for d in rest if d[1] == rest[0][1]]
        rate = (budget - sum(s for _, s in certain)) / sum(s * s for _, s in rest)
        if rate * top[0][1] < 1:
            break
        certain += top
        rest = rest[len(top) :]
    ranked = [(0.0, i, s) for i, s in certain]
    for i, s in rest:
        u, p = number(i), rate * s
        ranked.append((u / (1 - u) / (p / (1 - p)), i, s))
    out = set()
    for _, i, s in sorted(ranked):
        if s <= room:
            room -= s
            out.add(i)
    return out, {i: 1.0 for i, _ in certain} | {i: rate * s for i, s in rest}


def number(i):
    return (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def corpus(spark, sizes):
    rows = [(i, s, x) for x, own in sizes.items() for i, s in own]
    return spark.createDataFrame(rows, "doc_id long, words int, source string").select("doc_id", F.repeat(F.lit("w "), F.col("words")).alias("text"), "source", F.lit(1).alias("rate"), F.lit("x").alias("room"))


@pytest.mark.parametrize("tail", [10_000, 40])
def test_draw_is_that_of_the_rule(spark, monkeypatch, tail):
    monkeypatch.setattr(mixing, "TAIL_ROOM", tail)  # also in several turns
    rng = np.random.default_rng(7)
    sizes = {
        "a": [(i, int(s)) for i, s in enumerate(rng.pareto(1.2, 300) * 20)],
        "b": [(1000 + i, 100) for i in range(500)] + [(1999, 50_000)],  # half of the words in one document
        "c": [(3000 + i, int(s)) for i, s in enumerate(rng.integers(0, 60, 400))],
    }
    got = {r.doc_id: r for r in mixing.mix_sources(corpus(spark, sizes)).collect()}
    for own in sizes.values():
        first = got[own[0][0]]
        whole = math.floor(first.target / first.source_size)
        drawn, _ = plain_draw(own, first.target - whole * first.source_size, number)
        more = {i for i, s in own if s and got[i].taken == (whole + 1) * s}
        assert drawn <= more and len(more - drawn) <= 1  # at most one document closes the gap
        assert abs(sum(got[i].taken for i, _ in own) - first.target) <= 50
        assert all(got[i].taken <= 3 * s for i, s in own)


def test_inclusion_follows_the_odds():
    """Over many draws a document is taken as often as its probability says: five times the size, five times as often.

    What fills the last gap is small, which shows in small samples; here a sample is some 400 documents.
    """
    docs = [(i, 10 if i % 2 else 50) for i in range(2000)] + [(9999, 30_000)]
    taken, n = dict.fromkeys([i for i, _ in docs], 0), 100
    for draw in range(n):
        rng = np.random.default_rng(draw)
        numbers = dict(zip([i for i, _ in docs], rng.random(len(docs)), strict=True))
        drawn, p = plain_draw(docs, 18_000.0, numbers.__getitem__)
        for i in drawn:
            taken[i] += 1
    small, large = np.mean([taken[i] for i, s in docs if s == 10]) / n, np.mean([taken[i] for i, s in docs if s == 50]) / n
    assert p[0] == pytest.approx(5 * p[1]) and taken[9999] == 0
    assert large == pytest.approx(p[0], rel=0.05) and small == pytest.approx(p[1], rel=0.1)


def test_the_odds_alter_the_sample(spark):
    """Among documents of one random number the longer one is drawn: equal odds would tell them apart by id alone."""
    ids = sorted(range(2000), key=number)[300:1500]
    sizes = {"a": [(i, 90 if k % 3 == 0 else 10) for k, i in enumerate(ids)], "b": [(5000 + i, 100) for i in range(400)], "c": [(9000 + i, 60) for i in range(300)]}
    got = {r.doc_id: r for r in mixing.mix_sources(corpus(spark, sizes), weights=(1, 2, 2)).collect()}
    share = {size: np.mean([got[i].taken > 0 for i, s in sizes["a"] if s == size]) for size in (10, 90)}
    assert share[90] > 2 * share[10]
