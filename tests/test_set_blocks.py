"""Token sets compared in blocks of two groups of fitting lengths, and by their rare tokens: both give the pairs of brute force."""

import itertools
import random

import pytest

from postsift.operators import pairs
from postsift.tables import Tables


def some_sets():
    rng = random.Random(9)
    sets = [rng.sample(range(50), rng.randint(1, 40)) for _ in range(120)] + [list(range(i % 3, 60 + i % 5)) for i in range(30)]
    return [[f"w{x}" for x in s] for s in sets + [rng.sample(range(3000), 700)] * 2 + [[]]]


def brute(sets, threshold):
    found = {}
    for (i, a), (j, b) in itertools.combinations(enumerate(map(set, sets)), 2):
        if a and b and len(a & b) / len(a | b) >= threshold:
            found[i, j] = len(a & b) / len(a | b)
    return found


@pytest.mark.parametrize("threshold", [0.5, 0.7, 1.0])
def test_sets_in_blocks_equal_brute_force(spark, threshold, monkeypatch):
    """Several groups, lengths with more sets than a group holds, and several passes."""
    monkeypatch.setattr(pairs, "PASS_TOKENS_SHIPPED", 10)
    sets, tables = some_sets(), Tables(spark, "t")
    frame = spark.createDataFrame(list(enumerate(sets)), "node long, tokens array<string>")
    found = pairs.block_set_pairs(tables.write(pairs.numbered_sets(frame, tables), "n"), threshold, tables, most_sets=20).collect()
    assert {(r.a, r.b): r.similarity for r in found} == brute(sets, threshold) and len(found) == len(brute(sets, threshold))


@pytest.mark.parametrize(("cost", "joins"), [(1 << 40, 0), (0, 1)])
def test_frequent_tokens_are_compared_in_blocks(spark, cost, joins, monkeypatch):
    monkeypatch.setattr(pairs, "SET_PAIRS", cost)
    asked, candidates = [], pairs.set_candidates
    monkeypatch.setattr(pairs, "set_candidates", lambda *args: asked.append(1) or candidates(*args))
    sets = some_sets()
    found = pairs.jaccard_pairs(spark.createDataFrame(list(enumerate(sets)), "node long, tokens array<string>")).collect()
    assert {(r.a, r.b): r.similarity for r in found} == brute(sets, 0.7) and bool(asked) == bool(joins)


def test_groups_without_sets(spark):
    """Of the groups of one length some may get no set: the others are still compared once."""
    tables, sets = Tables(spark, "t"), [["a", "b", "c"]] * 9
    numbered = tables.write(pairs.numbered_sets(spark.createDataFrame(list(enumerate(sets)), "node long, tokens array<string>"), tables), "n")
    found = [(r.a, r.b) for r in pairs.block_set_pairs(numbered, 0.7, tables, most_sets=1).collect()]
    assert sorted(found) == list(itertools.combinations(range(9), 2))


def test_groups_are_bounded():
    numbers, groups = pairs._length_groups([(1, 5), (2, 3), (3, 50), (4, 2), (900, 1), (901, 1)], 10, 1000)
    assert numbers == [(1, 0, 1), (2, 0, 1), (3, 1, 5), (4, 6, 1), (900, 6, 1), (901, 7, 1)]
    assert groups == [[1, 2, 11], *[[3, 3, 30]] * 5, [4, 900, 908], [901, 901, 901]]
