"""Similarity joins against brute force, the bounds they prune by, and greedy dedupe over components."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift.operators import dedupe, graph, pairs
from postsift.tables import Tables, with_ranks


def plain_pairs(sets, threshold):
    out = {}
    for (i, a), (j, b) in itertools.combinations(sorted((i, set(t)) for i, t in sets if t), 2):
        if len(a & b) / len(a | b) >= threshold:
            out[i, j] = len(a & b) / len(a | b)
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9, 1.0])
def test_jaccard_equals_brute_force(spark, threshold, monkeypatch):
    monkeypatch.setattr(pairs, "SALT_ROWS", 7)  # hot tokens are dealt over several parts
    rng = random.Random(4)
    sets = [(i, rng.sample("abcdefghijklmnop", rng.randint(0, 16))) for i in range(120)]
    sets += [(500 + i, [f"t{k}" for k in range(i % 3, 40 + i % 5)]) for i in range(40)] + [(900, [f"u{k}" for k in range(700)]), (901, [f"u{k}" for k in range(60, 700)])]
    frame = spark.createDataFrame(sets, "node long, tokens array<string>").repartition(4)
    found = dedupe.jaccard_pairs(frame, threshold).collect()
    assert {(r.a, r.b): r.similarity for r in found} == pytest.approx(plain_pairs(sets, threshold)) and len(found) == len({(r.a, r.b) for r in found})


def test_a_dictionary_that_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(pairs, "DICTIONARY_BYTES", 0)
    sets = [(1, ["a", "b", "c"]), (2, ["a", "b", "c", "d"]), (3, None), (4, ["z"])]
    assert [(r.a, r.b) for r in dedupe.jaccard_pairs(spark.createDataFrame(sets, "node long, tokens array<string>")).collect()] == [(1, 2)]


def test_few_sets_become_candidates(spark):
    """Long sets with frequent tokens in common, which are no pairs, do not meet."""
    rng = random.Random(1)
    sets = [(i, [f"c{k}" for k in range(60)] + [f"r{rng.randrange(3000)}" for _ in range(80)]) for i in range(150)]
    sets = [(i, list(dict.fromkeys(t))) for i, t in sets] + [(1000, [f"c{k}" for k in range(60)] + ["x"]), (1001, [f"c{k}" for k in range(60)] + ["y"])]
    tables = Tables(spark, "t")
    numbered = tables.write(pairs.numbered_sets(spark.createDataFrame(sets, "node long, tokens array<string>"), tables), "n")
    assert {(r.a, r.b) for r in pairs.set_candidates(numbered, 0.7).collect()} == {(1000, 1001)}


def random_titles(rng, n):
    base = ["".join(rng.choices("abcdé ", k=rng.randrange(1, 90))) for _ in range(n)]
    out = list(base)
    for t in base:
        for _ in range(rng.randrange(1, 5)):
            edits = list(t)
            for _ in range(rng.randrange(1, 2 + len(t) // 8)):
                k = rng.randrange(len(edits) + 1)
                edits[k : k + rng.randrange(2)] = rng.choice(["", "x", "a", "yz"])
            out.append("".join(edits))
    return [t for t in dict.fromkeys(out) if t] + ["shared start of many titles " + "".join(rng.choices("abc", k=20)) for _ in range(40)]


@pytest.mark.parametrize("threshold", [90, 80, 97])
def test_titles_equal_brute_force(spark, threshold):
    titles = list(dict.fromkeys(random_titles(random.Random(threshold), 60)))
    frame = spark.createDataFrame(list(enumerate(titles)), "node long, title string").repartition(3)
    want = {(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if pairs.indel_ratio(titles[i], titles[j]) >= threshold}
    assert {(r.a, r.b) for r in pairs.similar_titles(frame, threshold).collect()} == want
    met = {(r.a, r.b) for r in pairs.title_candidates(frame, threshold, Tables(spark, "t")).collect()}
    assert want <= met and len(met) < len(titles) ** 2 / 6  # of half as many pairs again


def test_rarest_chunks_are_the_best_by_trying_all():
    rng = np.random.default_rng(0)
    for _ in range(60):
        chunks, size, spare = rng.integers(1, 4), rng.integers(1, 4), rng.integers(0, 5)
        costs = rng.integers(0, 20, (5, chunks * size + spare - size + 1))
        found = pairs._rarest(costs, chunks, size)
        for row, starts in zip(costs, found, strict=True):
            assert all(b - a >= size for a, b in itertools.pairwise(starts)) and starts[0] >= 0 and starts[-1] < len(row)
            best = min(sum(row[list(p)]) for p in itertools.combinations(range(len(row)), chunks) if all(b - a >= size for a, b in itertools.pairwise(p)))
            assert row[starts].sum() == best


def test_bags_bound_the_distance():
    rng = random.Random(2)
    titles = [t for t in random_titles(rng, 30) if len(t) > 4]
    bags = {}
    for _, at, codes in pairs._by_length(titles):
        for k, words in zip(at, zip(*pairs._bags(codes), strict=True), strict=True):
            bags[titles[k]] = words
    for a, b in itertools.product(titles[:60], titles[-60:]):
        distance = len(a) + len(b) - 2 * pairs._common(a, b)
        assert sum(int(np.uint64(x ^ y)).bit_count() for x, y in zip(bags[a], bags[b], strict=True)) <= distance


def sequential(rows):
    kept, gone = [], set()
    for pos, title, body in rows:
        tokens = set(f"{title} {body}".split())
        if any(pairs.indel_ratio(title, t) >= 90 or tokens and o and len(tokens & o) / len(tokens | o) >= 0.7 for t, o in kept):
            gone.add(pos)
        else:
            kept.append((title, tokens))
    return {pos for pos, _, _ in rows} - gone


@pytest.mark.parametrize("group_rows", [1, 40, 500_000])
def test_greedy_by_groups_and_by_rounds(spark, group_rows):
    """Chains, copies and a large component, decided in one task a component or in rounds."""
    rng = random.Random(group_rows)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, f"chain number {i:04d} {'x' * (i % 3)}", " ".join(words[i % 30 : i % 30 + 10])) for i in range(60)]
    rows += [(100 + i, "".join(rng.choices("klmno", k=25)), " ".join(rng.sample(words, 6))) for i in range(50)] + [(200 + i, "the same", "thing") for i in range(30)]
    rng.shuffle(rows)
    rows = [(pos, t, b) for pos, (_, t, b) in enumerate(rows)]
    frame = spark.createDataFrame([(f"p{p}", p, t, b, None) for p, t, b in rows], "id string, pos long, title string, body string, url string").repartition(5)
    assert {r.pos for r in dedupe.greedy_dedupe(frame, group_rows=group_rows).collect()} == sequential(rows)


def test_greedy_edges(spark):
    schema = "id string, pos int, title string, body string, url string"
    rows = [("a", 1, None, None, None), ("b", 2, None, None, None), ("c", 3, "", "", None), ("d", 4, "x", None, None), ("d", 9, "another title", "z", None)]
    frame = spark.createDataFrame(rows, schema)
    # Rows without any text have equal content; the last shares the id of the one before.
    assert {r.pos for r in dedupe.greedy_dedupe(frame).collect()} == {1, 4}
    assert {r.pos for r in dedupe.greedy_dedupe(frame, cross_source=False).collect()} == {1, 2, 3, 4}
    assert dedupe.greedy_dedupe(frame.limit(0)).count() == 0


def test_components_and_ranks(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (3, 5)], "a long, b long")
    found = {r.node: r.root for r in graph.connected_components(edges, Tables(spark, "t")).collect()}
    assert found == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8}
    ranked = with_ranks(spark.range(1000).select((F.col("id") % 7).alias("x"), "id"), [F.col("x").desc(), F.col("id").asc()], Tables(spark, "t"))
    assert [(r["rank"], -r.x, r.id) for r in ranked.orderBy("rank").collect()] == [(k, *v) for k, v in enumerate(sorted((-(i % 7), i) for i in range(1000)), 1)]


def test_similar_sets_in_passes(spark, monkeypatch):
    """Postings and pairs dealt over passes give the pairs of one pass; a pass holds part of the candidates only."""
    monkeypatch.setattr(pairs, "PASS_TOKENS", 10)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    sets = [(i, rng.sample(words, rng.randint(4, 9))) for i in range(150)]
    sets += [(200 + i, (sets[i][1] + ["new"])[: 9 - i % 2]) for i in range(60)]
    df = spark.createDataFrame(sets, "node long, tokens array<string>")
    found = {(r.a, r.b) for r in pairs.jaccard_pairs(df).collect()}
    assert found == {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) >= 0.7 * len(set(x) | set(y))}
    numbered = pairs.Tables(spark, "t").write(pairs.numbered_sets(df, pairs.Tables(spark, "u")), "n")
    each = [{(r.a, r.b) for r in pairs.set_candidates(numbered, 0.7, 4, turn).collect()} for turn in range(4)]
    assert found <= {(min(p), max(p)) for p in set.union(*each)} and all(len(x) < len(set.union(*each)) for x in each)


@pytest.mark.parametrize("threshold", [90, 80, 97])
def test_titles_in_blocks_equal_brute_force(spark, threshold):
    """Each pair of groups is compared once and loses no similar pair; few others stay."""
    rng = random.Random(100 + threshold)
    titles = list(dict.fromkeys(random_titles(rng, 60) + ["".join(rng.choices("abcdefgh é", k=k)) for k in (63, 64, 65, 150, 150, 300)]))
    titles += [t[:70] + "y" + t[72:] for t in titles[-2:]]
    frame = spark.createDataFrame(list(enumerate(titles)), "node long, title string").repartition(3)
    want = {(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if pairs.indel_ratio(titles[i], titles[j]) >= threshold}
    met = [(r.a, r.b) for r in pairs.block_candidates(frame, threshold, groups=3).collect()]
    assert want <= set(met) and len(met) == len(set(met)) < len(titles) ** 2 / 6


def test_titles_of_frequent_chunks_meet_in_blocks(spark, monkeypatch):
    """Titles of one small vocabulary share chunks with most others: they are compared in blocks, and few become candidates."""
    rng = random.Random(8)
    words = ["the", "and", "than", "ting", "ion", "ent", "here", "edan"]
    titles = list(dict.fromkeys(" ".join(rng.choices(words, k=20))[:80] for _ in range(300)))
    asked = []
    blocks = pairs.block_candidates
    monkeypatch.setattr(pairs, "block_candidates", lambda *args: asked.append(1) or blocks(*args))
    frame = spark.createDataFrame(list(enumerate(titles)), "node long, title string")
    met = pairs.title_candidates(frame, 90, Tables(spark, "t")).count()
    assert asked and met < len(titles)
