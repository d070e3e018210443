import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift.operators import cleaning, dedupe, ranking, vectors


def posts(spark, rows):
    return spark.createDataFrame([(i, p, t, b, None) for p, (i, t, b) in enumerate(rows)], "id string, pos long, title string, body string, url string")


def sequential(rows):
    kept = []
    for i, t, b in rows:
        key = " ".join(f"{t} {b}".lower().split())
        tokens = set(__import__("re").findall(r"\w+", f"{t} {b}".lower()))
        for j, u, c in kept:
            other = set(__import__("re").findall(r"\w+", f"{u} {c}".lower()))
            if i == j or key == " ".join(f"{u} {c}".lower().split()) or dedupe.indel_ratio(t.lower(), u.lower()) >= 90:
                break
            if tokens and other and len(tokens & other) / len(tokens | other) >= 0.7:
                break
        else:
            kept.append((i, t, b))
    return {i for i, _, _ in kept}


@pytest.mark.parametrize("seed", [0, 1])
def test_greedy_dedupe_equals_the_sequential_loop(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(8)]
    rows = []
    for i in range(60):
        if rows and rng.random() < 0.5:
            _, t, b = rng.choice(rows)
            parts = b.split()
            if parts and rng.random() < 0.7:
                parts[rng.randrange(len(parts))] = rng.choice(words)
            rows.append((f"p{i}", t if rng.random() < 0.3 else t[:-1] + rng.choice("abc"), " ".join(parts)))
        else:
            rows.append((f"p{i}", f"title {rng.random():.12f}", " ".join(rng.choices(words, k=rng.randrange(9)))))
    frame = posts(spark, rows).repartition(5)
    assert {r.id for r in dedupe.greedy_dedupe(frame).collect()} == sequential(rows)


def test_chain_keeps_both_ends(spark):
    words = [f"w{i}" for i in range(24)]
    rows = [("a", "alpha", " ".join(words[:20])), ("b", "brown", " ".join(words[2:22])), ("c", "cigar", " ".join(words[4:]))]
    assert {r.id for r in dedupe.greedy_dedupe(posts(spark, rows)).collect()} == sequential(rows) == {"a", "c"}


def test_history_and_ratio(spark):
    frame = posts(spark, [("a", "t one", ""), ("b", "entirely different", "")])
    seen = frame.where("id = 'a'").select(F.md5(F.lit("a:None")).alias("hash"))
    assert {r.id for r in dedupe.greedy_dedupe(frame, seen).collect()} == {"b"}
    assert dedupe.indel_ratio("", "") == 100.0
    assert dedupe.indel_ratio("abcd", "abcx") == 75.0
    assert dedupe.indel_ratio("ab", "") == 0.0


def test_similar_titles_are_complete(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcd ", k=rng.randrange(5, 40))) for _ in range(30)]
    titles = list(dict.fromkeys(base + [t[: (k := rng.randrange(len(t)))] + rng.choice("abcd") + t[k:] for t in base] + [t[1:] for t in base]))
    frame = spark.createDataFrame(list(enumerate(titles)), "node long, title string")
    got = {(r.a, r.b) for r in dedupe.similar_titles(frame).collect()}
    want = {(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if dedupe.indel_ratio(titles[i], titles[j]) >= 90}
    assert got == want


def test_jaccard(spark):
    sets = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "d"]), (3, []), (4, ["c", "a", "b"])], "node long, tokens array<string>")
    assert {(r.a, r.b, r.similarity) for r in dedupe.jaccard_pairs(sets, 0.5).collect()} == {(1, 2, 0.5), (1, 4, 1.0), (2, 4, 0.5)}


def plain_mmr(score, vec, k, weight, allowed=None):
    s = np.array(score, float)
    n = np.ones(len(s)) if s.max() == s.min() else (s - s.min()) / (s.max() - s.min())
    v = np.array(vec, float)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    chosen = []
    for _ in range(k):
        value = n.copy() if not chosen else weight * n - (1 - weight) * (v @ v[chosen].T).max(1)
        value[chosen] = -np.inf
        if allowed is not None:
            value[~allowed] = -np.inf
        if value.max() == -np.inf:
            break
        chosen.append(int(value.argmax()))
    return chosen


def test_mmr(spark):
    rng = np.random.default_rng(0)
    vec, score = rng.normal(size=(12, 4)), rng.random(12)
    rows = spark.createDataFrame([(i, float(score[i]), [float(x) for x in vec[i]], f"s{i % 3}") for i in range(12)], "cluster_id int, priority_score double, embedding array<double>, sector string")
    got = [r.cluster_id for r in ranking.mmr(rows, 5).orderBy("mmr_rank").collect()]
    assert got == plain_mmr(score, vec, 5, 0.7)
    by = ranking.mmr_by_sector(rows, 2).collect()
    assert len(by) == 6 and {r.mmr_rank for r in by} == set(range(1, 7))
    best = max(range(3), key=lambda s: np.mean([score[i] for i in range(12) if i % 3 == s]))
    assert {r.sector for r in by if r.mmr_rank <= 2} == {f"s{best}"}


def test_sampling_plan(spark):
    sources = spark.createDataFrame([("reddit", f"r{i}", "business_pme") for i in range(4)], "type string, name string, category string")
    quotas = spark.createDataFrame([("business_pme", 150), ("rest", 710)], "category string, quota int")
    row = ranking.sampling_plan(sources, quotas).first()
    assert (row.total, row.per_source) == (83, 20)


def test_quota_of_zero_is_no_limit(spark):
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(10)], "pos long, category string")
    quotas = spark.createDataFrame([("a", 0), ("b", 2)], "category string, quota int")
    assert ranking.apply_quotas(rows, quotas).count() == 7


def test_penalty_and_novelty(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0], 8.0)], "cluster_id int, centroid array<double>, priority_score double")
    past = spark.createDataFrame([([0.8, 0.6],)], "vector array<double>")
    assert vectors.penalized(items, past).first().priority_score_adjusted == pytest.approx(6.08)
    assert vectors.penalized(items, past.limit(0)).first().priority_score_adjusted == 8.0
    assert vectors.centroid_novelty(items, past).first().novelty == 2.0
    assert vectors.centroid_novelty(items, past.limit(0)).first().novelty == 8.0


def test_kmeans_and_knn(spark):
    rows = spark.createDataFrame([(i, [float(i // 5 * 10), float(i % 5) / 10]) for i in range(10)], "id long, embedding array<double>")
    found = {r.id: r.cluster_id for r in vectors.cluster(rows, 2, tries=2).collect()}
    assert len({found[i] for i in range(5)}) == 1 and found[0] != found[9]
    near = vectors.nearest(rows.where("id = 0").withColumnRenamed("id", "query_id"), rows, 2).orderBy("rank").collect()
    assert [r.id for r in near] == [0, 1]


def test_language_and_filters(spark):
    rows = spark.createDataFrame([("a", "the cat and the dog", "", None, 5), ("b", "le chat et la maison de", "", None, None), ("c", "short", "", 3, 1)], "id string, title string, body string, score int, comments_count int")
    assert {r.id: r.lang for r in cleaning.tag_language(rows).collect()} == {"a": "en", "b": "fr", "c": "unknown"}
    assert {r.id for r in cleaning.filter_score(rows, 1).collect()} == {"c"}
    assert cleaning.filter_score(rows, 0).count() == 3 and cleaning.filter_languages(rows, None).count() == 3
    assert {r.id for r in cleaning.filter_comments(rows, 2).collect()} == {"a"}
