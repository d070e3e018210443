import pytest
from pyspark.sql import functions as F

from postsift.functions import lexicon, parsing, text, vectors
from postsift.operators import cleaning, scoring


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, digits, expected", [(0.25, 1, 0.2), (2.5, 0, 2.0), (6.45, 1, 6.4), (7.0, 1, 7.0), (-0.5, 0, 0.0)])
def test_half_even(spark, value, digits, expected):
    assert one(spark, text.half_even(F.lit(value), digits)) == expected


def test_tokens_and_truncation(spark):
    assert one(spark, text.estimate_tokens(F.lit("1234567"))) == 1
    assert one(spark, text.truncate_to_tokens(F.lit("1234567890123"), 3)) == "123456789012..."
    assert one(spark, text.preview(F.lit("a" * 200))) == "a" * 200
    assert one(spark, text.normalize_whitespace(F.lit(" a \n b "))) == "a b"


def test_hash_of_missing_url_is_that_of_none(spark):
    import hashlib

    assert one(spark, text.identity_hash(F.lit("a"), F.lit(None).cast("string"))) == hashlib.md5(b"a:None").hexdigest()


@pytest.mark.parametrize("said, views", [("1,234,567 views", 1234567), ("1.2M views", 1200000), ("12K views", 12000), ("many", 0), (None, 0), ("3 Kinds", 3)])
def test_view_count(spark, said, views):
    assert one(spark, text.view_count(F.lit(said).cast("string"))) == views


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert one(spark, vectors.cosine(a, b)) == pytest.approx(2**-0.5)
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, vectors.squared_distance(a, b)) == 1.0
    same = spark.createDataFrame([(1,), (1,)], "x int").select(vectors.min_max(F.col("x")).alias("s"))
    assert [r.s for r in same.collect()] == [1.0, 1.0]


@pytest.mark.parametrize("said, intent", [("a problem and need a tool", "pain"), ("looking for a tool", "request"), ("nothing", None), ("frustrated, but which tool", "pain"), (None, None)])
def test_intent(spark, said, intent):
    assert one(spark, lexicon.rule_intent(F.lit(said).cast("string"))) == intent


def test_wtp_counts_the_first_matching_pattern_of_a_kind(spark):
    rows = spark.createDataFrame([("a", "I would pay $50. would pay!", ""), ("b", "", ""), ("c", "price", "x")], "id string, title string, body string")
    found = {r.id: r for r in cleaning.enrich_wtp(rows).select("id", "wtp_signals", lexicon.wtp_score(F.col("wtp_signals")).alias("score")).collect()}
    a = found["a"].wtp_signals
    assert a.has_wtp and a.signal_types == ["direct_payment", "budget"] and a.signal_count == 3 and len(a.examples) == 3
    assert found["a"].score == 10.0
    assert found["b"].score == 0.0 and not found["b"].wtp_signals.has_wtp
    assert found["c"].score == 2.5


def test_responses(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, 'x ```json\n{"a": 2}\n``` y'), (3, "```\n{\"a\": 3}\n```"), (4, "no"), (5, None), (6, "")], "id int, r string")
    got = {r.id: r.a for r in rows.select("id", parsing.response_field(parsing.response_json(F.col("r")), "a", "int").alias("a")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: None, 5: None, 6: None}
    assert one(spark, parsing.has_fields(F.lit('{"a":1,"b":null}'), ["a", "b"])) is True
    assert one(spark, parsing.has_fields(F.lit('{"a":1}'), ["a", "b"])) is False
    assert one(spark, parsing.clamp(F.lit(None).cast("double"), 1.0, 10.0)) is None


def stats(spark, **kw):
    base = dict(size=1, avg_score=0.0, avg_comments=0.0, max_score=0.0, max_comments=0.0, avg_keywords=0.0, source_mix=["a"])
    return spark.createDataFrame([base | kw])


@pytest.mark.parametrize("score, comments, expected", [(45.0, 12.0, 7.5), (500.0, 500.0, 10.0), (0.0, 0.0, 0.0)])
def test_traction(spark, score, comments, expected):
    assert stats(spark, avg_score=score, avg_comments=comments).select(scoring.traction().alias("x")).first().x == expected


def test_heuristic_pain(spark):
    assert stats(spark, avg_score=20.0, avg_comments=7.0, avg_keywords=0.5).select(scoring.heuristic_pain().alias("x")).first().x == 4


@pytest.mark.parametrize("n, size, expected", [(0, 5, 10.0), (2, 11, 5.0), (3, 25, 2.0)])
def test_novelty(spark, n, size, expected):
    assert one(spark, scoring.novelty(F.array_repeat(F.lit("x"), n), F.lit(size))) == expected


def test_priority_and_pain(spark):
    assert one(spark, scoring.priority(F.lit(8), F.lit(6), F.lit(7.0), F.lit(10.0), 5.0, 5.0)) == 6.97
    assert one(spark, scoring.combined_pain(F.lit(7), F.lit(5))) == 6
    assert one(spark, scoring.combined_pain(F.lit(None).cast("int"), F.lit(5))) == 5
    assert one(spark, scoring.final_pain(F.lit(0), F.lit(5))) == 5
    assert [one(spark, scoring.source_bonus(F.array(*[F.lit(str(i)) for i in range(n)]))) for n in (1, 2, 3)] == [1.0, 1.1, 1.2]


def test_trends(spark):
    sizes = spark.createDataFrame([("a", 6), ("b", 3)], "cluster_id string, size long")
    past = spark.createDataFrame([(1, "a", 4)], "week_offset int, cluster_id string, size long")
    assert {r.cluster_id: r.trend for r in scoring.trend_growth(sizes, past).collect()} == {"a": 7.3, "b": 9.8}
    assert {r.trend for r in scoring.trend_growth(sizes, past.limit(0)).collect()} == {5.0}
    assert one(spark, scoring.hybrid_trend(F.lit(8.0), F.lit(0.5))) == 5.9
    assert one(spark, scoring.hybrid_trend(F.lit(None).cast("double"), F.lit(4.0))) == 4.0


def test_recency(spark):
    day = 86400.0
    rows = spark.createDataFrame([("a", 100 * day), ("a", 96.5 * day), ("b", 200 * day), ("c", 1.0), ("d", None)], "cluster_id string, created_ts double")
    assert {r.cluster_id: r.recency for r in scoring.recency(rows, 100 * day).collect()} == {"a": 7.5, "b": 10.0, "c": 0.0, "d": 5.0}


def test_term_novelty(spark):
    posts = spark.createDataFrame([("a", 0, "alpha alpha", "the beta"), ("b", 1, "x", "y")], "cluster_id string, pos long, title string, body string")
    history = spark.createDataFrame([("alpha", 1), ("rest", 999)], "term string, freq long")
    got = {r.cluster_id: r.novelty for r in scoring.term_novelty(posts.select("cluster_id"), scoring.term_counts(posts), history).collect()}
    assert got == {"a": 7.5, "b": 5.0}
