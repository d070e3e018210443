"""Every operator as a query over the driver's tables, beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon, parsing, text, vectors as vec
from ..operators import cleaning, dedupe, ranking, scoring, vectors
from ..schemas import as_posts
from ..sources import feeds, history, sinks, store
from ..tables import spread
from . import providers, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

POSTS = """posts AS (SELECT 'doc_' || doc_id AS id, doc_id AS pos, source, substr(text, 1, 80) AS title, text AS body, lang,
  n_chars % 100 AS score, doc_id % 30 AS comments_count, NULL::VARCHAR AS url FROM documents)"""
CLUSTERED = POSTS + ", clustered AS (SELECT posts.*, label AS cluster_id, embedding FROM posts JOIN embeddings ON pos = vec_id)"
COSINE = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"
WORDS = ["the", "license", "free", "que"]
TOPICS = {"law": [r"license", r"warranty"], "function": [r"the", r"and"], "iberian": [r"que", r"los"]}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def posts(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    return d.select(
        F.concat(F.lit("doc_"), "doc_id").alias("id"), F.col("doc_id").alias("pos"), "source", F.substring("text", 1, 80).alias("title"), F.col("text").alias("body"), "lang",
        (F.col("n_chars") % 100).alias("score"), (F.col("doc_id") % 30).alias("comments_count"), F.lit(None).cast("string").alias("url"),
    )


def clustered(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.col("label").alias("cluster_id"), "embedding")
    return posts(spark, sf).join(e, "pos")


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.cluster_stats(clustered(spark, sf))


def _insights(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    rank = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("run_id"), rank.alias("rank"), F.col("o_totalprice").alias("priority_score"), F.col("o_orderpriority").alias("sector"),
                    (F.col("o_custkey") % 10).cast("double").alias("founder_fit_score"), (F.col("o_orderkey") % 2).cast("int").alias("monetizable"), F.col("o_orderdate").alias("created_at"))


INSIGHTS = """insights AS (SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS run_id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank,
  o_totalprice AS priority_score, o_orderpriority AS sector, (o_custkey % 10)::DOUBLE AS founder_fit_score, (o_orderkey % 2)::INT AS monetizable, o_orderdate AS created_at FROM orders)"""

# --- cleaning and text scalars ------------------------------------------------------------------


@query(f"WITH {POSTS} SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, substr(trim(regexp_replace(body, '\\s+', ' ', 'g')), 1, 2000) AS body FROM posts")
def clean_normalize(spark, sf):
    return cleaning.normalize_posts(posts(spark, sf)).select("id", "title", "body")


@query(f"WITH {POSTS} SELECT id, CASE WHEN body <> '' THEN title || ' ' || body ELSE title END AS text, length(body) // 4 AS tokens, CASE WHEN length(body) > 400 THEN substr(body, 1, 400) || '...' ELSE body END AS cut, CASE WHEN length(body) > 200 THEN substr(body, 1, 200) || '...' ELSE body END AS preview FROM posts")
def text_tokens_truncate(spark, sf):
    b = F.col("body")
    return posts(spark, sf).select("id", text.post_text(F.col("title"), b).alias("text"), text.estimate_tokens(b).alias("tokens"), text.truncate_to_tokens(b, 100).alias("cut"), text.preview(b).alias("preview"))


@query("SELECT conv_id AS cluster_id, turn AS pos, CASE WHEN length(text) > 4 * share THEN substr(text, 1, 4 * share) || '...' ELSE text END AS text FROM (SELECT *, greatest(1000 // count(*) OVER (PARTITION BY conv_id), 50)::BIGINT AS share FROM conversations)")
def truncate_to_fit(spark, sf):
    rows = _t(spark, sf, "conversations").select(F.col("conv_id").alias("cluster_id"), F.col("turn").alias("pos"), "text")
    return cleaning.fit_texts(rows, 1200)


@query(f"WITH {POSTS} SELECT id, md5(id || ':' || coalesce(url, 'None')) AS hash, md5(trim(regexp_replace(lower(title || ' ' || body), '\\s+', ' ', 'g'))) AS content_hash FROM posts")
def hashes(spark, sf):
    return posts(spark, sf).select("id", text.identity_hash(F.col("id"), F.col("url")).alias("hash"), text.content_hash(F.col("title"), F.col("body")).alias("content_hash"))


@query(f"WITH {POSTS} SELECT id, len(list_distinct(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}_]+')))::INT AS n_tokens, len(list_filter(string_split(trim(regexp_replace(lower(body), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 3))::INT AS n_terms FROM posts")
def tokenize(spark, sf):
    return posts(spark, sf).select("id", F.size(text.token_set(F.col("body"))).alias("n_tokens"), F.size(text.terms(F.col("body"))).alias("n_terms"))


@query(f"WITH {POSTS} SELECT id, " + " + ".join(f"contains(lower(body), '{k}')::INT" for k in lexicon.PAIN_KEYWORDS) + " AS pain_keywords FROM posts")
def pain_keywords(spark, sf):
    return posts(spark, sf).select("id", lexicon.keyword_count(F.col("body")).alias("pain_keywords"))


@query("SELECT user_id, round_even(10000 / (1 + exp(-value / 100)), 0) / 1000 AS s FROM events")
def sigmoid(spark, sf):
    return _t(spark, sf, "events").select("user_id", text.half_even(10 * text.sigmoid(F.col("value") / 100), 3).alias("s"))


@query(f"WITH {POSTS}, t AS (SELECT sum(length(body) // 4)::BIGINT AS tokens FROM posts) SELECT tokens, tokens / 1000.0::DOUBLE * 0.00002::DOUBLE AS cost_usd FROM t")
def embedding_cost(spark, sf):
    prices = spark.createDataFrame([(k, *v) for k, v in scan.PRICES.items()], "model string, input double, output double")
    return cleaning.token_cost(posts(spark, sf).select(F.col("body").alias("text")), prices, "text-embedding-3-small")


@query("SELECT o_orderkey, '$' || CASE WHEN o_totalprice / 1e7 < 0.01 THEN printf('%.4f', o_totalprice / 1e7) ELSE printf('%.2f', o_totalprice / 1e7) END AS shown FROM orders")
def format_cost(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", text.format_cost(F.col("o_totalprice") / 1e7).alias("shown"))


# --- filters and classifiers --------------------------------------------------------------------


@query(f"WITH {POSTS} SELECT id FROM posts WHERE score >= 40 AND comments_count >= 5 AND lang IN ('en', 'fr')")
def filter_chain(spark, sf):
    return cleaning.filter_languages(cleaning.filter_comments(cleaning.filter_score(posts(spark, sf), 40), 5), ["en", "fr"]).select("id")


@query(f"WITH {POSTS} SELECT id FROM posts WHERE " + " OR ".join(f"contains(lower(title || ' ' || body), '{w}')" for w in WORDS))
def keyword_filter(spark, sf):
    return cleaning.filter_keywords(posts(spark, sf), WORDS).select("id")


def _detector_sql() -> str:
    scores = [f"{{'n': len(list_filter(ws, lambda w: w IN ({', '.join(repr(x) for x in own)}))), 'o': {-i}, 'name': '{name}'}}" for i, (name, own) in enumerate(sorted(cleaning.STOP_WORDS.items()))]
    return f"WITH {POSTS}, w AS (SELECT id, trim(title || ' ' || body) AS t, string_split(trim(regexp_replace(lower(title || ' ' || body), '\\s+', ' ', 'g')), ' ') AS ws FROM posts), m AS (SELECT id, t, list_max([{', '.join(scores)}]) AS b FROM w) SELECT id, CASE WHEN length(t) >= 10 AND b.n > 0 THEN b.name ELSE 'unknown' END AS lang FROM m"


@query(_detector_sql())
def detect_language(spark, sf):
    return cleaning.tag_language(spread(posts(spark, sf))).select("id", "lang")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _intent_sql(source: str, patterns: dict[str, list[str]]) -> str:
    scores = [f"{{'score': {' + '.join('len(regexp_extract_all(t, ' + _quoted(p) + '))' for p in own)}, 'o': {-i}, 'name': '{name}'}}" for i, (name, own) in enumerate(patterns.items())]
    return f"WITH {source}, w AS (SELECT id, lower(trim(title || ' ' || body)) AS t FROM src), m AS (SELECT id, list_max([{', '.join(scores)}]) AS b FROM w) SELECT id, CASE WHEN b.score > 0 THEN b.name ELSE 'other' END AS intent FROM m"


@query(_intent_sql(POSTS + ", src AS (SELECT * FROM posts)", TOPICS))
def intent_lexicon(spark, sf):
    return cleaning.tag_intent(spread(posts(spark, sf)), TOPICS).select("id", "intent")


#: Posts that exercise the fixed lexicons, which the tables hardly touch.
SAMPLES = [
    ("a", "I am frustrated", "this tool is broken and a problem"),
    ("b", "Looking for a tool", "does anyone use an app for invoices"),
    ("c", "How to learn", "a step by step tutorial with tips"),
    ("d", "Just launched", "check out my new app, sign up"),
    ("e", "Company announced version 2", "according to reports"),
    ("f", "Nothing here", "plain words only"),
    ("g", "bug", "what do you use"),
    ("h", "I would pay $50", "pricing is too expensive, worth it"),
    ("i", "Need now", "my budget is 200 dollars, save time"),
    ("j", "Canceling my subscription", "alternative to an overpriced plan"),
]
_VALUES = "src AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{t}', '{b}')" for i, t, b in SAMPLES) + ") AS s(id, title, body))"


def _samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLES, "id string, title string, body string")


@query(_intent_sql(POSTS + ", " + _VALUES.replace("src AS", "own AS") + ", src AS (SELECT * FROM own UNION ALL SELECT id, title, body FROM posts)", lexicon.INTENT_PATTERNS))
def intent_rules(spark, sf):
    own = _samples(spark).unionByName(spread(posts(spark, sf)).select("id", "title", "body"))
    return cleaning.tag_intent(own).select("id", "intent")


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY source")
def source_frequencies(spark, sf):
    return cleaning.frequencies(_t(spark, sf, "documents"), "source")


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def top_frequencies(spark, sf):
    return cleaning.frequencies(_t(spark, sf, "events"), "event_type", 3)


@query("SELECT event_id, user_id FROM events WHERE epoch(ts) >= 1704844800 AND user_id % 3 <> 0 UNION ALL SELECT event_id, user_id FROM events WHERE user_id % 3 = 0")
def date_cutoff(spark, sf):
    e = _t(spark, sf, "events")
    timed = e.select("event_id", "user_id", F.when(F.col("user_id") % 3 != 0, F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")).alias("created_ts"))
    return cleaning.filter_since(timed, 1704844800.0).select("event_id", "user_id")


# --- dedupe -------------------------------------------------------------------------------------


@query(f"WITH {POSTS} SELECT id, pos FROM (SELECT *, row_number() OVER (PARTITION BY md5(trim(regexp_replace(lower(title || ' ' || body), '\\s+', ' ', 'g'))) ORDER BY pos) AS n FROM posts) WHERE n = 1")
def dedupe_content(spark, sf):
    return dedupe.exact_first(posts(spark, sf), text.content_hash(F.col("title"), F.col("body"))).select("id", "pos")


@query("SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey")
def dedupe_exact(spark, sf):
    return dedupe.exact_first(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.md5(F.col("o_custkey").cast("string")), "o_orderkey")


@query(f"WITH {POSTS} SELECT id FROM posts WHERE pos % 7 <> 0")
def history_anti_join(spark, sf):
    p = posts(spark, sf)
    return dedupe.drop_known(p, p.where("pos % 7 = 0").select(text.identity_hash(F.col("id"), F.col("url")).alias("hash"))).select("id")


@query("""WITH s AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM documents), e AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.w = b.w AND a.doc_id < b.doc_id AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) GROUP BY 1, 2)
SELECT a, b, round_even(c / (na + nb - c) * 1e6, 0) / 1e6 AS similarity FROM p WHERE c / (na + nb - c) >= 0.7""")
def jaccard_pairs(spark, sf):
    sets = spread(_t(spark, sf, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("node"), text.token_set(F.col("text")).alias("tokens"))
    return dedupe.jaccard_pairs(sets).select("a", "b", text.half_even(F.col("similarity"), 6).alias("similarity"))


@query()
def fuzzy_titles(spark, sf):
    titles = posts(spark, sf).groupBy(F.lower("title").alias("title")).agg(F.min("pos").alias("node"))
    return dedupe.similar_titles(titles)


@query()
def dedupe_greedy(spark, sf):
    return dedupe.greedy_dedupe(spread(posts(spark, sf))).select("id", "pos")


# --- joins --------------------------------------------------------------------------------------


@query(f"WITH {CLUSTERED} SELECT id, cluster_id FROM clustered")
def join_clusters(spark, sf):
    return clustered(spark, sf).select("id", "cluster_id")


@query("SELECT c_custkey, coalesce(n_name, 'other') AS category FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 12) n ON c_nationkey = n_nationkey")
def category_annotate(spark, sf):
    named = _t(spark, sf, "nation").where("n_nationkey < 12").select(F.col("n_nationkey").alias("name"), F.col("n_name").alias("category"))
    return ranking.annotate_category(_t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("source_name")), named).select("c_custkey", "category")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark, sf):
    return _t(spark, sf, "customer").join(_t(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey, coalesce(n, 5) AS score FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def left_join_default(spark, sf):
    n = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return _t(spark, sf, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(5)).alias("score"))


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS id, list_reduce(list_transform(list_zip(q, embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)), lambda a, b: a + b) AS d FROM q, embeddings) SELECT query_id, rank, id, round_even(d * 1e6, 0) / 1e6 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::INT AS rank FROM s) WHERE rank <= 5")
def knn(spark, sf):
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = vectors.nearest(e.where("id % 100 = 0").withColumnRenamed("id", "query_id"), e, 5)
    return found.withColumn("distance", text.half_even(F.col("distance"), 6))


# --- aggregations -------------------------------------------------------------------------------

_STATS = CLUSTERED + ", stats AS (SELECT cluster_id, count(*) AS size, min(pos) AS first_pos, avg(score) AS avg_score, avg(comments_count) AS avg_comments, max(score) AS max_score, max(comments_count) AS max_comments, avg(" + " + ".join(f"contains(lower(title), '{k}')::INT" for k in lexicon.PAIN_KEYWORDS) + ") AS avg_keywords, list_sort(list(DISTINCT source)) AS source_mix FROM clustered GROUP BY cluster_id)"
_PAIN = "greatest(0, least(10, round_even(least(avg_score / 10, 5) + least(avg_comments / 7, 3) + least(avg_keywords * 2, 2), 0)))::INT"
_TRACTION = "round_even(least(least(avg_score / 10, 5) + least(avg_comments / 4, 5), 10) * 10, 0) / 10"


@query(f"WITH {_STATS} SELECT cluster_id, size, first_pos, source_mix FROM stats")
def cluster_sizes(spark, sf):
    return _stats(spark, sf).select("cluster_id", "size", "first_pos", "source_mix")


@query(f"WITH {_STATS} SELECT cluster_id, {_PAIN} AS pain, {_TRACTION} AS traction, round_even(least(avg_score / 33.3::DOUBLE, 3) * 1e6 + least(avg_comments / 25, 2) * 1e6 + least(max_score / 100 + max_comments / 100, 3) * 1e6 + CASE WHEN size >= 3 THEN least((size - 2) / 9, 2) ELSE 0 END * 1e6, 0) / 1e6 AS traction_v1, CASE WHEN len(source_mix) >= 3 THEN 1.2::DOUBLE WHEN len(source_mix) = 2 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS bonus FROM stats")
def cluster_scores(spark, sf):
    return _stats(spark, sf).select("cluster_id", scoring.heuristic_pain().alias("pain"), scoring.traction().alias("traction"), text.half_even(scoring.traction_v1(), 6).alias("traction_v1"), scoring.source_bonus(F.col("source_mix")).alias("bonus"))


@query("SELECT n, s, round_even(greatest(0, least(10, 5 + CASE WHEN n = 0 THEN 4 WHEN n = 1 THEN 2 WHEN n = 2 THEN 1 ELSE -1 END + CASE WHEN s > 20 THEN -2 WHEN s > 10 THEN -1 ELSE 1 END)) * 10::DOUBLE, 0) / 10 AS novelty, least(10::DOUBLE, CASE WHEN n = 0 THEN 6 WHEN n <= 2 THEN 5 WHEN n <= 5 THEN 3 ELSE 1 END + CASE s % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END) AS novelty_v1 FROM (SELECT p_partkey % 8 AS n, p_size AS s FROM part)")
def novelty_rules(spark, sf):
    p = _t(spark, sf, "part").select((F.col("p_partkey") % 8).alias("n"), F.col("p_size").alias("s"))
    alternatives = F.array_repeat(F.lit("x"), F.col("n").cast("int"))
    signal = F.get(F.array(F.lit("Would pay now"), F.lit("a budget"), F.lit("maybe"), F.lit("")), F.col("s") % 4)
    return p.select("n", "s", scoring.novelty(alternatives, F.col("s")).alias("novelty"), scoring.novelty_v1(alternatives, signal).alias("novelty_v1"))


_PRIORITY = "round_even(least((8 * 0.7::DOUBLE + heuristic * 0.3::DOUBLE) * (0.30::DOUBLE / w) + traction * (0.25::DOUBLE / w) + 10.0::DOUBLE * (0.15::DOUBLE / w) + 5.0::DOUBLE * (0.20::DOUBLE / w) + 5.0::DOUBLE * (0.10::DOUBLE / w), 10) * 100, 0) / 100"


@query(f"WITH {_STATS}, h AS (SELECT cluster_id, {_PAIN} AS heuristic, {_TRACTION} AS traction, 0.30::DOUBLE + 0.25::DOUBLE + 0.15::DOUBLE + 0.20::DOUBLE + 0.10::DOUBLE AS w, source_mix FROM stats), p AS (SELECT cluster_id, {_PRIORITY} AS priority_score, round_even((0.45::DOUBLE * 8 + 0.25::DOUBLE * heuristic + 0.20::DOUBLE * traction + 0.10::DOUBLE * 10) * CASE WHEN len(source_mix) >= 3 THEN 1.2::DOUBLE WHEN len(source_mix) = 2 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END * 100, 0) / 100 AS priority_v1, round_even(0.6::DOUBLE * 8 + 0.4::DOUBLE * heuristic, 0)::INT AS combined, trunc(8 * 0.7::DOUBLE + heuristic * 0.3::DOUBLE)::INT AS final FROM h) SELECT *, row_number() OVER (ORDER BY priority_score DESC, cluster_id)::INT AS rank FROM p")
def priority_rank(spark, sf):
    h, t, eight = scoring.heuristic_pain(), scoring.traction(), F.lit(8)
    rows = _stats(spark, sf).select("cluster_id", scoring.priority(eight, h, t, F.lit(10.0), 5.0, 5.0).alias("priority_score"), scoring.priority_v1(eight, h, t, F.lit(10.0), F.col("source_mix")).alias("priority_v1"), scoring.combined_pain(eight, h).alias("combined"), scoring.final_pain(eight, h).alias("final"))
    return ranking.rank_by(rows)


@query("SELECT label AS cluster_id, i::INT AS dim, round_even(avg(embedding[i + 1]::DOUBLE) * 1e6, 0) / 1e6 AS x FROM embeddings, generate_series(0, 63) g(i) GROUP BY 1, 2")
def centroids(spark, sf):
    found = vectors.centroids(_t(spark, sf, "embeddings").select(F.col("label").alias("cluster_id"), "embedding"))
    return found.select("cluster_id", F.posexplode("centroid").alias("dim", "x")).select("cluster_id", "dim", text.half_even(F.col("x"), 6).alias("x"))


_CENTROIDS = "c AS (SELECT label AS cluster_id, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(embedding[i + 1]::DOUBLE) AS x FROM embeddings, generate_series(0, 63) g(i) GROUP BY 1, 2) GROUP BY 1)"
_BEST = f"m AS (SELECT cluster_id, max({COSINE.format(a='v', b='h.embedding')}) AS s FROM c, (SELECT embedding FROM embeddings WHERE vec_id % 25 = 3) h GROUP BY 1)"


def _centroids_and_history(spark, sf):
    e = _t(spark, sf, "embeddings")
    return vectors.centroids(e.select(F.col("label").alias("cluster_id"), "embedding")), e.where("vec_id % 25 = 3").select(F.col("embedding").alias("vector"))


@query(f"WITH {_CENTROIDS}, {_BEST} SELECT cluster_id, round_even(greatest(0, least(10, 10 * (1 - s))) * 10, 0) / 10 AS novelty FROM m")
def centroid_novelty(spark, sf):
    return vectors.centroid_novelty(*_centroids_and_history(spark, sf))


@query(f"WITH {_CENTROIDS}, {_BEST} SELECT cluster_id, round_even(s * 1e6, 0) / 1e6 AS max_similarity, round_even(8 * (1 - 0.3::DOUBLE * s) * 1e6, 0) / 1e6 AS adjusted FROM m")
def history_penalty(spark, sf):
    items, past = _centroids_and_history(spark, sf)
    found = vectors.penalized(items.withColumn("priority_score", F.lit(8.0)), past)
    return found.select("cluster_id", text.half_even(F.col("max_similarity"), 6).alias("max_similarity"), text.half_even(F.col("priority_score_adjusted"), 6).alias("adjusted"))


@query(f"WITH {_CENTROIDS}, {_BEST} SELECT round_even(avg(s) * 1e6, 0) / 1e6 AS mean, round_even(max(s) * 1e6, 0) / 1e6 AS max, round_even(min(s) * 1e6, 0) / 1e6 AS min FROM m")
def penalty_summary(spark, sf):
    items, past = _centroids_and_history(spark, sf)
    found = vectors.penalty_summary(vectors.penalized(items.withColumn("priority_score", F.lit(8.0)), past))
    return found.select(*[text.half_even(F.col(c), 6).alias(c) for c in found.columns])


@query("WITH a AS (SELECT event_type AS cluster_id, greatest(0, 1 - greatest((1706659200 - epoch(ts)) / 86400::DOUBLE, 0) / 7) AS f FROM events WHERE user_id % 5 <> 0) SELECT cluster_id, round_even(avg(f) * 100, 0) / 10 AS recency FROM a GROUP BY 1")
def recency(spark, sf):
    e = _t(spark, sf, "events").select(F.col("event_type").alias("cluster_id"), F.when(F.col("user_id") % 5 != 0, F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("created_ts"))
    return scoring.recency(e, 1706659200.0)


_WEEKLY = "weekly AS (SELECT event_type AS cluster_id, date_trunc('week', ts)::DATE AS week, count(*) AS size FROM events GROUP BY 1, 2)"


def _weekly(spark, sf):
    return _t(spark, sf, "events").groupBy(F.col("event_type").alias("cluster_id"), F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.count("*").alias("size"))


@query(f"WITH {_WEEKLY} SELECT cluster_id, week::VARCHAR AS week, size, avg(size) OVER (PARTITION BY cluster_id ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS previous_mean FROM weekly")
def weekly_lookback(spark, sf):
    return history.weekly_lookback(_weekly(spark, sf)).withColumn("week", F.col("week").cast("string"))


_OFFSETS = _WEEKLY + ", o AS (SELECT *, date_diff('week', week, DATE '2024-01-29') AS k FROM weekly)"


@query(f"WITH {_OFFSETS}, now AS (SELECT cluster_id, size FROM o WHERE k = 0), h AS (SELECT * FROM o WHERE k BETWEEN 1 AND 4), n AS (SELECT count(DISTINCT k) AS w FROM h), m AS (SELECT now.cluster_id, now.size, coalesce(p, 0) / w AS mean FROM now LEFT JOIN (SELECT cluster_id, sum(size) AS p FROM h GROUP BY 1) s ON now.cluster_id = s.cluster_id, n) SELECT cluster_id, round_even(100 / (1 + exp(-2 * CASE WHEN mean = 0 THEN 2 ELSE (size - mean) / mean END)), 0) / 10 AS trend FROM m")
def trend_growth(spark, sf):
    w = _weekly(spark, sf).withColumn("week_offset", (F.date_diff(F.lit("2024-01-29").cast("date"), F.col("week")) / 7).cast("int"))
    return scoring.trend_growth(w.where("week_offset = 0").select("cluster_id", "size"), w.where("week_offset > 0").select("week_offset", "cluster_id", "size"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN h ELSE round_even((0.7::DOUBLE * l + 0.3::DOUBLE * greatest(h, 1)) * 10, 0) / 10 END AS trend FROM (SELECT p_partkey, (p_size % 10 + 1)::DOUBLE AS l, (p_partkey % 20) / 2::DOUBLE AS h FROM part)")
def hybrid_trend(spark, sf):
    p = _t(spark, sf, "part")
    llm = F.when(F.col("p_partkey") % 3 != 0, (F.col("p_size") % 10 + 1).cast("double"))
    return p.select("p_partkey", scoring.hybrid_trend(llm, (F.col("p_partkey") % 20) / 2).alias("trend"))


_TERMS = "string_split(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')), ' ')"
_TERM_ROWS = CLUSTERED + f", w AS (SELECT cluster_id, pos, list_filter({_TERMS.format(c='title')}, lambda w: length(w) > 3) || list_filter({_TERMS.format(c='body')}, lambda w: length(w) > 3) AS ws FROM clustered), e AS (SELECT cluster_id, pos, unnest(ws) AS term, unnest(generate_series(1, len(ws))) AS i FROM w), t AS (SELECT cluster_id, term, count(*) AS n, min({{'p': pos, 'a': i}}) AS f FROM e GROUP BY 1, 2)"
_TERM_HISTORY = f"h AS (SELECT term, count(*) AS freq FROM (SELECT unnest(list_filter({_TERMS.format(c='body')}, lambda w: length(w) > 3)) AS term FROM posts WHERE pos % 4 = 0) GROUP BY 1)"


def _term_history(spark, sf):
    return posts(spark, sf).where("pos % 4 = 0").select(F.explode(text.terms(F.col("body"))).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))


@query(f"WITH {_TERM_ROWS}, {_TERM_HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, f) AS k FROM t) SELECT cluster_id, round_even(least(10, avg(1 / (1 + coalesce(freq, 0) / (SELECT sum(freq) FROM h) * 1000)) * 10) * 10, 0) / 10 AS novelty FROM r LEFT JOIN h USING (term) WHERE k <= 20 GROUP BY 1")
def term_novelty(spark, sf):
    c = clustered(spark, sf)
    return scoring.term_novelty(c.select("cluster_id").distinct(), scoring.term_counts(c), _term_history(spark, sf))


@query(f"WITH {_TERM_ROWS}, {_TERM_HISTORY} SELECT term, sum(freq)::BIGINT AS freq FROM (SELECT * FROM h UNION ALL SELECT term, n FROM t) GROUP BY 1 ORDER BY freq DESC, term LIMIT 500")
def term_history_merge(spark, sf):
    current = scoring.term_counts(clustered(spark, sf)).select("term", F.col("n").alias("freq"))
    return history.merge_terms(_term_history(spark, sf), current, 500)


# --- ranks, samples, top-k ----------------------------------------------------------------------


@query(f"WITH {POSTS} SELECT id, pos, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS n FROM posts) WHERE n <= CASE source WHEN 'src0' THEN 5 WHEN 'src1' THEN 7 ELSE 100000 END")
def quota_sample(spark, sf):
    quotas = spark.createDataFrame([("src0", 5), ("src1", 7), ("src2", 0)], "category string, quota int")
    return ranking.apply_quotas(posts(spark, sf).withColumn("category", F.col("source")), quotas).select("id", "pos", "source")


@query("WITH s AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'reddit' ELSE 'stackexchange' END AS type, n_name AS category, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey), q AS (SELECT n_name AS category, n_nationkey * 10 AS quota FROM nation WHERE n_nationkey BETWEEN 3 AND 15), w AS (SELECT sum(quota) AS whole FROM q) SELECT type, s.category, floor(800 * (coalesce(any_value(quota), 50) / any_value(whole)) * CASE type WHEN 'reddit' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END)::BIGINT AS total, floor(floor(800 * (coalesce(any_value(quota), 50) / any_value(whole)) * CASE type WHEN 'reddit' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END) / count(*))::BIGINT AS per_source, list_sort(list(name)) AS sources FROM s LEFT JOIN q ON s.category = q.category, w GROUP BY type, s.category")
def sampling_plan(spark, sf):
    n = _t(spark, sf, "nation")
    s = _t(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.when(F.col("s_suppkey") % 2 == 0, "reddit").otherwise("stackexchange").alias("type"), F.col("n_name").alias("category"), F.col("s_name").alias("name"))
    return ranking.sampling_plan(s, n.where("n_nationkey between 3 and 15").select(F.col("n_name").alias("category"), (F.col("n_nationkey") * 10).alias("quota")))


@query("SELECT 'all' AS type, n_regionkey::VARCHAR AS category, list_sort(list(n_name)) AS names FROM nation GROUP BY 2")
def group_sources(spark, sf):
    return ranking.sources_by_category(_t(spark, sf, "nation").select(F.lit("all").alias("type"), F.col("n_regionkey").cast("string").alias("category"), F.col("n_name").alias("name")))


@query(f"WITH {CLUSTERED}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pos) AS n FROM clustered) SELECT cluster_id, list(id ORDER BY pos) AS ids FROM r WHERE n <= 5 GROUP BY 1")
def cluster_examples(spark, sf):
    return ranking.examples(clustered(spark, sf)).select("cluster_id", F.transform("examples", lambda e: e["id"]).alias("ids"))


@query(f"WITH {_STATS}, r AS (SELECT cluster_id, row_number() OVER (ORDER BY {_PAIN} DESC, first_pos)::INT AS heuristic_rank FROM stats) SELECT *, CASE WHEN heuristic_rank <= 5 THEN 'heavy' ELSE 'light' END AS tier FROM r")
def heavy_tiers(spark, sf):
    return ranking.tiers(_stats(spark, sf).withColumn("heuristic_score", scoring.heuristic_pain())).select("cluster_id", "heuristic_rank", "tier")


@query(f"WITH {POSTS} SELECT id, score FROM posts ORDER BY score DESC, pos LIMIT 5")
def top_posts(spark, sf):
    return posts(spark, sf).orderBy(F.col("score").desc(), "pos").limit(5).select("id", "score")


@query("SELECT vec_id AS seq, label FROM embeddings ORDER BY vec_id DESC LIMIT 100")
def cap_centroids(spark, sf):
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), "label")
    return history.cap_centroids(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"))


# --- store and history --------------------------------------------------------------------------


@query(f"WITH {INSIGHTS} SELECT id, priority_score, sector FROM insights WHERE sector = '1-URGENT' AND priority_score >= 1000 AND founder_fit_score >= 4 AND monetizable = 1 ORDER BY priority_score DESC, id LIMIT 50")
def query_insights(spark, sf):
    return store.query_insights(_insights(spark, sf), "1-URGENT", 1000.0, 4.0, True).select("id", "priority_score", "sector")


@query(f"WITH {INSIGHTS} SELECT id, rank FROM insights WHERE run_id = 'O' ORDER BY rank LIMIT 20")
def run_insights(spark, sf):
    return store.run_insights(_insights(spark, sf), "O", 20).select("id", "rank")


@query(f"WITH {INSIGHTS} SELECT id, rank FROM (SELECT * FROM insights WHERE run_id = 'O' ORDER BY rank LIMIT 20) WHERE sector = '1-URGENT'")
def limit_then_filter(spark, sf):
    return store.limit_then_filter(_insights(spark, sf), "O", 20, "1-URGENT").select("id", "rank")


@query(f"WITH {INSIGHTS} SELECT id, rank FROM insights WHERE run_id = 'O' AND sector = '1-URGENT' ORDER BY rank LIMIT 20")
def filter_then_limit(spark, sf):
    return store.filter_then_limit(_insights(spark, sf), "O", 20, "1-URGENT").select("id", "rank")


@query(f"WITH {INSIGHTS} SELECT id, created_at FROM insights ORDER BY created_at DESC, id DESC LIMIT 1")
def latest_run(spark, sf):
    return store.latest_run(_insights(spark, sf)).select("id", "created_at")


@query(f"WITH {INSIGHTS} SELECT id, created_at FROM insights ORDER BY created_at DESC, id DESC LIMIT 10")
def list_runs(spark, sf):
    return store.list_runs(_insights(spark, sf)).select("id", "created_at")


@query(f"WITH {INSIGHTS} SELECT id, rank, sector FROM insights WHERE id = '7'")
def insight_by_id(spark, sf):
    return store.insight(_insights(spark, sf), "7").select("id", "rank", "sector")


@query("SELECT event_id AS id, user_id::VARCHAR AS insight_id, ts AS created_at FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC")
def explorations(spark, sf):
    e = _t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("insight_id"), F.col("ts").alias("created_at"))
    return store.explorations(e, "7")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 3 THEN -1::DOUBLE ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 4 <> 1 OR o_orderkey % 10 = 3")
def upsert(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return store.upsert(o.where("id % 4 <> 1"), o.where("id % 10 = 3").withColumn("v", F.lit(-1.0)), "id")


def _entries(spark, sf):
    return _t(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("sector"), "o_orderkey")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey FROM orders WHERE o_orderdate::DATE >= DATE '1997-06-01' - 30")
def history_retention(spark, sf):
    return history.retain(_entries(spark, sf), "1997-06-01", 30).select("date", "o_orderkey")


@query("SELECT count(*) AS total, strftime(min(o_orderdate), '%Y-%m-%d') AS oldest, strftime(max(o_orderdate), '%Y-%m-%d') AS newest FROM orders")
def history_stats(spark, sf):
    return history.history_stats(_entries(spark, sf))


@query("SELECT o_orderpriority AS sector, count(*) AS n FROM orders GROUP BY 1")
def history_sectors(spark, sf):
    return history.history_sectors(_entries(spark, sf))


@query("SELECT hash, title, max(t) AS timestamp FROM (SELECT (user_id % 50)::VARCHAR AS hash, event_type AS title, epoch(ts)::DOUBLE AS t, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts DESC, event_id) AS n FROM events WHERE epoch(ts) >= 1706659200 - 10 * 86400 AND event_id % 2 = 0 OR event_id % 2 = 1) WHERE n = 1 GROUP BY 1, 2")
def dedupe_history_merge(spark, sf):
    e = _t(spark, sf, "events").select((F.col("user_id") % 50).cast("string").alias("hash"), F.lit("").alias("content_hash"), F.col("event_type").alias("title"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"), "event_id")
    return history.merge_dedupe_history(e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 2 = 1").drop("event_id"), 1706659200.0, 10).select("hash", "title", "timestamp")


@query(f"WITH {_OFFSETS} SELECT (k + 1)::INT AS week_offset, cluster_id, size FROM o WHERE k BETWEEN 1 AND 2 UNION ALL SELECT 1, cluster_id, size FROM o WHERE k = 0")
def shift_weeks(spark, sf):
    w = _weekly(spark, sf).withColumn("week_offset", (F.date_diff(F.lit("2024-01-29").cast("date"), F.col("week")) / 7).cast("int"))
    return history.shift_weeks(w.where("week_offset > 0").select("week_offset", "cluster_id", "size"), w.where("week_offset = 0"), 3)


# --- parsing, feeds, sinks ----------------------------------------------------------------------

@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_keys(props) AS keys FROM events")
def json_fields(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.json_object_keys("props").alias("keys"))


@query("SELECT conv_id, CASE WHEN n % 2 = 0 THEN 'finance_accounting' ELSE 'other' END AS sector FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)")
def sector_labels(spark, sf):
    n = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    said = F.when(F.col("n") % 2 == 0, "it is finance_accounting, I think").otherwise("no idea")
    return n.select("conv_id", parsing.valid_sector(F.lit(None).cast("string"), said).alias("sector"))


@query(f"WITH {POSTS} SELECT source, count(*) AS n FROM (SELECT source FROM posts WHERE pos % 2 = 0 UNION ALL SELECT source FROM posts WHERE pos % 3 = 0) GROUP BY 1")
def union_sources(spark, sf):
    p = posts(spark, sf)
    return feeds.union_sources(p.where("pos % 2 = 0"), p.where("pos % 3 = 0")).groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {POSTS} SELECT id, title, 'reddit' AS source, body, score::BIGINT AS score FROM posts")
def post_schema(spark, sf):
    old = posts(spark, sf).select("id", "title", F.col("body").alias("selftext"), "score", F.col("comments_count").alias("num_comments"))
    return as_posts(old).select("id", "title", "source", "body", "score")


@query(f"WITH {POSTS}, n AS (SELECT min(score) AS lo, max(score) AS hi FROM posts) SELECT id, (score - lo) / (hi - lo) AS s FROM posts, n")
def min_max_scale(spark, sf):
    return vec.scaled(posts(spark, sf).select("id", "score"), "score", "s").select("id", "s")


# --- whole plans --------------------------------------------------------------------------------


@query()
def prefilter(spark, sf):
    return scan.prefilter(posts(spark, sf)).groupBy("lang", "intent", F.col("wtp_signals.has_wtp").alias("has_wtp")).agg(F.count("*").alias("n"))


@query(f"WITH {POSTS}, t AS (SELECT sum(length(title || ' ' || body) // 4)::BIGINT AS n FROM posts) SELECT n AS embed_tokens, n / 1000::DOUBLE * 0.00002::DOUBLE AS embed_cost_usd, 10 * (1.2::DOUBLE * 0.00015::DOUBLE + 0.4::DOUBLE * 0.0006::DOUBLE) AS summary_cost_usd, n / 1000::DOUBLE * 0.00002::DOUBLE + 10 * (1.2::DOUBLE * 0.00015::DOUBLE + 0.4::DOUBLE * 0.0006::DOUBLE) AS total_cost_usd FROM t")
def estimate(spark, sf):
    prices = spark.createDataFrame([(k, *v) for k, v in scan.PRICES.items()], "model string, input double, output double")
    return scan.estimate(posts(spark, sf), prices)


def _ranked(spark, sf):
    return scan.scan(clustered(spark, sf))


@query()
def scan_insights(spark, sf):
    return _ranked(spark, sf).select("cluster_id", "rank", "mmr_rank", "priority_score", "heuristic_score", "traction_score", "novelty_score", "wtp_score", "sector", "size")


@query()
def export_csv(spark, sf):
    return sinks.insights_csv(_ranked(spark, sf))


@query()
def export_json(spark, sf):
    """The document of a scan's results, and what is read back from it."""
    whole = sinks.results_document(sinks.insight_documents(_ranked(spark, sf)), _t(spark, sf, "documents").agg(F.count("*").alias("posts")))
    read = lambda path, kind: F.get_json_object("value", path).cast(kind)
    return whole.select(
        read("$.statistics.posts", "long").alias("posts"), F.json_array_length(F.get_json_object("value", "$.insights")).alias("insights"), read("$.insights[0].summary.title", "string").alias("title"), read("$.insights[0].priority_score", "double").alias("priority_score"),
        read("$.insights[1].cluster_id", "int").alias("second"), read("$.insights[1].summary.context", "string").alias("second_context"), read("$.insights[1].traction_score", "double").alias("second_traction"), read("$.insights[1].summary.pain_score_llm", "int").alias("second_pain"),
    )


@query()
def mmr(spark, sf):
    c, _ = _centroids_and_history(spark, sf)
    return ranking.mmr(c.select("cluster_id", F.col("size").cast("double").alias("priority_score"), F.col("centroid").alias("embedding")), 5).select("cluster_id", "mmr_rank")


@query()
def mmr_by_sector(spark, sf):
    c, _ = _centroids_and_history(spark, sf)
    rows = c.select("cluster_id", F.col("size").cast("double").alias("priority_score"), F.col("centroid").alias("embedding"), F.concat(F.lit("s"), (F.col("cluster_id") % 3).cast("string")).alias("sector"))
    return ranking.mmr_by_sector(rows).select("cluster_id", "sector", "mmr_rank")


@query()
def kmeans(spark, sf):
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.cluster(e, 10).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query()
def summaries(spark, sf):
    c = clustered(spark, sf)
    t = ranking.tiers(_stats(spark, sf).withColumn("heuristic_score", scoring.heuristic_pain()))
    return scan.summarize(c, t, scan.Settings(), providers.extractive_stub, providers.extractive_stub).select("cluster_id", "title", "monetizable", "pain_score_llm")


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship query: clusters by priority."""
    return priority_rank(spark, sf).where("rank <= 10")
