"""Queries of feeds, files, sinks, the store and model steps over rows of the driver's tables.

What the tables lack (payloads of services, answers of models) is made of their rows, all of them. Round trips write
under the session's shared folder and read back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon, parsing, text
from ..operators import cleaning, ranking
from ..sources import feeds, files, sinks, store
from ..tables import Tables, spread
from . import providers, scan
from .queries import _CENTROIDS, _VALUES, CLUSTERED, COSINE, ORACLE_SQL, POSTS, TOPICS, _detector_sql, _intent_sql, _quoted, _samples, _t, clustered, posts, query

# --- feeds --------------------------------------------------------------------------------------


def _payloads(spark: SparkSession, sf: str, **fields: Column | str) -> DataFrame:
    """Documents as payloads of a service; a string is an expression over their columns."""
    columns = [(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()]
    return _t(spark, sf, "documents").select(F.to_json(F.struct(*columns)).alias("payload"), F.lit("ux").alias("site"))


_DAY = "concat('2024-01-', lpad(cast(doc_id % 28 + 1 as string), 2, '0'), 'T00:00:00Z')"
_EPOCH = "epoch(make_date(2024, 1, (doc_id % 28 + 1)::INT))::DOUBLE"
_TITLE = "substring(text, 1, 60)"
_SINCE = 1704844800.0


def _reddit(spark, sf):
    return _payloads(spark, sf, id="concat('r', doc_id)", title=_TITLE, selftext="text", created_utc="doc_id * 10", permalink="concat('/r/x/', doc_id)", score="n_chars % 50", num_comments="doc_id % 7")


def _entries(spark, sf):
    return _payloads(spark, sf, link="concat('http://e/', doc_id)", title="text", summary="if(doc_id % 2 = 0, text, '')", description="concat('d', doc_id)", published=f"if(doc_id % 5 = 0, null, {_DAY})")


def _entry_sql(prefix: str, source: str, title: str, body: str, score: str) -> str:
    return f"""SELECT '{prefix}' || substr(md5('http://e/' || doc_id), 1, 16) AS id, '{source}' AS source, {title} AS title, {body} AS body, CASE WHEN doc_id % 5 <> 0 THEN {_EPOCH} END AS created_ts,
  'http://e/' || doc_id AS url, {score}::BIGINT AS score FROM documents WHERE doc_id % 5 = 0 OR {_EPOCH} >= {_SINCE}"""


_BODY = "CASE WHEN doc_id % 2 = 0 AND text <> '' THEN text ELSE 'd' || doc_id END"
_ENTRY = ("id", "source", "title", "body", "created_ts", "url", "score")


@query("SELECT 'r' || doc_id AS id, 'reddit' AS source, substr(text, 1, 60) AS title, 'https://reddit.com/r/x/' || doc_id AS url, n_chars % 50 AS score, doc_id % 7 AS comments_count FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'free')")
def reddit_feed(spark, sf):
    return feeds.reddit_posts(_reddit(spark, sf), ["license", "free"]).select("id", "source", "title", "url", "score", "comments_count")


@query("SELECT 'hn_' || doc_id AS id, substr(text, 1, 60) AS title, (doc_id * 1000)::DOUBLE AS created_ts, n_chars % 50 AS score FROM documents WHERE n_chars % 50 > 20 AND doc_id * 1000 >= 50000")
def hn_feed(spark, sf):
    items = _payloads(spark, sf, objectID="cast(doc_id as string)", title=_TITLE, story_text="text", created_at_i="doc_id * 1000", points="n_chars % 50", num_comments="doc_id % 7")
    return feeds.hn_posts(items, 20, 50000.0).select("id", "title", "created_ts", "score")


@query(_entry_sql("rss_", "rss", "text", _BODY, "0"))
def rss_feed(spark, sf):
    return feeds.rss_posts(_entries(spark, sf), _SINCE).select(*_ENTRY)


@query(_entry_sql("ih_", "rss", "substr(text, 1, 300)", f"substr({_BODY}, 1, 5000)", "NULL"))
def indiehackers_feed(spark, sf):
    return feeds.indiehackers_posts(_entries(spark, sf), _SINCE).select(*_ENTRY)


@query(_entry_sql("ntr_", "x", "substr(text, 1, 300)", f"substr({_BODY}, 1, 5000)", "NULL"))
def nitter_feed(spark, sf):
    return feeds.nitter_posts(_entries(spark, sf), _SINCE).select(*_ENTRY)


@query("SELECT 'se_ux_' || doc_id AS id, substr(text, 1, 60) AS title, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '...' ELSE text END AS body, n_chars % 50 AS score FROM documents WHERE n_chars % 50 >= 10")
def stackexchange_feed(spark, sf):
    items = _payloads(spark, sf, question_id="doc_id", title=_TITLE, body_markdown="if(doc_id % 2 = 0, text, null)", body="text", creation_date="doc_id", score="n_chars % 50", answer_count="doc_id % 7")
    return feeds.stackexchange_posts(items, 10).select("id", "title", "body", "score")


@query("SELECT 'gh_' || doc_id AS id, 'o/' || doc_id AS title, substr(text, 1, 100) || chr(10) || chr(10) || 'Language: ' || CASE WHEN doc_id % 3 = 0 THEN 'None' ELSE 'Go' END || CASE WHEN doc_id % 2 = 1 THEN chr(10) || 'Topics: a, b' ELSE '' END AS body, n_chars % 50 AS score, CASE WHEN doc_id % 3 <> 0 THEN 'Go' END AS lang FROM documents WHERE n_chars % 50 >= 10")
def github_feed(spark, sf):
    items = _payloads(spark, sf, id="cast(doc_id as string)", full_name="concat('o/', doc_id)", description="substring(text, 1, 100)", language="if(doc_id % 3 = 0, null, 'Go')", topics="if(doc_id % 2 = 1, array('a', 'b'), null)", created_at=_DAY, stargazers_count="n_chars % 50", open_issues_count="doc_id % 7")
    return feeds.github_posts(items).select("id", "title", "body", "score", "lang")


@query("SELECT 'yt_' || doc_id AS id, substr(text, 1, 60) AS title, CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE doc_id % 20 * 1000 END AS score, 'Channel: c | Duration: 1:00 | Views: ' || CASE WHEN doc_id % 2 = 0 THEN n_chars || ' views' ELSE doc_id % 20 || 'K views' END AS body FROM documents WHERE CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE doc_id % 20 * 1000 END >= 1000")
def youtube_feed(spark, sf):
    items = _payloads(spark, sf, id="cast(doc_id as string)", title=_TITLE, channel="'c'", duration="'1:00'", views="if(doc_id % 2 = 0, concat(n_chars, ' views'), concat(doc_id % 20, 'K views'))")
    return feeds.youtube_posts(items, 1000).select("id", "title", "score", "body")


@query("SELECT 'ph_' || doc_id AS id, 'n' || doc_id || ' - ' || substr(text, 1, 60) AS title, 'd' || doc_id || chr(10) || chr(10) || 'Top Comments:' || chr(10) || 'Comment: ' || substr(text, 1, 200) || chr(10) || 'Comment: x' || doc_id AS body, n_chars % 50 AS score FROM documents WHERE doc_id % 3 = 0")
def producthunt_feed(spark, sf):
    topic = "named_struct('edges', array(named_struct('node', named_struct('name', if(doc_id % 3 = 0, 'Tech', 'Art')))))"
    said = "named_struct('edges', array(named_struct('node', named_struct('body', text)), named_struct('node', named_struct('body', concat('x', doc_id)))))"
    items = _payloads(spark, sf, id="cast(doc_id as string)", name="concat('n', doc_id)", tagline=_TITLE, description="concat('d', doc_id)", url="concat('http://p/', doc_id)", createdAt=_DAY, votesCount="n_chars % 50", commentsCount="2", topics=topic, comments=said)
    return feeds.producthunt_posts(items, ["tech"]).select("id", "title", "body", "score")


@query(f"SELECT source, count(*) AS n FROM (SELECT 'reddit' AS source FROM documents WHERE n_chars % 50 >= 5 UNION ALL SELECT 'rss' FROM documents WHERE doc_id % 5 = 0 OR {_EPOCH} >= {_SINCE}) GROUP BY 1")
def daily_booster(spark, sf):
    def down() -> DataFrame:
        raise OSError("the feed does not answer")

    found = feeds.booster(spark, lambda: feeds.reddit_posts(_reddit(spark, sf)), lambda: feeds.indiehackers_posts(_entries(spark, sf), _SINCE), down)
    return found.groupBy("source").agg(F.count("*").alias("n"))


@query()
def collect_all(spark, sf):
    """Language, intent, score and comments, then dedupe: greedy choices have no SQL form."""
    return scan.collect_all(posts(spark, sf), ["en", "fr"], None, 10, 1).select("id", "lang", "intent")


# --- files --------------------------------------------------------------------------------------


def _root(spark: SparkSession, name: str) -> str:
    return Tables(spark, name).root


def _as_dump(spark, sf):
    return posts(spark, sf).select("id", F.lit("hn").alias("source"), "title", F.col("body").alias("selftext"), "score", F.col("comments_count").alias("num_comments"), "pos")


@query(f"WITH {POSTS} SELECT id, 'hn' AS source, title, body, score, comments_count FROM posts")
def json_scan(spark, sf):
    path = _root(spark, "scan") + "/posts.jsonl"
    sinks.write_json(_as_dump(spark, sf).drop("pos"), path)
    return files.read_posts(spark, path).select("id", "source", "title", "body", "score", "comments_count")


@query(f"WITH {POSTS} SELECT id, title, score FROM posts WHERE pos % 10 NOT IN (0, 3)")
def json_scan_tolerant(spark, sf):
    """Lines that are no JSON, and rows without a title, go."""
    path = _root(spark, "scan") + "/posts.jsonl"
    rows = _as_dump(spark, sf).withColumn("title", F.when(F.col("pos") % 10 != 3, F.col("title")))
    rows.select(F.when(F.col("pos") % 10 == 0, "{broken").otherwise(F.to_json(F.struct("*"))).alias("value")).write.text(path)
    return files.read_posts(spark, path, tolerant=True).select("id", "title", "score")


@query(f"WITH {POSTS} SELECT 'posts_' || source || '_20240131_000000.json' AS dump, count(*) AS n FROM posts GROUP BY 1")
def raw_dumps(spark, sf):
    path = _root(spark, "dumps")
    sinks.write_dumps(posts(spark, sf), path, "20240131_000000")
    return spark.read.json(path).groupBy("dump").agg(F.count("*").alias("n"))


@query("SELECT trim(v) AS value FROM (SELECT CASE doc_id % 4 WHEN 0 THEN '# note' WHEN 1 THEN '' WHEN 2 THEN '  word' || doc_id || '  ' ELSE 'word' || doc_id END AS v FROM documents) WHERE trim(v) <> '' AND NOT starts_with(trim(v), '#')")
def line_lists(spark, sf):
    path = _root(spark, "lines")
    line = "case doc_id % 4 when 0 then '# note' when 1 then '' when 2 then concat('  word', doc_id, '  ') else concat('word', doc_id) end"
    _t(spark, sf, "documents").select(F.expr(line).alias("value")).write.text(path)
    return files.read_lines(spark, path)


@query("SELECT r_name AS name FROM region")
def list_packs(spark, sf):
    folder = _root(spark, "packs")
    for row in _t(spark, sf, "region").select("r_name").collect():  # five rows
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{row['r_name']}.txt")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path).close()
    return files.list_packs(spark, folder)


_KIND = "CASE WHEN n_nationkey % 2 = 0 THEN 'reddit' ELSE 'stackexchange' END"


@query(f"SELECT {_KIND} AS type, n_name AS name, 'cat' || n_regionkey AS category, (n_nationkey + 1)::INT AS max_posts FROM nation UNION ALL SELECT 'quota', 'cat' || r_regionkey, 'cat' || r_regionkey, (r_regionkey * 10)::INT FROM region")
def sources_config(spark, sf):
    path, nation = _root(spark, "config"), _t(spark, sf, "nation")
    line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    parts = []
    for section, odd, key, size in (("reddit_sources", 0, "name", "max_posts"), ("stackexchange_sources", 1, "site", "max_questions")):
        parts.append(spark.range(1).select(F.lit(2 * odd).alias("part"), F.lit(0).cast("long").alias("at"), F.array(F.lit(f"{section}:")).alias("lines")))
        said = F.array(line(f'  - {key}: "', F.col("n_name"), '"  # a source'), line("    category: cat", F.col("n_regionkey").cast("string")), line(f"    {size}: ", (F.col("n_nationkey") + 1).cast("string")))
        parts.append(nation.where(F.col("n_nationkey") % 2 == odd).select(F.lit(2 * odd + 1), F.col("n_nationkey").cast("long"), said))
    parts.append(spark.range(1).select(F.lit(4), F.lit(0).cast("long"), F.array(F.lit("# quotas"), F.lit("category_quotas:"))))
    quota = line("  cat", F.col("r_regionkey").cast("string"), ": ", (F.col("r_regionkey") * 10).cast("string"))
    parts.append(_t(spark, sf, "region").select(F.lit(5), F.col("r_regionkey").cast("long"), F.array(quota)))
    lines = reduce(DataFrame.union, parts).select("part", "at", F.posexplode("lines").alias("k", "value"))
    lines.repartition(1).sortWithinPartitions("part", "at", "k").select("value").write.text(path)  # a file of settings
    sources, quotas = files.read_sources_config(spark, path)
    return sources.union(quotas.select(F.lit("quota"), "category", "category", "quota"))


@query(f"WITH {CLUSTERED} SELECT id, title, len(embedding)::INT AS dimensions, round_even(embedding[1]::DOUBLE * 1e6, 0) / 1e6 AS first FROM clustered")
def embedding_files(spark, sf):
    path = _root(spark, "vectors")
    sinks.save_embeddings(clustered(spark, sf), path)
    saved = files.read_embeddings(spark, f"{path}/embeddings").join(spark.read.parquet(f"{path}/meta"), "id")
    return saved.select("id", "title", F.size("embedding").alias("dimensions"), text.half_even(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey AS cluster_id, o_orderpriority AS sector FROM orders WHERE o_orderkey % 9 <> 0 AND strftime(o_orderdate, '%Y-%m-%d') >= '1996-01-01'")
def history_file(spark, sf):
    """JSON lines, some unreadable."""
    path = _root(spark, "past") + "/history.jsonl"
    entry = F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderkey").alias("cluster_id"), F.col("o_orderpriority").alias("sector")))
    _t(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 9 == 0, "{").otherwise(entry).alias("value")).write.text(path)
    return files.read_history(spark, path, "date string, cluster_id long, sector string", "1996-01-01")


# --- sinks and the store ------------------------------------------------------------------------


def _export(spark, sf):
    """Suppliers as ranked insights."""
    k, tenths = F.col("s_suppkey").cast("int"), (F.col("s_suppkey") % 100) / 10.0
    url = lambda x: F.struct(F.concat(F.lit(f"http://{x}/"), k.cast("string")).alias("url"))
    return _t(spark, sf, "supplier").select(
        k.alias("rank"), F.when(k % 3 != 0, k).alias("mmr_rank"), F.col("s_acctbal").alias("priority_score"), F.when(k % 4 != 0, F.col("s_acctbal")).alias("priority_score_adjusted"), k.alias("cluster_id"), (k % 30).alias("size"),
        F.lit("dev_tools").alias("sector"), F.col("s_name").alias("title"), F.concat(F.lit("p"), k.cast("string")).alias("problem"), F.lit("user").alias("persona"), F.lit(None).cast("string").alias("jtbd"), F.lit("c").alias("context"),
        (k % 2 == 0).alias("monetizable"), F.lit("m").alias("mvp"), F.array(F.lit("a"), F.lit(""), F.lit("b")).alias("alternatives"), F.lit("w").alias("willingness_to_pay_signal"), (k % 11).alias("pain_score_llm"), (k % 7).alias("pain_score_final"),
        *[tenths.alias(n) for n in ("heuristic_score", "traction_score", "novelty_score", "trend_score", "founder_fit_score")],
        F.array(url("e"), F.struct(F.lit("").alias("url")), url("f"), url("g")).alias("examples"), F.array(F.lit("hn"), F.lit("rss")).alias("source_mix"), F.array(F.lit("x")).alias("keywords_matched"),
    )


def _blank(value: str, shown: str) -> str:
    return f"CASE WHEN {value} = 0 OR {value} IS NULL THEN '' ELSE {shown} END"


_KEY, _TENTH = "s_suppkey", "(s_suppkey % 100) / 10::DOUBLE"
_SCORES = ("heuristic_score", "traction_score", "novelty_score", "trend_score", "founder_fit_score")


@query(f"""SELECT {_KEY}::VARCHAR AS rank, CASE WHEN {_KEY} % 3 <> 0 THEN {_KEY}::VARCHAR ELSE '' END AS mmr_rank, printf('%.2f', s_acctbal) AS priority_score,
  CASE WHEN {_KEY} % 4 <> 0 AND s_acctbal <> 0 THEN printf('%.2f', s_acctbal) ELSE '' END AS priority_score_adjusted, {_KEY}::VARCHAR AS cluster_id, ({_KEY} % 30)::VARCHAR AS size, 'dev_tools' AS sector, s_name AS title,
  'p' || {_KEY} AS problem, 'user' AS persona, '' AS jtbd, 'c' AS context, CASE WHEN {_KEY} % 2 = 0 THEN 'Yes' ELSE 'No' END AS monetizable, 'm' AS mvp, 'a, b' AS alternatives, 'w' AS willingness_to_pay_signal,
  {_blank(f'{_KEY} % 11', f'({_KEY} % 11)::VARCHAR')} AS pain_score_llm, {_blank(f'{_KEY} % 7', f'({_KEY} % 7)::VARCHAR')} AS pain_score_final, {', '.join(f"{_blank(_TENTH, f"printf('%.1f', {_TENTH})")} AS {n}" for n in _SCORES)},
  'http://e/' || {_KEY} || ', http://f/' || {_KEY} AS example_urls, 'hn, rss' AS source_mix, 'x' AS keywords_matched FROM supplier""")
def csv_columns(spark, sf):
    return sinks.insights_csv(_export(spark, sf))


@query(f"""SELECT {_KEY}::VARCHAR AS rank, {_KEY}::VARCHAR AS cluster_id, ({_KEY} % 30)::VARCHAR AS size, s_acctbal::VARCHAR AS priority_score, s_name AS title, 'p' || {_KEY} AS problem, 'user' AS persona, NULL::VARCHAR AS jtbd, 'c' AS context,
  CASE WHEN {_KEY} % 2 = 0 THEN 'True' ELSE 'False' END AS monetizable, 'm' AS mvp, 'a, , b' AS alternatives, 'w' AS willingness_to_pay_signal, {_blank(f'{_KEY} % 11', f'({_KEY} % 11)::VARCHAR')} AS pain_score_llm,
  {_blank(f'{_KEY} % 7', f'({_KEY} % 7)::VARCHAR')} AS pain_score_final, {', '.join(f"{_blank(_TENTH, f'({_TENTH})::VARCHAR')} AS {n}" for n in _SCORES)}, 'x' AS keywords_matched, 'hn, rss' AS source_mix,
  'http://e/' || {_KEY} || ' |  | http://f/' || {_KEY} AS example_urls FROM supplier""")
def csv_enriched(spark, sf):
    return sinks.enriched_csv(_export(spark, sf))


@query(f"""SELECT {_KEY}::INT AS cluster_id, ({_KEY} % 30)::INT AS size, s_name AS title, 'p' || {_KEY} AS description, CASE WHEN {_KEY} % 2 = 0 THEN 'True' ELSE 'False' END AS monetizable, 'Persona: user. Context: c' AS justification, 'm' AS mvp,
  {_blank(f'{_KEY} % 11', f'({_KEY} % 11)::VARCHAR')} AS pain_score_llm, {_blank(f'{_KEY} % 7', f'({_KEY} % 7)::VARCHAR')} AS pain_score_final, 'http://e/' || {_KEY} || ' |  | http://f/' || {_KEY} AS example_urls, 'reddit' AS source FROM supplier""")
def csv_legacy(spark, sf):
    return sinks.legacy_csv(_export(spark, sf))


@query(f"SELECT {_KEY}::INT AS rank, s_name AS title, 'p' || {_KEY} AS problem, CASE WHEN {_KEY} % 2 = 0 THEN 'true' ELSE 'false' END AS monetizable, ({_KEY} % 30)::VARCHAR AS size, 'http://f/' || {_KEY} AS third_url, 'Persona: user. Context: c' AS justification FROM supplier")
def insight_json(spark, sf):
    """Fields read back from both JSON forms."""
    rows = _export(spark, sf)
    found = sinks.insight_documents(rows).join(sinks.legacy_documents(rows).withColumnRenamed("document", "legacy"), "rank")
    read = lambda c, path: F.get_json_object(c, path)
    return found.select("rank", read("document", "$.summary.title").alias("title"), read("document", "$.summary.problem").alias("problem"), read("document", "$.summary.monetizable").alias("monetizable"), read("document", "$.summary.size").alias("size"), read("document", "$.examples[2].url").alias("third_url"), read("legacy", "$.summary.justification").alias("justification"))


@query(f"SELECT {_KEY}::INT AS rank, CASE WHEN {_KEY} % 3 <> 0 THEN {_KEY}::INT END AS mmr_rank, s_name AS title, 'dev_tools' AS sector, s_acctbal AS priority_score, CASE WHEN {_KEY} % 4 <> 0 THEN s_acctbal END AS priority_score_adjusted, {_TENTH} AS trend_score, {_TENTH} AS founder_fit_score FROM supplier")
def run_summary(spark, sf):
    return sinks.summary_json(_export(spark, sf))


@query("SELECT 'run_' || r_regionkey AS id, CASE WHEN r_regionkey % 2 = 0 THEN 'deep' ELSE 'light' END AS mode, (r_regionkey * 3)::INT AS nb_insights FROM region")
def store_runs(spark, sf):
    kept = store.Store(spark, _root(spark, "store"))
    kept.init()
    r = _t(spark, sf, "region").withColumn("id", F.concat(F.lit("run_"), "r_regionkey"))
    fields = spark.createDataFrame([], store.RUNS).schema
    rows = r.withColumns({"mode": F.when(F.col("r_regionkey") % 2 == 0, "deep").otherwise("light"), "nb_insights": F.col("r_regionkey") * 3, "created_at": F.timestamp_seconds(F.col("r_regionkey") * 60)})
    rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    kept.save_run(rows.where("id < 'run_3'"))
    kept.save_run(rows.where("id >= 'run_3'"))
    return kept.table("runs").select("id", "mode", "nb_insights")


@query(f"SELECT 'r1_cluster_' || {_KEY} AS id, {_KEY}::INT AS rank, CASE WHEN {_KEY} % 2 = 0 THEN 'new' ELSE s_name END AS title, ({_KEY} % 2 = 0)::INT AS monetizable, ['http://e/' || {_KEY}, 'http://f/' || {_KEY}] AS example_urls FROM supplier")
def store_insights(spark, sf):
    """Saved, then half of them saved again."""
    kept, rows = store.Store(spark, _root(spark, "store")), _export(spark, sf)
    kept.init()
    kept.save_insights("r1", rows)
    kept.save_insights("r1", rows.where("cluster_id % 2 = 0").withColumn("title", F.lit("new")))
    return kept.table("insights").select("id", "rank", "title", "monetizable", "example_urls")


@query("WITH e AS (SELECT c_custkey AS k, c_custkey % 2 AS odd FROM customer) SELECT (CASE WHEN odd = 1 THEN (SELECT count(*) FROM e WHERE odd = 0) ELSE 0 END + row_number() OVER (PARTITION BY odd ORDER BY k))::BIGINT AS id, 'i' || k AS insight_id FROM e")
def store_explorations(spark, sf):
    kept = store.Store(spark, _root(spark, "store"))
    kept.init()
    k = F.col("c_custkey")
    rows = _t(spark, sf, "customer").select(k, F.concat(F.lit("i"), k.cast("string")).alias("insight_id"), F.timestamp_seconds(k * 60).alias("created_at"))
    kept.save_exploration(rows.where("c_custkey % 2 = 0"))
    kept.save_exploration(rows.where("c_custkey % 2 = 1"))
    return kept.table("insight_explorations").select("id", "insight_id")


# --- text, filters and model steps --------------------------------------------------------------


@query("SELECT event_id, coalesce(list_contains(json_keys(props), 'k'), false) AS has_k, coalesce(list_contains(json_keys(props), 'k') AND list_contains(json_keys(props), 'missing'), false) AS has_both FROM events")
def required_fields(spark, sf):
    return _t(spark, sf, "events").select("event_id", parsing.has_fields(F.col("props"), ["k"]).alias("has_k"), parsing.has_fields(F.col("props"), ["k", "missing"]).alias("has_both"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS run_id, CASE WHEN o_orderkey % 7 <> 0 THEN epoch(o_orderdate)::DOUBLE END AS at FROM orders")
def run_ids_and_epochs(spark, sf):
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    said = F.when(F.col("o_orderkey") % 7 != 0, at).otherwise("not a date")
    return _t(spark, sf, "orders").select("o_orderkey", text.run_id(F.col("o_orderdate")).alias("run_id"), text.iso_epoch(said).alias("at"))


_KEYS = ", ".join(parsing.ENRICHED_FIELDS)


@query(f"SELECT conv_id AS cluster_id, 'Summarise.' || chr(10) || 'Answer with one JSON object with the keys {_KEYS}.' || chr(10) || string_agg('---' || chr(10) || 'Extract ' || i || ':' || chr(10) || text || chr(10), '' ORDER BY i) || '---' AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY 1")
def prompts(spark, sf):
    said = _t(spark, sf, "conversations").groupBy(F.col("conv_id").alias("cluster_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return said.select("cluster_id", providers.prompt(F.transform("t", lambda t: t["text"]), "Summarise.").alias("prompt"))


@query(f"WITH {CLUSTERED}, f AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pos) AS n FROM clustered), s AS (SELECT cluster_id, pos, CASE WHEN body <> '' THEN title || ' ' || body ELSE title END AS t, greatest(1000 // count(*) OVER (PARTITION BY cluster_id), 50)::BIGINT AS share FROM f WHERE n <= 6) SELECT cluster_id, pos, CASE WHEN length(t) > 4 * share THEN substr(t, 1, 4 * share) || '...' ELSE t END AS text FROM s")
def cluster_texts(spark, sf):
    shown = ranking.firsts(clustered(spark, sf).select("cluster_id", "pos", text.post_text(F.col("title"), F.col("body")).alias("text")), "cluster_id", 6)
    return cleaning.fit_texts(shown, 1200)


@query(f"SELECT id, CASE WHEN intent = 'other' AND id LIKE '%1' THEN 'pain' ELSE intent END AS intent FROM ({_intent_sql(POSTS + ', src AS (SELECT * FROM posts)', TOPICS)})")
def intent_fallback(spark, sf):
    return cleaning.tag_intent(spread(posts(spark, sf)), TOPICS, F.when(F.col("id").endswith("1"), "pain")).select("id", "intent")


_WANTED = {"pain": [r"license"], "request": [r"free"], "news": [r"the", r"que"]}


@query(f"SELECT id, intent FROM ({_intent_sql(POSTS + ', src AS (SELECT * FROM posts)', _WANTED)}) WHERE intent IN ('pain', 'request')")
def intent_filter(spark, sf):
    return cleaning.filter_intents(cleaning.tag_intent(spread(posts(spark, sf)), _WANTED)).select("id", "intent")


def _wtp_sql(source: str) -> str:
    """(id, has_wtp, signal_types, signal_count, wtp_score) of `src` (id, title, body)."""
    counts = {k: "coalesce(" + ", ".join(f"nullif(len(regexp_extract_all(t, {_quoted(p.lower())})), 0)" for p in own) + ", 0)" for k, own in lexicon.WTP_PATTERNS.items()}
    named = ", ".join(f"{c} AS n_{k}" for k, c in counts.items())
    types = ", ".join(f"CASE WHEN n_{k} > 0 THEN '{k}' END" for k in counts)
    points = " + ".join(f"CASE WHEN n_{k} > 0 THEN {lexicon.WTP_BONUS[k]}::DOUBLE ELSE 0 END" for k in counts)
    return f"""WITH {source}, w AS (SELECT id, lower(trim(title || ' ' || body)) AS t FROM src), c AS (SELECT id, {named} FROM w),
s AS (SELECT id, list_filter([{types}], lambda x: x IS NOT NULL) AS signal_types, ({' + '.join(f'n_{k}' for k in counts)})::INT AS signal_count, {points} AS points FROM c)
SELECT id, len(signal_types) > 0 AS has_wtp, signal_types, signal_count, CASE WHEN signal_count > 0 THEN round_even(least(least(signal_count * 2.0::DOUBLE, 6) + least(points, 4), 10) * 10, 0) / 10 ELSE 0 END AS wtp_score FROM s"""


_ALL = POSTS + ", " + _VALUES.replace("src AS", "own AS") + ", src AS (SELECT * FROM own UNION ALL SELECT id, title, body FROM posts)"


def _tagged(spark, sf):
    return cleaning.enrich_wtp(_samples(spark).unionByName(spread(posts(spark, sf)).select("id", "title", "body")), examples=False)


@query(_wtp_sql(_ALL))
def wtp_signals_posts(spark, sf):
    s = F.col("wtp_signals")
    return _tagged(spark, sf).select("id", s["has_wtp"].alias("has_wtp"), s["signal_types"].alias("signal_types"), s["signal_count"].alias("signal_count"), lexicon.wtp_score(s).alias("wtp_score"))


@query(f"SELECT count(*) AS posts, count(*) FILTER (has_wtp) AS with_signal, avg(has_wtp::INT) * 100 AS rate FROM ({_wtp_sql(_ALL)})")
def wtp_rate_posts(spark, sf):
    return cleaning.wtp_rate(_tagged(spark, sf))


@query(f"SELECT id FROM ({_wtp_sql(_ALL)}) WHERE has_wtp")
def wtp_filter(spark, sf):
    return cleaning.filter_wtp(_tagged(spark, sf)).select("id")


@query(f"WITH {CLUSTERED}, s AS (SELECT cluster_id, least(pos % 5 * 2.0::DOUBLE, 6) + CASE WHEN pos % 2 = 0 THEN 3.0::DOUBLE ELSE 1.0 END AS v, pos % 5 > 0 AS has FROM clustered) SELECT cluster_id, round_even(avg(CASE WHEN has THEN least(v, 10) ELSE 0 END) * 10, 0) / 10 AS wtp_score FROM s GROUP BY 1")
def cluster_wtp(spark, sf):
    n = (F.col("pos") % 5).cast("int")
    signals = F.struct((n > 0).alias("has_wtp"), F.array(F.when(F.col("pos") % 2 == 0, "direct_payment").otherwise("roi")).alias("signal_types"), n.alias("signal_count"))
    return clustered(spark, sf).groupBy("cluster_id").agg(text.half_even(F.avg(lexicon.wtp_score(signals)), 1).alias("wtp_score"))


@query("SELECT o_orderkey, o_totalprice / 1e6 > 0.1 AS cost_warning FROM orders WHERE o_totalprice / 1e6 <= 0.2")
def cost_guard(spark, sf):
    return providers.cost_guard(_t(spark, sf, "orders"), F.col("o_totalprice") / 1e6, 0.1).select("o_orderkey", "cost_warning")


def _answers(spark, sf, *cases: str) -> DataFrame:
    told = " ".join(f"when {i} then {c}" for i, c in enumerate(cases))
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("cluster_id"), F.expr(f"case doc_id % {len(cases)} {told} end").alias("response"))


@query("SELECT doc_id AS cluster_id, CASE doc_id % 4 WHEN 0 THEN 'dev_tools' WHEN 1 THEN 'ai_llm' WHEN 2 THEN 'legal_compliance' ELSE 'other' END AS sector FROM documents")
def llm_sectors(spark, sf):
    return providers.sectors(_answers(spark, sf, """'{"sector": "dev_tools"}'""", "'I think ai_llm fits'", """'```json\\n{"sector": "Legal_Compliance"}\\n```'""", "'none of them'"))


@query("SELECT doc_id AS cluster_id, CASE WHEN doc_id % 2 = 0 THEN greatest(1, least(10, doc_id % 15))::DOUBLE END AS trend_score FROM documents")
def llm_trend(spark, sf):
    return providers.scores(_answers(spark, sf, """concat('{"trend_score": ', doc_id % 15, '}')""", "'no number'"), "trend_score", None)


@query("SELECT doc_id AS cluster_id, CASE WHEN doc_id % 2 = 0 THEN greatest(1, least(10, doc_id % 15))::DOUBLE ELSE 5 END AS founder_fit_score FROM documents")
def founder_fit(spark, sf):
    return providers.scores(_answers(spark, sf, """concat('{"founder_fit_score": ', doc_id % 15, '}')""", "'no number'"), "founder_fit_score", 5.0)


@query("SELECT s_suppkey AS cluster_id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey)::INT AS rank FROM supplier QUALIFY rank <= 12")
def max_insights(spark, sf):
    rows = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("cluster_id"), F.col("s_acctbal").alias("priority_score"))
    return ranking.rank_by(rows).where(F.col("rank") <= 12).select("cluster_id", "rank")


@query("SELECT s_suppkey AS cluster_id, s_acctbal AS trend_score FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5")
def top_scores(spark, sf):
    return ranking.top_scores(_t(spark, sf, "supplier").select(F.col("s_suppkey").alias("cluster_id"), F.col("s_acctbal").alias("trend_score")), "trend_score")


@query("""WITH d AS (SELECT count(*) AS n, count(*) FILTER (length(text) > 200) AS c, (SELECT count(*) FROM (SELECT DISTINCT source FROM documents)) AS s, count(*) FILTER (length(text) > 200 AND lang = 'en') AS e FROM documents)
SELECT n AS total_posts, c AS after_cleaning, e AS after_dedup, s AS num_clusters, 0.1235::DOUBLE AS embeddings_cost_usd, 0.5::DOUBLE AS summary_cost_usd, 0.6235::DOUBLE AS total_cost_usd, 0.3::DOUBLE AS pain_weight FROM d""")
def run_statistics(spark, sf):
    """Rows of each step and of the clusters, counted in one pass over the documents."""
    steps, long = scan.Steps(), F.length("body") > 200
    p = steps.seen(posts(spark, sf), total_posts=None, after_cleaning=long, after_dedup=long & (F.col("lang") == "en"))
    clusters = steps.seen(p.groupBy(F.col("source").alias("cluster_id")).agg(F.count("*").alias("size")), num_clusters=None)
    clusters.write.format("noop").mode("overwrite").save()
    found = scan.statistics(spark, steps.counts(), 0.123456, 0.5)
    return found.select("*", F.col("priority_weights.pain").alias("pain_weight")).drop("priority_weights")


# --- SQL of plans that are registered without --------------------------------------------------


def _mmr_sql(sectors: str | None, picks: list[str]) -> str:
    """Greedy picks as one table a pick; `picks` are the conditions on the candidates of each."""
    parts = [_CENTROIDS, f"b AS (SELECT cluster_id, v, n, CASE WHEN hi = lo THEN 1::DOUBLE ELSE (n - lo) / (hi - lo)::DOUBLE END AS norm{sectors or ''} FROM c JOIN (SELECT label AS cluster_id, count(*) AS n FROM embeddings GROUP BY 1) z USING (cluster_id), (SELECT min(n) AS lo, max(n) AS hi FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)))"]
    parts.append(f"p AS (SELECT x.cluster_id AS one, y.cluster_id AS other, {COSINE.format(a='x.v', b='y.v')} AS s FROM b x, b y)")
    if sectors:
        parts.append("o AS (SELECT sector, row_number() OVER (ORDER BY avg(n) DESC, min(cluster_id)) AS k FROM b GROUP BY 1)")
    for i, where in enumerate(picks):
        before = " UNION ALL ".join(f"SELECT cluster_id FROM s{j}" for j in range(i))
        taken = f"AND cluster_id NOT IN ({before})" if i else ""
        value = f"0.7::DOUBLE * norm - 0.3::DOUBLE * (SELECT max(s) FROM p WHERE one = b.cluster_id AND other IN ({before}))" if i else "norm"
        parts.append(f"s{i} AS (SELECT cluster_id FROM (SELECT cluster_id, {value} AS value FROM b WHERE {where} {taken}) ORDER BY value DESC, cluster_id LIMIT 1)")
    return "WITH " + ", ".join(parts) + " "


ORACLE_SQL["mmr"] = _mmr_sql(None, ["true"] * 5) + " UNION ALL ".join(f"SELECT cluster_id, {i + 1}::INT AS mmr_rank FROM s{i}" for i in range(5))
_BY_SECTOR = _mmr_sql(", 's' || cluster_id % 3 AS sector", [f"sector = (SELECT sector FROM o WHERE k = {k})" for k in (1, 2, 3) for _ in range(2)])
ORACLE_SQL["mmr_by_sector"] = _BY_SECTOR + " UNION ALL ".join(f"SELECT cluster_id, 's' || cluster_id % 3 AS sector, {i + 1}::INT AS mmr_rank FROM s{i}" for i in range(6))
ORACLE_SQL["prefilter"] = f"SELECT lang, intent, has_wtp, count(*) AS n FROM ({_detector_sql()}) JOIN ({_intent_sql(POSTS + ', src AS (SELECT * FROM posts)', lexicon.INTENT_PATTERNS)}) USING (id) JOIN ({_wtp_sql(POSTS + ', src AS (SELECT * FROM posts)')}) USING (id) GROUP BY ALL"
