"""Queries of the language model, the vector index, answers of models and signals with their extracts, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon, parsing, text
from ..functions import vectors as vec
from ..operators import cleaning, language, vectors
from ..operators.index import VectorIndex, build_index
from ..sources import feeds, store
from ..streaming import incremental, stateful
from ..tables import Tables, spread, with_ranks
from . import explore, providers
from .queries import _CENTROIDS, _PAIN, _STATS, _TRACTION, CLUSTERED, COSINE, ORACLE_SQL, POSTS, _samples, _t, posts, query
from .table_queries import _ALL, _TITLE, _entries, _entry_sql, _payloads, _quoted, _wtp_sql

# --- language -----------------------------------------------------------------------------------

_TEXTS = "SELECT 'doc_' || doc_id AS id, trim(coalesce(substr(text, 1, 80), '') || ' ' || coalesce(text, '')) AS text FROM documents"


@query(language.sql("SELECT text, lang FROM documents WHERE doc_id % 5 <> 0", _TEXTS))
def language_model(spark, sf):
    """A model of four fifths of the documents tags all of them."""
    p = spread(posts(spark, sf).select("id", "pos", "title", "body", "lang"))
    model = language.fit_language_model(p.where("pos % 5 <> 0"), "body")
    return cleaning.tag_language(p.drop("lang"), model.detector()).select("id", "lang")


# --- vector index -------------------------------------------------------------------------------


@query(ORACLE_SQL["knn"])
def knn_index(spark, sf):
    """Built, saved, loaded and searched: the rows of `knn`."""
    e, path = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), Tables(spark, "ivf").root
    build_index(e, path, cells=16)
    found = VectorIndex.load(spark, path).search(e.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 5)
    return found.withColumn("distance", text.half_even(F.col("distance"), 6))


# --- signals with their extracts ----------------------------------------------------------------


def _examples_sql(source: str) -> str:
    """(id, examples) of `src` (id, title, body): the first two matches of each kind, three in all."""

    def shown(start: str, length: str) -> str:
        return f"regexp_replace(substr(x, greatest({start} - 30, 0) + 1, {start} + {length} + 30 - greatest({start} - 30, 0)), '^\\s+|\\s+$', '', 'g')"

    def of(pattern: str) -> str:
        p = _quoted(pattern.lower())
        hits, between = f"regexp_extract_all(t, {p})", f"regexp_split_to_array(t, {p})"
        second = f"length({between}[1]) + length({hits}[1]) + length({between}[2])"
        return f"CASE WHEN len({hits}) > 1 THEN [{shown(f'length({between}[1])', f'length({hits}[1])')}, {shown(f'({second})', f'length({hits}[2])')}] WHEN len({hits}) = 1 THEN [{shown(f'length({between}[1])', f'length({hits}[1])')}] END"

    kinds = " || ".join(f"coalesce({', '.join(map(of, own))}, []::VARCHAR[])" for own in lexicon.WTP_PATTERNS.values())
    return f"WITH {source}, w AS (SELECT id, trim(title || ' ' || body) AS x, lower(trim(title || ' ' || body)) AS t FROM src) SELECT id, ({kinds})[1:3] AS examples FROM w"


@query(f"SELECT * FROM ({_wtp_sql(_ALL)}) JOIN ({_examples_sql(_ALL)}) USING (id)")
def wtp_signals(spark, sf):
    own = _samples(spark).unionByName(spread(posts(spark, sf)).select("id", "title", "body"))
    s = F.col("wtp_signals")
    return cleaning.enrich_wtp(own).select("id", s["has_wtp"].alias("has_wtp"), s["signal_types"].alias("signal_types"), s["signal_count"].alias("signal_count"), s["examples"].alias("examples"), lexicon.wtp_score(s).alias("wtp_score"))


@query(f"SELECT count(*) AS posts, count(*) FILTER (has_wtp) AS with_signal, avg(has_wtp::INT) * 100 AS rate FROM ({_wtp_sql(POSTS + ', src AS (SELECT * FROM posts)')})")
def wtp_rate(spark, sf):
    return cleaning.wtp_rate(cleaning.enrich_wtp(spread(posts(spark, sf)), examples=False))


# --- answers of models --------------------------------------------------------------------------


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 5 < 3 THEN source END AS title,
  CASE WHEN doc_id % 5 < 2 THEN greatest(1, least(10, n_chars % 15))::DOUBLE ELSE 5 END AS pain FROM documents""")
def parse_responses(spark, sf):
    """Answers of every shape with the documents' own values: plain, fenced, in a bare fence, without JSON, none."""
    whole = F.to_json(F.struct(F.col("source").alias("title"), (F.col("n_chars") % 15).alias("pain_score_llm")))
    bare = F.to_json(F.struct(F.col("source").alias("title")))
    kind = F.col("doc_id") % 5
    said = F.when(kind == 0, whole).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), whole, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("```\n"), bare, F.lit("\n```"))).when(kind == 3, "no json in it").otherwise("")
    read = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), parsing.response_json(said).alias("j"))
    pain = F.coalesce(parsing.clamp(parsing.response_field(F.col("j"), "pain_score_llm", "double"), 1.0, 10.0), F.lit(5.0))
    return read.select("id", parsing.response_field(F.col("j"), "title", "string").alias("title"), pain.alias("pain"))


#: Turns as the lines of an answer: headings of known and unknown sections, items of three kinds, and plain lines.
_LINES = ["concat('## Monetization of ', role)", "concat('- ', text)", "concat('  * ', text)", "'**Validation**'", "concat(turn, '. ', text)", "text", "'### Notes'", "'## Product variants'", "concat('- ', role)"]


@query(f"""WITH s AS (SELECT conv_id, string_agg(CASE (turn + conv_id) % {len(_LINES)} {' '.join(f"WHEN {i} THEN {x}" for i, x in enumerate(_LINES))} END, chr(10) ORDER BY turn) AS said FROM conversations GROUP BY 1),
l AS (SELECT conv_id, unnest(string_split(said, chr(10))) AS line, unnest(generate_series(1, len(string_split(said, chr(10))))) AS pos FROM s),
n AS (SELECT *, CASE WHEN contains(line, '##') OR contains(line, '**') THEN CASE {' '.join(f"WHEN contains(lower(trim(line)), '{w}') THEN '{x}'" for w, x in parsing.SECTIONS.items())} END END AS named FROM l),
m AS (SELECT *, last_value(named IGNORE NULLS) OVER w AS section, max(CASE WHEN named IS NOT NULL THEN pos END) OVER w AS turn FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
g AS (SELECT conv_id, section, turn, list(trim(line, ' ') ORDER BY pos) AS items FROM m WHERE named IS NULL AND section IS NOT NULL AND regexp_matches(trim(line, ' '), '^[-*0-9]') GROUP BY 1, 2, 3)
SELECT conv_id, section, arg_max(items, turn) AS items FROM g GROUP BY 1, 2""")
def exploration_sections(spark, sf):
    case = f"case (turn + conv_id) % {len(_LINES)} " + " ".join(f"when {i} then {x}" for i, x in enumerate(_LINES)) + " end"
    turns = _t(spark, sf, "conversations").select("conv_id", "turn", F.expr(case).alias("line"))
    said = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("t"))
    return parsing.exploration_sections(said.select("conv_id", F.array_join(F.transform("t", lambda t: t["line"]), "\n").alias("said")), "conv_id", "said")


@query(f"""SELECT 'hn_' || doc_id AS id, 'hn' AS source, substr(text, 1, 60) AS title, n_chars % 50 AS score FROM documents WHERE n_chars % 50 > 20
UNION ALL SELECT 'se_ux_' || doc_id, 'se', substr(text, 1, 60), n_chars % 50 FROM documents UNION ALL SELECT id, source, title, score FROM ({_entry_sql('rss_', 'rss', 'text', 'text', '0')})""")
def feed_union(spark, sf):
    """Three feeds, and one that is always empty."""
    hn = _payloads(spark, sf, objectID="cast(doc_id as string)", title=_TITLE, story_text="text", points="n_chars % 50")
    se = _payloads(spark, sf, question_id="doc_id", title=_TITLE, body="text", score="n_chars % 50")
    found = feeds.union_sources(feeds.hn_posts(hn), feeds.stackexchange_posts(se), feeds.rss_posts(_entries(spark, sf), 1704844800.0), feeds.twitter_posts(spark))
    return found.select("id", "source", "title", "score")


# --- embeddings ---------------------------------------------------------------------------------


@query()
def embed_posts(spark, sf):
    p = vectors.embed_posts(posts(spark, sf), 64)
    return p.select("id", F.size("embedding").alias("dimensions"), text.half_even(vec.norm(F.col("embedding")), 4).alias("norm"))


# --- streams ------------------------------------------------------------------------------------


def _stream(spark, sf, name):
    """The table as a stream of its files."""
    return spark.readStream.schema(_t(spark, sf, name).schema).parquet(f"{sf}/{name}.parquet*")


@query("""SELECT user_id::VARCHAR AS key, event_id AS pos FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
WHERE previous IS NULL OR epoch_ms(ts) - epoch_ms(previous) > 86400000""")
def stream_first_sights(spark, sf):
    """Events of users who were not seen in the day before: state with timers, over all there is now."""
    with stateful.rocksdb(spark):
        seen = stateful.first_sights(_stream(spark, sf, "events"), "user_id", "ts", "event_id", "1 day")
        return stateful.drain(seen, Tables(spark, "sights").root).select("key", "pos")


@query("""SELECT event_type AS cluster_id, date_trunc('week', ts)::TIMESTAMP AS week, count(*) AS size FROM events GROUP BY 1, 2
HAVING date_trunc('week', any_value(ts)) + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_weekly_sizes(spark, sf):
    """Weeks that the watermark has passed."""
    events = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stateful.drain(incremental.weekly_sizes(events, "ts", "event_type"), Tables(spark, "weeks").root)


@query(f"WITH {POSTS} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY md5(trim(regexp_replace(lower(title || ' ' || body), '\\s+', ' ', 'g')))) AS n, count(*) OVER (PARTITION BY md5(trim(regexp_replace(lower(title || ' ' || body), '\\s+', ' ', 'g')))) AS many FROM posts) WHERE many = 1")
def stream_dedupe(spark, sf):
    """Contents that the stream has once, by its deduplicated rows and the batch's counts."""
    docs = _stream(spark, sf, "documents")
    rows = docs.select(F.concat(F.lit("doc_"), "doc_id").alias("id"), F.lit(None).cast("string").alias("url"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("body"), F.col("doc_id").cast("double").alias("created_ts"))
    once = stateful.drain(incremental.dedupe_stream(rows, by_content=True).select("id", "hash"), Tables(spark, "once").root)
    counted = posts(spark, sf).groupBy(text.content_hash(F.col("title"), F.col("body")).alias("hash")).agg(F.count("*").alias("n")).where("n = 1")
    return once.join(counted, "hash").select("id")


# --- SQL of the whole scan, from fixed clusters -------------------------------------------------

_W = "(0.30::DOUBLE + 0.25::DOUBLE + 0.15::DOUBLE + 0.20::DOUBLE + 0.10::DOUBLE)"
#: The offline provider's summary of each cluster's first six texts, cut to their share of the prompt.
_SUMMARIES = """f AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pos) AS nth FROM clustered),
x AS (SELECT cluster_id, pos, CASE WHEN body <> '' THEN title || ' ' || body ELSE title END AS t, greatest(1000 // count(*) OVER (PARTITION BY cluster_id), 50)::BIGINT AS share FROM f WHERE nth <= 6),
y AS (SELECT cluster_id, pos, regexp_replace(CASE WHEN length(t) > 4 * share THEN substr(t, 1, 4 * share) || '...' ELSE t END, '^\\s+|\\s+$', '', 'g') AS t FROM x),
summary AS (SELECT cluster_id, count(*) AS parts, coalesce(arg_min(t, pos) FILTER (t <> ''), '') AS first FROM y GROUP BY 1),
told AS (SELECT cluster_id, array_to_string(regexp_extract_all(first, '\\S+')[1:6], ' ') AS title, substr(first, 1, 200) AS problem, parts || ' extracts' AS context, parts > 1 AS monetizable, least(10, 3 + parts)::INT AS pain_score_llm FROM summary)"""
_SCANNED = f"""WITH {_STATS}, {_SUMMARIES}, {_CENTROIDS},
wtp AS (SELECT cluster_id, round_even(avg(wtp_score) * 10, 0) / 10 AS wtp_score FROM ({_wtp_sql(POSTS + ', src AS (SELECT * FROM posts)')}) JOIN clustered USING (id) GROUP BY 1),
h AS (SELECT cluster_id, size, source_mix, {_PAIN}::DOUBLE AS heuristic_score, {_TRACTION} AS traction_score, greatest(0, least(10, 9 + CASE WHEN size > 20 THEN -2 WHEN size > 10 THEN -1 ELSE 1 END))::DOUBLE AS novelty_score FROM stats),
i AS (SELECT *, round_even(least((pain_score_llm * 0.7::DOUBLE + heuristic_score * 0.3::DOUBLE) * (0.30::DOUBLE / {_W}) + traction_score * (0.25::DOUBLE / {_W}) + novelty_score * (0.15::DOUBLE / {_W}) + wtp_score * (0.20::DOUBLE / {_W}) + 5.0::DOUBLE * (0.10::DOUBLE / {_W}), 10) * 100, 0) / 100 AS priority_score
  FROM h JOIN told USING (cluster_id) JOIN wtp USING (cluster_id) JOIN (SELECT cluster_id, v FROM c) USING (cluster_id)),
n AS (SELECT *, CASE WHEN hi = lo THEN 1 ELSE (priority_score - lo) / (hi - lo) END AS norm FROM i, (SELECT min(priority_score) AS lo, max(priority_score) AS hi FROM i)),
one AS (SELECT * FROM n ORDER BY norm DESC, cluster_id LIMIT 1),
two AS (SELECT n.* FROM n, one WHERE n.cluster_id <> one.cluster_id ORDER BY 0.7::DOUBLE * n.norm - 0.3::DOUBLE * {COSINE.format(a='n.v', b='one.v')} DESC, n.cluster_id LIMIT 1),
picked AS (SELECT *, 1 AS rank FROM one UNION ALL SELECT *, 2 AS rank FROM two)"""

ORACLE_SQL["summaries"] = f"WITH {CLUSTERED}, {_SUMMARIES} SELECT cluster_id, title, monetizable, pain_score_llm FROM told"
ORACLE_SQL["scan_insights"] = f"{_SCANNED} SELECT cluster_id, rank, rank AS mmr_rank, priority_score, heuristic_score, traction_score, novelty_score, wtp_score, 'other' AS sector, size FROM picked"
_ONE = "CASE WHEN {0} = 0 THEN '' ELSE printf('%.1f', {0}) END AS {0}"
ORACLE_SQL["export_csv"] = f"""{_SCANNED} SELECT rank::VARCHAR AS rank, rank::VARCHAR AS mmr_rank, printf('%.2f', priority_score) AS priority_score, printf('%.2f', priority_score) AS priority_score_adjusted,
  cluster_id::VARCHAR AS cluster_id, size::VARCHAR AS size, 'other' AS sector, title, problem, 'user' AS persona, '' AS jtbd, context, CASE WHEN monetizable THEN 'Yes' ELSE 'No' END AS monetizable, '' AS mvp, '' AS alternatives,
  '' AS willingness_to_pay_signal, pain_score_llm::VARCHAR AS pain_score_llm, trunc(pain_score_llm * 0.7::DOUBLE + heuristic_score * 0.3::DOUBLE)::INT::VARCHAR AS pain_score_final,
  {', '.join(_ONE.format(c) for c in ('heuristic_score', 'traction_score', 'novelty_score'))}, '5.0' AS trend_score, '5.0' AS founder_fit_score, '' AS example_urls, array_to_string(source_mix, ', ') AS source_mix, '' AS keywords_matched FROM picked"""

ORACLE_SQL["export_json"] = f"""{_SCANNED} SELECT (SELECT count(*) FROM documents) AS posts, (SELECT count(*)::INT FROM picked) AS insights, a.title, a.priority_score,
  b.cluster_id AS second, b.context AS second_context, b.traction_score AS second_traction, b.pain_score_llm AS second_pain FROM picked a, picked b WHERE a.rank = 1 AND b.rank = 2"""


# --- exploration, embeddings by a provider, and the store's layout ------------------------------

_SAID = "'About ' || p_name || '.' || chr(10) || '## Monetization ideas' || chr(10) || '- Subscription: ' || p_name || chr(10) || '- One-time fee' || chr(10) || '## Product variants' || chr(10) || '- ' || p_name || ' for teams' || chr(10) || '## Validation steps' || chr(10) || '1. Interview ten ' || CASE WHEN p_partkey % 3 = 0 THEN 'users' ELSE p_brand END || chr(10) || '2. Landing page' || chr(10)"


@query(f"""SELECT row_number() OVER (ORDER BY 'i' || p_partkey) AS id, 'i' || p_partkey AS insight_id, {_SAID} AS exploration_text, ['- Subscription: ' || p_name, '- One-time fee'] AS monetization_hypotheses,
['- ' || p_name || ' for teams'] AS product_variants, ['1. Interview ten ' || CASE WHEN p_partkey % 3 = 0 THEN 'users' ELSE p_brand END, '2. Landing page'] AS validation_steps FROM part""")
def explore_insights(spark, sf):
    """Parts as insights: prompts, answers, their sections, and the rows stored and read back."""
    p = _t(spark, sf, "part")
    insights = p.select(F.concat(F.lit("i"), "p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("problem"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("persona"),
                        F.lit(None).cast("string").alias("context"), (F.col("p_size") % 10).alias("pain_score_final"), F.lit(5.0).alias("trend_score"))
    kept = store.Store(spark, Tables(spark, "store").root)
    kept.init()
    kept.save_exploration(explore.explore(insights, providers.exploration_stub).withColumn("created_at", F.timestamp_seconds(F.lit(0))))
    return kept.table("insight_explorations").select("id", "insight_id", "exploration_text", "monetization_hypotheses", "product_variants", "validation_steps")


def _counts(texts: list[str]) -> list[list[float]]:
    """A provider for the query below: letters, digits and all characters of each text."""
    return [[float(sum("a" <= c <= "z" for c in t)), float(sum("0" <= c <= "9" for c in t)), float(len(t))] for t in texts]


@query(f"WITH {POSTS} SELECT id, [length(regexp_replace(title, '[^a-z]', '', 'g')), length(regexp_replace(title, '[^0-9]', '', 'g')), length(title)]::DOUBLE[] AS embedding FROM posts")
def embed_by_provider(spark, sf):
    return providers.embed(spread(posts(spark, sf).select("id", "title")), "title", _counts).select("id", "embedding")


@query("""SELECT o_orderstatus || '_cluster_' || o_orderkey AS id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank, o_totalprice AS priority_score
FROM orders QUALIFY o_orderstatus = 'O' AND o_totalprice >= 300000""")
def store_layout(spark, sf):
    """A run's insights of high priority, from a compacted table whose row groups are sorted by priority."""
    o, kept = _t(spark, sf, "orders"), store.Store(spark, Tables(spark, "store").root)
    kept.init()
    # Ranks of one sort over all runs, less those of the runs before: no run is sorted in one task.
    ranked = with_ranks(o.select("o_orderstatus", "o_orderkey", "o_totalprice"), [F.col("o_orderstatus").asc(), F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], Tables(spark, "ranks"))
    firsts = ranked.groupBy("o_orderstatus").agg(F.min("rank").alias("first"))
    o, rank = ranked.join(F.broadcast(firsts), "o_orderstatus"), (F.col("rank") - F.col("first") + 1).cast("int")
    rows = o.select(F.col("o_orderstatus").alias("run"), F.col("o_orderkey").alias("cluster_id"), F.col("o_totalprice").alias("priority_score"), rank.alias("rank"), F.lit(False).alias("monetizable"), F.array(F.struct(F.lit("u").alias("url"))).alias("examples"))
    for run in ("F", "O", "P"):
        kept.save_insights(run, rows.where(F.col("run") == run).drop("run"))
    kept.compact("insights", ["priority_score"], 1 << 20)
    return kept.table("insights").where("run_id = 'O' and priority_score >= 300000").select("id", "rank", "priority_score")
