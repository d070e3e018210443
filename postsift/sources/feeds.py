"""Feeds as posts: payloads of the public services turned into the post schema, and a data source that fetches them.

Each `*_posts` function takes the rows of a payload as JSON text (column `payload`) with what the request knew, so
the same plan runs on fetched pages, on saved dumps and in tests without a network.
"""

from __future__ import annotations

import json
import urllib.parse
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import any_keyword
from ..functions.text import iso_epoch, view_count, with_ellipsis
from ..schemas import POST, as_posts
from .feed_source import read_feed


def _field(path: str, kind: str = "string") -> Column:
    return F.get_json_object("payload", f"$.{path}").try_cast(kind)


def _since(cutoff: float | None) -> Column:
    """Rows without a time pass."""
    return F.lit(True) if cutoff is None else F.col("created_ts").isNull() | (F.col("created_ts") >= cutoff)


def _link_id(prefix: str, link: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(F.coalesce(link, F.lit(""))), 1, 16))


def reddit_posts(items: DataFrame, include_keywords: list[str] | None = None) -> DataFrame:
    posts = as_posts(items.select(
        _field("id").alias("id"), F.lit("reddit").alias("source"), F.coalesce(_field("title"), F.lit("")).alias("title"), _field("selftext").alias("body"),
        _field("created_utc", "double").alias("created_ts"), F.concat(F.lit("https://reddit.com"), F.coalesce(_field("permalink"), F.lit(""))).alias("url"),
        _field("score", "long").alias("score"), _field("num_comments", "long").alias("comments_count"), F.col("payload").alias("raw"),
    ))
    return posts.where(any_keyword(F.concat_ws(" ", "title", "body"), include_keywords or []))


def hn_posts(items: DataFrame, min_points: int = 20, cutoff: float | None = None) -> DataFrame:
    story = F.coalesce(_field("objectID"), F.lit(""))
    posts = as_posts(items.select(
        F.concat(F.lit("hn_"), story).alias("id"), F.lit("hn").alias("source"), F.coalesce(_field("title"), F.lit("")).alias("title"), _field("story_text").alias("body"),
        F.coalesce(_field("created_at_i", "double"), F.lit(0.0)).alias("created_ts"), F.concat(F.lit("https://news.ycombinator.com/item?id="), story).alias("url"),
        _field("points", "long").alias("score"), _field("num_comments", "long").alias("comments_count"), F.col("payload").alias("raw"),
    ))
    return posts.where((F.col("score") > min_points) & _since(cutoff))


def _entry_posts(items: DataFrame, prefix: str, source: str, cutoff: float | None, title_chars: int | None, body_chars: int | None, scored: bool) -> DataFrame:
    link = F.coalesce(_field("link"), F.lit(""))
    title, body = F.coalesce(_field("title"), F.lit("")), F.coalesce(F.nullif(_field("summary"), F.lit("")), _field("description"), F.lit(""))
    rows = items.select(
        _link_id(prefix, link).alias("id"), F.lit(source).alias("source"),
        (F.substring(title, 1, title_chars) if title_chars else title).alias("title"), (F.substring(body, 1, body_chars) if body_chars else body).alias("body"),
        iso_epoch(_field("published")).alias("created_ts"), link.alias("url"), F.lit(0 if scored else None).cast("long").alias("score"),
        F.lit(0 if scored else None).cast("long").alias("comments_count"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("intent"), F.col("payload").alias("raw"),
    )
    return rows.where(_since(cutoff))


def rss_posts(items: DataFrame, cutoff: float | None = None) -> DataFrame:
    return _entry_posts(items, "rss_", "rss", cutoff, None, None, True)


def indiehackers_posts(items: DataFrame, cutoff: float | None = None) -> DataFrame:
    return _entry_posts(items, "ih_", "rss", cutoff, 300, 5000, False)


def nitter_posts(items: DataFrame, cutoff: float | None = None) -> DataFrame:
    return _entry_posts(items, "ntr_", "x", cutoff, 300, 5000, False)


def stackexchange_posts(items: DataFrame, min_score: int | None = None) -> DataFrame:
    """`items` has `site` beside `payload`."""
    posts = as_posts(items.select(
        F.concat(F.lit("se_"), F.col("site"), F.lit("_"), _field("question_id")).alias("id"), F.lit("se").alias("source"), F.coalesce(_field("title"), F.lit("")).alias("title"),
        with_ellipsis(F.coalesce(_field("body_markdown"), _field("body"), F.lit("")), 1000).alias("body"), _field("creation_date", "double").alias("created_ts"), _field("link").alias("url"),
        _field("score", "long").alias("score"), _field("answer_count", "long").alias("comments_count"), F.col("payload").alias("raw"),
    ))
    return posts if min_score is None else posts.where(F.col("score") >= min_score)


def producthunt_posts(items: DataFrame, categories: list[str] | None = None) -> DataFrame:
    node = F.from_json(
        "payload",
        "id string, name string, tagline string, description string, url string, createdAt string, votesCount long, commentsCount long, "
        "topics struct<edges: array<struct<node: struct<name: string>>>>, comments struct<edges: array<struct<node: struct<body: string>>>>",
    )
    rows = items.select(node.alias("n"), "payload")
    topics = F.transform(F.coalesce("n.topics.edges", F.array().cast("array<struct<node: struct<name: string>>>")), lambda t: F.lower(t["node"]["name"]))
    top = F.array_join(F.transform(F.slice(F.coalesce("n.comments.edges", F.array().cast("array<struct<node: struct<body: string>>>")), 1, 3), lambda c: F.concat(F.lit("Comment: "), F.substring(c["node"]["body"], 1, 200))), "\n")
    about = F.coalesce("n.description", F.lit(""))
    kept = rows if not categories else rows.where(F.arrays_overlap(topics, F.array(*[F.lit(c.lower()) for c in categories])))
    return as_posts(kept.select(
        F.concat(F.lit("ph_"), "n.id").alias("id"), F.lit("ph").alias("source"), F.concat(F.coalesce("n.name", F.lit("")), F.lit(" - "), F.coalesce("n.tagline", F.lit(""))).alias("title"),
        F.when(top != "", F.concat(about, F.lit("\n\nTop Comments:\n"), top)).otherwise(about).alias("body"), iso_epoch(F.col("n.createdAt")).alias("created_ts"), F.col("n.url").alias("url"),
        F.col("n.votesCount").alias("score"), F.col("n.commentsCount").alias("comments_count"), F.col("payload").alias("raw"),
    ))


def github_posts(items: DataFrame, min_stars: int = 10) -> DataFrame:
    repo = F.from_json("payload", "id string, full_name string, description string, language string, topics array<string>, created_at string, html_url string, stargazers_count long, open_issues_count long")
    rows = items.select(repo.alias("r"), "payload")
    named = F.slice(F.coalesce("r.topics", F.array().cast("array<string>")), 1, 5)
    body = F.concat(F.coalesce("r.description", F.lit("")), F.lit("\n\nLanguage: "), F.coalesce("r.language", F.lit("None")), F.when(F.size(named) > 0, F.concat(F.lit("\nTopics: "), F.array_join(named, ", "))).otherwise(F.lit("")))
    posts = as_posts(rows.select(
        F.concat(F.lit("gh_"), F.coalesce("r.id", F.md5(F.coalesce("r.full_name", F.lit(""))))).alias("id"), F.lit("rss").alias("source"), F.substring(F.coalesce("r.full_name", F.lit("")), 1, 300).alias("title"),
        F.substring(body, 1, 5000).alias("body"), iso_epoch(F.col("r.created_at")).alias("created_ts"), F.col("r.html_url").alias("url"), F.coalesce("r.stargazers_count", F.lit(0)).alias("score"),
        F.col("r.open_issues_count").alias("comments_count"), F.nullif("r.language", F.lit("")).alias("lang"), F.col("payload").alias("raw"),
    ))
    return posts.where(F.col("score") >= min_stars)


def youtube_posts(items: DataFrame, min_views: int = 10_000) -> DataFrame:
    said = F.coalesce(_field("views"), F.lit("0"))
    about = F.concat(F.lit("Channel: "), F.coalesce(_field("channel"), F.lit("")), F.lit(" | Duration: "), F.coalesce(_field("duration"), F.lit("")), F.lit(" | Views: "), said)
    posts = items.select(
        F.concat(F.lit("yt_"), F.coalesce(_field("id"), F.lit(""))).alias("id"), F.lit("rss").alias("source"), F.substring(F.coalesce(_field("title"), F.lit("")), 1, 300).alias("title"), about.alias("body"),
        F.lit(None).cast("double").alias("created_ts"), F.concat(F.lit("https://www.youtube.com/watch?v="), F.coalesce(_field("id"), F.lit(""))).alias("url"), view_count(said).alias("score"),
        F.lit(None).cast("long").alias("comments_count"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("intent"), F.col("payload").alias("raw"),
    )
    return posts.where(F.col("score") >= min_views)


def twitter_posts(spark: SparkSession) -> DataFrame:
    """There is no free interface; always empty."""
    return spark.createDataFrame([], POST)


def union_sources(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def isolated(spark: SparkSession, fetch: Callable[[], DataFrame]) -> DataFrame:
    """What `fetch` plans, or no rows if it cannot: one source does not stop the others.

    Nothing is fetched here. What fails later, page by page, is the reader's to pass over (`on_error` skip).
    """
    try:
        return fetch()
    except Exception:  # noqa: BLE001  any failure of a feed
        return spark.createDataFrame([], POST)


def booster(spark: SparkSession, reddit: Callable[[], DataFrame], indiehackers: Callable[[], DataFrame], nitter: Callable[[], DataFrame], min_score: int = 5) -> DataFrame:
    """The daily union: hot posts with a score, and two feeds; each may fail alone."""
    return union_sources(isolated(spark, reddit).where(F.col("score") >= min_score), isolated(spark, indiehackers), isolated(spark, nitter))


def subreddit_items(spark: SparkSession, subreddits: list[str], mode: str = "new", limit: int = 1000, **options: str) -> DataFrame:
    """Items of subreddits, page after page up to `limit` each; one that fails gives what it has."""
    settings = {"next": "data.after", "cursor": "after", "time": "created_utc", "limit": str(limit), "on_error": "skip"} | ({"order": "newest"} if mode == "new" else {})
    return read_feed(spark, reddit_urls(subreddits, mode), "data.children", sites=json.dumps(subreddits), **settings | options)


def nitter_items(spark: SparkSession, queries: list[str], instances: list[str], **options: str) -> DataFrame:
    """Entries of searches, each from the first of the instances that answers."""
    urls = ["{mirror}/search/rss?" + urllib.parse.urlencode({"f": "tweets", "q": q}) for q in queries]
    return read_feed(spark, urls, kind="rss", mirrors=json.dumps(instances), sites=json.dumps(queries), **{"on_error": "skip"} | options)


def hn_urls(queries: list[str], min_points: int = 20, since: int | None = None, limit: int = 100) -> list[str]:
    """The service filters points and time, so those never cross the network."""
    numeric = [f"points>{min_points}"] + ([f"created_at_i>{since}"] if since is not None else [])
    return ["https://hn.algolia.com/api/v1/search?" + urllib.parse.urlencode({"query": q, "tags": "ask_hn", "numericFilters": ",".join(numeric), "hitsPerPage": limit}) for q in queries]


def stackexchange_urls(site: str, tags: list[str], since: int, min_score: int = 5, limit: int = 100) -> list[str]:
    return ["https://api.stackexchange.com/2.3/questions?" + urllib.parse.urlencode({"site": site, "tagged": ";".join(tags), "fromdate": since, "min": min_score, "sort": "votes", "pagesize": limit, "filter": "withbody"})]


def reddit_urls(subreddits: list[str], mode: str = "new", limit: int = 100) -> list[str]:
    return [f"https://www.reddit.com/r/{s}/{mode}.json?limit={limit}" for s in subreddits]
