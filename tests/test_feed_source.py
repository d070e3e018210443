"""The feed source against a local server: cursors, limits, failures, mirrors, pushed filters."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from postsift.sources import feeds
from postsift.sources.feed_source import read_feed


@pytest.fixture
def service():
    """/r/NAME/new.json: 5 items a page, 12 in all, newest first. /busy: fails twice. /down: always. /late: from the second page on."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urllib.parse.urlparse(self.path)
            query = dict(urllib.parse.parse_qsl(url.query))
            asked.append(self.path)
            start = int(query.get("after", "0"))
            if url.path == "/down" or url.path == "/late" and start or url.path == "/busy" and sum(a.startswith("/busy") for a in asked) < 3:
                self.send_response(503)
                self.end_headers()
                return
            if url.path.endswith("rss"):
                body = "<rss><channel><item><title>t</title><link>http://l/1</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item></channel></rss>"
            else:
                found = [{"kind": "t3", "data": {"id": f"{url.path.split('/')[2] if url.path.count('/') > 1 else url.path[1:]}{i}", "title": "t", "created_utc": 1000 - i, "score": i}} for i in range(start, min(12, start + 5))]
                body = json.dumps({"data": {"children": found, "after": str(start + 5) if start + 5 < 12 else None}})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


PAGED = {"next": "data.after", "cursor": "after", "time": "created_utc", "pause": "0.01"}


def ids(df):
    return sorted(r.id for r in df.select(F.get_json_object("payload", "$.id").alias("id")).collect())


def test_cursor_pages_and_limit(spark, service):
    base, asked = service
    rows = read_feed(spark, [f"{base}/r/a/new.json?limit=5", f"{base}/r/b/new.json"], "data.children", sites='["a", "b"]', **PAGED)
    assert ids(rows) == sorted(f"{s}{i}" for s in "ab" for i in range(12))
    posts = feeds.reddit_posts(rows)
    assert posts.count() == 24 and posts.agg(F.max("score")).first()[0] == 11
    asked.clear()
    assert len(ids(read_feed(spark, [f"{base}/r/a/new.json"], "data.children", limit="7", **PAGED))) == 7
    assert len(asked) == 2


def test_failures_are_tried_again_skipped_or_raised(spark, service):
    base, _ = service
    assert len(ids(read_feed(spark, [f"{base}/busy"], "data.children", **PAGED))) == 12
    urls = [f"{base}/down", f"{base}/r/a/new.json", f"{base}/late"]
    rows = read_feed(spark, urls, "data.children", on_error="skip", tries="2", **PAGED)
    assert ids(rows) == sorted([f"a{i}" for i in range(12)] + [f"late{i}" for i in range(5)])
    with pytest.raises(Exception, match="503"):
        read_feed(spark, urls[:1], "data.children", tries="1", **PAGED).collect()


def test_mirrors_take_over(spark, service):
    base, asked = service
    found = feeds.nitter_posts(feeds.nitter_items(spark, ["a b"], ["http://127.0.0.1:9", f"{base}/down", base], tries="1", pause="0.01"))
    row = found.first()
    assert row.url == "http://l/1" and row.created_ts == 1704067200.0 and row.source == "x"
    assert feeds.nitter_items(spark, ["a"], ["http://127.0.0.1:9"], tries="1").count() == 0


def test_filters_reach_the_source(spark, service):
    base, asked = service
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = read_feed(spark, [f"{base}/r/a/new.json", f"{base}/r/b/new.json"], "data.children", sites='["a", "b"]', order="newest", **PAGED)
        asked.clear()
        found = rows.where("site = 'b' and created >= 998 and payload is not null")
        assert ids(found) == ["b0", "b1", "b2"]
        assert len(asked) == 1 and asked[0].startswith("/r/b/")  # one source, and one of its three pages
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "isnotnull(payload" in plan and "998" not in plan and "= b" not in plan  # what the source took, Spark does not test again
        assert ids(rows.where("created > 998")) == ["a0", "a1", "b0", "b1"]
        assert ids(rows.where("site in ('a', 'c') and created > 990 and created < 993")) == ["a8", "a9"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert ids(rows.where("site = 'a' and created >= 998")) == ["a0", "a1", "a2"]


def test_isolated_fetches_nothing(spark, service):
    base, asked = service
    feeds.isolated(spark, lambda: feeds.subreddit_items(spark, ["x"]))
    feeds.isolated(spark, lambda: read_feed(spark, [f"{base}/r/a/new.json"], "data.children", **PAGED))
    assert asked == []
