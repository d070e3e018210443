"""Format `feed`: pages of web services as rows, fetched in Spark tasks.

A partition is one source (a URL). Its pages follow each other by the service's cursor until there is none, a limit is
reached, or, for feeds sorted newest first, items are older than a pushed filter asks for. A source that fails is tried
again with growing pauses, then on its mirrors; with `on_error` skip it gives what it has read so far and stops nobody else.
"""

from __future__ import annotations

import email.utils
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterable, Iterator
from datetime import UTC

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Answers that another try may mend.
_PASSING = frozenset((408, 425, 429, 500, 502, 503, 504))


class _Source(InputPartition):
    def __init__(self, url: str, site: str):
        super().__init__(url)
        self.url, self.site = url, site


def _at(value, path: str):
    for name in filter(None, path.split(".")):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _entries(data: bytes) -> list[dict]:
    """Items of an RSS document; the publication time as ISO text."""
    found = []
    for item in ElementTree.fromstring(data).iter("item"):
        entry = {child.tag: child.text or "" for child in item}
        if entry.get("pubDate"):
            entry["published"] = email.utils.parsedate_to_datetime(entry["pubDate"]).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        found.append(entry)
    return found


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.since: tuple[float, bool] | None = None  # least time, and whether it is itself allowed
        self.sites: set[str] | None = None

    def partitions(self) -> list[_Source]:
        urls = json.loads(self.options["urls"])
        sites = json.loads(self.options["sites"]) if "sites" in self.options else [self.options.get("site", "")] * len(urls)
        return [_Source(u, s) for u, s in zip(urls, sites, strict=True) if self.sites is None or s in self.sites]

    def _get(self, url: str) -> bytes:
        tries, pause = int(self.options.get("tries", "3")), float(self.options.get("pause", "1"))
        for turn in range(tries):
            wait = pause * 2**turn
            try:
                request = urllib.request.Request(url, headers={"User-Agent": "postsift"})
                with urllib.request.urlopen(request, timeout=float(self.options.get("timeout", "30"))) as answer:
                    return answer.read()
            except urllib.error.HTTPError as error:
                if error.code not in _PASSING or turn == tries - 1:
                    raise
                said = error.headers.get("Retry-After", "")
                wait = float(said) if said.isdigit() else wait
            except OSError:  # no connection, or a time-out
                if turn == tries - 1:
                    raise
            time.sleep(min(wait, 60.0))
        raise ValueError("at least one try")

    def _page(self, url: str) -> tuple[list, object]:
        """(items, answer) from the first of the mirrors that answers."""
        failure: Exception | None = None
        for mirror in json.loads(self.options.get("mirrors", '[""]')):
            try:
                data = self._get(url.replace("{mirror}", mirror))
                if self.options.get("kind") == "rss":
                    return _entries(data), None
                answer = json.loads(data)
                return _at(answer, self.options.get("items", "")) or [], answer
            except (OSError, ValueError, ElementTree.ParseError) as error:
                failure = error
        raise failure or ValueError("no mirror")

    def _created(self, item) -> float | None:
        found = _at(item, self.options["time"]) if self.options.get("time") else None
        return float(found) if isinstance(found, (int, float)) else None

    def _too_old(self, created: float | None) -> bool:
        return self.since is not None and (created is None or created < self.since[0] or created == self.since[0] and not self.since[1])

    def read(self, partition: _Source) -> Iterator[tuple]:
        given, limit, url = 0, int(self.options.get("limit", "0")), partition.url
        while url:
            try:
                items, answer = self._page(url)
            except Exception:
                if self.options.get("on_error") == "skip":
                    return
                raise
            for item in items:
                item = item.get("data", item) if isinstance(item, dict) else item
                created = self._created(item)
                if self._too_old(created):
                    if self.options.get("order") == "newest" and created is not None:
                        return
                    continue
                yield json.dumps(item), partition.site, created
                given += 1
                if given == limit:
                    return
            cursor = _at(answer, self.options["next"]) if self.options.get("next") and items else None
            url = f"{partition.url}{'&' if '?' in partition.url else '?'}{urllib.parse.urlencode({self.options['cursor']: cursor})}" if cursor else ""


class PushingReader(FeedReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of `site` and lower bounds of `created`; the others stay with Spark."""
        for f in filters:
            match f:
                case EqualTo(("site",), value):
                    self.sites = {value} if self.sites is None else self.sites & {value}
                case In(("site",), values):
                    self.sites = set(values) if self.sites is None else self.sites & set(values)
                case GreaterThanOrEqual(("created",), value) | GreaterThan(("created",), value):
                    bound = (float(value), isinstance(f, GreaterThanOrEqual))
                    self.since = bound if self.since is None else max(self.since, bound, key=lambda b: (b[0], not b[1]))
                case _:
                    yield f


class FeedSource(DataSource):
    """Rows (payload: an item as JSON, site, created) of the `urls` (a JSON list; `sites` beside it, or one `site`).

    `items` is the path of an answer's list, `kind` rss reads RSS items instead; `next` the path of the cursor and
    `cursor` the parameter that takes it; `time` the path of an item's seconds; `order` newest ends a source at the
    first item that is too old; `limit` items a source; `tries`, `pause`, `timeout`; `mirrors`, a JSON list that
    takes the place of {mirror}; `on_error` skip.
    """

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "payload string, site string, created double"

    def reader(self, schema) -> FeedReader:
        return (PushingReader if self.options.get("push") == "true" else FeedReader)(dict(self.options))


def read_feed(spark: SparkSession, urls: list[str], items: str = "", site: str = "", **options: str) -> DataFrame:
    """Rows of the feeds; filters reach the source where spark.sql.python.filterPushdown.enabled is set."""
    spark.dataSource.register(FeedSource)
    push = spark.conf.get(_PUSHDOWN, "false")
    return spark.read.format("feed").options(urls=json.dumps(urls), items=items, site=site, push=push, **options).load()
