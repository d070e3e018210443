import json

import pytest

from postsift.operators import cleaning
from postsift.plans import providers, scan
from postsift.sources import feeds, files, history, sinks, store


def test_read_posts(spark, tmp_path):
    good = [{"id": "1", "title": "t", "selftext": "old", "num_comments": 3, "raw": {}}, {"id": "2", "source": "hn", "title": "u", "body": "new"}]
    (tmp_path / "a.json").write_text(json.dumps(good))
    rows = {r.id: r for r in files.read_posts(spark, str(tmp_path / "*.json")).collect()}
    assert rows["1"].body == "old" and rows["1"].comments_count == 3 and rows["1"].source == "reddit" and rows["2"].body == "new"
    with pytest.raises(FileNotFoundError):
        files.read_posts(spark, str(tmp_path / "none*.json"))
    (tmp_path / "b.json").write_text(json.dumps([{"title": "no id"}]))
    with pytest.raises(ValueError):
        files.read_posts(spark, str(tmp_path / "*.json"))
    assert files.read_posts(spark, str(tmp_path / "*.json"), tolerant=True).count() == 2


def test_lists_and_config(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# c\n\n a \nb\n")
    assert [r.value for r in files.read_lines(spark, str(tmp_path / "p.txt")).collect()] == ["a", "b"]
    assert [r.name for r in files.list_packs(spark, str(tmp_path)).collect()] == ["p"]
    (tmp_path / "c.yaml").write_text("reddit_sources:\n  # x\n  - name: freelance\n    category: business_pme\n    max_posts: 40\nstackexchange_sources:\n  - site: ux\n    category: dev_tools\ncategory_quotas:\n  business_pme: 150\n")
    sources, quotas = files.read_sources_config(spark, str(tmp_path / "c.yaml"))
    assert {(r.type, r.name, r.category) for r in sources.collect()} == {("reddit", "freelance", "business_pme"), ("stackexchange", "ux", "dev_tools")}
    assert quotas.first().quota == 150
    assert files.read_sources_config(spark, str(tmp_path / "missing.yaml"))[0].count() == 0


def test_history_reads(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"date": "2025-01-25", "cluster_id": 1}\nbroken\n{"date": "2024-01-01", "cluster_id": 2}\n')
    rows = files.read_history(spark, str(tmp_path / "h.jsonl"), "date string, cluster_id int", since="2025-01-01")
    assert [r.cluster_id for r in rows.collect()] == [1]
    assert files.read_history(spark, str(tmp_path / "none"), "date string").count() == 0


def test_feeds(spark):
    rows = lambda *x: spark.createDataFrame([(json.dumps(v),) for v in x], "payload string")
    rss = feeds.rss_posts(rows({"link": "l", "title": "t", "summary": "", "description": "d", "published": "2024-01-02T00:00:00Z"}, {"link": "m", "title": "u"}), cutoff=1.8e9)
    assert [(r.title, r.created_ts) for r in rss.collect()] == [("u", None)]
    ph = feeds.producthunt_posts(rows({"id": "1", "name": "N", "tagline": "T", "description": "D", "createdAt": "2024-01-01T00:00:00Z", "topics": {"edges": [{"node": {"name": "SaaS"}}]}, "comments": {"edges": [{"node": {"body": "c" * 300}}]}}), ["saas"])
    row = ph.first()
    assert row.title == "N - T" and row.body == "D\n\nTop Comments:\nComment: " + "c" * 200 and row.created_ts == 1704067200.0
    assert feeds.producthunt_posts(rows({"id": "1", "topics": {"edges": []}}), ["saas"]).count() == 0
    failed = feeds.isolated(spark, lambda: 1 / 0)
    assert failed.count() == 0 and feeds.twitter_posts(spark).count() == 0
    assert feeds.indiehackers_posts(rows({"link": "l", "title": "x" * 400})).first().title == "x" * 300
    assert feeds.booster(spark, lambda: feeds.reddit_posts(rows({"id": "r", "title": "t", "score": 9}, {"id": "s", "title": "t", "score": 1})), lambda: 1 / 0, lambda: 1 / 0).count() == 1
    assert "points%3E20" in feeds.hn_urls(["a b"])[0] and "fromdate=5" in feeds.stackexchange_urls("ux", ["x"], 5)[0]


def test_feed_source_reads_pages(spark, tmp_path):
    (tmp_path / "page.json").write_text(json.dumps({"data": {"children": [{"data": {"id": "a", "title": "t"}}]}}))
    rows = feeds.read_feed(spark, [f"file://{tmp_path}/page.json"], "data.children", "x")
    assert feeds.reddit_posts(rows).first().id == "a"


def clusters(spark):
    rows = [(f"p{i}", i, ["reddit", "hn", "rss"][i % 3], f"problem {'invoice' if i < 6 else 'contract'} {i}", "need help with billing tool", 1.7e9, f"http://u/{i}", i * 3, i, i // 6, [1.0, float(i // 6), float(i % 6) / 10]) for i in range(12)]
    return spark.createDataFrame(rows, "id string, pos long, source string, title string, body string, created_ts double, url string, score long, comments_count long, cluster_id int, embedding array<double>")


def test_scan_store_and_exports(spark, tmp_path):
    insights = scan.scan(clusters(spark)).cache()
    assert insights.count() == 2 and {r.rank for r in insights.collect()} == {1, 2}
    csv = sinks.insights_csv(insights)
    assert len(csv.columns) == 26 and len(sinks.enriched_csv(insights).columns) == 23 and len(sinks.legacy_csv(insights).columns) == 11
    sinks.write_csv(csv, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == 2
    doc = json.loads(sinks.results_document(sinks.insight_documents(insights), spark.range(1).selectExpr("12 as posts")).first().value)
    assert doc["statistics"]["posts"] == 12 and [i["rank"] for i in doc["insights"]] == [1, 2]
    legacy = json.loads(sinks.results_document(sinks.legacy_documents(insights), spark.range(1).selectExpr("1 as n")).first().value)
    assert set(legacy["insights"][0]["summary"]) == {"title", "description", "monetizable", "justification", "mvp", "pain_score_llm", "size"}
    assert len(sinks.summary_json(insights).columns) == 8
    s = store.Store(spark, str(tmp_path / "store"))
    s.init()
    run = spark.sql("select 'r1' id, timestamp'2025-01-01' created_at, 'c' config_name, 'deep' mode, 2 nb_insights, 2 nb_clusters, 0.1D total_cost_usd, 0D embed_cost_usd, 0D summary_cost_usd, null csv_path, null json_path, null notes")
    s.save_run(run)
    with pytest.raises(ValueError):
        s.save_run(run)
    s.save_insights("r1", insights)
    s.save_insights("r1", insights.where("cluster_id = 0").withColumn("title", insights["title"].substr(1, 3)))
    saved = {r.id: r for r in s.table("insights").collect()}
    assert set(saved) == {"r1_cluster_0", "r1_cluster_1"} and len(saved["r1_cluster_0"].title) == 3 and len(saved["r1_cluster_0"].example_urls) == 3
    more = spark.sql("select 'r1_cluster_0' insight_id, timestamp'2025-01-01' created_at, 'm' model_used, 'x' exploration_text")
    s.save_exploration(more)
    s.save_exploration(more)
    assert sorted(r.id for r in s.table("insight_explorations").collect()) == [1, 2]
    assert store.run_insights(s.table("insights"), "r1", 0).count() == 2


def test_limit_and_filter_order(spark):
    rows = spark.createDataFrame([("1", "r", 1, "X"), ("2", "r", 2, "X"), ("3", "r", 3, "Y")], "id string, run_id string, rank int, sector string")
    assert store.limit_then_filter(rows, "r", 2, "Y").count() == 0
    assert store.filter_then_limit(rows, "r", 2, "Y").count() == 1


def test_providers(spark):
    asked = spark.createDataFrame([(1, "p"), (2, "q")], "cluster_id int, prompt string")

    def flaky(text):
        if text == "q":
            raise RuntimeError
        return '{"score": 42}'

    answers = providers.complete(asked, "prompt", flaky)
    assert {r.cluster_id: r.score for r in providers.scores(answers, "score", 5.0).collect()} == {1: 10.0, 2: 5.0}
    guarded = providers.cost_guard(spark.createDataFrame([(0.4,), (0.6,), (1.1,)], "c double"), cleaning.F.col("c"))
    assert sorted((r.c, r.cost_warning) for r in guarded.collect()) == [(0.4, False), (0.6, True)]


def test_history_tables(spark):
    past = spark.createDataFrame([("a", 2), ("b", 1)], "term string, freq long")
    assert [(r.term, r.freq) for r in history.merge_terms(past, past, 1).collect()] == [("a", 4)]
    weeks = history.shift_weeks(spark.createDataFrame([(12, "a", 1), (1, "a", 2)], "week_offset int, cluster_id string, size long"), spark.createDataFrame([("a", 9)], "cluster_id string, size long"))
    assert sorted((r.week_offset, r.size) for r in weeks.collect()) == [(1, 9), (2, 2)]


def test_streams(spark, tmp_path):
    from postsift.streaming import incremental

    schema = "id string, url string, title string, body string, created_ts double"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id":"1","title":"t","body":"b","created_ts":1700000000}\n{"id":"1","title":"t","body":"b","created_ts":1700000001}\n')
    stream = incremental.dedupe_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 1


def test_prefilter_and_estimate(spark):
    p = clusters(spark).drop("cluster_id", "embedding")
    assert scan.prefilter(p, intents=("pain",)).count() == 12
    prices = spark.createDataFrame([(k, *v) for k, v in scan.PRICES.items()], "model string, input double, output double")
    assert scan.estimate(p, prices).first().summary_cost_usd == pytest.approx(0.0042)
    assert scan.clean_run(p).count() >= 1
