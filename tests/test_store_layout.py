"""The store's layout: row groups and files that lookups skip; explorations and providers that fail."""

import pytest
from pyspark.sql import functions as F

from postsift.plans import explore, providers
from postsift.sources.store import Store


def scanned(df):
    """Rows that the scans of `df` gave to the plan."""
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    stack = [plan]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            rows += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    return rows


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    kept = Store(spark, str(tmp_path_factory.mktemp("store")))
    kept.init()
    n = 60_000
    rows = spark.range(n).select(
        F.col("id").cast("int").alias("cluster_id"), (F.col("id") + 1).cast("int").alias("rank"), (F.lit(n) - F.col("id")).cast("double").alias("priority_score"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("sector"),
        F.lit(True).alias("monetizable"), F.array(F.struct(F.concat(F.lit("http://x/"), F.sha2(F.col("id").cast("string"), 512)).alias("url"))).alias("examples"),
    )
    for run in ("a", "b"):
        kept.save_insights(run, rows)
    kept.save_exploration(rows.select(F.sha2("sector", 256).alias("insight_id"), F.timestamp_seconds("cluster_id").alias("created_at"), F.sha2(F.col("cluster_id").cast("string"), 512).alias("exploration_text")))
    kept.save_run(spark.range(5000).select(F.concat(F.lit("r"), "id").alias("id"), F.timestamp_seconds("id").alias("created_at"), *[F.lit(None).cast("string").alias(c) for c in ("config_name", "mode")], *[F.lit(None).cast("int").alias(c) for c in ("nb_insights", "nb_clusters")], *[F.lit(None).cast("double").alias(c) for c in ("total_cost_usd", "embed_cost_usd", "summary_cost_usd")], F.sha2(F.col("id").cast("string"), 512).alias("csv_path"), F.lit(None).cast("string").alias("json_path"), F.sha2(F.concat(F.lit("n"), "id"), 512).alias("notes")))
    for name in ("insights", "insight_explorations", "runs"):
        kept.compact(name, None, 64 << 10)
    return kept


def test_lookups_skip_rows(kept):
    insights, explorations, runs = (kept.table(n) for n in ("insights", "insight_explorations", "runs"))
    assert insights.count() == 120_000 and explorations.count() == 60_000 and runs.count() == 5000
    assert scanned(insights.where("run_id = 'a'")) == 60_000
    for found, rows, most in (
        (insights.where("run_id = 'a' and rank <= 10"), 10, 30_000),
        (insights.where("run_id = 'b' and id = 'b_cluster_77'"), 1, 30_000),
        (insights.where("run_id = 'a' and id = 'nowhere'"), 0, 0),
        (insights.where("run_id = 'a' and sector = 'nothing'"), 0, 0),
        (explorations.where(F.col("insight_id") == F.sha2(F.lit("s3"), 256)), 60_000 // 7, 40_000),
        (explorations.where("insight_id = 'none'"), 0, 0),
        (runs.where("created_at >= timestamp_seconds(4990)"), 10, 4000),
        (runs.where("id = 'nobody'"), 0, 0),
    ):
        assert abs(found.count() - rows) <= 1 and scanned(found) <= most, (found, scanned(found))
    kept.compact("insights", ["priority_score"], 64 << 10)
    high = kept.table("insights").where("run_id = 'a' and priority_score >= 59990")
    assert high.count() == 11 and scanned(high) <= 30_000
    kept.compact("insights", ["sector", "rank"], 64 << 10)
    some = kept.table("insights").where("run_id = 'a' and sector = 's3'")
    assert some.count() == 60_000 // 7 and scanned(some) <= 40_000


def test_exploration_sections_and_failures(spark):
    rows = spark.createDataFrame([("a", "Late invoices", "p", "agencies", None, 8, 5.0), ("b", None, None, None, "c", None, None), ("c", "breaks", "p", None, None, 1, 1.0)], "id string, title string, problem string, persona string, context string, pain_score_final int, trend_score double")

    def provider(text):
        if "breaks" in text:
            raise OSError("no answer")
        return providers.exploration_stub(text)

    found = {r.insight_id: r for r in explore.explore(rows, provider, tries=2, pause=0).collect()}
    assert set(found) == {"a", "b"}
    assert found["a"].monetization_hypotheses == ["- Subscription: Late invoices", "- One-time fee"] and found["a"].validation_steps[0] == "1. Interview ten agencies"
    assert found["b"].product_variants == ["-  for teams"] and found["a"].cost_usd > 0
    said = rows.select(explore.exploration_prompt(*[F.col(c) for c in rows.columns[1:]]).alias("p")).first().p
    assert said.splitlines()[:4] == ["Insight: Late invoices", "Problem: p", "Persona: agencies", "Pain of ten: 8"]


def test_embeddings_in_batches_with_failures(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(25)], "i int, text string").coalesce(1)

    def provider(texts):
        assert 0 < len(texts) <= 4
        if "t9" in texts:
            raise OSError("too many requests")
        return [[float(t[1:])] for t in texts]

    found = {r.i: r.embedding for r in providers.embed(rows, "text", provider, batch=4, tries=2, pause=0).collect()}
    assert len(found) == 25 and found[3] is None and found[0] == [0.0] and found[24] == [24.0]
    assert sum(v is None for v in found.values()) == 5  # the null text and the four of the failed batch
    assert all(r.embedding is None for r in providers.embed(rows, "text", lambda t: [[1.0]], batch=4, tries=1, pause=0).where("i between 4 and 8").collect())
