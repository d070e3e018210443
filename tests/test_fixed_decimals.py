"""Costs are rounded by the double's exact value, as the SQL's printf does."""

from pyspark.sql import functions as F

from postsift.functions import text


def test_half_way_costs(spark):
    amounts = [(500 + 1000 * i) / 1e7 for i in range(100)] + [(1 + 2 * i) / 200 for i in range(100)] + [0.0, 0.125, 0.375, 0.00999999, 1234.5]
    rows = spark.createDataFrame([(a,) for a in amounts], "a double").select("a", text.format_cost(F.col("a")).alias("shown"), text.fixed(-F.col("a"), 2).alias("minus")).collect()
    assert [r["shown"] for r in rows] == [f"${a:.4f}" if a < 0.01 else f"${a:.2f}" for a in amounts]
    assert [r["minus"] for r in rows] == [f"{-a:.2f}" for a in amounts]
