"""Terms are counted in a hash table, with their first place."""

from postsift.operators import scoring


def test_counts_without_a_sort(spark):
    posts = spark.createDataFrame([(1, 2, "alpha beta", "alpha"), (1, 1, "", "gamma beta")], "cluster_id int, pos long, title string, body string")
    counts = scoring.term_counts(posts)
    assert "SortAggregate" not in counts._jdf.queryExecution().executedPlan().toString()
    assert [r.term for r in counts.orderBy("first_at").collect()] == ["gamma", "beta", "alpha"]
