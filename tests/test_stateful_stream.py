"""First sights over several batches: state that outlives a restart, timers that end it, late rows."""

from postsift.plans import scan
from postsift.streaming import stateful

DAY = 86_400


def test_first_sights_over_batches(spark, tmp_path):
    schema = "user string, seconds long, n long"
    (tmp_path / "in").mkdir()

    def batch(k, *rows):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(f'{{"user":"{u}","seconds":{d * DAY},"n":{n}}}' for u, d, n in rows))
        with stateful.rocksdb(spark):
            stream = spark.readStream.schema(schema).json(str(tmp_path / "in")).selectExpr("user", "timestamp_seconds(seconds) AS ts", "n")
            found = stateful.drain(stateful.first_sights(stream, "user", "ts", "n", "60 days"), str(tmp_path / "out"))
            return sorted((r.key, r.pos) for r in found.collect())

    assert batch(1, ("a", 100, 1), ("a", 100, 0), ("b", 110, 2), ("a", 120, 3)) == [("a", 0), ("b", 2)]
    # A sight within the horizon of the last one, which moved, is none; another is.
    assert batch(2, ("a", 179, 4), ("b", 171, 5), ("c", 171, 6)) == [("a", 0), ("b", 2), ("b", 5), ("c", 6)]
    assert batch(3, ("a", 200, 7), ("a", 400, 8)) == [("a", 0), ("a", 8), ("b", 2), ("b", 5), ("c", 6)]
    # The watermark passed c's horizon, so its state has gone by its timer.
    assert batch(4, ("c", 401, 9)) == [("a", 0), ("a", 8), ("b", 2), ("b", 5), ("c", 6), ("c", 9)]


def test_steps_are_counted_in_one_pass(spark):
    """The counts come from the action itself: no job but its own."""
    sc = spark.sparkContext
    steps = scan.Steps()
    rows = steps.seen(spark.range(0, 100, 1, 3), all_rows=None)
    even = steps.seen(rows.where("id % 2 = 0"), even=None, tens=scan.F.col("id") % 10 == 0)
    sc.setJobGroup("steps", "steps")
    even.write.format("noop").mode("overwrite").save()
    assert steps.counts() == {"all_rows": 100, "even": 50, "tens": 10}
    assert len(sc.statusTracker().getJobIdsForGroup("steps")) == 1
    sc.setLocalProperty("spark.jobGroup.id", None)
    row = scan.statistics(spark, steps.counts(), 0.1, 0.25).first()
    assert row.even == 50 and row.total_cost_usd == 0.35 and row.priority_weights.pain == 0.3
