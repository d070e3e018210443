"""The collection's tags are worked out once, and each row keeps its own columns."""

from pyspark.sql import functions as F

from postsift.operators import cleaning, dedupe
from postsift.plans import scan


def test_tags_are_written_not_worked_out_again(spark):
    texts = ["the cat and the dog of the house is looking for a tool", "le chat et la maison de la ville est une des", "der hund und die katze ist nicht ein", "how do I fix this problem with the app that is slow"]
    rows = [(f"p{i}", i, texts[i % 4] + f" {i // 4 * 7919}" * (i // 8), f"body {i // 8} " * (1 + i % 3), i * 3 % 20, i % 5, "xx") for i in range(60)]
    posts = spark.createDataFrame(rows, "id string, pos int, title string, body string, score int, comments_count int, lang string").withColumn("url", F.lit(None).cast("string"))
    tagged = cleaning.tag_intent(cleaning.filter_languages(cleaning.tag_language(posts), ["en", "fr"]))
    want = dedupe.greedy_dedupe(cleaning.filter_comments(cleaning.filter_score(tagged, 4), 1))
    found = scan.collect_all(posts, ["en", "fr"], None, 4, 1)
    assert found.columns == want.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and 0 < found.count() < 60
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan and "EvalPython" in want._jdf.queryExecution().optimizedPlan().toString()
