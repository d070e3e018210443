"""The fitted language detector on held-out rows, and the saved vector index against a full scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift.operators import cleaning, language, vectors
from postsift.operators.index import VectorIndex, build_index
from postsift.plans.queries import posts
from postsift.tables import Tables

SF = "/root/testdata/sf0.01"


def plain_buckets(text, buckets):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not words:
        return []
    codes = [ord(c) for c in f" {' '.join(words)} "]
    return [((a * 31 + b) * 31 + c) % buckets for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)]


def test_buckets_equal_a_plain_loop(spark):
    texts = ["", "7 !", "a", "Hello, World", "l'été À la", "漢字 x", "ÿ\n\tz", "😀 one 𝔘two"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", language.trigram_buckets(F.col("text"), 97).alias("b"))
    assert {r.i: r.b for r in rows.collect()} == {i: plain_buckets(t, 97) for i, t in enumerate(texts)}
    assert rows.sparkSession.range(1).select(language.trigram_buckets(F.lit(None).cast("string")).alias("b")).first().b == []


def test_held_out_accuracy(spark):
    rows = posts(spark, SF)
    model = language.fit_language_model(rows.where("pos % 5 <> 0"), "body")
    held = rows.where("pos % 5 = 0 and length(trim(body)) >= 10").withColumnRenamed("lang", "label")
    got = cleaning.tag_language(held, model.detector()).agg(F.avg((F.col("lang") == F.col("label")).cast("int"))).first()[0]
    words = cleaning.tag_language(held).agg(F.avg((F.col("lang") == F.col("label")).cast("int"))).first()[0]
    assert got >= 0.98 and got >= words


def test_short_and_letterless_texts_are_unknown(spark):
    model = language.fit_language_model(spark.createDataFrame([("the cat sat", "en"), ("le chat noir", "fr"), ("x", None)], "text string, lang string"))
    rows = spark.createDataFrame([(1, "the cat on the mat", ""), (2, "le chat est noir", None), (3, "the", ""), (4, "123 456 789 000", ""), (5, None, None)], "id int, title string, body string")
    assert {r.id: r.lang for r in cleaning.tag_language(rows, model.detector()).collect()} == {1: "en", 2: "fr", 3: "unknown", 4: "unknown", 5: "unknown"}
    with pytest.raises(ValueError):
        language.fit_language_model(spark.createDataFrame([("12", "en")], "text string, lang string"))


def clustered(spark, n=4000, groups=20):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(groups, 8)) * 10
    vecs = centres[rng.integers(groups, size=n)] + rng.normal(size=(n, 8)) * 0.3
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)] + [(9000 + i, vecs[5].tolist()) for i in range(7)], "id long, embedding array<double>")


def scanned(rows, queries, k):
    return sorted((r.query_id, r["rank"], r.id, r.distance) for r in vectors.nearest(queries, rows, k).collect())


def test_index_equals_a_scan_and_reads_a_part(spark, tmp_path):
    rows = clustered(spark)
    build_index(rows, str(tmp_path), cells=20)
    index = VectorIndex.load(spark, str(tmp_path))
    queries = rows.where("id % 500 = 3").withColumnRenamed("id", "query_id")
    found = sorted((r.query_id, r["rank"], r.id, r.distance) for r in index.search(queries, 5).collect())
    assert found == scanned(rows, queries, 5)
    one = index.needed(queries.where("query_id = 503"), 5, Tables(spark, "t"))
    assert index.cells.count() > 10 and one.count() <= 3  # of the cells, for one query
    plan = index._distances(one, True)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("cells", [1, 4, 50])
def test_index_edges(spark, tmp_path, cells):
    """Fewer rows than k, ties, equal vectors, rows without a usable vector, far queries."""
    rows = spark.createDataFrame([(5, [0.0, 0.0]), (2, [0.0, 0.0]), (7, [3.0, 4.0]), (8, None), (9, [None, 1.0]), (10, [float("nan"), 0.0]), (11, [1.0, 1.0])], "id long, embedding array<double>")
    build_index(rows, str(tmp_path), cells=cells)
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1e6, -1e6])], "query_id long, embedding array<double>")
    usable = rows.where("id in (2, 5, 7, 11)")
    index = VectorIndex.load(spark, str(tmp_path))
    for k in (1, 3, 10):
        assert sorted((r.query_id, r["rank"], r.id, r.distance) for r in index.search(queries, k).collect()) == scanned(usable, queries, k)


def test_empty_index(spark, tmp_path):
    build_index(spark.createDataFrame([], "id long, embedding array<double>"), str(tmp_path))
    index = VectorIndex.load(spark, str(tmp_path))
    assert index.search(spark.createDataFrame([(1, [0.0])], "query_id long, embedding array<double>"), 3).count() == 0


def test_trigrams_of_a_batch_equal_the_column(spark, monkeypatch):
    """A batch's trigrams, taken in parts of any size, are those of each text; the tags are the best sums of weights."""
    texts = ["", "7 !", "a", "Hello, World", "l'été À la", "漢字 x", "ÿ\n\tz", "😀 one 𝔘two", None, "the cat sat on the mat " * 9, "𝔘" * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", "text", language.letters(F.col("text")).alias("own"), language.trigram_buckets(F.col("text"), 97).alias("b")).orderBy("i").collect()
    for size in (1, 5, 1 << 20):
        monkeypatch.setattr(language, "BATCH_CHARS", size)
        got = {i: [] for i in range(len(texts))}
        for own, bucket in language._runs([r.own for r in rows], 97):
            for i, b in zip(own.tolist(), bucket.tolist(), strict=True):
                got[i].append(b)
        assert got == {r.i: r.b for r in rows}
    model = language.LanguageModel({"x": [b % 7 for b in range(97)], "a": [b % 5 for b in range(97)]})
    found = spark.createDataFrame([(r.i, r.text) for r in rows], "i int, text string").select("i", model.best(F.col("text")).alias("lang")).collect()
    assert {r.i: r.lang for r in found} == {r.i: max(sorted(model.weights), key=lambda x: sum(model.weights[x][b] for b in r.b)) for r in rows}
