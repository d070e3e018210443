"""Every query of feeds, files, sinks, store and model steps against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from postsift.functions import vectors as vec
from postsift.operators import ranking, vectors
from postsift.plans import table_queries
from postsift.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
OWN = [n for n, f in QUERIES.items() if f.__module__ == table_queries.__name__ and n in ORACLE_SQL]


@pytest.fixture(scope="module")
def tables():
    found = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split():
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return found


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([tuple(v) if isinstance(v, list) else v for v in (row[i] for i in order)]) for row in rows)


@pytest.mark.parametrize("name", [*OWN, "mmr", "mmr_by_sector", "prefilter", "min_max_scale", "centroids"])
def test_query_equals_its_sql(spark, tables, name):
    found = QUERIES[name](spark, SF)
    asked = tables.execute(ORACLE_SQL[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == sorted(found.columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(names, asked.fetchall())


def test_collect_all_keeps_what_its_filters_keep(spark):
    rows = table_queries.collect_all(spark, SF).collect()
    assert rows and {r.lang for r in rows} <= {"en", "fr"} and len({r.id for r in rows}) == len(rows)


def test_rounds_and_fold_pick_the_same(spark, monkeypatch):
    items = spark.range(40).select(F.col("id").alias("cluster_id"), (F.col("id") * 7 % 11).cast("double").alias("priority_score"), F.array(*[F.sin(F.col("id") * k) for k in range(1, 6)]).alias("embedding"), (F.col("id") % 3).cast("string").alias("sector"))

    def picks():
        return [sorted((r.mmr_rank, r.cluster_id) for r in found.collect()) for found in (ranking.mmr(items, 9), ranking.mmr_by_sector(items, 3))]

    folded = picks()
    monkeypatch.setattr(ranking, "FOLD_ROWS", 5)
    assert folded == picks()


def test_chunks_of_queries_and_of_history(spark, monkeypatch):
    rows = spark.range(60).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 2)).alias("embedding"))
    asked, past = rows.where("id % 4 = 0").withColumnRenamed("id", "query_id"), rows.select(F.col("embedding").alias("vector"))
    items = rows.select(F.col("id").alias("cluster_id"), F.col("embedding").alias("centroid")).where("cluster_id < 5")

    def found():
        near = {(r.query_id, r["rank"], r.id) for r in vectors.nearest(asked, rows, 3).collect()}
        return near, {(r.cluster_id, round(r.max_similarity, 9)) for r in vectors.max_similarity(items, past).collect()}

    whole = found()
    monkeypatch.setattr(vectors, "CHUNK_ROWS", 4)
    assert whole == found() and len(whole[0]) == 45


def test_scaled_equals_the_window(spark):
    rows = spark.range(9).select("id", (F.col("id") * 3 % 7).alias("x"))
    assert {(r.id, r.s) for r in vec.scaled(rows, "x", "s").collect()} == {(r.id, r.s) for r in rows.select("id", vec.min_max(F.col("x")).alias("s")).collect()}
    assert {r.s for r in vec.scaled(rows.withColumn("x", F.lit(2)), "x", "s").collect()} == {1.0}
