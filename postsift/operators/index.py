"""A saved vector index for exact nearest neighbours: an inverted file pruned by the triangle inequality.

Vectors are dealt to the nearest of a bounded number of centroids (cells) and written as a table partitioned by cell,
each with its distance to its centroid. A cell's least and largest distance bound how near any of its vectors can be
to a query. A search reads each query's nearest cells for a first kth distance, then only the cells, and of these
only the rows, whose bound does not exceed it; cells that no query needs are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import squared_distance
from ..tables import Tables, chunks_of
from .vectors import BLOCK_ROWS, CHUNK_ROWS, _one_by_one, _squared, best_rows, exact_distances

#: Rows that the centroids are fitted on, about, and rows of a file of a cell.
SAMPLE_ROWS, FILE_ROWS = 20_000, 1_000_000
#: Slack of a bound against the rounding of distances.
SLACK = 1e-6


def _placed(centres: list[list[float]]):
    """(id, embedding) -> with the nearest centre and the distance to it."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.array(centres, np.float64)
        for rows in batches:
            if len(rows):
                e = np.array(rows["embedding"].tolist(), np.float64)
                cell = _squared(e, c).argmin(1)
                yield rows.assign(cell=cell.astype(np.int32), radius=np.sqrt(exact_distances(c[cell], e)))

    return each


def build_index(vectors: DataFrame, path: str, cells: int = 64, seed: int = 42, sample_rows: int = SAMPLE_ROWS) -> None:
    """Writes the index of `vectors` (id, embedding: of one length) under `path`: every row, in cells.

    Centroids are fitted on about `sample_rows` rows, which decides what is read and never what is found. Rows
    without a vector, or with a null or non-finite component, are not indexed.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where((F.size("embedding") > 0) & F.coalesce(finite, F.lit(False))).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count()
    sample = rows.sample(min(1.0, sample_rows / n), seed) if n else rows
    sample = sample.select(array_to_vector("embedding").alias("_v"))
    found = sample.limit(2).count()
    if found < 2 or cells < 2:
        centres = [[0.0] * len(r["embedding"]) for r in rows.limit(1).collect()]
    else:
        centres = [c.tolist() for c in KMeans(k=cells, seed=seed, maxIter=10, featuresCol="_v").fit(sample).clusterCenters()]
    spark = vectors.sparkSession
    centroids = F.broadcast(spark.createDataFrame(list(enumerate(centres)), "cell int, centroid array<double>"))  # `cells` rows
    placed = rows.mapInPandas(_placed(centres), f"id {rows.schema['id'].dataType.simpleString()}, embedding array<double>, cell int, radius double")
    # A crowded cell is dealt over several tasks and files.
    dealt = placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // FILE_ROWS)))))
    dealt.sortWithinPartitions("cell", "radius").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    saved = spark.read.schema("id long, embedding array<double>, radius double, cell int").parquet(f"{path}/rows") if n else placed.limit(0)
    told = saved.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("least"), F.max("radius").alias("most"))
    told.join(centroids, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


@dataclass(frozen=True)
class VectorIndex:
    """`rows` (id, embedding, radius, cell), partitioned by cell, and `cells` (cell, centroid, n, least, most)."""

    rows: DataFrame
    cells: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.schema("id long, embedding array<double>, radius double, cell int").parquet(f"{path}/rows")
        return cls(rows, spark.read.schema("cell int, n long, least double, most double, centroid array<double>").parquet(f"{path}/cells"))

    def bounds(self, queries: DataFrame) -> DataFrame:
        """(query_id, q, cell, far, low, n): the distance to each cell's centroid, and the least possible to a row in it."""
        pairs = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")).join(F.broadcast(self.cells))
        far = F.sqrt(squared_distance(F.col("q"), F.col("centroid")))
        low = F.greatest(F.col("far") - F.col("most"), F.col("least") - F.col("far"), F.lit(0.0))
        return pairs.withColumn("far", far).select("query_id", "q", "cell", "far", low.alias("low"), "n")

    def _distances(self, pairs: DataFrame, bound: bool, k: int = 5) -> DataFrame:
        """(query_id, id, distance) of each query's k nearest rows, or more, in its cells; with `bound`, of those that `kth` allows.

        `pairs` are a chunk of queries' cells, which every task gets; a task multiplies blocks of a cell's rows with its queries.
        """
        told = pairs.select("query_id", "cell", *(["far", "kth"] if bound else [])).toPandas()  # queries of a chunk x cells of the index
        vectors = {r["query_id"]: r["q"] for r in pairs.select("query_id", "q").dropDuplicates(["query_id"]).collect()}
        if not len(told):
            return self.rows.limit(0).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("distance"))
        sent = pairs.sparkSession.sparkContext.broadcast((told, vectors))

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            told, vectors = sent.value
            asked = dict(list(told.groupby("cell")))
            for rows in batches:
                for cell, own in rows.groupby("cell"):
                    for low in range(0, len(asked[cell]), BLOCK_ROWS):
                        queries = asked[cell].iloc[low : low + BLOCK_ROWS]
                        names, q = queries["query_id"].to_numpy(), np.array([vectors[n] for n in queries["query_id"]], np.float64)
                        for start in range(0, len(own), BLOCK_ROWS):
                            some = own.iloc[start : start + BLOCK_ROWS]
                            allowed = None
                            if bound:
                                far, radius = queries["far"].to_numpy()[:, None], some["radius"].to_numpy()[None, :]
                                allowed = np.abs(far - radius) <= queries["kth"].to_numpy()[:, None] + (far + radius) * SLACK
                            at, row, distance = best_rows(q, np.array(some["embedding"].tolist(), np.float64), some["id"].to_numpy(), k, allowed)
                            yield pd.DataFrame({"query_id": names[at], "id": some["id"].to_numpy()[row], "distance": distance})

        rows = self.rows.where(F.col("cell").isin(sorted(set(told["cell"].tolist()))))
        return rows.mapInPandas(each, f"query_id {pairs.schema['query_id'].dataType.simpleString()}, id long, distance double")

    def needed(self, queries: DataFrame, k: int, tables: Tables) -> DataFrame:
        """(query_id, q, cell, far, kth): the cells that may hold one of a query's k nearest rows, after a look at its nearest cells."""
        bounds = tables.write(self.bounds(queries), "bounds")
        before = F.sum("n").over(Window.partitionBy("query_id").orderBy("far", "cell").rowsBetween(Window.unboundedPreceding, -1))
        first = tables.write(bounds.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k), "first")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance"))
        best = self._distances(first.select("query_id", "q", "cell"), False, k).withColumn("nth", rank).where(F.col("nth") <= k)
        # Fewer than k rows in all: nothing is too far.
        kth = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.sqrt(F.max("distance"))).otherwise(F.lit(float("inf"))).alias("kth"))
        return tables.write(bounds.join(kth, "query_id").where(F.col("low") <= F.col("kth") + F.col("far") * SLACK).drop("low", "n"), "needed")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, id, distance): the k smallest squared distances to `queries` (query_id, embedding), ties to the smaller id; exact."""
        tables = Tables(queries.sparkSession, "index")
        rank, found = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")), []
        for i, some in enumerate(chunks_of(queries, "query_id", CHUNK_ROWS)):
            best = self._distances(self.needed(some, k, Tables(queries.sparkSession, f"{tables.root.rsplit('/', 1)[1]}-{i}")), True, k)
            found.append(best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance"))
        return reduce(DataFrame.union, _one_by_one(found))
