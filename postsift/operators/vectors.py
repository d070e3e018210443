"""Embeddings, clusters, centroids, nearest neighbours and similarity penalties."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_even, post_text, terms
from ..functions.vectors import cosine
from ..tables import Tables, chunks_of

#: Vectors of a chunk that is broadcast.
CHUNK_ROWS = 10_000
#: Queries and rows of one matrix product of distances: 32 MB.
BLOCK_ROWS = 2_000
#: Rows that the starts of k-means are drawn from, at most.
START_ROWS = 10_000


def embed_posts(posts: DataFrame, dimensions: int = 256) -> DataFrame:
    """`posts` with `embedding`: the offline provider, hashed terms weighted by rarity and scaled to length 1."""
    words = posts.withColumn("_words", terms(post_text(F.col("title"), F.col("body")), 0))
    counted = HashingTF(numFeatures=dimensions, inputCol="_words", outputCol="_tf").transform(words)
    weighted = IDF(inputCol="_tf", outputCol="_idf").fit(counted).transform(counted)
    scaled = Normalizer(inputCol="_idf", outputCol="_v").transform(weighted)
    return scaled.withColumn("embedding", vector_to_array("_v", "float32")).drop("_words", "_tf", "_idf", "_v")


def start_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of `sample` by k-means++: each next one in proportion to its squared distance to the nearest so far."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(sample)))]
    far = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = far.sum()
        chosen.append(int(np.searchsorted(np.cumsum(far), rng.random() * total, "right").clip(0, len(sample) - 1)) if total > 0 else int(rng.integers(len(sample))))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(row, centre) squared distances, in one matrix product."""
    return np.maximum((rows**2).sum(1)[:, None] - 2 * (rows @ centres.T) + (centres**2).sum(1)[None, :], 0.0)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield pd.DataFrame({"rows": [np.array(rows["v"].tolist(), np.float64).tobytes()] if len(rows) else []})


def _add(a, b):
    return b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b, strict=True))


def fit_clusters(rows: DataFrame, k: int, seed: int = 42, tries: int = 10, iterations: int = 300, tolerance: float = 1e-4) -> tuple[np.ndarray, float] | None:
    """(centres, cost) of k-means on `embedding`: the lowest cost of `tries` starts; None without vectors.

    All tries share a pass: a task multiplies its rows with the centres of every try that still moves and returns
    sums of `tries` x k rows, which a tree of additions combines. Starts are drawn by k-means++ from a bounded sample
    of rows, those of the smallest hash, so a run can be replayed. A try ends when its centres move less than
    `tolerance` of the mean variance of a component.
    """
    spark, tables = rows.sparkSession, Tables(rows.sparkSession, "kmeans")
    whole = rows.where("size(embedding) > 0").select(F.col("embedding").cast("array<double>").alias("v"))
    sample = np.array([r["v"] for r in whole.orderBy(F.xxhash64("v"), "v").limit(START_ROWS).collect()])
    if not len(sample):
        return None
    width, k = sample.shape[1], min(k, len(sample))
    packed = tables.write(whole.mapInPandas(_packed, "rows binary"), "rows").rdd
    centres = np.stack([start_centres(sample, k, seed + i) for i in range(tries)])
    least = tolerance * float(sample.var(0).mean())
    moving, costs = list(range(tries)), np.full(tries, np.inf)
    for turn in range(iterations + 1):
        sent = spark.sparkContext.broadcast(centres[moving])

        def partial(row, sent=sent):
            data = np.frombuffer(bytes(row["rows"]), np.float64).reshape(-1, width)
            far = _squared(data, sent.value.reshape(-1, width)).reshape(len(data), -1, k)
            near = far.argmin(2)
            # One product adds the rows of every try's clusters: a column a centre, 1 where the row is its own.
            own = np.zeros((len(data), near.shape[1] * k))
            np.put_along_axis(own, near + np.arange(near.shape[1]) * k, 1.0, 1)
            sums, counts = (own.T @ data).reshape(sent.value.shape), own.sum(0).reshape(sent.value.shape[:2])
            return sums, counts, np.take_along_axis(far, near[:, :, None], 2)[:, :, 0].sum(0)

        sums, counts, cost = packed.map(partial).treeAggregate(None, _add, _add)
        sent.unpersist()
        costs[moving] = cost  # of the centres that were sent
        if turn == iterations:
            break
        moved = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], centres[moving])
        shift = ((moved - centres[moving]) ** 2).sum((1, 2))
        going = shift > least
        # A try that ends keeps the centres whose cost is known.
        centres[np.array(moving)[going]] = moved[going]
        moving = [i for i, g in zip(moving, going.tolist(), strict=True) if g]
        if not moving:
            break
    tables.drop("rows")
    best = int(costs.argmin())
    return centres[best], float(costs[best])


def cluster(rows: DataFrame, k: int = 10, seed: int = 42, tries: int = 10, iterations: int = 300) -> DataFrame:
    """`rows` with `cluster_id`: the nearest centre of fit_clusters, at most one cluster a row; null without a vector."""
    fitted = fit_clusters(rows, k, seed, tries, iterations)
    if fitted is None:
        return rows.withColumn("cluster_id", F.lit(None).cast("int"))
    sent = rows.sparkSession.sparkContext.broadcast(fitted[0])

    @F.pandas_udf("int")
    def nearest_centre(vectors: pd.Series) -> pd.Series:
        known = vectors.map(lambda v: v is not None and len(v) > 0)
        out = pd.Series([None] * len(vectors), dtype="Int32")
        if known.any():
            out[known.to_numpy()] = _squared(np.array(vectors[known].tolist(), np.float64), sent.value).argmin(1)
        return out

    return rows.withColumn("cluster_id", nearest_centre(F.col("embedding").cast("array<double>")))


def centroids(rows: DataFrame) -> DataFrame:
    """(cluster_id, size, centroid): element-wise means of vectors of one length; a task sends one vector a cluster."""
    whole = rows.where("size(embedding) > 0").select("cluster_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    means = whole.groupBy("cluster_id").agg(F.count("*").alias("size"), Summarizer.mean(F.col("v")).alias("v"))
    return means.select("cluster_id", "size", vector_to_array("v").alias("centroid"))


def nearest(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, distance): the k smallest squared distances, ties to the smaller id; exact.

    `queries` (query_id, vector) is the stated side: it is broadcast in chunks of bounded size, so the index is read
    once a chunk and neither side shuffles before each task has cut its rows to k a query.
    """
    order, found = Window.partitionBy("query_id").orderBy("distance", "id"), []
    id_type, query_type = index.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    rows = index.select("id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.forall("embedding", lambda x: x.isNotNull()))
    for some in chunks_of(queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")), "query_id", CHUNK_ROWS):
        sent = queries.sparkSession.sparkContext.broadcast([(r["query_id"], r["q"]) for r in some.collect()])  # about CHUNK_ROWS rows
        best = rows.mapInPandas(_nearest_rows(sent, k), f"query_id {query_type}, id {id_type}, distance double")
        found.append(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance"))
    return reduce(DataFrame.union, _one_by_one(found))


def exact_distances(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared distances of rows of `q` to the same rows of `e`, added in the order of the components as SQL adds them."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += (q[:, j] - e[:, j]) ** 2
    return total


def best_rows(q: np.ndarray, e: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) that hold each query's k nearest rows of those `allowed` (query, row), ties to the smaller id.

    A matrix product gives distances up to rounding; all rows within that of the kth are measured exactly.
    """
    far = _squared(q, e)
    if allowed is not None:
        far[~allowed] = np.inf
    slack = 1e-9 * ((q**2).sum(1) + (e**2).sum(1).max(initial=0.0))
    if len(e) > k:
        near = far <= (np.partition(far, k - 1, axis=1)[:, k - 1] + slack)[:, None]
    else:
        near = np.ones(far.shape, bool)
    at, row = np.nonzero(near & np.isfinite(far))
    distance = exact_distances(q[at], e[row])
    by = np.lexsort((ids[row], distance, at))
    at, row, distance = at[by], row[by], distance[by]
    first = np.searchsorted(at, at)
    kept = np.arange(len(at)) - first < k
    return at[kept], row[kept], distance[kept]


def _nearest_rows(sent, k: int):
    """(id, embedding) -> each query's k nearest rows of the task, by the blocks of one matrix product each."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not sent.value:
            return
        names = np.array([n for n, _ in sent.value])
        widths = np.array([-1 if v is None or None in v else len(v) for _, v in sent.value])
        alike = {w: (np.flatnonzero(widths == w), np.array([v for _, v in sent.value if v is not None and None not in v and len(v) == w], np.float64)) for w in set(widths.tolist()) - {-1}}
        held = None
        for rows in batches:
            sizes = rows["embedding"].map(len).to_numpy()
            for width, (places, q) in alike.items():
                same = rows[sizes == width]
                for start in range(0, len(same), BLOCK_ROWS):
                    some = same.iloc[start : start + BLOCK_ROWS]
                    ids, e = some["id"].to_numpy(), np.array(some["embedding"].tolist(), np.float64).reshape(len(some), width)
                    for low in range(0, len(q), BLOCK_ROWS):
                        at, row, distance = best_rows(q[low : low + BLOCK_ROWS], e, ids, k)
                        new = pd.DataFrame({"at": places[at + low], "id": ids[row], "distance": distance})
                        held = new if held is None else pd.concat([held, new])
            held = held.sort_values(["at", "distance", "id"]).groupby("at").head(k) if held is not None else None
        if held is not None:
            yield pd.DataFrame({"query_id": names[held["at"]], "id": held["id"].to_numpy(), "distance": held["distance"].to_numpy()})

    return each


def _one_by_one(parts: list[DataFrame]) -> list[DataFrame]:
    """One plan as it is; several are run and written in turn, so that one broadcast lives at a time."""
    if len(parts) == 1:
        return parts
    tables = Tables(parts[0].sparkSession, "chunks")
    return [tables.write(part, str(i)) for i, part in enumerate(parts)]


def max_similarity(items: DataFrame, history: DataFrame, key: str = "cluster_id", vector: str = "centroid") -> DataFrame:
    """(key, max_similarity): the largest cosine to any vector of `history` (vector), null without history.

    Both sides are one row a cluster of a run; the history is capped by its writer.
    """
    own = items.select(key, F.col(vector).alias("_a"))
    parts = [own.crossJoin(F.broadcast(some)).select(key, cosine(F.col("_a"), F.col("_b")).alias("s")) for some in chunks_of(history.select(F.col("vector").alias("_b")), "_b", CHUNK_ROWS)]
    best = reduce(DataFrame.union, _one_by_one([p.groupBy(key).agg(F.max("s").alias("s")) for p in parts])).groupBy(key).agg(F.max("s").alias("max_similarity"))
    return items.select(key).join(best, key, "left")


def penalized(scores: DataFrame, history: DataFrame, factor: float = 0.3, key: str = "cluster_id", vector: str = "centroid", score: str = "priority_score") -> DataFrame:
    """`scores` with max_similarity and priority_score_adjusted = score (1 - factor max_similarity)."""
    joined = scores.join(max_similarity(scores, history, key, vector), key)
    similarity = F.coalesce("max_similarity", F.lit(0.0))
    return joined.withColumn("max_similarity", similarity).withColumn("priority_score_adjusted", F.col(score) * (1 - factor * similarity))


def penalty_summary(adjusted: DataFrame) -> DataFrame:
    return adjusted.agg(F.avg("max_similarity").alias("mean"), F.max("max_similarity").alias("max"), F.min("max_similarity").alias("min"))


def centroid_novelty(items: DataFrame, history: DataFrame) -> DataFrame:
    """(cluster_id, novelty): 10 (1 - largest cosine) in 0..10; no history: 8; a cluster without a vector: 5."""
    found = items.join(max_similarity(items, history), "cluster_id")
    score = F.greatest(F.lit(0.0), F.least(F.lit(10.0), 10 * (1 - F.col("max_similarity"))))
    value = F.when(F.col("centroid").isNull() | (F.size("centroid") <= 0), 5.0).when(F.col("max_similarity").isNull(), 8.0).otherwise(half_even(score, 1))
    return found.select("cluster_id", value.alias("novelty"))
