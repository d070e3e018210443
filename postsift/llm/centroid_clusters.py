"""Centroid clustering in exact integers.

Components are rounded down to integers, so distances and means have one exact value however rows are partitioned.
Squared distances are |x|^2 - 2 x.c + |c|^2 with the products of a block of rows in one float64 matrix product.
That is exact while every partial sum stays below 2**53, which the largest magnitudes of rows and centroids
bound; rows and centroids beyond the bound are computed in 64-bit or, last, in Python's integers. A round reads
blocks of packed rows from a table; a tree of additions combines each task's sums, of k rows only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import Tables

#: Rows of a block: 2 MB of 64 doubles.
BLOCK_ROWS = 4_096
EXACT, LONG = 2**53, 2**63


def _pack(width: int):
    """Arrow batches of (vec_id, vector) -> rows of (ids, rows): up to BLOCK_ROWS ids and their doubles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                values = part.column("vector").flatten().to_numpy(zero_copy_only=False)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("vec_id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([np.ascontiguousarray(values, np.float64).tobytes()], pa.binary())], ["ids", "rows"])

    return each


def _scaled(data: bytes, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of packed doubles: whole doubles, or Python integers where one passes the doubles' range."""
    raw = np.frombuffer(data, np.float64).reshape(-1, width)
    with np.errstate(over="ignore"):
        out = np.floor(raw * scale)
    if np.isfinite(out).all():
        return out
    # A double beyond 2**53 is whole, and so is its product.
    return np.array([[int(y) if np.isfinite(y) else int(x) * scale for x, y in zip(r, o, strict=True)] for r, o in zip(raw.tolist(), out.tolist(), strict=True)], object)


def _integers(rows: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in r] for r in rows.tolist()], object).reshape(rows.shape)


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centres: float64, int64 or Python integers, as the magnitudes ask."""
    if not len(rows):
        return np.zeros((0, len(centres)), np.int64)
    # |x|^2 + 2 |x.c| + |c|^2 and all partial sums are at most width (max|x| + max|c|)^2.
    bound = rows.shape[1] * (int(np.abs(rows).max()) + int(np.abs(centres).max())) ** 2
    if bound < EXACT:
        x, c = rows.astype(np.float64), centres.astype(np.float64)
        return ((x**2).sum(1)[:, None] - 2 * (x @ c.T) + (c**2).sum(1)[None, :]).astype(np.int64)
    if bound < LONG:
        x, c = rows.astype(np.int64), centres.astype(np.int64)
    else:
        x, c = _integers(rows), _integers(centres)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row: the nearest of `centres` (Python integers), ties to the smaller number.

    A few large rows or centres do not slow the others: pairs of small ones are multiplied apart.
    """
    width = rows.shape[1]
    small = int((EXACT / width) ** 0.5) // 2 - 1
    row_small, centre_small = np.abs(rows).max(1) <= small, np.array([max(map(abs, c)) <= small for c in centres.tolist()], bool)
    if row_small.all() and centre_small.all():
        far = _distances(rows, centres)
    else:
        far = np.zeros((len(rows), len(centres)), object)
        for rs in (True, False):
            for cs in (True, False):
                r, c = np.flatnonzero(row_small == rs), np.flatnonzero(centre_small == cs)
                if len(r) and len(c):
                    far[np.ix_(r, c)] = _distances(rows[r], centres[c]).astype(object)
    cluster = far.argmin(1)
    return cluster, far[np.arange(len(rows)), cluster]


def _sums(rows: np.ndarray, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(count, sum) of the rows of each cluster, as Python integers."""
    counts = np.bincount(cluster, minlength=k)
    if len(rows) * int(np.abs(rows).max(initial=0)) < LONG:
        own, sums = rows.astype(np.int64), np.zeros((k, rows.shape[1]), np.int64)
    else:
        own, sums = _integers(rows), np.zeros((k, rows.shape[1]), object)
    for i in np.flatnonzero(counts).tolist():
        sums[i] = own[cluster == i].sum(0)
    return counts.astype(object), sums.astype(object)


def _add(a, b):
    return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])


def _assign(centres, width: int, scale: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column("ids"), batch.column("rows"), strict=True):
                cluster, far = nearest(_scaled(data.as_py(), width, scale), centres.value)
                within = np.array([min(int(x), LONG - 1) for x in far.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster, pa.int32()), pa.array(within)], ["vec_id", "cluster", "distance"])

    return each


def start_rows(kept: DataFrame, k: int, seed: int) -> list[list[float]]:
    """Vectors of the k smallest sha256 of `seed:vec_id`, in order; each task sends k rows at most."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = kept.select(mark.alias("mark"), "vector").orderBy(F.col("mark").asc_nulls_last(), "vector").limit(k)
    return [r["vector"] for r in found.collect()]


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly `width` components, none null, NaN or infinite; others give no row. Rows with a
    null id take part and never start a cluster before rows with one; rows that repeat an id are separate, and as
    starts go by their components. Fewer kept rows than `k` make as many clusters; an empty table gives an empty
    result. Two clusters that start at equal vectors leave the larger number empty, and it stays where it is.
    Distances and inertias beyond the range of long are given as its largest value. Other columns are not read.
    """
    spark = vectors.sparkSession
    tables = Tables(spark, "clusters")
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where((F.size(v) == width) & F.coalesce(finite, F.lit(False)))
    kept = kept.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))
    blocks = tables.write(kept.mapInArrow(_pack(width), "ids array<long>, rows binary"), "blocks")
    starts = start_rows(kept, k, seed)
    schema = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts:
        return spark.createDataFrame([], schema)
    centres = np.array([_scaled(np.array(x, np.float64).tobytes(), width, scale)[0] for x in starts], object)
    centres = _integers(centres)
    packed = blocks.select("rows").rdd
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centres)  # k rows

        def partial(row, sent=sent):
            rows = _scaled(bytes(row["rows"]), width, scale)
            return _sums(rows, nearest(rows, sent.value)[0], len(sent.value))

        counts, sums = packed.map(partial).treeAggregate(None, _add, _add, depth=2)
        sent.unpersist()
        moved = np.array([[int(x) // int(n) for x in s] if n else c for c, s, n in zip(centres.tolist(), sums.tolist(), counts.tolist(), strict=True)], object)
        if (moved == centres).all():
            break  # every further round gives the same centroids
        centres = moved
    sent = spark.sparkContext.broadcast(centres)
    assigned = tables.write(blocks.mapInArrow(_assign(sent, width, scale), "vec_id long, cluster int, distance long"), "assigned")
    tables.drop("blocks")
    inertia = {r["cluster"]: int(r["inertia"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}  # k rows
    whole = min(sum(inertia.values()), LONG - 1)
    facts = [(i, min(inertia.get(i, 0), LONG - 1), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centres.tolist())]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = assigned.join(F.broadcast(told), "cluster")
    return out.select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(i: int) -> str:
    far = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    return f"""
), a{i} AS MATERIALIZED (
  SELECT row, vec_id, q, cluster, distance FROM (
    SELECT v.row, v.vec_id, v.q, c.cluster, {far} AS distance, row_number() OVER (PARTITION BY v.row ORDER BY {far}, c.cluster) AS nth FROM v, c{i} c) WHERE nth = 1
), m{i} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY dim) AS q FROM (
    SELECT cluster, dim, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS dim FROM a{i}) GROUP BY 1, 2) GROUP BY 1
), c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m USING (cluster)"""


def sql(k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same rows by DuckDB: a common table for every round."""
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY mark NULLS LAST, q) - 1)::INT AS cluster, q FROM (
    SELECT sha256('{seed}:' || vec_id) AS mark, q FROM v ORDER BY mark NULLS LAST, q LIMIT {k})""" + "".join(map(_round_sql, range(rounds + 1))) + f"""
), inertias AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY 1)
SELECT vec_id, cluster, distance, cluster_inertia, (SELECT sum(cluster_inertia)::BIGINT FROM inertias) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN inertias USING (cluster) JOIN c{rounds} c USING (cluster)
"""


SQL = sql()
