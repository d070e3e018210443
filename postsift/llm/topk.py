"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors are rounded down to integers and laid out in document-range blocks, each with its forward index (the rows)
and, for each term (component), its largest and smallest value. Documents are ordered by the nearest of a bounded
sample of pivots, then by id, so that a block's vectors are alike and its bounds close. A query's bound of a
block sums the term maxima: weight times largest value, or smallest for a negative weight. Each query takes
blocks in falling order of bound and stops at the first whose bound is below its kth best score. The stated
queries go to the blocks in chunks of bounded size, one after another; tasks return their k best for each query, and
a chunk's best are written before the next one starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import Tables, bound_batches, hash_sample

BLOCK_ROWS, GROUP_BLOCKS = 128, 64
#: Rows that order the documents, about: those of the smallest hash of their id.
PIVOTS = 64
#: Bytes of a chunk of queries, which each executor holds.
QUERY_BYTES = 8 << 20
EXACT = 2**53
LONG = 2**63
LARGEST = 1.7976931348623157e308


def _padded(vectors: list, width: int) -> np.ndarray:
    rows = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        rows[i, : len(v)] = v
    return rows


def _assign(pivots):
    """Rows with `near`: the pivot at the least distance. It orders rows and decides no result."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = pivots.value
        half = (centres**2).sum(1) / 2
        for rows in batches:
            vectors = rows["vector"].tolist()
            width = max([centres.shape[1], *map(len, vectors)])
            with np.errstate(over="ignore", invalid="ignore"):
                far = half[None, :] - _padded(vectors, width)[:, : centres.shape[1]] @ centres.T
            yield rows.assign(near=np.nan_to_num(far, nan=np.inf).argmin(1).astype(np.int32))

    return each


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order -> blocks of BLOCK_ROWS."""

    def block(ids: list, vectors: list) -> pd.DataFrame:
        width = max(map(len, vectors))
        rows = _padded(vectors, width)
        small = rows.size == 0 or np.abs(rows).max() < 2**31
        return pd.DataFrame({"ids": [np.array(ids, np.int64).tobytes()], "width": [width], "small": [bool(small)], "rows": [rows.astype(np.int32).tobytes() if small else rows.tobytes()]})

    ids, vectors = [], []
    for rows in batches:
        ids += rows["vec_id"].tolist()
        vectors += rows["vector"].tolist()
        while len(ids) >= BLOCK_ROWS:
            yield block(ids[:BLOCK_ROWS], vectors[:BLOCK_ROWS])
            ids, vectors = ids[BLOCK_ROWS:], vectors[BLOCK_ROWS:]
    if ids:
        yield block(ids, vectors)


def _fit(rows: np.ndarray, width: int) -> np.ndarray:
    return rows[:, :width] if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integer values held as doubles; beyond the range of long it saturates."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).sum(1).max() * np.abs(b).max() < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(whole, -LONG, LONG - 1).astype(np.int64)


class _Search:
    """The k best of some queries over the blocks seen so far; `scored` of `offered` (query, block) pairs were computed."""

    def __init__(self, own_ids: np.ndarray, own: np.ndarray, k: int):
        self.own_ids, self.own, self.k, n = own_ids, own, k, len(own_ids)
        self.best, self.best_ids = np.full((n, k), -LONG, np.int64), np.full((n, k), LONG - 1, np.int64)
        self.found = np.zeros(n, np.int64)
        self.scored = self.offered = 0

    def _merge(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k, none = self.k, -LONG
        mine = self.own_ids[at][:, None] == ids[None, :]
        live = ~mine
        if scores.shape[1] > 4 * k:  # all that reach the kth best of the block, ties included
            masked = np.where(mine, none, scores)
            live &= scores >= np.partition(masked, -k, 1)[:, -k][:, None]
        row, col = np.nonzero(live & (scores >= self.best[at, -1][:, None]))
        if not len(row):
            return
        touched, row = np.unique(row, return_inverse=True)
        who = at[touched]
        rows = np.concatenate([row, np.repeat(np.arange(len(who)), k)])
        held = np.tile(np.arange(k), len(who))
        values = np.concatenate([scores[touched[row], col], self.best[who].ravel()])
        names = np.concatenate([ids[col], self.best_ids[who].ravel()])
        real = np.concatenate([np.ones(len(row), bool), held < np.repeat(self.found[who], k)])
        order = np.lexsort((names, -np.where(values == none, none + 1, values), ~real, rows))
        order = order[real[order]]
        nth = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
        order, nth = order[nth < k], nth[nth < k]
        self.best[who], self.best_ids[who] = none, LONG - 1
        self.best[who[rows[order]], nth], self.best_ids[who[rows[order]], nth] = values[order], names[order]
        self.found[who] = np.bincount(rows[order], minlength=len(who))

    def group(self, blocks: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Takes (ids, rows) blocks, for each query in falling order of its bounds."""
        width = max(self.own.shape[1], *(b.shape[1] for _, b in blocks))
        mine = _fit(self.own, width)
        rows = [_fit(b, width) for _, b in blocks]
        most, least = np.array([b.max(0) for b in rows]), np.array([b.min(0) for b in rows])
        # In doubles; the margin covers their rounding where sums pass 2**53.
        bound = np.maximum(mine, 0) @ most.T + np.minimum(mine, 0) @ least.T
        bound = bound + np.abs(bound) * 1e-9
        order = np.argsort(-bound, axis=1, kind="stable")
        live = np.arange(len(mine))
        self.offered += len(mine) * len(blocks)
        for turn in range(len(blocks)):
            block = order[live, turn]
            keep = (self.found[live] < self.k) | (bound[live, block] >= self.best[live, -1].astype(float))
            live, block = live[keep], block[keep]
            if not len(live):
                break
            self.scored += len(live)
            by = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[by], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(by)], strict=True):
                at = live[by[a:b]]
                ids, values = blocks[block[by[a]]][0], rows[block[by[a]]]
                self._merge(at, _products(mine[at], values), ids)

    def result(self) -> pd.DataFrame:
        nth = np.arange(self.k)[None, :] < self.found[:, None]
        return pd.DataFrame({"query_id": np.repeat(self.own_ids, self.found), "vec_id": self.best_ids[nth], "score": self.best[nth]})


def _search(queries, k: int):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search, held = _Search(*queries.value, k), []
        for rows in batches:
            for ids, width, small, data in zip(rows["ids"], rows["width"], rows["small"], rows["rows"], strict=True):
                values = np.frombuffer(data, np.int32 if small else np.float64).astype(float)
                held.append((np.frombuffer(ids, np.int64), values.reshape(len(ids) // 8, width)))
                if len(held) == GROUP_BLOCKS:
                    search.group(held)
                    held = []
        if held:
            search.group(held)
        yield search.result()

    return each


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query row by inner product of floor(scale x).

    Vectors that are null or hold a null, NaN or infinite component take no part, nor do rows with a null id;
    shorter vectors count as padded with zeros. Ties go to the smaller id. A row that repeats the query's id is
    the query's own; of query rows that share an id the smallest vector asks. With fewer than k candidates all
    are returned; an empty table gives an empty result. Scores beyond the range of long saturate, and components that
    the scale takes beyond the range of double count as its largest value. Other columns are not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    tables = Tables(spark, "topk")
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))

    def lower(x: Column) -> Column:  # doubles from 2**53 on are whole, and may not fit a long
        scaled = F.greatest(F.least(x.cast("double") * scale, F.lit(LARGEST)), F.lit(-LARGEST))
        return F.when(F.abs(scaled) < EXACT, F.floor(scaled).cast("double")).otherwise(scaled)

    lowered = F.transform(F.col(vector_col), lower)
    rows = whole.select(F.col(id_col).cast("long").alias("vec_id"), lowered.alias("vector"), is_query.alias("asks"))
    asked = tables.write(rows.where("asks").groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    near = hash_sample(rows.select("vec_id", "vector"), PIVOTS, "vec_id").collect()  # at most 2 x PIVOTS rows
    if not near:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    near = [r["vector"] for r in sorted(near, key=lambda r: (r["vec_id"], r["vector"]))]
    pivots = spark.sparkContext.broadcast(_padded(near, max(map(len, near))))
    placed = rows.select("vec_id", "vector").mapInPandas(_assign(pivots), "vec_id long, vector array<double>, near int")
    laid = placed.repartitionByRange("near", "vec_id").sortWithinPartitions("near", "vec_id")
    blocks = tables.write(laid.mapInPandas(_blocks, "ids binary, width int, small boolean, rows binary"), "blocks")
    size = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    chunks = max(1, -(-size[0] * 8 * max(1, size[1] or 1) // query_bytes))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = []
    for chunk in range(chunks):
        some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == chunk).collect()  # about query_bytes
        if not some:
            continue
        sent = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in some], np.int64), _padded([r["vector"] for r in some], max(len(r["vector"]) for r in some))))
        hits = blocks.mapInPandas(_search(sent, k), "query_id long, vec_id long, score long")
        ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        tables.write(ranked, f"best{chunk}")
        best.append(f"best{chunk}")
        sent.unpersist()
    tables.drop("blocks", "queries")
    schema = "query_id long, rank int, vec_id long, score long"
    return tables.read(best, schema) if best else spark.createDataFrame([], schema)


SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
