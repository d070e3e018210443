"""Ranks, firsts of a group, sampling plans and diversification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, scaled
from ..tables import Tables, broadcast_if_small

#: Rows that are diversified in one task.
FOLD_ROWS = 10_000
_ANY = "*any row*"


def rank_by(rows: DataFrame, score: str = "priority_score", order: str = "cluster_id", name: str = "rank") -> DataFrame:
    """Rank by score, null as 0, ties by `order`. For tables of one row a cluster."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), order)))


def top_scores(rows: DataFrame, score: str, n: int = 5, order: str = "cluster_id") -> DataFrame:
    """The n largest of one score, as runs report them; ties by `order`."""
    return rows.orderBy(F.col(score).desc(), order).limit(n)


def firsts(rows: DataFrame, group: str, n: int | Column, order: str = "pos") -> DataFrame:
    """The first n rows of each group; a null or zero n keeps all. Spark cuts groups before the shuffle where n is fixed."""
    numbered = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    limit = n if isinstance(n, Column) else F.lit(n)
    return numbered.where(F.coalesce(F.nullif(limit, F.lit(0)), F.lit(2**31 - 1)) >= F.col("_nth")).drop("_nth")


def apply_quotas(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """First rows of each category up to its quota; a category without one keeps all."""
    joined = rows.join(broadcast_if_small(quotas.select("category", "quota")), "category", "left")
    return firsts(joined, "category", F.col("quota")).drop("quota")


def annotate_category(posts: DataFrame, sources: DataFrame, key: str = "source_name") -> DataFrame:
    named = sources.select(F.col("name").alias(key), "category").dropDuplicates([key])
    return posts.drop("category").join(broadcast_if_small(named), key, "left").withColumn("category", F.coalesce("category", F.lit("other")))


def examples(rows: DataFrame, n: int = 5) -> DataFrame:
    """(cluster_id, examples): the first n posts of each cluster as structs, in order."""
    shown = firsts(rows, "cluster_id", n)
    entry = F.struct("pos", F.struct("id", "url", "title", "score", "comments_count", "source").alias("e"))
    return shown.groupBy("cluster_id").agg(F.array_sort(F.collect_list(entry)).alias("_l")).select("cluster_id", F.transform("_l", lambda x: x["e"]).alias("examples"))


def tiers(clusters: DataFrame, k: int = 5, score: str = "heuristic_score") -> DataFrame:
    """Clusters by heuristic, ties by first appearance; the first k get the heavy model."""
    ranked = rank_by(clusters, score, "first_pos", "heuristic_rank")
    return ranked.withColumn("tier", F.when(F.col("heuristic_rank") <= k, "heavy").otherwise("light"))


def sampling_plan(sources: DataFrame, quotas: DataFrame, budget: int = 800, shares: dict[str, float] | None = None, default_quota: int = 50) -> DataFrame:
    """(type, category, total, per_source, sources): the budget by quota and kind of source."""
    shares = shares or {"reddit": 0.6, "stackexchange": 0.4}
    whole = quotas.agg(F.coalesce(F.nullif(F.sum("quota"), F.lit(0)), F.lit(1)).alias("whole"))
    grouped = sources.groupBy("type", F.coalesce("category", F.lit("other")).alias("category")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("sources"))
    joined = grouped.join(broadcast_if_small(quotas), "category", "left").crossJoin(F.broadcast(whole))  # one row
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("type")]
    total = F.floor(budget * (F.coalesce("quota", F.lit(default_quota)) / F.col("whole")) * share)
    return joined.withColumn("total", total).select("type", "category", "total", F.floor(F.col("total") / F.col("n")).alias("per_source"), "sources")


def sources_by_category(sources: DataFrame) -> DataFrame:
    return sources.groupBy("type", F.coalesce("category", F.lit("other")).alias("category")).agg(F.array_sort(F.collect_list("name")).alias("names"))


def _fold(weight: float, picks: list):
    """Rows (_ord, _norm, embedding, _in) of one task -> (_ord, mmr_rank); a pick is a value of _in, or None for any row."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches, ignore_index=True).sort_values("_ord", kind="stable")
        norm, vectors = rows["_norm"].to_numpy(float), [np.zeros(0) if v is None else np.asarray(v, float) for v in rows["embedding"]]
        whole = np.zeros((len(rows), max(map(len, vectors), default=0)))
        for i, v in enumerate(vectors):
            whole[i, : len(v)] = v
        length = np.sqrt((whole**2).sum(1))
        free, most, out = np.ones(len(rows), bool), None, []
        for pick in picks:
            open_ = free if pick is _ANY else free & (rows["_in"].isna() if pick is None else rows["_in"] == pick).to_numpy(bool)
            if open_.any():
                value = norm if most is None else weight * norm - (1 - weight) * most
                at = int(np.where(open_, value, -np.inf).argmax())
                apart = length * length[at]
                similar = np.where(apart > 0, whole @ whole[at] / np.where(apart > 0, apart, 1), 0.0)
                most = similar if most is None else np.maximum(most, similar)
                free[at] = False
                out.append((int(rows["_ord"].iloc[at]), len(out) + 1))
        yield pd.DataFrame(out, columns=["_ord", "mmr_rank"])

    return each


def _pick(state: DataFrame, weight: float, where: Column) -> tuple | None:
    value = F.when(F.col("max_sim").isNull(), F.col("_norm")).otherwise(weight * F.col("_norm") - (1 - weight) * F.col("max_sim"))
    found = state.where(where & ~F.col("_taken")).agg(F.max(F.struct(value.alias("v"), (-F.col("_ord")).alias("o"), F.col("embedding").alias("e"))).alias("m")).first()["m"]
    return None if found is None else (-found["o"], found["e"])


def _greedy(items: DataFrame, score: str, order: str, weight: float, picks: list, sector: str | None = None, keep: int = 8) -> DataFrame:
    """The rows picked, with mmr_rank; each pick is a value of `sector`, or _ANY.

    Clusters of a run, up to FOLD_ROWS of them, are folded in one task. More take rounds: each reads the items once and
    returns one row; the running largest cosine is a column, and every `keep` rounds it is written out.
    """
    tables = Tables(items.sparkSession, "mmr")
    state = tables.write(scaled(items.withColumn("_ord", F.col(order).cast("long")), score, "_norm"), "m0")
    if state.limit(FOLD_ROWS + 1).count() <= FOLD_ROWS:
        rows = state.select("_ord", F.coalesce("_norm", F.lit(float("-inf"))).alias("_norm"), "embedding", (F.col(sector) if sector else F.lit(None).cast("string")).alias("_in"))
        chosen = rows.coalesce(1).mapInPandas(_fold(weight, picks), "_ord long, mmr_rank int")
        return state.drop("mmr_rank").join(F.broadcast(chosen), "_ord").drop("_norm", "_ord")
    state, rank = state.withColumns({"max_sim": F.lit(None).cast("double"), "_taken": F.lit(False), "mmr_rank": F.lit(None).cast("int")}), 0
    for pick in picks:
        where = F.lit(True) if pick is _ANY else F.col(sector).eqNullSafe(F.lit(pick))
        found = _pick(state, weight, where)
        if found is None:
            continue
        rank += 1
        at, vector = found
        chosen = F.array(*[F.lit(float(x)) for x in vector])
        similarity = cosine(F.col("embedding"), chosen)
        mine = F.col("_ord") == at
        state = state.withColumns({"max_sim": F.greatest(F.coalesce("max_sim", F.lit(-1.0)), similarity), "mmr_rank": F.when(mine, rank).otherwise(F.col("mmr_rank")), "_taken": F.col("_taken") | mine})
        if rank % keep == 0:
            state = tables.write(state, f"m{rank}")
    return state.where("_taken").drop("_norm", "_ord", "max_sim", "_taken")


def mmr(items: DataFrame, k: int, weight: float = 0.7, score: str = "priority_score", order: str = "cluster_id") -> DataFrame:
    """The k rows of largest `weight` x scaled score - (1 - weight) x largest cosine to those before, with mmr_rank.

    The first is the best score; ties go to the smaller `order`.
    """
    return _greedy(items, score, order, weight, [_ANY] * k)


def mmr_by_sector(items: DataFrame, per_sector: int = 2, weight: float = 0.7, score: str = "priority_score", order: str = "cluster_id", sector: str = "sector") -> DataFrame:
    """Sectors by mean score, then up to `per_sector` rows of each; scores are scaled and cosines taken over all."""
    named = items.groupBy(sector).agg(F.avg(score).alias("mean"), F.min(order).alias("first")).orderBy(F.col("mean").desc(), "first")
    sectors = [r[sector] for r in named.collect()]  # the fixed list of sectors
    return _greedy(items, score, order, weight, [s for s in sectors for _ in range(per_sector)], sector)
