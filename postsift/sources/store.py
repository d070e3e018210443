"""Stored runs, insights and explorations: Parquet tables with upserts, and the canned queries on them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EXPLORATIONS, INSIGHTS, RUNS
from ..tables import Tables, with_ranks

_SCHEMAS = {"runs": RUNS, "insights": INSIGHTS, "insight_explorations": EXPLORATIONS}
#: What each table is looked up by: files are sorted by the first columns, whose least and largest values let a read skip
#: files and row groups; columns that are looked up by equality out of that order have Bloom filters. With the
#: partitions by run these stand for the six indexes: run, rank, priority and sector of insights, time of runs, insight of explorations.
_SORTED = {"runs": ["created_at", "id"], "insights": ["rank", "id"], "insight_explorations": ["insight_id", "created_at"]}
_BLOOM = {"runs": ["id"], "insights": ["id", "sector"], "insight_explorations": ["insight_id"]}

_TIMES = "spark.sql.parquet.outputTimestampType"


class Store:
    """Tables under one folder. `insights` is partitioned by run_id and sorted by rank; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def init(self) -> None:
        for name, schema in _SCHEMAS.items():
            self._write(self.spark.createDataFrame([], schema), name, "append")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame, name: str, mode: str, by: list[str] | None = None, group_bytes: int | None = None) -> None:
        out = df.sortWithinPartitions(*(["run_id"] if name == "insights" else []), *(by or _SORTED[name])).write.mode(mode)
        for column in _BLOOM[name]:
            out = out.option(f"parquet.bloom.filter.enabled#{column}", "true")
        if group_bytes:
            out = out.option("parquet.block.size", str(group_bytes)).option("parquet.page.size", str(max(1024, group_bytes // 16)))
        out = out.partitionBy("run_id") if name == "insights" else out
        before = self.spark.conf.get(_TIMES, None)
        self.spark.conf.set(_TIMES, "TIMESTAMP_MICROS")  # the older form of times has no least and largest values
        try:
            out.option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{name}")
        finally:
            self.spark.conf.unset(_TIMES) if before is None else self.spark.conf.set(_TIMES, before)

    def compact(self, name: str, by: list[str] | None = None, group_bytes: int | None = None) -> None:
        """Rewrites a table sorted over all its files by `by` (its own order if none), in few files: after many small appends.

        Insights are compacted run by run, by sector or priority for instance: what they are asked for most.
        """
        columns, kept = by or _SORTED[name], f"{self.path}/_compact-{uuid.uuid4().hex[:8]}"
        keys = [*(["run_id"] if name == "insights" else []), *columns]
        rows = self.table(name)
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(kept)  # the table is read and then replaced
        saved = self.spark.read.schema(rows.schema).parquet(kept)
        self._write(saved.repartitionByRange(*keys), name, "overwrite", columns, group_bytes)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(kept)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def save_run(self, run: DataFrame) -> None:
        """Appends; a run id that is there already raises ValueError."""
        known = run.join(self.table("runs").select("id"), "id", "left_semi").select("id").first()
        if known:
            raise ValueError(f"run {known['id']} exists")
        self._write(run.select(*self.table("runs").columns), "runs", "append")

    def save_insights(self, run_id: str, insights: DataFrame) -> None:
        """Upsert by `{run_id}_cluster_{cluster_id}`. Only the run's own partition is read and rewritten."""
        rows = insights.withColumns({
            "id": F.concat(F.lit(f"{run_id}_cluster_"), F.col("cluster_id").cast("string")),
            "run_id": F.lit(run_id),
            "monetizable": F.coalesce(F.col("monetizable").cast("int"), F.lit(0)),
            "example_urls": F.transform(F.filter(F.slice("examples", 1, 3), lambda e: F.coalesce(e["url"], F.lit("")) != ""), lambda e: e["url"]),
        })
        fields = self.spark.createDataFrame([], INSIGHTS).schema
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        merged = upsert(self.table("insights").where(F.col("run_id") == run_id), rows, "id")
        kept = f"{self.path}/_merge-{uuid.uuid4().hex[:8]}"
        merged.write.parquet(kept)  # the partition is read and then replaced
        self._write(self.spark.read.schema(fields).parquet(kept), "insights", "overwrite")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(kept)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def save_exploration(self, rows: DataFrame) -> None:
        """Appends with the next numbers as ids, in order of created_at and insight."""
        last = self.table("insight_explorations").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        rows = with_ranks(rows, [F.col("created_at").asc(), F.col("insight_id").asc()], Tables(self.spark, "store"))
        rows = rows.withColumn("id", F.col("rank") + F.lit(last)).drop("rank")
        fields = self.spark.createDataFrame([], EXPLORATIONS).schema
        self._write(rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]), "insight_explorations", "append")


def upsert(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """`existing` with `rows` in place of those of the same key."""
    return existing.join(rows.select(key), key, "left_anti").unionByName(rows)


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(1)


def list_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return runs.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def run_insights(insights: DataFrame, run_id: str, limit: int | None = None) -> DataFrame:
    """By rank; no limit, or 0, returns all."""
    rows = insights.where(F.col("run_id") == run_id).orderBy("rank", "id")
    return rows.limit(limit) if limit else rows


def insight(insights: DataFrame, insight_id: str) -> DataFrame:
    return insights.where(F.col("id") == insight_id)


def explorations(table: DataFrame, insight_id: str) -> DataFrame:
    return table.where(F.col("insight_id") == insight_id).orderBy(F.col("created_at").desc(), F.col("id").desc())


def _filters(insights: DataFrame, sector: str | None, min_priority: float | None, min_fit: float | None = None, monetizable: bool = False) -> DataFrame:
    if sector is not None:
        insights = insights.where(F.col("sector") == sector)
    if min_priority is not None:
        insights = insights.where(F.col("priority_score") >= min_priority)
    if min_fit is not None:
        insights = insights.where(F.col("founder_fit_score") >= min_fit)
    return insights.where("monetizable = 1") if monetizable else insights


def query_insights(insights: DataFrame, sector: str | None = None, min_priority: float | None = None, min_fit: float | None = None, monetizable: bool = False, limit: int = 50) -> DataFrame:
    """Filters, then the highest priorities."""
    return _filters(insights, sector, min_priority, min_fit, monetizable).orderBy(F.col("priority_score").desc(), "id").limit(limit)


def limit_then_filter(insights: DataFrame, run_id: str, limit: int, sector: str | None = None, min_priority: float | None = None) -> DataFrame:
    """As the service answers: the first ranks, and of those the matching ones."""
    return _filters(run_insights(insights, run_id, limit), sector, min_priority)


def filter_then_limit(insights: DataFrame, run_id: str, limit: int, sector: str | None = None, min_priority: float | None = None) -> DataFrame:
    """As the command line shows: the matching ones, and of those the first ranks."""
    return _filters(insights.where(F.col("run_id") == run_id), sector, min_priority).orderBy("rank", "id").limit(limit)
