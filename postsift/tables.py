"""Written intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Parquet looks at a row group's and a page's size after 100 rows: hundreds of MB where a row has megabytes.
_LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1}
#: Rows of the largest side that is broadcast by hint; a larger one is left to the optimizer.
BROADCAST_ROWS = 100_000


def work_dir(spark: SparkSession) -> str:
    """A folder that all executors share, under spark.checkpoint.dir; set here only where it is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"/tmp/postsift-checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/postsift"


@contextlib.contextmanager
def cleaned_shuffles(spark: SparkSession):
    """Shuffle files of the writes inside go as soon as each has ended: their results are in a table by then."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int | None):
    """Arrow batches of at most `rows` rows for the actions inside; None leaves them as they are."""
    before = spark.conf.get(_ARROW, "10000")
    if rows:
        spark.conf.set(_ARROW, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ARROW, before)


class Tables:
    """Intermediate tables in the shared folder: they cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, owner: str):
        self.spark, self.root = spark, f"{work_dir(spark)}/{owner}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str, partition_by: str | None = None, batch_rows: int | None = None, large_rows: bool = False) -> DataFrame:
        """`batch_rows` bounds the rows that a Python worker holds at once, `large_rows` row groups and pages by bytes: for rows of megabytes."""
        path = f"{self.root}/{name}"
        out = df.write.mode("overwrite").option("compression", "zstd")
        if large_rows:
            out = out.options(**_LARGE_ROWS)
        with cleaned_shuffles(self.spark), arrow_rows(self.spark, batch_rows):
            (out.partitionBy(partition_by) if partition_by else out).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, names: list[str], schema: str) -> DataFrame:
        """The rows of several tables of one schema."""
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}" for name in names])

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over the cores where it has fewer partitions than there are, as with one small file.

    For plans of costly expressions, such as dozens of patterns a row. Large inputs have more partitions and stay
    as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def chunks_of(df: DataFrame, key: str, rows: int) -> list[DataFrame]:
    """`df` in parts of about `rows` rows, by a hash of `key`: each small enough to be broadcast."""
    parts = max(1, -(-df.count() // rows))
    return [df] if parts == 1 else [df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint when it has at most `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def with_ranks(rows: DataFrame, order: list[Column], tables: Tables, name: str = "sorted") -> DataFrame:
    """`rows` with `rank` (1, 2, 3, ...) in `order`: a sort by ranges, and an offset a partition; no row meets all others."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id numbers the rows of a partition in their order: partition in the upper 31 bits, row in the lower 33.
    laid = tables.write(placed.withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", 33)
    sizes = laid.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))  # one row a partition
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = laid.withColumn("part", part).join(F.broadcast(offsets), "part")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return numbered.withColumn("rank", rank).drop("part", "place", "before")
