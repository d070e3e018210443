"""File scans: posts, embeddings, line lists, packs, configuration and histories."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ALIASES, POST, as_posts, valid_post

_READ = T.StructType([*[f for f in POST if f.name != "raw"], *[T.StructField(a, POST[n].dataType) for n, a in ALIASES.items()], T.StructField("raw", T.MapType(T.StringType(), T.StringType()))])


def _positioned(df: DataFrame) -> DataFrame:
    """`pos`: order of files by name, and of rows within them. Dense only within a file; its order is what counts."""
    return df.withColumn("pos", F.monotonically_increasing_id())


def read_posts(spark: SparkSession, pattern: str, tolerant: bool = False) -> DataFrame:
    """JSON files of post arrays (or one object a line in *.jsonl).

    Strict: no match raises FileNotFoundError, no rows or a row that is no post ValueError. Tolerant: such rows go.
    """
    lines = pattern.endswith(".jsonl")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in _READ), T.StructField("_corrupt_record", T.StringType())])
    try:
        rows = spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").json(pattern)
        broken = rows.where("_corrupt_record is not null or id is null or title is null")
        if not tolerant:
            counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("_corrupt_record").isNotNull() | F.col("id").isNull() | F.col("title").isNull()).alias("bad")).first()
            if counts["n"] == 0:
                raise ValueError(f"no posts in {pattern}")
            if counts["bad"]:
                raise ValueError(f"{counts['bad']} rows in {pattern} are not posts, e.g. {broken.select('id').first()}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(pattern) from error
        raise
    posts = as_posts(_positioned(rows.drop("_corrupt_record")))
    return posts.where(valid_post(posts))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of a list file, trimmed, without blanks and # comments."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")


def list_packs(spark: SparkSession, folder: str) -> DataFrame:
    """(name): list files *.txt of a folder, by Hadoop's file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*.txt")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = sorted(os.path.splitext(s.getPath().getName())[0] for s in found)
    return spark.createDataFrame([(n,) for n in names], "name string")


def read_sources_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((type, name, category, max_posts), (category, quota)) of a configuration file; both empty if it is missing.

    The file has lists of flat entries and one flat map, so its indentation is read directly.
    """
    try:
        text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    except AnalysisException:
        text = ""
    kinds = {"reddit_sources": "reddit", "stackexchange_sources": "stackexchange"}
    sources, quotas, section, entry = [], [], "", None
    for line in text.split("\n"):
        line = line.split(" #")[0].rstrip()
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        if not line.startswith((" ", "-")):
            section, entry = body.rstrip(":"), None
            continue
        if body.startswith("- "):
            entry = {"type": kinds.get(section, section)}
            sources.append(entry)
            body = body[2:]
        key, _, value = (x.strip().strip("\"'") for x in body.partition(":"))
        if entry is not None:
            entry[key] = value
        elif section == "category_quotas":
            quotas.append((key, int(value)))
    rows = [(s["type"], s.get("name") or s.get("site"), s.get("category", "other"), int(s.get("max_posts", s.get("max_questions", 0)) or 0)) for s in sources]
    return spark.createDataFrame(rows, "type string, name string, category string, max_posts int"), spark.createDataFrame(quotas, "category string, quota int")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding: array<float>)"""
    return spark.read.parquet(path)


def read_history(spark: SparkSession, path: str, schema: str, since: str | None = None, date_col: str = "date") -> DataFrame:
    """A history table, JSON lines or Parquet; unreadable lines and rows before `since` go; a missing one is empty."""
    try:
        if path.rstrip("/").endswith((".json", ".jsonl")):
            rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
            rows = rows.where("_corrupt_record is null").drop("_corrupt_record")
        else:
            rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], schema)
    return rows if since is None else rows.where(F.col(date_col) >= F.lit(since))
