"""Exact dedup: two-pass Bloom filtering, DataFrame functions only.

Pass 1 reads the texts once and keeps (row, id, digest). A counting Bloom filter over the digests (blocks of
32,768 counters, two counters a digest in one block) is reduced to a bitmap of the counters that were hit at
least twice. Pass 2 tests each digest: only rows whose counters are both set can have a copy; those rows
shuffle on their digest and are grouped exactly, the others pass straight through. No text shuffles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import Tables, drop_rows, normalised

BLOCK_BITS = 32_768  # what bitmap_construct_agg holds
COUNTERS_A_ROW = 16
#: Bitmaps of up to so many bytes, those of some 33 million rows, are broadcast; larger ones are joined by shuffling
#: narrow rows, in SALTS parts a block.
BROADCAST_BYTES = 64 << 20
SALTS = 16


def _bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), position % 8)) % 2 == 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; texts are equal after each run of ASCII white space becomes one space. The row
    with the smallest id stays; a null id comes last, and of rows that repeat an id exactly one stays. An empty
    table gives an empty result. Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "exact")
    digests = tables.write(
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha"))
        .withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    rows = max(1, digests.count())
    blocks = max(1, math.ceil(rows * COUNTERS_A_ROW / BLOCK_BITS))
    placed = digests.withColumns({
        "block": F.pmod(F.xxhash64("sha"), F.lit(blocks)),
        "p1": F.pmod(F.xxhash64("sha", F.lit(1)), F.lit(BLOCK_BITS)).cast("int"),
        "p2": F.pmod(F.xxhash64("sha", F.lit(2)), F.lit(BLOCK_BITS)).cast("int"),
    })
    counters = placed.select("block", F.explode(F.array_distinct(F.array("p1", "p2"))).alias("p")).groupBy("block", "p").agg(F.count("*").alias("n"))
    repeated = counters.where("n >= 2").groupBy("block").agg(F.bitmap_construct_agg(F.col("p").cast("long")).alias("bitmap"))
    bitmaps = tables.write(repeated, "bitmaps")
    if blocks * BLOCK_BITS // 8 <= BROADCAST_BYTES:
        tested = placed.join(F.broadcast(bitmaps), "block", "left")
    else:  # a text with many copies is one block's
        salted = bitmaps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        tested = placed.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["block", "salt"], "left")
    maybe = F.coalesce(_bit(F.col("bitmap"), F.col("p1")) & _bit(F.col("bitmap"), F.col("p2")), F.lit(False))
    tested = tables.write(tested.select("doc_id", "sha", "row", maybe.alias("maybe")), "tested")
    tables.drop("digests")

    suspects = tested.where("maybe")
    groups = (
        suspects.groupBy("sha")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("keep"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("sha").alias("g_sha"), "keep", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("g_salt"))
    )
    joined = suspects.join(groups, (F.col("sha") == F.col("g_sha")) & (F.pmod("row", F.lit(SALTS)) == F.col("g_salt")), "left")
    grouped = joined.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("keep.row") == F.col("row"))).alias("kept"),
        "sha",
    )
    alone = tested.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    out = alone.union(grouped)
    return out.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that exact_dedup drops, all columns kept; rows that repeat an id and a text stay once."""
    found = exact_dedup(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"), "kept")
    keys = {"id": F.col(f"`{id_col}`"), "sha": F.sha2(normalised(F.col(f"`{text_col}`")), 256)}
    return drop_rows(docs, keys, found, Tables(docs.sparkSession, "exact"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
