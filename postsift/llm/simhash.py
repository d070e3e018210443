"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints within `radius` bits are found without loss: bit i gets a non-zero vector m(i) of radius + 1 bits,
and table v (one for each non-zero v) compares the bits with <m(i), v> = 1. The vectors of up to `radius`
differing bits span less than the whole space, so some v is orthogonal to all of them and that table's masks of
both fingerprints are equal. 2**(radius + 1) - 1 tables; each compares a little over half of the bits.

Links are taken between distinct fingerprints. A bucket of two is a pair at once; one of up to `bucket_limit`
fingerprints is searched in its row by a vectorised breadth-first search that emits a spanning forest, never all
pairs; a larger one is dealt out by Hamming balls: each fingerprint goes to all patterns within radius - 1 flips
of the bits that the table leaves open, and to those within 1 flip as a centre. Two fingerprints within the radius meet at a
pattern where one is a centre, and all that meet a centre are within the radius of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import Tables, bound_batches, connected_components, drop_rows

BITS = 64
#: Distinct fingerprints of a bucket that one task searches: 32 KB.
BUCKET_LIMIT = 4096
_SHINGLE_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """SimHash of `text`: bit 1 where over half of the shingles' XXH64 have it; no words: 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle_words:
        return digest(joined, seed)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], spaces[: len(words) - shingle_words] + 1])
    ends = np.concatenate([spaces[shingle_words - 1 :], [len(joined)]])
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(starts), _SHINGLE_BLOCK):
        some = zip(starts[i : i + _SHINGLE_BLOCK].tolist(), ends[i : i + _SHINGLE_BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in some], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(shingle_words: int, seed: int):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = np.array([fingerprint(t, shingle_words, seed) for t in rows["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": rows["doc_id"], "fp": found.view(np.int64)})

    return each


def cover_masks(radius: int) -> list[int]:
    """The masks of the covering code, one for each table."""
    side = 2 ** (radius + 1) - 1
    vectors = [i % side + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vectors[i] & v).bit_count() % 2) for v in range(1, side + 1)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _forest(radius: int):
    """Rows of (fps: array of a bucket) -> (a, b), a spanning forest of the links in it."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            left, right = [], []
            for fps in rows["fps"]:
                rest = np.asarray(fps, np.int64)
                while len(rest) > 1:
                    frontier, rest = [rest[0]], rest[1:]
                    while frontier and len(rest):
                        x = frontier.pop()
                        near = np.bitwise_count(rest.view(np.uint64) ^ np.array(x, np.int64).view(np.uint64)) <= radius
                        if near.any():
                            found, rest = rest[near], rest[~near]
                            left.append(np.full(len(found), x, np.int64))
                            right.append(found)
                            frontier.extend(found)
            if left:
                yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})

    return each


def _balls(masks: list[int], radius: int):
    """Rows of (t, fp) -> (t, z, fp, centre): where a fingerprint of a large bucket meets others."""
    flips = {}
    for t, mask in enumerate(masks):
        free = [i for i in range(BITS) if not mask >> i & 1]
        near = [0] + [1 << i for i in free]
        far = [sum(1 << i for i in c) for n in range(2, radius) for c in combinations(free, n)]
        flips[t] = (np.array(near + far, np.uint64), len(near))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for t, fp in zip(rows["t"], rows["fp"], strict=True):
                patterns, centres = flips[t]
                z = (patterns ^ np.array(fp, np.int64).view(np.uint64)).view(np.int64)
                yield pd.DataFrame({"t": np.int32(t), "z": z, "fp": np.int64(fp), "centre": np.arange(len(z)) < centres})

    return each


def near_links(fps: DataFrame, tables: Tables, radius: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b): links between the distinct fingerprints of `fps` (fp: long) that connect all within `radius` bits."""
    masks = cover_masks(radius)
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks)]))
    keyed = fps.select("fp", keys.alias("_")).select("fp", "_.t", "_.k")
    buckets = tables.write(keyed.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
    twos = buckets.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    more = buckets.where("n > 2").select("t", "k", "n")
    members = keyed.join(more, ["t", "k"])
    lists = members.where(F.col("n") <= bucket_limit).groupBy("t", "k").agg(F.collect_list("fp").alias("fps")).select("fps")
    threes = lists.mapInPandas(_forest(radius), "a long, b long")
    large = members.where(F.col("n") > bucket_limit).select("t", "fp")
    met = large.mapInPandas(_balls(masks, radius), "t int, z long, fp long, centre boolean")
    hubs = met.groupBy("t", "z").agg(F.min(F.when(F.col("centre"), F.col("fp"))).alias("a"), F.count("*").alias("n")).where("a is not null and n > 1")
    stars = met.join(hubs.select("t", "z", "a"), ["t", "z"]).select("a", F.col("fp").alias("b")).where("a <> b")
    return twos.union(threes).union(stars).distinct()


def simhash_components(docs: DataFrame, shingle_words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Null, empty and blank texts have fingerprint zero and link like any other. Null ids are passed over when the
    smallest id is taken (a component of null ids only has a null component_id). Repeated rows stay; an empty
    table gives an empty result. Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tables = Tables(spark, "simhash")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = tables.write(rows.mapInPandas(_fingerprints(shingle_words, 42), f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long"), "prints")
    fps = tables.write(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    links = tables.write(near_links(fps.select("fp"), tables, radius, bucket_limit), "links")
    roots = connected_components(links, tables)
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = tables.write(rooted.join(smallest, "root").select(F.col("fp").alias("n_fp"), "component_id"), "named")
    tables.drop("buckets", "links")
    out = prints.join(named, F.col("fp") == F.col("n_fp"))
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """`docs` with one document of each near-duplicate group: the one with the smallest id. All columns are kept.

    Rows with a null id stay. Of rows that repeat a kept id the first by their columns' digest stays.
    """
    found = simhash_components(docs, id_col=id_col, **options).where(F.col(id_col).isNotNull())
    decided = found.select(F.col(id_col).alias("id"), (F.col("component_id") == F.col(id_col)).alias("kept"))
    return drop_rows(docs, {"id": F.col(f"`{id_col}`")}, decided, Tables(docs.sparkSession, "copies"))
