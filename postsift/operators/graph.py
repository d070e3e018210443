"""Connected components over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Tables


def connected_components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, root) for each node of `edges` (a, b: long); root is the component's smallest node.

    Alternating large-star and small-star rounds. Each round is a written table, so no lineage grows and
    nothing but a count and a checksum of a round reaches the driver.
    """
    oriented = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    current, mark, turn = tables.write(oriented, "cc0"), None, 0
    while True:
        both = current.union(current.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        middle = tables.write(large, f"cc{turn}_large")
        low = middle.groupBy("u").agg(F.min("v").alias("m"))
        small = middle.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = tables.write(small, f"cc{turn + 1}")
        seen = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        tables.drop(f"cc{turn}", f"cc{turn}_large")
        current, turn = after, turn + 1
        if seen == mark:
            break
        mark = seen
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
