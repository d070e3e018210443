"""Mixing sources to target weights: Pareto order sampling, DataFrame functions only.

A source's target in words is a weight share of the whole, capped at `max_repeat` times its size. Each document
first gets the certain whole copies, floor(target / size of source). The remaining word budget is a sample of fixed
size in words, of unequal probabilities: a document's inclusion probability is proportional to its size, p = rate x
size, those that reach 1 are certain, and the rate is such that the expected words are the budget. Documents longer
than the budget have none. The others are ranked by Pareto order, random odds u / (1 - u) divided by inclusion odds
p / (1 - p), and taken from the lowest rank on; one that does not fit in what is left of the budget is passed over. Last,
the one unused document whose size comes closest to what is left is taken if that brings the sum nearer the target.
The random number of a document is a hash of its id, so reruns agree.

Ranks need no sort of a whole source: sizes are summed per (source, bucket of the rank), the bucket in which the budget
ends is found from those sums, and only that bucket's documents are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import WORD_CLASS, Tables, free_names

BUCKETS = 4096
#: Words of room up to which a source's draw is finished in one pass.
TAIL_ROOM = 10_000
#: Fixed weights of the contract, repeating over the sources in code point order.
WEIGHTS = (5, 2, 1)


def _targets(sources: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """(source, source_size, target): shares of the total by weight under caps.

    With sources ordered by cap / weight, those capped are a prefix, so running sums replace iteration. One row a
    source passes through the single-partition windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    named = sources.select("source", "source_size", weight.alias("w"), (F.col("source_size") * max_repeat).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = named.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
        F.sum("source_size").over(whole).alias("total"),
        F.sum("w").over(whole).alias("w_all"),
    )
    level = ranked.withColumn("level", F.try_divide((F.col("total") - F.col("cap_before")).cast("double"), (F.col("w_all") - F.col("w_before")).cast("double")))
    level = level.withColumn("capped", F.col("level") * F.col("w") > F.col("cap"))
    level = level.withColumn("share", F.max(F.when(~F.col("capped"), F.col("level"))).over(whole))
    return level.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("share") * F.col("w")).alias("target"))


def _rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """`targets` with `rate` and `certain_over`: sizes above are certain, smaller ones have probability rate x size.

    With sizes from large to small, a size is certain while the rate that all larger ones leave gives it 1 or more.
    Windows run over distinct sizes, not documents.
    """
    key = targets.select(F.col("source").alias("h_source"), "room", "budget")
    sizes = sizes.where("size > 0").join(key, F.col("source").eqNullSafe(F.col("h_source"))).where("size <= room")
    whole = F.col("size").cast("decimal(18,0)")
    larger = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("budget") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(larger), F.lit(0)).cast("double")
    squares = F.sum((F.col("n") * whole).cast("decimal(19,0)") * whole).over(up_to).cast("double")
    rated = sizes.select("source", "size", (left / squares).alias("rate"))
    best = rated.where("rate * size < 1").groupBy("source").agg(F.max(F.struct("size", "rate")).alias("top"))
    best = best.select(F.col("source").alias("b_source"), F.col("top.size").alias("top"), F.col("top.rate").alias("rate"))
    return targets.join(best, F.col("source").eqNullSafe(F.col("b_source")), "left").drop("b_source").withColumn("certain_over", F.coalesce("top", F.lit(0))).drop("top")


def _within(rows: DataFrame) -> DataFrame:
    """`rows` with `drawn`: whether the sizes up to a row, in order of rank in its source, stay within `room`."""
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("b_size"), F.first("room").alias("b_room"))
    upto = Window.partitionBy("source").orderBy("bucket")
    ends = sums.withColumn("b_before", F.sum("b_size").over(upto) - F.col("b_size")).select(
        F.col("source").alias("e_source"), F.col("bucket").alias("e_bucket"), "b_before", (F.col("b_before") + F.col("b_size") <= F.col("b_room")).alias("b_whole"), (F.col("b_before") >= F.col("b_room")).alias("b_none")
    )
    placed = rows.join(ends, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("bucket") == F.col("e_bucket")))
    inside = Window.partitionBy("source", "bucket").orderBy("rank", F.col("doc_id").asc_nulls_last(), "row")
    split = placed.where("not b_whole and not b_none").withColumn("sum_to", F.col("b_before") + F.sum("size").over(inside)).withColumn("drawn", F.col("sum_to") <= F.col("room"))
    return placed.where("b_whole or b_none").withColumn("drawn", F.col("b_whole")).unionByName(split.drop("sum_to")).drop("e_source", "e_bucket", "b_before", "b_whole", "b_none")


def _tail(open_: DataFrame, most: int) -> DataFrame:
    """(source, row, size): what the draw takes of `open_`, whose rooms are at most `most` words.

    Of equal sizes those of lower rank are taken, at most room / size of them: per source no more than some
    room x log(room) documents meet in one row, however many fit.
    """
    by_size = Window.partitionBy("source", "size").orderBy("rank", F.col("doc_id").asc_nulls_last(), "row")
    few = open_.withColumn("nth", F.row_number().over(by_size)).where(F.col("nth") <= most).where("nth * size <= room")
    listed = few.groupBy("source").agg(F.first("room").alias("room"), F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").isNull().alias("last"), "doc_id", "row", "size"))).alias("docs"))
    kept = "array<struct<row:bigint,size:bigint>>"
    start = F.struct(F.col("room").alias("room"), F.array().cast(kept).alias("kept"))

    def take(a, x):
        one = F.array(F.struct(x["row"].alias("row"), x["size"].alias("size"))).cast(kept)
        return F.when(x["size"] <= a["room"], F.struct((a["room"] - x["size"]).alias("room"), F.concat(a["kept"], one).alias("kept"))).otherwise(a)

    return listed.select("source", F.explode(F.aggregate("docs", start, take, lambda a: a["kept"])).alias("k")).select("source", "k.row", "k.size")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, copies (whole copies in the mix).

    Size is the number of words (null or empty text: 0). Null sources form the last source. A source of size 0
    has target 0. Ties in rank go to the smaller id, null ids last; repeated rows are separate documents. An
    empty table gives an empty result. Other columns of `docs` are not read.
    """
    tables = Tables(docs.sparkSession, "mix")
    draw = (F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(2**52))
    sized = tables.write(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_CLASS)), F.lit(0)).cast("long").alias("size"))
        .withColumns({"u": draw, "row": F.monotonically_increasing_id()}),
        "sized",
    )
    sizes = tables.write(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    sources = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    targets = _targets(sources, weights, max_repeat).withColumn("copies", F.floor(ratio)).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("room", F.floor("budget"))
    plan = tables.write(_rates(sizes, targets), "plan")
    rates = plan.select(F.col("source").alias("t_source"), "room", "rate", "certain_over")
    p = F.col("rate") * F.col("size")
    rank = F.when(F.col("size") > F.col("certain_over"), 0.0).otherwise((F.col("u") / (1 - F.col("u"))) / (p / (1 - p)))
    open_ = sized.where("size > 0").join(rates, F.col("source").eqNullSafe(F.col("t_source"))).where("size <= room")
    open_ = open_.select("doc_id", "row", "source", "size", "room", rank.alias("rank")).withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS))
    names, most = [], TAIL_ROOM + 1
    while most > TAIL_ROOM:  # what does not fit is passed over: the next turn goes on with what fits in the room that is left
        n = len(names)
        turn = tables.write(_within(open_), f"turn{n}")
        left = turn.groupBy("source").agg((F.first("room") - F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0))).alias("room"))
        left = left.select(F.col("source").alias("r_source"), "room")
        names.append(f"turn{n}")
        open_ = turn.where("not drawn").drop("drawn", "room").join(left, F.col("source").eqNullSafe(F.col("r_source"))).where("size <= room").drop("r_source")
        most = left.agg(F.max("room")).first()[0] or 0
    drawn = tables.read(names, f"doc_id {docs.schema[id_col].dataType.simpleString()}, row long, source string, size long, drawn boolean").where("drawn")
    taken = tables.write(drawn.select("source", "row", "size").union(_tail(open_, most)), "taken")
    used = taken.groupBy("source").agg(F.sum("size").alias("words")).select(F.col("source").alias("u_source"), "words")
    gaps = plan.join(used, F.col("source").eqNullSafe(F.col("u_source")), "left").select(F.col("source").alias("g_source"), (F.col("budget") - F.coalesce("words", F.lit(0))).alias("gap"))
    unused = sized.where("size > 0").join(taken.select("row"), "row", "left_anti").join(gaps, F.col("source").eqNullSafe(F.col("g_source")))
    closest = (
        unused.groupBy("source", "gap")
        .agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("miss"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("c"))
        .where("c.miss < gap")
        .select(F.col("c.row").alias("row"))
    )
    more = taken.select("row").union(closest).select(F.col("row").alias("m_row"))
    tables.drop("sizes", *names)
    key = plan.select(F.col("source").alias("t_source"), "source_size", "target", "copies")
    done = sized.join(more, F.col("row") == F.col("m_row"), "left").join(key, F.col("source").eqNullSafe(F.col("t_source")))
    copies = F.when(F.col("size") > 0, F.col("copies") + F.col("m_row").isNotNull().cast("int")).otherwise(1).cast("long")
    return done.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), F.col("row").alias("row_number"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """`docs` with each row as often as the mix takes it, all columns kept; rows without words stay once.

    Copies of a document are equal rows. Ids are expected to be unique; rows that share an id share their copies' sum.
    """
    id_col = options.get("id_col", "doc_id")
    key, copies, rows, nth = free_names(docs, "key", "copies", "rows", "nth")
    found = mix_sources(docs, **options).groupBy(F.col(id_col).alias(key)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
    joined = docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col(key))).where(F.col(copies) > 0)
    each = F.greatest(F.lit(1), F.floor(F.col(copies) / F.col(rows)).cast("int"))
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), each))).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), n AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * 3 AS cap FROM s
), r AS (
  SELECT *, coalesce(sum(cap) OVER b, 0)::BIGINT AS cap_before, coalesce(sum(w) OVER b, 0)::BIGINT AS w_before,
         sum(source_size) OVER ()::BIGINT AS total, sum(w) OVER ()::BIGINT AS w_all
  FROM n WINDOW b AS (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (total - cap_before)::DOUBLE / (w_all - w_before)::DOUBLE AS level FROM r
), c AS (
  SELECT *, level * w > cap AS capped, max(CASE WHEN NOT level * w > cap THEN level END) OVER () AS share FROM l
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE share * w END AS target FROM c
), t2 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS copies FROM t
), t3 AS (
  SELECT *, target - copies * source_size AS budget FROM t2
), e AS (
  SELECT d.doc_id, d.source, d.size, u, source_size, target, copies, budget, floor(budget)::BIGINT AS room
  FROM d JOIN t3 ON d.source IS NOT DISTINCT FROM t3.source
), h AS (
  SELECT source, size, any_value(budget) AS budget, count(*) AS n FROM e WHERE size > 0 AND size <= room GROUP BY source, size
), q AS (
  SELECT source, size, (budget - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(n * size * size) OVER (PARTITION BY source ORDER BY size ROWS UNBOUNDED PRECEDING))::DOUBLE AS rate FROM h
), o AS (
  SELECT source, max(size) AS top, arg_max(rate, size) AS rate FROM q WHERE rate * size < 1 GROUP BY source
), k AS (
  SELECT e.source, doc_id, size, room, CASE WHEN size > coalesce(top, 0) THEN 0 ELSE (u / (1 - u)) / (rate * size / (1 - rate * size)) END AS rank
  FROM e LEFT JOIN o ON e.source IS NOT DISTINCT FROM o.source WHERE size > 0 AND size <= room
), y AS (
  SELECT source, list_reduce(
    [{'room': any_value(room), 'size': 0::BIGINT, 'ids': []::BIGINT[]}] || list({'room': 0::BIGINT, 'size': size, 'ids': [doc_id]} ORDER BY rank, doc_id),
    lambda a, x: CASE WHEN x.size <= a.room THEN {'room': a.room - x.size, 'size': 0::BIGINT, 'ids': a.ids || x.ids} ELSE a END).ids AS ids
  FROM k GROUP BY source
), z AS (
  SELECT e.*, coalesce(list_contains(ids, doc_id), false) AS drawn FROM e LEFT JOIN y ON e.source IS NOT DISTINCT FROM y.source
), g AS (
  SELECT source, any_value(budget) - coalesce(sum(size) FILTER (drawn), 0) AS gap FROM z GROUP BY source
), f AS (
  SELECT arg_min(doc_id, {'miss': abs(size - gap), 'id': doc_id}) AS pick, min(abs(size - gap)) AS miss, any_value(gap) AS gap
  FROM z JOIN g ON z.source IS NOT DISTINCT FROM g.source WHERE NOT drawn AND size > 0 GROUP BY z.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size > 0 THEN copies + (drawn OR doc_id IN (SELECT pick FROM f WHERE miss < gap))::INT ELSE 1 END * size)::BIGINT AS taken
FROM z
"""
