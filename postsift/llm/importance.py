"""Target-distribution importance resampling in DataFrame functions.

Documents are drawn so that their hashed n-grams look like those of target texts. Feature arrays are exploded, a
feature's bucket is its crc32 modulo the number of buckets, and grouped counts of both corpora give each bucket an
integer gain (a log ratio of its smoothed frequencies). The gain table has one row a bucket, so it is broadcast;
gains are summed by document, and Gumbel noise of a hash of the id turns the mean gain into a score whose largest
values are a sample without replacement. Ranks come from a distributed sort: rows are dealt by ranges of the score,
sorted within their partition, and a partition's first rank is the number of rows before it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import spread, with_ranks
from .support import Tables

BUCKETS = 10_000
#: Buckets up to which the gain table is broadcast (24 bytes a row); with more it is joined by shuffling counts.
BROADCAST_BUCKETS = 1 << 20
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: runs of digits, a-z and all beyond ASCII, after A-Z became a-z; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, BREAKS), "")


def features_of(words: Column, n: int) -> Column:
    """All runs of 1 to n consecutive words, joined by one space."""

    def grams(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (k - 1))
        runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
        return F.when(F.size(words) >= k, runs).otherwise(F.array().cast("array<string>"))

    return words if n == 1 else F.concat(words, *[grams(k) for k in range(2, n + 1)])


def _bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, text_col: str, n: int, buckets: int) -> DataFrame:
    """(bucket, n) of all features of all texts: at most `buckets` rows a task are shuffled."""
    words = texts.select(words_of(F.col(f"`{text_col}`")).alias("words"))
    each = words.select(F.explode(features_of(F.col("words"), n)).alias("feature"))
    return each.groupBy(_bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gain_table(documents: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket from the bucket counts of the documents and of the target."""
    whole = [(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]) for counts in (documents, target)]
    of_docs, of_target = documents.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    all_buckets = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = all_buckets.join(of_docs, "bucket", "left").join(of_target, "bucket", "left")
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = ((t + 1) * F.lit(float(whole[0] + buckets))) / ((s + 1) * F.lit(float(whole[1] + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, n: int = 1, buckets: int = BUCKETS, seed: int = 2024, min_words: int = 20,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (null where it is not drawn), all long.

    `percent` of the documents of at least `min_words` words are drawn (rounded down), those of the highest scores,
    ties to the smaller id, a null id first of all. A null text has no words, and no features weigh 0; the noise of
    a null id is that of the empty text. Rows that repeat an id are judged one by one; of equal rows any may be
    drawn. An empty target leaves every text near its own frequencies; an empty table gives an empty result. Other
    columns are not read.
    """
    tables = Tables(docs.sparkSession, "importance")
    docs = spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    own = tables.write(bucket_counts(docs, "text", n, buckets), "documents")
    wanted = tables.write(bucket_counts(target, target_col, n, buckets), "target")
    gains = tables.write(gain_table(own, wanted, buckets), "gains")

    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words_of(F.col("text")).alias("words"))
    each = texts.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode_outer(features_of(F.col("words"), n)).alias("feature"))
    keyed = each.select("row", "doc_id", "n_words", _bucket(F.col("feature"), buckets).alias("bucket"))
    if buckets <= BROADCAST_BUCKETS:
        gained = keyed.join(F.broadcast(gains), "bucket", "left")
    else:
        gained = keyed.groupBy("row", "doc_id", "n_words", "bucket").agg(F.count("bucket").alias("times")).join(gains, "bucket", "left")
    times = F.count("bucket") if buckets <= BROADCAST_BUCKETS else F.sum("times")
    gain = F.sum("gain") if buckets <= BROADCAST_BUCKETS else F.sum(F.col("gain") * F.col("times"))
    summed = gained.groupBy("row", "doc_id", "n_words").agg(times.alias("n_features"), F.coalesce(gain, F.lit(0)).alias("total"))
    floored = F.expr("(total - pmod(total, n_features)) div n_features")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    scored = summed.withColumn("weight", F.when(F.col("n_features") > 0, floored).otherwise(F.lit(0)).cast("long")).withColumn("score", F.col("weight") + noise)
    scored = tables.write(scored.select("doc_id", "row", "n_words", "n_features", "weight", "score"), "scored")

    long_enough = scored.where(F.col("n_words") >= min_words)
    drawn = percent * long_enough.count() // 100
    # Rows that agree in all that is returned are dealt apart by their number: a repeated row may be a large part of all.
    ranked = with_ranks(long_enough, [F.col("score").desc(), F.col("doc_id").asc(), F.col("n_features").asc(), F.col("row").asc()], tables)
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    short = scored.where(F.col("n_words") < min_words)
    out = ranked.withColumn("rank", rank).unionByName(short.withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, percent: int = 10, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of `docs` that resample draws, all columns kept; rows that share an id are drawn together."""
    found = resample(docs, target, percent, id_col=id_col, **settings).where("rank is not null")
    return docs.join(found.select(F.col(id_col).alias("_drawn")).distinct(), F.col(f"`{id_col}`").eqNullSafe(F.col("_drawn")), "left_semi")


#: crc32 of a word's bytes, by the usual table of 256 remainders, which SQL makes by eight steps each.
SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS turn FROM generate_series(0, 255) g(i)
  UNION ALL
  SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, turn + 1 FROM steps WHERE turn < 8
), crc_table AS (SELECT list(c ORDER BY byte) AS remainders FROM steps WHERE turn = 8
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, words, len(words)::BIGINT AS n_words FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents)
), e AS (SELECT row, unnest(words) AS word FROM d
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), w AS (SELECT DISTINCT word FROM (SELECT word FROM e UNION ALL SELECT word FROM b)
), bytes AS (
  SELECT word, list_transform(generate_series(1, octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT) AS x FROM w
), k AS (
  SELECT word, (xor(list_reduce(x, lambda c, y: xor(c >> 8, remainders[xor(c & 255, y) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000)::INT AS bucket FROM bytes, crc_table
), s AS (SELECT bucket, count(*) AS s FROM e JOIN k USING (word) GROUP BY 1
), t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY 1
), whole AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt
), gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * (ss + 10000)) / ((s::DOUBLE + 1) * (tt + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), whole
), f AS (SELECT row, count(*) AS n, sum(gain)::BIGINT AS total FROM e JOIN k USING (word) JOIN gains USING (bucket) GROUP BY 1
), v AS (
  SELECT doc_id, n_words, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h
  FROM d LEFT JOIN f USING (row)
), z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM v
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS many FROM z
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 10 * many // 100 THEN place END AS rank FROM r
"""
