"""Stupid-backoff language-model scores, computed relationally.

Documents are gathered into batches in a written table. For each order, a batch's distinct n-grams and their
counts go, packed, to the shard of their hash; a shard adds the counts of all batches (the n-gram count table,
partitioned by hash) and joins them back by answering each batch with the corpus counts of its own n-grams. A
hot n-gram is one entry a batch, however many documents hold it. Last, each batch meets its answers and sums
log scores per document. Counts cover all documents, so what moves grows with the corpus.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import Tables, Words, bound_batches, pack_counts, plain, runs, unpack_counts, within

BATCH_CHARS = 3_000_000
#: Entries that one task counts at a time: 8 MB of keys.
SHARD_KEYS = 1_000_000


def _gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows -> batches of about BATCH_CHARS characters."""
    from pyspark import TaskContext

    part, turn = TaskContext.get().partitionId(), 0

    def batch(ids: list, texts: list) -> pd.DataFrame:
        words = int(Words(texts, hashed=False).count.sum())
        return plain(pd.DataFrame({"batch": [f"{part}-{turn}"], "words": [words], "payload": [pickle.dumps((ids, texts), 5)]}))

    ids, texts, size = [], [], 0
    for rows in batches:
        new = rows["doc_id"].astype(object).where(rows["doc_id"].notna(), None).tolist()
        for doc, text in zip(new, rows["text"].tolist(), strict=True):
            ids.append(doc)
            texts.append(text)
            size += len(text or "")
            if size >= BATCH_CHARS:
                yield batch(ids, texts)
                ids, texts, size, turn = [], [], 0, turn + 1
    if ids:
        yield batch(ids, texts)


def _grams(texts: list, order: int, shards: int):
    """(words, positions, index of each position's n-gram, n-grams by shard, their counts, shards used, first of each and past the last).

    The shard comes from a second, independent hash, and keys are compared within a shard: the identity of an n-gram
    has 64 bits and those of the shard's number, so collisions stay rare as the corpus and the shards grow.
    """
    words = Words([t if t is None else t.encode("utf-8", "replace").lower().decode() for t in texts])
    at = within(words, order)
    keys = runs(words.hash, order)[at] if len(at) else np.zeros(0, np.uint64)
    own, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    other = runs(words.hashes(1), order, 1)[at][first] if len(at) else own
    shard = (other % np.uint64(shards)).astype(np.int64)
    by = np.argsort(shard, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    cuts = np.flatnonzero(np.diff(shard[by], prepend=-1))
    return words, at, place[inverse], own[by], counts[by], shard[by][cuts], np.append(cuts, len(by))


def _send(order: int, shards: int):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, payload in zip(rows["batch"], rows["payload"], strict=True):
                _, _, _, keys, counts, used, cuts = _grams(pickle.loads(payload)[1], order, shards)
                yield plain(pd.DataFrame({"batch": name, "shard": used.astype(np.int32), "keys": [keys[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], "counts": [pack_counts(counts[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]}))

    return each


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard: corpus counts of its n-grams, and each batch's share of them."""
    sizes = np.array([len(x) // 8 for x in rows["keys"]])
    keys = np.frombuffer(b"".join(rows["keys"]), np.uint64)
    _, inverse = np.unique(keys, return_inverse=True)
    own = np.concatenate([unpack_counts(x) for x in rows["counts"]])
    total = np.bincount(inverse, weights=own).astype(np.int64)[inverse]
    ends = np.cumsum(sizes)
    return plain(pd.DataFrame({"batch": rows["batch"], "shard": rows["shard"], "counts": [pack_counts(total[e - n : e]) for e, n in zip(ends, sizes, strict=True)]}))


def _score(order: int, shards: int, total: int, backoff: float, min_count: int):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i, payload in enumerate(rows["payload"]):
                ids, texts = pickle.loads(payload)
                before = score = None
                for n in range(1, order + 1):
                    words, at, gram, keys, *_ = _grams(texts, n, shards)
                    counts = np.zeros(len(keys), np.int64)
                    answers = sorted(rows[f"answers{n}"].iloc[i] if rows[f"answers{n}"].iloc[i] is not None else [], key=lambda x: x["shard"])
                    if answers:
                        counts = np.concatenate([unpack_counts(x["counts"]) for x in answers])
                    here = np.zeros(len(words.start), np.int64)  # count of the n-gram that ends at each word
                    here[at + n - 1] = counts[gram]
                    if n == 1:
                        score = np.log(here / max(total, 1), where=here > 0, out=np.zeros(len(here)))
                    else:
                        kept = np.flatnonzero(here >= min_count)
                        score = score + np.log(backoff)
                        score[kept] = np.log(here[kept] / before[kept - 1])
                        # A word with fewer than n - 1 words before it has no context of this order to back off from.
                        short = np.arange(len(here)) - np.repeat(words.first[:-1], words.count) < n - 1
                        score[short] -= np.log(backoff)
                    before = here
                parts = [float(np.sum(score[a:b])) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                yield pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "n_words": words.count, "log_score": parts})

    return each


def lm_scores(docs: DataFrame, order: int = 3, backoff: float = 0.4, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per input row: id, n_words, log_score (natural log, summed), mean_log_score.

    Words are runs of non-space characters, A-Z lowered. A word's score is count(n-gram) / count(its first n-1
    words) for the longest n-gram up to `order` in its document with a corpus count of at least `min_count`, times
    `backoff` for each order given up; the last is count(word) / words. Counts are over all rows. A text without
    words, null included, has log_score 0 and a null mean. Null and repeated ids are documents of their own; an
    empty table gives an empty result. Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tables = Tables(spark, "lm")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gathered = tables.write(rows.mapInPandas(_gather, "batch string, words long, payload binary"), "gathered", large_rows=True)
    total = gathered.agg(F.sum("words")).first()[0] or 0
    shards = total // shard_keys + 1
    met = gathered.select("batch", "payload")
    for n in range(1, order + 1):
        sent = gathered.select("batch", "payload").mapInPandas(_send(n, shards), "batch string, shard int, keys binary, counts binary")
        counted = sent.groupBy("shard").applyInPandas(_count, "batch string, shard int, counts binary")
        answers = counted.groupBy(F.col("batch").alias(f"b{n}")).agg(F.collect_list(F.struct("shard", "counts")).alias(f"answers{n}"))
        answers = tables.write(answers, f"answers{n}", batch_rows=1, large_rows=True)  # a row is a batch of documents
        met = met.join(answers, F.col("batch") == F.col(f"b{n}"), "left").drop(f"b{n}")
    scored = met.drop("batch").mapInPandas(_score(order, shards, total, backoff, min_count), f"doc_id {id_type}, n_words long, log_score double")
    scored = tables.write(scored, "scored", batch_rows=1)
    tables.drop("gathered", *[f"answers{n}" for n in range(1, order + 1)])
    return scored.select(F.col("doc_id").alias(id_col), "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(ws) AS a, unnest(generate_series(1, len(ws))) AS i FROM w WHERE len(ws) > 0
), g AS (
  SELECT doc_id, i, a, lag(a) OVER d AS b, lag(a, 2) OVER d AS c FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), n AS (
  SELECT doc_id, i, a, b, c, count(*) OVER () AS total,
         count(*) OVER (PARTITION BY a) AS c1,
         count(*) OVER (PARTITION BY b, a) AS c2, count(*) OVER (PARTITION BY c, b, a) AS c3 FROM g
), m AS (
  SELECT *, lag(c1) OVER d AS x1, lag(c2) OVER d AS x2 FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), s AS (
  SELECT doc_id,
    CASE WHEN c IS NOT NULL AND c3 >= 2 THEN ln(c3::DOUBLE / x2)
         WHEN b IS NOT NULL AND c2 >= 2 THEN ln(c2::DOUBLE / x1) + CASE WHEN c IS NULL THEN 0 ELSE ln(0.4) END
         ELSE ln(c1::DOUBLE / total) + CASE WHEN b IS NULL THEN 0 WHEN c IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END AS v
  FROM m
), t AS (SELECT doc_id, sum(v) AS v, count(*) AS n FROM s GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_words, round(coalesce(v, 0), 4) AS log_score FROM w LEFT JOIN t ON w.doc_id = t.doc_id
"""
