"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and, for longer words, their first four and five bytes, hashed into buckets. The machine is
score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the distinct terms of a text; the pair term learns what
terms mean together. It is fitted in numpy on a bounded sample of labelled rows (SAMPLE_ROWS, a parameter), over
the buckets whose presence differs between the classes by a likelihood-ratio test, by itself or among the rows that
hold a bucket chosen by itself; all others carry no weight, so a long text of ordinary words is not pushed either
way. Every row's whole text is then scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import Words, bound_batches, hash_sample, in_chunks, mix64, plain

BUCKET_BITS = 20
#: Labelled rows that the fit uses, about: those of the smallest hash of their id.
SAMPLE_ROWS = 8_000
FACTORS, EPOCHS = 4, 30
#: Least likelihood ratio of a term by itself, and of one beside another: those tests are many more.
SCREEN, PAIR_SCREEN = 12.0, 36.0
_NOT_LETTERS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def _terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each term, repeats included."""
    words = Words([None if t is None else t.lower().encode("utf-8", "replace").translate(_NOT_LETTERS).decode("utf-8", "replace") for t in texts])
    doc, length = words.documents(), words.end - words.start
    shift = np.uint64(64 - BUCKET_BITS)
    docs, buckets = [doc], [mix64(words.hash, 1) >> shift]
    for size in (4, 5):
        long = length > size
        docs.append(doc[long])
        buckets.append(mix64(words.hashes(0, size)[long], size) >> shift)
    return np.concatenate(docs), np.concatenate(buckets).astype(np.int64)


def _distinct(docs: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(docs * (1 << BUCKET_BITS) + buckets)
    return pairs >> BUCKET_BITS, pairs & (1 << BUCKET_BITS) - 1


def _collect_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for a, b in in_chunks(rows["text"].tolist()):
            docs, buckets = _distinct(*_terms(rows["text"].tolist()[a:b]))
            cuts = np.searchsorted(docs, np.arange(b - a + 1))
            yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[a:b], "toxic": rows["toxic"].to_numpy()[a:b], "terms": [buckets[i:j].astype(np.int32).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]})


class FactorizationMachine:
    """slot: bucket -> row of w and v, or -1."""

    def __init__(self, slot: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float):
        self.slot, self.w, self.v, self.bias = slot, w, v, bias

    def logits(self, docs: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
        """Of n documents; (docs, slots) are the distinct known terms, by document."""
        sums = np.zeros((n, self.v.shape[1]))
        squares = np.zeros(n)
        np.add.at(sums, docs, self.v[slots])
        np.add.at(squares, docs, (self.v[slots] ** 2).sum(1))
        return self.bias + np.bincount(docs, self.w[slots], n) + 0.5 * ((sums**2).sum(1) - squares)

    def score(self, texts: list[str | None]) -> np.ndarray:
        docs, buckets = _terms(texts)
        slots = self.slot[buckets]
        known = slots >= 0
        pairs = np.unique(docs[known] * np.int64(len(self.w) + 1) + slots[known])
        logits = self.logits(pairs // (len(self.w) + 1), pairs % (len(self.w) + 1), len(texts))
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def _gain(terms: np.ndarray, toxic: np.ndarray, n: int, positives: int, size: int = 1 << BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(likelihood ratio of presence against class, rows that hold it) of each term under `size`; (terms, toxic): one a row and term."""
    in_toxic = np.bincount(terms[toxic], minlength=size).astype(float)
    in_clean = np.bincount(terms[~toxic], minlength=size).astype(float)
    at = np.flatnonzero(in_toxic + in_clean)
    yes, no, base = in_toxic[at], in_clean[at], positives / n
    seen, gain = yes + no, np.zeros(size)

    def part(k: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(expected, 1e-9)), 0)

    gain[at] = 2 * (part(yes, seen * base) + part(no, seen * (1 - base)) + part(positives - yes, (n - seen) * base) + part(n - positives - no, (n - seen) * (1 - base)))
    return gain, in_toxic + in_clean


def fit(terms: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> FactorizationMachine:
    """Screening, then Adagrad on log loss; no rows or one class only: the machine is its bias."""
    n, positives = len(labels), int(labels.sum())
    slot = np.full(1 << BUCKET_BITS, -1, np.int32)
    bias = float(np.log((positives + 0.5) / (n - positives + 0.5)))
    if not positives or positives == n:
        return FactorizationMachine(slot, np.zeros(0), np.zeros((0, FACTORS)), bias)
    docs = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in terms])
    own, flat = np.unique(np.concatenate(terms), return_inverse=True)  # the terms that occur, numbered
    first = np.searchsorted(docs, np.arange(n + 1))
    gain, seen = _gain(flat, labels[docs] == 1, n, positives, len(own))
    chosen = (gain > SCREEN) & (seen >= 3)
    holders = flat[chosen[flat]], docs[chosen[flat]]
    by = np.argsort(holders[0], kind="stable")
    paired = np.zeros_like(chosen)
    for rows in np.split(holders[1][by], np.flatnonzero(np.diff(holders[0][by])) + 1) if len(by) else []:
        toxic = int(labels[rows].sum())
        if 0 < toxic < len(rows):  # what else tells the classes apart among the rows of one chosen term
            sizes = first[rows + 1] - first[rows]
            at = np.repeat(first[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            beside, counts = _gain(flat[at], labels[docs[at]] == 1, len(rows), toxic, len(own))
            paired |= (beside > PAIR_SCREEN) & (counts >= 3)
    chosen = np.flatnonzero(chosen | paired)
    slot[own[chosen]] = np.arange(len(chosen))
    slots = slot[own][flat]
    keep = slots >= 0
    docs, slots = docs[keep], slots[keep].astype(np.int64)
    first = np.searchsorted(docs, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    machine = FactorizationMachine(slot, np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), FACTORS)), bias)
    w2, v2, b2 = np.full(len(chosen), 1e-6), np.full((len(chosen), FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, 128):
            batch = order[at : at + 128]
            sizes = first[batch + 1] - first[batch]
            take = np.repeat(first[batch] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            row, s = np.repeat(np.arange(len(batch)), sizes), slots[take]
            sums = np.zeros((len(batch), FACTORS))
            np.add.at(sums, row, machine.v[s])
            error = 1 / (1 + np.exp(-np.clip(machine.logits(row, s, len(batch)), -30, 30))) - labels[batch]
            gw = np.bincount(s, error[row], len(chosen)) / len(batch)
            gv = np.zeros_like(machine.v)
            np.add.at(gv, s, error[row, None] * (sums[row] - machine.v[s]))
            gv, gb = gv / len(batch), error.mean()
            used = np.unique(s)
            gw[used] += 1e-5 * machine.w[used]
            gv[used] += 1e-4 * machine.v[used]
            w2[used] += gw[used] ** 2
            v2[used] += gv[used] ** 2
            b2 += gb**2
            machine.w[used] -= 0.3 * gw[used] / np.sqrt(w2[used])
            machine.v[used] -= 0.05 * gv[used] / np.sqrt(v2[used])
            machine.bias -= 0.1 * gb / np.sqrt(b2)
    return machine


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """`docs` (doc_id, text) and `labels` (doc_id, toxic); rows with a null id or label are left out."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = hash_sample(known, sample_rows)
    rows = docs.join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), "toxic", "text")  # at most 2 x sample_rows ids
    # One text an id, the first by its terms: an id with many rows neither grows the sample nor makes it depend on arrival.
    firsts = rows.mapInPandas(_collect_terms, "doc_id string, toxic int, terms binary").groupBy("doc_id").agg(F.min(F.struct("toxic", "terms")).alias("r"))
    found = sorted((r["toxic"], bytes(r["terms"])) for r in firsts.select("r.*").collect())
    labels = np.array([y for y, _ in found], np.int64)
    terms = [np.frombuffer(t, np.int32) for _, t in found]
    del found
    return fit(terms, labels)


def _scorer(model):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = model.value
        for rows in batches:
            texts = rows["text"].tolist()
            scores = [machine.score(texts[a:b]) for a, b in in_chunks(texts)]
            yield plain(rows.drop(columns="text").assign(score=np.concatenate(scores) if scores else np.zeros(0)))

    return each


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted (1 from `threshold` on).

    `held_out` is a condition on doc_id, the name of the id here; labels of held-out rows are never read, and a
    row with a null id is not held out. Null and empty texts get the score of no terms. Without labels of both
    classes every row gets the smoothed base rate. Repeated rows stay; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = train(rows.where("not held_out").select("doc_id", "text"), labels.select("doc_id", "toxic").where(~F.coalesce(held_out, F.lit(False))), sample_rows)
    sent = spark.sparkContext.broadcast(model)  # 4 MB of slots, and a row for each term that the sample's tests chose
    id_type = docs.schema[id_col].dataType.simpleString()
    scored = rows.mapInPandas(_scorer(sent), f"doc_id {id_type}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("doc_id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """`docs` without the rows scored `threshold` or more; all columns are kept."""
    spark = docs.sparkSession
    bound_batches(spark)
    out = F.coalesce(held_out, F.lit(False))
    model = train(docs.where(~out).select("doc_id", "text"), labels.select("doc_id", "toxic").where(~out))
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        parts = [sent.value.score(values[a:b]) for a, b in in_chunks(values)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(score(docs["text"]) < threshold)
