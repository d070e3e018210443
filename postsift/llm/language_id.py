"""Language identification by a bidirectional gated recurrent network over bytes, trained and run in numpy.

Two GRUs read the bytes of a segment, one from each end; at every position a linear layer over both states gives
the languages' probabilities. A document's probabilities are the mean over all its positions that hold letters
(ASCII letters and bytes of 128 and over). Long texts are cut into segments of SEGMENT bytes, each read with
MARGIN further bytes on both sides as context, so every byte of every text is labelled once. The network is fitted by back-propagation through
time on a bounded sample of rows with a language (SAMPLE_ROWS, a parameter); tasks draw segments of TRAIN_BYTES bytes
from anywhere in their whole texts, and every step draws from those.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import bound_batches, hash_sample, in_chunks, plain

#: Labelled rows that the fit uses, about: those of the smallest hash of their id.
SAMPLE_ROWS = 4000
UNITS, SEGMENT, MARGIN = 12, 112, 8
STEPS, BATCH, TRAIN_BYTES = 300, 192, 64
#: Segments that a text of the sample gives to the fit, at most: 4 KB.
DRAWN_SEGMENTS = 64
_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


class BiGru:
    """For each direction: a table of input projections by byte, recurrent weights and biases; and the output layer."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages, n = languages, len(languages)
        self.tables = [rng.normal(0, 0.3, (257, 3 * units)).astype(np.float32) for _ in range(2)]  # 256: padding
        self.recurrent = [(rng.normal(0, 1, (units, 3 * units)) / np.sqrt(units)).astype(np.float32) for _ in range(2)]
        self.out = [rng.normal(0, 0.3, (units, n)).astype(np.float32) for _ in range(2)]
        self.bias = np.zeros(n, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, *self.out, self.bias]

    def states(self, codes: np.ndarray, side: int):
        """codes: (time, rows). States after each step, and what back-propagation needs."""
        table, u = self.tables[side], self.recurrent[side]
        k = u.shape[0]
        steps, rows = codes.shape
        state = np.zeros((rows, k), np.float32)
        states, kept = np.empty((steps, rows, k), np.float32), []
        for t in range(steps) if not side else range(steps - 1, -1, -1):
            x, s = table[codes[t]], state @ u
            gates = x[:, : 2 * k] + s[:, : 2 * k]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            reset, update = gates[:, :k], gates[:, k:]
            fresh = reset * s[:, 2 * k :]
            fresh += x[:, 2 * k :]
            np.tanh(fresh, out=fresh)
            kept.append((state, reset, update, s[:, 2 * k :], fresh))
            state = fresh + update * (state - fresh)
            states[t] = state
        return states, kept

    def run(self, codes: np.ndarray, side: int) -> np.ndarray:
        """The states of `states`, but for rounding: gates and fresh states lie apart, so that every operation reads whole runs of memory."""
        k = self.recurrent[side].shape[0]

        def split(x: np.ndarray, *shares: int) -> list[np.ndarray]:
            return [np.ascontiguousarray(x[:, g * k : (g + 1) * k] * np.float32(share)) for g, share in enumerate(shares)]

        # exp costs half of tanh. A gate is 1 / (1 + exp(-x)) and tanh(x) is 1 - 2 / (1 + exp(2 x)): signs and twos go into the weights.
        (r_table, u_table, f_table), (r_weights, u_weights, f_weights) = split(self.tables[side], -1, -1, 2), split(self.recurrent[side], -1, -1, 2)
        steps, rows = codes.shape
        states, before = np.empty((steps, rows, k), np.float32), np.zeros((rows, k), np.float32)
        reset, update, fresh, product = (np.empty((rows, k), np.float32) for _ in range(4))
        with np.errstate(over="ignore"):  # an infinite exp is a gate of 0 or a tanh of 1
            for t in range(steps) if not side else range(steps - 1, -1, -1):
                for gate, table, weights in ((reset, r_table, r_weights), (update, u_table, u_weights)):
                    np.take(table, codes[t], axis=0, out=gate, mode="clip")
                    np.matmul(before, weights, out=product)
                    gate += product
                    np.exp(gate, out=gate)
                    gate += 1
                np.matmul(before, f_weights, out=product)
                np.take(f_table, codes[t], axis=0, out=fresh, mode="clip")
                product /= reset
                fresh += product
                np.exp(fresh, out=fresh)
                fresh += 1
                np.divide(-2, fresh, out=fresh)
                fresh += 1
                state = states[t]
                np.subtract(before, fresh, out=state)
                state /= update
                state += fresh
                before = state
        return states

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """(time, rows, languages), a view of an array by language."""
        codes = codes.astype(np.intp)
        logits = np.zeros((len(self.languages), codes.size), np.float32)
        for side in range(2):
            logits += np.matmul(self.out[side].T, self.run(codes, side).reshape(codes.size, -1).T)
        logits += self.bias[:, None]
        logits -= logits.max(0)
        np.exp(logits, out=logits)
        logits /= logits.sum(0)
        return logits.reshape(-1, *codes.shape).transpose(1, 2, 0)

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of all positions that are not padding, and its gradients in the order of parameters()."""
        runs = [self.states(codes, side) for side in range(2)]
        logits = runs[0][0] @ self.out[0] + runs[1][0] @ self.out[1] + self.bias
        logits -= logits.max(-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(-1, keepdims=True)
        real = (codes < 256).astype(np.float32)
        total = max(1.0, float(real.sum()))
        loss = -float((np.log(p[:, np.arange(codes.shape[1]), labels] + 1e-9) * real).sum()) / total
        p[:, np.arange(codes.shape[1]), labels] -= 1
        p *= (real / total)[:, :, None]
        grads = [np.zeros_like(x) for x in self.parameters()]
        grads[6] = p.sum((0, 1))
        for side in range(2):
            states, kept = runs[side]
            u = self.recurrent[side]
            grads[4 + side] = np.einsum("trk,trl->kl", states, p)
            d_states = p @ self.out[side].T
            carry = np.zeros_like(states[0])
            order = range(len(codes)) if not side else range(len(codes) - 1, -1, -1)
            for t, (before, reset, update, s, fresh) in zip(reversed(order), reversed(kept), strict=True):
                d = d_states[t] + carry
                d_fresh = d * (1 - update) * (1 - fresh**2)
                d_update = d * (before - fresh) * update * (1 - update)
                d_reset = d_fresh * s * reset * (1 - reset)
                d_x = np.concatenate([d_reset, d_update, d_fresh], 1)
                d_s = np.concatenate([d_reset, d_update, d_fresh * reset], 1)
                np.add.at(grads[side], codes[t], d_x)
                grads[2 + side] += before.T @ d_s
                carry = d * update + d_s @ u.T
        return loss, grads


def segments_of(text: str) -> list[bytes]:
    """Up to DRAWN_SEGMENTS runs of TRAIN_BYTES bytes of the whole text, at places that follow from its bytes."""
    data = text.encode("utf-8", "replace")
    if len(data) <= TRAIN_BYTES:
        return [data]
    rng = np.random.default_rng(zlib.crc32(data))
    starts = rng.integers(0, len(data) - TRAIN_BYTES + 1, min(DRAWN_SEGMENTS, -(-2 * len(data) // TRAIN_BYTES)))
    return [data[i : i + TRAIN_BYTES] for i in starts.tolist()]


def _draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield plain(pd.DataFrame({"digest": rows["digest"], "lang": rows["lang"], "segments": [segments_of(t) for t in rows["text"]]}))


def train(rows: list[tuple[list[bytes], str]], steps: int = STEPS, seed: int = 0) -> BiGru | None:
    """(segments of a text, language) rows -> network by Adam; None without rows. Languages are drawn equally often, then texts."""
    texts = [([np.frombuffer(x, np.uint8) for x in own], lang) for own, lang in rows if any(own)]
    languages = sorted({lang for _, lang in texts})
    if not languages:
        return None
    net, rng = BiGru(languages, seed=seed), np.random.default_rng(seed)
    by = [[data for data, lang in texts if lang == x] for x in languages]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1 if len(languages) > 1 else 1):
        labels = rng.integers(0, len(languages), BATCH)
        codes = np.full((TRAIN_BYTES, BATCH), 256, np.int64)
        for i, label in enumerate(labels):
            own = by[label][rng.integers(len(by[label]))]
            part = own[rng.integers(len(own))]
            codes[: len(part), i] = part
        _, grads = net.gradients(codes, labels)
        scale = min(1.0, 1.0 / (np.sqrt(sum(float((g**2).sum()) for g in grads)) + 1e-9))
        rate = 0.02 * min(1, step / 20) * (1 - step / (steps + 1)) ** 0.5
        for p, g, (m, v) in zip(net.parameters(), grads, moments, strict=True):
            m += 0.1 * (g * scale - m)
            v += 0.01 * ((g * scale) ** 2 - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def predict(net: BiGru, texts: list[str | None], rows_at_once: int = 1024) -> np.ndarray:
    """(texts, languages): mean probability over the positions that hold letters; NaN without any."""
    data = [np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8) for t in texts]
    size = np.array([len(x) for x in data])
    parts = -(-size // SEGMENT)
    doc = np.repeat(np.arange(len(data)), parts)
    start = np.concatenate([np.zeros(0, np.int64), *[np.arange(n) * SEGMENT for n in parts]]).astype(np.int64)
    flat = np.concatenate([*data, np.zeros(0, np.uint8)])
    base = np.cumsum(size) - size
    sums, counts = np.zeros((len(data), len(net.languages))), np.zeros(len(data))
    offset = np.arange(-MARGIN, SEGMENT + MARGIN)[:, None]
    own = ((offset >= 0) & (offset < SEGMENT)).astype(bool)
    for at in range(0, len(doc), rows_at_once):
        d, s = doc[at : at + rows_at_once], start[at : at + rows_at_once]
        place = s[None, :] + offset
        there = (place >= 0) & (place < size[d][None, :])
        codes = np.where(there, flat[np.where(there, place + base[d][None, :], 0)], np.int16(256))
        use = there & own & np.append(_LETTER, False)[codes]
        p = net.probabilities(codes)[MARGIN:-MARGIN]
        use = use[MARGIN:-MARGIN]
        summed = np.stack([(p[:, :, x] * use).sum(0) for x in range(p.shape[2])], 1)
        np.add.at(sums, d, summed)
        np.add.at(counts, d, use.sum(0))
    with np.errstate(invalid="ignore"):
        return sums / counts[:, None]


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _labeller(model):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = model.value
        for rows in batches:
            texts = rows["text"].tolist()
            names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            for a, b in in_chunks(texts):
                if net is None:
                    continue
                found = predict(net, texts[a:b])
                real = np.array([_has_letter(t) for t in texts[a:b]]) & ~np.isnan(found[:, 0])
                best = np.where(real, np.nan_to_num(found).argmax(1), 0)
                names[a:b] = np.where(real, np.array(net.languages, object)[best], "und")
                scores[a:b] = np.where(real, np.nan_to_num(found)[np.arange(b - a), best], 0.0)
            yield plain(rows.drop(columns="text").assign(lang_pred=names, score=np.clip(scores, 0, 1)))

    return each


def identify_languages(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, steps: int = STEPS) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score (the pooled probability of lang_pred).

    `held_out` is a condition on doc_id, the name of the id here; languages of held-out rows are never read. Null
    texts and texts without a letter are `und` with score 0, as all are where no row has a language. A row with a
    null id is not held out. Repeated rows stay; an empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    known = rows.where("not held_out and lang is not null and text is not null").select("doc_id", "lang", "text", F.xxhash64("text", "lang").alias("digest"))
    picked = hash_sample(known.select("doc_id", "digest"), sample_rows).distinct().select(F.col("doc_id").alias("p_id"), F.col("digest").alias("p_digest"))
    taken = known.join(F.broadcast(picked), F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("digest") == F.col("p_digest")))  # at most 2 x sample_rows ids
    # Tasks send segments, some KB a text, and of repeated rows one.
    drawn = taken.select("digest", "lang", "text").mapInPandas(_draw, "digest long, lang string, segments array<binary>").groupBy("digest").agg(F.min(F.struct("lang", "segments")).alias("r"))
    found = sorted(([bytes(x) for x in r["segments"]], r["lang"]) for r in drawn.select("r.*").collect())
    net = train(found, steps)
    sent = spark.sparkContext.broadcast(net)
    id_type = docs.schema[id_col].dataType.simpleString()
    labelled = rows.select("doc_id", "held_out", "text").mapInPandas(_labeller(sent), f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
    return labelled.withColumnRenamed("doc_id", id_col)
