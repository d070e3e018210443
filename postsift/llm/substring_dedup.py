"""Substring dedup: a count-min prefilter, then exact grouping of the windows estimated repeated.

Documents are gathered into batches in a written table. Pass 1 sketches windows by their anchors: the anchor of a
window of `width` words is the least hash of a run of (width + 1) // 2 words in it, the leftmost of equals. Equal windows
have equal anchors at different places, so the count of an anchor's places is an upper bound of the count of each of
its windows, and neighbouring windows share one: some 0.1 entries a word. A batch's sketch has two rows of cells,
saturating at two, and travels in ranges of cells; the sketches of a range are added by one task, which answers each
batch with one bit an entry: reached twice? Cells and ranges grow with the data, so the estimate stays as sharp.
Pass 2 groups the windows estimated repeated by 128 bits of two independent hashes of their words: each batch sends its
distinct keys, packed, to the key's shard, and the shard answers with one bit a key. Documents without such windows
are finished in the pass itself.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import Tables, Words, bound_batches, mix64, plain, runs, within

#: Cells of a sketch row: four an anchor, at least MIN_CELLS.
MIN_CELLS, ROWS = 1 << 20, 2
#: Sketch entries that one task adds at a time, about.
_SKETCH_FLUSH = 1_000_000
#: Keys that one task groups at a time: 16 MB.
SHARD_KEYS = 1_000_000
_CHUNK_CHARS = 2_000_000


def _anchors(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of the windows, number of each window's anchor, the anchors' hashes); an anchor is one place."""
    at, inner = within(words, width), (width + 1) // 2
    if not len(at):
        return at, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, span = runs(words.hash, inner), width - inner + 1
    value, place, size = grams, np.arange(len(grams)), 1
    while size < span:  # the least of 2, 4, 8, ... runs, at last of two that overlap
        step = min(size, span - size)
        later = value[step:] < value[:-step]
        value = np.where(later, value[step:], value[:-step])
        place = np.where(later, place[step:], place[:-step])
        size += step
    place = place[at]
    first = np.diff(place, prepend=-1) != 0
    return at, np.cumsum(first) - 1, grams[place[first]]


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix64(keys, row + 1) >> np.uint64(64 - bits)).astype(np.int64)


def _gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows -> batches of about _CHUNK_CHARS characters."""
    from pyspark import TaskContext

    part, turn, held, size = TaskContext.get().partitionId(), 0, ([], []), 0

    def batch() -> pd.DataFrame:
        return plain(pd.DataFrame({"batch": [f"{part}-{turn}"], "words": [int(Words(held[1], hashed=False).count.sum())], "payload": [pickle.dumps(held, 5)]}))

    for rows in batches:
        ids, texts = rows["doc_id"].astype(object).where(rows["doc_id"].notna(), None).tolist(), rows["text"].tolist()
        for doc, text in zip(ids, texts, strict=True):
            held[0].append(doc)
            held[1].append(text)
            size += len(text or "")
            if size >= _CHUNK_CHARS:
                yield batch()
                held, size, turn = ([], []), 0, turn + 1
    if held[0]:
        yield batch()


def _sketch(width: int, bits: int, low_bits: int):
    """Batches -> their sketches by row and range: offsets of the cells hit, and one bit each: more than once?"""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, payload in zip(rows["batch"], rows["payload"], strict=True):
                keys = _anchors(Words(pickle.loads(payload)[1]), width)[2]
                for row in range(ROWS if len(keys) else 0):
                    cells, counts = np.unique(_cells(keys, row, bits), return_counts=True)
                    cuts = [*np.flatnonzero(np.diff(cells >> low_bits, prepend=-1)).tolist(), len(cells)]
                    low = (cells & (1 << low_bits) - 1).astype("<u4")
                    packed = [low[i:j].tobytes() + np.packbits(counts[i:j] > 1).tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
                    yield plain(pd.DataFrame({"batch": name, "row": np.int32(row), "range": cells[cuts[:-1]] >> low_bits, "n": np.diff(cuts), "payload": packed}))

    return each


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Adds the sketches of one range of cells; each batch's answer is one bit an entry."""
    sizes = rows["n"].tolist()
    cells = np.concatenate([np.frombuffer(x, "<u4", n) for x, n in zip(rows["payload"], sizes, strict=True)])
    more = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, -1, 4 * n), count=n) for x, n in zip(rows["payload"], sizes, strict=True)])
    _, inverse = np.unique(cells, return_inverse=True)
    twice = (np.bincount(inverse) + np.bincount(inverse, more) > 1)[inverse]
    ends = np.cumsum(sizes)
    return plain(pd.DataFrame({"batch": rows["batch"], "row": rows["row"], "range": rows["range"], "bits": [np.packbits(twice[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]}))


def _repeated(keys: np.ndarray, bits: int, low_bits: int, answers: list) -> np.ndarray:
    """Whether an anchor's cells were all reached twice."""
    told = {(x["row"], x["range"]): x["bits"] for x in answers}
    maybe = np.ones(len(keys), bool)
    for row in range(ROWS if len(keys) else 0):
        cells, inverse = np.unique(_cells(keys, row, bits), return_inverse=True)
        ranges, sizes = np.unique(cells >> low_bits, return_counts=True)
        own = np.concatenate([np.unpackbits(np.frombuffer(told[row, r], np.uint8), count=n) for r, n in zip(ranges.tolist(), sizes.tolist(), strict=True)])
        maybe &= own[inverse].astype(bool)
    return maybe


def _digest(words: Words, doc: int, removed: np.ndarray | None) -> str:
    """SHA-256 of the kept words of a document, joined by one space."""
    a, b = words.first[doc], words.first[doc + 1]
    kept = range(a, b) if removed is None else np.flatnonzero(~removed) + a
    return hashlib.sha256(b" ".join(words.buffer[words.start[i] : words.end[i]] for i in kept)).hexdigest()


PASS_SCHEMA = "kind int, batch string, doc_id {id}, n_words long, kept_sha256 string, shard int, payload binary"


def _candidates(width: int, bits: int, low_bits: int, shards: int):
    """Batches with their answers -> finished rows (kind 0), batches that wait for answers (1), and packed keys for the shards (2)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, payload, answers in zip(rows["batch"], rows["payload"], rows["answers"], strict=True):
                ids, texts = pickle.loads(payload)
                words = Words(texts)
                at, anchor, keys = _anchors(words, width)
                if len(at):
                    at = at[_repeated(keys, bits, low_bits, answers)[anchor]]
                doc = words.documents()[at]
                waiting = np.zeros(len(ids), bool)
                waiting[doc] = True
                done = np.flatnonzero(~waiting)
                if len(done):
                    yield plain(pd.DataFrame({"kind": 0, "batch": None, "doc_id": pd.Series([ids[i] for i in done], dtype=object), "n_words": words.count[done], "kept_sha256": [_digest(words, i, None) for i in done], "shard": 0, "payload": None}))
                if not len(at):
                    continue
                pairs = np.stack([runs(words.hash, width)[at], runs(words.hashes(1), width, 1)[at]], 1)
                keys, inverse, counts = np.unique(pairs.view("V16").ravel(), return_inverse=True, return_counts=True)
                keys = np.ascontiguousarray(keys).view(np.uint64).reshape(-1, 2)
                shard = (keys[:, 0] % np.uint64(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                kept = np.flatnonzero(waiting)
                batch = {"ids": [ids[i] for i in kept], "texts": [texts[i] for i in kept], "doc": np.searchsorted(kept, doc).astype(np.int32), "at": (at - words.first[doc]).astype(np.int64), "key": np.argsort(order)[inverse].astype(np.int32), "shard": shard[order]}
                yield plain(pd.DataFrame({"kind": 1, "batch": [name], "doc_id": [None], "n_words": 0, "kept_sha256": None, "shard": 0, "payload": [pickle.dumps(batch, 5)]}))
                cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
                sent = [keys[order[i:j]].tobytes() + (counts[order[i:j]] > 1).tobytes() for i, j in zip(cuts, [*cuts[1:], len(order)], strict=True)]
                yield plain(pd.DataFrame({"kind": 2, "batch": name, "doc_id": None, "n_words": 0, "kept_sha256": None, "shard": shard[order][cuts], "payload": sent}))

    return each


def _group(rows: pd.DataFrame) -> pd.DataFrame:
    """All packed keys of a shard -> for each batch one bit a key: does it occur twice?"""
    sizes = [len(x) // 17 for x in rows["payload"]]
    keys = np.concatenate([np.frombuffer(x, np.uint64, 2 * n) for x, n in zip(rows["payload"], sizes, strict=True)]).reshape(-1, 2)
    twice = np.concatenate([np.frombuffer(x, bool, n, 16 * n) for x, n in zip(rows["payload"], sizes, strict=True)])
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    sorted_keys = keys[order]
    group = np.cumsum((sorted_keys[1:] != sorted_keys[:-1]).any(1))
    group = np.concatenate([[0], group])
    many = np.bincount(group, weights=1 + twice[order]) > 1
    answer = np.zeros(len(keys), bool)
    answer[order] = many[group]
    ends = np.cumsum(sizes)
    return plain(pd.DataFrame({"batch": rows["batch"], "shard": rows["shard"], "bits": [np.packbits(answer[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]}))


def _finish(width: int):
    """Waiting batches with their answers -> finished rows."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for payload, answers in zip(rows["payload"], rows["answers"], strict=True):
                batch = pickle.loads(payload)
                words = Words(batch["texts"], hashed=False)
                sizes = np.bincount(batch["shard"])
                told = {x["shard"]: x["bits"] for x in answers}
                bits = np.concatenate([np.unpackbits(np.frombuffer(told[s], np.uint8), count=n) for s, n in enumerate(sizes) if n]).astype(bool)
                hit = bits[batch["key"]]
                first = words.first[batch["doc"][hit]] + batch["at"][hit]
                cover = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(cover, first, 1)
                np.add.at(cover, first + width, -1)
                removed = np.cumsum(cover)[:-1] > 0
                parts = [removed[words.first[i] : words.first[i + 1]] for i in range(len(words.count))]
                yield plain(pd.DataFrame({"doc_id": pd.Series(batch["ids"], dtype=object), "n_words": words.count, "n_removed": [int(x.sum()) for x in parts], "kept_sha256": [_digest(words, i, x) for i, x in enumerate(parts)]}))

    return each


def remove_repeated_passages(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", max_cells: int | None = None, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256.

    Every word goes that a window covers whose word sequence also starts elsewhere, in the same document or
    another. Windows are judged on the input. Null text has no words; a text under `width` words loses none.
    Null and repeated ids are carried as they are: each row is a document of its own, so repeated rows remove
    each other's windows. An empty table gives an empty result. Other columns of `docs` are not read. `max_cells`
    bounds the sketch: more windows then take the exact pass, and the result is the same.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tables = Tables(spark, "passages")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gathered = tables.write(rows.mapInPandas(_gather, "batch string, words long, payload binary"), "gathered", large_rows=True)
    total = gathered.agg(F.sum("words")).first()[0] or 0
    anchors = 2 * total // ((width + 1) // 2 + 1)
    bits = max(MIN_CELLS, 4 * anchors).bit_length()
    bits = min(bits, max_cells.bit_length() - 1) if max_cells else bits
    low_bits = min(bits, 32, (4 * _SKETCH_FLUSH).bit_length() - 1)
    sketch = gathered.select("batch", "payload").mapInPandas(_sketch(width, bits, low_bits), "batch string, row int, range long, n int, payload binary")
    merged = sketch.groupBy("row", "range").applyInPandas(_merge, "batch string, row int, range long, bits binary")
    estimates = merged.groupBy(F.col("batch").alias("e_batch")).agg(F.collect_list(F.struct("row", "range", "bits")).alias("answers"))
    estimates = tables.write(estimates, "estimates", batch_rows=1, large_rows=True)  # a row is a batch of documents
    shards = max(1, total // 3 // shard_keys + 1)
    met = gathered.join(estimates, F.col("batch") == F.col("e_batch"), "left").select("batch", "payload", "answers")
    passed = tables.write(met.mapInPandas(_candidates(width, bits, low_bits, shards), PASS_SCHEMA.format(id=id_type)), "passed", partition_by="kind", batch_rows=1, large_rows=True)
    tables.drop("gathered", "estimates")
    packed = passed.where("kind = 2").select("batch", "shard", "payload")
    answers = packed.groupBy("shard").applyInPandas(_group, "batch string, shard int, bits binary")
    answers = tables.write(answers.groupBy("batch").agg(F.collect_list(F.struct("shard", "bits")).alias("answers")), "answers", large_rows=True)
    tables.drop("passed/kind=2")
    waiting = passed.where("kind = 1").select("batch", "payload").join(answers, "batch").select("payload", "answers")
    finished = waiting.mapInPandas(_finish(width), f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string")
    finished = tables.write(finished, "finished", batch_rows=1)
    tables.drop("passed/kind=1", "answers")
    alone = passed.where("kind = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return alone.union(finished).withColumnRenamed("doc_id", id_col)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), p AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35
), k AS (
  SELECT p.doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM p JOIN d USING (doc_id)
), r AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM k
), x AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS j FROM r WHERE n > 1
), m AS (
  SELECT doc_id, list(j) AS js FROM x GROUP BY doc_id
), f AS (
  SELECT d.doc_id, len(w) AS n, list_filter(list_zip(w, generate_series(1, len(w))), lambda e: NOT coalesce(list_contains(js, e[2]), false)) AS kept
  FROM d LEFT JOIN m ON d.doc_id = m.doc_id
)
SELECT doc_id, n AS n_words, n - len(kept) AS n_removed, sha256(array_to_string(list_transform(kept, lambda e: e[1]), ' ')) AS kept_sha256 FROM f
"""
