"""Shared helpers: vectorised words, packed counts, connected components."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..tables import Tables, broadcast_if_small

__all__ = ["Tables", "broadcast_if_small", "connected_components"]

#: ASCII white space, the separator of words in every operator here.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch: bounds a Python worker's memory when texts are long.
BATCH_ROWS = 512


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of at most `rows` rows from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def hash_sample(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """About `rows` rows, those whose key hashes lowest, and never over twice as many; all of a smaller table.

    Rows without a key go by their other columns. Tasks return their own share only, where ordering by the hash
    would have each send `rows` rows; which rows stay does not depend on their order of arrival.
    """
    n = df.count()
    if n <= rows:
        return df
    others = [c for c in df.columns if c != key]
    place = F.pmod(F.when(F.col(key).isNull(), F.xxhash64(*others)).otherwise(F.xxhash64(key)), F.lit(1 << 40))
    return df.where(place < int(rows / n * (1 << 40))).orderBy(place, *others).limit(2 * rows)


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    """`frame` with object columns in place of extension arrays, which may be chunked and then do not convert to Arrow."""
    odd = {c: object for c in frame.columns if not isinstance(frame[c].dtype, np.dtype)}
    return frame.astype(odd) if odd else frame


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names that are no columns of `docs`, in any case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def drop_rows(docs: DataFrame, keys: dict[str, Column], decided: DataFrame, tables: Tables) -> DataFrame:
    """`docs` without the rows whose keys `decided` (the keys by their names, kept: one row each) keeps nowhere.

    Rows that repeat a kept key stay once: the first by their columns' digest. Only keys that go or repeat are sent;
    where they are few no text moves. Keys that are not in `decided` stay.
    """
    names = free_names(docs, *keys, "nth")
    own = [F.col(n) for n in names[:-1]]
    told = decided.groupBy(*keys).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
    t_keys = free_names(docs, *[f"t_{k}" for k in keys])
    told = tables.write(told.withColumnsRenamed(dict(zip(keys, t_keys, strict=True))), "told")
    same = reduce(lambda a, b: a & b, [mine.eqNullSafe(F.col(t)) for mine, t in zip(own, t_keys, strict=True)])
    keyed = docs.withColumns(dict(zip(names, keys.values(), strict=False)))
    left = keyed.join(broadcast_if_small(told.where("not kept").select(*t_keys)), same, "left_anti")
    again = told.where("kept").select(*t_keys)
    if not again.isEmpty():
        again = broadcast_if_small(again)
        digest = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
        once = left.join(again, same, "left_semi").withColumn(names[-1], F.row_number().over(Window.partitionBy(*own).orderBy(digest)))
        left = left.join(again, same, "left_anti").unionByName(once.where(F.col(names[-1]) == 1).drop(names[-1]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


# --- vectorised words ---------------------------------------------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of two hashes in order; it mixes between the steps, so no sums of products cancel."""
    x = a ^ (a >> np.uint64(32))
    x *= np.uint64(_LANES[lane])
    x ^= b
    return mix64(x, lane + 3)


#: Words of over so many bytes are hashed one by one.
_LONG_WORD = 64
_LANES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class Words:
    """Words of a list of texts: one byte buffer, starts and ends in it, hashes of each, and the document of each.

    `hash` is 64 bits of a word's bytes; hashes(1) is 64 further, independent bits.
    """

    def __init__(self, texts: list[str | None], hashed: bool = True):
        encoded = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
        self.buffer = b"\n".join(encoded) + b"\n" * 9  # eight bytes can be read at any byte of a word
        data = np.frombuffer(self.buffer, np.uint8)
        space = _IS_SPACE[data]
        turns = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            turns = np.concatenate([[0], turns])
        self.start, self.end = turns[0::2], turns[1::2]
        text_start = np.concatenate([[0], np.cumsum([len(x) + 1 for x in encoded])])
        self.first = np.searchsorted(self.start, text_start)  # of each document, and one past the last
        self.count = np.diff(self.first)
        if hashed:
            self.hash = self.hashes()

    def hashes(self, lane: int = 0, size: int | None = None) -> np.ndarray:
        """Hashes of the words, or of the first `size` bytes of each (of the whole word where it is shorter)."""
        end = self.end if size is None else np.minimum(self.start + size, self.end)
        length = end - self.start
        at_byte = np.ndarray((len(self.buffer) - 7,), "<u8", self.buffer, strides=(1,))
        out = mix64(length.astype(np.uint64), lane + 1)
        for done in range(0, min(_LONG_WORD, int(length.max(initial=0))), 8):
            open_ = slice(None) if not done else np.flatnonzero((length > done) & (length <= _LONG_WORD))
            left = np.minimum(length[open_] - done, 8).astype(np.uint64)
            eight = at_byte[self.start[open_] + done] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left))
            out[open_] = chain(out[open_], eight, lane)
        for i in np.flatnonzero(length > _LONG_WORD).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.buffer[self.start[i] : end[i]], seed=lane + 1)
        return out

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words at `a` and at `b` have the same bytes."""
        length = (self.end - self.start)[a]
        same = length == (self.end - self.start)[b]
        at_byte = np.ndarray((len(self.buffer) - 7,), "<u8", self.buffer, strides=(1,))
        for done in range(0, min(_LONG_WORD, int(length.max(initial=0))), 8):
            open_ = np.flatnonzero(same & (length > done) & (length <= _LONG_WORD))
            rest = np.uint64(64) - np.uint64(8) * np.minimum(length[open_] - done, 8).astype(np.uint64)
            same[open_] = (at_byte[self.start[a[open_]] + done] ^ at_byte[self.start[b[open_]] + done]) << rest == 0
        for i in np.flatnonzero(same & (length > _LONG_WORD)).tolist():
            same[i] = self.word(a[i]) == self.word(b[i])
        return same

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def word(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.end[i]]


def runs(hashes: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """Hash of each run of `width` consecutive word hashes (runs across documents too; the caller drops those)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, done, out = hashes, 1, 0, None
    while True:  # runs of 1, 2, 4, ... words, joined by the binary digits of the width
        if width & size:
            own = power[done : done + n]
            out = mix64(own, lane + 7) if out is None else chain(out, own, lane)
            done += size
        if done == width:
            return out
        power = chain(power[:-size], power[size:], lane)
        size *= 2


def within(words: Words, width: int) -> np.ndarray:
    """Positions at which a run of `width` words lies in one document."""
    n = len(words.start) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    doc = words.documents()
    return np.flatnonzero(doc[:n] == doc[width - 1 :])


def in_chunks(texts: list, limit: int = 4_000_000):
    """(first, past last) of runs of rows with up to `limit` characters; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as one byte each, those of 255 and over listed behind as (index, value)."""
    over = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + over.astype(np.int64).tobytes() + counts[over].astype(np.int64).tobytes() + np.array([len(over)], np.int64).tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    k = int(np.frombuffer(data[-8:], np.int64)[0])
    body = len(data) - 8 - 16 * k
    out = np.frombuffer(data[:body], np.uint8).astype(np.int64)
    tail = np.frombuffer(data[body:-8], np.int64)
    out[tail[:k]] = tail[k:]
    return out


def normalised(text: Column) -> Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, " ")
