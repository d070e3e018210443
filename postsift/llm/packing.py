"""Packing tokenised documents into sequences: shortest-pack-first over the length histogram.

Texts are tokenised once; a document's ids are cut into pieces of the sequence length and a rest. Only the
histogram of piece lengths (at most one entry a length) reaches the driver, where lengths are placed longest
first, each into the packs with the most room, whole groups of equal packs at a time. The result is a list of
patterns with counts; pieces find their place by their rank among the pieces of equal length.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import Tables, Words, bound_batches, in_chunks, plain

END_ID = 2
RANK_SALTS = 64
_CACHE_WORDS = 400_000


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet of such vocabularies: printable bytes stand for themselves, the others follow from code point 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = count(256)
    return {b: chr(b if b in printable else next(spare)) for b in range(256)}


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space: words are tokenised apart and remembered.

    `path` is a tokenizers file whose pre-tokenizer never joins across white space. Words of Latin letters with
    trailing stops, the common case, go to the model directly; all others go through the whole tokenizer.
    """

    _letters = re.compile(r"[a-zß-öø-þ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.stops: dict[bytes, bytes] = {}
        self.letters = {chr(b): "".join(_byte_letters()[x] for x in chr(b).encode()) for b in range(256)}

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        core = word.rstrip(b".,;:!?")
        if core.isalpha():
            name = core.lower()
            ids = self.known.get(name)
            if ids is None:
                ids = self.known[name] = self._piece(name.decode())
        else:
            text = core.decode("utf-8", "replace").lower()
            if not self._letters.fullmatch(text):
                return array("I", self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
            name = text.encode()
            ids = self.known.get(name)
            if ids is None:
                ids = self.known[name] = self._piece("".join(map(self.letters.__getitem__, text)))
        end = word[len(core) :]
        if not end:
            return ids
        if end not in self.stops:
            self.stops[end] = self._piece(end.decode())
        return ids + self.stops[end]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for a, b in in_chunks(texts):
            words = Words(texts[a:b])
            _, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
            odd = np.flatnonzero(~words.equal(np.arange(len(inverse)), first[inverse]))  # another word of the same hash
            inverse[odd] = len(first) + np.arange(len(odd))
            first = np.concatenate([first, odd])
            if len(self.known) > _CACHE_WORDS:
                self.known.clear()
            ids = []
            for i in first.tolist():
                word = words.word(i)
                got = self.known.get(word)
                ids.append(self._word(word) if got is None else got)
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            flat, at = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
            each = sizes[inverse]
            ends = np.concatenate([[0], np.cumsum(each)])
            where = np.repeat(at[inverse] - ends[:-1], each) + np.arange(ends[-1])
            tokens = flat[where]
            for i in range(b - a):
                yield tokens[ends[words.first[i]] : ends[words.first[i + 1]]]


def _gathered(batches: Iterator[pd.DataFrame], chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Arrow batches joined up to about `chars` characters: a word is looked up once for all of them."""
    held, size = [], 0
    for rows in batches:
        held.append(rows)
        size += int(rows["text"].str.len().sum())
        if size >= chars:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _pieces(path: str, capacity: int):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = WordTokenizer(path)
        for rows in _gathered(batches):
            ids = rows["doc_id"].astype(object).where(rows["doc_id"].notna(), None).tolist()
            out = []
            for doc, tokens in zip(ids, tokenizer.encode(rows["text"].tolist()), strict=True):
                data = np.append(tokens, END_ID).astype("<u4")
                for at in range(0, len(data), capacity):
                    part = data[at : at + capacity]
                    out.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(data)))
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            frame["doc_id"] = pd.Series([x[0] for x in out], dtype=object)
            yield frame

    return each


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (packs, [(length, copies), ...]) that hold exactly the pieces of `histogram` (length -> pieces)."""
    groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []

    def add(room: int, packs: int, pattern: list[tuple[int, int]]) -> None:
        if room not in groups:
            groups[room] = []
            heapq.heappush(rooms, -room)
        groups[room].append((packs, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while rooms and not groups[-rooms[0]]:
                del groups[-heapq.heappop(rooms)]
            room = -rooms[0] if rooms else 0
            if room < length:
                copies = min(capacity // length, left)  # a pack just opened is the shortest while it has room
                opened = left // copies
                left -= opened * copies
                add(capacity - copies * length, opened, [(length, copies)])
                continue
            packs, pattern = groups[room].pop()
            if groups[room]:
                second = room
            else:  # how far this group is ahead of the next one
                del groups[-heapq.heappop(rooms)]
                while rooms and not groups[-rooms[0]]:
                    del groups[-heapq.heappop(rooms)]
                second = -rooms[0] if rooms else 0
            copies = min(room // length, max(0, room - second) // length + 1, left)
            filled = min(packs, left // copies)
            left -= filled * copies
            add(room - copies * length, filled, [*pattern, (length, copies)])
            if packs > filled:
                add(room, packs - filled, pattern)
    return [x for room in sorted(groups) for x in groups[room]]


def _slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """length -> rows of (first rank, packs, first sequence, offset), by rank."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for packs, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            first = ranks.get(length, 0)
            slots.setdefault(length, []).append((first, packs, sequence, offset))
            ranks[length] = first + packs * copies
            offset += length * copies
        sequence += packs
    return {k: np.array(v, np.int64) for k, v in slots.items()}


def _place(slots):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = slots.value
        for rows in batches:
            sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for length, at in rows.groupby("length").indices.items():
                own, rank = table[length], rows["rank"].to_numpy()[at]
                hit = own[np.searchsorted(own[:, 0], rank, "right") - 1]
                turn, pack = np.divmod(rank - hit[:, 0], hit[:, 1])
                sequence[at], offset[at] = hit[:, 2] + pack, hit[:, 3] + turn * length
            yield plain(rows.drop(columns="rank").assign(sequence_id=sequence, offset=offset))

    return each


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and END_ID; null and empty texts are END_ID alone. Documents over `capacity` are cut
    into full pieces and a rest. Null and repeated ids are separate documents. Ties in rank go by id, start. An
    empty table gives an empty result. Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tables = Tables(spark, "packing")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = tables.write(rows.mapInPandas(_pieces(tokenizer_path, capacity), f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = spark.sparkContext.broadcast(_slots(shortest_pack_first(histogram, capacity)))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(RANK_SALTS)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))  # at most capacity x RANK_SALTS rows
    before = Window.partitionBy("length").orderBy("salt")
    bases = sizes.select(F.col("length").alias("b_length"), F.col("salt").alias("b_salt"), (F.sum("n").over(before) - F.col("n")).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(inside)).join(F.broadcast(bases), (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt")))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInPandas(_place(slots), f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("doc_id", id_col)
