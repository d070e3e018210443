"""Exact similarity joins: token sets by Jaccard, titles by indel ratio.

Both meet only through signatures that any two similar items must share, and send narrow rows (ids, lengths, a bit
sketch) until few candidates are left. A sketch's differing bits are a lower bound of the distance, so it drops pairs
inside the join and never a similar one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..tables import Tables, spread

#: Postings of a token that one task meets; a token with more is dealt over several.
SALT_ROWS = 20_000
#: Bytes of a dictionary of tokens; none is built any more, hashes number the tokens.
DICTIONARY_BYTES = 0
#: Buckets of token hashes whose frequencies every task gets: 8 MB.
TOKEN_BUCKETS = 1 << 20
#: Passes over the postings, and tokens of all sets up to which one is enough.
PASSES, PASS_TOKENS = 4, 2_000_000
#: Words of 64 bits of a token set's parity sketch.
SKETCH_WORDS = 8
#: Pairs of sets compared by sketches in a block's time of one meeting of equal tokens in a join.
SET_PAIRS = 50
#: Sets and tokens of a group, whose pairs with another group's are one task, at most, and at least where cores could take more groups.
GROUP_SETS, GROUP_TOKENS, LEAST_SETS, LEAST_TOKENS = 32_768, 3_000_000, 1_000, 100_000
#: Tokens that a pass ships in any case: 256 MB. Tokens met at a time, sets a batch, and pairs a batch.
PASS_TOKENS_SHIPPED, MET_TOKENS, SET_ROWS, PAIR_ROWS = 32_000_000, 1_000_000, 1_000, 50_000
EPSILON = 1e-9


def _differing(a: str, b: str, words: int) -> Column:
    return reduce(add, [F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(words)])


def _parts(df: DataFrame) -> int:
    """Partitions for rows that are few in bytes and costly each: adaptive execution would join them into few."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


# --- token sets ---------------------------------------------------------------------------------


def _frequency_table(sets: DataFrame) -> np.ndarray:
    """How many sets hold a token of each of TOKEN_BUCKETS buckets of token hashes: a bounded table, by 256 packed rows."""
    bucket = F.pmod(F.col("id"), F.lit(TOKEN_BUCKETS))
    counted = sets.select(F.explode(F.transform("tokens", lambda t: F.xxhash64(t))).alias("id")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("times"))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [rows["bucket"].to_numpy(np.int64).tobytes()], "times": [rows["times"].to_numpy(np.int64).tobytes()]})

    table = np.zeros(TOKEN_BUCKETS, np.int64)
    for r in counted.groupBy(F.pmod("bucket", F.lit(256)).alias("part")).applyInPandas(packed, "bucket binary, times binary").collect():
        table[np.frombuffer(r["bucket"], np.int64)] = np.frombuffer(r["times"], np.int64)
    return table


def _assembled(frequency):
    """(node, ids) -> a row a node, its ids from rare to frequent, with a sketch."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sizes = np.array([len(x) for x in rows["ids"]], np.int64)
            if not sizes.any():
                continue
            rows, sizes = rows[sizes > 0], sizes[sizes > 0]
            ids, owner = np.concatenate(rows["ids"].tolist()).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
            df = frequency.value[ids % TOKEN_BUCKETS]
            by = np.lexsort((ids, df, owner))
            ids, df, starts = ids[by], df[by], np.cumsum(sizes) - sizes
            hashed = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            word, bit = hashed // np.uint64(64) % np.uint64(SKETCH_WORDS), np.uint64(1) << hashed % np.uint64(64)
            words = {f"x{k}": np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), starts).view(np.int64) for k in range(SKETCH_WORDS)}
            yield pd.DataFrame({"node": rows["node"].to_numpy(), "n": sizes.astype(np.int32), "ids": np.split(ids, starts[1:]), "dfs": np.split(df, starts[1:]), **words})

    return each


def numbered_sets(sets: DataFrame, tables: Tables) -> DataFrame:
    """(node, n, ids, dfs, x0..): non-empty sets as arrays of token hashes, rare tokens first, at most how many sets hold each, and a sketch.

    Frequencies are those of TOKEN_BUCKETS buckets, which every task gets, so no token is shuffled to be numbered; a
    token whose bucket is full counts as frequent. A sketch's bit is the parity of the tokens that hash to it.
    """
    sent = sets.sparkSession.sparkContext.broadcast(_frequency_table(sets))
    schema = "node long, n int, ids array<long>, dfs array<long>, " + ", ".join(f"x{k} long" for k in range(SKETCH_WORDS))
    return sets.where("size(tokens) > 0").select("node", F.transform("tokens", lambda t: F.xxhash64(t)).alias("ids")).mapInPandas(_assembled(sent), schema)


def set_candidates(numbered: DataFrame, threshold: float, passes: int = 1, turn: int = 0) -> DataFrame:
    """(a, b) pairs of `numbered` sets that may be similar, the shorter set first; each pair once.

    Two similar sets share a token among the first n - ceil(threshold n) + 1 of the longer and the first
    n - ceil(2 threshold / (1 + threshold) n) + 1 of the shorter, all but one of the tokens that they must share lie
    behind the first one, and their lengths differ by the threshold at most: postings are split by bands of length,
    and by parts where a token has many. A token of one set alone meets nothing. With `passes`, only the tokens of
    pass `turn` meet.
    """
    words = [f"x{k}" for k in range(SKETCH_WORDS)]
    first = lambda share: (F.col("n") - F.ceil(F.col("n") * share - EPSILON) + 1).cast("int")
    prefix = F.slice(F.arrays_zip("ids", "dfs"), F.lit(1), first(threshold))
    # A band spans slightly more than the threshold's ratio, so partners lie in the same or in the next one.
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(1 / threshold) + 1e-6)).cast("int") if threshold < 1 else F.col("n")
    each = numbered.select("node", "n", band.alias("band"), *words, F.posexplode(prefix).alias("at", "term"), first(2 * threshold / (1 + threshold)).alias("asked")).where((F.col("term.dfs") > 1) & (F.pmod(F.col("term.ids"), F.lit(passes)) == turn))
    parts = F.ceil(F.col("term.dfs") / SALT_ROWS).cast("int")
    posted = each.select(F.col("term.ids").alias("id"), "band", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("at").alias("rb"), *[F.col(w).alias(f"b{w}") for w in words])
    asking = each.where("at < asked").select(
        F.col("term.ids").alias("id"), F.explode(F.array("band", F.col("band") + 1)).alias("band"), parts.alias("parts"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("ra"), *[F.col(w).alias(f"a{w}") for w in words]
    ).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    needed = F.ceil((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - EPSILON)
    ordered = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))
    reach = 1 + F.least(F.col("na") - F.col("ra") - 1, F.col("nb") - F.col("rb") - 1) >= needed
    close = _differing("ax", "bx", SKETCH_WORDS) <= F.col("na") + F.col("nb") - 2 * needed
    met = asking.hint("merge").join(posted, ["id", "band", "part"]).where(ordered & (F.col("na") >= threshold * F.col("nb") - EPSILON) & reach & close)
    return met.select("a", "b").distinct()


def _length_groups(lengths: list[tuple[int, int]], most_sets: int, most_tokens: int) -> tuple[list[tuple[int, int, int]], list[list[int]]]:
    """From (n, sets of n tokens): (n, its first group, its groups), and [least n, largest n, tokens] of each group, in order of length.

    A group is bounded in sets and in tokens; a length with more sets has several groups.
    """
    numbers, groups, held = [], [], most_sets + 1
    for n, count in sorted(lengths):
        parts = max(-(-count // most_sets), -(-n * count // most_tokens))
        if parts > 1:
            numbers.append((n, len(groups), parts))
            groups += [[n, n, -(-count // parts) * n] for _ in range(parts)]
            held = most_sets + 1
            continue
        if held + count > most_sets or groups[-1][2] + n * count > most_tokens:
            groups.append([n, n, 0])
            held = 0
        groups[-1][1:] = n, groups[-1][2] + n * count
        held += count
        numbers.append((n, len(groups) - 1, 1))
    return numbers, groups


class _Sets:
    """Sets of a group by length: nodes, hashes of tokens one set after another."""

    def __init__(self, rows: pa.Table):
        ids = rows["ids"].combine_chunks()
        lengths = np.diff(ids.offsets.to_numpy())
        by = np.argsort(lengths, kind="stable")
        self.nodes, self.lengths, self.ids = rows["node"].to_numpy()[by], lengths[by].astype(np.int64), ids.take(pa.array(by)).flatten().to_numpy()
        self.ends = np.cumsum(self.lengths)

    def sketches(self, words: int) -> np.ndarray:
        """(word, set): parities of the tokens by a hash."""
        out = np.zeros((words, len(self.nodes)), np.uint64)
        hashed = self.ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)
        bit, word = np.uint64(1) << hashed % np.uint64(64), (hashed // np.uint64(64) % np.uint64(words)).astype(np.int64)
        np.bitwise_xor.at(out, (word, np.repeat(np.arange(len(self.nodes)), self.lengths)), bit)
        return out

    def of(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i] - self.lengths[i] : self.ends[i]]

    def shared(self, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of a set's sorted tokens each set of `at` holds; few tokens at a time."""
        out, ends = [], np.cumsum(self.lengths[at])
        for cut in np.split(at, np.flatnonzero(np.diff(ends // MET_TOKENS)) + 1):
            ids, sizes = np.concatenate([self.of(j) for j in cut]), self.lengths[cut]
            place = np.minimum(np.searchsorted(own, ids), len(own) - 1)
            out.append(np.add.reduceat(own[place] == ids, np.cumsum(sizes) - sizes, dtype=np.int64))
        return np.concatenate(out)


def _sets_pairs(a: _Sets, b: _Sets, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes and similarities of the similar pairs of two groups, b's sets no shorter than a's, or of one group given twice.

    Differing bits of two sketches are a lower bound of the sets' difference. A sketch has some bits more than a set has tokens.
    """
    same, words = a is b, max(1, -(-5 * (len(a.ids) + len(b.ids)) // (4 * 64 * (len(a.nodes) + len(b.nodes)))))
    first = a.sketches(words)
    second = first if same else b.sketches(words)
    differ, count, part, total = (np.empty(len(b.nodes), kind) for kind in (np.uint64, np.uint8, np.uint8, np.uint32))
    last, limit, high = None, None, 0
    for i, n in enumerate(a.lengths.tolist()):
        if n != last:
            last, high = n, int(np.searchsorted(b.lengths, math.floor(n / threshold + EPSILON), "right"))
            both = n + b.lengths[:high]
            limit = both - 2 * np.ceil(both * (threshold / (1 + threshold)) - EPSILON).astype(np.int64)
        low = i + 1 if same else 0
        if low >= high:
            continue
        own = slice(low, high)
        for k in range(words):
            fresh = k % 3 == 0  # a byte counts three words
            np.bitwise_xor(second[k, own], first[k, i], out=differ[own])
            np.bitwise_count(differ[own], out=(part if fresh else count)[own])
            if not fresh:
                np.add(part[own], count[own], out=part[own])
            if k % 3 == 2 or k == words - 1:
                if k < 3:
                    total[own] = part[own]
                else:
                    total[own] += part[own]
        at = low + np.flatnonzero(total[own] <= limit[own])
        if len(at):
            shared = b.shared(np.sort(a.of(i)), at)
            similarity = shared / (n + b.lengths[at] - shared)
            fits = similarity >= threshold
            if fits.any():
                yield np.full(int(fits.sum()), a.nodes[i]), b.nodes[at[fits]], similarity[fits]


def _set_cells(threshold: float, cells: list[tuple[int, int]]):
    """Rows of cells (cell, own, node, ids) -> (a, b, similarity); a partition has the whole rows of its cells. cells: the two groups of each."""
    names = ["a", "b", "similarity"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [x for x in batches if x.num_rows]
        if not kept:
            return
        rows = pa.Table.from_batches(kept)
        kept.clear()
        for cell in pc.unique(rows["cell"]).to_pylist():
            whole = pc.equal(rows["cell"], cell)
            sides = {own: _Sets(rows.filter(pc.and_(whole, pc.equal(rows["own"], own)))) for own in pc.unique(rows["own"].filter(whole)).to_pylist()}
            i, j = cells[cell]
            if i not in sides or j not in sides:
                continue
            found, waiting = [], 0
            for x, y, similarity in _sets_pairs(sides[i], sides[j], threshold):
                found.append((np.minimum(x, y), np.maximum(x, y), similarity))
                waiting += len(x)
                if waiting >= PAIR_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)
                    found, waiting = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)

    return each


def block_set_pairs(numbered: DataFrame, threshold: float, tables: Tables, most_sets: int | None = None) -> DataFrame:
    """(a, b, similarity) of similar `numbered` sets, every pair of fitting lengths compared once.

    Sets are grouped by length, and a task compares the sets of two groups whose lengths allow the threshold: it holds two
    groups however many sets there are, and no set travels with a pair. A set travels once for each group that it meets, in
    passes that ship no more than all sets have tokens; pairs compared grow with the square of the sets.
    """
    spark = numbered.sparkSession
    lengths = [(r["n"], r["count"]) for r in numbered.groupBy("n").count().collect()]  # a row a length
    sets, tokens, deal = sum(c for _, c in lengths), sum(n * c for n, c in lengths), 4 * math.sqrt(spark.sparkContext.defaultParallelism)
    most_sets = most_sets or min(GROUP_SETS, max(LEAST_SETS, math.ceil(sets / deal)))
    numbers, groups = _length_groups(lengths, most_sets, min(GROUP_TOKENS, max(LEAST_TOKENS, math.ceil(tokens / deal))))
    passes, shipped = [], math.inf
    for j, (least, _, held) in enumerate(groups):
        for i, (_, largest, other) in enumerate(groups[: j + 1]):
            if largest < threshold * least - EPSILON:
                continue
            moved = held + other * (i != j)
            if shipped + moved > max(PASS_TOKENS_SHIPPED, tokens):
                passes.append([])
                shipped = 0
            passes[-1].append((i, j))
            shipped += moved
    named = F.broadcast(spark.createDataFrame(numbers, "n int, first int, parts int"))
    placed = numbered.select("node", "n", "ids").join(named, "n").select("node", "ids", (F.col("first") + F.pmod(F.xxhash64("node"), "parts")).cast("int").alias("own"))
    for turn, cells in enumerate(passes):
        meant = [(group, [k for k, cell in enumerate(cells) if group in cell]) for group in sorted({g for cell in cells for g in cell})]
        dealt = placed.join(F.broadcast(spark.createDataFrame(meant, "own int, cells array<int>")), "own").select(F.explode("cells").alias("cell"), "own", "node", "ids")
        tables.write(dealt.repartitionById(len(cells), "cell").mapInArrow(_set_cells(threshold, cells), "a long, b long, similarity double"), f"similar{turn}", batch_rows=SET_ROWS)
    return tables.read([f"similar{turn}" for turn in range(len(passes))], "a long, b long, similarity double")


def _meetings(numbered: DataFrame, threshold: float) -> tuple[float, float]:
    """Meetings of equal tokens that `set_candidates` would look at, at most, and pairs of fitting lengths."""
    asked = (F.col("n") - F.ceil(F.col("n") * (2 * threshold / (1 + threshold)) - EPSILON) + 1).cast("int")
    met = numbered.agg(F.sum(F.aggregate(F.slice("dfs", F.lit(1), asked), F.lit(0.0), lambda x, t: x + t - 1))).first()[0] or 0.0
    found = sorted((r["n"], r["count"]) for r in numbered.groupBy("n").count().collect())
    n, sets = np.array([n for n, _ in found]), np.cumsum([0] + [c for _, c in found], dtype=float)
    partners = sets[np.searchsorted(n, np.floor(n / threshold + EPSILON), "right")] - (sets[1:] + sets[:-1]) / 2  # among equals half of them
    return met, float((np.diff(sets) * partners).sum())


def jaccard_pairs(sets: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, similarity) with a < b of `sets` (node: long, tokens: distinct); exact, but that 64-bit hashes tell tokens apart. Empty sets have no pair.

    Sets meet by their rare tokens, or, where tokens are so frequent that this costs more, all pairs of fitting lengths are compared.
    """
    tables = Tables(sets.sparkSession, "jaccard")
    known = tables.write(sets.select(F.col("node").cast("long").alias("node"), "tokens"), "sets")
    numbered = tables.write(numbered_sets(known, tables), "numbered", batch_rows=SET_ROWS)
    tables.drop("sets")
    met, fitting = _meetings(numbered, threshold)
    if met == 0:
        return tables.spark.createDataFrame([], "a long, b long, similarity double")
    if met * SET_PAIRS > fitting:
        similar = block_set_pairs(numbered, threshold, tables)
        tables.drop("numbered")
        return similar
    # A pass's shuffle files go with its write: of postings, and of sets that travel once a pair, no more than a pass's lie on disk.
    tokens = numbered.agg(F.sum("n")).first()[0] or 0
    passes = max(PASSES, -(-tokens // PASS_TOKENS_SHIPPED)) if tokens > PASS_TOKENS else 1
    for turn in range(passes):
        tables.write(set_candidates(numbered, threshold, passes, turn), f"met{turn}")
    met = tables.write(tables.read([f"met{turn}" for turn in range(passes)], "a long, b long").distinct(), "met")
    tables.drop(*[f"met{turn}" for turn in range(passes)])
    first, second = (numbered.select(F.col("node").alias(x), F.col("ids").alias(f"t{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    similarity = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    for turn in range(passes):
        some = met.where(F.pmod(F.xxhash64("b"), F.lit(passes)) == turn).repartition(_parts(sets), "a")
        part = second.where(F.pmod(F.xxhash64("b"), F.lit(passes)) == turn)
        scored = some.join(first, "a").join(part, "b").withColumn("shared", F.size(F.array_intersect("ta", "tb")))
        tables.write(scored.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), similarity.alias("similarity")).where(F.col("similarity") >= threshold), f"similar{turn}")
    tables.drop("numbered", "met")
    return tables.read([f"similar{turn}" for turn in range(passes)], "a long, b long, similarity double")


# --- titles -------------------------------------------------------------------------------------

#: Characters are told apart in so many classes by a title's bag, whose bits say that a class has so many or more.
CLASSES, COUNTS = 32, (1, 2, 3, 4, 6, 8, 11, 15)
BAG_WORDS = CLASSES * len(COUNTS) // 64
#: Longest chunk, and buckets of the table of chunk frequencies, which the driver holds.
CHUNK, FREQUENCIES = 4, 1 << 16
#: Pairs compared by bags in a block's time of one meeting of equal chunks in a join.
MEETING_PAIRS = 50
#: Titles of a group, whose pairs with another group's are one task, at most and at least; titles met at a time.
GROUP_TITLES, LEAST_TITLES, PIECE = 131_072, 1_000, 32_768
#: Bits of a title's sketch of neighbouring characters, and folded for all pairs, where a byte counts them; characters compared at a time.
WIDE_BITS, SKETCH_BITS, CELLS = 1024, 256, 1 << 19
#: Characters after which pairs that are too far apart by then are left.
STEPS = 16


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows in one integer."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 x twice the common subsequence over both lengths; equal strings: 100."""
    return 100.0 if a == b else 200.0 * _common(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@lru_cache(maxsize=65_536)
def _plan(n: int, threshold: int) -> tuple[int, int]:
    """(chunks, their size) of a title of n characters: one more chunk than edits to a partner that is not longer."""
    edits = math.floor(2 * n * (100 - threshold) / 100 + EPSILON)
    return edits + 1, min(CHUNK, n // (edits + 1))


@lru_cache(maxsize=65_536)
def _sizes(n: int, threshold: int) -> list[int]:
    """Chunk sizes of all titles that a title of n characters may be similar to and that are not shorter."""
    longest = math.floor(n * (200 - threshold) / threshold + EPSILON)
    return sorted({_plan(m, threshold)[1] for m in range(n, longest + 1)} - {0})


def _by_length(titles: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, code points a row) of the titles of each length."""
    lengths = np.array([len(t) for t in titles], np.int64)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield n, at, np.frombuffer("".join(titles[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n).astype(np.uint64)


def _bucket(codes: np.ndarray, size: int) -> np.ndarray:
    """The frequency bucket of each run of `size` characters."""
    h = np.full((codes.shape[0], codes.shape[1] - size + 1), size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[:, k : codes.shape[1] - size + 1 + k]
        h ^= h >> np.uint64(29)
    return (h % np.uint64(FREQUENCIES)).astype(np.int64)


def _frequencies(threshold: int):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(FREQUENCIES, np.int64)
        for rows in batches:
            for n, _, codes in _by_length(rows["title"].tolist()):
                for size in _sizes(n, threshold):
                    if size <= n:
                        seen += np.bincount(_bucket(codes, size).ravel(), minlength=FREQUENCIES)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": at, "times": seen[at]})

    return each


def _bags(codes: np.ndarray) -> list[np.ndarray]:
    counts = np.stack([(codes % np.uint64(CLASSES) == np.uint64(c)).sum(1) for c in range(CLASSES)], 1)
    bits = (counts[:, :, None] >= np.array(COUNTS)).reshape(len(codes), -1)
    return list(np.packbits(bits, axis=1).view(">i8").astype(np.int64).T)


def _rarest(costs: np.ndarray, chunks: int, size: int) -> np.ndarray:
    """Starts of `chunks` disjoint chunks of each title, in order, with the least sum of costs (a row a title, a column a start)."""
    spare = costs.shape[1] - 1 - (chunks - 1) * size  # chunk j starts at j * size + o, with o never falling
    best, taken = np.zeros((len(costs), spare + 1), np.int64), []
    for j in range(chunks):
        low = np.minimum.accumulate(best, 1)
        new = best < np.concatenate([np.full((len(best), 1), np.iinfo(np.int64).max), low[:, :-1]], 1)
        taken.append(np.maximum.accumulate(np.where(new, np.arange(spare + 1), 0), 1))  # the best o' <= o of the chunk before
        best = low + costs[:, j * size : j * size + spare + 1]
    o, out = best.argmin(1), []
    for j in reversed(range(chunks)):
        out.append(j * size + o)
        o = taken[j][np.arange(len(costs)), o]
    return np.stack(out[::-1], 1)


def _chunked(frequency, threshold: int):
    """(node, title) -> with n, chunk size, starts of the chunks, sizes of partners' chunks, equal chunks, bag words."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for n, at, codes in _by_length(rows["title"].tolist()):
                chunks, size = _plan(n, threshold)
                if not size:
                    continue
                costs = frequency.value[_bucket(codes, size)]
                starts = _rarest(costs, chunks, size)
                meets = np.take_along_axis(costs, starts, 1).sum(1)
                own = rows.iloc[at].assign(n=n, size=size, meets=meets, starts=list(starts.astype(np.int32)), sizes=[np.array(_sizes(n, threshold), np.int32)] * len(at))
                found.append(own.assign(**{f"x{k}": w for k, w in enumerate(_bags(codes))}))
            if found:
                yield pd.concat(found)

    return each


def _allowed(n: int, lengths: np.ndarray, threshold: int) -> np.ndarray:
    """Insertions and deletions between a title of n characters and similar ones of `lengths`, at most."""
    return np.floor((n + lengths) * ((100 - threshold) / 100) + EPSILON).astype(np.int64)


def _sketches(codes: np.ndarray) -> np.ndarray:
    """WIDE_BITS / 64 words a title: parities of its pairs of neighbouring characters, by a hash; a pair's second occurrence counts as another pair.

    An insertion or a deletion puts one pair in the place of two or two in the place of one, so d of them differ in at most 3 d bits.
    """
    grams = np.sort(codes[:, :-1] << np.uint64(32) | codes[:, 1:], axis=1)
    place = np.broadcast_to(np.arange(grams.shape[1]), grams.shape)
    starts = np.ones(grams.shape, bool)
    starts[:, 1:] = grams[:, 1:] != grams[:, :-1]
    turn = place - np.maximum.accumulate(np.where(starts, place, 0), 1)
    h = (grams ^ turn.astype(np.uint64) << np.uint64(56)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
    out = np.zeros((len(codes), WIDE_BITS // 64), np.uint64)
    word, bit = (h // np.uint64(64) % np.uint64(WIDE_BITS // 64)).astype(np.int64), np.uint64(1) << h % np.uint64(64)
    np.bitwise_xor.at(out, (np.arange(len(codes))[:, None], word), bit)
    return out


class _Block:
    """Titles of a group by length: nodes, code points one title after another, bags, sketches, and sketches folded to SKETCH_BITS."""

    def __init__(self, rows: pd.DataFrame):
        found = [(n, rows["node"].to_numpy(np.int64)[at], codes) for n, at, codes in _by_length(rows["title"].tolist())]
        self.nodes = np.concatenate([nodes for _, nodes, _ in found])
        self.lengths = np.repeat([n for n, _, _ in found], [len(nodes) for _, nodes, _ in found])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.points = np.concatenate([codes.astype(np.uint32).ravel() for _, _, codes in found])
        self.bags = np.concatenate([np.stack(_bags(codes), 1) for _, _, codes in found]).view(np.uint64)  # a negative number would count as its absolute value
        self.sketches = np.concatenate([_sketches(codes) for _, _, codes in found])
        self.folded = np.ascontiguousarray(np.bitwise_xor.reduce(self.sketches.reshape(len(self.nodes), -1, SKETCH_BITS // 64), axis=1).T)

    def padded(self, letters: np.ndarray, at: np.ndarray, width: int, other: int) -> np.ndarray:
        """`letters` (one for each code point) of titles, a row each, with `other` behind them."""
        place = np.arange(width)
        out = letters[np.minimum(self.starts[at][:, None] + place, len(letters) - 1)]
        out[place >= self.lengths[at][:, None]] = other
        return out


def _letters(a: _Block, b: _Block) -> tuple[np.ndarray, np.ndarray]:
    """The code points of both, numbered from 2, in a byte where that is enough."""
    used = np.union1d(a.points, b.points)
    kind = np.uint8 if len(used) <= 254 else np.uint32
    return tuple((np.searchsorted(used, x.points) + 2).astype(kind) for x in (a, b))


def _fits(rows: list[np.ndarray], window: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Where at least so many of a window's first bits are zero."""
    full, found = np.uint64(0xFFFFFFFFFFFFFFFF), np.zeros(len(window), np.int64)
    for w, row in enumerate(rows):
        bits = np.clip(window - 64 * w, 0, 64)
        mask = np.where(bits > 0, full >> (64 - np.maximum(bits, 1)).astype(np.uint64), np.uint64(0))
        found += np.bitwise_count(~row & mask)
    return found >= least


def _similar(a: _Block, b: _Block, letters: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, threshold: int) -> np.ndarray:
    """Places of the pairs of titles x of a and y of b that reach the ratio, by the common subsequence as in `_common`, a step for all at once.

    Of p characters all but the deleted ones stand, in order, among the first p + inserted of the partner: that is asked every STEPS
    characters, of few pairs that are not similar more than once or twice.
    """
    out, words = [np.empty(0, np.int64)], -(-b.lengths[y] // 64)
    for w in np.unique(words).tolist():
        own = np.flatnonzero(words == w)
        step = max(1, CELLS // (64 * w))
        for k in range(0, len(own), step):
            at = own[k : k + step]
            na, nb = a.lengths[x[at]], b.lengths[y[at]]
            edits = np.floor((na + nb) * ((100 - threshold) / 100) + EPSILON).astype(np.int64)
            first, second = a.padded(letters[0], x[at], int(na.max()), 0), b.padded(letters[1], y[at], 64 * w, 1)  # no letters, and not equal
            rows = [np.full(len(at), np.uint64(0xFFFFFFFFFFFFFFFF)) for _ in range(w)]
            for p in range(first.shape[1]):
                if p and p % STEPS == 0:
                    # A title that has ended is asked for what all of it holds.
                    fits = np.flatnonzero(_fits(rows, np.minimum(nb, p + (edits - na + nb) // 2), np.minimum(p, na) - (edits + na - nb) // 2))
                    if len(fits) < len(at):
                        at, na, nb, edits, first, second, rows = at[fits], na[fits], nb[fits], edits[fits], first[fits], second[fits], [row[fits] for row in rows]
                masks = np.packbits((second == first[:, p, None]).ravel(), bitorder="little").view("<u8").reshape(len(at), w)
                carry = np.zeros(len(at), np.uint64)
                for word, row in enumerate(rows):
                    hit = row & masks[:, word]
                    total = row + hit
                    over = total < hit
                    total += carry
                    carry = (over | (total < carry)).astype(np.uint64)
                    rows[word] = total | (row ^ hit)  # hit is a part of row: its difference is the exclusive or
            common = 64 * w - sum(np.bitwise_count(row).astype(np.int64) for row in rows)
            out.append(at[200.0 * common / (na + nb) >= threshold])
    return np.concatenate(out)


def _block_pairs(a: _Block, b: _Block, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes of pairs of two blocks, or of one block given twice, that reach the ratio."""
    same, letters = a is b, _letters(a, b)

    def similar(found: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.repeat([i for i, _ in found], [len(at) for _, at in found]), np.concatenate([at for _, at in found])
        edits = np.floor((a.lengths[x] + b.lengths[y]) * ((100 - threshold) / 100) + EPSILON)
        for p, q, times in ((a.sketches, b.sketches, 3), (a.bags, b.bags, 1)):
            near = np.bitwise_count(p[x] ^ q[y]).sum(1, dtype=np.int64) <= times * edits
            x, y, edits = x[near], y[near], edits[near]
        fits = _similar(a, b, letters, x, y, threshold)
        return a.nodes[x[fits]], b.nodes[y[fits]]

    for piece in range(0, len(b.nodes), PIECE):
        part = slice(piece, piece + PIECE)
        lengths, sketches = b.lengths[part], b.folded[:, part]
        differ, count = np.empty(len(lengths), np.uint64), np.empty(len(lengths), np.uint8)
        total = np.empty(len(lengths), np.uint8)  # of 256 bits: if all differ it reads 0, and the pair stays
        last, limit, low, high = None, None, 0, 0
        found, waiting = [], 0
        for i in range(len(a.nodes)):
            n = int(a.lengths[i])
            if n != last:
                last, allowed = n, _allowed(n, lengths, threshold)
                limit = np.minimum(3 * allowed, 255).astype(np.uint8)
                fits = np.flatnonzero(np.abs(lengths - n) <= allowed)  # one run: a longer title allows less than its length more
                low, high = (int(fits[0]), int(fits[-1]) + 1) if len(fits) else (0, 0)
            first = max(low, i + 1 - piece) if same else low
            if first >= high:
                continue
            own = slice(first, high)
            for k, words in enumerate(sketches):
                np.bitwise_xor(words[own], a.folded[k, i], out=differ[own])
                np.bitwise_count(differ[own], out=(count if k else total)[own])
                if k:
                    np.add(total[own], count[own], out=total[own])
            at = np.flatnonzero(total[own] <= limit[own])
            if len(at):
                found.append((i, piece + first + at))
                waiting += len(at)
            if waiting >= PIECE:
                yield similar(found)
                found, waiting = [], 0
        if found:
            yield similar(found)


def _cells(threshold: int, groups: int):
    """Rows of cells (cell, own, node, title) -> (a, b); a partition has the whole rows of its cells."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = list(batches)
        if not kept:
            return
        for cell, rows in pd.concat(kept).groupby("cell"):
            i, j = divmod(int(cell), groups)
            sides = {g: _Block(own) for g, own in rows.groupby("own")}
            if i in sides and j in sides:
                for x, y in _block_pairs(sides[i], sides[j], threshold):
                    yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return each


def block_candidates(titles: DataFrame, threshold: int, groups: int | None = None) -> DataFrame:
    """(a, b) pairs of `titles` (node: long, title: distinct, not empty) that reach the ratio, every pair compared once.

    Titles are dealt into groups, and a task compares the titles of two groups: by lengths, by sketches of neighbouring
    characters, by bags, and what is left by its common subsequence. Tasks hold two groups however many titles there are, and
    no title travels with a pair; pairs compared grow with the titles' square.
    """
    n, cores = titles.count(), titles.sparkSession.sparkContext.defaultParallelism
    groups = groups or max(-(-n // GROUP_TITLES), min(-(-n // LEAST_TITLES), math.ceil(math.sqrt(8 * cores))), 1)
    own = F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    dealt = titles.select("node", "title", own.alias("own")).withColumn("other", other)
    cell = (F.least("own", "other") * groups + F.greatest("own", "other")).alias("cell")
    # Cells are numbered without gaps, and a partition takes one: by hash some would take several, others none.
    low, high = F.least("own", "other"), F.greatest("own", "other")
    number = (high * (high + 1) / 2 + low).cast("int")
    placed = dealt.select(cell, "own", "node", "title", number.alias("number")).repartitionById(groups * (groups + 1) // 2, F.col("number")).drop("number")
    return placed.mapInPandas(_cells(threshold, groups), "a long, b long")


def title_candidates(titles: DataFrame, threshold: int, tables: Tables) -> DataFrame:
    """(a, b) pairs of `titles` (node: long, title: distinct) that may reach the ratio; each pair once."""
    met = _chunk_candidates(titles, threshold, tables)
    return block_candidates(_filled(titles), threshold) if met is None else met


def _filled(titles: DataFrame) -> DataFrame:
    return titles.select(F.col("node").cast("long").alias("node"), "title").where("title <> ''")


def _chunk_candidates(titles: DataFrame, threshold: int, tables: Tables) -> DataFrame | None:
    """(a, b) pairs of `titles` that share a chunk and may reach the ratio; None where all pairs cost less.

    With ratio r two lengths allow d = (1 - r)(la + lb) insertions and deletions. Each spoils at most one of d + 1
    disjoint chunks of the longer title, so some chunk i (from 0) stands in the shorter one, with at most i edits
    before it and d - i behind, which bounds its shift. Any disjoint chunks will do: those with the least sum of
    frequencies are taken. Pairs of equal chunks whose bags differ in more than d bits go at once. Where chunks are so
    frequent that meeting them costs more than comparing all pairs, all pairs are compared, in blocks.
    """
    if not 50 < threshold <= 100:
        raise ValueError("a threshold of over 50 and at most 100")
    spark = titles.sparkSession
    titles = _filled(titles)
    counted = titles.select("title").mapInPandas(_frequencies(threshold), "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("times"))
    table = np.zeros(FREQUENCIES, np.int64)
    for r in counted.collect():  # at most FREQUENCIES rows
        table[r["bucket"]] = r["times"]
    words = [f"x{k}" for k in range(BAG_WORDS)]
    schema = "node long, title string, n int, size int, starts array<int>, sizes array<int>, meets long, " + ", ".join(f"{w} long" for w in words)
    cut = tables.write(titles.mapInPandas(_chunked(spark.sparkContext.broadcast(table), threshold), schema), "chunks")
    meets, n = cut.agg(F.sum("meets"), F.count("*")).first()
    if (meets or 0) * MEETING_PAIRS > n * n / 2:
        return None
    at = F.posexplode("starts").alias("i", "p")
    indexed = cut.select(F.col("node").alias("s"), "title", "size", F.col("n").alias("ns"), *[F.col(w).alias(f"s{w}") for w in words], at)
    indexed = indexed.withColumn("gram", F.substring("title", F.col("p") + 1, F.col("size"))).drop("title", "size")
    asking = cut.select(F.col("node").alias("r"), "title", F.col("n").alias("nr"), *[F.col(w).alias(f"r{w}") for w in words], F.explode("sizes").alias("size")).where("size <= nr")
    asking = asking.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("nr") - F.col("size")))).withColumn("gram", F.substring("title", F.col("from") + 1, F.col("size"))).drop("title", "size")
    edits = F.floor((F.col("ns") + F.col("nr")) * ((100 - threshold) / 100) + EPSILON)
    shift, longer = F.col("p") - F.col("from"), F.col("ns") - F.col("nr")
    ordered = (longer > 0) | (longer == 0) & (F.col("r") < F.col("s"))
    near = (longer <= edits) & (F.abs(shift) <= F.col("i")) & (F.abs(shift - longer) <= edits - F.col("i"))
    # Exploded rows are many more than their table's size tells the optimizer: no side is broadcast.
    met = indexed.hint("merge").join(asking, "gram").where(ordered & near & (_differing("sx", "rx", BAG_WORDS) <= edits))
    return met.select(F.least("s", "r").alias("a"), F.greatest("s", "r").alias("b")).distinct()


def similar_titles(titles: DataFrame, threshold: int = 90) -> DataFrame:
    """(a, b) with a < b of `titles` (node: long, title: distinct) of indel ratio >= threshold; exact."""
    tables = Tables(titles.sparkSession, "titles")
    # Narrow rows, and many pairs: they are dealt over the cores however few bytes they have.
    titles = spread(tables.write(_filled(titles), "titles"))
    met = _chunk_candidates(titles, threshold, tables)
    if met is None:
        return block_candidates(titles, threshold)
    met = met.repartition(_parts(titles), "a")
    first, second = (titles.select(F.col("node").alias(x), F.col("title").alias(f"t{x}")) for x in "ab")
    named = met.join(first, "a").join(second, "b")
    # An indel distance is at least the edit distance, whose banded form runs in the JVM and leaves few pairs for Python.
    allowed = F.floor((F.length("ta") + F.length("tb")) * ((100 - threshold) / 100) + EPSILON).cast("int")
    close = named.withColumn("allowed", allowed).where("levenshtein(ta, tb, allowed) >= 0")
    return close.where(_ratio("ta", "tb") >= threshold).select("a", "b")
