"""Near copies by exact Jaccard similarity of word shingles, for the pipeline's near-dedup stage.

Candidates come from two sides. SimHash fingerprints of the shingle sets are linked by the covering code of `simhash`:
no pair within RADIUS bits is missed. A similarity of 0.8 differs in some ten of 64 bits, though, and a covering code of that
radius needs thousands of tables. Texts that share a band of MinHash values are therefore candidates too: of two texts of
similarity s a band of BAND_ROWS values is equal with odds s**BAND_ROWS, so at 0.8 all BANDS differ for about one
pair in 20,000.

Texts that are candidates of each other, directly or over others, form a group. In a group every pair is compared by its
whole shingle sets, except pairs that are connected already. A large group is dealt out by pairs of blocks, so a task holds
two blocks and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import near_links
from .support import Tables, Words, bound_batches, connected_components, drop_rows, in_chunks, mix64, runs, within

BAND_ROWS = 7
BANDS = 42
#: Bits by which SimHash fingerprints of candidates differ at most.
RADIUS = 3
#: Texts of a block, and bytes of their shingles.
BLOCK_ROWS = 512
BLOCK_BYTES = 16 << 20
#: Shingles hashed at once: 256 KB, so that the many passes stay in the cache.
_CACHE = 1 << 15
_SEEDS = mix64(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64), 11)
_FACTORS = mix64(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64), 12) | np.uint64(1)


def shingles(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of `width` lower-cased words; a shorter text is one run, one without words none."""
    words = Words([None if t is None else t.encode("utf-8", "replace").lower().decode() for t in texts])
    at = within(words, width)
    hashes = runs(words.hash, width)[at]
    first = np.searchsorted(at, words.first)
    out = []
    for i, n in enumerate(words.count.tolist()):
        if n >= width:
            out.append(np.unique(hashes[first[i] : first[i + 1]]))
        else:
            a = words.first[i]
            out.append(runs(words.hash[a : a + n], n) if n else np.zeros(0, np.uint64))
    return out


def set_hash(found: np.ndarray) -> int:
    """Of equal sets the same: 0 of an empty one."""
    return int(mix64(found, 5).sum(dtype=np.uint64).view(np.int64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(set, band): one key a band, from the least of each permuted hash; the sets are not empty."""
    keys = np.zeros((len(sets), BANDS), np.uint64)
    sizes = np.array([len(s) for s in sets])
    done = 0
    while done < len(sets):
        upto = max(done + 1, int(np.searchsorted(np.cumsum(sizes[done:]), _CACHE, "right")) + done)
        flat = np.concatenate(sets[done:upto])
        starts = np.concatenate([[0], np.cumsum(sizes[done:upto])[:-1]])
        for p, (seed, factor) in enumerate(zip(_SEEDS, _FACTORS, strict=True)):
            permuted = flat ^ seed
            permuted *= factor
            band = p // BAND_ROWS
            keys[done:upto, band] = mix64(keys[done:upto, band] ^ np.minimum.reduceat(permuted, starts), band + 1)
        done = upto
    return keys


def simhashes(sets: list[np.ndarray]) -> np.ndarray:
    """The SimHash of each set of hashes: a bit is 1 where over half of them have it; the sets are not empty."""
    out = np.zeros(len(sets), np.uint64)
    sizes = np.array([len(s) for s in sets])
    done = 0
    while done < len(sets):
        upto = max(done + 1, int(np.searchsorted(np.cumsum(sizes[done:]), _CACHE, "right")) + done)
        bits = np.unpackbits(np.concatenate(sets[done:upto]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(sizes[done:upto])[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[done:upto] = np.packbits(2 * ones > sizes[done:upto, None], axis=1, bitorder="little").view("<u8").ravel()
        done = upto
    return out


def _prints(width: int):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = rows["text"].tolist()
            for a, b in in_chunks(texts):
                sets = shingles(texts[a:b], width)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [[]] * len(sets)
                code = np.zeros(len(sets), np.int64)
                if full:
                    for i, k in zip(full, band_keys([sets[i] for i in full]).view(np.int64), strict=True):
                        keys[i] = k
                    code[full] = simhashes([sets[i] for i in full]).view(np.int64)
                yield pd.DataFrame({"doc_id": rows["doc_id"].iloc[a:b].to_numpy(), "fp": [set_hash(s) for s in sets], "code": code, "keys": keys})

    return each


def _sets(width: int):
    """Rows of (text, fp, root) -> (fp, root, grams) where the text is that of fp (rows that share an id may differ)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = rows["text"].tolist()
            for a, b in in_chunks(texts):
                out = [(fp, root, s.tobytes()) for s, fp, root in zip(shingles(texts[a:b], width), rows["fp"].iloc[a:b], rows["root"].iloc[a:b], strict=True) if set_hash(s) == fp]
                if out:
                    yield pd.DataFrame(out, columns=["fp", "root", "grams"])

    return each


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (positions) that connect all pairs of `sets` of at least `similarity`: a spanning forest."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    alive = np.ones(len(sets), bool)
    marked = np.zeros(len(values), bool)
    links = []
    for head in range(len(sets)):
        if not alive[head]:
            continue
        alive[head] = False
        frontier = [head]
        while frontier and alive.any():
            x = frontier.pop()
            own = at[starts[x] : starts[x] + sizes[x]]
            marked[own] = True
            common = np.add.reduceat(marked[at], starts, dtype=np.int64)
            marked[own] = False
            near = np.flatnonzero(alive & (common >= similarity * (sizes + sizes[x] - common) - 1e-9))
            alive[near] = False
            links += [(x, int(y)) for y in near]
            frontier += near.tolist()
    return links


def _linked(similarity: float):
    """Rows (root, i, j, fp, grams) in order of (root, i, j) -> (a, b): the links of each run."""

    def search(run: list) -> list[tuple[int, int]]:
        sets = [np.frombuffer(g, np.uint64) for _, g in run]
        return [(run[x][0], run[y][0]) for x, y in forest(sets, similarity)]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, run = None, []
        for rows in batches:
            links = []
            for *k, fp, grams in rows[["root", "i", "j", "fp", "grams"]].itertuples(index=False):
                if k != key:
                    links += search(run) if len(run) > 1 else []
                    key, run = k, []
                run.append((fp, grams))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])
        links = search(run) if len(run) > 1 else []
        if links:
            yield pd.DataFrame(links, columns=["a", "b"])

    return each


def _coded(fps: DataFrame, tables: Tables) -> DataFrame:
    """(a, b): links that connect all sets (fp, code) whose SimHash differs in RADIUS bits at most, by the covering code."""
    codes = tables.write(fps.groupBy("code").agg(F.min("fp").alias("hub")), "codes")
    same = fps.join(codes, "code").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    found = near_links(codes.select(F.col("code").alias("fp")), Tables(fps.sparkSession, "code"), RADIUS)
    left, right = (codes.select(F.col("code").alias(x), F.col("hub").alias(f"hub_{x}")) for x in "ab")
    return same.union(found.join(left, "a").join(right, "b").select("hub_a", "hub_b"))


def near_components(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, component_id) of each row with an id: the smallest id reachable over texts of at least `similarity`.

    Similarity is the exact Jaccard of the sets of `shingle_words` lower-cased words. Texts without words link to
    each other only. Rows with a null id are left out. Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tables = Tables(spark, "near")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    prints = tables.write(rows.mapInPandas(_prints(shingle_words), f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long, code long, keys array<long>"), "prints")
    fps = tables.write(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("code").alias("code"), F.first("keys").alias("keys")), "fps")
    keyed = fps.select("fp", F.explode("keys").alias("k"))
    buckets = tables.write(keyed.groupBy("k").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
    more = keyed.join(buckets.where("n > 2").select("k", "a"), "k").select("a", F.col("fp").alias("b")).where("a <> b")
    banded = buckets.where("n = 2").select("a", "b").union(more)
    groups = tables.write(connected_components(banded.union(_coded(fps.where(F.size("keys") > 0), tables)).distinct(), tables), "groups")
    wanted = fps.join(groups, F.col("fp") == F.col("node")).select("fp", "first", "root")
    sets = tables.write(rows.join(wanted, F.col("doc_id") == F.col("first")).select("text", "fp", "root").mapInPandas(_sets(shingle_words), "fp long, root long, grams binary").dropDuplicates(["fp"]), "sets")
    blocks = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum(F.length("grams")) / BLOCK_BYTES)).cast("int")
    sized = sets.groupBy(F.col("root").alias("g_root")).agg(blocks.alias("g"))
    placed = sets.join(sized, F.col("root") == F.col("g_root")).withColumn("at", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("root", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "fp", "grams")
    links = tables.write(met.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInPandas(_linked(similarity), "a long, b long").distinct(), "links", batch_rows=64)
    roots = connected_components(links, tables)
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = tables.write(rooted.join(smallest, "root").select(F.col("fp").alias("n_fp"), "component_id"), "named")
    tables.drop("buckets", "codes", "groups", "sets", "links")
    return prints.join(named, F.col("fp") == F.col("n_fp")).select(F.col("doc_id").alias(id_col), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """`docs` with one document of each group of near copies: the one with the smallest id. All columns are kept.

    Rows with a null id stay. Of rows that repeat a kept id the first by their columns' digest stays.
    """
    found = near_components(docs, id_col=id_col, **options).where(F.col(id_col).isNotNull())
    decided = found.select(F.col(id_col).alias("id"), (F.col("component_id") == F.col(id_col)).alias("kept"))
    return drop_rows(docs, {"id": F.col(f"`{id_col}`")}, decided, Tables(docs.sparkSession, "copies"))
