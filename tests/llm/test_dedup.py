import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from postsift.llm import exact_dedup, lm_scoring, mixing, simhash, substring_dedup, support
from postsift.tables import Tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """(doc_id, text) rows, with columns whose names the operators use inside."""
    schema = "doc_id long, text string, source string, kept boolean, row long, size long, fp long, n long, component_id long"
    return spark.createDataFrame([(i, t, ["a", "b", None][k % 3], True, 7, 8, 9, 10, 11) for k, (i, t) in enumerate(rows)], schema).repartition(3)


EDGE = [(5, None), (3, ""), (4, " \t\n"), (1, "one two"), (2, "one  two"), (2, "one two"), (None, "one two"), (9, "x" * 5000 + " y" * 3000), (8, "É accents Ω 漢字 😀 here")]


# --- support ------------------------------------------------------------------------------------


def test_words_are_those_of_the_pattern():
    texts = [t for _, t in EDGE] + ["\x0b a b \x1c c ", "z"]
    found = support.Words(texts)
    for i, t in enumerate(texts):
        assert [found.word(j).decode() for j in range(found.first[i], found.first[i + 1])] == WORD.findall(t or "")
    by = {}
    for j in range(len(found.start)):
        assert by.setdefault(found.word(j), found.hash[j]) == found.hash[j]
    assert len(set(by.values())) == len(by)
    assert support.Words([]).first.tolist() == [0] and len(support.Words([None, ""]).hash) == 0


def test_packed_counts():
    x = np.array([1, 254, 255, 3, 10**12])
    assert support.unpack_counts(support.pack_counts(x)).tolist() == x.tolist()


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in support.connected_components(spark.createDataFrame(edges, "a long, b long"), Tables(spark, "t")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert support.connected_components(spark.createDataFrame([], "a long, b long"), Tables(spark, "t")).count() == 0


# --- exact dedup --------------------------------------------------------------------------------


def test_exact(spark):
    docs = documents(spark, EDGE)
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == len(EDGE)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    sizes = Counter(norm(t) for _, t in EDGE)
    sha = {hashlib.sha256(k.encode()).hexdigest(): (k, n) for k, n in sizes.items()}
    for r in rows:
        assert r.group_size == sha[r.text_sha256][1]
    two = [r for r in rows if sha[r.text_sha256][0] == "one two"]
    assert {r.keep_id for r in two} == {1} and [r.doc_id for r in two if r.kept] == [1]
    assert Counter(r.text_sha256 for r in rows if r.kept) == dict.fromkeys(sha, 1)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns and left.count() == len(sizes)


def test_exact_keeps_one_of_repeated_rows(spark):
    docs = documents(spark, [(1, "a")] * 5 + [(2, "b")])
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(docs).where("kept").collect()) == [1, 2]
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(docs).collect()) == [1, 2]


def test_exact_without_broadcast_and_with_a_crowded_filter(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(exact_dedup, "BLOCK_BITS", 64)
    docs = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 300).cast("string").alias("text"))
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == 500 and all(r.keep_id == r.doc_id % 300 and r.group_size == (2 if r.keep_id < 200 else 1) for r in rows)


# --- SimHash ------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(monkeypatch):
    texts = [t for _, t in EDGE] + ["a b c d", "A B c D", "w " * 999]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "_SHINGLE_BLOCK", 7)
    assert simhash.fingerprint("w x " * 99) == plain_fingerprint("w x " * 99)


@pytest.mark.parametrize("limit", [1, 3, 4096])
def test_cover_finds_every_link(spark, limit):
    rng = np.random.default_rng(limit)
    base = rng.integers(0, 2**64, 25, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base.tolist() * 3 + base.tolist()[:2] * 30:
        for i in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(i)
        fps.add(x)
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    tables = Tables(spark, "t")
    links = simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long"), tables, bucket_limit=limit)
    u = np.array(fps, np.int64).view(np.uint64)
    for r in links.collect():
        assert (int(r.a) ^ int(r.b)).bit_count() <= 3 if (r.a < 0) == (r.b < 0) else ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[i + 1 :]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in support.connected_components(links, tables).collect()}
    assert all(got.get(x, x) == fps[find(i)] for i, x in enumerate(fps))


def test_simhash_components(spark):
    docs = documents(spark, EDGE + [(20, "é accents Ω 漢字 😀 here"), (21, "one two three four five six seven")])
    rows = simhash.simhash_components(docs).collect()
    assert len(rows) == len(EDGE) + 2
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {3}
    assert {r.component_id for r in rows if r.doc_id in (1, 2, None)} == {1}
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted([-1, 1, 3, 9, 8, 20, 21])


# --- substring dedup ----------------------------------------------------------------------------


def plain_removal(texts, width):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("crowded", [False, True])
def test_passages(spark, monkeypatch, crowded):
    if crowded:  # a sketch that lets nearly everything pass, and several shards
        monkeypatch.setattr(substring_dedup, "MIN_CELLS", 1 << 17)
        monkeypatch.setattr(substring_dedup, "_CHUNK_CHARS", 400)
        monkeypatch.setattr(substring_dedup, "_SKETCH_FLUSH", 50)
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 6, n))
    shared = text(9)
    texts = [None, "", "a", text(40), shared, f"{text(5)} {shared} {text(4)}", "r " * 30, "same words here now ok", "same words  here now ok"] + [f"{text(rng.integers(1, 60))}" for _ in range(30)]
    docs = documents(spark, list(enumerate(texts)))
    found = substring_dedup.remove_repeated_passages(docs, width=5, max_cells=1 << 17 if crowded else 1 << 28, shard_keys=40 if crowded else 10**6)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()}
    assert got == dict(enumerate(plain_removal(texts, 5)))
    assert substring_dedup.remove_repeated_passages(docs.limit(0), 5).count() == 0


def test_passages_of_repeated_and_null_ids(spark):
    docs = documents(spark, [(1, "a b c d"), (1, "a b c d"), (None, "a b c d e"), (2, "f g h i")])
    rows = sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.remove_repeated_passages(docs, 3).collect())
    assert rows == [(-1, 4), (1, 4), (1, 4), (2, 0)]


# --- mixing -------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(n)) for i, n in enumerate(rng.integers(0, 200, 400))]
    docs = spark.createDataFrame([(i, t, "abcdef"[i % 6] if i % 7 else None) for i, t in rows], "doc_id long, text string, source string").withColumn("size", F.lit(-1))
    out = mixing.mix_sources(docs).collect()
    assert len(out) == 400 and all(r.taken <= 3 * r["size"] for r in out)
    total = sum(r["size"] for r in out)
    sources = {r.doc_id: r.source for r in docs.collect()}
    by = {}
    for r in out:
        by.setdefault(sources[r.doc_id], []).append(r)
    assert sum(x[0].target for x in by.values()) == pytest.approx(total)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target + 5
        assert own[0].source_size == sum(r["size"] for r in own) and own[0].target <= 3 * own[0].source_size + 1e-6
    again = {(r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns and whole.where("text <> ''").count() == sum(r.copies for r in out if r["size"])


def test_mixing_edges(spark):
    rows = mixing.mix_sources(documents(spark, EDGE)).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert mixing.mix_sources(documents(spark, EDGE).limit(0)).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix_sources(documents(spark, [(1, None), (2, "")])).collect())


# --- language model -----------------------------------------------------------------------------


def plain_scores(texts, order=3, cut=2):
    words = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] for t in texts]
    counts = Counter(tuple(w[i : i + n]) for w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words))

    def score(ws, i):
        value = 0.0
        for n in range(min(order, i + 1), 1, -1):
            gram = tuple(ws[i - n + 1 : i + 1])
            if counts[gram] >= cut:
                return value + np.log(counts[gram] / counts[gram[:-1]])
            value += np.log(0.4)
        return value + np.log(counts[ws[i : i + 1][0],] / total)

    return [sum(score(w, i) for i in range(len(w))) for w in words]


@pytest.mark.parametrize("shard", [20, 10**6])
def test_lm_scores(spark, monkeypatch, shard):
    monkeypatch.setattr(lm_scoring, "BATCH_CHARS", 300)
    rng = np.random.default_rng(3)
    texts = [t for _, t in EDGE[:5]] + [" ".join(f"W{x}" for x in rng.integers(0, 9, rng.integers(1, 50))) for _ in range(40)]
    docs = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs, shard_keys=shard).collect()}
    for i, want in enumerate(plain_scores(texts)):
        assert got[i].log_score == pytest.approx(want, abs=1e-9)
        assert (got[i].mean_log_score is None) == (got[i].n_words == 0)
    assert lm_scoring.lm_scores(docs.limit(0)).count() == 0
