import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift.llm import near_copies

SF = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(texts):
    """By brute force over texts that share a shingle; of equal sets too."""
    sets, seen, root = {i: grams(t) for i, t in texts.items()}, {}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = set()
    for i, s in sets.items():
        for g in s or {None}:
            pairs |= {(j, i) for j in seen.get(g, [])}
            seen.setdefault(g, []).append(i)
    for a, b in pairs:
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("block_rows", [3, 512])
def test_near_components(spark, block_rows):
    rng = np.random.default_rng(5)
    texts = [None, "", " \t", "a b c", "A  b c", "a b", "a b c d e"]
    for n in (30, 60, 400):
        base = [f"w{x}" for x in rng.integers(0, 5000, n)]
        for changes in [0, 1, 1, 2, 3, n // 30, n // 20]:
            own = list(base)
            for at in rng.integers(0, n, changes):
                own[at] = f"z{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
    rows = dict(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows.items()] + [(None, "a b c", 2)], "doc_id long, text string, fp int").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.near_components(docs, block_rows=block_rows).collect()}
    want = plain_components(rows)
    assert got == want and len(set(want.values())) < len(want) - 8
    left = near_copies.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in left.collect()) == sorted([-1, *{*want.values()}])
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_stage_leaves_no_pair_of_similarity_four_fifths(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["text"]).where(F.length("text") < 4000)
    out = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, SF).collect()}
    want = plain_components({r.doc_id: r.text for r in docs.collect()})
    assert set(out) == set(want.values()) and len(out) < len(want)


def test_simhashes_are_majorities():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**64, n, np.uint64) for n in (1, 2, 3, 50, near_copies._CACHE + 3, 7)]
    for own, found in zip(sets, near_copies.simhashes(sets), strict=True):
        assert int(found) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in own[:60].tolist()) > len(own)) or len(own) > 60
    big = sets[4]
    assert int(near_copies.simhashes([big])[0]) == sum(1 << b for b in range(64) if 2 * int((big >> np.uint64(b) & np.uint64(1)).sum()) > len(big))


def test_the_covering_code_alone_finds_close_texts(spark, monkeypatch):
    """Without any band the sets within three bits of SimHash still meet; exact similarity decides."""
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 5000, 3000)]
    texts = [" ".join(base)]
    for at in (5, 1500, 2990):
        own = list(base)
        own[at] = "other"
        texts.append(" ".join(own))
    texts.append(" ".join(f"v{x}" for x in rng.integers(0, 5000, 3000)))
    real = near_copies.band_keys
    monkeypatch.setattr(near_copies, "band_keys", lambda sets: np.array([[hash(s.tobytes()) & (2**62 - 1)] for s in sets], np.uint64))
    sets = near_copies.shingles(texts, 5)
    codes = near_copies.simhashes(sets)
    assert all(int(codes[0] ^ c).bit_count() <= near_copies.RADIUS for c in codes[1:4]) and int(codes[0] ^ codes[4]).bit_count() > 3
    from postsift.tables import Tables

    rows = [(near_copies.set_hash(s), int(c.view(np.int64)), [1]) for s, c in zip(sets, codes, strict=True)]
    links = near_copies._coded(spark.createDataFrame(rows, "fp long, code long, keys array<long>"), Tables(spark, "t")).collect()
    near = {near_copies.set_hash(s) for s in sets[:4]}
    assert {x for r in links for x in r} == near
    assert real(sets).shape == (5, near_copies.BANDS)
