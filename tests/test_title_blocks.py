"""Titles in blocks: sketches bound the distance, and a block decides its pairs itself."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest

from postsift.operators import pairs


def changed(rng, title, times):
    edits = list(title)
    for _ in range(times):
        k = rng.randrange(len(edits) + 1)
        edits[k : k + rng.randrange(2)] = rng.choice(["", "x", "a", "yz", "漢"])
    return "".join(edits)


@pytest.mark.parametrize("letters", ["abcdé ", "".join(map(chr, range(0x4E00, 0x4E00 + 600)))])  # in a byte, and in more
def test_blocks_decide_titles_of_any_length(letters):
    rng = random.Random(6)
    base = ["".join(rng.choices(letters, k=k)) for k in (1, 2, 15, 16, 17, 63, 64, 65, 80, 80, 127, 128, 129, 400)]
    titles = [t for t in dict.fromkeys(base + [changed(rng, t, rng.randrange(1, 2 + len(t) // 5)) for t in base for _ in range(6)]) if t]
    block = pairs._Block(pd.DataFrame({"node": np.arange(len(titles)), "title": titles}))
    for threshold in (60, 80, 90):
        found = [(min(p), max(p)) for x, y in pairs._block_pairs(block, block, threshold) for p in zip(x.tolist(), y.tolist(), strict=True)]
        assert sorted(found) == [(i, j) for i, j in itertools.combinations(range(len(titles)), 2) if pairs.indel_ratio(titles[i], titles[j]) >= threshold]


def test_similar_titles_in_blocks_travel_with_no_pair(spark, monkeypatch):
    """Equal starts and ends and another middle are no pair, which the block itself finds; no title is joined to a pair."""
    monkeypatch.setattr(pairs, "MEETING_PAIRS", 1 << 40)  # always in blocks
    rng = random.Random(7)
    start, end = ("".join(rng.choices("abcdefgh", k=60)) for _ in range(2))
    titles = [start + "".join(rng.choices("abcdefgh", k=60)) + end for _ in range(12)]
    titles += [changed(rng, t, 3) for t in titles]
    frame = spark.createDataFrame(list(enumerate(titles)), "node long, title string")
    want = {(i, j) for i, j in itertools.combinations(range(len(titles)), 2) if pairs.indel_ratio(titles[i], titles[j]) >= 90}
    assert {(r.a, r.b) for r in pairs.block_candidates(frame, 90, 2).collect()} == want
    found = pairs.similar_titles(frame, 90)
    assert {(r.a, r.b) for r in found.collect()} == want and "Join" not in found._jdf.queryExecution().toString()
