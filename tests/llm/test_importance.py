"""Importance resampling against a plain loop, and ranks of repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from postsift.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, target, percent, n, buckets, min_words):
    def features(text):
        words = WORD.findall((text or "").translate(LOWER))
        grams = [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]

    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    rows = []
    for i, words, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long_enough = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    rank = [(r, k if k <= percent * len(long_enough) // 100 else None) for k, r in enumerate(long_enough, 1)]
    return Counter((r[0], r[2], r[3], r[4], k) for r, k in [*rank, *((r, None) for r in rows if r[1] < min_words)])


@pytest.mark.parametrize("n,buckets,percent,min_words", [(1, 97, 30, 3), (3, 50, 100, 1), (2, 10_000, 10, 0)])
def test_equals_a_plain_loop(spark, n, buckets, percent, min_words):
    rng = np.random.default_rng(n)
    docs = [(i, " ".join(rng.choice(["An", "b-c", "É", "漢字", "7x", "don't", "ZZ"], rng.integers(0, 30)))) for i in range(120)]
    docs += [(None, "a b c d e"), (None, None), (5, "É é É"), (5, "é"), (7, ""), (500, "\x00\x7f _ []"), (501, "long " * 30_000), *[(600, "same words here again")] * 40]
    target = ["An an b 7x", None, "", "漢字 " * 5]
    frame = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, rank int, bucket int, n_words string").repartition(5)
    wanted = spark.createDataFrame([(t, 3) for t in target], "text string, n int")
    found = importance.resample(frame, wanted, percent, n, buckets, min_words=min_words)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in found.dtypes} == {"bigint"}
    assert Counter(map(tuple, found.collect())) == plain(docs, target, percent, n, buckets, min_words)


def test_many_buckets_join_counts(spark, monkeypatch):
    docs = [(i, f"w{i % 7} w{i % 3} w1") for i in range(50)]
    frame, wanted = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("w1 w2",)], "text string")
    monkeypatch.setattr(importance, "BROADCAST_BUCKETS", 10)
    assert Counter(map(tuple, importance.resample(frame, wanted, 50, 2, 64, min_words=1).collect())) == plain(docs, ["w1 w2"], 50, 2, 64, 1)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    assert Counter(map(tuple, importance.resample(some, none, 50, min_words=0).collect())) == plain([(1, "a b"), (2, "a")], [], 50, 1, 10_000, 0)
    assert [r.doc_id for r in importance.drawn_documents(some, none, 50, min_words=0).collect()] in ([1], [2])
