"""Words that sums of powers cannot tell apart must stay different words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift.llm import lm_scoring, packing, queries, substring_dedup, support

A = "".join("ab"[i.bit_count() % 2] for i in range(1024))
B = "".join("ba"[i.bit_count() % 2] for i in range(1024))


def test_hashes_of_words_and_prefixes():
    texts = ["", "a", "ab", "abcdefgh", "abcdefghi", "abcdefgh x", "x" * 64, "x" * 65, "x" * 1000, A, B, A[:512], "a" * 7 + "\0", "a" * 7, "é", "漢字"]
    words = support.Words(texts)
    for lane in range(2):
        by = {}
        for i, h in enumerate(words.hashes(lane).tolist()):
            assert by.setdefault(words.word(i), h) == h
        assert len(set(by.values())) == len(by)
    assert not np.any(words.hashes(0) == words.hashes(1))
    short = words.hashes(0, 4)
    assert [short[i] == short[j] for i, j in ((1, 2), (2, 3), (9, 10))] == [False, True, False]
    n = len(words.start)
    every = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    assert words.equal(*every).tolist() == [words.word(i) == words.word(j) for i, j in zip(*every, strict=True)]


@pytest.mark.parametrize("width", [1, 2, 3, 5, 18, 35, 64])
def test_runs_depend_on_their_words_and_order(width):
    rng = np.random.default_rng(width)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    found, by = support.runs(support.mix64(words), width), {}
    assert len(found) == 401 - width
    for i, h in enumerate(found.tolist()):
        assert by.setdefault(tuple(words[i : i + width]), h) == h
    assert len(set(by.values())) == len(by)


def test_packing(spark):
    docs = spark.createDataFrame([(0, f"{A} {B}"), (1, A), (2, B)], "doc_id long, text string")
    from tokenizers import Tokenizer

    own, crc = Tokenizer.from_file(queries.tokenizer_path()), __import__("zlib").crc32
    want = {i: crc(np.array(own.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in enumerate([f"{A} {B}", A, B])}
    assert {r.doc_id: r.ids_crc32 for r in packing.pack_documents(docs, queries.tokenizer_path()).collect()} == want
    assert want[1] != want[2]


def test_packing_compares_the_bytes_of_words(monkeypatch):
    monkeypatch.setattr(support.Words, "hashes", lambda self, lane=0, size=None: np.zeros(len(self.start), np.uint64))
    own = packing.WordTokenizer(queries.tokenizer_path())
    text = "all these words share one hash, all of them"
    want = own.tokenizer.encode(text, add_special_tokens=False).ids
    assert [x.tolist() for x in own.encode([text])] == [want]


def test_passages(spark):
    fill = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(0, f"{fill} {A}"), (1, f"{fill} {B}"), (2, f"{fill} x"), (3, f"{fill} x")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeated_passages(docs).collect()} == {0: 0, 1: 0, 2: 35, 3: 35}


def test_scores(spark):
    docs = spark.createDataFrame([(0, f"{A} q"), (1, f"{B} q")], "doc_id long, text string")
    got = lm_scoring.lm_scores(docs).collect()
    assert all(r.log_score == pytest.approx(np.log(0.25) + np.log(0.4) + np.log(0.5)) for r in got)  # one of four words; q is two of four, backed off once


def test_anchors_are_shared_by_equal_windows():
    rng = np.random.default_rng(0)
    for width in (1, 2, 3, 8, 35):
        texts = [" ".join(f"w{x}" for x in rng.integers(0, 2, 120)) for _ in range(3)]
        words = support.Words(texts)
        at, anchor, keys = substring_dedup._anchors(words, width)
        assert at.tolist() == support.within(words, width).tolist() and np.all(np.diff(anchor) >= 0) and anchor[-1] == len(keys) - 1
        windows = [tuple(words.word(i) for i in range(a, a + width)) for a in at]
        many, of = {w for w in windows if windows.count(w) > 1}, dict(zip(*np.unique(keys, return_counts=True), strict=True))
        by = {}
        for w, k in zip(windows, keys[anchor].tolist(), strict=True):
            assert by.setdefault(w, k) == k and (w not in many or of[k] > 1)


def test_lanes_are_columns_of_their_own(spark):
    """Column names of the operators' own do not clash with those of the table."""
    docs = spark.createDataFrame([(0, "a b c")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("batch", "words", "payload", "range", "bits")})
    assert substring_dedup.remove_repeated_passages(docs, 2).first().n_words == 3 and lm_scoring.lm_scores(docs).first().n_words == 3
