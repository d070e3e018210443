"""Quality rules: measures against a plain count, verdicts that no order changes, the order itself."""

import itertools
import random

from postsift.llm import quality

SPACES = " \t\n\x0b\x0c\r"


def plain(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in SPACES:
            words += [word] if word else []
            word = ""
        else:
            word += c
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if any(c not in SPACES for c in line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def texts():
    rng = random.Random(0)
    out = [None, "", " \n\t", "a a a a", "a b c", "x\x85y \xa0z", "漢 字 漢 字 漢 字 " * 20, "LOUD!! " * 60, "w# " * 60, "1 2 3 4 " * 30, "- item\n" * 60, "so ...\n" * 70, "one\none\none \nONE\n\n\n", "z" * 100_000]
    out += ["".join(rng.choice("abA# \n.1é") for _ in range(rng.randint(0, 400))) for _ in range(80)]
    return out + [" ".join(f"word{rng.randint(0, 400)}" for _ in range(rng.randint(40, 120))) for _ in range(40)] + ["Lorem Ipsum " + " ".join(f"w{i}" for i in range(60))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, True, 3) for i, t in enumerate(rows)], "doc_id long, text string, kept boolean, n_words int").repartition(3)


def test_measures_equal_plain_counts(spark):
    rows = texts()
    found = {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()}
    assert len(found) == len(rows)
    for i, t in enumerate(rows):
        r, want = found[i], plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, t)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        own = quality.Text(t)
        assert r.kept == (not r.base_failed and not any(rule.rejects(own) for rule in quality.RULES))
    assert any(r.kept for r in found.values())


def test_no_order_changes_a_verdict(spark, monkeypatch):
    docs = frame(spark, texts())
    want = sorted(map(tuple, quality.judge(docs).collect()))
    for turn in (1, 5):
        monkeypatch.setattr(quality, "learned_order", lambda d, rules, *_, turn=turn: [(i + turn) % len(rules) for i in reversed(range(len(rules)))])
        assert sorted(map(tuple, quality.judge(docs).collect())) == want
    kept = {r[0] for r in want if r[-1]}
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept


def test_order_takes_rejections_per_second_among_the_living():
    # Rule 0 rejects what rule 1 rejects and two more, at ten times the cost; rule 2 rejects others cheaply; 3 nothing.
    masks = {0b0011: 50, 0b0001: 2, 0b0100: 20, 0: 100}
    assert quality.order_by_rejection(masks, [10.0, 1.0, 0.5, 0.1]) == [1, 2, 3, 0]
    assert quality.order_by_rejection({}, [2.0, 1.0]) == [1, 0]
    # The first choice is the best one by trying all orders on two rules.
    cost = lambda order: sum(c for m, n in masks.items() for c in [sum([10.0, 1.0, 0.5][i] for k, i in enumerate(order) if not any(m >> j & 1 for j in order[:k])) * n])
    assert min(itertools.permutations(range(3)), key=cost) in ((1, 2, 0), (2, 1, 0))


def test_a_rule_after_a_rejection_is_not_run(spark):
    def never(_):
        raise AssertionError("ran after a rejection")

    rules = [quality.Rule("all", lambda t: True), quality.Rule("never", never)]
    run = quality._run([], rules, [])
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a", None]})
    assert [b.column("kept").to_pylist() for b in run([batch])] == [[False, False]]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(none).count() == 0 and quality.keep_good(none).count() == 0
