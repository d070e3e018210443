"""Quality rules as a short-circuit cascade.

Every rule looks at one text and rejects it or not; a text stays if no rule rejects it, so the order of the rules
changes the time and never the verdict. The order is learned: on a sample every rule is run and timed on every
text, and the next rule is always the one that rejects most of the texts still alive per second spent. A text then
goes through the rules in that order until one rejects it. Measures that rules share (words, lines, counts) are
computed when first asked for, once a text.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import spread
from .support import BATCH_ROWS, Tables

#: Texts of the sample that orders the rules, about.
SAMPLE_ROWS = 2_000
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


class Text:
    """One text and its measures. Words are runs of anything but ASCII white space; a null text is empty."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "replace").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [line for line in self.text.split("\n") if line.strip(_SPACES)]

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words within a window of three words that the text has twice or more."""
        if self.n_words < 4:
            return 0
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, self.n_words)
        pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]  # numbers of two words, then of three
        _, window, times = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
        again = times[window] > 1
        covered = np.zeros(self.n_words, bool)
        for shift in range(3):
            covered[shift : shift + len(again)] |= again
        return int(covered.sum())


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Text], bool]


#: Rejects what is too short or mostly repeats itself.
BASE = [
    Rule("short", lambda t: t.n_words < 50),
    Rule("repeats", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
]
#: Rules for web text of any language, each a plain count against a threshold.
RULES = [
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
    Rule("dup_lines", lambda t: t.n_dup_lines > 2 and 10 * t.n_dup_lines > 3 * len(t.lines)),
    Rule("shouting", lambda t: 2 * sum(w.isupper() for w in t.words) > t.n_words),
    Rule("letters", lambda t: 10 * sum(1 for w in t.words if w.translate(None, _NO_LETTERS)) < 6 * t.n_words),
    Rule("bullets", lambda t: 10 * sum(x.lstrip(_SPACES).startswith(("- ", "* ", "•")) for x in t.lines) > 9 * len(t.lines)),
    Rule("ellipses", lambda t: 10 * sum(x.rstrip(_SPACES).endswith(("...", "…")) for x in t.lines) > 3 * len(t.lines)),
    Rule("placeholder", lambda t: "lorem ipsum" in t.text.lower()),
]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _trial(rules: list[Rule], measures: list[str]):
    """Texts -> rows of (mask of the rules that reject it, seconds of each rule)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, spent = [], []
            for text in batch.column("text").to_pylist():
                mask, seconds = 0, []
                for i, rule in enumerate(rules):
                    own = Text(text)
                    for name in measures:  # known before any rule is run
                        getattr(own, name)
                    began = time.perf_counter()
                    mask |= bool(rule.rejects(own)) << i
                    seconds.append(time.perf_counter() - began)
                masks.append(mask)
                spent.append(seconds)
            yield pa.RecordBatch.from_arrays([pa.array(masks, pa.int64()), pa.array(spent, pa.list_(pa.float64()))], ["mask", "seconds"])

    return each


def order_by_rejection(masks: dict[int, int], seconds: list[float]) -> list[int]:
    """Rules in order: next is the one with most rejections, among texts that none before rejects, per second.

    `masks` counts the sample's texts by the set of rules that reject them, one bit each. Rules that reject nothing
    any more follow from cheap to costly.
    """
    left, order = list(range(len(seconds))), []
    while left:
        value = {i: (sum(n for mask, n in masks.items() if mask >> i & 1) + 0.5) / max(seconds[i], 1e-9) for i in left}
        best = max(left, key=lambda i: (value[i], -i))
        order.append(best)
        left.remove(best)
        masks = {mask: n for mask, n in masks.items() if not mask >> best & 1}
    return order


def learned_order(docs: DataFrame, rules: list[Rule], measures: list[str], sample_rows: int = SAMPLE_ROWS) -> list[int]:
    """The cascade's order by costs and rejections on about `sample_rows` rows of `docs` (text), drawn from all partitions.

    Drawing reads the text column once more; decoding it costs a hundredth of the rules.
    """
    rows = docs.count()
    if not rows or len(rules) < 2:
        return list(range(len(rules)))
    tried = docs.sample(min(1.0, sample_rows / rows), 1).mapInArrow(_trial(rules, measures), "mask long, seconds array<double>")
    # At most one row for each set of rules that a text of the sample fails.
    found = tried.groupBy("mask").agg(F.count("*").alias("n"), *[F.sum(F.col("seconds")[i]).alias(f"s{i}") for i in range(len(rules))]).collect()
    return order_by_rejection({r["mask"]: r["n"] for r in found}, [sum(r[f"s{i}"] for r in found) for i in range(len(rules))])


def _run(base: list[Rule], rules: list[Rule], measures: list[str]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, failed, kept = [[] for _ in measures], [], []
            for text in batch.column("text").to_pylist():
                own = Text(text)
                for values, name in zip(known, measures, strict=True):
                    values.append(getattr(own, name))
                out = any(rule.rejects(own) for rule in base)
                failed.append(out)
                kept.append(not out and not any(rule.rejects(own) for rule in rules))
            columns = [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in known], pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *measures, "base_failed", "kept"])

    return each


def judge(
    docs: DataFrame, rules: list[Rule] = RULES, base: list[Rule] = BASE, measures: list[str] = MEASURES, sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: id, the measures, base_failed (a rule of `base` rejects it), kept (no rule does).

    Measures are those of the whole text, for rejected texts too; with none asked for, the rules of `base` are
    ordered among the others and base_failed is false. Null texts count as empty. Rows are judged one by one, so a
    repeated or null id and equal texts make no difference; an empty table gives an empty result. Other columns are
    not read.
    """
    tables = Tables(docs.sparkSession, "quality")
    texts = spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    if not measures:
        base, rules = [], [*base, *rules]
    rules = [rules[i] for i in learned_order(texts, rules, measures, sample_rows)]
    schema = "doc_id long, " + "".join(f"{m} long, " for m in measures) + "base_failed boolean, kept boolean"
    return tables.write(texts.mapInArrow(_run(base, rules, measures), schema), "judged", batch_rows=BATCH_ROWS).withColumnRenamed("doc_id", id_col)


def _filter(rules: list[Rule], text_col: str):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = map(Text, batch.column(text_col).to_pylist())
            yield batch.filter(pa.array([not any(rule.rejects(own) for rule in rules) for own in texts], pa.bool_()))

    return each


def keep_good(docs: DataFrame, rules: list[Rule] = RULES, base: list[Rule] = BASE, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that no rule rejects, all columns kept: the cascade alone, which stops at a text's first rejection."""
    rules = [*base, *rules]
    rules = [rules[i] for i in learned_order(docs.select(F.col(f"`{text_col}`").alias("text")), rules, [], sample_rows)]
    return docs.mapInArrow(_filter(rules, text_col), docs.schema)


SQL = r"""
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), p AS (SELECT row, words, unnest(generate_series(1, len(words) - 2)) AS i FROM t
), g AS (SELECT row, i, count(*) OVER (PARTITION BY row, words[i], words[i + 1], words[i + 2]) AS times FROM p
), r AS (SELECT row, count(DISTINCT pos) AS n_repeat_words FROM (SELECT row, unnest([i, i + 1, i + 2]) AS pos FROM g WHERE times > 1) GROUP BY 1
), m AS (
  SELECT doc_id, text, words, lines, len(words)::BIGINT AS n_words, len(lines) AS n_lines,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN r USING (row)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines
    OR 2 * len(list_filter(words, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) > n_words
    OR 10 * len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) < 6 * n_words
    OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*([-*] |•)'))) > 9 * n_lines
    OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '([.][.][.]|…)[\x20\x09-\x0D]*$'))) > 3 * n_lines
    OR contains(lower(text), 'lorem ipsum')) AS kept
FROM b
"""
