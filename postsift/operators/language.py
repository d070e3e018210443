"""A language detector fitted on labelled rows: naive Bayes over hashed character trigrams.

Fitting counts trigrams by language in Spark; the model is a bounded table of integer log-probabilities. Scoring looks
each trigram's weight up and adds integers, which are the same anywhere. Both take the letters of a batch of texts as one
array of code points.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trigrams are told apart in so many buckets; a model has one weight a bucket and language.
BUCKETS = 8_192
#: Units of a weight: hundredths of a natural logarithm.
UNITS = 100
#: Shortest text, white space at its ends left out, whose language is told.
LEAST_CHARS = 10
#: Characters that are turned into trigrams at a time; a longer text is taken in parts.
BATCH_CHARS = 1 << 20


def letters(text: Column) -> Column:
    """Lower-cased words of letters, one space before, between and behind them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+", " ")), F.lit(" "))


def trigram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of each run of three characters of `letters`; a text without letters has none."""
    codes = F.transform(F.regexp_extract_all(letters(text), F.lit("(?s)."), F.lit(0)), F.ascii)

    def runs(c: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(c) - 3)
        return F.transform(at, lambda i: F.pmod((F.get(c, i) * 31 + F.get(c, i + 1)) * 31 + F.get(c, i + 2), F.lit(buckets)))

    # The codes are bound once: each of the three look-ups would compute them again.
    return F.get(F.transform(F.array(codes), lambda c: F.when(F.size(c) >= 3, runs(c)).otherwise(F.array().cast("array<int>"))), F.lit(0))


def _runs(texts: list[str | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's number, bucket) of all trigrams of texts that `letters` gave: some BATCH_CHARS characters at a time."""

    def of(parts: list[str], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.int32)
        owner = np.repeat(np.array(owners, np.int64), [len(x) for x in parts])
        ends = np.cumsum([len(x) for x in parts])
        whole = np.ones(len(codes), bool)  # a run that begins at a part's last two characters is none
        for back in (1, 2):
            whole[ends - back] = False
        at = np.flatnonzero(whole)
        # Three code points in base 31 are under 2^31, as in the column's integers.
        return owner[at], ((codes[at] * 31 + codes[at + 1]) * 31 + codes[at + 2]) % buckets

    parts, owners, size = [], [], 0
    for i, t in enumerate(texts):
        for start in range(0, len(t or "") - 2, BATCH_CHARS):
            part = t[start : start + BATCH_CHARS + 2]
            parts.append(part)
            owners.append(i)
            size += len(part)
            if size >= BATCH_CHARS:
                yield of(parts, owners)
                parts, owners, size = [], [], 0
    if parts:
        yield of(parts, owners)


def _counted(buckets: int):
    """(lang, letters) -> (lang, bucket, n): counts of parts of a batch."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            code, names = pd.factorize(rows["lang"])
            for own, bucket in _runs(rows["letters"].tolist(), buckets):
                if len(names) * buckets <= 1 << 22:
                    n = np.bincount(code[own] * buckets + bucket, minlength=len(names) * buckets)
                    cells = np.flatnonzero(n)
                    n = n[cells]
                else:
                    cells, n = np.unique(code[own] * buckets + bucket, return_counts=True)
                yield pd.DataFrame({"lang": np.asarray(names, object)[cells // buckets], "bucket": (cells % buckets).astype(np.int32), "n": n.astype(np.int64)})

    return each


@dataclass(frozen=True)
class LanguageModel:
    """Integer weights by language, one a bucket: rounded log-probabilities."""

    weights: dict[str, list[int]]

    def best(self, text: Column) -> Column:
        """The language of the highest sum of weights over the text's trigrams, the first by name among equals."""
        languages = sorted(self.weights)
        table = np.array([self.weights[name] for name in languages], np.int64)

        @F.pandas_udf("string")
        def named(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for found in batches:
                sums = np.zeros((len(languages), len(found)), np.int64)
                for own, bucket in _runs(found.tolist(), table.shape[1]):
                    first = np.flatnonzero(np.diff(own, prepend=-1))  # rows come in order, so a text's trigrams lie together
                    for total, weights in zip(sums, table, strict=True):
                        total[own[first]] += np.add.reduceat(weights[bucket], first)
                yield pd.Series(np.array(languages, object)[sums.argmax(0)], dtype=object)

        return named(letters(text))

    def detector(self) -> Callable[[Column], Column]:
        """text -> its likeliest language, the first by name among equals; null for a text of under ten characters or without letters."""

        def detect(text: Column) -> Column:
            told = (F.length(F.trim(text)) >= LEAST_CHARS) & text.rlike(r"\p{L}")
            return F.when(told, self.best(text))

        return detect


def fit_language_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> LanguageModel:
    """The model of `labelled`; rows without a language are left out. The driver gets one count a language and bucket.

    A bucket's weight is that of its share of the language's trigrams, smoothed by half a trigram a bucket.
    """
    rows = labelled.where(F.col(lang_col).isNotNull())
    each = rows.select(F.col(lang_col).cast("string").alias("lang"), letters(F.col(text_col)).alias("letters")).mapInPandas(_counted(buckets), "lang string, bucket int, n long")
    counts: dict[str, list[int]] = {}
    for r in each.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["lang"], [0] * buckets)[r["bucket"]] = r["n"]
    if not counts:
        raise ValueError("no labelled text has a letter")

    def weight(n: int, total: int) -> int:
        return math.floor(UNITS * math.log((n + 0.5) / (total + 0.5 * buckets)) + 0.5)

    return LanguageModel({lang: [weight(n, sum(own)) for n in own] for lang, own in counts.items()})


def sql(labelled: str, texts: str, buckets: int = BUCKETS) -> str:
    """The same tags in DuckDB SQL: (id, lang) of `texts` (id, text) by the model of `labelled` (text, lang)."""

    def grams(source: str, key: str) -> str:
        runs = f"list_transform(generate_series(1, len(c) - 2), lambda i: ((c[i] * 31 + c[i + 1]) * 31 + c[i + 2]) % {buckets})"
        clean = "' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}]+', ' ', 'g')) || ' '"
        return f"SELECT {key}, unnest({runs}) AS bucket FROM (SELECT {key}, list_transform(regexp_extract_all({clean}, '(?s).'), lambda x: unicode(x)) AS c FROM {source})"

    return f"""
WITH texts AS MATERIALIZED ({texts}), labelled AS ({labelled}),
n AS (SELECT lang, bucket, count(*) AS n FROM ({grams("labelled", "lang")}) WHERE lang IS NOT NULL GROUP BY 1, 2),
totals AS (SELECT lang, sum(n) AS total FROM n GROUP BY 1),
w AS (SELECT lang, bucket, floor({UNITS} * ln((coalesce(n, 0) + 0.5::DOUBLE) / (total + 0.5::DOUBLE * {buckets})) + 0.5::DOUBLE)::BIGINT AS weight
  FROM (SELECT lang, total, unnest(generate_series(0, {buckets} - 1)) AS bucket FROM totals) LEFT JOIN n USING (lang, bucket)),
g AS (SELECT id, bucket, count(*) AS times FROM ({grams("texts", "id")}) GROUP BY 1, 2),
s AS (SELECT id, lang, sum(times * weight) AS score FROM g JOIN w USING (bucket) GROUP BY 1, 2),
best AS (SELECT id, arg_min(lang, (-score, lang)) AS lang FROM s GROUP BY 1)
SELECT id, CASE WHEN length(trim(text)) >= {LEAST_CHARS} AND regexp_matches(text, '\\p{{L}}') THEN coalesce(lang, 'unknown') ELSE 'unknown' END AS lang FROM texts LEFT JOIN best USING (id)
"""
