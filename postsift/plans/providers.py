"""Model calls behind interfaces, with deterministic offline stubs. Parsing and defaults stay in columns."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import ENRICHED_FIELDS, clamp, has_fields, response_field, response_json, valid_sector

Complete = Callable[[str], str]
Embed = Callable[[list[str]], list[list[float]]]


def prompt(texts: Column, task: str) -> Column:
    """The task, then the extracts numbered from 1."""
    numbered = F.transform(texts, lambda t, i: F.concat(F.lit("---\nExtract "), (i + 1).cast("string"), F.lit(":\n"), t, F.lit("\n")))
    return F.concat(F.lit(f"{task}\nAnswer with one JSON object with the keys {', '.join(ENRICHED_FIELDS)}.\n"), F.array_join(numbered, ""), F.lit("---"))


def _tried(call: Callable[[], object], tries: int, pause: float):
    """What `call` returns; null after `tries` failures, with a pause between them that doubles."""
    for turn in range(tries):
        try:
            return call()
        except Exception:  # noqa: BLE001  any failure of a provider
            if turn + 1 < tries and pause:
                time.sleep(pause * 2**turn)
    return None


def complete(rows: DataFrame, prompt_col: str, provider: Complete, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """`rows` with `response`: the provider's answer, null after `tries` failures. One row a cluster."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(response=[_tried(lambda t=text: provider(t), tries, pause) for text in batch[prompt_col]])

    return rows.mapInPandas(each, rows.withColumn("response", F.lit(None).cast("string")).schema)


def embed(rows: DataFrame, text_col: str, provider: Embed, batch: int = 64, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """`rows` with `embedding`: the provider gets up to `batch` texts at a time; null for a batch that fails `tries` times.

    Each task calls for its own rows. Null texts are not sent and get no vector. A provider that returns another
    number of vectors than it got texts has failed.
    """

    def ask(texts: list[str]) -> list:
        found = list(provider(texts))
        if len(found) != len(texts):
            raise ValueError("a vector for each text")
        return found

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            vectors: list = [None] * len(some)
            known = [i for i, t in enumerate(some[text_col]) if t is not None]
            texts = some[text_col].tolist()
            for at in range(0, len(known), batch):
                part = known[at : at + batch]
                found = _tried(lambda p=part: ask([texts[i] for i in p]), tries, pause)
                for i, v in zip(part, found or [None] * len(part), strict=True):
                    vectors[i] = v
            yield some.assign(embedding=vectors)

    return rows.mapInPandas(each, rows.withColumn("embedding", F.lit(None).cast("array<double>")).schema)


def cost_guard(rows: DataFrame, cost: Column, limit: float = 0.50) -> DataFrame:
    """Rows of up to twice the limit; `cost_warning` from the limit on."""
    return rows.withColumn("_cost", cost).where(F.col("_cost") <= 2 * limit).withColumn("cost_warning", F.col("_cost") > limit).drop("_cost")


def extractive_stub(text: str) -> str:
    """Offline summary: the first extract stands for the cluster; pain rises with the number of extracts."""
    parts = [p.split(":\n", 1)[-1].strip() for p in text.split("---\n")[1:]]
    parts = [p.removesuffix("---").strip() for p in parts]
    first = next((p for p in parts if p), "")
    return json.dumps({
        "title": " ".join(first.split()[:6]), "problem": first[:200], "persona": "user", "jtbd": "", "context": f"{len(parts)} extracts", "monetizable": len(parts) > 1,
        "mvp": "", "alternatives": [], "willingness_to_pay_signal": "", "pain_score_llm": min(10, 3 + len(parts)),
    }, sort_keys=True)


def exploration_stub(text: str) -> str:
    """Offline exploration: sections about the insight that the prompt names."""
    title = next((line.removeprefix("Insight: ") for line in text.splitlines() if line.startswith("Insight: ")), "")
    who = next((line.split(": ", 1)[1] for line in text.splitlines() if line.startswith("Persona: ")), "users")
    return f"About {title}.\n## Monetization ideas\n- Subscription: {title}\n- One-time fee\n## Product variants\n- {title} for teams\n## Validation steps\n1. Interview ten {who}\n2. Landing page\n"


def summaries(answers: DataFrame) -> DataFrame:
    """(cluster_id, summary fields) of the responses that parse and have every field; pain within 1..10."""
    parsed = answers.withColumn("_j", response_json(F.col("response"))).where(has_fields(F.col("_j"), ENRICHED_FIELDS))
    kinds = {"monetizable": "boolean", "alternatives": "array<string>", "pain_score_llm": "int"}
    fields = [response_field(F.col("_j"), f, kinds.get(f, "string")).alias(f) for f in ENRICHED_FIELDS]
    return parsed.select("cluster_id", *[f if n != "pain_score_llm" else clamp(response_field(F.col("_j"), n, "int"), 1, 10).cast("int").alias(n) for n, f in zip(ENRICHED_FIELDS, fields, strict=True)])


def sectors(answers: DataFrame) -> DataFrame:
    """(cluster_id, sector)"""
    label = response_field(response_json(F.col("response")), "sector", "string")
    return answers.select("cluster_id", valid_sector(label, F.col("response")).alias("sector"))


def scores(answers: DataFrame, field: str, default: float | None) -> DataFrame:
    """(cluster_id, field): a model's score within 1..10; failures get the default."""
    value = clamp(response_field(response_json(F.col("response")), field, "double"), 1.0, 10.0)
    return answers.select("cluster_id", (F.coalesce(value, F.lit(default)) if default is not None else value).alias(field))
