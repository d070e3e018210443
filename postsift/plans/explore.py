"""Deep exploration of insights: a prompt each, a heavy model's answer, its sections, and rows for the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import exploration_sections
from ..functions.text import estimate_tokens
from . import providers
from .scan import PRICES

#: Columns of the store by section.
_STORED = {"monetization_ideas": "monetization_hypotheses", "product_variants": "product_variants", "validation_steps": "validation_steps"}


def exploration_prompt(title: Column, problem: Column, persona: Column, context: Column, pain: Column, trend: Column) -> Column:
    """What is known of the insight, a line each, and the sections asked for; unknown fields have no line."""
    line = lambda label, value: F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(label), value.cast("string")))
    known = [line("Persona: ", persona), line("Context: ", context), line("Pain of ten: ", pain), line("Trend of ten: ", trend)]
    asked = F.lit("Answer in three sections, each a list: Monetization ideas, Product variants, Validation steps.")
    return F.concat_ws("\n", F.concat(F.lit("Insight: "), F.coalesce(title, F.lit(""))), F.concat(F.lit("Problem: "), F.coalesce(problem, F.lit(""))), *known, asked)


def explore(insights: DataFrame, provider: providers.Complete, model: str = "gpt-4o", tries: int = 3, pause: float = 1.0) -> DataFrame:
    """(insight_id, model_used, exploration_text, the three lists, cost_usd): one row an insight whose answer came.

    `insights` has id, title, problem, persona, context, pain_score_final and trend_score. A section without items
    is an empty list. The cost is that of the tokens of prompt and answer.
    """
    c = {n: F.col(n) for n in ("title", "problem", "persona", "context", "pain_score_final", "trend_score")}
    asked = insights.select("id", exploration_prompt(*c.values()).alias("prompt"))
    answers = providers.complete(asked, "prompt", provider, tries, pause).where("response is not null")
    found = exploration_sections(answers, "id", "response").groupBy("id").pivot("section", list(_STORED)).agg(F.first("items"))
    none = F.array().cast("array<string>")
    price = PRICES[model]
    cost = estimate_tokens(F.col("prompt")) / 1000 * price[0] + estimate_tokens(F.col("response")) / 1000 * price[1]
    rows = answers.join(found, "id", "left")
    return rows.select(F.col("id").alias("insight_id"), F.lit(model).alias("model_used"), F.col("response").alias("exploration_text"), *[F.coalesce(s, none).alias(c) for s, c in _STORED.items()], cost.alias("cost_usd"))
