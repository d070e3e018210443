"""Patterns run only where their words stand, with the counts that they have anywhere."""

import re

from pyspark.sql import functions as F

from postsift.functions import lexicon

TEXTS = ["I would pay $50, pricing is too expensive", "need a simple app, need now a tool", "wouldpay", "", "sos please help !", "ways to save money; it fails, fail", "price\nprices price", "prêt à payer 20 €", None]


def test_gated_counts(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for patterns in (lexicon.WTP_PATTERNS, lexicon.INTENT_PATTERNS, {"odd": [r"a|[bc]", r"(x|yz)*q", r"pay|\Spp", r"p(ay)?"]}):
        gated = lexicon._counts(F.lower("t"), patterns)
        plain = {k: [F.regexp_count(F.lower("t"), F.lit(lexicon._java(p))) for p in own] for k, own in patterns.items()}
        found = rows.select(F.array(*[c for own in gated.values() for c in own]).alias("g"), F.array(*[F.coalesce(c, F.lit(0)) for own in plain.values() for c in own]).alias("p")).collect()
        assert all(r["g"] == r["p"] for r in found)


def test_words_that_a_match_needs():
    parse = lambda p: [sorted(g) for g in lexicon._literals(re._parser.parse(p))]
    assert parse(r"\b(looking for|need)\b.*\b(tools?|app)\b") == [["looking for", "need"], ["app", "tool"]]
    assert parse(r"(help|[ab])+x*") == []


def test_patterns_run_once_and_gated(spark):
    plan = spark.range(1).select(F.concat(F.lit("pay "), F.col("id")).alias("t")).select(lexicon.rule_intent(F.col("t")).alias("i"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
