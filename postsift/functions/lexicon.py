"""Lexicon classifiers: intent, willingness to pay and pain. Lexicons are arguments; the defaults are fixed values."""

from __future__ import annotations

import re
from functools import reduce
from re import _parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import half_even

# Intents in the order that ties follow, with their patterns.
INTENT_PATTERNS = {
    "pain": [
        r"\b(struggling|frustrated|annoyed|angry|hate|difficult|impossible|broken|fails?|sucks?)\b",
        r"\b(problem|issue|bug|error|pain|headache|nightmare|disaster)\b",
        r"\b(doesn't work|not working|won't work|can't|unable to)\b",
        r"\b(tired of|sick of|fed up)\b",
        r"\b(why (is|does)|how come)\b",
        r"(help|sos|urgent)\s*(me|please|!)",
    ],
    "request": [
        r"\b(looking for|need|want|searching for|seeking|require)\b.*\b(tool|solution|app|software|platform|service)\b",
        r"\b(recommend|suggestion|advice).*\b(tool|app|software|platform)\b",
        r"\b(what do you (use|recommend)|which tool|best tool|any tools?)\b",
        r"\b(alternative to|replacement for|instead of)\b",
        r"\b(does anyone (use|know)|has anyone tried)\b",
        r"\b(tool|solution|app) (for|to help with)\b",
    ],
    "howto": [
        r"\b(how (do|to|can)|ways? to)\b",
        r"\b(tutorial|guide|walkthrough|instructions)\b",
        r"\b(tips?|tricks?|best practices)\b",
        r"\b(learn|teach me|show me)\b",
        r"\b(step by step)\b",
    ],
    "promo": [
        r"\b(i (built|made|created|launched|released)|check out (my|our)|announcing)\b",
        r"\b(new (tool|app|product|service|platform))\b",
        r"\b(feedback (on|for) (my|our)|try (my|our))\b",
        r"\b(just launched|now available|coming soon)\b",
        r"\b(sign up|get started|join (us|now)|limited offer)\b",
    ],
    "news": [
        r"\b(announced|announcement|releases?|update|version \d+)\b",
        r"\b(according to|reports?|study shows?|research)\b",
        r"\b(breaking|latest news|just heard)\b",
        r"\b(acquired|acquires|acquisition|merger)\b",
    ],
}

# Kinds of willingness-to-pay signal with their patterns, of which the first that matches counts.
WTP_PATTERNS = {
    "direct_payment": [
        r"\b(willing to pay|would pay|ready to pay|will pay)\b",
        r"\b(take my money|shut up and take my money)\b",
        r"\b(subscription|subscribe|monthly|yearly) (fee|cost|price|plan)\b",
        r"\b(how much|what's the (price|cost)|pricing)\b",
        r"\b(prêt à payer|accepte de payer|payerais)\b",
        r"\b(combien|quel (prix|tarif)|coût)\b",
    ],
    "budget": [
        r"\$\d+",
        r"\b\d+\s*(dollars?|USD|EUR|€|\$)\b",
        r"\b(budget|spend|invest|cost)\s*(is|of|up to)?\s*\$?\d+",
        r"\b(budget|dépense|investir|coûter)\s*(de|d'environ)?\s*\d+",
    ],
    "pricing_inquiry": [
        r"\b(price|pricing|cost|fee|rate|charge)\b",
        r"\b(affordable|cheap|expensive|worth it|value for money)\b",
        r"\b(free (trial|version|plan)|freemium|paid (plan|tier|version))\b",
        r"\b(prix|tarif|coût|frais|gratuit|payant)\b",
    ],
    "comparison": [
        r"\b(alternative to|better than|cheaper than|more affordable)\b",
        r"\b(worth upgrading|worth paying|worth the (cost|price))\b",
        r"\b(compare|comparison|vs|versus)\b",
        r"\b(alternatif|alternative à|moins cher|plus abordable)\b",
        r"\b(vaut le coup|vaut la peine|comparaison)\b",
    ],
    "urgent_need": [
        r"\b(need (now|asap|urgently))\b.*\b(pay|budget|cost|price)\b",
        r"\b(desperate|critical|must have)\b.*\b(pay|budget|invest)\b",
        r"\b(besoin urgent|besoin maintenant)\b.*\b(payer|budget|tarif)\b",
    ],
    "dissatisfaction": [
        r"\b(paying for|subscribed to)\b.*\b(but|however|doesn't|not)\b",
        r"\b(cancel|canceling|switching from|leaving)\b.*\b(subscription|plan|service)\b",
        r"\b(overpriced|too expensive|not worth)\b",
        r"\b(trop cher|trop coûteux|pas worth)\b",
        r"\b(résilie|annule|change de)\b.*\b(abonnement|service)\b",
    ],
    "roi": [
        r"\b(ROI|return on investment|save (time|money)|efficiency)\b",
        r"\b((would|will) pay if it (saves|helps))\b",
        r"\b(retour sur investissement|gagner du temps|économiser)\b",
        r"\b(rentable|rentabilité|efficacité)\b",
    ],
}

# Points of a signal kind.
WTP_BONUS = {"direct_payment": 3.0, "budget": 2.5, "dissatisfaction": 2.0, "urgent_need": 1.5, "roi": 1.0, "pricing_inquiry": 0.5, "comparison": 0.5}

# Words of pain.
PAIN_KEYWORDS = [
    "help", "tool", "pay", "automate", "stuck", "urgence", "urgent", "devis", "facture", "invoice",
    "bill", "problem", "issue", "difficult", "hard", "struggle", "need", "looking for", "cherche", "besoin",
    "comment", "how to", "frustrat", "annoying", "time-consuming", "manuel", "manual", "répétit", "repetitive", "tedious",
]

#: The kinds of post that the prefilter keeps.
WANTED_INTENTS = ("pain", "request")


def _java(pattern: str) -> str:
    """The pattern for text in lower case. Word boundaries are Unicode anyway; the slower Unicode classes only where used."""
    plain = pattern.lower() if not re.search(r"\\[A-Z]", pattern) else "(?iu)" + pattern
    return "(?U)" + plain if re.search(r"\\[swd]", pattern) else plain


def _literals(items) -> list[frozenset[str]]:
    """Sets of literals, of each of which a match of the parsed pattern holds one."""
    groups, run = [], ""
    for op, value in [*items, (None, None)]:
        if op is _parser.LITERAL:
            run += chr(value)
            continue
        groups += [frozenset([run])] if run else []
        run = ""
        if op is _parser.SUBPATTERN:
            groups += _literals(value[3])
        elif op is _parser.MAX_REPEAT and value[0] > 0:
            groups += _literals(value[2])
        elif op is _parser.BRANCH:
            own = [_literals(branch) for branch in value[1]]
            if all(own):
                groups.append(frozenset().union(*[max(g, key=lambda x: min(map(len, x))) for g in own]))
    return groups


def _gates(text: Column, patterns: list[str]) -> Column:
    """array<boolean>: whether the lower-cased text holds the literals that a match of each pattern needs.

    A text is searched for plain words once, and the patterns run only where their words stand. A user function also
    keeps the optimizer from repeating the search in filters and aggregates.
    """
    # Classes in upper case make a pattern ignore case, which folds more than lower-casing: such a pattern always runs.
    needed = [[] if re.search(r"\\[A-Z]", p) else [sorted(g) for g in _literals(_parser.parse(p.lower()))] for p in patterns]

    @F.pandas_udf("array<boolean>")
    def gates(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [all(any(w in t for w in group) for group in groups) for groups in needed])

    return gates(text)


def _counts(lowered: Column, patterns: dict[str, list[str]]) -> dict[str, list[Column]]:
    """The matches of each pattern by name, 0 without a search where its literals are missing."""
    gate, at, out = _gates(lowered, [p for own in patterns.values() for p in own]), 0, {}
    for name, own in patterns.items():
        out[name] = [F.when(F.get(gate, F.lit(at + i)), F.regexp_count(lowered, F.lit(_java(p)))).otherwise(0) for i, p in enumerate(own)]
        at += len(own)
    return out


def keyword_count(text: Column, keywords: list[str] = PAIN_KEYWORDS) -> Column:
    """How many of the keywords occur, however often."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [F.contains(lowered, F.lit(k)).cast("int") for k in keywords], F.lit(0))


def any_keyword(text: Column, keywords: list[str]) -> Column:
    """True where any keyword occurs, in any case; no keywords keep all."""
    if not keywords:
        return F.lit(True)
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(k.lower())) for k in keywords])


def rule_intent(text: Column, patterns: dict[str, list[str]] = INTENT_PATTERNS) -> Column:
    """The intent with the most matches, the first in order among equals; null without any."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    scores = [
        F.struct(reduce(lambda a, b: a + b, own).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name"))
        for i, (name, own) in enumerate(_counts(lowered, patterns).items())
    ]
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] > 0, best["name"])


def _snippets(text: Column, patterns: dict[str, list[str]]) -> Column:
    """Up to three extracts: the first two matches of each kind's first pattern with any, and 30 characters on both sides.

    Offsets follow from the pieces between the matches and the matches' own lengths.
    """
    lowered = F.lower(text)
    edges = r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

    def shown(start: Column, length: Column) -> Column:
        low = F.greatest(start - 30, F.lit(0))
        return F.regexp_replace(F.substring(text, low + 1, start + length + 30 - low), edges, "")

    def of(pattern: str) -> Column:
        hits, between = F.regexp_extract_all(lowered, F.lit(_java(pattern)), F.lit(0)), F.split(lowered, _java(pattern), 3)
        first = F.length(F.get(between, F.lit(0)))
        second = first + F.length(F.get(hits, F.lit(0))) + F.length(F.get(between, F.lit(1)))
        return F.when(F.size(hits) > 0, F.array_compact(F.array(shown(first, F.length(F.get(hits, F.lit(0)))), F.when(F.size(hits) > 1, shown(second, F.length(F.get(hits, F.lit(1))))))))

    none = F.array().cast("array<string>")
    return F.slice(F.concat(*[F.coalesce(*[of(p) for p in own], none) for own in patterns.values()]), 1, 3)


def wtp_matches(text: Column, patterns: dict[str, list[str]] = WTP_PATTERNS) -> Column:
    """array<struct<name, n>>: kinds with a match, and the matches of each kind's first pattern that has any."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    counts = {name: F.array(*own) for name, own in _counts(lowered, patterns).items()}
    firsts = F.transform(F.array(*[F.struct(F.lit(k).alias("name"), c.alias("all")) for k, c in counts.items()]), lambda x: F.struct(x["name"].alias("name"), F.get(F.filter(x["all"], lambda n: n > 0), F.lit(0)).alias("n")))
    return F.filter(firsts, lambda x: x["n"].isNotNull())


def wtp_signals(matches: Column, text: Column, examples: bool = True, patterns: dict[str, list[str]] = WTP_PATTERNS) -> Column:
    """struct<has_wtp, signal_types, signal_count, examples> of a column of wtp_matches; types in the lexicon's order.

    `matches` should be a column of its own, as it is read more than once.
    """
    total = F.aggregate(matches, F.lit(0), lambda s, x: s + x["n"])
    shown = F.when(F.size(matches) > 0, _snippets(text, patterns)).otherwise(F.array().cast("array<string>")) if examples else F.array().cast("array<string>")
    return F.struct((F.size(matches) > 0).alias("has_wtp"), F.transform(matches, lambda x: x["name"]).alias("signal_types"), total.cast("int").alias("signal_count"), shown.alias("examples"))


def wtp_score(signals: Column, bonus: dict[str, float] = WTP_BONUS) -> Column:
    """0 to 10: two points a signal up to six, and up to four for its kinds."""
    points = F.aggregate(signals["signal_types"], F.lit(0.0), lambda s, t: s + F.coalesce(F.create_map(*[F.lit(x) for kv in bonus.items() for x in kv])[t], F.lit(0.0)))
    total = F.least(F.least(signals["signal_count"] * 2.0, F.lit(6.0)) + F.least(points, F.lit(4.0)), F.lit(10.0))
    return F.when(F.coalesce(signals["has_wtp"], F.lit(False)), half_even(total, 1)).otherwise(F.lit(0.0))
