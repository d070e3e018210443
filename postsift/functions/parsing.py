"""Parsing of model responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keys that a response must have.
LEGACY_FIELDS = ["title", "description", "monetizable", "justification", "mvp", "pain_score_llm"]
ENRICHED_FIELDS = ["title", "problem", "persona", "jtbd", "context", "monetizable", "mvp", "alternatives", "willingness_to_pay_signal", "pain_score_llm"]

# Sectors.
SECTORS = [
    "dev_tools", "ai_llm", "business_pme", "education_learning", "health_wellbeing", "consumer_lifestyle", "creator_economy",
    "workplace_hr", "finance_accounting", "legal_compliance", "marketing_sales", "ecommerce_retail", "other",
]

# Word of a heading -> section of an exploration.
SECTIONS = {"monetization": "monetization_ideas", "product variant": "product_variants", "validation": "validation_steps"}


def response_json(text: Column) -> Column:
    """The JSON text of a response: the whole, else what a json fence holds, else a bare fence; null if none parses."""
    def valid(part: Column) -> Column:
        return F.when(F.try_parse_json(part).isNotNull(), F.trim(part))

    tagged = F.regexp_extract(text, r"(?s)```json(.*?)```", 1)
    bare = F.regexp_extract(text, r"(?s)```(.*?)```", 1)
    fenced = F.when(F.contains(text, F.lit("```json")), valid(tagged)).otherwise(valid(bare))
    return F.coalesce(valid(F.when(F.trim(text) != "", text)), fenced)


def has_fields(json_text: Column, fields: list[str]) -> Column:
    keys = F.json_object_keys(json_text)
    return F.coalesce(reduce(lambda a, b: a & b, [F.array_contains(keys, f) for f in fields]), F.lit(False))


def response_field(json_text: Column, field: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(json_text), f"$.{field}", kind)


def clamp(value: Column, low: float, high: float) -> Column:
    """Null stays null, which greatest and least pass over."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def valid_sector(label: Column, raw: Column | None = None) -> Column:
    """`label` if it is a sector; else the first sector named in `raw`; else other."""
    known = F.lower(F.trim(label))
    mentioned = F.lit(None).cast("string") if raw is None else F.get(F.filter(F.array(*[F.lit(s) for s in SECTORS]), lambda s: F.contains(F.lower(raw), s)), F.lit(0))
    return F.when(known.isin(SECTORS), known).otherwise(F.coalesce(mentioned, F.lit("other")))


def exploration_sections(responses: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section, items): list lines below each heading; a later heading of the same section replaces its items."""
    lines = responses.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    lowered = F.lower(F.trim("line"))
    heading = F.contains(F.col("line"), F.lit("##")) | F.contains(F.col("line"), F.lit("**"))
    named = F.coalesce(*[F.when(heading & F.contains(lowered, F.lit(word)), F.lit(section)) for word, section in SECTIONS.items()])
    by_line = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("named", named).withColumns({
        "section": F.last("named", ignorenulls=True).over(by_line),
        "turn": F.last(F.when(F.col("named").isNotNull(), F.col("pos")), ignorenulls=True).over(by_line),
    })
    items = marked.where(F.col("named").isNull() & F.col("section").isNotNull() & F.trim("line").rlike(r"^[-*0-9]"))
    turns = items.groupBy(id_col, "section", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", F.trim("line").alias("item")))).alias("rows"))
    last = turns.groupBy(id_col, "section").agg(F.max_by("rows", "turn").alias("rows"))
    return last.select(id_col, "section", F.transform("rows", lambda r: r["item"]).alias("items"))
