"""Text scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int = 0) -> Column:
    """Rounds ties of the scaled double to even, as the engine's scores do everywhere."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def post_text(title: Column, body: Column) -> Column:
    """What is embedded: the title, and the body behind it where there is one."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat_ws(" ", title, body)).otherwise(title)


def joined_text(title: Column, body: Column) -> Column:
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))))


def estimate_tokens(text: Column) -> Column:
    """Four characters a token, rounded down."""
    return F.floor(F.length(text) / 4)


def with_ellipsis(text: Column, limit: Column | int) -> Column:
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.when(F.length(text) > limit, F.concat(F.substring(text, F.lit(1), limit.cast("int")), F.lit("..."))).otherwise(text)


def truncate_to_tokens(text: Column, tokens: Column | int) -> Column:
    tokens = F.lit(tokens) if isinstance(tokens, int) else tokens
    return with_ellipsis(text, tokens * 4)


def preview(text: Column) -> Column:
    return with_ellipsis(text, 200)


def identity_hash(post_id: Column, url: Column) -> Column:
    """A missing url counts as the word None."""
    return F.md5(F.concat(post_id, F.lit(":"), F.coalesce(url, F.lit("None"))))


def content_hash(title: Column, body: Column) -> Column:
    return F.md5(normalize_whitespace(F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))))))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\w+)"), F.lit(1)))


def terms(text: Column, longer_than: int = 3) -> Column:
    """Lower-cased words of more than `longer_than` characters, repeats included."""
    words = F.split(normalize_whitespace(F.lower(F.coalesce(text, F.lit("")))), " ")
    return F.filter(words, lambda w: F.length(w) > longer_than)


def cost(tokens_in: Column, price_in: Column, tokens_out: Column | None = None, price_out: Column | None = None) -> Column:
    """Prices are for 1,000 tokens."""
    total = tokens_in / 1000.0 * price_in
    return total if tokens_out is None else total + tokens_out / 1000.0 * price_out


def fixed(value: Column, digits: int) -> Column:
    """`value` with so many decimals, rounded as C does: by the double's exact value, and exact ties to even.

    Java rounds the shortest decimal that names the double, half up. Both differ only where that decimal lies half-way;
    there the double's distance from it is exact in two parts of 26 bits, and the value moves off the tie.
    """
    size, halves = F.abs(value), 2.0 * 10**digits
    odd = F.rint(size * halves)  # the half-way decimal is this number of half units
    high = size * 134217729.0 - (size * 134217729.0 - size)
    beyond = (high * halves - odd) + (size - high) * halves
    down = (beyond < 0) | ((beyond == 0) & (F.pmod(odd, F.lit(4.0)) == 1))
    tied = (F.pmod(odd, F.lit(2.0)) == 1) & (odd / halves == size) & down
    return F.format_string(f"%.{digits}f", F.when(tied, F.signum(value) * (odd - 0.5) / halves).otherwise(value))


def format_cost(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.when(amount < 0.01, fixed(amount, 4)).otherwise(fixed(amount, 2)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def run_id(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")


def iso_epoch(text: Column) -> Column:
    """ISO 8601 -> epoch seconds; null where it is not a date."""
    return F.unix_timestamp(F.try_to_timestamp(text)).cast("double")


def view_count(text: Column) -> Column:
    """'1,234 views', '12K views' and '1.2M views' as a number; 0 where there is none."""
    number = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([\d.,]*\d)", 1)
    suffix = F.upper(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*[\d.,]*\d\s*([KkMm])\b", 1))
    scaled = F.regexp_replace(number, ",", "").try_cast("double") * F.when(suffix == "K", 1e3).otherwise(1e6)
    plain = F.regexp_replace(number, "[.,]", "").try_cast("double")
    return F.coalesce(F.when(suffix != "", scaled).otherwise(plain), F.lit(0.0)).cast("long")
