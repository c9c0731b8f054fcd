"""Numeric expressions: two-decimal rounding, bounds and the score formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions import text as tx

#: Spellings of a number that count; Spark's cast alone also takes those of Java, such as ``1d``.
DIGITS = "[0-9](?:_?[0-9])*"
NUMBER = rf"[+-]?(?:(?:{DIGITS}\.?(?:{DIGITS})?|\.{DIGITS})(?:[eE][+-]?{DIGITS})?|(?i:inf|infinity|nan))"


def two_places(value: Column) -> Column:
    """``0.87``-style text. Rounds the exact binary value, half to even."""
    return F.call_function("format_number", value, F.lit("0.00"))


def round2(value: Column) -> Column:
    """Two-decimal rounding of the binary value; ``round`` and ``bround`` go via decimals and differ."""
    return two_places(value).cast("double")


def clamp(value: Column, low: float, high: float) -> Column:
    # least and greatest skip nulls, so a missing value would come out as the upper bound.
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def bounded(value: Column) -> Column:
    """Score in [0, 0.99], two decimals."""
    return round2(clamp(value, 0.0, 0.99))


def ratio(part: Column, total: Column) -> Column:
    share = part.cast("double") / total.cast("double")
    return F.when(total <= 0, F.lit(0.0)).otherwise(bounded(share))


def score_or_else(score: Column, other: Column) -> Column:
    """``score`` unless it is missing or exactly zero."""
    return F.coalesce(F.nullif(score, F.lit(0.0)), other)


def safe_score(text: Column) -> Column:
    """Score out of untrusted text: unreadable is 0, the rest is clamped to [0, 1]."""
    plain = tx.strip(text)
    number = F.when(plain.rlike(f"^{NUMBER}$"), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))
    return F.coalesce(round2(clamp(number, 0.0, 1.0)), F.lit(0.0))


def safe_texts(json_text: Column) -> Column:
    """List of texts out of an untrusted JSON value; anything but a list gives no items.

    Scalars keep the spelling the record format uses for them (``True``, ``None``); blank items
    are dropped.
    """
    items = F.from_json(json_text, "array<variant>")
    # A variant forgets whether a number was written with a point; the texts of the items know.
    written = F.from_json(json_text, "array<string>")

    def spelled(item: Column, place: Column) -> Column:
        number = F.get(written, place)
        kind = F.schema_of_variant(item)
        plain = F.try_variant_get(item, "$", "string")
        return (
            F.when(item.isNull() | (kind == "VOID"), F.lit("None"))
            .when(kind == "BOOLEAN", F.initcap(plain))
            .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & number.rlike("[.eE]"), number.try_cast("double").cast("string"))
            .otherwise(plain)
        )

    kept = F.filter(F.transform(items, spelled), lambda item: ~tx.is_blank(item))
    return F.coalesce(kept, F.array().cast("array<string>"))


def percent(value: Column) -> Column:
    """Whole percent of a clamped score, halves up."""
    return F.floor(clamp(value, 0.0, 1.0) * F.lit(100.0) + F.lit(0.5)).cast("long")
