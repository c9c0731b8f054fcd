"""Checks on natural-language output: which share is Chinese, what is only an identifier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.text import is_blank, no_texts, strip

# Character classes and limits of the language check.
CJK = r"[一-鿿]"
ASCII_LETTER = "[A-Za-z]"
IDENTIFIER = r"^[A-Za-z0-9_.:/@#\-\[\]]+$"
MIN_CJK_SHARE = 0.45
SHORT_TEXT = 5


def chinese_dominant(text: Column) -> Column:
    cjk = F.regexp_count(text, F.lit(CJK)).cast("double")
    latin = F.regexp_count(text, F.lit(ASCII_LETTER)).cast("double")
    share = F.when(cjk > 0, cjk / (cjk + latin)).otherwise(F.lit(0.0))
    return ~is_blank(text) & (share >= F.lit(MIN_CJK_SHARE))


def identifier_like(text: Column) -> Column:
    inner = strip(text)
    short = (F.length(inner) <= SHORT_TEXT) & F.regexp_like(inner, F.lit(ASCII_LETTER))
    return (inner == "") | F.regexp_like(inner, F.lit(IDENTIFIER)) | short


def json_texts(json_text: Column) -> Column:
    """All string values of a JSON text, at any depth, in order; keys are no values."""
    tokens = F.regexp_extract_all(json_text, F.lit(r'("[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:?)'), 1)
    values = F.filter(tokens, lambda token: ~F.endswith(token, F.lit(":")))
    listed = F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))
    return F.coalesce(F.from_json(listed, "array<string>"), no_texts())


def texts_chinese(texts: Column, required: bool) -> Column:
    """All natural texts are Chinese-dominant; having none passes unless some are required."""
    natural = F.filter(texts, lambda text: ~identifier_like(text))
    good = F.forall(natural, chinese_dominant)
    return good & (F.size(natural) > 0) if required else good


def unfenced(reply: Column) -> Column:
    """A reply without the code fence that it may stand in."""
    inner = strip(F.regexp_replace(F.btrim(strip(reply), F.lit("`")), "^json", ""))
    return F.when(F.startswith(strip(reply), F.lit("```")), inner).otherwise(strip(reply))
