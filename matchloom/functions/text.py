"""Text expressions: trimming, line handling, normalisation and containment."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space characters a text is trimmed of, and the line breaks.
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0" + "".join(
    chr(code) for code in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
# Characters one by one instead of ranges: Java tests such a class with one table lookup.
BREAKS = r"\n\x0b\f\r\x1c\x1d\x1e\x85\x{2028}-\x{2029}"
WORD_CHARACTERS = string.ascii_lowercase + string.digits
#: Characters that no trimming of a bullet takes away; other ends are trimmed.
PLAIN_ENDS = string.ascii_letters + string.digits + "."
MARK = "- "


def strip(text: Column) -> Column:
    """Trim every Unicode white-space character; plain ``trim`` only knows the blank.

    Looks at both ends only, unlike a regular expression, which would walk the whole text.
    """
    return F.btrim(text, F.lit(WHITE))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def lines(text: Column) -> Column:
    """Lines of a text. A two-character break makes one more empty line, which no reader keeps."""
    return F.split(text, f"[{BREAKS}]")


def normalised(text: Column) -> Column:
    """Lower-case ASCII words joined by one blank.

    Everything outside ``[a-z0-9]`` separates words, so one replacement covers both the
    punctuation pass and the white-space pass.
    """
    return F.trim(F.regexp_replace(F.lower(text), f"[^{WORD_CHARACTERS}]+", " "))


def spaced(*arrays: Column) -> Column:
    """All items of all arrays as one blank-separated text."""
    return F.array_join(F.concat(*arrays), " ")


def bullets(text: Column) -> Column:
    """Lines that start with a hyphen, without the hyphens and blanks around them.

    Trimming looks every end up in all white-space characters and measures the whole line, so a line with
    nothing but the mark to take off is cut instead.
    """
    hyphen, mark, plain = F.lit("-"), F.lit(MARK), F.lit(PLAIN_ENDS)

    def item(line: Column) -> Column:
        first, last = F.substring(line, len(MARK) + 1, 1), F.substring(line, -1, 1)
        only_marked = F.startswith(line, mark) & F.contains(plain, first) & F.contains(plain, last)
        cut = F.substring(line, len(MARK) + 1, 2**31 - 1)
        return F.when(only_marked, cut).otherwise(strip(F.btrim(line, mark)))

    marked = F.filter(
        lines(text), lambda line: F.startswith(line, hyphen) | F.startswith(F.ltrim(line, F.lit(WHITE)), hyphen)
    )
    return F.transform(marked, item)


def header(block: Column, label: str) -> Column:
    """Value of the first ``Label:`` line, or an empty text."""
    return strip(F.regexp_extract(block, rf"(?:\A|[{BREAKS}]){SPACE}*{label}:([^{BREAKS}]*)", 1))


def body_bullets(block: Column) -> Column:
    """Bullets after the first ``Body:``; no bullets at all without that mark."""
    body = F.get(F.split(block, "Body:", 2), F.lit(1))
    return F.coalesce(bullets(body), no_texts())


def first_token(text: Column) -> Column:
    """First word of a keyword. A blank keyword is an input error, as it has no first word."""
    token = F.regexp_extract(text, f"{NOT_SPACE}+", 0)
    return F.when(token != "", token).otherwise(F.raise_error(F.lit("keyword without a first word")))


def no_texts() -> Column:
    return F.array().cast("array<string>")


def texts(*values: str) -> Column:
    return F.array(*[F.lit(value) for value in values]).cast("array<string>")


def head(array: Column, size: int) -> Column:
    return F.slice(array, 1, size)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it.

    A column named twice in one expression is worked out twice where code generation does not see that they
    are the same: inside lambdas and branches.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def or_default(array: Column, default: Column) -> Column:
    return once(array, lambda items: F.when(F.size(items) > 0, items).otherwise(default))


def first_item(array: Column, message: str) -> Column:
    """First item; an empty array stops the job with ``message``."""
    return F.coalesce(F.get(array, F.lit(0)), F.raise_error(F.lit(message)))


def lexicon_labels(lowered: Column, lexicon: list[tuple[str, str]] | Column) -> Column:
    """Labels of all lexicon needles found in ``lowered``, in lexicon order.

    A fixed lexicon becomes plain CASE expressions; a lexicon computed by Spark comes as an
    array of (needle, label) structs.
    """
    if isinstance(lexicon, Column):
        # Named in a lambda alone, the text would be made anew for every needle.
        found = once(lowered, lambda text: F.filter(lexicon, lambda entry: F.contains(text, entry["needle"])))
        return F.transform(found, lambda entry: entry["label"])
    return F.array_compact(
        F.array(*[F.when(F.contains(lowered, F.lit(needle)), F.lit(label)) for needle, label in lexicon])
    )


def absent_from(items: Column, text: Column, norm=normalised) -> Column:
    """Items whose normalised form does not occur in ``text``."""
    return F.filter(items, lambda item: ~F.contains(text, norm(item)))


def distinct_texts(*arrays: Column) -> Column:
    """Trimmed non-blank items of all arrays, first occurrence kept, in order."""
    trimmed = F.transform(F.concat(*arrays), lambda item: strip(item))
    return F.array_distinct(F.filter(trimmed, lambda item: item != ""))
