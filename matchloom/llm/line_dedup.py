"""Site-relative line dedup: lines that a large share of a site's pages carry are boilerplate.

For each site the pages that contain a line are divided by all pages of the site. A line above
``ratio`` goes from every page of that site. Lines are compared without white space at their edges;
lines empty after that are never counted and always stay.

Only DataFrame functions are used. A line is counted under (site, line digest), so a site with a third
of all pages is spread over as many groups as it has lines, and partial counts are made before the
shuffle. A site's boilerplate lines are fewer than its mean number of lines a page divided by
``ratio``, so the list that joins its pages is bounded by the length of pages, not by their number.

Defined results: a null text stays null and has no lines; an empty text stays empty. Pages with a null
site are a site of their own. A line that a page repeats counts once for it. The share alone decides, on
small sites as on large ones; only a line that a single page has is never boilerplate. A page of
boilerplate only becomes an empty text, or with ``keep_whole`` stays as it was. Repeated pages are pages, unless
``unit`` says which of them count as one. Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: Share of a site's pages above which a line is boilerplate.
RATIO = 0.1
#: Boilerplate digests that may go to all tasks; more are joined by a shuffle.
SENT_LINES = 200_000
#: What ends a line.
BREAK = r"\r\n|\n|\r"


def host(url: Column) -> Column:
    """Lower-cased host of a URL without user and port; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(found != "", found)


def _digest(line: Column) -> Column:
    """128 bits of a line without white space at its edges; null for an empty one."""
    line = F.btrim(line, F.lit(" \t\x0b\f\x85\xa0"))
    return F.when(line != "", F.md5(line.cast("binary")))


def sketch(text: Column, size: int = 5) -> Column:
    """The least hash of a text's runs of ``size`` words, which near copies mostly share; of the words, if fewer."""
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \t\n\x0b\f\r]+")

    def least(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(1)))
        return F.array_min(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(size)))))

    # A variable of a lambda: the text is split once, not once for each of its words.
    return F.transform(F.array(split), least)[0]


def boilerplate(
    pages: DataFrame, site: Column, text: Column, breaks: str = BREAK, ratio: float = RATIO, unit: Column | None = None
) -> DataFrame:
    """Per site with boilerplate: its number of pages and its boilerplate line digests."""
    one = [] if unit is None else [unit.alias("unit")]
    rows = pages.select(F.coalesce(site.cast("string"), F.lit("")).alias("site"), text.alias("text"), *one)
    many = F.count(F.lit(1)) if unit is None else F.count_distinct("unit")
    totals = rows.groupBy("site").agg(many.alias("n_pages"))
    lines = rows.select(
        "site", *(["unit"] if one else []), F.explode(F.array_distinct(F.transform(F.split("text", breaks, -1), _digest))).alias("line")
    ).where(F.col("line").isNotNull())
    if one:  # a line counts once for all pages of a unit
        lines = lines.distinct()
    counts = lines.groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return (
        counts.join(totals, "site")
        .where(F.col("n") > ratio * F.col("n_pages"))
        .groupBy("site")
        .agg(F.first("n_pages").alias("n_pages"), F.collect_list("line").alias("lines"))
    )


def without_boilerplate(
    pages: DataFrame,
    site: Column,
    text: str = "text",
    breaks: str = BREAK,
    joint: str = "\n",
    ratio: float = RATIO,
    unit: Column | None = None,
    keep_whole: bool = False,
) -> DataFrame:
    """Pages with their boilerplate lines taken out; a page without any keeps its text as it was.

    Pages of a site that agree in ``unit`` are counted as one.
    """
    names = pages.columns
    found = stored(boilerplate(pages, site, F.col(text), breaks, ratio, unit).select("site", "lines"))
    if (found.agg(F.sum(F.size("lines"))).head()[0] or 0) <= SENT_LINES:
        found = F.broadcast(found)
    whole = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("page"),
        F.coalesce(site.cast("string"), F.lit("")).alias("site"),
    )
    rows = whole.join(found, "site", "left").select(
        "page", "lines", F.when(F.col("lines").isNotNull(), F.split(F.col(f"page.`{text}`"), breaks, -1)).alias("parts")
    )
    # A null digest (an empty line) is in no list: array_contains gives null for it.
    dropped = lambda line: F.coalesce(F.array_contains("lines", _digest(line)), F.lit(False))
    rows = rows.select("page", "parts", F.filter("parts", lambda line: ~dropped(line)).alias("kept"))
    shorter = F.size("kept") < F.size("parts")
    if keep_whole:
        shorter &= F.exists("kept", lambda line: _digest(line).isNotNull())
    short = F.when(shorter, F.array_join("kept", joint)).otherwise(F.col(f"page.`{text}`"))
    return rows.select(*[short.alias(c) if c == text else F.col(f"page.`{c}`").alias(c) for c in names])


#: HTML tags that stand inside a line; any other tag ends one.
INLINE = (
    "a|abbr|b|bdi|bdo|big|button|cite|code|data|del|dfn|em|font|i|img|input|ins|kbd|label|mark|q|s|samp|small|span"
    "|strike|strong|sub|sup|time|tt|u|var|wbr"
)
# What is opened and never closed goes to the page's end, and no tag reaches past the next "<": each pattern
# reads a page once. Possessive repeats keep long runs of tags or line breaks off the stack.
UNSEEN = (
    r"(?is)<(?:script.*?(?:</script>|\z)|style.*?(?:</style>|\z)|!--.*?(?:-->|\z)"
    rf"|/?(?:{INLINE})(?:[\s/][^<>]*+)?>)"
)
LINE_END = r"(?:\n|<[^<>]*+>)(?:[ \t\n]++|<[^<>]*+>)*+"


def page_text(html: Column) -> Column:
    """Text of an HTML page: lines as its elements end them, without scripts, styles, comments and tags."""
    text = F.regexp_replace(F.regexp_replace(html, UNSEEN, ""), LINE_END, "\n")
    return F.btrim(text, F.lit("\n"))
