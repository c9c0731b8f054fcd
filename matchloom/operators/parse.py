"""Target documents (job descriptions) to typed profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.operators.ordering import running_total

# Block mark, id format and defaults of the document format.
BLOCK_MARK = "=== JD ==="
ID_FORMAT = "jd-%03d"
SENIORITY = "mid"
LEVEL_CONFIDENCE = 0.72
NO_CLUSTER = "general"
BONUS_LEAD = "Bonus for "
BONUS_WORD = "bonus"

# Keyword lexicon, needle and label, in order of precedence.
KEYWORD_LEXICON = [
    ("evaluation", "evaluation"),
    ("ranking", "ranking"),
    ("python", "python"),
    ("prompt", "prompt engineering"),
    ("product", "product collaboration"),
    ("automation", "automation"),
    ("metrics", "metrics"),
    ("experimentation", "experimentation"),
    ("llm", "llm"),
]
KEYWORD_LIMIT = 5
DEFAULT_KEYWORDS = ("python", "ai workflows")

# Risk signals and the words that raise them.
METRICS_SIGNAL = "Requires metrics storytelling"
METRICS_WORDS = ("metrics", "experimentation")
PROMPT_SIGNAL = "Prompt quality will be probed"
PROMPT_WORDS = ("prompt",)


def blocks(content: Column) -> Column:
    """Non-blank blocks of one input text."""
    trimmed = F.transform(F.split(content, BLOCK_MARK), lambda block: tx.strip(block))
    return F.filter(trimmed, lambda block: block != "")


def number_blocks(inputs: DataFrame) -> DataFrame:
    """One row per block with an id that counts on over all inputs of a run.

    Only the block count per input takes part in the numbering; the texts are split in the row
    they arrive in.
    """
    counted = inputs.withColumn("_blocks", blocks(F.col("content"))).drop("content")
    placed = running_total(
        counted, ["run_id"], ["input_ord"], [F.col("input_ord")], F.size("_blocks"), "_last_number"
    )
    first = F.col("_last_number") - F.size("_blocks")
    exploded = placed.select(
        "*", first.alias("_first"), F.posexplode("_blocks").alias("_pos", "block")
    ).withColumn("jd_index", F.col("_first") + F.col("_pos"))
    return exploded.withColumn("jd_id", F.format_string(ID_FORMAT, F.col("jd_index") + 1)).drop(
        "_blocks", "_last_number", "_first", "_pos"
    )


def keywords(lowered: Column, lexicon: list[tuple[str, str]] | Column = KEYWORD_LEXICON) -> Column:
    found = tx.head(tx.lexicon_labels(lowered, lexicon), KEYWORD_LIMIT)
    return tx.or_default(found, tx.texts(*DEFAULT_KEYWORDS))


def cluster(title: Column, body: Column) -> Column:
    """First words of the title, else of the body, as a slug."""

    def slug(text: Column) -> Column:
        words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
        return F.nullif(F.array_join(tx.head(words, 4), "-"), F.lit(""))

    return F.coalesce(slug(title), slug(tx.spaced(body)), F.lit(NO_CLUSTER))


def bonuses(body: Column) -> Column:
    named = F.filter(body, lambda line: F.contains(F.lower(line), F.lit(BONUS_WORD)))
    return F.transform(named, lambda line: tx.strip(F.replace(line, F.lit(BONUS_LEAD), F.lit(""))))


def risk_signals(lowered: Column) -> Column:
    def raised(signal: str, words: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(lowered, F.lit(word))
        return F.when(hit, F.lit(signal))

    return F.array_compact(
        F.array(raised(METRICS_SIGNAL, METRICS_WORDS), raised(PROMPT_SIGNAL, PROMPT_WORDS))
    )


def jd_profiles(blocks_df: DataFrame, lexicon: list[tuple[str, str]] | Column = KEYWORD_LEXICON) -> DataFrame:
    """Profiles out of numbered blocks: a row-wise projection, no shuffle."""
    parsed = blocks_df.withColumns(
        {
            "title": tx.header(F.col("block"), "Title"),
            "company": tx.header(F.col("block"), "Company"),
            "responsibilities": tx.body_bullets(F.col("block")),
        }
    ).withColumn("_lowered", F.lower(tx.spaced(F.col("responsibilities"))))
    derived = parsed.withColumns(
        {
            "keywords": keywords(F.col("_lowered"), lexicon),
            # Lines are looked at one by one only where the word occurs at all.
            "bonuses": F.when(
                F.contains("_lowered", F.lit(BONUS_WORD)), bonuses(F.col("responsibilities"))
            ).otherwise(tx.no_texts()),
            "risk_signals": risk_signals(F.col("_lowered")),
        }
    )
    body = F.col("responsibilities")
    return derived.select(
        "run_id",
        "jd_index",
        "jd_id",
        "title",
        "company",
        cluster(F.col("title"), body).alias("cluster"),
        "responsibilities",
        tx.head(body, 2).alias("requirements"),
        "keywords",
        F.lit(SENIORITY).alias("seniority"),
        "bonuses",
        "risk_signals",
        "source_type",
        "source_value",
        tx.head(body, 2).alias("must_have_requirements"),
        tx.head(F.col("bonuses"), 2).alias("nice_to_have_requirements"),
        F.filter("risk_signals", lambda s: F.contains(F.lower(s), F.lit("metrics"))).alias("hidden_signals"),
        tx.head(F.col("keywords"), 3).alias("interview_focus_areas"),
        F.lit(LEVEL_CONFIDENCE).alias("role_level_confidence"),
    )


def jd_evidence(jds: DataFrame) -> DataFrame:
    """The per-document part of the evidence map, one row per profile."""
    return jds.select(
        "run_id",
        "jd_index",
        "jd_id",
        F.col("must_have_requirements").alias("must_have"),
        tx.head(F.col("responsibilities"), 3).alias("source_snippets"),
        "risk_signals",
    )
