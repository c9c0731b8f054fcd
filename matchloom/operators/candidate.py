"""Candidate documents to one profile per run."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.operators.ordering import running_total

# Skill lexicon, needle and label, in order of precedence.
SKILL_LEXICON = [
    ("python", "Python"),
    ("llm", "LLM workflows"),
    ("resume", "Resume evaluation"),
    ("product", "Product collaboration"),
]
# Defaults and constant columns of a candidate profile.
DEFAULT_SKILLS = ("AI workflow delivery",)
DEFAULT_STRENGTHS = ("Structured AI workflow delivery",)
PROJECT_WORDS = ("prototype", "tool")
INDUSTRY_TAGS = ("AI tooling", "Resume ops")
CONSTRAINTS = ("No explicit production ML platform ownership yet",)
PREFERENCES = ("Product-oriented AI roles",)
MISSING_EVIDENCE = ("Large-scale online experiment ownership",)
ROLE_TRACKS = ("LLM Product Engineer", "Applied AI Ops")


def text_pieces(documents: DataFrame) -> DataFrame:
    """The pieces a run's candidate text consists of, each with its position in that text.

    The text is the pieces in input order with a blank line between them. Positions come from a
    distributed running total, so a run of any size keeps its whole text.
    """
    chunk = F.concat(F.lit("Source: "), F.col("source_value"), F.lit("\n"), tx.strip(F.col("text")))
    filled = documents.filter(~tx.is_blank(F.col("text"))).select("run_id", "input_ord", chunk.alias("piece"))
    placed = running_total(
        filled, ["run_id"], ["input_ord"], [F.col("input_ord")], F.length("piece") + 2, "_end"
    )
    start = F.col("_end") - F.length("piece") - 2
    return placed.select("run_id", "input_ord", start.alias("start_char"), "piece")


def joined_text(documents: DataFrame) -> DataFrame:
    """One text per run, for those that need it whole, such as a prompt; profiles are made without it."""
    chunk = F.concat(F.lit("Source: "), F.col("source_value"), F.lit("\n"), tx.strip(F.col("text")))
    filled = documents.filter(~tx.is_blank(F.col("text"))).select("run_id", "input_ord", chunk.alias("piece"))
    ordered = F.array_sort(F.collect_list(F.struct("input_ord", "piece")))
    return filled.groupBy("run_id").agg(
        F.array_join(F.transform(ordered, lambda item: item["piece"]), "\n\n").alias("resume_text")
    )


def experiences(documents: DataFrame) -> DataFrame:
    """Bullets of all documents of a run, in input order: the same as those of their joined text.

    Bullets are cut out where the document is, so a run's text never has to fit a row, only its bullets.
    """
    chunk = F.concat(F.lit("Source: "), F.col("source_value"), F.lit("\n"), tx.strip(F.col("text")))
    filled = documents.filter(~tx.is_blank(F.col("text")))
    found = filled.select("run_id", "input_ord", tx.bullets(chunk).alias("bullets"))
    ordered = F.array_sort(F.collect_list(F.struct("input_ord", "bullets")))
    return found.groupBy("run_id").agg(F.flatten(F.transform(ordered, lambda item: item["bullets"])).alias("experiences"))


def candidate_profiles(
    resumes: DataFrame,
    skills: list[tuple[str, str]] | Column = SKILL_LEXICON,
    project_words: tuple[str, ...] = PROJECT_WORDS,
) -> DataFrame:
    """Profile of each resume row (run_id, candidate_id, base_resume_path, and resume_text or its ``experiences``)."""
    given = "experiences" in resumes.columns
    lined = resumes if given else resumes.withColumn("experiences", tx.bullets(F.col("resume_text")))
    lined = lined.withColumn("_lowered", F.lower(tx.spaced(F.col("experiences"))))

    def is_project(line: Column) -> Column:
        return reduce(or_, [F.contains(F.lower(line), F.lit(word)) for word in project_words])

    lines = F.col("experiences")
    return lined.select(
        "run_id",
        "candidate_id",
        "base_resume_path",
        "experiences",
        F.filter(lines, is_project).alias("projects"),
        tx.or_default(tx.lexicon_labels(F.col("_lowered"), skills), tx.texts(*DEFAULT_SKILLS)).alias("skills"),
        tx.texts(*INDUSTRY_TAGS).alias("industry_tags"),
        tx.or_default(tx.head(lines, 2), tx.texts(*DEFAULT_STRENGTHS)).alias("strengths"),
        tx.texts(*CONSTRAINTS).alias("constraints"),
        tx.texts(*PREFERENCES).alias("preferences"),
        tx.head(lines, 3).alias("core_claims"),
        tx.head(lines, 4).alias("verified_evidence"),
        tx.texts(*MISSING_EVIDENCE).alias("missing_evidence_areas"),
        tx.texts(*ROLE_TRACKS).alias("preferred_role_tracks"),
    )


def with_match_texts(candidates: DataFrame) -> DataFrame:
    """Add the four texts that needles are looked up in, once per candidate instead of per pair."""
    gap_lines = tx.spaced(F.col("experiences"), F.col("projects"), F.col("skills"))
    rule_lines = tx.spaced(
        F.col("experiences"), F.col("projects"), F.col("skills"), F.col("industry_tags"), F.col("strengths")
    )
    guard_lines = tx.spaced(F.col("experiences"), F.col("projects"), F.col("skills"), F.col("strengths"))
    return candidates.withColumns(
        {
            "rule_text": tx.normalised(rule_lines),
            "gap_text": tx.normalised(gap_lines),
            "claim_text": F.lower(gap_lines),
            "guard_text": F.lower(guard_lines),
        }
    )
