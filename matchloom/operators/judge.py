"""Judging of scored pairs: the built-in judge, guardrails and the final score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import scoring as sc
from matchloom.functions import text as tx
from matchloom.operators.variants import JD_SPECIFIC

# Names and thresholds of the built-in judge.
DETERMINISTIC = "deterministic"
HEURISTIC_MODEL = "heuristic-v0.3.0"
RANKING_VERSION = "v0.3.0-llm-eval"
REVIEW_THRESHOLD = 0.7
ROLE_FIT_LIFT = 0.03
EVIDENCE_QUALITY = {"verified": 0.8, "unverified": 0.62}
PERSUASIVENESS = {"jd-specific": 0.76, "other": 0.68}
STRONG_APPLY, APPLY, HOLD = "strong_apply", "apply", "hold"
STRONG_FROM, APPLY_FROM = 0.8, 0.65
HOLD_ISSUE = "Core evidence is too weak for this role level."

# Judge weights, caps and flags.
JUDGE_WEIGHTS = {"role_fit": 0.35, "evidence_quality": 0.25, "persuasiveness": 0.2, "risk": 0.2}
BINDING_MINIMUM, BINDING_CAP = 0.4, 0.65
MUST_HAVE_CAP = 0.79
FLAG_MISSING = "llm_assessment_missing"
FLAG_INCOMPLETE = "llm_assessment_incomplete"
FLAG_EVIDENCE = "insufficient_evidence_cap"
FLAG_CLAIMS = "untraceable_claims"
FLAG_MUST_HAVE = "missing_must_have_requirements"
FROM_FALLBACK, FROM_JUDGE, FROM_GUARDRAIL = "guardrail-fallback", "llm-primary", "llm-primary+guardrail"

# Error recorded for an assessment whose core fields are unusable.
INVALID_TYPE, INVALID_MESSAGE = "ValueError", "assessment payload missing core fields"
EXCERPT_CHARS = 200

ASSESSMENT_COLUMNS = [
    "role_fit",
    "evidence_quality",
    "persuasiveness",
    "interview_pressure_risk",
    "application_worthiness",
    "must_fix_issues",
    "evidence_citations",
    "rewrite_opportunities",
    "decision_rationale",
    "assessment_provider",
    "assessment_model",
]


def review_text(overall: Column) -> Column:
    risk = F.when(overall >= REVIEW_THRESHOLD, F.lit("manageable risk")).otherwise(F.lit("meaningful catch-up risk"))
    return F.concat(
        F.col("variant_type"), F.lit(" variant aligns "), F.col("candidate_id"), F.lit(" with "), F.col("title"),
        F.lit("; score indicates "), risk, F.lit(" for this batch."),
    )


def review_worthiness(overall: Column) -> Column:
    return F.when(overall >= REVIEW_THRESHOLD, F.lit(APPLY)).otherwise(F.lit("stretch"))


def with_review(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("judge_rationale", review_text(F.col("overall_score")))


def with_assessment(pairs: DataFrame, provider: str = DETERMINISTIC, model: str = HEURISTIC_MODEL) -> DataFrame:
    """The built-in judge as plain columns."""
    lifted = sc.round2(F.least(F.lit(0.99), F.greatest(F.lit(0.0), F.col("overall_score") + F.lit(ROLE_FIT_LIFT))))
    role_fit = F.col("role_fit")
    verified = F.size("verified_evidence") > 0
    specific = F.col("variant_type") == JD_SPECIFIC
    quality = F.when(verified, EVIDENCE_QUALITY["verified"]).otherwise(F.lit(EVIDENCE_QUALITY["unverified"]))
    appeal = F.when(specific, PERSUASIVENESS["jd-specific"]).otherwise(F.lit(PERSUASIVENESS["other"]))
    rationale = F.concat(
        F.lit("Deterministic LLM-assessment fallback based on rule score "),
        sc.two_places(F.col("overall_score")),
        F.lit("."),
    )
    worthiness = (
        F.when(role_fit >= STRONG_FROM, F.lit(STRONG_APPLY))
        .when(role_fit >= APPLY_FROM, F.lit(APPLY))
        .otherwise(F.lit(HOLD))
    )
    return pairs.withColumn("role_fit", lifted).withColumns(
        {
            "evidence_quality": quality,
            "persuasiveness": appeal,
            "interview_pressure_risk": sc.round2(F.greatest(F.lit(0.0), 1 - role_fit)),
            "application_worthiness": worthiness,
            "must_fix_issues": F.when(role_fit < APPLY_FROM, tx.texts(HOLD_ISSUE)).otherwise(tx.no_texts()),
            "evidence_citations": tx.head(F.col("verified_evidence"), 3),
            "rewrite_opportunities": tx.head(F.col("stretch_points"), 2),
            "decision_rationale": rationale,
            "assessment_provider": F.lit(provider),
            "assessment_model": F.lit(model),
        }
    )


def assessment_usable() -> Column:
    """Worthiness named and all four scores inside [0, 1]."""
    usable = ~tx.is_blank(F.col("application_worthiness"))
    for score in ASSESSMENT_COLUMNS[:4]:
        usable = usable & F.col(score).between(0.0, 1.0)
    return F.coalesce(usable, F.lit(False))


def assessment_incomplete() -> Column:
    return tx.is_blank(F.col("decision_rationale")) | (F.size("evidence_citations") == 0)


def judge_overall() -> Column:
    weight = JUDGE_WEIGHTS
    return sc.round2(
        F.col("role_fit") * F.lit(weight["role_fit"])
        + F.col("evidence_quality") * F.lit(weight["evidence_quality"])
        + F.col("persuasiveness") * F.lit(weight["persuasiveness"])
        + (1 - F.col("interview_pressure_risk")) * F.lit(weight["risk"])
    )


def settle_assessments(pairs: DataFrame) -> DataFrame:
    """Split judge output into accepted and failed rows, in place.

    Adds ``assessed``; rows whose judge call failed keep its error, rows with unusable fields
    get the fixed one. Rows are never lost: a failed judge falls back to the rule score.
    """
    errors = {"error_type": "string", "error_message": "string"}
    for column, kind in errors.items():
        if column not in pairs.columns:
            pairs = pairs.withColumn(column, F.lit(None).cast(kind))
    called = F.col("error_type").isNull()
    checked = pairs.withColumn("assessed", called & assessment_usable())
    rejected = called & ~F.col("assessed")
    return checked.withColumns(
        {
            # An error without a message gets its type, so that all later stages tell the same reason.
            "error_message": F.when(rejected, F.lit(INVALID_MESSAGE)).otherwise(
                F.coalesce(F.nullif(tx.strip(F.col("error_message")), F.lit("")), F.col("error_type"))
            ),
            "error_type": F.when(rejected, F.lit(INVALID_TYPE)).otherwise(F.col("error_type")),
        }
    )


def must_haves_missing() -> Column:
    """Some must-have requirement does not occur, un-normalised, in the candidate's lines."""
    return F.exists("must_have_requirements", lambda item: ~F.contains(F.col("guard_text"), F.lower(item)))


def with_final_score(pairs: DataFrame, provider: str = DETERMINISTIC, model: str = HEURISTIC_MODEL) -> DataFrame:
    """Judge score first, rule score as fallback, guardrails as caps and flags."""
    assessed = F.col("assessed")
    weak_binding = F.col("evidence_binding") < BINDING_MINIMUM
    over_confident = (F.col("application_worthiness") == STRONG_APPLY) & must_haves_missing()
    raised = F.array_compact(
        F.array(
            F.when(assessment_incomplete(), F.lit(FLAG_INCOMPLETE)),
            F.when(weak_binding, F.lit(FLAG_EVIDENCE)),
            F.when(F.size("untraceable_claim_flags") > 0, F.lit(FLAG_CLAIMS)),
            F.when(over_confident, F.lit(FLAG_MUST_HAVE)),
        )
    )
    judged = pairs.withColumns(
        {
            "guardrail_flags": F.when(assessed, raised).otherwise(tx.texts(FLAG_MISSING)),
            "llm_overall_score": F.when(assessed, judge_overall()).otherwise(F.lit(0.0)),
        }
    )

    def capped(score: Column, flag: str, cap: float) -> Column:
        return F.when(F.array_contains("guardrail_flags", flag), F.least(score, F.lit(cap))).otherwise(score)

    capped_score = capped(capped(F.col("llm_overall_score"), FLAG_EVIDENCE, BINDING_CAP), FLAG_MUST_HAVE, MUST_HAVE_CAP)

    def judge_column(column: str) -> Column:
        return F.when(assessed, F.col(column)).otherwise(F.lit(0.0))

    def named(column: str, fallback: str) -> Column:
        return F.when(assessed, F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(fallback))).otherwise(
            F.lit(fallback)
        )

    source = (
        F.when(~assessed, F.lit(FROM_FALLBACK))
        .when(F.size("guardrail_flags") > 0, F.lit(FROM_GUARDRAIL))
        .otherwise(F.lit(FROM_JUDGE))
    )
    return judged.withColumns(
        {
            "ranking_version": F.lit(RANKING_VERSION),
            "llm_role_fit_score": judge_column("role_fit"),
            "llm_evidence_score": judge_column("evidence_quality"),
            "llm_persuasion_score": judge_column("persuasiveness"),
            "llm_risk_score": judge_column("interview_pressure_risk"),
            "final_overall_score": F.when(assessed, sc.round2(capped_score)).otherwise(F.col("overall_score")),
            "final_decision_source": source,
            "provider": named("assessment_provider", provider),
            "model": named("assessment_model", model),
        }
    )


def failure_rows(pairs: DataFrame) -> DataFrame:
    """One record per pair whose judge gave nothing usable."""
    message = F.coalesce(F.nullif(tx.strip(F.col("error_message")), F.lit("")), F.col("error_type"))
    return pairs.filter(~F.col("assessed")).select(
        "run_id",
        "jd_index",
        "variant_ord",
        "jd_id",
        "variant_id",
        F.lit("evaluate").alias("stage"),
        "provider",
        "model",
        "error_type",
        message.alias("error_message"),
        F.substring(message, 1, EXCERPT_CHARS).alias("raw_output_excerpt"),
    )


def failure_reason(error_type: Column, error_message: Column) -> Column:
    """``Type: message`` of a failure; null without one."""
    return F.when(error_type.isNotNull(), F.concat_ws(": ", error_type, F.nullif(error_message, F.lit(""))))
