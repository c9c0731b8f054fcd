"""Recommended action per document, from its best scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import scoring as sc
from matchloom.functions import text as tx
from matchloom.operators.judge import failure_reason
from matchloom.operators.ranking import ranking_score
from matchloom.operators.variants import JD_SPECIFIC

# Thresholds and default texts of a strategy.
APPLY_FROM = 0.7
CONFIDENCE_LIFT, CONFIDENCE_LOW, CONFIDENCE_HIGH = 0.1, 0.35, 0.95
FALLBACK_REASON = "Guardrail fallback strategy."
FALLBACK_ACTION = "Refine core evidence bullets."
NO_NOTES = "No critical catch-up themes."
NO_WATCHOUTS = "No material watchouts surfaced by current checks."
DEFAULT_ACTION = "Refine 2-3 evidence-backed bullets before applying."

STRATEGY_COLUMNS = [
    "run_id",
    "jd_id",
    "recommended_variant_id",
    "priority_rank",
    "apply_decision",
    "reason_summary",
    "needs_jd_specific_variant",
    "decision_drivers",
    "watchouts",
    "recommended_actions",
    "catch_up_notes",
    "decision_confidence",
    "interview_prep_points",
    "resume_revision_tasks",
]


def reason_summary() -> Column:
    reason = failure_reason(F.col("error_type"), F.col("error_message"))
    return (
        F.when(F.col("assessed"), F.col("decision_rationale"))
        .when(reason.isNotNull(), F.concat(F.lit("LLM assessment unavailable: "), reason))
        .otherwise(F.lit(FALLBACK_REASON))
    )


def planned(ranked: DataFrame) -> DataFrame:
    """Strategy columns by rule for ranked best rows that carry document, candidate and judge columns."""
    score = ranking_score()
    assessed = F.col("assessed")
    missing = F.col("missing_evidence_areas")
    confidence = F.least(F.lit(CONFIDENCE_HIGH), F.greatest(F.lit(CONFIDENCE_LOW), score + F.lit(CONFIDENCE_LIFT)))
    drivers = F.array(
        F.concat(F.lit("Final score "), sc.two_places(score)),
        F.concat(F.lit("Variant type: "), F.col("variant_type")),
    )
    return ranked.withColumns(
        {
            "recommended_variant_id": F.col("variant_id"),
            "apply_decision": F.when(score >= APPLY_FROM, F.lit("apply")).otherwise(F.lit("hold")),
            "reason_summary": reason_summary(),
            "needs_jd_specific_variant": F.col("variant_type") == JD_SPECIFIC,
            "decision_drivers": drivers,
            "watchouts": tx.or_default(F.col("guardrail_flags"), tx.head(missing, 2)),
            "recommended_actions": F.when(assessed, tx.head(F.col("rewrite_opportunities"), 2)).otherwise(
                tx.texts(FALLBACK_ACTION)
            ),
            "catch_up_notes": tx.or_default(tx.head(missing, 2), tx.texts(NO_NOTES)),
            "decision_confidence": sc.round2(confidence),
            "interview_prep_points": tx.head(F.col("interview_focus_areas"), 3),
            "resume_revision_tasks": F.when(assessed, tx.head(F.col("must_fix_issues"), 3)).otherwise(tx.no_texts()),
        }
    )


def backfilled(strategies: DataFrame) -> DataFrame:
    """Fill list columns the planner left empty; needs explanation, flag and document columns."""
    signals = tx.head(F.col("positive_signals"), 3)
    drivers = tx.or_default(signals, F.array(F.col("dimension_reasons")["overall"]))
    fallbacks = {
        "decision_drivers": drivers,
        "watchouts": tx.or_default(F.col("guardrail_flags"), tx.texts(NO_WATCHOUTS)),
        "recommended_actions": tx.texts(DEFAULT_ACTION),
        "interview_prep_points": tx.head(F.col("interview_focus_areas"), 3),
    }
    return strategies.withColumns({name: tx.or_default(F.col(name), value) for name, value in fallbacks.items()})
