"""Ranking explanations, including those of runs that stored none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import scoring as sc
from matchloom.functions import text as tx
from matchloom.operators.judge import RANKING_VERSION, failure_reason
from matchloom.operators.ordering import last_per_key
from matchloom.operators.ranking import ranking_score

EXPLANATION_COLUMNS = [
    "ranking_version",
    "dimension_reasons",
    "positive_signals",
    "risk_flags",
    "evidence_refs",
    "decision_summary",
]
# Reasons given for runs without stored explanations.
LEGACY_LEAD = "Legacy run fallback: "


def labelled(**scores: Column) -> Column:
    """``name=0.87; other=0.50``."""
    return F.concat_ws("; ", *[F.concat(F.lit(f"{name}="), sc.two_places(value)) for name, value in scores.items()])


def reasons(**parts: Column) -> Column:
    return F.create_map(*[item for name, value in parts.items() for item in (F.lit(name), value)])


def summary_text() -> Column:
    """Why the score is what it is: the judge's words, or what replaced them."""
    rule_score = F.concat(
        F.lit("Fallback to rules with overall score "), sc.two_places(F.col("overall_score")), F.lit(".")
    )
    reason = failure_reason(F.col("error_type"), F.col("error_message"))
    silent = F.concat(
        F.lit("LLM assessment accepted with incomplete rationale; final score "),
        sc.two_places(ranking_score()),
        F.lit("."),
    )
    return (
        F.when(F.col("assessed") & (F.col("decision_rationale") != ""), F.col("decision_rationale"))
        .when(F.col("assessed"), silent)
        .when(reason.isNotNull(), F.concat(F.lit("LLM assessment unavailable: "), reason, F.lit(". "), rule_score))
        .otherwise(rule_score)
    )


def with_explanation(evaluations: DataFrame) -> DataFrame:
    """Add the explanation columns to evaluated pairs."""
    col = F.col
    cited = col("assessed") & (F.size("evidence_citations") > 0)
    dimension_reasons = reasons(
        fit=labelled(rule_fit=col("fit_score"), llm_role_fit=col("llm_role_fit_score")),
        ats=labelled(keyword_coverage=col("keyword_coverage")),
        evidence=labelled(rule_evidence=col("evidence_binding"), llm_evidence=col("llm_evidence_score")),
        stretch=labelled(stretch=col("stretch_score")),
        gap_risk=labelled(gap_risk=col("gap_risk_score")),
        rewrite_cost=labelled(rewrite_cost=col("rewrite_cost_score")),
        overall=col("decision_summary"),
    )
    source = F.concat(F.lit("decision_source="), col("final_decision_source"))
    return evaluations.withColumn("decision_summary", summary_text()).withColumns(
        {
            "dimension_reasons": dimension_reasons,
            "positive_signals": F.array(labelled(final_score=ranking_score()), source),
            "risk_flags": tx.or_default(col("guardrail_flags"), tx.head(col("untraceable_claim_flags"), 2)),
            "evidence_refs": F.when(cited, col("evidence_citations")).otherwise(tx.head(col("matched_lines"), 3)),
        }
    )


def explanation_rows(evaluations: DataFrame) -> DataFrame:
    return evaluations.select("run_id", "jd_index", "variant_ord", "jd_id", "variant_id", *EXPLANATION_COLUMNS)


def legacy_explanations(scorecards: DataFrame, gaps: DataFrame) -> DataFrame:
    """Explanations made up from scorecards and gap maps alone."""
    items = last_per_key(gaps.select("run_id", "jd_id", "items", "jd_index"), ["run_id", "jd_id"], "jd_index")
    joined = scorecards.join(items.drop("jd_index"), ["run_id", "jd_id"], "left")
    firsts = F.flatten(F.transform("items", lambda item: F.slice(item["weak_points"], 1, 1)))
    score = ranking_score()
    overall = F.concat(
        F.lit(f"{LEGACY_LEAD[:-2]} for "), F.col("variant_id"), F.lit(": "), labelled(final_score=score),
        F.lit(", "), labelled(gap_risk_score=F.col("gap_risk_score")), F.lit("."),
    )

    def not_captured(what: str) -> Column:
        return F.lit(f"{LEGACY_LEAD}{what} reasoning not captured.")

    def from_card(**score_column: Column) -> Column:
        return F.concat(labelled(**score_column), F.lit(" based on legacy scorecard."))

    return joined.withColumn("_overall", overall).select(
        "run_id",
        "jd_index",
        "variant_ord",
        "jd_id",
        "variant_id",
        F.coalesce(F.nullif(F.col("ranking_version"), F.lit("")), F.lit(RANKING_VERSION)).alias("ranking_version"),
        reasons(
            fit=not_captured("fit"),
            ats=not_captured("ATS"),
            evidence=not_captured("evidence"),
            stretch=not_captured("stretch"),
            gap_risk=from_card(gap_risk_score=F.col("gap_risk_score")),
            rewrite_cost=from_card(rewrite_cost_score=F.col("rewrite_cost_score")),
            overall=F.col("_overall"),
        ).alias("dimension_reasons"),
        F.array(F.concat(labelled(final_score=score), F.lit(" from legacy scorecard"))).alias("positive_signals"),
        tx.head(F.coalesce(firsts, tx.no_texts()), 2).alias("risk_flags"),
        tx.no_texts().alias("evidence_refs"),
        F.coalesce(F.nullif(F.col("judge_rationale"), F.lit("")), F.col("_overall")).alias("decision_summary"),
    )


def complete_explanations(stored: DataFrame, scorecards: DataFrame, gaps: DataFrame) -> DataFrame:
    """Stored explanations, and made-up ones for the scorecards that have none."""
    uncovered = scorecards.join(
        stored.select("run_id", "jd_id", "variant_id"), ["run_id", "jd_id", "variant_id"], "left_anti"
    )
    return stored.unionByName(legacy_explanations(uncovered, gaps), allowMissingColumns=True)
