"""The staged run as lazy DataFrame functions; persist between stages only where it pays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators import candidate as cand
from matchloom.operators import explain, judge, ranking, rules, strategy, variants
from matchloom.operators.ordering import last_per_key

PAIR = ["run_id", "jd_id", "variant_id"]

SCORECARD_COLUMNS = [
    "run_id",
    "jd_index",
    "variant_ord",
    "jd_id",
    "variant_id",
    "fit_score",
    "ats_score",
    "evidence_score",
    "stretch_score",
    "gap_risk_score",
    "rewrite_cost_score",
    "overall_score",
    "ranking_version",
    "judge_rationale",
    "llm_role_fit_score",
    "llm_evidence_score",
    "llm_persuasion_score",
    "llm_risk_score",
    "llm_overall_score",
    "final_overall_score",
    "final_decision_source",
    "guardrail_flags",
    "provider",
    "model",
]

# What the planner reads of the best evaluated row of a document.
PLAN_COLUMNS = [
    "jd_index",
    "variant_id",
    "variant_type",
    "title",
    "company",
    "final_overall_score",
    "overall_score",
    "final_decision_source",
    "guardrail_flags",
    "assessed",
    "error_type",
    "error_message",
    "decision_rationale",
    "rewrite_opportunities",
    "must_fix_issues",
    "interview_focus_areas",
    "missing_evidence_areas",
    "positive_signals",
    "dimension_reasons",
    "evidence_refs",
]


def scored_pairs(jds: DataFrame, candidates: DataFrame, variants_df: DataFrame) -> DataFrame:
    """Rule-scored work items.

    Texts are normalised on the side they belong to, before the joins. A document looks up its candidate on
    run_id and finds its keywords there once; the variants then meet it in one equi-join on (run_id, jd_id).
    """
    known = rules.with_jd_norms(jds).join(cand.with_match_texts(candidates), "run_id")
    items = variants.work_items(rules.with_candidate_hits(known), rules.with_variant_norms(variants_df))
    return rules.rule_evaluations(items)


def settled(judged: DataFrame, provider: str = judge.DETERMINISTIC, model: str = judge.HEURISTIC_MODEL) -> DataFrame:
    """Final scores and explanations of judged pairs."""
    return explain.with_explanation(judge.with_final_score(judge.settle_assessments(judged), provider, model))


def evaluate(jds: DataFrame, candidates: DataFrame, variants_df: DataFrame) -> DataFrame:
    """Evaluate all pairs with the built-in judge; every column the artifacts need is in the result."""
    return settled(judge.with_assessment(judge.with_review(scored_pairs(jds, candidates, variants_df))))


def scorecards(evaluations: DataFrame) -> DataFrame:
    return evaluations.select(*SCORECARD_COLUMNS)


def assessments(evaluations: DataFrame) -> DataFrame:
    kept = [c for c in judge.ASSESSMENT_COLUMNS if not c.startswith("assessment_")]
    return evaluations.filter("assessed").select(
        "run_id",
        "jd_index",
        "variant_ord",
        "jd_id",
        "variant_id",
        *kept,
        F.col("assessment_provider").alias("provider"),
        F.col("assessment_model").alias("model"),
    )


def whole_assessments(stored: DataFrame) -> DataFrame:
    """What a remote planner is told of an assessment, beside what planning itself reads; of repeated keys the last."""
    named = stored.withColumnsRenamed({"provider": "assessment_provider", "model": "assessment_model"})
    kept = [c for c in judge.ASSESSMENT_COLUMNS if c not in ("decision_rationale", "rewrite_opportunities", "must_fix_issues")]
    place = F.struct("jd_index", "variant_ord").alias("_at")
    return last_per_key(named.select(*PAIR, *kept, place), PAIR, "_at").drop("_at")


def ranked_best(evaluations: DataFrame) -> DataFrame:
    """Best row per document with its rank in the run."""
    return ranking.priority_ranks(ranking.best_per_jd(evaluations, PLAN_COLUMNS))


def strategies(evaluations: DataFrame) -> DataFrame:
    """Strategies with everything the report needs beside them."""
    return strategy.backfilled(strategy.planned(ranked_best(evaluations)))


def rejoined(
    cards: DataFrame,
    jds: DataFrame,
    candidates: DataFrame,
    variants_df: DataFrame,
    assessed: DataFrame,
    failed: DataFrame,
    explanations: DataFrame,
) -> DataFrame:
    """Evaluation rows put together again from stored artifacts, as input of ``strategies``.

    Of duplicate keys the last record counts. A scorecard without its document or variant is an
    error, found before planning.
    """
    documents = last_per_key(
        jds.select("run_id", "jd_id", "title", "company", "interview_focus_areas", F.col("jd_index").alias("_at")),
        ["run_id", "jd_id"], "_at",
    ).drop("_at")
    known_variants = last_per_key(
        variants_df.select("run_id", "variant_id", "variant_type", F.col("variant_ord").alias("_at")),
        ["run_id", "variant_id"], "_at",
    ).drop("_at")
    orphan = (
        cards.join(documents, ["run_id", "jd_id"], "left_anti")
        .select("jd_id", "variant_id")
        .unionByName(cards.join(known_variants, ["run_id", "variant_id"], "left_anti").select("jd_id", "variant_id"))
        .head(1)
    )
    if orphan:
        raise KeyError(f"scorecard of `{orphan[0]['jd_id']}` / `{orphan[0]['variant_id']}` has no document or variant")

    def newest(rows: DataFrame, columns: list[str]) -> DataFrame:
        place = F.struct("jd_index", "variant_ord").alias("_at")
        return last_per_key(rows.select(*PAIR, *columns, place), PAIR, "_at").drop("_at")

    judged = newest(assessed, ["decision_rationale", "rewrite_opportunities", "must_fix_issues"])
    errors = newest(failed, ["error_type", "error_message"])
    notes = newest(explanations, ["positive_signals", "dimension_reasons", "evidence_refs"])
    return (
        cards.join(documents, ["run_id", "jd_id"])
        .join(known_variants, ["run_id", "variant_id"])
        .join(candidates.select("run_id", "missing_evidence_areas"), "run_id")
        .join(judged.withColumn("assessed", F.lit(True)), PAIR, "left")
        .join(errors, PAIR, "left")
        .join(notes, PAIR)
        .withColumn("assessed", F.coalesce("assessed", F.lit(False)))
    )


def report_joined(plans: DataFrame, jds: DataFrame, cards: DataFrame, notes: DataFrame) -> DataFrame:
    """Strategies with title, company, scores and evidence, put together from separate tables.

    Of repeated keys the last record counts; a strategy without its document, scorecard or explanation is
    left out.
    """
    place = F.struct("jd_index", "variant_ord").alias("_at")

    def last(rows: DataFrame, columns: list[str]) -> DataFrame:
        named = rows.select(*PAIR, *columns, place)
        return last_per_key(named, PAIR, "_at").drop("_at").withColumnRenamed("variant_id", "recommended_variant_id")

    documents = last_per_key(
        jds.select("run_id", "jd_id", "title", "company", "jd_index"), ["run_id", "jd_id"], "jd_index"
    ).drop("jd_index")
    pair = ["run_id", "jd_id", "recommended_variant_id"]
    return (
        plans.join(documents, ["run_id", "jd_id"])
        .join(last(cards, ["final_overall_score", "overall_score", "final_decision_source"]), pair)
        .join(last(notes, ["evidence_refs"]), pair)
    )
