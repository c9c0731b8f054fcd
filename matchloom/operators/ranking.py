"""Best variant per document and the ranking of documents within a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import scoring as sc
from matchloom.operators.ordering import numbered


def ranking_score() -> Column:
    return sc.score_or_else(F.col("final_overall_score"), F.col("overall_score"))


def with_ranking_key(scorecards: DataFrame) -> DataFrame:
    """Add the sortable key: higher is better; earlier rows win ties by the negated positions."""
    return scorecards.withColumn(
        "ranking_key",
        F.struct(
            ranking_score().alias("final"),
            F.col("fit_score").alias("fit"),
            F.col("evidence_score").alias("evidence"),
            (-F.col("gap_risk_score")).alias("risk"),
            (-F.col("jd_index")).alias("jd_first"),
            (-F.col("variant_ord")).alias("variant_first"),
        ),
    )


def best_per_group(scorecards: DataFrame, keys: list[str], columns: list[str], by: Column, name: str) -> DataFrame:
    """Winning row of every group as a struct. Combines map-side: a hot group costs one row per task."""
    return scorecards.groupBy(*keys).agg(F.max_by(F.struct(*columns), by).alias(name))


def best_per_jd(scorecards: DataFrame, columns: list[str]) -> DataFrame:
    """Best row per ``jd_id`` by the ranking key, plus where the document first appears."""
    keyed = with_ranking_key(scorecards)
    keep = [column for column in columns if column not in ("run_id", "jd_id")]
    grouped = keyed.groupBy("run_id", "jd_id").agg(
        F.max_by(F.struct(*keep, "ranking_key"), F.col("ranking_key")).alias("best"),
        F.min("jd_index").alias("first_index"),
    )
    return grouped.select("run_id", "jd_id", "best.*", "first_index")


def priority_ranks(best: DataFrame) -> DataFrame:
    """Rank the best rows of a run from high to low; ties keep the input order."""
    key = F.col("ranking_key")
    order = [-key["final"], -key["fit"], -key["evidence"], -key["risk"], F.col("first_index")]
    return numbered(best, ["run_id"], ["jd_id"], order, "priority_rank", carry=True)


def gap_maps(jds: DataFrame, candidates: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Gaps of the variant with the best rule score, for every document, empty when it has none."""
    best = best_per_group(
        evaluations,
        ["run_id", "jd_index"],
        ["gaps"],
        F.struct("overall_score", -F.col("variant_ord")),
        "best_gap",
    )
    named = jds.select("run_id", "jd_index", "jd_id").join(candidates.select("run_id", "candidate_id"), "run_id")
    return named.join(best, ["run_id", "jd_index"], "left").select(
        "run_id",
        "jd_index",
        "jd_id",
        "candidate_id",
        F.coalesce(F.col("best_gap.gaps"), F.array().cast(evaluations.schema["gaps"].dataType)).alias("items"),
    )


def eval_summary(evaluations: DataFrame) -> DataFrame:
    """Per document: the variant with the best ranking key, and the gap count of the best rule score."""
    keyed = with_ranking_key(evaluations)
    grouped = keyed.groupBy("run_id", "jd_index").agg(
        F.max_by(
            F.struct("jd_id", "title", "variant_id", "positive_signals", "decision_summary"), F.col("ranking_key")
        ).alias("top"),
        F.max_by(F.size("gaps"), F.struct("overall_score", -F.col("variant_ord"))).cast("long").alias("gap_count"),
    )
    signals = F.slice("top.positive_signals", 1, 2)
    return grouped.select(
        "run_id",
        "jd_index",
        "top.jd_id",
        "top.title",
        F.col("top.variant_id").alias("top_variant_id"),
        "gap_count",
        F.when(F.size(signals) > 0, signals).otherwise(F.array("top.decision_summary")).alias("top_reasons"),
    )
