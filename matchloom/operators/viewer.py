"""Read-side views over the artifacts of many runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import naming as nm
from matchloom.functions import scoring as sc
from matchloom.functions import text as tx
from matchloom.operators.ordering import first_per_key, numbered

# The files that make a stage complete, in stage order.
STAGE_FILES = {
    "ingest": ("ingest/manifest.json",),
    "analyze": ("analyze/candidate_profile.json", "analyze/jd_profiles.json"),
    "generate": ("generate/resume_variants.json",),
    "evaluate": ("evaluate/scorecards.json", "evaluate/gap_maps.json", "evaluate/eval_summary.json"),
    "plan": ("plan/application_strategies.json",),
    "report": ("report/summary.md",),
}
DRAFT_FILE = "ingest/upload_manifest.json"
REQUIRED_FILES = [(path, stage) for stage, paths in STAGE_FILES.items() for path in paths]


def completed_stages(listing: DataFrame) -> DataFrame:
    """Completed stages of every run out of a file listing (run_id, artifact).

    Each known file is one bit, so a run aggregates to a single number on the map side, however
    many files or duplicates its listing has.
    """
    files = [path for path, _ in REQUIRED_FILES] + [DRAFT_FILE]
    bits = F.create_map(*[part for index, path in enumerate(files) for part in (F.lit(path), F.lit(1 << index))])
    seen = listing.groupBy("run_id").agg(
        F.coalesce(F.bit_or(F.try_element_at(bits, F.col("artifact"))), F.lit(0)).alias("_seen")
    )

    def done(stage: str) -> Column:
        mask = sum(1 << index for index, path in enumerate(files) if path in STAGE_FILES[stage])
        return F.when(F.col("_seen").bitwiseAND(F.lit(mask)) == mask, F.lit(stage))

    draft_bit = 1 << files.index(DRAFT_FILE)
    return seen.select(
        "run_id",
        F.array_compact(F.array(*[done(stage) for stage in STAGE_FILES])).alias("completed_stages"),
        (F.col("_seen").bitwiseAND(F.lit(draft_bit)) != 0).alias("has_draft"),
    )


def draft_status() -> Column:
    stages = F.col("completed_stages")
    return (
        F.when(F.array_contains(stages, "report"), F.lit("complete"))
        .when(F.size(stages) > 0, F.lit("running"))
        .when(F.col("has_draft"), F.lit("draft"))
        .otherwise(F.lit("ingest-ready"))
    )


def run_list(runs: DataFrame) -> DataFrame:
    """Runs with a ``position`` from the latest change to the earliest, ties by run id."""
    everywhere = runs.withColumn("_all", F.lit(0))
    order = [-F.unix_micros("last_modified"), F.col("run_id")]
    return numbered(everywhere, ["_all"], ["run_id"], order, "position", carry=True).drop("_all")


def run_totals(runs: DataFrame) -> DataFrame:
    """Number of runs, completed stages over all of them, and the stages of the latest run."""
    latest = F.max_by(F.struct("run_id", "completed_stages"), F.struct("last_modified", "run_id"))
    return runs.agg(
        F.count("*").alias("runs"),
        F.sum(F.size("completed_stages")).cast("long").alias("completed_stage_count"),
        latest.alias("_latest"),
    ).select(
        "runs",
        "completed_stage_count",
        F.col("_latest.run_id").alias("latest_run"),
        F.size("_latest.completed_stages").cast("long").alias("latest_completed"),
    )


def shown_score() -> Column:
    """Score shown to readers. Unlike the ranking, only a missing value falls through, zero is kept."""
    return F.coalesce("final_overall_score", "overall_score", F.lit(0.0))


def top_variants(summary: DataFrame, scorecards: DataFrame, jds: DataFrame, gaps: DataFrame) -> DataFrame:
    """Summary rows with score, display name and titles filled from the other artifacts."""
    cards = first_per_key(
        scorecards.select("run_id", "jd_id", F.col("variant_id").alias("top_variant_id"), "final_overall_score",
                          "overall_score", F.struct("jd_index", "variant_ord").alias("_ord")),
        ["run_id", "jd_id", "top_variant_id"], "_ord",
    ).drop("_ord")
    titles = jds.groupBy("run_id", "jd_id").agg(F.max_by("title", "jd_index").alias("jd_title"))
    counts = gaps.groupBy("run_id", "jd_id").agg(F.max_by(F.size("items"), "jd_index").alias("gap_items"))
    joined = (
        summary.join(cards, ["run_id", "jd_id", "top_variant_id"], "left")
        .join(titles, ["run_id", "jd_id"], "left")
        .join(counts, ["run_id", "jd_id"], "left")
    )
    return joined.select(
        "run_id",
        "jd_index",
        "jd_id",
        F.coalesce(F.nullif("title", F.lit("")), F.nullif("jd_title", F.lit("")), F.col("jd_id")).alias("title"),
        F.col("top_variant_id").alias("variant_id"),
        nm.variant_display_name(F.col("top_variant_id")).alias("variant_display_name"),
        shown_score().alias("score"),
        F.coalesce(F.col("gap_count"), F.col("gap_items"), F.lit(0)).cast("long").alias("gap_count"),
        F.coalesce("top_reasons", tx.no_texts()).alias("top_reasons"),
    )


def priority_matrix(tops: DataFrame, scorecards: DataFrame, explanations: DataFrame, strategies: DataFrame) -> DataFrame:
    """Matrix rows ordered by score within a run; the first matching artifact row counts."""
    pair = ["run_id", "jd_id", "variant_id"]
    place = F.struct("jd_index", "variant_ord").alias("_ord")
    dimensions = ["fit_score", "ats_score", "evidence_score", "stretch_score", "gap_risk_score", "rewrite_cost_score"]
    cards = first_per_key(scorecards.select(*pair, *dimensions, place), pair, "_ord").drop("_ord")
    notes = first_per_key(
        explanations.select(*pair, "positive_signals", "risk_flags", "evidence_refs", place), pair, "_ord"
    ).drop("_ord")
    plans = first_per_key(
        strategies.select("run_id", "jd_id", "apply_decision", "priority_rank"), ["run_id", "jd_id"], "priority_rank"
    )
    joined = tops.join(cards, pair, "left").join(notes, pair, "left").join(plans, ["run_id", "jd_id"], "left")
    placed = numbered(joined, ["run_id"], ["jd_index"], [-F.col("score"), F.col("jd_index")], "position", carry=True)
    return placed.withColumn("score_percent", sc.percent(F.col("score"))).withColumn(
        "signals", tx.or_default(F.coalesce("positive_signals", tx.no_texts()), F.col("top_reasons"))
    )


def report_summary(tops: DataFrame, strategies: DataFrame, explanations: DataFrame, gaps: DataFrame) -> DataFrame:
    """The three lists shown above a run's report, for its highest-scoring document."""
    best = tops.groupBy("run_id").agg(
        F.max_by(F.struct("jd_id", "variant_id", "title", "score", "top_reasons"), F.struct("score", -F.col("jd_index")))
        .alias("top")
    ).select("run_id", "top.*")
    plans = first_per_key(
        strategies.select(
            "run_id", "jd_id", "priority_rank", "apply_decision", "reason_summary", "decision_drivers",
            "catch_up_notes", "interview_prep_points", "recommended_actions",
        ),
        ["run_id", "jd_id"], "priority_rank",
    )
    notes = first_per_key(
        explanations.select(
            "run_id", "jd_id", "variant_id", "evidence_refs", "positive_signals", "risk_flags",
            F.struct("jd_index", "variant_ord").alias("_ord"),
        ),
        ["run_id", "jd_id", "variant_id"], "_ord",
    )
    first_gaps = first_per_key(gaps.select("run_id", "jd_id", "items", "jd_index"), ["run_id", "jd_id"], "jd_index")
    joined = (
        best.join(plans, ["run_id", "jd_id"], "left")
        .join(notes, ["run_id", "jd_id", "variant_id"], "left")
        .join(first_gaps.drop("jd_index"), ["run_id", "jd_id"], "left")
    )

    def listed(column: str) -> Column:
        return F.coalesce(F.col(column), tx.no_texts())

    advice = F.array_compact(
        F.array(
            F.concat(
                F.lit("优先投递 "), F.col("title"), F.lit("，综合得分 "), sc.percent(F.col("score")).cast("string"),
                F.lit("%。"),
            ),
            F.concat(F.lit("投递决策："), F.col("apply_decision"), F.lit("。"), F.col("reason_summary")),
        )
    )
    gap_texts = F.coalesce(
        F.flatten(F.transform("items", lambda item: F.concat(item["catch_up_concepts"], item["weak_points"]))),
        tx.no_texts(),
    )
    return joined.select(
        "run_id",
        tx.distinct_texts(advice).alias("recommendations"),
        tx.distinct_texts(
            listed("evidence_refs"), listed("positive_signals"), listed("decision_drivers"), listed("top_reasons")
        ).alias("evidence"),
        tx.distinct_texts(
            listed("catch_up_notes"), listed("interview_prep_points"), listed("recommended_actions"), gap_texts,
            listed("risk_flags"),
        ).alias("interview_prep"),
    )


def input_sources(manifest: DataFrame, drafts: DataFrame) -> DataFrame:
    """Input rows of every run: the ingest manifest if it lists any, else the uploaded draft files.

    ``position`` is the place in that list.
    """
    from_manifest = manifest.select(
        "run_id",
        F.coalesce("role", F.lit("cv")).alias("role"),
        F.coalesce("source_origin", F.lit("cli")).alias("source_origin"),
        F.coalesce(F.col("original_name"), nm.file_name(F.coalesce("source_value", F.lit("")))).alias("original_name"),
        F.coalesce("relative_path", "source_value", F.lit("")).alias("relative_path"),
        F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes"),
        F.coalesce("extraction_status", F.lit("unknown")).alias("extraction_status"),
        F.coalesce("extraction_error", F.lit("")).alias("extraction_error"),
        "position",
    )
    ingested = manifest.select("run_id").distinct()
    from_draft = drafts.join(ingested, "run_id", "left_anti").select(
        "run_id",
        "role",
        F.lit("upload").alias("source_origin"),
        "original_name",
        "relative_path",
        F.col("size_bytes").cast("long").alias("size_bytes"),
        F.lit("draft").alias("extraction_status"),
        F.lit("").alias("extraction_error"),
        "position",
    )
    return from_manifest.unionByName(from_draft).withColumn("shown_size", nm.byte_size(F.col("size_bytes")))
