"""Typed record tables: schemas with defaults, JSON reading and writing."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.sources.artifacts import FILE, FOLDER, pretty, write_artifact
from matchloom.sources.paths import absolute, kind, literal, write_text

TEXTS = "ARRAY<STRING>"
GAP_ITEM = (
    "STRUCT<area: STRING, current_state: STRING, target_state: STRING, priority: STRING, "
    "catch_up_concepts: ARRAY<STRING>, weak_points: ARRAY<STRING>>"
)


def required(names: str, kind: str = "STRING") -> dict[str, tuple[str, Any]]:
    return {name: (kind, REQUIRED) for name in names.split()}


def optional(names: str, kind: str, default: Any) -> dict[str, tuple[str, Any]]:
    return {name: (kind, default) for name in names.split()}


REQUIRED = object()

# Column -> (type, default) of every record table, in file order.
RECORDS: dict[str, dict[str, tuple[str, Any]]] = {
    "jd_profiles": {
        **required("jd_id title company cluster"),
        **required("responsibilities requirements keywords", TEXTS),
        **required("seniority"),
        **required("bonuses risk_signals", TEXTS),
        **required("source_type source_value"),
        **optional("must_have_requirements nice_to_have_requirements hidden_signals interview_focus_areas", TEXTS, []),
        **optional("role_level_confidence", "DOUBLE", 0.0),
    },
    "candidate_profile": {
        **required("candidate_id base_resume_path"),
        **required("experiences projects skills industry_tags strengths constraints preferences", TEXTS),
        **optional("core_claims verified_evidence missing_evidence_areas preferred_role_tracks", TEXTS, []),
    },
    "resume_variants": {
        **required("variant_id variant_type cluster"),
        **required("target_jd_ids", TEXTS),
        **required("summary"),
        **required("emphasized_strengths stretch_points", TEXTS),
        **required("source_resume_path"),
    },
    "scorecards": {
        **required("jd_id variant_id"),
        **required(
            "fit_score ats_score evidence_score stretch_score gap_risk_score rewrite_cost_score overall_score", "DOUBLE"
        ),
        **required("ranking_version judge_rationale"),
        **optional(
            "llm_role_fit_score llm_evidence_score llm_persuasion_score llm_risk_score llm_overall_score "
            "final_overall_score", "DOUBLE", 0.0,
        ),
        **optional("final_decision_source", "STRING", "rules"),
        **optional("guardrail_flags", TEXTS, []),
        **optional("provider model", "STRING", ""),
    },
    "gap_maps": {**required("jd_id candidate_id"), **optional("items", f"ARRAY<{GAP_ITEM}>", [])},
    "ranking_explanations": {
        **required("jd_id variant_id ranking_version"),
        **required("dimension_reasons", "MAP<STRING, STRING>"),
        **optional("positive_signals risk_flags evidence_refs", TEXTS, []),
        **optional("decision_summary", "STRING", ""),
    },
    "llm_assessments": {
        **required("jd_id variant_id"),
        **required("role_fit evidence_quality persuasiveness interview_pressure_risk", "DOUBLE"),
        **required("application_worthiness"),
        **optional("must_fix_issues evidence_citations rewrite_opportunities", TEXTS, []),
        **optional("decision_rationale provider model", "STRING", ""),
    },
    "llm_failures": {
        **required("jd_id variant_id stage provider model error_type error_message"),
        **optional("raw_output_excerpt", "STRING", ""),
    },
    "eval_summary": {
        **required("jd_id title top_variant_id"),
        **required("gap_count", "BIGINT"),
        **optional("top_reasons", TEXTS, []),
    },
    "application_strategies": {
        **required("jd_id recommended_variant_id"),
        **required("priority_rank", "BIGINT"),
        **required("apply_decision reason_summary"),
        **required("needs_jd_specific_variant", "BOOLEAN"),
        **optional("decision_drivers watchouts recommended_actions catch_up_notes", TEXTS, []),
        **optional("decision_confidence", "DOUBLE", 0.0),
        **optional("interview_prep_points resume_revision_tasks", TEXTS, []),
    },
    "input_documents": {
        **required("role source_origin source_type source_value original_name relative_path"),
        **required("size_bytes", "BIGINT"),
        **required("media_type text extraction_status"),
        **optional("extraction_provider extraction_error", "STRING", ""),
    },
}
# Positions that order the records of a table; written along, read back when present.
ORDINALS = {
    "jd_profiles": ["jd_index"],
    "candidate_profile": [],
    "resume_variants": ["variant_ord"],
    "scorecards": ["jd_index", "variant_ord"],
    "gap_maps": ["jd_index"],
    "ranking_explanations": ["jd_index", "variant_ord"],
    "llm_assessments": ["jd_index", "variant_ord"],
    "llm_failures": ["jd_index", "variant_ord"],
    "eval_summary": ["jd_index"],
    "application_strategies": ["priority_rank"],
    "input_documents": ["input_ord"],
}


def schema(table: str) -> str:
    extra = [f"`{name}` BIGINT" for name in ORDINALS[table] if name not in RECORDS[table]]
    return ", ".join([f"`{name}` {type_}" for name, (type_, _) in RECORDS[table].items()] + extra)


def checked(rows: DataFrame, table: str) -> DataFrame:
    """Defaults filled in; a missing required value stops the job with its name."""

    def value(name: str, type_: str, default: Any) -> Column:
        if default is REQUIRED:
            problem = F.raise_error(F.lit(f"Missing required field `{name}` for `{table}`.")).cast(type_)
            return F.coalesce(F.col(name), problem)
        fallback = F.array() if isinstance(default, list) else F.lit(default)
        return F.coalesce(F.col(name), fallback.cast(type_))

    extra = [name for name in ORDINALS[table] if name not in RECORDS[table]]
    place = F.monotonically_increasing_id()
    return rows.select(
        *[value(name, type_, default).alias(name) for name, (type_, default) in RECORDS[table].items()],
        *[F.coalesce(F.col(name), place).alias(name) for name in extra],
    )


def read_records(spark: SparkSession, path: str, table: str, run_id: str, optional_file: bool = False) -> DataFrame:
    """Records of one artifact: a JSON array or object file, or a folder of JSON lines.

    Unknown fields are ignored. Records of a single file without positions keep their file order.
    """
    found = kind(path)
    if optional_file and found is None:
        rows = spark.createDataFrame([], schema(table))
    else:
        reader = spark.read.schema(schema(table))
        rows = (reader if found == FOLDER else reader.option("multiLine", "true")).json(literal(absolute(path)))
    return checked(rows, table).withColumn("run_id", F.lit(run_id))


def write_records(rows: DataFrame, path: str, table: str, single: bool = False, form: str = FILE) -> str:
    """Write an artifact as a folder of ordered JSON lines, or as one file with a JSON array.

    ``single`` writes the only record as a JSON object. The form is what the caller asks for, whatever the size.
    """
    extra = [name for name in ORDINALS[table] if name not in RECORDS[table]]
    shaped, whole = rows.select(*RECORDS[table], *extra), F.struct("*")
    if form == FOLDER:
        return write_artifact(shaped, F.to_json(whole, {"ignoreNullFields": "false"}), ORDINALS[table], path)
    if single:
        return write_artifact(shaped.limit(1), pretty(whole, ""), [], path, FILE)
    return write_artifact(shaped, pretty(whole), ORDINALS[table], path, FILE, "[\n", ",\n", "\n]")


def write_json(path: str, payload: Any) -> str:
    return write_text(path, json.dumps(payload, indent=2, ensure_ascii=False))


def write_table(rows: DataFrame, folder: str) -> DataFrame:
    """The scale-out form of an artifact: one Parquet table for all runs, read back.

    Rows are sorted by run inside each file, so reading one run skips most row groups. A folder
    per run would not do: there can be millions of small runs, and one that is most of the data.
    """
    rows.sortWithinPartitions("run_id").write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.parquet(folder)
