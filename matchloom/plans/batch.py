"""Many runs at once: the same stages over tables of all runs, with Parquet between them.

This is the path for large data. A stage boundary is a table, so texts are parsed once, later
stages read only the columns they use, and a lost executor rereads files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.config import Endpoint
from matchloom.operators import candidate as cand
from matchloom.operators import evidence_map, explain, judge, parse, ranking, remote, report, strategy, variants
from matchloom.plans import run, stages
from matchloom.sources import files
from matchloom.sources.records import write_table

#: Names that a run's problems call its inputs by.
ROLES = {"cv": "CV", "jd": "JD"}


def ingest_batch(
    spark: SparkSession, root: str, folder: str, extractors: files.Extractors | None = None, whole_text: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resumes and JD inputs of all runs below ``root`` (``<run>/cv/...``, ``<run>/jd/...``), and the runs left out.

    A run without a usable text of either kind does not stop the others: it is a row of ``rejected``. Resumes
    have their bullets (``experiences``); a remote analyzer needs the ``whole_text`` beside them.
    """
    documents = write_table(files.collect_runs(spark, root, extractors), os.path.join(folder, "inputs"))
    documents = documents.filter(F.col("role").isin(*ROLES))
    labels = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    found = files.text_problems(documents, ["run_id", "role"], labels[F.col("role")])
    by_role = found.groupBy("run_id").agg(
        *[F.max(F.when(F.col("role") == role, F.struct("n_inputs", "problem"))).alias(role) for role in ROLES]
    )
    missing = [
        F.when(F.col(role).isNull(), F.lit(f"At least one {label} input is required for ingest.")).otherwise(F.col(f"{role}.problem"))
        for role, label in ROLES.items()
    ]
    rejected = by_role.select("run_id", F.coalesce(*missing).alias("problem")).filter(F.col("problem").isNotNull())
    rejected = write_table(rejected, os.path.join(folder, "rejected"))
    usable = documents.join(rejected, "run_id", "left_anti")
    cvs = usable.filter("role = 'cv'")
    first = cvs.groupBy("run_id").agg(F.min_by("source_value", "input_ord").alias("base_resume_path"))
    resumes = cand.experiences(cvs).join(first, "run_id").withColumn("candidate_id", F.col("run_id"))
    if whole_text:
        resumes = resumes.join(cand.joined_text(cvs), "run_id")
    inputs = usable.filter("role = 'jd'").select(
        "run_id", "input_ord", "source_type", "source_value", F.col("text").alias("content")
    )
    return resumes, inputs, rejected


def run_batch(
    resumes: DataFrame,
    jd_inputs: DataFrame,
    folder: str,
    endpoints: dict[str, Endpoint | None] | None = None,
    transport: remote.Transport = remote.post_json,
) -> dict[str, DataFrame]:
    """All stages for all runs; returns the tables it wrote.

    ``resumes`` has one row per run (run_id, candidate_id, base_resume_path, and resume_text or experiences),
    ``jd_inputs`` any number (run_id, input_ord, source_type, source_value, content). ``endpoints`` names
    the remote providers by role (analyzer, generator, judge, planner); the others are built in. Replies
    are logged below ``folder``, so a batch that is run again asks only for what is missing.
    """
    tables: dict[str, DataFrame] = {}
    given = endpoints or {}

    def stored(name: str, rows: DataFrame) -> DataFrame:
        tables[name] = write_table(rows, os.path.join(folder, name))
        return tables[name]

    def log(name: str) -> str:
        return os.path.join(folder, "replies", name)

    people, evidence = cand.candidate_profiles(resumes), evidence_map.made
    documents = parse.jd_profiles(parse.number_blocks(jd_inputs))
    if given.get("analyzer"):
        texts = jd_inputs.withColumnRenamed("content", "text")
        people, documents, evidence = run.remote_profiles(
            resumes, texts, people, documents, given["analyzer"], transport, log("analyze")
        )
    people, documents = stored("candidates", people), stored("jd_profiles", documents)
    evidence = stored("evidence_map", evidence(people, documents))
    made = variants.jd_variants(documents, cand.with_match_texts(people))
    if given.get("generator"):
        made = run.told_summaries(made, documents, people, given["generator"], transport, log("generate"))
    made = stored("resume_variants", made)
    pairs = judge.with_review(stages.scored_pairs(documents, people, made))
    provider, model = judge.DETERMINISTIC, judge.HEURISTIC_MODEL
    if given.get("judge"):
        provider, model = given["judge"].provider, given["judge"].model
        judged = remote.remote_assessments(pairs, evidence, given["judge"], transport, log("evaluate"))
    else:
        judged = judge.with_assessment(pairs)
    columns = [*stages.SCORECARD_COLUMNS, *stages.PLAN_COLUMNS, *judge.ASSESSMENT_COLUMNS, *explain.EXPLANATION_COLUMNS]
    rows = stored("evaluations", stages.settled(judged, provider, model).select(*dict.fromkeys([*columns, "gaps"])))
    stored("gap_maps", ranking.gap_maps(documents, people, rows))
    stored("eval_summary", ranking.eval_summary(rows))
    assessed = stored("llm_assessments", stages.assessments(rows))
    stored("llm_failures", judge.failure_rows(rows))
    stored("ranking_explanations", explain.explanation_rows(rows))
    ranked = strategy.planned(stages.ranked_best(rows))
    if given.get("planner"):
        asked = ranked.join(stages.whole_assessments(assessed), stages.PAIR, "left")
        ranked = remote.remote_strategies(asked, given["planner"], transport, log("plan"))
    plans = stored("strategies", strategy.backfilled(ranked))
    stored("reports", report.report_blocks(plans))
    return tables


def report_text(reports: DataFrame, run_id: str) -> DataFrame:
    """Report blocks of one run in rank order, to be written as text."""
    return reports.filter(F.col("run_id") == run_id).orderBy("priority_rank").select("block")
