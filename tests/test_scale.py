"""Hot keys, many runs in one plan, and what the plans look like."""

import re

import pytest
from pyspark.sql import functions as F

from matchloom.operators import candidate, parse, variants
from matchloom.plans import adapters, batch, match_queries, queries, stages
from matchloom.session import split_hot_keys
from matchloom.sources import files
from test_run import BATCH, RESUME

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def small_limits(spark):
    names = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_hot_document_is_split_and_stays_whole(spark, small_limits):
    split_hot_keys(spark)
    jds = spark.range(40).select(F.lit("r").alias("run_id"), F.col("id").alias("jd_index"), F.format_string("jd-%d", "id").alias("jd_id"))
    target = F.when(F.col("id") % 10 < 7, F.lit("jd-0")).otherwise(F.format_string("jd-%d", F.col("id") % 40))
    made = spark.range(0, 40_000, 1, 8).select(
        F.lit("r").alias("run_id"), F.col("id").alias("variant_ord"), F.array(target).alias("target_jd_ids"),
        F.sha2(F.col("id").cast("string"), 512).alias("summary"),
    )
    items = variants.work_items(jds, made)
    best = items.groupBy("run_id", "jd_id").agg(F.count("*").alias("n"), F.max("variant_ord").alias("last"))
    rows = {row["jd_id"]: row["n"] for row in best.collect()}
    assert sum(rows.values()) == 40_000
    assert rows["jd-0"] >= 28_000
    assert "skew=true" in best._jdf.queryExecution().executedPlan().toString()


def test_batch_of_runs_equals_single_runs(spark, tmp_path):
    people = spark.createDataFrame(
        [("r1", "cand-001", "resume.md", RESUME), ("r2", "cand-002", "two.md", "- Python tool owner\n- ranking work")],
        "run_id STRING, candidate_id STRING, base_resume_path STRING, resume_text STRING",
    )
    inputs = spark.createDataFrame(
        [("r1", 1, "file", "b.txt", BATCH), ("r2", 1, "file", "b.txt", BATCH), ("r2", 2, "file", "c.txt", "Title: T\nBody:\n- llm")],
        "run_id STRING, input_ord BIGINT, source_type STRING, source_value STRING, content STRING",
    )
    tables = batch.run_batch(people, inputs, str(tmp_path))
    plans = {(r["run_id"], r["jd_id"]): r for r in tables["strategies"].collect()}
    assert len(plans) == 5
    first = plans["r1", "jd-001"]
    assert (first["priority_rank"], first["apply_decision"], first["decision_confidence"]) == (1, "apply", 0.89)
    assert plans["r1", "jd-002"]["priority_rank"] == 2
    assert sorted(p["priority_rank"] for key, p in plans.items() if key[0] == "r2") == [1, 2, 3]
    text = [row["block"] for row in batch.report_text(tables["reports"], "r1").collect()]
    assert [block.split("\n")[0] for block in text] == [
        "### 1. LLM Product Engineer @ Example AI", "### 2. Applied AI Engineer @ Workflow Labs",
    ]
    gaps = {(r["run_id"], r["jd_id"]): len(r["items"]) for r in tables["gap_maps"].collect()}
    assert gaps["r1", "jd-001"] == 1


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_evaluation_has_no_python_cross_join_or_nested_loop(spark):
    plan = plan_of(match_queries.evaluated(spark, FOLDER))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert word not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(queries.QUERIES["jd_cluster"](spark, FOLDER))
    assert "n_chars" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_best_and_summary_aggregate_before_they_shuffle(spark):
    plan = plan_of(stages.ranking.best_per_jd(adapters.event_scorecards(spark, FOLDER), ["variant_id"]))
    assert "partial_max_by" in plan
    assert plan.index("partial_max_by") > plan.index("Exchange hashpartitioning")


def test_every_query_has_rows_and_unique_columns(spark):
    for name in ("priority_rank", "scan_files", "manifest_items", "guardrails"):
        frame = queries.QUERIES[name](spark, FOLDER)
        assert len(set(frame.columns)) == len(frame.columns)
        assert frame.head(1)


def test_scan_shuffles_names_and_opens_files_last(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"a{i}.txt").write_text(f"text {i}")
    plan = plan_of(files.collect_documents(spark, [str(tmp_path)], "r"))
    assert plan.index("MapInArrow") < plan.index("Exchange")
    assert not [line for line in plan.split("\n") if "Exchange" in line and ("content" in line or "sidecar#" in line)]


def above(plan, mark):
    """Operators between the lowest one with ``mark`` and the root; expressions may break lines, operators do not."""
    nodes = [line for line in plan.split("\n") if re.match(r"[ :]*[+:]- |[A-Z]", line)]
    depth = lambda line: line.find("- ") if re.match(r"[ :]*[+:]- ", line) else -1
    at = max(i for i, line in enumerate(nodes) if mark in line)
    out, low = [], depth(nodes[at])
    for line in reversed(nodes[:at]):
        if depth(line) < low:
            out, low = [*out, line[depth(line) + 2 :].strip()], depth(line)
    return out


def test_numbers_reach_texts_without_a_shuffle(spark):
    rows = adapters.table(spark, FOLDER, "documents").select(
        F.col("lang").alias("run_id"), F.col("doc_id").alias("input_ord"), F.lit("file").alias("source_type"),
        F.lit("x").alias("source_value"), F.col("text").alias("content"),
    )
    for plan in (plan_of(parse.number_blocks(rows)), plan_of(candidate.text_pieces(rows.withColumnRenamed("content", "text")))):
        way = above(plan, ",text#")
        assert any(step.startswith("BroadcastHashJoin") for step in way)
        assert not any("Exchange" in step or "SortMergeJoin" in step for step in way)
        assert "ExistingRDD" not in plan  # no checkpoint
