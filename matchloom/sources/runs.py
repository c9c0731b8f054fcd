"""Listing of run directories and their artifacts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.config import load_config
from matchloom.functions import naming as nm
from matchloom.operators import viewer
from matchloom.session import durable
from matchloom.sources import listing
from matchloom.sources.paths import absolute, filesystem, kind, literal
from matchloom.sources.records import read_records
from matchloom.sources.uploads import read_upload_items

RUNS_DIR_VARIABLE = "MATCHLOOM_RUNS_DIR"
ROLES = ("analyzer", "generator", "judge", "planner")
CONFIG_SCHEMA = ", ".join(
    [f"{role} STRUCT<provider: STRING>" for role in ROLES]
    + ["run_metadata STRUCT<label: STRING>"]
)


def runs_dir(given: str | None = None) -> str:
    return given or os.environ.get(RUNS_DIR_VARIABLE) or os.path.join(os.getcwd(), "runs")


def run_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Run directories and when they changed: names and times only."""
    system, root = filesystem(spark, folder)
    found = [
        (status.getPath().getName(), status.getModificationTime())
        for status in system.listStatus(root)
        if status.isDirectory()
    ]
    return spark.createDataFrame(found, "run_id STRING, millis BIGINT").select(
        "run_id", F.timestamp_millis("millis").alias("last_modified")
    )


def run_files(spark: SparkSession, folder: str) -> DataFrame:
    """Names of all files of all runs (run_id, relative, path), listed by tasks and written once."""
    system, root = filesystem(spark, folder)
    base = system.resolvePath(root).toString()
    relative = F.regexp_replace(F.substring("path", len(base) + 1, 1 << 20), "^/+", "")
    names = listing.names_below(spark, base, every=True).select("path", relative.alias("_below"))
    parts = F.split("_below", "/", 2)
    return durable(names.filter(F.size(parts) == 2).select(parts[0].alias("run_id"), parts[1].alias("relative"), "path"))


def artifact_listing(files: DataFrame) -> DataFrame:
    """Artifacts of all runs (run_id, artifact); a table may be a folder of parts."""
    return files.select("run_id", F.regexp_extract("relative", "^([^/]+/[^/]+)", 1).alias("artifact"))


def _per_run(files: DataFrame, name: str, schema: str) -> DataFrame:
    """One small JSON file of every run that has it, opened by tasks; what is no JSON has null fields."""
    found = listing.opened(files.filter(F.col("relative") == name).select("run_id", "path"), {"content": "path"})
    return found.select("run_id", F.from_json(F.decode("content", "UTF-8"), schema).alias("_file")).select("run_id", "_file.*")


def list_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All runs with stages, providers, label and draft state, the latest first by ``position``.

    One listing serves stages, configurations and drafts; the driver makes one call, for the runs' times.
    """
    files = run_files(spark, folder)
    runs = run_folders(spark, folder).join(viewer.completed_stages(artifact_listing(files)), "run_id", "left")
    runs = runs.withColumns(
        {
            "completed_stages": F.coalesce("completed_stages", F.array().cast("array<string>")),
            "has_draft": F.coalesce("has_draft", F.lit(False)),
        }
    )
    configs = _per_run(files, "config/run_config.json", CONFIG_SCHEMA)
    drafts = _per_run(files, viewer.DRAFT_FILE, "label STRING")
    joined = runs.join(configs, "run_id", "left").join(drafts.withColumnRenamed("label", "_draft_label"), "run_id", "left")
    listed = joined.select(
        "run_id",
        "last_modified",
        "completed_stages",
        *[F.coalesce(F.col(role)["provider"], F.lit("unknown")).alias(f"{role}_provider") for role in ROLES],
        F.coalesce(F.nullif("run_metadata.label", F.lit("")), F.nullif("_draft_label", F.lit("")), F.lit("")).alias("label"),
        viewer.draft_status().alias("draft_status"),
    )
    return viewer.run_list(listed)


def load_run(spark: SparkSession, folder: str, run_id: str) -> dict[str, DataFrame]:
    """Tables of one run for a reader; what a stage has not written yet is an empty table.

    Beside the stored tables there are ``detail`` (one row: label, providers, completed stages, draft
    state), ``variants`` with display names, ``top_variants`` and ``input_sources`` in input order
    (``position``). A run without a configuration raises.
    """
    run_dir = os.path.join(folder, run_id)
    config = load_config(run_dir)
    places = {
        "candidate_profile": "analyze", "jd_profiles": "analyze", "resume_variants": "generate",
        "scorecards": "evaluate", "gap_maps": "evaluate", "ranking_explanations": "evaluate",
        "eval_summary": "evaluate", "application_strategies": "plan",
    }
    tables = {
        name: read_records(spark, os.path.join(run_dir, stage, f"{name}.json"), name, run_id, optional_file=True)
        for name, stage in places.items()
    }
    tables["detail"] = run_detail(spark, run_dir, run_id, config)
    tables["variants"] = tables["resume_variants"].withColumns(
        {
            "variant_display_name": nm.variant_display_name(F.col("variant_id")),
            "variant_type_display": nm.variant_type_label(F.col("variant_type")),
        }
    )
    tables["top_variants"] = viewer.top_variants(
        tables["eval_summary"], tables["scorecards"], tables["jd_profiles"], tables["gap_maps"]
    )
    uploaded = read_upload_items(spark, run_dir, run_id).select(
        "run_id", F.col("upload_role").alias("role"), F.col("upload_name").alias("original_name"),
        F.col("upload_path").alias("relative_path"), F.col("upload_size").alias("size_bytes"),
        F.col("upload_ord").alias("position"),
    )
    tables["input_sources"] = viewer.input_sources(ingested_items(spark, run_dir, run_id), uploaded)
    return tables


def run_detail(spark: SparkSession, run_dir: str, run_id: str, config: dict[str, dict[str, str]]) -> DataFrame:
    """Label, providers, completed stages and draft state of one run, from the names of its files."""
    known = [path for path, _ in viewer.REQUIRED_FILES] + [viewer.DRAFT_FILE]
    present = [(run_id, path) for path in known if kind(os.path.join(run_dir, path)) is not None]
    files = spark.createDataFrame(present, "run_id STRING, artifact STRING")
    facts = [(run_id, config["run_metadata"]["label"] or "", *(config[role]["provider"] for role in ROLES))]
    names = ", ".join(f"{role}_provider STRING" for role in ROLES)
    detail = spark.createDataFrame(facts, f"run_id STRING, label STRING, {names}")
    joined = detail.join(viewer.completed_stages(files), "run_id", "left").withColumns(
        {
            "completed_stages": F.coalesce("completed_stages", F.array().cast("array<string>")),
            "has_draft": F.coalesce("has_draft", F.lit(False)),
        }
    )
    return joined.withColumn("draft_status", viewer.draft_status())


def ingested_items(spark: SparkSession, run_dir: str, run_id: str) -> DataFrame:
    """Input rows of a run's ingest, without their texts, numbered as the manifest lists them."""
    names = ("role", "source_origin", "original_name", "relative_path", "source_value", "extraction_status", "extraction_error")
    fields = ", ".join(f"{name} STRING" for name in names) + ", size_bytes BIGINT"
    rows, parts = spark.createDataFrame([], fields + ", position BIGINT"), ("candidate_inputs", "jd_inputs")
    before = F.lit(0).cast("long")
    for part in parts:
        path = os.path.join(run_dir, "ingest", f"{part}.json")
        if kind(path) == "folder":
            table = spark.read.schema(fields + ", input_ord BIGINT").json(literal(absolute(path)))
            rows = rows.unionByName(table.withColumn("position", F.col("input_ord") + before).drop("input_ord"))
            before = F.coalesce(table.agg(F.max("input_ord")).scalar(), F.lit(0))
    manifest = os.path.join(run_dir, "ingest", "manifest.json")
    if kind(os.path.join(run_dir, "ingest", "jd_inputs.json")) != "folder" and kind(manifest) is not None:
        item = "STRUCT<" + fields.replace(" STRING", ": STRING").replace(" BIGINT", ": BIGINT") + ">"
        lists = spark.read.schema(", ".join(f"{part} ARRAY<{item}>" for part in parts)).option("multiLine", "true")
        both = F.concat(*[F.coalesce(name, F.array().cast(f"ARRAY<{item}>")) for name in parts])
        listed = lists.json(literal(absolute(manifest))).select(F.posexplode(both).alias("position", "item"))
        rows = listed.select("item.*", (F.col("position") + 1).cast("long").alias("position"))
    return rows.withColumn("run_id", F.lit(run_id))


def load_report(spark: SparkSession, folder: str, run_id: str) -> DataFrame | None:
    """Report lines of a run in order, or None when it has no report."""
    path = os.path.join(folder, run_id, "report", "summary.md")
    found, place = kind(path), literal(absolute(path))
    if found is None:
        return None
    if found == "file":
        return spark.read.text(place)
    blocks = spark.read.schema("rank BIGINT, block STRING").json(place)
    # A newline at the very end closes the last line and begins none.
    last = F.col("rank") == blocks.agg(F.max("rank")).scalar()
    text = F.when(last, F.regexp_replace("block", r"\n\z", "")).otherwise(F.col("block"))
    lines = blocks.select("rank", F.posexplode(F.split(text, "\n")).alias("line", "value"))
    return lines.orderBy("rank", "line").select("value")
