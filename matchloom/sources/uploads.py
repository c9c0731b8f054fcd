"""Uploaded inputs: manifest metadata, manifest items and new run drafts."""

from __future__ import annotations

import json
import os
import posixpath
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.config import default_config
from matchloom.functions import naming as nm
from matchloom.functions import text as tx
from matchloom.operators.ordering import last_per_key
from matchloom.sources.files import UNPARSEABLE
from matchloom.sources.paths import absolute, exists, literal, write_bytes, write_text

# Format version, place and error texts of upload drafts.
MANIFEST_VERSION = "v0.5.1-upload-manifest"
MANIFEST_PATH = "ingest/upload_manifest.json"
ERROR_TEXTS = {
    "missing_candidate_id": "Candidate id is required.",
    "missing_cv": "At least one CV file is required.",
    "missing_jd": "At least one JD file is required.",
    "empty_file": "File {name} is empty.",
    "file_too_large": "File {name} exceeds the 10MB limit.",
    "unsupported_file_type": "Unsupported file type: {extension}",
    "unsafe_filename": "Uploaded filename is invalid.",
    "run_exists": "Run already exists.",
    "write_failed": "Failed to create draft run.",
}
PROJECT_ROOT = str(Path(__file__).resolve().parents[2])


class DraftError(Exception):
    """A draft that cannot be created, with a stable ``code``."""

    def __init__(self, code: str, name: str = "") -> None:
        extension = os.path.splitext(name)[1].lower() or "none"
        super().__init__(ERROR_TEXTS[code].format(name=name, extension=extension))
        self.code = code


@dataclass(frozen=True)
class Upload:
    name: str
    content: bytes
    content_type: str = ""


def upload_items(manifests: DataFrame) -> DataFrame:
    """Upload metadata out of manifest texts (run_id, value), tolerant of every malformed part.

    The last entry of a path counts.
    """
    files = F.try_variant_get(F.try_parse_json("value"), "$.files", "array<variant>")
    exploded = manifests.select("run_id", F.posexplode(files).alias("_pos", "item"))

    def text(name: str) -> Column:
        return F.coalesce(F.try_variant_get("item", f"$.{name}", "string"), F.lit(""))

    stored = tx.strip(nm.slashed(text("storedRelativePath")))
    items = exploded.filter(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT"))).select(
        "run_id",
        nm.manifest_path(stored).alias("path_key"),
        text("role").alias("upload_role"),
        text("originalName").alias("upload_name"),
        stored.alias("upload_path"),
        F.coalesce(F.try_variant_get("item", "$.sizeBytes", "bigint"), F.lit(0)).alias("upload_size"),
        (F.col("_pos") + 1).cast("long").alias("upload_ord"),
    )
    return last_per_key(items.filter(F.col("upload_path") != ""), ["run_id", "path_key"], "upload_ord")


def read_upload_items(spark: SparkSession, run_dir: str, run_id: str) -> DataFrame:
    path = os.path.join(run_dir, MANIFEST_PATH)
    if not exists(path):
        empty = "run_id STRING, path_key STRING, upload_role STRING, upload_name STRING, upload_path STRING, upload_size BIGINT, upload_ord BIGINT"
        return spark.createDataFrame([], empty)
    return upload_items(spark.read.text(literal(absolute(path)), wholetext=True).select(F.lit(run_id).alias("run_id"), "value"))


def below(path: Column, folder: str) -> Column:
    """Path relative to ``folder``, null when it lies elsewhere."""
    prefix = folder.rstrip("/") + "/"
    return F.when(
        F.startswith(path, F.lit(prefix)), F.substring(path, F.lit(len(prefix) + 1), F.length(path))
    )


def manifest_items(documents: DataFrame, uploads: DataFrame, role: str, run_dir: str) -> DataFrame:
    """Manifest rows of documents: upload metadata overrides what the scan found."""
    resolved = F.col("resolved_path")
    in_run = below(resolved, absolute(run_dir).removeprefix("file://"))
    is_fixture = below(resolved, os.path.join(PROJECT_ROOT, "fixtures")).isNotNull()
    display = F.coalesce(
        F.when(is_fixture, below(resolved, PROJECT_ROOT)), in_run, below(resolved, os.getcwd()), F.col("source_value")
    )
    keyed = documents.withColumn("path_key", nm.manifest_path(F.coalesce(in_run, nm.slashed(F.col("source_value")))))
    joined = keyed.join(uploads, ["run_id", "path_key"], "left")
    uploaded = F.col("upload_path").isNotNull()
    return joined.select(
        "run_id",
        "input_ord",
        F.coalesce(F.col("upload_role"), F.lit(role)).alias("role"),
        F.when(uploaded, F.lit("upload")).when(is_fixture, F.lit("fixture")).otherwise(F.lit("cli")).alias("source_origin"),
        "source_type",
        "source_value",
        F.coalesce("upload_name", "original_name").alias("original_name"),
        F.coalesce(F.col("upload_path"), display).alias("relative_path"),
        F.coalesce("upload_size", "size_bytes").alias("size_bytes"),
        "media_type",
        "text",
        "extraction_status",
        "extraction_provider",
        "extraction_error",
    )


def input_warnings(items: DataFrame) -> DataFrame:
    return items.filter(F.col("extraction_status") == UNPARSEABLE).select(
        "run_id", "input_ord", "role", "relative_path", "original_name", "extraction_error"
    )


def validate_uploads(uploads: DataFrame) -> DataFrame:
    """Error code per upload row (name, size_bytes); null for acceptable ones."""
    return uploads.withColumn("error_code", nm.upload_error(F.col("name"), F.col("size_bytes")))


def create_draft(
    spark: SparkSession,
    runs_dir: str,
    candidate_id: str,
    cvs: Sequence[Upload],
    jds: Sequence[Upload],
    label: str = "",
    now: datetime | None = None,
    program: str = "python -m matchloom",
) -> dict[str, str]:
    """Store one upload as a draft run and say how to run it. Never runs the pipeline."""
    candidate_id, label = candidate_id.strip(), label.strip()
    for missing, code in ((not candidate_id, "missing_candidate_id"), (not cvs, "missing_cv"), (not jds, "missing_jd")):
        if missing:
            raise DraftError(code)
    uploads = [("cv", upload) for upload in cvs] + [("jd", upload) for upload in jds]
    moment = (now or datetime.now(UTC)).astimezone(UTC)
    rows = [(at, role, upload.name, len(upload.content)) for at, (role, upload) in enumerate(uploads)]
    checked = (
        validate_uploads(spark.createDataFrame(rows, "at INT, role STRING, name STRING, size_bytes BIGINT"))
        .withColumn("stored", nm.stored_name(F.col("name")))
        .withColumn(
            "run_id",
            nm.run_identifier(F.lit(label or candidate_id), F.lit(moment.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")),
        )
        .withColumn("command", nm.next_command(F.col("run_id"), F.lit(candidate_id), program))
        .orderBy("at")
        .collect()  # one row per file of a single form post
    )
    for row in checked:
        if row["error_code"] is not None:
            raise DraftError(row["error_code"], row["name"])
    run_id, command = checked[0]["run_id"], checked[0]["command"]
    run_dir = os.path.join(runs_dir, run_id)
    if exists(run_dir):
        raise DraftError("run_exists")
    stamp = moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}Z"
    try:
        files = []
        for row, (role, upload) in zip(checked, uploads, strict=True):
            stored = f"input_files/{role}/{row['stored']}"
            write_bytes(_inside(run_dir, stored), upload.content)
            files.append(
                {
                    "role": role,
                    "originalName": upload.name,
                    "storedRelativePath": stored,
                    "sizeBytes": len(upload.content),
                    "contentType": upload.content_type or "application/octet-stream",
                    "uploadedAt": stamp,
                }
            )
        manifest = {
            "schemaVersion": MANIFEST_VERSION,
            "candidateId": candidate_id,
            "label": label,
            "createdAt": stamp,
            "files": files,
            "nextCommand": command,
        }
        config = default_config()
        config["run_metadata"]["label"] = label
        for place, content in (("config/run_config.json", config), (MANIFEST_PATH, manifest)):
            write_text(os.path.join(run_dir, place), json.dumps(content, indent=2, ensure_ascii=False))
    except OSError as error:
        raise DraftError("write_failed") from error
    return {"runId": run_id, "status": "draft", "uploadManifestPath": MANIFEST_PATH, "nextCommand": command}


def _inside(folder: str, relative: str) -> str:
    """``relative`` below ``folder``; what leads out of it is refused."""
    place = posixpath.normpath(relative)
    if posixpath.isabs(place) or place.split("/")[0] == "..":
        raise DraftError("unsafe_filename")
    return f"{folder.rstrip('/')}/{place}"
