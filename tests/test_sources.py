"""Scans, extraction, upload metadata, drafts, record tables and run listings."""

import json
import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from matchloom import config
from matchloom.operators import viewer
from matchloom.sources import files, records, runs, uploads
from matchloom.sources.uploads import DraftError, Upload


def put(folder, **named):
    for name, content in named.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
    return str(folder)


def collected(spark, sources, tools=None):
    rows = files.collect_documents(spark, sources, "r", tools).collect()
    return sorted(rows, key=lambda row: row["input_ord"])


def test_directory_scan_order_and_filters(spark, tmp_path):
    folder = put(
        tmp_path / "in",
        **{
            "b.txt": "bee", "a.md": "# a", "sub/c.markdown": "sea", "_notes.md": "kept", ".hidden/x.md": "no",
            "node_modules/y.md": "no", "build/z.txt": "no", "pic.png": b"img", "pic.txt": "side", "data.csv": "no",
            "_sub/d.txt": "kept too",
        },
    )
    tools = files.Extractors(ocr_provider="disabled")
    rows = collected(spark, [folder], tools)
    assert [os.path.relpath(row["source_value"], folder) for row in rows] == [
        "_notes.md", "_sub/d.txt", "a.md", "b.txt", "pic.png", "sub/c.markdown",
    ]
    assert [row["input_ord"] for row in rows] == [1, 2, 3, 4, 5, 6]
    image = rows[4]
    assert (image["text"], image["extraction_status"], image["media_type"]) == ("side", "sidecar", "image/png")
    assert image["extraction_error"] == "ocr: OCR provider is disabled.; vision: Vision fallback is disabled."
    assert rows[2]["media_type"] == "text/markdown" and rows[3]["media_type"] == "text/plain"
    assert rows[3]["size_bytes"] == 3


def test_sources_keep_argument_order(spark, tmp_path):
    second = put(tmp_path / "one", **{"z.txt": "last"})
    put(tmp_path, **{"first.md": "line\r\nbreak"})
    rows = collected(spark, [str(tmp_path / "first.md"), second])
    assert [row["text"] for row in rows] == ["line\nbreak", "last"]


def test_pattern_characters_in_paths_are_plain(spark, tmp_path):
    folder = put(tmp_path / "in [1] {x}", **{"a b#1%20.md": "text", "_u [2].txt": "under"})
    rows = collected(spark, [folder + "/."])
    assert [(row["original_name"], row["text"]) for row in rows] == [("_u [2].txt", "under"), ("a b#1%20.md", "text")]
    assert rows[1]["source_value"] == f"{folder}/a b#1%20.md"


def test_single_image_finds_its_sidecar(spark, tmp_path):
    put(tmp_path, **{"jd.png": b"x", "jd.txt": "from text", "jd.md": "from markdown"})
    row = collected(spark, [str(tmp_path / "jd.png")], files.Extractors())[0]
    assert (row["text"], row["extraction_provider"]) == ("from text", "sidecar")
    assert "Tesseract OCR requires" in row["extraction_error"]


@pytest.mark.parametrize(
    ("name", "message"), [("none.txt", "does not exist"), ("x.csv", "Unsupported input type"), ("empty", "does not contain")]
)
def test_bad_sources_raise(spark, tmp_path, name, message):
    (tmp_path / "x.csv").write_text("a")
    (tmp_path / "empty").mkdir()
    with pytest.raises(files.InputExtractionError, match=message):
        files.collect_documents(spark, [str(tmp_path / name)], "r")


def test_pdf_literals_and_failures(spark, tmp_path):
    put(tmp_path, **{"a.pdf": rb"BT (Hello \(you) Tj (World)  Tj ET", "b.pdf": b"%PDF nothing"})
    good, bad = collected(spark, [str(tmp_path)])
    assert good["text"] == "you\nWorld" and good["extraction_status"] == "extracted"
    assert bad["extraction_status"] == "unparseable" and "did not contain extractable text" in bad["extraction_error"]
    tools = files.Extractors(pdf=lambda data: "read by tool")
    assert collected(spark, [str(tmp_path / "b.pdf")], tools)[0]["text"] == "read by tool"


def test_image_cascade(spark, tmp_path):
    put(tmp_path, **{"a.jpg": b"ocr", "b.jpg": b"vision", "c.jpg": b"neither"})

    def ocr(data, languages):
        return f"text {languages}" if data == b"ocr" else " "

    def vision(data, media, error):
        if data == b"neither":
            raise RuntimeError("vision down")
        return f"{media} after {error}"

    tools = files.Extractors(ocr=ocr, vision=vision, vision_provider="openai_vision", ocr_languages="eng")
    first, second, third = collected(spark, [str(tmp_path)], tools)
    assert (first["text"], first["extraction_status"]) == ("text eng", "ocr")
    assert second["text"] == "image/jpeg after OCR returned empty text."
    assert (second["extraction_status"], second["extraction_error"]) == ("vision", "ocr: OCR returned empty text.")
    assert third["extraction_status"] == "unparseable"
    assert "OCR error: OCR returned empty text.. Vision fallback error: vision down." in third["extraction_error"]


def test_text_that_is_no_utf8_stops(spark, tmp_path):
    put(tmp_path, **{"a.txt": b"\xff\xfe\xff"})
    with pytest.raises(Exception, match="(?i)malformed|utf"):
        collected(spark, [str(tmp_path / "a.txt")])


def test_upload_metadata_overrides_scan(spark, tmp_path):
    run_dir = tmp_path / "run"
    put(run_dir, **{"input_files/cv/resume.md": "- x", "input_files/cv/other.md": "- y"})
    manifest = {
        "files": [
            {"storedRelativePath": "input_files/cv/resume.md", "originalName": "old"},
            {"role": "cv", "storedRelativePath": "./input_files\\cv\\resume.md", "originalName": "Original Resume.md", "sizeBytes": 26},
            "junk", {"storedRelativePath": " "},
        ]
    }
    put(run_dir, **{"ingest/upload_manifest.json": json.dumps(manifest)})
    documents = files.collect_documents(spark, [str(run_dir / "input_files" / "cv")], "r")
    items = uploads.manifest_items(documents, uploads.read_upload_items(spark, str(run_dir), "r"), "cv", str(run_dir))
    by_name = {row["original_name"]: row for row in items.collect()}
    uploaded, scanned = by_name["Original Resume.md"], by_name["other.md"]
    assert (uploaded["size_bytes"], uploaded["source_origin"]) == (26, "upload")
    assert (scanned["source_origin"], scanned["relative_path"]) == ("cli", "input_files/cv/other.md")


@pytest.mark.parametrize("content", ["[]", "{}", '{"files": 3}', "not json"])
def test_malformed_upload_manifest_has_no_items(spark, tmp_path, content):
    put(tmp_path, **{"ingest/upload_manifest.json": content})
    assert uploads.read_upload_items(spark, str(tmp_path), "r").count() == 0


NOW = datetime(2026, 4, 25, 8, 30, tzinfo=UTC)


def draft(spark, folder, **changes):
    given = {"candidate_id": "cand-001", "cvs": [Upload("resume.md", b"resume text", "text/markdown")],
             "jds": [Upload("jd.txt", b"jd text")], "label": "April upload", "now": NOW}
    return uploads.create_draft(spark, str(folder), **{**given, **changes})


def test_draft_files_and_manifest(spark, tmp_path):
    made = draft(spark, tmp_path)
    assert made["runId"] == "april-upload-20260425-083000"
    assert "--cv ./runs/april-upload-20260425-083000/input_files/cv" in made["nextCommand"]
    run_dir = tmp_path / made["runId"]
    text = (run_dir / "ingest" / "upload_manifest.json").read_text()
    manifest = json.loads(text)
    assert "resume text" not in text
    assert manifest["createdAt"] == "2026-04-25T08:30:00.000Z"
    assert [(f["role"], f["storedRelativePath"], f["sizeBytes"]) for f in manifest["files"]] == [
        ("cv", "input_files/cv/resume.md", 11), ("jd", "input_files/jd/jd.txt", 7),
    ]
    assert manifest["files"][1]["contentType"] == "application/octet-stream"
    assert (run_dir / "input_files" / "cv" / "resume.md").read_bytes() == b"resume text"
    assert config.load_config(str(run_dir))["run_metadata"]["label"] == "April upload"


@pytest.mark.parametrize(
    ("changes", "code"),
    [
        ({"candidate_id": " "}, "missing_candidate_id"),
        ({"cvs": []}, "missing_cv"),
        ({"jds": []}, "missing_jd"),
        ({"cvs": [Upload("../resume.md", b"x")]}, "unsafe_filename"),
        ({"cvs": [Upload("resume.exe", b"x")]}, "unsupported_file_type"),
        ({"cvs": [Upload("resume.md", b"")]}, "empty_file"),
    ],
)
def test_draft_errors(spark, tmp_path, changes, code):
    with pytest.raises(DraftError) as caught:
        draft(spark, tmp_path, **changes)
    assert caught.value.code == code


def test_draft_of_the_same_name_exists(spark, tmp_path):
    draft(spark, tmp_path)
    with pytest.raises(DraftError) as caught:
        draft(spark, tmp_path)
    assert caught.value.code == "run_exists"


def test_run_list(spark, tmp_path):
    draft(spark, tmp_path)
    put(
        tmp_path / "demo",
        **{
            "config/run_config.json": json.dumps({"judge": {"provider": "deterministic"}, "run_metadata": {"label": "demo-run"}}),
            "ingest/manifest.json": "{}", "analyze/candidate_profile.json": "{}", "analyze/jd_profiles.json": "[]",
        },
    )
    (tmp_path / "bare").mkdir()
    rows = {row["run_id"]: row for row in runs.list_runs(spark, str(tmp_path)).collect()}
    assert rows["demo"]["completed_stages"] == ["ingest", "analyze"]
    assert (rows["demo"]["label"], rows["demo"]["judge_provider"], rows["demo"]["planner_provider"]) == ("demo-run", "deterministic", "unknown")
    assert rows["demo"]["draft_status"] == "running"
    uploaded = rows["april-upload-20260425-083000"]
    assert (uploaded["draft_status"], uploaded["label"]) == ("draft", "April upload")
    assert rows["bare"]["draft_status"] == "ingest-ready"
    assert sorted(row["position"] for row in rows.values()) == [1, 2, 3]


def test_records_fill_defaults_and_name_what_is_missing(spark, tmp_path):
    card = {name: 0.5 for name in records.RECORDS["scorecards"] if name.endswith("_score") and not name.startswith(("llm", "final"))}
    card |= {"jd_id": "a", "variant_id": "v", "ranking_version": "1", "judge_rationale": "r", "unknown": 1}
    path = tmp_path / "scorecards.json"
    path.write_text(json.dumps([card]))
    row = records.read_records(spark, str(path), "scorecards", "r").head()
    assert (row["final_overall_score"], row["final_decision_source"], row["guardrail_flags"]) == (0.0, "rules", [])
    path.write_text(json.dumps([{key: value for key, value in card.items() if key != "judge_rationale"}]))
    with pytest.raises(Exception, match="Missing required field `judge_rationale`"):
        records.read_records(spark, str(path), "scorecards", "r").collect()


@pytest.mark.parametrize("form", ["folder", "file"])
def test_records_of_both_forms_are_read_back(spark, tmp_path, form):
    rows = spark.range(12).select(
        F.lit("r").alias("run_id"), F.col("id").alias("jd_index"), F.format_string("jd-%d", "id").alias("jd_id"),
        F.lit("c").alias("candidate_id"), F.array().cast(f"ARRAY<{records.GAP_ITEM}>").alias("items"),
    )
    path = str(tmp_path / "gap_maps.json")
    records.write_records(rows, path, "gap_maps", form=form)
    assert os.path.isdir(path) == (form == "folder")
    back = records.read_records(spark, path, "gap_maps", "r")
    assert {(r["jd_id"], r["jd_index"]) for r in back.collect()} == {(f"jd-{n}", n) for n in range(12)}


def test_config_defaults_and_overrides(tmp_path):
    made = config.normalised_config({"judge": {"provider": "deterministic"}, "openai": {"base_url": ""}, "planner": 3})
    assert made["judge"] == {"provider": "deterministic", "model": ""}
    assert made["planner"]["provider"] == "openai"
    assert made["openai"]["base_url"] is None
    with pytest.raises(ValueError, match="JSON object"):
        config.normalised_config([])
    config.write_config(str(tmp_path), vision_fallback=False, ocr_languages="eng")
    assert config.load_config(str(tmp_path))["input_extraction"]["vision_provider"] == "disabled"
    with pytest.raises(FileNotFoundError):
        config.load_config(str(tmp_path / "none"))


def test_endpoint_resolution(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# c\nexport OPENAI_API_KEY='k'\nJUDGE_MODEL=\"m1\"\nOPENAI_MODEL=m2\nOPENAI_BASE_URL=http://x/\nbroken\n")
    made = config.default_config()
    made["openai"]["env_file"] = str(env)
    found = config.endpoint(made, "judge", "evaluate", str(tmp_path))
    assert (found.model, found.base_url, found.api_key) == ("m1", "http://x/", "k")
    assert config.endpoint(made, "planner", "plan", str(tmp_path)).model == "m2"
    made["planner"]["provider"] = "unknown"
    with pytest.raises(ValueError, match="Unsupported planner provider"):
        config.endpoint(made, "planner", "plan", str(tmp_path))
    made["planner"]["provider"] = ""
    assert config.endpoint(made, "planner", "plan", str(tmp_path)) is None


def test_stage_bits_ignore_other_files(spark):
    rows = [("a", "ingest/manifest.json"), ("a", "ingest/manifest.json"), ("a", "x"), ("b", "x"), ("c", "analyze/jd_profiles.json")]
    found = viewer.completed_stages(spark.createDataFrame(rows, "run_id STRING, artifact STRING")).collect()
    assert {r["run_id"]: r["completed_stages"] for r in found} == {"a": ["ingest"], "b": [], "c": []}
