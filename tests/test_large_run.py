"""Artifacts in folders say the same as those in files, and the form is the caller's choice at every size."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from matchloom import cli
from matchloom.plans import run
from matchloom.sources import artifacts, runs

RESUME = "# Me\n- Built a python tool for llm review\n- Led product rollout in two regions\n"
JDS = "\n".join(f"### JD\nTitle: Engineer {i}\nCompany: Firm {i}\nBody:\n- python and llm delivery {i}\n- must own evaluation" for i in range(4))


def finished(spark, folder, form, prefix=""):
    (folder / "cv.md").write_text(RESUME)
    (folder / "jd.txt").write_text(JDS)
    roles = {role: {"provider": "deterministic"} for role in ("analyzer", "generator", "judge", "planner")}
    (folder / "config.json").write_text(json.dumps(roles))
    code, output = cli.execute(
        ["run", "--run-dir", f"{prefix}{folder / 'run'}", "--artifact-form", form, "--candidate-id", "c", "--cv", str(folder / "cv.md"),
         "--jd", str(folder / "jd.txt"), "--config", str(folder / "config.json")], spark,
    )
    assert code == 0, output
    return folder / "run"


def test_folders_and_files_say_the_same(spark, tmp_path_factory):
    small = finished(spark, tmp_path_factory.mktemp("small"), "file")
    large = finished(spark, tmp_path_factory.mktemp("large"), "folder", "file://")
    assert (small / "evaluate" / "scorecards.json").is_file() and (large / "evaluate" / "scorecards.json").is_dir()
    assert not list(large.rglob("*.writing-*")) and not list(small.rglob("*.writing-*"))
    for stage, table in (("analyze", "jd_profiles"), ("evaluate", "scorecards"), ("plan", "application_strategies"),
                         ("analyze", "candidate_profile"), ("evaluate", "llm_failures"), ("evaluate", "gap_maps")):
        one, two = (run.read(spark, str(folder), stage, table).drop("source_value", "base_resume_path") for folder in (small, large))
        assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0 and (table == "llm_failures") == (one.count() == 0)
    one, two = (sorted(map(tuple, run.read_evidence(spark, str(f)).drop("place").fillna("").collect())) for f in (small, large))
    assert [(r[1], r[2], json.loads(r[3])) for r in one] == [(r[1], r[2], json.loads(r[3])) for r in two]
    whole = json.loads((small / "analyze" / "evidence_map.json").read_text())
    assert set(whole) == {"candidate", "risks", "jds"} and whole["risks"] == whole["candidate"]["missing_evidence_areas"]
    one, two = (
        [r.value for r in runs.load_report(spark, str(Path(f).parent), "run").collect()] for f in (small, large)
    )
    assert [line.replace(str(small), "") for line in one] == [line.replace(f"file://{large}", "") for line in two]
    assert spark.read.json(str(small / "ingest" / "jd_inputs.json")).where(F.col("text").isNull()).count() == 0


def test_manifest_of_a_file_run_repeats_everything(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(30):
        (folder / f"cv{i:02}.md").write_text(f'- bullet "{i}" \\ with\ttab\n- second')
    (folder / "cv99.jpg").write_bytes(b"no image")
    (tmp_path / "jd.txt").write_text(JDS)
    run_dir = tmp_path / "run"
    run.ingest(spark, str(run_dir), "c", [str(folder)], [str(tmp_path / "jd.txt")], vision_fallback=False)
    manifest = json.loads((run_dir / "ingest" / "manifest.json").read_text())
    assert manifest["candidate_id"] == "c" and len(manifest["candidate_inputs"]) == 31
    parts = [f"Source: {i['source_value']}\n{i['text'].strip()}" for i in manifest["candidate_inputs"] if i["text"].strip()]
    assert manifest["candidate_resume_text"] == "\n\n".join(parts) and 'bullet "7" \\ with\ttab' in parts[7]
    assert manifest["jd_inputs"][0]["content"] == JDS
    assert [w["original_name"] for w in manifest["input_warnings"]] == ["cv99.jpg"]
    run.ingest(spark, str(run_dir), "c", [str(folder)], [str(tmp_path / "jd.txt")], vision_fallback=False, form="folder")
    assert set(json.loads((run_dir / "ingest" / "manifest.json").read_text())) == {"candidate_id", "candidate_resume_path"}


def test_parts_keep_their_order_and_failed_jobs_the_old_artifact(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id"), F.concat(F.lit("text\u2028 "), "id").alias("t")).repartition(7)
    folder, single = str(tmp_path / "many.json"), str(tmp_path / "one.json")
    value = F.to_json(F.struct("id", "t"))
    artifacts.write_artifact(rows, value, ["id"], folder)
    lines = [line for part in sorted(Path(folder).glob("part-*")) for line in part.read_text().split("\n") if line]
    assert [json.loads(line)["id"] for line in lines] == list(range(5000))
    artifacts.write_artifact(rows, artifacts.pretty(F.struct("id", "t")), ["id"], single, "file", "[\n", ",\n", "\n]")
    assert [r["id"] for r in json.loads(Path(single).read_text())] == list(range(5000))
    for path, form in ((folder, "folder"), (single, "file")):
        with pytest.raises(Exception, match="stop here"):
            bad = F.when(F.col("id") == 4321, F.raise_error(F.lit("stop here"))).otherwise(value)
            artifacts.write_artifact(rows, bad, ["id"], path, form)
    assert len(json.loads(Path(single).read_text())) == 5000 and spark.read.json(folder).count() == 5000
    assert not list(tmp_path.glob("*.writing-*"))
    artifacts.write_artifact(rows.limit(0), value, ["id"], folder)
    artifacts.write_artifact(rows.limit(0), value, ["id"], single, "file", "[", ",", "]")
    assert spark.read.schema("id BIGINT").json(folder).count() == 0 and Path(single).read_text() == "[]"
    with pytest.raises(ValueError, match="not `zip`"):
        artifacts.write_artifact(rows, value, ["id"], single, "zip")
