"""Batches of runs read from folders, with remote providers and with runs that cannot be used."""

import json

from matchloom import cli
from matchloom.config import Endpoint
from matchloom.plans import batch
from matchloom.sources import files
from test_run import BATCH, RESUME

ENDPOINT = Endpoint("openai-compatible", "m", "http://host/v1", "key")


def runs_below(folder):
    for name, text in {
        "r1/cv/resume.md": RESUME, "r1/jd/batch.txt": BATCH, "r2/cv/b.md": "- second bullet", "r2/cv/a.md": "- Python tool owner",
        "r2/jd/one.txt": "Title: T\nBody:\n- llm", "r2/jd/sub/two.txt": BATCH, "r3/cv/resume.md": RESUME, "r4/cv/a.md": "  ",
        "r4/jd/x.txt": BATCH, "loose.txt": "no run", "r2/notes.txt": "no role", "r2/jd/.hidden/x.txt": "no",
    }.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(folder)


def test_runs_are_read_in_order_from_one_listing(spark, tmp_path):
    found = files.collect_runs(spark, runs_below(tmp_path / "in")).select("run_id", "role", "input_ord", "source_value").collect()
    assert sorted(map(tuple, found)) == [
        ("r1", "cv", 1, "r1/cv/resume.md"), ("r1", "jd", 1, "r1/jd/batch.txt"), ("r2", "cv", 1, "r2/cv/a.md"),
        ("r2", "cv", 2, "r2/cv/b.md"), ("r2", "jd", 1, "r2/jd/one.txt"), ("r2", "jd", 2, "r2/jd/sub/two.txt"),
        ("r3", "cv", 1, "r3/cv/resume.md"), ("r4", "cv", 1, "r4/cv/a.md"), ("r4", "jd", 1, "r4/jd/x.txt"),
    ]


def test_batch_command_with_rejected_runs(spark, tmp_path):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({role: {"provider": "deterministic"} for role in ("analyzer", "generator", "judge", "planner")}))
    out = tmp_path / "out"
    code, text = cli.execute(
        ["batch", "--run-dir", str(out), "--inputs", runs_below(tmp_path / "in"), "--config", str(config)], spark
    )
    assert code == 0, text
    assert "Batch completed: runs=2, rejected=2, strategies=5" in text
    assert "r3: At least one JD input is required for ingest." in text
    assert "r4: At least one CV input must contain extractable text." in text
    plans = {(r["run_id"], r["jd_id"]): r for r in spark.read.parquet(str(out / "strategies")).collect()}
    assert plans["r1", "jd-001"]["priority_rank"] == 1 and set(plans) >= {("r2", f"jd-00{i}") for i in (1, 2, 3)}
    assert spark.read.parquet(str(out / "candidates")).filter("run_id = 'r2'").head()["experiences"] == ["Python tool owner", "second bullet"]
    assert spark.read.parquet(str(out / "evidence_map")).filter("name IS NOT NULL").count() == 5


def test_batch_with_a_remote_judge_and_planner(spark, tmp_path):
    resumes, inputs, _ = batch.ingest_batch(spark, runs_below(tmp_path / "in"), str(tmp_path / "out"))
    calls = tmp_path / "calls"
    calls.mkdir()
    assessment = {"role_fit": 0.9, "evidence_quality": 0.7, "persuasiveness": 0.6, "interview_pressure_risk": 0.2,
                  "application_worthiness": "apply", "must_fix_issues": [], "evidence_citations": ["证"], "rewrite_opportunities": [],
                  "decision_rationale": "值得投递"}

    def transport(url, payload, headers, timeout):
        import uuid

        prompt = payload["messages"][1]["content"]
        (calls / uuid.uuid4().hex).write_text(prompt)
        if prompt.startswith("评估候选人") and "Workflow Labs" in prompt:
            raise ConnectionError("offline")
        text = {"评": json.dumps(assessment, ensure_ascii=False), "给": '{"apply_decision": "hold", "reason_summary": "匹配度高"}'}
        return {"choices": [{"message": {"content": text.get(prompt[0], "远程说明")}}]}

    given = {"judge": ENDPOINT, "planner": ENDPOINT}
    tables = batch.run_batch(resumes, inputs, str(tmp_path / "out"), given, transport)
    assert tables["llm_assessments"].count() == 3 and tables["llm_failures"].count() == 2
    assert {r["error_message"] for r in tables["llm_failures"].collect()} == {"offline"}
    plans = {(r["run_id"], r["jd_id"]): r for r in tables["strategies"].collect()}
    assert plans["r1", "jd-001"]["apply_decision"] == "hold" and plans["r1", "jd-001"]["reason_summary"] == "匹配度高"
    assert plans["r1", "jd-002"]["reason_summary"] == "LLM assessment unavailable: ConnectionError: offline"
    asked = len(list(calls.iterdir()))
    batch.run_batch(resumes, inputs, str(tmp_path / "out"), given, transport)
    assert len(list(calls.iterdir())) == asked + 2  # the two that failed
