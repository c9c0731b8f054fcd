"""A whole run over the two sample texts, stage by stage and through the command line."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from matchloom import cli
from matchloom.operators import judge
from matchloom.plans import run
from matchloom.sources import runs

# The sample inputs whose results are known.
RESUME = """# 候选人主简历样例

- 围绕 LLM 辅助工作流构建过内部工具
- 完成过简历评估与评分流程原型
- 与产品和工程团队进行过高频协作
"""
BATCH = """=== JD ===
Title: LLM Product Engineer
Company: Example AI
SourceType: text
Body:
- Build evaluation pipelines for resume and strategy ranking
- Strong Python and prompt engineering fundamentals
- Partner with product and engineering on AI workflows

=== JD ===
Title: Applied AI Engineer
Company: Workflow Labs
SourceType: text
Body:
- Build internal automation tools for AI-assisted operations
- Python, LLM workflow tooling, and product collaboration
- Bonus for metrics ownership and experimentation rigor
"""


def config_file(folder: Path, provider: str = "deterministic") -> str:
    path = folder / "config.json"
    path.write_text(json.dumps({role: {"provider": provider} for role in ("analyzer", "generator", "judge", "planner")}))
    return str(path)


def sources(folder: Path) -> tuple[str, str]:
    (folder / "resume.md").write_text(RESUME, encoding="utf-8")
    (folder / "batch.txt").write_text(BATCH, encoding="utf-8")
    return str(folder / "resume.md"), str(folder / "batch.txt")


def load(run_dir: Path, stage: str, name: str):
    return json.loads((run_dir / stage / f"{name}.json").read_text(encoding="utf-8"))


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("finished")
    resume, batch = sources(folder)
    run_dir = folder / "run"
    code, output = cli.execute(
        ["run", "--run-dir", str(run_dir), "--candidate-id", "cand-001", "--cv", resume, "--jd", batch,
         "--config", config_file(folder)],
        spark,
    )
    assert code == 0, output
    assert "Run completed" in output
    return run_dir


def test_profiles(finished):
    first, second = load(finished, "analyze", "jd_profiles")
    assert (first["jd_id"], first["title"], first["company"]) == ("jd-001", "LLM Product Engineer", "Example AI")
    assert first["cluster"] == "llm-product-engineer"
    assert first["keywords"] == ["evaluation", "ranking", "python", "prompt engineering", "product collaboration"]
    assert first["risk_signals"] == ["Prompt quality will be probed"]
    assert second["keywords"] == ["python", "product collaboration", "automation", "metrics", "experimentation"]
    assert second["bonuses"] == ["metrics ownership and experimentation rigor"]
    assert second["hidden_signals"] == ["Requires metrics storytelling"]
    person = load(finished, "analyze", "candidate_profile")
    assert person["skills"] == ["LLM workflows"]
    assert person["projects"] == []
    assert len(person["verified_evidence"]) == 3


def test_variants(finished):
    first, second = load(finished, "generate", "resume_variants")
    assert first["variant_id"] == "variant-jd-jd-001"
    assert len(first["emphasized_strengths"]) == 2
    assert first["stretch_points"] == ["evaluation", "ranking", "python"]
    assert second["stretch_points"] == ["python", "product collaboration", "automation"]


def test_scores(finished):
    for card in load(finished, "evaluate", "scorecards"):
        rule = [card[f"{name}_score"] for name in ("fit", "ats", "evidence", "stretch", "gap_risk", "rewrite_cost", "overall")]
        assert rule == [0.76, 0.6, 0.99, 0.9, 0.18, 0.51, 0.79]
        assert card["llm_role_fit_score"] == 0.82
        assert card["llm_overall_score"] == 0.8
        assert card["final_overall_score"] == 0.79
        assert card["final_decision_source"] == "llm-primary+guardrail"
        assert card["guardrail_flags"] == ["missing_must_have_requirements"]
    gap = load(finished, "evaluate", "gap_maps")[0]["items"][0]
    assert (gap["area"], gap["priority"]) == ("Role alignment", "high")
    assert gap["catch_up_concepts"] == ["evaluation", "ranking", "python"]
    assert load(finished, "evaluate", "llm_failures") == []
    assert len(load(finished, "evaluate", "llm_assessments")) == 2


def test_ranking_keeps_input_order_on_ties(finished):
    strategies = load(finished, "plan", "application_strategies")
    assert [(s["jd_id"], s["priority_rank"]) for s in strategies] == [("jd-001", 1), ("jd-002", 2)]
    assert strategies[0]["apply_decision"] == "apply"
    assert strategies[0]["decision_confidence"] == 0.89
    assert strategies[0]["recommended_actions"] == ["evaluation", "ranking"]
    assert strategies[0]["catch_up_notes"] == ["Large-scale online experiment ownership"]


def test_report(finished):
    text = (finished / "report" / "summary.md").read_text(encoding="utf-8")
    assert "### 1. LLM Product Engineer @ Example AI" in text
    assert "- Final score: `0.79` via `llm-primary+guardrail`" in text
    assert text.index("### 1.") < text.index("### 2.")
    assert text.endswith("guardrail`\n")


def test_reader_tables(spark, finished):
    tables = runs.load_run(spark, str(finished.parent), finished.name)
    tops = sorted(tables["top_variants"].collect(), key=lambda row: row["jd_index"])
    assert [(t["jd_id"], t["score"], t["gap_count"]) for t in tops] == [("jd-001", 0.79, 1), ("jd-002", 0.79, 1)]
    assert tops[0]["variant_display_name"] == "岗位定制版本（jd-001）"
    assert tops[0]["top_reasons"] == ["final_score=0.79", "decision_source=llm-primary+guardrail"]
    assert {v["variant_type_display"] for v in tables["variants"].collect()} == {"岗位定制版本"}
    inputs = {r["original_name"]: r for r in tables["input_sources"].collect()}
    assert (inputs["resume.md"]["role"], inputs["batch.txt"]["role"]) == ("cv", "jd")
    assert inputs["batch.txt"]["extraction_status"] == "extracted"
    assert [r["original_name"] for r in tables["input_sources"].orderBy("position").collect()] == ["resume.md", "batch.txt"]
    detail = tables["detail"].head()
    assert (detail["label"], detail["judge_provider"], detail["draft_status"]) == ("", "deterministic", "complete")
    assert detail["completed_stages"] == ["ingest", "analyze", "generate", "evaluate", "plan", "report"]
    assert runs.load_report(spark, str(finished.parent), finished.name).head()["value"].startswith("# ")
    listed = runs.list_runs(spark, str(finished.parent)).filter("run_id = 'run'").head()
    assert (listed["draft_status"], len(listed["completed_stages"])) == ("complete", 6)


def test_reader_of_an_unfinished_run(spark, tmp_path):
    (tmp_path / "new" / "config").mkdir(parents=True)
    (tmp_path / "new" / "config" / "run_config.json").write_text("{}")
    tables = runs.load_run(spark, str(tmp_path), "new")
    detail = tables.pop("detail").head()
    assert (detail["completed_stages"], detail["draft_status"]) == ([], "ingest-ready")
    assert {name: table.count() for name, table in tables.items()} == dict.fromkeys(tables, 0)
    assert runs.load_report(spark, str(tmp_path), "new") is None
    with pytest.raises(FileNotFoundError):
        runs.load_run(spark, str(tmp_path), "absent")


def test_legacy_run_without_explanations(spark, finished, tmp_path):
    import shutil

    run_dir = tmp_path / "legacy"
    shutil.copytree(finished, run_dir)
    (run_dir / "evaluate" / "ranking_explanations.json").unlink()
    assert run.plan(spark, str(run_dir))["strategies"] == 2
    text = Path(run.write_report(spark, str(run_dir))).read_text(encoding="utf-8")
    assert "Evidence mapping is limited." in text


def test_failing_judge_falls_back_to_rules(spark, finished, tmp_path):
    import shutil

    run_dir = tmp_path / "failing"
    shutil.copytree(finished, run_dir)

    def broken(pairs):
        judged = judge.with_assessment(pairs)
        fails = F.col("variant_id") == "variant-jd-jd-002"
        return judged.withColumn("error_type", F.when(fails, F.lit("RuntimeError"))).withColumn(
            "error_message", F.when(fails, F.lit("judge down"))
        )

    events = []
    done = run.evaluate(spark, str(run_dir), progress=events.append, assess=broken)
    assert (done["scorecards"], done["ok"]) == (2, 1)
    assert events[-1]["completed"] == events[-1]["total"] == 2
    assert (sum(event["ok"] for event in events), sum(event["fallback"] for event in events)) == (1, 1)
    assert {event["jd_id"] for event in events} <= {"jd-001", "jd-002"}
    card = load(run_dir, "evaluate", "scorecards")[1]
    assert card["final_decision_source"] == "guardrail-fallback"
    assert card["guardrail_flags"] == ["llm_assessment_missing"]
    failure = load(run_dir, "evaluate", "llm_failures")[0]
    assert (failure["error_type"], failure["error_message"]) == ("RuntimeError", "judge down")
    run.plan(spark, str(run_dir))
    reasons = {s["jd_id"]: s["reason_summary"] for s in load(run_dir, "plan", "application_strategies")}
    assert reasons["jd-002"] == "LLM assessment unavailable: RuntimeError: judge down"


def test_incomplete_judge_is_flagged(spark, finished, tmp_path):
    import shutil

    run_dir = tmp_path / "incomplete"
    shutil.copytree(finished, run_dir)

    def silent(pairs):
        return judge.with_assessment(pairs).withColumns(
            {"decision_rationale": F.lit(""), "evidence_citations": F.array().cast("array<string>")}
        )

    run.evaluate(spark, str(run_dir), assess=silent)
    for card in load(run_dir, "evaluate", "scorecards"):
        assert "llm_assessment_incomplete" in card["guardrail_flags"]


def test_command_line_errors(spark, tmp_path):
    assert cli.execute(["bogus"], spark)[0] == 2
    code, output = cli.execute(["--help"], spark)
    assert code == 0 and "evaluate" in output
    code, output = cli.execute(["ingest", "--run-dir", str(tmp_path), "--candidate-id", "c"], spark)
    assert code == 1 and "--cv" in output
    code, output = cli.execute(["analyze", "--run-dir", str(tmp_path / "none")], spark)
    assert code == 1 and "run_config.json" in output


def test_no_usable_text_raises(spark, tmp_path):
    resume, batch = sources(tmp_path)
    (tmp_path / "scan.jpg").write_bytes(b"not a real image")
    code, output = cli.execute(
        ["ingest", "--run-dir", str(tmp_path / "r"), "--candidate-id", "c", "--cv", str(tmp_path / "scan.jpg"),
         "--jd", batch, "--config", config_file(tmp_path), "--no-vision-fallback"],
        spark,
    )
    assert code == 1 and "At least one CV input must contain extractable text." in output


def test_remote_provider_needs_its_key(spark, tmp_path):
    resume, batch = sources(tmp_path)
    (tmp_path / ".env").write_text("OTHER=1\n")
    config = {"analyzer": {"provider": "openai"}, "openai": {"env_file": str(tmp_path / ".env")}}
    (tmp_path / "remote.json").write_text(json.dumps(config))
    common = ["--run-dir", str(tmp_path / "r")]
    code, _ = cli.execute(
        ["ingest", *common, "--candidate-id", "c", "--cv", resume, "--jd", batch, "--config", str(tmp_path / "remote.json"),
         "--no-vision-fallback"],
        spark,
    )
    assert code == 0
    code, output = cli.execute(["analyze", *common], spark)
    assert code == 1 and "OPENAI_API_KEY" in output
