"""Remote providers over stand-in transports."""

import json
import time
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchloom.config import Endpoint
from matchloom.operators import evidence_map, remote, replies
from matchloom.plans import run
from test_run import config_file, load, sources

ENDPOINT = Endpoint("openai-compatible", "m", "http://host/v1/", "key")


def reply(content):
    return {"choices": [{"message": {"content": content}}]}


def test_json_object():
    assert remote.json_object('```json\n{"a": 1}\n```') == {"a": 1}
    with pytest.raises(ValueError, match="Expected JSON object"):
        remote.json_object("[1]")
    with pytest.raises(ValueError, match="invalid output"):
        remote.json_object("no")


def test_values_chinese():
    assert remote.values_chinese({"a": "理由充分", "id": "jd-001"})
    assert not remote.values_chinese({"id": "jd-001"})
    assert remote.values_chinese({"id": "jd-001"}, frozenset({"reason"}))
    assert remote.values_chinese({"list": ["English text here"], "reason": "理由"}, frozenset({"reason"}))
    assert not remote.values_chinese({"x": [{"reason": {"deep": "English text here"}}]}, frozenset({"reason"}))


def test_unusable_output_is_asked_twice_and_transport_errors_once():
    calls = []

    def english(url, payload, headers, timeout):
        calls.append((url, headers["Authorization"], timeout))
        return reply("only English words")

    with pytest.raises(ValueError, match="Chinese dominance"):
        remote.ask(ENDPOINT, "p", False, None, english)
    assert calls == [("http://host/v1/chat/completions", "Bearer key", 90)] * 2

    def down(*_):
        calls.append("down")
        raise TimeoutError("down")

    with pytest.raises(TimeoutError):
        remote.ask(ENDPOINT, "p", False, None, down)
    assert calls.count("down") == 1


def test_completed_keeps_failures_as_rows(spark):
    def transport(url, payload, headers, timeout):
        prompt = payload["messages"][1]["content"]
        if prompt == "fail":
            raise ConnectionError("no route")
        return reply(f"回答：{prompt}")

    rows = spark.createDataFrame([(1, "问"), (2, "fail")], "id BIGINT, p STRING")
    found = {r["id"]: r for r in remote.completed(rows, ["id"], F.col("p"), ENDPOINT, False, None, transport).collect()}
    assert found[1]["reply"] == "回答：问"
    assert (found[2]["reply"], found[2]["error_type"], found[2]["error_message"]) == (None, "ConnectionError", "no route")


def asked_in(folder):
    """Prompts that a counting transport was asked, from the files it left."""
    return sorted(path.read_text() for path in folder.glob("call-*"))


def counting(folder, fail=lambda prompt: False):
    def transport(url, payload, headers, timeout):
        prompt = payload["messages"][1]["content"]
        (folder / f"call-{uuid.uuid4().hex}").write_text(prompt)
        if fail(prompt):
            raise ConnectionError("no route")
        return reply(f"回答：{prompt}")

    return transport


def test_an_attempt_goes_on_where_the_failed_one_stopped(tmp_path):
    rows = pd.DataFrame({"request": [f"r{i}" for i in range(100)], "prompt": [f"p{i}" for i in range(100)], "label": ""})
    asked = []

    def dying(prompt):
        asked.append(prompt)
        if prompt == "p70":
            raise KeyboardInterrupt  # the task is lost
        return prompt.upper(), None, None

    def answering(prompt):
        asked.append(prompt)
        return prompt.upper(), None, None

    log = str(tmp_path / "job")
    with pytest.raises(KeyboardInterrupt):
        list(replies.logged_calls(iter([rows[:50], rows[50:]]), dying, log, 3))
    before = len(asked)
    done = list(replies.logged_calls(iter([rows[:50], rows[50:]]), answering, log, 3))
    assert done[0]["calls"].tolist() == [100]
    # All that was written down is asked once: only the group that was open when the task was lost comes again.
    assert before <= 82 and len(set(asked)) == 100 and len(asked) <= 100 + replies.CALLS_PER_FILE
    assert all(asked.count(f"p{i}") == 1 for i in range(48))
    lines = [json.loads(line) for path in tmp_path.rglob("part-*") for line in path.read_text().splitlines()]
    assert sorted(line["reply"] for line in lines) == sorted(f"P{i}" for i in range(100))


def test_log_is_looked_up_before_asking(spark, tmp_path):
    calls, log = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()
    rows = spark.createDataFrame([(i, f"问{i}") for i in range(40)], "id BIGINT, p STRING").repartition(5)

    def run_all(frame, fail=lambda prompt: False):
        done = remote.completed(frame, ["id"], F.col("p"), ENDPOINT, False, None, counting(calls, fail), log)
        return {r["id"]: (r["reply"], r["error_type"]) for r in done.collect()}

    first = run_all(rows, lambda prompt: prompt.endswith("7"))
    assert len(asked_in(calls)) == 40 and first[7] == (None, "ConnectionError") and first[8] == ("回答：问8", None)
    second = run_all(rows)  # only the four errors are asked again
    assert len(asked_in(calls)) == 44 and second[7] == ("回答：问7", None) and second[8] == first[8]
    third = run_all(rows.withColumn("p", F.when(F.col("id") == 5, F.lit("另问")).otherwise(F.col("p"))))
    assert len(asked_in(calls)) == 45 and third[5] == ("回答：另问", None)
    assert run_all(rows.limit(0)) == {}


def test_progress_comes_while_calls_run(spark, tmp_path):
    events, log = [], str(tmp_path / "log")

    def slow(url, payload, headers, timeout):
        time.sleep(0.15)
        return reply("回答")

    rows = spark.createDataFrame([(i,) for i in range(96)], "id BIGINT").repartition(1)
    label = F.to_json(F.struct(F.format_string("jd-%d", "id").alias("jd_id"), F.lit("v").alias("variant_id")))
    with replies.Watch(log, 96, lambda event: events.append((time.time(), event))):
        remote.completed(rows, ["id"], F.format_string("%d", "id"), ENDPOINT, False, None, slow, log, label).collect()
        over = time.time()
    assert len([at for at, _ in events if at < over]) >= 2
    assert [event["completed"] for _, event in events][-1] == 96 and sum(event["ok"] for _, event in events) == 96
    assert all(event["duration_ms"] >= 100 and event["jd_id"].startswith("jd-") for _, event in events)


def test_evidence_map_rows(spark):
    maps = {
        "a": {"candidate": {"core_claims": ["x \"y\""]}, "risks": ["r"], "note": "text", "n": 3, "jds": {"jd-1": {"must_have": ["é"]}, "jd 2": [1]}},
        "b": {"jds": ["a list"], "risks": None}, "c": ["no object"], "d": {},
    }
    frame = spark.createDataFrame([(k, json.dumps(v)) for k, v in maps.items()], "run_id STRING, value STRING")
    rows = evidence_map.parsed(frame)
    for run_id in ("a", "b", "d"):
        text = "{" + "".join(r["piece"] for r in evidence_map.pieces(rows.filter(F.col("run_id") == run_id)).orderBy("step", "place").collect()) + "}"
        expected = dict(maps[run_id])
        expected |= {"documents": {}} if run_id == "b" else {"jds": maps[run_id].get("jds", {})}
        assert json.loads(text) == expected
    pairs = spark.createDataFrame([("a", "jd-1"), ("a", "jd-9"), ("c", "jd-1")], "run_id STRING, jd_id STRING")
    told = pairs.join(evidence_map.shared_json(rows), "run_id", "left").join(evidence_map.own_json(rows), ["run_id", "jd_id"], "left")
    told = told.select("run_id", "jd_id", evidence_map.told(F.col("shared_json"), F.col("jd_id"), F.col("own_json")).alias("text"))
    found = {(r["run_id"], r["jd_id"]): json.loads(r["text"]) for r in told.collect()}
    shared = {k: v for k, v in maps["a"].items() if k != "jds"}
    assert found == {("a", "jd-1"): shared | {"jds": {"jd-1": {"must_have": ["é"]}}}, ("a", "jd-9"): shared, ("c", "jd-1"): {}}


def remote_run(spark, tmp_path, transport):
    resume, batch = sources(tmp_path)
    (tmp_path / ".env").write_text("OPENAI_API_KEY=k\n")
    path = tmp_path / "config.json"
    config_file(tmp_path, "openai-compatible")
    made = json.loads(path.read_text()) | {"openai": {"env_file": str(tmp_path / ".env")}}
    path.write_text(json.dumps(made))
    run_dir = str(tmp_path / "run")
    run.ingest(spark, run_dir, "cand-001", [resume], [batch], str(path), vision_fallback=False)
    run.analyze(spark, run_dir, transport)
    run.generate(spark, run_dir, transport)
    run.evaluate(spark, run_dir, transport=transport)
    run.plan(spark, run_dir, transport)
    return tmp_path / "run"


def test_remote_run(spark, tmp_path):
    profiles = {
        "candidate_profile": {"experiences": ["做过评估", 7, None], "skills": "none", "strengths": ["强项"], "verified_evidence": ["证据"]},
        "jd_profiles": [
            {"jd_id": "jd-a", "title": "Operations Analyst", "company": "C", "keywords": ["python"], "responsibilities": ["写 Python"],
             "role_level_confidence": "2"},
            "junk",
        ],
        "evidence_map": {},
    }
    assessment = {"role_fit": 0.876, "evidence_quality": "0.7", "persuasiveness": None, "interview_pressure_risk": 0.2,
                  "application_worthiness": "apply", "evidence_citations": ["English citation is fine"], "decision_rationale": " 值得投递 "}
    strategy = {"apply_decision": "apply", "decision_confidence": 0.9, "reason_summary": "匹配度高", "decision_drivers": []}

    def transport(url, payload, headers, timeout):
        prompt = payload["messages"][1]["content"]
        if prompt.startswith("解析"):
            return reply(json.dumps(profiles, ensure_ascii=False))
        if prompt.startswith("评估候选人"):
            return reply("```json\n" + json.dumps(assessment, ensure_ascii=False) + "\n```")
        if prompt.startswith("给出投递策略"):
            return reply(json.dumps(strategy, ensure_ascii=False))
        return reply("远程摘要")

    run_dir = remote_run(spark, tmp_path, transport)
    person, jds = load(run_dir, "analyze", "candidate_profile"), load(run_dir, "analyze", "jd_profiles")
    assert person["experiences"] == ["做过评估", "7", "None"] and person["skills"] == []
    assert [(j["jd_id"], j["cluster"], j["seniority"], j["role_level_confidence"]) for j in jds] == [
        ("jd-a", "operations-analyst", "mid", 1.0)
    ]
    assert load(run_dir, "generate", "resume_variants")[0]["summary"] == "远程摘要"
    card = load(run_dir, "evaluate", "scorecards")[0]
    assert (card["llm_role_fit_score"], card["llm_evidence_score"], card["llm_persuasion_score"]) == (0.88, 0.7, 0.0)
    assert (card["provider"], card["model"], card["judge_rationale"]) == ("openai-compatible", "gpt-5.4-mini", "远程摘要")
    assessed = load(run_dir, "evaluate", "llm_assessments")[0]
    assert (assessed["decision_rationale"], assessed["must_fix_issues"]) == ("值得投递", [])
    plan = load(run_dir, "plan", "application_strategies")[0]
    assert (plan["reason_summary"], plan["decision_confidence"]) == ("匹配度高", 0.9)
    assert plan["decision_drivers"][1] == "decision_source=llm-primary"  # left empty, so taken from the explanation
    assert load(run_dir, "analyze", "evidence_map") == {"jds": {}}  # the remote analyzer's own


def test_judge_and_planner_read_all_that_is_stored(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    assessment = {"role_fit": 0.9, "evidence_quality": 0.7, "persuasiveness": 0.6, "interview_pressure_risk": 0.2,
                  "application_worthiness": "apply", "must_fix_issues": ["改"], "evidence_citations": ["证"],
                  "rewrite_opportunities": ["写"], "decision_rationale": "值得投递"}

    def transport(url, payload, headers, timeout):
        prompt = payload["messages"][1]["content"]
        (calls / f"call-{uuid.uuid4().hex}").write_text(prompt)
        if prompt.startswith("评估候选人"):
            return reply(json.dumps(assessment, ensure_ascii=False))
        if prompt.startswith("给出投递策略"):
            return reply('{"apply_decision": "apply", "reason_summary": "匹配度高"}')
        raise ConnectionError("offline")

    run_dir = remote_run(spark, tmp_path, transport)
    prompts = asked_in(calls)
    judged = [p for p in prompts if p.startswith("评估候选人")]
    assert len(judged) == 2
    for prompt in judged:
        told = json.loads(prompt.split("证据：", 1)[1])
        assert set(told) == {"candidate", "risks", "jds"} and len(told["jds"]) == 1
        assert told["candidate"]["core_claims"] and told["risks"] == ["Large-scale online experiment ownership"]
    planned = [json.loads(p.split("评估：", 1)[1].split("\n")[0]) for p in prompts if p.startswith("给出投递策略")]
    assert len(planned) == 2
    assert set(planned[0]) == {*assessment, "jd_id", "variant_id", "provider", "model"}
    assert (planned[0]["role_fit"], planned[0]["evidence_citations"], planned[0]["model"]) == (0.9, ["证"], "gpt-5.4-mini")

    # Run again, nothing is asked; an edited map changes what the judge is asked.
    total = len([p for p in prompts if p.startswith("评估候选人")])
    run.evaluate(spark, str(run_dir), transport=transport)
    assert len([p for p in asked_in(calls) if p.startswith("评估候选人")]) == total
    path = run_dir / "analyze" / "evidence_map.json"
    path.write_text(json.dumps(json.loads(path.read_text()) | {"note": "added by hand"}))
    events = []
    run.evaluate(spark, str(run_dir), events.append, transport)
    again = [p for p in asked_in(calls) if p.startswith("评估候选人") and "added by hand" in p]
    assert len(again) == 2 and events[-1]["completed"] >= 2 and events[-1]["status"] == "ok"


def test_unreachable_remote_falls_back_everywhere(spark, tmp_path):
    def down(*_):
        raise ConnectionError("offline")

    run_dir = remote_run(spark, tmp_path, down)
    assert [j["jd_id"] for j in load(run_dir, "analyze", "jd_profiles")] == ["jd-001", "jd-002"]
    assert "variant focused on" in load(run_dir, "generate", "resume_variants")[0]["summary"]
    card = load(run_dir, "evaluate", "scorecards")[0]
    assert (card["final_decision_source"], card["final_overall_score"]) == ("guardrail-fallback", 0.79)
    assert (card["provider"], card["model"]) == ("openai-compatible", "gpt-5.4-mini")
    assert load(run_dir, "evaluate", "llm_failures")[0]["error_type"] == "ConnectionError"
    assert load(run_dir, "plan", "application_strategies")[0]["reason_summary"] == "LLM assessment unavailable: ConnectionError: offline"


def test_vision_reader():
    seen = {}

    def transport(url, payload, headers, timeout):
        seen.update(payload)
        return reply(" image text ")

    assert remote.vision_reader(ENDPOINT, transport)(b"x", "image/png", "none") == "image text"
    assert seen["messages"][0]["content"][1]["image_url"]["url"] == "data:image/png;base64,eA=="
    with pytest.raises(RuntimeError, match="missing OPENAI_API_KEY"):
        remote.vision_reader(Endpoint("v", "m", "u", ""))(b"", "", "")
