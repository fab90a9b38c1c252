"""From raw exports to rows by model, all incidents in one job."""

import json

import pytest
from pyspark.sql import functions as F

from lakewarden import jobs

VIOLATIONS = "array<struct<rule_id:string,severity:string,type:string,action:string,repair:string,missing_before:string>>"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    exports = [
        {"incident_id": "I1", "severity_code": "High", "start_date": 1736071200000, "name": "Malware Found", "properties": {"cs_command_line": "run C:\\Users\\joe\\x 8.8.8.8"},
         "extracted_notes": [{"text": "<b>ask</b> a@b.org", "create_date": 1736071201000, "user_name": "u"}, {"text": " "}], "extracted_tasks": [{"name": "Isolár host"}, {"name": "call"}]},
        {"incident_id": "I2", "discovered_date": 1736071200000, "description": "Beacon", "extracted_tasks": []},
        {"incident_id": None, "start_date": 1}, {"incident_id": "I3"},
    ]
    (root / "exports.json").write_text(json.dumps(exports))
    rules = [{"rule_id": "M", "type": "mandatory", "action": "notify", "scope": {"category_contains": ["malware"]}, "note": "x"}, {"rule_id": "O", "type": "prohibit_before", "action": "wipe", "condition_action": "image"}, {"rule_id": "A", "type": "require_approval", "action": "wipe", "severity": "soft"}]
    (root / "rules.json").write_text(json.dumps(rules))
    (root / "texts.json").write_text(json.dumps([{"action_id": "isolate", "keywords": ["Isolar  host", "isolar host"], "match_policy": "any_keyword", "priority": 1}]))
    (root / "catalog.json").write_text("\n".join(json.dumps({"action_id": a, "requires_approval": a == "wipe"}) for a in ("notify", "wipe", "image", "isolate")))
    jobs.main(["package", str(root / "exports.json"), str(root / "package"), "--text-rules", str(root / "texts.json")])
    runs = [(1, "I1", ["wipe"], "m1", "llm_zero"), (2, "I1", ["wipe", "isolate", "made_up"], "m1", "llm_policy_prompt"), (3, "I2", ["isolate"], "m1", "llm_zero"), (4, "I9", ["image"], "m2", "llm_zero"), (5, "I2", None, "m2", "llm_zero")]
    df = spark.createDataFrame(runs, "run_id bigint, incident_id string, llm_actions array<string>, llm_deployment string, llm_arm string")
    none = {"incident_dir_id": "string", "incident_type": "string", "severity": "string", "asset_criticality": "string", "mode": "string", "approval_policy_mode": "string", "llm_latency_ms": "bigint", "llm_cost_estimated_usd": "double"}
    df = df.withColumns({k: F.lit(None).cast(t) for k, t in none.items()}).withColumns({"human_actions": F.array(F.lit("isolate")), "incident_approved_actions": F.array().cast("array<string>"), "run_tag": F.concat(F.lit("t"), "run_id")})
    df = df.withColumn("llm_usage", F.lit(None).cast("struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>"))
    df.write.parquet(str(root / "runs.parquet"))
    jobs.main(["enforce", str(root / "package"), str(root / "runs.parquet"), str(root / "catalog.json"), str(root / "rules.json"), str(root / "enforced")])
    jobs.main(["analyse", str(root / "enforced" / "runs.parquet"), str(root / "analysis")])
    return root


def read(spark, made, name):
    return spark.read.parquet(f"{made}/{name}.parquet")


def test_package(spark, made):
    assert {(r.incident_id, r.reason) for r in read(spark, made, "package/rejected").collect()} == {(None, "no_id"), ("I3", "no_time")}
    events = {(r.incident_id, r.line_no): (r.event_type, r.category, r.command) for r in read(spark, made, "package/events").collect()}
    assert events[("I1", 1)] == ("command_execution_attempt", "malware_found", r"run C:\Users\user_home\x 10.255.1.1")
    assert events[("I1", 2)] == ("case_note", "soar_note", "ask user_0001@masked.local") and set(events) == {("I1", 1), ("I1", 2), ("I2", 1)}
    assert {(r.incident_id, r.action_id, r.action_order) for r in read(spark, made, "package/human_actions").collect()} == {("I1", "isolate", 1), ("I2", "collect_forensics", 1)}
    assert {r.incident_id: r.severity for r in read(spark, made, "package/incidents").collect()} == {"I1": "high", "I2": "medium"}


def test_enforced(spark, made):
    got = {r.run_id: (r.enforced_actions, [v.type for v in r.violations], r.error) for r in read(spark, made, "enforced/runs").collect()}
    assert got == {
        1: (["notify", "image"], ["missing_mandatory", "order_violation", "approval_required"], None), 2: (["notify", "image", "isolate"], ["missing_mandatory", "order_violation", "approval_required"], None),
        3: (["isolate"], [], None), 4: (["image"], [], "no_events"), 5: ([], [], "no_plan"),
    }


def test_analysis(spark, made):
    rows = {r.model_label: r for r in read(spark, made, "analysis/by_model").collect()}
    assert set(rows) == {"m1|llm_zero", "m1|llm_policy_prompt", "m2|llm_zero"}
    assert (rows["m1|llm_zero"].run_count, rows["m1|llm_zero"].runs_with_violations, rows["m1|llm_zero"].inserted_count_total, rows["m1|llm_zero"].removed_count_total) == (2, 1, 1, 1)
    assert rows["m1|llm_policy_prompt"].recall_enforced_avg == 1.0 and read(spark, made, "analysis/summary").first().runs == 5
    declared = read(spark, made, "analysis/by_model").withColumn("violation_rate", F.when(F.col("model_label") == "m2|llm_zero", 0.5).otherwise(F.col("violation_rate")))
    checks = jobs.recheck(read(spark, made, "analysis/by_model"), declared, ["model_label"], ["violation_rate", "recall_raw_avg"]).collect()
    assert len(checks) == 6 and [(r.model_label, r.name) for r in checks if not r.ok] == [("m2|llm_zero", "violation_rate")]


def test_rule_files(tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"rule_id": "r", "technique_id": "T1", "tactic_id": "A", "event_type_contains": ["x"], "command_contains": ["y"], "base_weight": 0.5, "min_confidence": 0.7}]))
    rule = jobs.technique_rules(str(tmp_path / "t.json"))[0]
    assert (rule.event_type, rule.command, rule.weights, rule.least) == (["x"], ["y"], (0.5, 0.3, 0.2, 0.1), 0.7)
    (tmp_path / "c.json").write_text(json.dumps([{"rule_id": "1", "type": "prohibit_before", "action": "a", "condition_action": "b"}, {"rule_id": "2", "type": "prohibit_before", "action": "b", "condition_action": "a"}]))
    with pytest.raises(ValueError, match="cycle"):
        jobs.policy_rules(str(tmp_path / "c.json"))
