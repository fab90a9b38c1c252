"""Whole jobs over all incidents at once: package raw exports, enforce plans, analyse runs.  Errors are rows, not exceptions.

    python -m lakewarden.jobs package EXPORTS OUT
    python -m lakewarden.jobs enforce PACKAGE RUNS CATALOG RULES OUT
    python -m lakewarden.jobs analyse RUNS OUT
"""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.functions.text import match_form
from lakewarden.operators import analysis, audit, enforce, matching, normalize, stability
from lakewarden.operators.enforce import Rule
from lakewarden.operators.matching import TechniqueRule, TextRule
from lakewarden.sources.records import read_rules
from lakewarden.sources.tables import bounded_rows

#: Actions of a catalog at most: they become a literal of the plan.
CATALOG = 5_000

EXPORT = """incident_id string, incident_type_ids array<string>, severity_code string, resolution_id string, name string, description string,
start_date bigint, inc_start bigint, end_date bigint, inc_last_modified_date bigint, discovered_date bigint,
properties struct<cs_severity:string,status_do_incidente:string,cs_hostname:string,cs_source_ip:string,cs_username:string,cs_command_line:string>,
extracted_notes array<struct<text:string,create_date:bigint,user_name:string>>, extracted_tasks array<struct<name:string,description:string>>"""


def _typed(kind: type, rows: list[dict], names: dict[str, str]) -> list:
    """Records of a rule file as objects of a class: ``names`` translates keys, unknown keys are dropped, missing ones need a default."""
    known = {f.name for f in fields(kind)}
    out = []
    for row in rows:
        own = {names.get(k, k): v for k, v in row.items()}
        out.append(kind(**{k: v for k, v in own.items() if k in known and v is not None}))
    return out


def policy_rules(path: str) -> list[Rule]:
    """Rules from a file; sets with a cycle are refused."""
    rules = _typed(Rule, read_rules(path), {"type": "kind", "condition_action": "before"})
    enforce.check_rules(rules)
    return rules


def technique_rules(path: str) -> list[TechniqueRule]:
    """Technique rules from a file; event_type_contains, command_contains, category_contains and source_type_contains hold the needles."""
    names = {f"{x}_contains": x for x in ("event_type", "command", "category", "source_type")} | {"min_confidence": "least"}
    rows = read_rules(path)
    weights = ("base_weight", "command_weight", "category_weight", "source_type_weight")
    for row in rows:
        if any(w in row for w in weights):
            row["weights"] = tuple(float(row.get(w, d)) for w, d in zip(weights, TechniqueRule.weights, strict=True))
    return _typed(TechniqueRule, rows, names)


def text_rules(path: str) -> list[TextRule]:
    """Text rules from a file, their keywords in matching form, each once in first order."""
    rows = read_rules(path)
    for row in rows:
        row["every"] = row.get("match_policy") == "all_keywords"
        row["keywords"] = list(dict.fromkeys(" ".join(str(k).lower().split()) for k in row.get("keywords", []) if str(k).strip()))
    return _typed(TextRule, rows, {})


def package(exports: DataFrame, rules: list[TextRule] = (), terms: dict[str, str] | None = None, default: str = "collect_forensics") -> dict[str, DataFrame]:
    """incidents, events and human_actions of raw exports, and rejected: exports without an id or a time, with the reason.

    Texts of events are sanitized with numbers that count per incident; actions come from the
    tasks whose texts ``rules`` fit, ``default`` where none does.
    """
    checks = {"no_id": F.col("incident_id").isNotNull() & (F.col("incident_id") != ""), "no_time": F.coalesce("start_date", "inc_start", "discovered_date").isNotNull()}
    judged = audit.reject(exports, checks)
    fine = judged.where(F.size("errors") == 0).drop("errors")
    events = normalize.export_events(fine).withColumn("_row", F.struct("incident_id", "line_no"))
    if terms is not None:
        events = audit.sanitize(events, "_row", "incident_id", "line_no", "command", terms, "_clean").withColumn("command", F.col("_clean")).drop("_clean")
    tasks = fine.select("incident_id", F.posexplode_outer("extracted_tasks").alias("_n", "_t"))
    tasks = tasks.select("incident_id", "_n", match_form(F.concat_ws(" ", "_t.name", "_t.description")).alias("_text"))
    actions = matching.actions_from_texts(matching.ranked_rules(tasks, "_text", list(rules)), "incident_id", ["_n"], default) if rules else None
    out = {"incidents": normalize.export_meta(fine), "events": events.drop("_row"), "rejected": judged.where(F.size("errors") > 0).select("incident_id", F.array_join("errors", ",").alias("reason"))}
    if actions is not None:
        out["human_actions"] = actions.select("incident_id", "action_id", F.col("place").alias("action_order"))
    return out


def event_table(events: DataFrame) -> DataFrame:
    """Packaged events with the columns that scopes ask for."""
    details = F.to_json(F.struct("command", "log_source", "severity"), {"ignoreNullFields": "false"})
    return events.withColumns({"category": F.lower("category"), "severity": F.lower("severity"), "details_text": F.lower(details)})


def catalog_of(actions: DataFrame) -> list[tuple[str, bool]]:
    rows = bounded_rows(actions.select("action_id", "requires_approval").where("action_id is not null").distinct(), CATALOG)
    if rows is None:
        raise ValueError(f"more than {CATALOG} actions")
    return [(r[0], bool(r[1])) for r in rows]


def enforce_runs(runs: DataFrame, events: DataFrame, rules: list[Rule], catalog: list[tuple[str, bool]], defer: Column | bool = False) -> DataFrame:
    """``runs`` (run_id, incident_id, llm_actions, incident_approved_actions) with enforced_actions, violations and approval_pending_actions made anew.

    A run whose incident has no event is not enforced but told by error: no_events; one without a plan: no_plan.
    """
    flags = enforce.scope_flags(events, rules).withColumn("_events", F.lit(True))
    met = runs.drop("enforced_actions", "violations", "approval_pending_actions").join(flags, "incident_id", "left")
    made = enforce.enforce(met, rules, catalog, plan="llm_actions", approved="incident_approved_actions", defer=defer)
    error = F.when(F.col("_events").isNull(), "no_events").when(F.coalesce(F.size("llm_actions"), F.lit(0)) == 0, "no_plan")
    pending = F.array_sort(F.array_distinct(F.transform(F.filter("found", lambda v: v["type"] == "approval_deferred"), lambda v: v["action"])))
    made = made.withColumns({"error": error, "approval_pending_actions": pending})
    return made.withColumnsRenamed({"enforced": "enforced_actions", "found": "violations"}).drop("matched", "_events")


def analyse(runs: DataFrame) -> dict[str, DataFrame]:
    """All analyses of enforced runs: one flat row per run, by model, by rule, by rule and arm, pairs of models, summary, stability of repeats."""
    rows = analysis.run_rows(runs)
    latest = analysis.latest_runs(rows)
    flags = rows.select("incident_key", "model_label", "run_tag", "run_id", F.when(F.col("violation_count") > 0, 1.0).otherwise(0.0).alias("violating"))
    series = stability.repeat_index(flags, ["incident_key", "model_label"], ["run_tag", "run_id"]).groupBy("model_label", "repeat").agg(F.avg("violating").alias("rate"))
    return {
        "run_rows": rows, "by_model": analysis.by_model(latest), "by_rule": analysis.by_rule(rows), "by_rule_treatment": analysis.by_rule_treatment(rows),
        "pairwise": analysis.pairwise(latest), "summary": analysis.summary(rows), "stability": stability.metric_series(series, ["model_label"], "rate"),
    }


def recheck(made: DataFrame, declared: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-4) -> DataFrame:
    """One row per key and value: name, made, declared, ok."""
    found = None
    for v in values:
        own = stability.conformance(made, declared, keys, v, tolerance).select(*keys, F.lit(v).alias("name"), F.col("made").cast("double"), F.col("declared").cast("double"), "ok")
        found = own if found is None else found.unionByName(own)
    return found


def _write(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lakewarden.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, asked in (("package", ["exports", "out"]), ("enforce", ["package", "runs", "catalog", "rules", "out"]), ("analyse", ["runs", "out"])):
        job = jobs.add_parser(name)
        for a in asked:
            job.add_argument(a)
        if name == "package":
            job.add_argument("--text-rules")
        if name == "enforce":
            job.add_argument("--defer", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.job == "package":
        exports = spark.read.schema(EXPORT).option("multiLine", True).json(args.exports)
        _write(package(exports, text_rules(args.text_rules) if args.text_rules else [], {}), args.out)
    elif args.job == "enforce":
        events = event_table(spark.read.parquet(f"{args.package}/events.parquet"))
        catalog = catalog_of(spark.read.json(args.catalog))
        _write({"runs": enforce_runs(spark.read.parquet(args.runs), events, policy_rules(args.rules), catalog, args.defer)}, args.out)
    else:
        _write(analyse(spark.read.parquet(args.runs)), args.out)


if __name__ == "__main__":
    main()
