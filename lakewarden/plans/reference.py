"""The engine's named queries over whole tables: projections, filters, joins, aggregates, windows, sets, plans, scalars."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewarden.functions import stats, text
from lakewarden.functions.present import first_present, present, strip_quotes
from lakewarden.operators import analysis, audit, enforce, matching, normalize, stability
from lakewarden.operators.instants import source_zones, with_instant
from lakewarden.plans import problem_sql
from lakewarden.plans import sql as S
from lakewarden.plans.fixtures import PRIORITY_WORDS, RULES, STOP, TECHNIQUES, TERMS, TEXT_RULES
from lakewarden.plans.registry import query
from lakewarden.sources import records
from lakewarden.sources.tables import bounded_rows, latest_copy, table


def runs(spark: SparkSession, root: str) -> DataFrame:
    return analysis.run_rows(table(spark, root, "verifier_output"))


def events(spark: SparkSession, root: str) -> DataFrame:
    return normalize.event_rows(table(spark, root, "telemetry"))


def deliveries(spark: SparkSession, root: str) -> DataFrame:
    """Events with all of their deliveries: enough to ask whether there is one, without a shuffle."""
    return normalize.event_columns(table(spark, root, "telemetry"))


def catalog(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    """The action catalog; a catalog of more than 5000 actions is refused."""
    rows = bounded_rows(table(spark, root, "action_catalog").select("action_id", "requires_approval"), 5000)
    if rows is None:
        raise ValueError("catalog too large for a plan literal")
    return [(r[0], bool(r[1])) for r in rows if r[0] is not None]


def joined(c: str, sep: str = ",") -> Column:
    return F.array_join(c, sep)


# --- Sources -----------------------------------------------------------------------------------


@query("SELECT event_id, details.source_summary->>'detection_name' AS detection_name, details.source_summary->>'host' AS host FROM telemetry WHERE details.source_summary IS NOT NULL GROUP BY ALL")
def scan_jsonl_permissive(spark, root):
    """JSON text with a fixed schema; broken text gives nulls."""
    parsed = F.from_json("details.source_summary", "detection_name string, host string", {"mode": "PERMISSIVE"})
    return table(spark, root, "telemetry").where("details.source_summary is not null").select("event_id", parsed.alias("p")).select("event_id", "p.detection_name", "p.host").distinct()


@query("SELECT * FROM (SELECT 'telemetry' AS source_type, incident_id, count(*) AS n FROM telemetry GROUP BY ALL UNION ALL SELECT 'actions', incident_id, count(*) FROM human_actions GROUP BY ALL UNION ALL SELECT 'meta', incident_id, count(*) FROM incident_meta GROUP BY ALL)")
def union_sources_tagged(spark, root):
    frames = {k: table(spark, root, t).select("incident_id") for k, t in (("telemetry", "telemetry"), ("actions", "human_actions"), ("meta", "incident_meta"))}
    return records.union_sources(frames).groupBy("source_type", "incident_id").agg(F.count(F.lit(1)).alias("n"))


_PREFIX = " ".join(f"WHEN starts_with(lower('dataset-' || log_source), '{p}') THEN '{k}'" for p, k in normalize.SOURCE_PREFIXES)


@query(f"SELECT log_source, CASE {_PREFIX} ELSE upper('dataset-' || log_source) END AS kind FROM log_sources")
def source_type_prefix_lookup(spark, root):
    return table(spark, root, "log_sources").select("log_source", normalize.source_type(F.concat(F.lit("dataset-"), "log_source")).alias("kind"))


@query("SELECT DISTINCT incident_id FROM telemetry WHERE incident_id IS NOT NULL")
def distinct_sorted_keys(spark, root):
    return table(spark, root, "telemetry").select("incident_id").where("incident_id is not null").distinct().orderBy("incident_id")


@query(f"WITH {S.ROWS} SELECT run_id, incident_key FROM rows_ r WHERE mode <> 'human' OR incident_key NOT IN (SELECT incident_key FROM rows_ WHERE mode <> 'human')")
def prefer_versioned_else_canonical(spark, root):
    rows = runs(spark, root).select("run_id", "incident_key", "mode")
    return records.versioned_else_canonical(rows.where("mode <> 'human'"), rows.where("mode = 'human'"), "incident_key").select("run_id", "incident_key")


@query(r"""WITH t AS (SELECT DISTINCT event_id, details.raw AS raw FROM telemetry WHERE details.raw IS NOT NULL),
r AS (SELECT *, replace(regexp_replace(regexp_replace(raw, '(\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))|\\', '\1' || chr(1), 'g'), '(\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))' || chr(1), '\1', 'g'), chr(1), '\\') AS fixed FROM t)
SELECT event_id, json_valid(raw) AS valid, NOT json_valid(raw) AND contains(raw, '\') AND json_valid(fixed) AS repaired,
  sha256(CASE WHEN json_valid(raw) THEN raw WHEN contains(raw, '\') AND json_valid(fixed) THEN fixed END) AS text_hash FROM r""")
def json_repair_backslashes(spark, root):
    raw = table(spark, root, "telemetry").select("event_id", "details.raw").where("raw is not null").distinct()
    out = raw.select("event_id", F.try_parse_json("raw").isNotNull().alias("valid"), records.readable_json("raw").alias("t"))
    return out.select("event_id", "valid", (~F.col("valid") & F.col("t").isNotNull()).alias("repaired"), F.sha2("t", 256).alias("text_hash"))


@query(f"WITH {S.ROWS} SELECT incident_key, model_label, run_id FROM rows_ WHERE llm_action_count > 0 QUALIFY row_number() OVER (PARTITION BY incident_key, model_label ORDER BY coalesce(run_tag, '') DESC, run_id) = 1")
def latest_saved_output(spark, root):
    return analysis.latest_runs(runs(spark, root).where("llm_action_count > 0").select("incident_key", "model_label", "run_tag", "run_id")).select("incident_key", "model_label", "run_id")


# --- Projections -------------------------------------------------------------------------------

_EVENT = ["event_id", "event_type", "category", "source_type", "source_ip", "dest_ip", "username", "command", "severity", "log_source"]


@query(f"WITH {S.EVENTS} SELECT {', '.join(_EVENT)} FROM ev")
def normalize_event(spark, root):
    return events(spark, root).select(*_EVENT)


@query(f"SELECT DISTINCT event_id, coalesce({S.present('username')}, {S.present('source_ip')}, {S.present('dest_ip')}) AS who FROM telemetry")
def coalesce_placeholder(spark, root):
    return table(spark, root, "telemetry").select("event_id", first_present("username", "source_ip", "dest_ip").alias("who")).distinct()


@query("SELECT DISTINCT event_id, trim(trim(details.command, '\"'), '''') AS command FROM telemetry", name="strip_quotes")
def stripped_commands(spark, root):
    return table(spark, root, "telemetry").select("event_id", strip_quotes("details.command").alias("command")).distinct()


@query(f"SELECT DISTINCT event_id, coalesce({S.present('details.severity')}, {S.present('category')}, {S.present('details.log_source')}, 'unknown') AS level FROM telemetry")
def coalesce_priority(spark, root):
    return table(spark, root, "telemetry").select("event_id", F.coalesce(first_present("details.severity", "category", "details.log_source"), F.lit("unknown")).alias("level")).distinct()


@query(f"WITH {S.EVENTS} SELECT incident_id, 'detection' AS kind, count(*) AS n FROM (SELECT DISTINCT incident_id FROM incident_meta) GROUP BY ALL UNION ALL SELECT incident_id, 'note', count(*) FROM ev WHERE contains(lower(event_type), 'note') AND command <> '' GROUP BY ALL")
def explode_notes_union(spark, root):
    """One detection row per incident and one row per non-empty note, counted."""
    found = table(spark, root, "incident_meta").select("incident_id").distinct().select("incident_id", F.lit("detection").alias("kind"))
    notes = events(spark, root).where(F.contains(F.lower("event_type"), F.lit("note")) & (F.col("command") != "")).select("incident_id", F.lit("note").alias("kind"))
    return found.unionByName(notes).groupBy("incident_id", "kind").agg(F.count(F.lit(1)).alias("n"))


_FLAT = ["run_id", "incident_key", "incident_type", "severity", "asset_criticality", "mode", "model_label", "violation_count", "hard_violation_count", "llm_action_count", "human_action_count", "enforced_action_count", "total_tokens", "latency_ms", "cost_usd"]


@query(f"WITH {S.ROWS} SELECT {', '.join(_FLAT)} FROM rows_")
def incident_row_flatten(spark, root):
    return runs(spark, root).select(*_FLAT)


@query(f"WITH {S.ROWS} SELECT model_label, count(*) AS n, min(split_part(model_label, '|', 1)) AS deployment, min(CASE WHEN contains(model_label, '|') THEN substr(model_label, instr(model_label, '|') + 1) ELSE 'human' END) AS arm FROM rows_ GROUP BY 1")
def split_label(spark, root):
    p = F.split("model_label", r"\|", 2)
    rows = runs(spark, root).groupBy("model_label").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("model_label", "n", p[0].alias("deployment"), F.coalesce(F.get(p, F.lit(1)), F.lit("human")).alias("arm"))


@query("SELECT action_id, concat_ws(', ', 'action=' || action_id, 'phase=' || phase, CASE WHEN requires_approval THEN 'approval' END, 'role=' || operational_role, CASE WHEN NOT reversible THEN 'final' END) AS line FROM action_catalog")
def rule_text_render(spark, root):
    c = table(spark, root, "action_catalog")
    parts = [F.concat(F.lit("action="), "action_id"), F.concat(F.lit("phase="), "phase"), F.when(F.col("requires_approval"), "approval"), F.concat(F.lit("role="), "operational_role"), F.when(~F.col("reversible"), "final")]
    return c.select("action_id", F.concat_ws(", ", *parts).alias("line"))


@query(f"WITH {S.EVENTS} SELECT event_id, coalesce('[' || substr(timestamp, 1, 19) || '] ', '') || event_type || coalesce(': ' || substr(command, 1, 80), '') AS line FROM ev")
def telemetry_lines(spark, root):
    return events(spark, root).select("event_id", normalize.event_line().alias("line"))


@query("SELECT DISTINCT event_id, CASE WHEN instr(details.command, 'Ledger') > 0 THEN substr(details.command, instr(details.command, 'Ledger')) ELSE details.command END AS path FROM telemetry WHERE details.command IS NOT NULL")
def path_relativize(spark, root):
    return table(spark, root, "telemetry").where("details.command is not null").select("event_id", normalize.relative_path("details.command", "Ledger").alias("path")).distinct()


@query("SELECT c.action_id, coalesce(h.approval_seen, c.requires_approval) AS approval FROM action_catalog c LEFT JOIN (SELECT action_id, bool_or(approval) AS approval_seen FROM human_actions GROUP BY 1) h USING (action_id)")
def lookup_refresh_names(spark, root):
    """Values of a lookup replace those of a table where it has them."""
    seen = table(spark, root, "human_actions").groupBy("action_id").agg(F.bool_or("approval").alias("seen"))
    return table(spark, root, "action_catalog").join(seen, "action_id", "left").select("action_id", F.coalesce("seen", "requires_approval").alias("approval"))


@query(r"SELECT DISTINCT doc_id, coalesce(nullif(trim(regexp_replace(source, '[^\p{L}\p{N}_-]', '_', 'g'), '_'), ''), 'unknown') || '_' || coalesce(nullif(trim(regexp_replace(lang, '[^\p{L}\p{N}_-]', '_', 'g'), '_'), ''), 'unknown') AS tag FROM documents")
def sanitize_tag(spark, root):
    return table(spark, root, "documents").select("doc_id", normalize.run_tag("source", "lang").alias("tag")).distinct()


# --- Filters and checks ------------------------------------------------------------------------

_SQL_SCOPE = {
    "Q1": f"{S.has_any('lower(event_type)', ['beacon', 'macro'])} AND {S.has_any(chr(34) + 'cat' + chr(34), ['command', 'malware'])}",
    "Q2": S.has_all("com", ["ref", "host_1"]),
    "Q9": f"{S.has_any('all_', ['crabshell'])} AND {S.has_any('sev', ['critical'])}",
}
_SCOPED = f"""{S.EVENTS},
sc AS (SELECT event_id, incident_id, event_type, lower(coalesce(category, '')) AS cat, lower(coalesce(command, '')) AS com, lower(coalesce(severity, '')) AS sev,
  lower(concat_ws(' ', (SELECT NULL), coalesce(raw, ''), coalesce(source_summary, ''), (coalesce(command_raw, '')))) AS all_ FROM (SELECT ev.*, t.c AS command_raw FROM ev JOIN (SELECT event_id AS eid, min(details.command) AS c FROM telemetry GROUP BY 1) t ON t.eid = ev.event_id)),
hit AS ({' UNION ALL '.join(f"SELECT event_id, incident_id, '{k}' AS rule_id FROM sc WHERE {v}" for k, v in _SQL_SCOPE.items())})"""
_MANDATORY = [r for r in RULES if r.kind == "mandatory"]


def scope_hits(spark: SparkSession, root: str) -> DataFrame:
    marks = F.array_compact(F.array(*[F.when(enforce.scope_predicate(r.scope), r.rule_id) for r in _MANDATORY]))
    return normalize.once(deliveries(spark, root).select("event_id", "incident_id", F.explode(marks).alias("rule_id")), "event_id", "rule_id")


@query(f"WITH {_SCOPED} SELECT event_id, rule_id FROM hit")
def scope_match_events(spark, root):
    return scope_hits(spark, root).select("event_id", "rule_id")


@query(f"WITH {_SCOPED} SELECT DISTINCT incident_id, rule_id FROM hit")
def scope_match_incidents(spark, root):
    return enforce.scope_flags(deliveries(spark, root), RULES).select("incident_id", F.explode("matched").alias("rule_id"))


@query(f"WITH {S.EVENTS} SELECT incident_id, bool_or({S.has_any('lower(event_type)', ['beacon', 'sweep'])} AND {S.has_all('lower(coalesce(command, chr(32)))', ['shift'])}) AS indicator FROM ev GROUP BY 1")
def legacy_indicator(spark, root):
    """Any event-type needle and all command needles; no event-type needle is no indicator."""
    hit = text.contains_any(F.lower("event_type"), ["beacon", "sweep"]) & text.contains_all(F.lower(F.coalesce("command", F.lit(" "))), ["shift"])
    return deliveries(spark, root).groupBy("incident_id").agg(F.bool_or(hit).alias("indicator"))


@query(f"WITH {S.CLEANED}, c AS (SELECT list(action_id) AS known FROM action_catalog) SELECT run_id, array_to_string(list_filter(llm_actions, lambda a: list_contains(known, a)), ',') AS kept FROM cleaned, c")
def catalog_filter(spark, root):
    known = F.array(*[F.lit(a) for a, _ in catalog(spark, root)])
    return runs(spark, root).select("run_id", F.array_join(enforce.in_catalog(F.col("llm_actions"), known), ",").alias("kept"))


@query("SELECT incident_id, array_to_string(list_filter([CASE WHEN NOT coalesce(severity IN ('low', 'medium', 'high', 'critical'), false) THEN 'severity' END, CASE WHEN NOT coalesce(asset_criticality IN ('low', 'medium', 'high', 'critical'), false) THEN 'criticality' END, CASE WHEN NOT coalesce(final_status <> '', false) THEN 'status' END], lambda x: x IS NOT NULL), ',') AS errors FROM (SELECT DISTINCT * FROM incident_meta)")
def validate_rows(spark, root):
    checks = {"severity": F.col("severity").isin(*audit.LEVELS), "criticality": F.col("asset_criticality").isin(*audit.LEVELS), "status": F.col("final_status") != ""}
    return audit.reject(table(spark, root, "incident_meta").distinct(), checks).select("incident_id", joined("errors").alias("errors"))


@query("SELECT incident_id, count(*) AS rows, count(*) FILTER (action_order IS NULL) AS missing, coalesce(count(*) FILTER (action_order IS NULL) = 0 AND count(DISTINCT action_order) = count(*) AND min(action_order) = 1 AND max(action_order) = count(*), false) AS valid FROM (SELECT DISTINCT * FROM human_actions) GROUP BY 1")
def validate_contiguous_order(spark, root):
    """Plans that were written twice are one plan."""
    return audit.contiguous_order(table(spark, root, "human_actions").distinct(), "incident_id", "action_order")


_WINDOWS = "SELECT row_id, 's' AS side, time_window_start AS value, reporting_source AS src FROM m UNION ALL SELECT row_id, 'e', time_window_end, reporting_source FROM m"


@query(f"""WITH m AS MATERIALIZED (SELECT *, row_number() OVER () AS row_id FROM (SELECT DISTINCT * FROM incident_meta)), {problem_sql.instants(_WINDOWS)},
i AS (SELECT row_id, max(instant_us) FILTER (side = 's') AS s, max(instant_us) FILTER (side = 'e') AS e FROM timed GROUP BY 1),
v AS (SELECT incident_id, count(DISTINCT event_id) AS events FROM telemetry GROUP BY 1),
a AS (SELECT incident_id, count(*) AS actions, count(*) FILTER (approval IS NULL) AS na FROM (SELECT DISTINCT * FROM human_actions) GROUP BY 1)
SELECT incident_id, coalesce(events, 0) AS events, coalesce(actions, 0) AS actions, array_to_string(list_filter([CASE WHEN coalesce(events, 0) = 0 THEN 'no_events' END, CASE WHEN coalesce(actions, 0) = 0 THEN 'no_actions' END,
  CASE WHEN coalesce(na, 0) > 0 THEN 'approval_missing' END, CASE WHEN NOT coalesce(severity IN ('low', 'medium', 'high', 'critical'), false) THEN 'bad_severity' END,
  CASE WHEN e < s THEN 'window_reversed' END, CASE WHEN s IS NULL OR e IS NULL THEN 'no_window' END], lambda x: x IS NOT NULL), ',') AS issues
FROM m JOIN i USING (row_id) LEFT JOIN v USING (incident_id) LEFT JOIN a USING (incident_id)""")
def incident_validation(spark, root):
    """All checks of incidents: against their events and actions, and of the instants of their windows."""
    zones = source_zones(table(spark, root, "log_sources"))
    meta = table(spark, root, "incident_meta").distinct()
    meta = with_instant(with_instant(meta, "time_window_start", "reporting_source", zones, "s"), "time_window_end", "reporting_source", zones, "e")
    ev = table(spark, root, "telemetry").select("incident_id", "event_id").distinct()
    out = audit.incident_issues(meta, table(spark, root, "human_actions").distinct(), ev, "s", "e")
    return out.select("incident_id", "events", "actions", joined("issues").alias("issues"))


@query("SELECT incident_id, count(*) AS rows, count(*) FILTER (approval IS NULL) AS approval_nulls, count(*) FILTER (action_order IS NULL) AS action_order_nulls, count(*) FILTER (timestamp IS NULL) AS timestamp_nulls FROM human_actions GROUP BY 1")
def null_audit_counts(spark, root):
    return audit.null_counts(table(spark, root, "human_actions"), ["approval", "action_order", "timestamp"], "incident_id")


_PII_SQL = rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, line_no, 'email' AS kind, nullif(regexp_extract(line, '{text.EMAIL}'), '') AS value FROM l
UNION ALL SELECT doc_id, line_no, 'ipv4', nullif(regexp_extract(line, '{text.IPV4}'), '') FROM l
UNION ALL SELECT doc_id, line_no, 'phone', CASE WHEN contains(lower(line), 'sha256') AND len(list_filter(regexp_extract_all(line, '{text.HEX_HASH}'), lambda h: contains(h, regexp_extract(line, '{text.PHONE}')))) > 0 THEN NULL ELSE nullif(regexp_extract(line, '{text.PHONE}'), '') END FROM l
{' '.join(f"UNION ALL SELECT doc_id, line_no, 'term', CASE WHEN contains(lower(line), '{t}') THEN '{t}' END FROM l" for t in TERMS)})
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, kind, value FROM h WHERE value IS NOT NULL AND NOT (kind = 'email' AND regexp_matches(value, '^user_[0-9]+@masked\.local$')) AND NOT (kind = 'ipv4' AND starts_with(value, '10.255.')) AND NOT (kind = 'phone' AND regexp_matches(value, '^<phone_[0-9]+>$'))"""


@query(_PII_SQL)
def pii_scan_lines(spark, root):
    return audit.personal_data(table(spark, root, "documents"), "doc_id", "text", terms=TERMS)


@query("SELECT run_id, array_to_string(list_distinct_first, ';') AS items FROM (SELECT run_id, list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda x: x IS NOT NULL AND x <> '') AS list_distinct_first FROM (SELECT run_id, list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: x <> '') AS a FROM (SELECT DISTINCT run_id, coalesce(array_to_string(llm_actions, ' , '), '') || ', ,' AS s FROM verifier_output)))")
def csv_list_parse(spark, root):
    made = table(spark, root, "verifier_output").select("run_id", F.concat(F.coalesce(F.array_join("llm_actions", " , "), F.lit("")), F.lit(", ,")).alias("s")).distinct()
    return made.select("run_id", F.array_join(normalize.csv_items("s"), ";").alias("items"))


@query("""WITH s(selector) AS (SELECT DISTINCT lower(trim(llm_deployment)) FROM verifier_output WHERE trim(llm_deployment) <> '' UNION SELECT name FROM model_registry),
r AS (SELECT s.selector, m.name, m.deployment, row_number() OVER (PARTITION BY s.selector ORDER BY m.name, m.deployment) AS rn FROM s LEFT JOIN model_registry m ON m.name = s.selector OR m.deployment = s.selector)
SELECT selector, coalesce(name, selector) AS name, coalesce(deployment, selector) AS deployment, name IS NULL AS ad_hoc FROM r WHERE rn = 1
UNION ALL SELECT 'enabled: ' || name, name, deployment, false FROM model_registry WHERE enabled""")
def select_with_fallback(spark, root):
    """Models by the names that runs and the registry use, the first that fits; and those that are enabled."""
    registry = table(spark, root, "model_registry")
    used = runs(spark, root).select(F.col("llm_deployment").alias("selector")).where("selector is not null").union(registry.select("name")).distinct()
    enabled = analysis.select_profiles(registry).withColumn("selector", F.concat(F.lit("enabled: "), "selector"))
    return analysis.select_profiles(registry, used).unionByName(enabled)


_RULE_VALUES = ", ".join(f"('{r.rule_id}', '{r.kind}', '{r.action}', {'NULL' if r.before is None else chr(39) + r.before + chr(39)}, '{r.severity}')" for r in RULES)


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.rule_id, r.kind, r.action, r.before, r.severity) for r in RULES], "rule_id string, kind string, action string, before string, severity string")


def _precedence(rules: str) -> str:
    """How far each action's prerequisites reach in a table of rules (action, before), and whether back to it; a path ends where it closes."""
    return f"""WITH RECURSIVE edge(a, b) AS (SELECT action, before FROM {rules} WHERE kind = 'prohibit_before' AND before IS NOT NULL),
path(a, b, hops) AS (SELECT a, b, 1 FROM edge UNION ALL SELECT p.a, e.b, p.hops + 1 FROM path p JOIN edge e ON p.b = e.a WHERE p.a <> p.b AND p.hops < (SELECT count(*) FROM edge))
SELECT a AS action, CAST(max(hops) AS INTEGER) AS depth, bool_or(a = b) AS cyclic FROM path GROUP BY a"""


@query(_precedence(f"(VALUES {_RULE_VALUES}) r(rule_id, kind, action, before, severity)"))
def rule_cycle_check(spark, root):
    """Walks the order rules as a table; a rule set with a cycle is refused before it is used."""
    enforce.check_rules(RULES)
    return spark.sql(_precedence("{rules}"), rules=rule_table(spark))


@query(f"WITH r(rule_id, kind, action, before, severity) AS (VALUES {_RULE_VALUES}) SELECT rule_id, action AS missing FROM r WHERE action NOT IN (SELECT action_id FROM action_catalog) UNION ALL SELECT rule_id, before FROM r WHERE before IS NOT NULL AND before NOT IN (SELECT action_id FROM action_catalog)")
def rules_not_in_catalog(spark, root):
    named = rule_table(spark).select("rule_id", F.explode(F.array_compact(F.array("action", "before"))).alias("missing"))
    return named.join(table(spark, root, "action_catalog").select(F.col("action_id").alias("missing")), "missing", "left_anti").select("rule_id", "missing")


@query(f"WITH {S.RUNS}, u AS (SELECT DISTINCT unnest(llm_actions) AS action FROM runs) SELECT action, CASE WHEN c.action_id IS NULL THEN 'error' WHEN coalesce(c.phase, '') = '' THEN 'warning' ELSE 'ok' END AS verdict FROM u LEFT JOIN action_catalog c ON c.action_id = u.action WHERE action IS NOT NULL")
def mapping_validation(spark, root):
    used = runs(spark, root).select(F.explode("llm_actions").alias("action")).where("action is not null").distinct()
    c = table(spark, root, "action_catalog").select(F.col("action_id").alias("action"), F.lit(True).alias("known"), "phase")
    verdict = F.when(F.col("known").isNull(), "error").when(F.coalesce("phase", F.lit("")) == "", "warning").otherwise("ok")
    return used.join(c, "action", "left").select("action", verdict.alias("verdict"))


@query("SELECT DISTINCT event_id, coalesce(CAST(trunc(TRY_CAST(regexp_extract(details.command, '([0-9.]+)$', 1) AS DOUBLE)) AS BIGINT), 0) AS n FROM telemetry")
def safe_cast(spark, root):
    """A number at the end of a text, 0 where there is none."""
    value = F.regexp_extract("details.command", "([0-9.]+)$", 1).try_cast("double").try_cast("bigint")
    return table(spark, root, "telemetry").select("event_id", F.coalesce(value, F.lit(0)).alias("n")).distinct()


@query("SELECT doc_id, regexp_matches(text, 'host_[0-9]{4}') AS host, regexp_matches(text, 'INC_OPS_[0-9]+') AS incident, contains(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL")
def text_marker_scan(spark, root):
    d = table(spark, root, "documents").where("text is not null")
    return d.select("doc_id", F.col("text").rlike("host_[0-9]{4}").alias("host"), F.col("text").rlike("INC_OPS_[0-9]+").alias("incident"), F.contains("text", F.lit("\n")).alias("lines"))


# --- Joins -------------------------------------------------------------------------------------


@query(f"WITH {S.RUNS}, u AS (SELECT run_id, unnest(llm_actions) AS action FROM runs) SELECT run_id, action, requires_approval, count(*) AS n FROM u JOIN action_catalog ON action_id = action GROUP BY ALL")
def join_plan_catalog(spark, root):
    plan = runs(spark, root).select("run_id", F.explode("llm_actions").alias("action"))
    c = table(spark, root, "action_catalog").select(F.col("action_id").alias("action"), "requires_approval")
    return plan.join(c, "action").groupBy("run_id", "action", "requires_approval").agg(F.count(F.lit(1)).alias("n"))


def _technique_sql() -> str:
    parts = []
    for r in TECHNIQUES:
        score, signals = str(r.weights[0]), ["'event_type'"]
        for name, needles, w in (("command", r.command, r.weights[1]), ("category", r.category, r.weights[2]), ("source_type", r.source_type, r.weights[3])):
            if needles:
                low = f"lower(coalesce({name}, ''))"
                score += f" + CASE WHEN {S.has_any(low, list(needles))} THEN {w} ELSE 0.0 END"
                signals += [f"CASE WHEN contains({low}, '{n.lower()}') THEN '{name}:{n}' END" for n in needles]
        parts.append(
            f"SELECT event_id, incident_id, event_type, command, '{r.rule_id}' AS rule_id, '{r.technique_id}' AS technique_id, '{r.tactic_id}' AS tactic_id, {r.least} AS least_, least(round(CAST({score} AS DOUBLE), 3), 1.0) AS score, "
            f"list_filter([{', '.join(signals)}], lambda x: x IS NOT NULL) AS signals FROM ev WHERE {S.has_any('lower(event_type)', list(r.event_type))}"
        )
    return f"{S.EVENTS}, cand AS ({' UNION ALL '.join(parts)})"


_CAND = _technique_sql()


def found_techniques(spark: SparkSession, root: str) -> DataFrame:
    """Candidates are few beside the events, so deliveries of an event are told apart among them."""
    asked = deliveries(spark, root).select("event_id", "incident_id", "event_type", "command", "category", "source_type")
    return normalize.once(matching.candidates(asked, TECHNIQUES), "event_id", "rule_id")


@query(f"WITH {_CAND} SELECT event_id, rule_id, score FROM cand")
def attack_theta_join(spark, root):
    return found_techniques(spark, root).select("event_id", "rule_id", "score")


@query(f"WITH {_CAND} SELECT event_id, rule_id, technique_id, score, array_to_string(signals, ', ') || ' | ' || coalesce(nullif(substr(command, 1, 120), ''), event_type) AS evidence FROM cand WHERE score >= least_")
def attack_matches(spark, root):
    return matching.matches(found_techniques(spark, root)).select("event_id", "rule_id", "technique_id", "score", matching.evidence().alias("evidence"))


def _ranked_sql() -> str:
    rows = []
    for r in TEXT_RULES:
        hits = " + ".join(f"CASE WHEN contains(t, '{k}') THEN 1 ELSE 0 END" for k in r.keywords)
        score = f"CASE WHEN {hits} = {len(r.keywords)} THEN {hits} ELSE 0 END" if r.every else hits
        rows.append(f"SELECT doc_id, {score} AS score, {r.priority} AS priority, {hits} AS hits, '{r.action_id}' AS action_id FROM d")
    return f"""d AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g')) AS t FROM documents),
m AS (SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE score > 0),
k AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS s2, lead(priority) OVER w AS p2 FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, priority DESC, hits DESC, action_id DESC)),
v AS (SELECT d.doc_id, CASE WHEN k.doc_id IS NULL THEN 'zero' WHEN s2 = score AND p2 = priority THEN 'ambiguous' WHEN hits = 1 THEN 'single' ELSE 'multi' END AS verdict, k.score, k.action_id AS best FROM d LEFT JOIN k ON k.doc_id = d.doc_id AND rn = 1)"""


_RANKED = _ranked_sql()


def classified(spark: SparkSession, root: str) -> DataFrame:
    return matching.ranked_rules(table(spark, root, "documents").select("doc_id", "source", text.match_form("text").alias("t")), "t", TEXT_RULES)


@query(f"WITH {_RANKED} SELECT doc_id, verdict, CASE WHEN verdict IN ('single', 'multi') THEN best END AS action_id FROM v")
def map_task_best_rule(spark, root):
    return classified(spark, root).select("doc_id", "verdict", "action_id")


@query(f"WITH {_RANKED} SELECT doc_id, CAST(coalesce(score, 0) AS INTEGER) AS score FROM v")
def keyword_score(spark, root):
    return classified(spark, root).select("doc_id", F.coalesce(F.get("ranked", F.lit(0))["score"], F.lit(0)).alias("score"))


@query(f"WITH {_RANKED} SELECT doc_id FROM v WHERE verdict = 'ambiguous'")
def tie_detection(spark, root):
    return classified(spark, root).where("verdict = 'ambiguous'").select("doc_id")


@query(f"WITH {_RANKED} SELECT verdict, count(*) AS n FROM v GROUP BY 1")
def classify_support(spark, root):
    return classified(spark, root).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_RANKED} SELECT best AS action_id, count(*) AS n, count(*) FILTER (verdict = 'single') AS single, count(*) FILTER (verdict = 'multi') AS multi FROM v WHERE verdict IN ('single', 'multi') GROUP BY 1")
def mapping_support_by_action(spark, root):
    one = classified(spark, root).where("action_id is not null")
    return one.groupBy("action_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "single").alias("single"), F.count_if(F.col("verdict") == "multi").alias("multi"))


@query("SELECT doc_id, " + "CASE " + " ".join(f"WHEN {S.has_any(chr(108) + 'ower(coalesce(text, ' + chr(39) * 2 + '))', list(r.keywords))} THEN '{r.action_id}'" for r in TEXT_RULES) + " END AS action_id FROM documents")
def first_match_mapping(spark, root):
    return table(spark, root, "documents").select("doc_id", matching.first_match("text", TEXT_RULES).alias("action_id"))


@query(f"WITH {_SCOPED}, {S.RUNS} SELECT run_id FROM runs WHERE incident_id IN (SELECT incident_id FROM hit WHERE rule_id = 'Q1')")
def semi_scope(spark, root):
    hit = scope_hits(spark, root).where("rule_id = 'Q1'").select("incident_id").distinct()
    return latest_copy(table(spark, root, "verifier_output").select("run_id", "incident_id"), "run_id").join(hit, "incident_id", "left_semi").select("run_id")


@query(f"WITH {_SCOPED}, {S.RUNS} SELECT DISTINCT run_id, rule_id FROM runs JOIN hit USING (incident_id) WHERE NOT coalesce(list_contains(llm_actions, CASE rule_id WHEN 'Q1' THEN 'snapshot_memory' WHEN 'Q2' THEN 'notify_data_owner' ELSE 'isolate_everything' END), false)")
def anti_missing_mandatory(spark, root):
    """Mandatory actions that are due in a run's incident and absent from its plan."""
    due = enforce.scope_flags(deliveries(spark, root), RULES).select("incident_id", F.explode("matched").alias("rule_id"))
    rule = F.create_map(*[x for r in _MANDATORY for x in (F.lit(r.rule_id), F.lit(r.action))])
    plans = latest_copy(table(spark, root, "verifier_output").select("run_id", "incident_id", "llm_actions"), "run_id")
    out = plans.join(due, "incident_id")
    return out.where(~F.coalesce(F.array_contains("llm_actions", rule[F.col("rule_id")]), F.lit(False))).select("run_id", "rule_id")


@query(f"WITH {S.CLEANED}, u AS (SELECT DISTINCT run_id, approved, unnest(llm_actions) AS action FROM cleaned) SELECT run_id, action FROM u JOIN action_catalog ON action_id = action AND requires_approval WHERE NOT list_contains(approved, action)")
def anti_unapproved(spark, root):
    v = latest_copy(table(spark, root, "verifier_output").select("run_id", "llm_actions", "incident_approved_actions"), "run_id")
    plan = v.select("run_id", F.explode(F.array_distinct("llm_actions")).alias("action"))
    gated = table(spark, root, "action_catalog").where("requires_approval").select(F.col("action_id").alias("action"))
    approved = v.select("run_id", F.explode("incident_approved_actions").alias("action"))
    return plan.join(gated, "action").join(approved, ["run_id", "action"], "left_anti").select("run_id", "action")


_ERF_Z, _ERF_M = S.erf("abs(z_score_) / sqrt(2.0)"), S.erf("sqrt(chi / 2)")
_PAIRS = f"""{S.LATEST},
p AS (SELECT a.model_label AS model_a, b.model_label AS model_b, count(*) AS paired, count(*) FILTER (a.violation_count > 0) AS violating_a, count(*) FILTER (b.violation_count > 0) AS violating_b,
  count(*) FILTER (a.violation_count > 0 AND b.violation_count = 0) AS only_a, count(*) FILTER (a.violation_count = 0 AND b.violation_count > 0) AS only_b
  FROM latest a JOIN latest b ON a.incident_key = b.incident_key AND a.model_label < b.model_label GROUP BY 1, 2),
q AS (SELECT *, violating_a / paired AS ra, violating_b / paired AS rb, (violating_a + violating_b) / (2.0 * paired) AS pool, CASE WHEN only_a + only_b = 0 THEN 0.0 ELSE (abs(only_a - only_b) - 1) ** 2 / (only_a + only_b) END AS chi FROM p),
z AS (SELECT *, CASE WHEN pool * (1 - pool) <= 0 THEN 0.0 ELSE (ra - rb) / sqrt(pool * (1 - pool) * 2.0 / paired) END AS z_score_ FROM q),
t AS (SELECT *, round(greatest(0.0, least(1.0, 1 - {_ERF_Z})), 6) AS p_value, CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE round(greatest(0.0, least(1.0, 1 - {_ERF_M})), 6) END AS mcnemar_p FROM z),
h AS (SELECT *, row_number() OVER (ORDER BY p_value, model_a, model_b) AS k1, row_number() OVER (ORDER BY mcnemar_p, model_a, model_b) AS k2, count(*) OVER () AS m FROM t),
out_ AS (SELECT model_a, model_b, paired, violating_a, violating_b, only_a, only_b, round(ra, 4) AS rate_a, round(rb, 4) AS rate_b, round(ra - rb, 4) AS rate_diff, round(z_score_, 6) AS z_score, p_value,
  round(2 * (asin(sqrt(ra)) - asin(sqrt(rb))), 6) AS cohens_h, round((only_a - only_b) / paired, 6) AS cliffs_delta, round(chi, 6) AS mcnemar_chi2, mcnemar_p,
  round(max(least(1.0, (m - k1 + 1) * p_value)) OVER (ORDER BY k1 ROWS UNBOUNDED PRECEDING), 6) AS p_value_holm, round(max(least(1.0, (m - k2 + 1) * mcnemar_p)) OVER (ORDER BY k2 ROWS UNBOUNDED PRECEDING), 6) AS mcnemar_p_holm FROM h)"""


@query(f"WITH {_PAIRS} SELECT * FROM out_")
def pairwise_self_join(spark, root):
    return analysis.pairwise(analysis.latest_runs(runs(spark, root).select("incident_key", "model_label", "run_tag", "run_id", "violation_count")))


@query("SELECT incident_id, i.severity, coalesce(a.n, 0) AS actions FROM (SELECT DISTINCT * FROM incident_meta) i LEFT JOIN (SELECT incident_id, count(*) AS n FROM human_actions GROUP BY 1) a USING (incident_id)")
def left_lookup_quality(spark, root):
    n = table(spark, root, "human_actions").groupBy("incident_id").agg(F.count(F.lit(1)).alias("actions"))
    return table(spark, root, "incident_meta").distinct().join(n, "incident_id", "left").select("incident_id", "severity", F.coalesce("actions", F.lit(0)).alias("actions"))


@query(f"WITH {S.CLEANED}, r(rule_id, a, b) AS (VALUES ('Q3', 'reimage_endpoint', 'snapshot_memory'), ('Q4', 'snapshot_memory', 'preserve_proxy_logs'), ('Q5', 'rejoin_network', 'revoke_sessions')) SELECT run_id, rule_id FROM cleaned, r WHERE list_contains(llm_actions, a) AND (NOT list_contains(llm_actions, b) OR list_position(llm_actions, b) > list_position(llm_actions, a))")
def order_violation_join(spark, root):
    """Plans in which an action comes without, or before, what has to precede it: positions per plan, no self-join."""
    made = []
    for r in RULES:
        if r.before:
            at, need = F.array_position("llm_actions", r.action), F.array_position("llm_actions", r.before)
            made.append(F.when((at > 0) & ((need == 0) | (need > at)), r.rule_id))
    return runs(spark, root).select("run_id", F.explode(F.array_compact(F.array(*made))).alias("rule_id"))


@query("SELECT action_id, requires_approval AS approval, 'catalog' AS origin FROM action_catalog WHERE phase IS NOT NULL UNION ALL SELECT action_id, bool_or(approval), 'plans' FROM human_actions WHERE action_id IS NOT NULL AND action_id NOT IN (SELECT action_id FROM action_catalog WHERE phase IS NOT NULL) GROUP BY 1")
def overlay_merge(spark, root):
    main = table(spark, root, "action_catalog").where("phase is not null").select("action_id", F.col("requires_approval").alias("approval"), F.lit("catalog").alias("origin"))
    other = table(spark, root, "human_actions").where("action_id is not null").groupBy("action_id").agg(F.bool_or("approval").alias("approval")).withColumn("origin", F.lit("plans"))
    return normalize.overlay(main, other, ["action_id"])


@query(f"WITH {S.ROWS} SELECT run_id, violation_count AS made, runs.metrics.violation_count AS declared, coalesce(abs(rows_.violation_count - runs.metrics.violation_count) <= 0, false) AS ok FROM rows_ JOIN runs USING (run_id)")
def recompute_vs_declared(spark, root):
    declared = latest_copy(table(spark, root, "verifier_output").select("run_id", F.col("metrics.violation_count").alias("violation_count")), "run_id")
    return stability.conformance(runs(spark, root), declared, ["run_id"], "violation_count", 0)


_SPARE = f"""{S.ROWS},
s AS (SELECT incident_key, run_id AS slot_run, row_number() OVER (PARTITION BY incident_key ORDER BY run_id) AS k FROM rows_ WHERE llm_action_count = 0),
o AS (SELECT incident_key, run_id AS spare_run, row_number() OVER (PARTITION BY incident_key ORDER BY run_tag, run_id) AS k FROM rows_ WHERE llm_action_count > 4)"""


@query(f"WITH {_SPARE} SELECT incident_key, slot_run, spare_run FROM s JOIN o USING (incident_key, k)")
def zip_slots(spark, root):
    rows = runs(spark, root).select("incident_key", "run_id", "run_tag", "llm_action_count")
    slots = rows.where("llm_action_count = 0").select("incident_key", F.col("run_id").alias("slot_run"))
    spare = rows.where("llm_action_count > 4").select("incident_key", F.col("run_id").alias("spare_run"), "run_tag")
    return stability.fill_slots(slots, spare, ["incident_key"], ["slot_run"], ["run_tag", "spare_run"]).select("incident_key", "slot_run", "spare_run")


@query(f"WITH r(rule_id, kind, action, before, severity) AS (VALUES {_RULE_VALUES}), a AS (SELECT action_id, count(*) AS uses, count(DISTINCT incident_id) AS incidents, count(*) FILTER (approval) AS approved FROM (SELECT DISTINCT * FROM human_actions) GROUP BY 1) SELECT c.action_id, requires_approval, coalesce(uses, 0) AS uses, coalesce(incidents, 0) AS incidents, coalesce(approved, 0) AS approved, coalesce(x.rules, '') AS rules FROM action_catalog c LEFT JOIN a USING (action_id) LEFT JOIN (SELECT action AS action_id, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM r GROUP BY 1) x USING (action_id)")
def catalog_provenance(spark, root):
    stats_ = audit.action_stats(table(spark, root, "human_actions").distinct())
    return audit.provenance(table(spark, root, "action_catalog"), stats_, rule_table(spark)).select("action_id", "requires_approval", "uses", "incidents", "approved", "rules")


@query(f"WITH {_SCOPED}, {S.CLEANED} SELECT rule_id, count(DISTINCT incident_id) AS incidents FROM hit GROUP BY 1 UNION ALL SELECT 'Q' || i, count(DISTINCT incident_key) FROM cleaned, (VALUES (3, 'reimage_endpoint'), (4, 'snapshot_memory'), (5, 'rejoin_network'), (6, 'quarantine_endpoint'), (7, 'suspend_account'), (8, 'snapshot_memory')) r(i, a) WHERE list_contains(human_actions, a) GROUP BY 1")
def rule_applicability(spark, root):
    """In how many incidents a rule can apply: mandatory rules by scope, others by the action in the human plan."""
    by_scope = enforce.scope_flags(deliveries(spark, root), RULES).select(F.explode("matched").alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("incidents"))
    named = F.array_compact(F.array(*[F.when(F.array_contains("human_actions", r.action), r.rule_id) for r in RULES if r.kind != "mandatory"]))
    by_plan = runs(spark, root).select("incident_key", F.explode(named).alias("rule_id")).groupBy("rule_id").agg(F.count_distinct("incident_key").alias("incidents"))
    return by_scope.unionByName(by_plan)


# --- Aggregates --------------------------------------------------------------------------------


def _counter(name: str, column: str):
    def run(spark, root):
        return analysis.violation_rows(runs(spark, root)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))

    run.__name__ = name
    query(f"WITH {S.CLEANED} SELECT v.{column} AS {column}, count(*) AS n FROM (SELECT unnest(violations) AS v FROM cleaned) GROUP BY 1")(run)


for _n, _col in (("violations_by_rule", "rule_id"), ("violations_by_type", "type"), ("violations_by_severity", "severity")):
    _counter(_n, _col)


@query(f"WITH {S.CLEANED} SELECT mode, count(*) AS n FROM cleaned GROUP BY 1")
def mode_counts(spark, root):
    return runs(spark, root).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def _rates(name: str, key: str):
    def run(spark, root):
        return analysis.violation_rate_by(runs(spark, root), key)

    run.__name__ = name
    query(f"WITH {S.ROWS} SELECT {key}, count(*) AS support, count(*) FILTER (violation_count > 0) AS violating, {S.rate('count(*) FILTER (violation_count > 0)', 'count(*)')} AS violation_rate FROM rows_ GROUP BY 1")(run)


for _n, _col in (("violation_rate_by_type", "incident_type"), ("violation_rate_by_severity", "severity"), ("violation_rate_by_criticality", "asset_criticality")):
    _rates(_n, _col)


@query(f"WITH {_CAND}, {S.ROWS}, t AS (SELECT DISTINCT incident_id, tactic_id FROM cand WHERE score >= least_) SELECT tactic_id, count(*) AS support, count(*) FILTER (violation_count > 0) AS violating, {S.rate('count(*) FILTER (violation_count > 0)', 'count(*)')} AS violation_rate FROM rows_ JOIN t ON t.incident_id = rows_.incident_key GROUP BY 1")
def violation_rate_by_tactic(spark, root):
    tactics = matching.matches(found_techniques(spark, root)).select(F.col("incident_id").alias("incident_key"), "tactic_id").distinct()
    return analysis.violation_rate_by(runs(spark, root).select("incident_key", "violation_count").join(tactics, "incident_key"), "tactic_id")


_WILSON = "(k / n + 3.841458820694124 / (2 * n) {s} 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n)"
_LOW, _HIGH = f"round(greatest(0.0, {_WILSON.format(s='-')}), 4)", f"round(least(1.0, {_WILSON.format(s='+')}), 4)"
_SUMS = ["violation_count", "hard_violation_count", "soft_violation_count", "warning_violation_count", "inserted_count", "removed_count", "deferred_count", "reordered_count", "modification_count", "llm_only_action_count", "human_only_action_count", "prompt_tokens", "completion_tokens", "total_tokens", "latency_ms"]
_MEANS = ["precision_raw", "recall_raw", "f1_raw", "jaccard_raw", "precision_enforced", "recall_enforced", "f1_enforced", "jaccard_enforced", "delta_jaccard", "coverage_delta"]


@query(f"WITH {S.LATEST}, g AS (SELECT model_label, count(*) AS n, count(*) FILTER (violation_count > 0) AS k, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}_total' for c in _SUMS)}, CAST(round(sum(CAST(cost_usd AS DECIMAL(18, 6))), 4) AS DOUBLE) AS cost_usd_total, {', '.join(f'round(avg({c}) + sign(avg({c})) * 1e-9, 4) AS {c}_avg' for c in _MEANS)}, count(*) FILTER (coverage_delta < 0) AS coverage_drop_runs, count(*) FILTER (modification_count > 0) AS modified_runs FROM latest GROUP BY 1) SELECT * EXCLUDE (n, k), n AS run_count, k AS runs_with_violations, {S.rate('k', 'n')} AS violation_rate, {_LOW} AS ci_low, {_HIGH} AS ci_high FROM g")
def by_model(spark, root):
    return analysis.by_model(analysis.latest_runs(runs(spark, root)))


@query(f"WITH {S.ROWS} SELECT model_label, v.rule_id AS rule_id, count(*) AS violation_count, count(*) FILTER (v.severity = 'hard') AS hard_violation_count FROM (SELECT model_label, unnest(violations) AS v FROM rows_) GROUP BY 1, 2")
def by_rule(spark, root):
    return analysis.by_rule(runs(spark, root))


@query(f"""WITH {S.ROWS}, o AS (SELECT * FROM rows_ WHERE llm_deployment IS NOT NULL AND llm_arm IN ('llm_zero', 'llm_policy_prompt')),
n AS (SELECT llm_deployment AS model, count(*) FILTER (llm_arm = 'llm_zero') AS a, count(*) FILTER (llm_arm = 'llm_policy_prompt') AS b FROM o GROUP BY 1),
v AS (SELECT DISTINCT run_id, llm_deployment AS model, llm_arm, unnest(list_transform(violations, lambda x: x.rule_id)) AS rule_id FROM o),
c AS (SELECT model, rule_id, count(*) FILTER (llm_arm = 'llm_zero') AS x, count(*) FILTER (llm_arm = 'llm_policy_prompt') AS y FROM v GROUP BY 1, 2)
SELECT rule_id, model, a AS llm_zero_runs, b AS llm_policy_prompt_runs, x AS llm_zero_violations, y AS llm_policy_prompt_violations, round(x / a, 4) AS llm_zero_rate, round(y / b, 4) AS llm_policy_prompt_rate, round(round(x / a, 4) - round(y / b, 4), 4) AS rate_diff FROM c JOIN n USING (model) WHERE a > 0 AND b > 0""")
def by_rule_treatment(spark, root):
    return analysis.by_rule_treatment(runs(spark, root))


@query(f"WITH {S.ROWS}, g AS (SELECT count(*) AS runs, count(DISTINCT incident_key) AS incidents, count(DISTINCT model_label) AS models, CAST(sum(violation_count) AS BIGINT) AS violations, CAST(sum(hard_violation_count) AS BIGINT) AS hard_violations, count(*) FILTER (violation_count > 0) AS violating_runs, count(DISTINCT incident_key) FILTER (violation_count > 0) AS violating_incidents, round(avg(llm_action_count), 4) AS llm_actions_avg, round(avg(human_action_count), 4) AS human_actions_avg, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM rows_) SELECT *, {S.rate('violating_runs', 'runs')} AS run_violation_rate, {S.rate('violating_incidents', 'incidents')} AS incident_violation_rate FROM g")
def summary(spark, root):
    return analysis.summary(runs(spark, root))


@query(f"WITH {S.CLEANED} SELECT action, count(*) AS n FROM (SELECT unnest({S.minus('llm_actions', 'human_actions')}) AS action FROM cleaned) GROUP BY 1")
def llm_only_actions(spark, root):
    return analysis.action_difference(runs(spark, root), "llm_actions", "human_actions")


@query(f"WITH {S.CLEANED} SELECT action, count(*) AS n FROM (SELECT unnest({S.minus('human_actions', 'llm_actions')}) AS action FROM cleaned) GROUP BY 1")
def human_only_actions(spark, root):
    return analysis.action_difference(runs(spark, root), "human_actions", "llm_actions")


@query(f"WITH {_CAND} SELECT incident_id, count(*) AS candidates, count(*) FILTER (score >= least_) AS matches, greatest(count(*) - count(*) FILTER (score >= least_), 0) AS gap FROM cand GROUP BY 1")
def attack_unique_totals(spark, root):
    c = found_techniques(spark, root).groupBy("incident_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("score") >= F.col("least")).alias("matches"))
    return c.withColumn("gap", F.greatest(F.col("candidates") - F.col("matches"), F.lit(0)))


@query(f"WITH {_CAND} SELECT incident_id, count(*) AS matches, count(*) FILTER (score >= 0.8) AS high_confidence, string_agg(DISTINCT technique_id, ',' ORDER BY technique_id) AS techniques, string_agg(DISTINCT tactic_id, ',' ORDER BY tactic_id) AS tactics FROM cand WHERE score >= least_ GROUP BY 1")
def attack_context(spark, root):
    ids = {n: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(n) for n, c in (("techniques", "technique_id"), ("tactics", "tactic_id"))}
    found = matching.matches(found_techniques(spark, root)).groupBy("incident_id")
    return found.agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("score") >= 0.8).alias("high_confidence"), ids["techniques"], ids["tactics"])


@query(f"WITH {_CAND} SELECT technique_id, count(*) AS candidates, count(DISTINCT incident_id) AS incidents, round(avg(score), 3) AS score_avg FROM cand GROUP BY 1")
def attack_candidates(spark, root):
    return found_techniques(spark, root).groupBy("technique_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct("incident_id").alias("incidents"), F.round(F.avg("score"), 3).alias("score_avg"))


_METRICS = ["run_id", "soft_violation_count", "warning_violation_count", "inserted_count", "removed_count", "deferred_count", "reordered_count", "modification_count", "llm_only_action_count", "human_only_action_count", "precision_raw", "recall_raw", "f1_raw", "jaccard_raw", "precision_enforced", "recall_enforced", "f1_enforced", "jaccard_enforced", "delta_jaccard", "coverage_delta"]


@query(f"WITH {S.ROWS} SELECT {', '.join(_METRICS)} FROM rows_")
def incident_metrics(spark, root):
    return runs(spark, root).select(*_METRICS)


@query("""WITH e AS (SELECT incident_id, count(DISTINCT event_id) AS n FROM telemetry GROUP BY 1), a AS (SELECT incident_id, count(*) AS n FROM (SELECT DISTINCT * FROM human_actions) GROUP BY 1),
m AS (SELECT i.incident_id, coalesce(e.n, 0) AS ev, coalesce(a.n, 0) AS ac FROM (SELECT DISTINCT incident_id FROM incident_meta) i LEFT JOIN e USING (incident_id) LEFT JOIN a USING (incident_id))
SELECT count(*) AS incidents, CAST(sum(ev) AS BIGINT) AS events, min(ev) AS events_min, max(ev) AS events_max, round(avg(ev), 4) AS events_avg, CAST(sum(ac) AS BIGINT) AS actions, count(*) FILTER (ac > 0) AS with_actions FROM m""")
def corpus_readiness(spark, root):
    e = table(spark, root, "telemetry").groupBy("incident_id").agg(F.count_distinct("event_id").alias("ev"))
    a = table(spark, root, "human_actions").distinct().groupBy("incident_id").agg(F.count(F.lit(1)).alias("ac"))
    m = table(spark, root, "incident_meta").select("incident_id").distinct().join(e, "incident_id", "left").join(a, "incident_id", "left").fillna(0, ["ev", "ac"])
    return m.agg(
        F.count(F.lit(1)).alias("incidents"), F.sum("ev").alias("events"), F.min("ev").alias("events_min"), F.max("ev").alias("events_max"),
        F.round(F.avg("ev"), 4).alias("events_avg"), F.sum("ac").alias("actions"), F.count_if(F.col("ac") > 0).alias("with_actions"),
    )


@query("SELECT action_id, count(*) AS uses, count(DISTINCT incident_id) AS incidents, count(*) FILTER (approval) AS approved FROM (SELECT DISTINCT * FROM human_actions) GROUP BY 1")
def action_stats(spark, root):
    return audit.action_stats(table(spark, root, "human_actions").distinct())


@query(f"WITH {S.ROWS} SELECT llm_deployment, llm_arm, count(*) AS runs, round(avg(violation_count), 4) AS violations_avg, round(avg(recall_enforced), 4) AS coverage_avg FROM rows_ GROUP BY 1, 2")
def recheck_model_metrics(spark, root):
    return runs(spark, root).groupBy("llm_deployment", "llm_arm").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("violation_count"), 4).alias("violations_avg"), F.round(F.avg("recall_enforced"), 4).alias("coverage_avg"))


_REPEATS = f"""{S.ROWS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY incident_key, model_label ORDER BY run_tag, run_id) AS INTEGER) AS repeat_ FROM rows_),
m AS (SELECT model_label, repeat_, count(*) AS runs, avg(CASE WHEN violation_count > 0 THEN 1.0 ELSE 0.0 END) AS rate FROM r GROUP BY 1, 2)"""


def repeats(spark: SparkSession, root: str) -> DataFrame:
    return stability.repeat_index(runs(spark, root).select("incident_key", "model_label", "run_tag", "run_id", "violation_count"), ["incident_key", "model_label"], ["run_tag", "run_id"])


@query(f"WITH {_REPEATS} SELECT model_label, repeat_ AS repeat, runs, round(rate, 6) AS rate FROM m")
def metric_series(spark, root):
    flag = F.when(F.col("violation_count") > 0, 1.0).otherwise(0.0)
    return repeats(spark, root).groupBy("model_label", "repeat").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg(flag), 6).alias("rate"))


@query(f"WITH {_REPEATS} SELECT model_label, count(rate) AS n, round(avg(rate), 6) AS mean, round(min(rate), 6) AS smallest, round(max(rate), 6) AS largest, round(max(rate) - min(rate), 6) AS spread FROM m GROUP BY 1")
def repeat_stability_by_model(spark, root):
    flag = F.when(F.col("violation_count") > 0, 1.0).otherwise(0.0)
    series = repeats(spark, root).groupBy("model_label", "repeat").agg(F.avg(flag).alias("rate"))
    return stability.metric_series(series, ["model_label"], "rate").withColumns({c: F.round(c, 6) for c in ("smallest", "largest")})


@query("SELECT coalesce(nullif(trim(upper(details.severity)), ''), 'NONE') AS kind, count(*) AS n, count(DISTINCT incident_id) AS incidents, count(*) FILTER (contains(lower(event_type), 'fail')) AS failures FROM telemetry GROUP BY 1")
def failure_summary(spark, root):
    kind = F.coalesce(F.nullif(F.trim(F.upper("details.severity")), F.lit("")), F.lit("NONE"))
    return table(spark, root, "telemetry").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("incident_id").alias("incidents"), F.count_if(F.contains(F.lower("event_type"), F.lit("fail"))).alias("failures"))


@query(f"WITH {S.ROWS} SELECT count(DISTINCT llm_deployment) AS models, count(DISTINCT llm_arm) AS arms, count(DISTINCT incident_key) AS incidents, count(DISTINCT llm_deployment) * count(DISTINCT llm_arm) * count(DISTINCT incident_key) AS planned, count(DISTINCT CASE WHEN llm_deployment IS NOT NULL AND llm_arm IS NOT NULL THEN llm_deployment || '|' || llm_arm || '|' || incident_key END) AS done FROM rows_")
def experiment_coverage(spark, root):
    rows = runs(spark, root).select("llm_deployment", "llm_arm", "incident_key").distinct()
    cell = F.when(F.col("llm_deployment").isNotNull() & F.col("llm_arm").isNotNull(), F.concat_ws("|", "llm_deployment", "llm_arm", "incident_key"))
    out = rows.agg(F.count_distinct("llm_deployment").alias("models"), F.count_distinct("llm_arm").alias("arms"), F.count_distinct("incident_key").alias("incidents"), F.count_distinct(cell).alias("done"))
    return out.withColumn("planned", F.col("models") * F.col("arms") * F.col("incidents"))


@query(f"WITH {S.ROWS}, g AS (SELECT approval_policy_mode AS m, avg(enforced_action_count) AS e, avg(recall_enforced) AS r, count(*) AS n FROM rows_ GROUP BY 1), o AS (SELECT * FROM g WHERE m = 'remove'), d AS (SELECT * FROM g WHERE m <> 'remove') SELECT d.m AS mode, d.n AS runs, round(d.e - o.e, 6) AS enforced_delta, round(d.r - o.r, 6) AS coverage_delta FROM d, o")
def approval_mode_sensitivity(spark, root):
    """How means differ from those of the mode remove; the aggregate has a row per mode."""
    g = runs(spark, root).groupBy(F.col("approval_policy_mode").alias("mode")).agg(F.avg("enforced_action_count").alias("e"), F.avg("recall_enforced").alias("r"), F.count(F.lit(1)).alias("runs"))
    base = Window.partitionBy(F.lit(0))
    e0, r0 = (F.max(F.when(F.col("mode") == "remove", F.col(c))).over(base) for c in ("e", "r"))
    return g.select("mode", "runs", F.round(F.col("e") - e0, 6).alias("enforced_delta"), F.round(F.col("r") - r0, 6).alias("coverage_delta")).where("mode <> 'remove'")


@query(f"WITH {S.ROWS} SELECT llm_arm, count(*) AS runs, CAST(sum(violation_count) AS BIGINT) AS violations, round(avg(jaccard_enforced), 4) AS jaccard_avg FROM rows_ WHERE ends_with(llm_arm, 'zero') OR ends_with(llm_arm, 'prompt') GROUP BY 1")
def pooled_arm_metrics(spark, root):
    arm = F.col("llm_arm")
    own = runs(spark, root).where(arm.endswith("zero") | arm.endswith("prompt"))
    return own.groupBy("llm_arm").agg(F.count(F.lit(1)).alias("runs"), F.sum("violation_count").alias("violations"), F.round(F.avg("jaccard_enforced"), 4).alias("jaccard_avg"))


@query(f"WITH {S.ROWS}, k(rule_id) AS (VALUES ('PX-01'), ('PX-02'), ('PX-99')), c AS (SELECT rule_id, count(*) AS n FROM (SELECT DISTINCT run_id, unnest(list_transform(violations, lambda v: v.rule_id)) AS rule_id FROM rows_) GROUP BY 1) SELECT rule_id, coalesce(n, 0) AS runs, round(coalesce(n, 0) / (SELECT count(*) FROM rows_), 6) AS rate FROM k LEFT JOIN c USING (rule_id)")
def rule_rates_zero_filled(spark, root):
    rows = runs(spark, root)
    keys = spark.createDataFrame([("PX-01",), ("PX-02",), ("PX-99",)], "rule_id string")
    hits = rows.select(F.explode(F.array_distinct(F.transform("violations", lambda v: v["rule_id"]))).alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("runs"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    # Three keys and one total.
    return keys.join(hits, "rule_id", "left").join(F.broadcast(total)).select("rule_id", F.coalesce("runs", F.lit(0)).alias("runs"), F.round(F.coalesce("runs", F.lit(0)) / F.col("total"), 6).alias("rate"))


_STOP = ", ".join(f"'{w}'" for w in STOP)
_TOKENS = f"tok AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{{3,}}'), lambda w: w NOT IN ({_STOP}) AND NOT regexp_matches(w, '^[0-9]+$'))) AS word FROM documents)"


@query(f"WITH {_TOKENS} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM tok GROUP BY 1 ORDER BY n DESC, word LIMIT 12")
def top_tokens(spark, root):
    """The twelve most frequent words: a report."""
    words = table(spark, root, "documents").select("doc_id", F.explode(text.tokens("text", STOP)).alias("word"))
    per_doc = words.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return per_doc.groupBy("word").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs")).orderBy(F.desc("n"), "word").limit(12)


@query(f"WITH {_RANKED}, {_TOKENS}, u AS (SELECT doc_id FROM v WHERE verdict = 'zero') SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM tok JOIN u USING (doc_id) GROUP BY 1")
def unmapped_clusters(spark, root):
    """Words of the texts that no rule fits."""
    d = table(spark, root, "documents")
    zero = matching.ranked_rules(d.select("doc_id", "text", text.match_form("text").alias("t")), "t", TEXT_RULES).where("verdict = 'zero'")
    words = zero.select("doc_id", F.explode(text.tokens("text", STOP)).alias("word")).groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return words.groupBy("word").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs"))


@query(f"WITH r(rule_id, kind, action, before, severity) AS (VALUES {_RULE_VALUES}) SELECT kind, severity, count(*) AS rules, count(DISTINCT action) AS actions FROM r GROUP BY 1, 2")
def policy_surface_counts(spark, root):
    return rule_table(spark).groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("rules"), F.count_distinct("action").alias("actions"))


@query(f"WITH {S.ROWS} SELECT llm_deployment, round(avg(CASE WHEN llm_arm = 'llm_zero' THEN violation_count END), 6) AS llm_zero, round(avg(CASE WHEN llm_arm = 'llm_policy_prompt' THEN violation_count END), 6) AS llm_policy_prompt FROM rows_ WHERE llm_deployment IS NOT NULL GROUP BY 1")
def arm_pivot(spark, root):
    rows = runs(spark, root).where("llm_deployment is not null")
    return rows.groupBy("llm_deployment").pivot("llm_arm", list(analysis.ARMS)).agg(F.round(F.avg("violation_count"), 6))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines FROM documents WHERE text IS NOT NULL")
def nonblank_line_count(spark, root):
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return table(spark, root, "documents").where("text is not null").select("doc_id", lines.cast("bigint").alias("lines"))


# --- Windows, order, sets ----------------------------------------------------------------------


@query(f"WITH {S.LATEST} SELECT incident_key, model_label, run_id FROM latest")
def latest_run_per_key(spark, root):
    return analysis.latest_runs(runs(spark, root).select("incident_key", "model_label", "run_tag", "run_id")).select("incident_key", "model_label", "run_id")


@query(f"WITH {S.CLEANED} SELECT run_id, CAST(unnest(range(1, len(llm_actions) + 1)) AS INTEGER) AS place, unnest(llm_actions) AS action FROM cleaned")
def action_ordinals(spark, root):
    return runs(spark, root).select("run_id", F.posexplode("llm_actions").alias("p", "action")).select("run_id", (F.col("p") + 1).alias("place"), "action")


@query(f"WITH t AS (SELECT incident_id, {S.present('source_ip')} AS value, line_no FROM telemetry), f AS (SELECT incident_id, value, min(line_no) AS m FROM t WHERE value IS NOT NULL GROUP BY 1, 2) SELECT incident_id, value, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY m, value) AS INTEGER) AS token FROM f")
def tokenize_first_seen(spark, root):
    rows = table(spark, root, "telemetry").select("incident_id", "line_no", present("source_ip").alias("value"))
    return audit.first_seen_tokens(rows, "incident_id", "line_no", "value")


@query(f"WITH {_CAND}, m AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY event_id, rule_id) AS rn FROM cand WHERE score >= least_) SELECT incident_id, event_id, rule_id FROM m WHERE rn <= 10")
def first_n_samples(spark, root):
    """The first ten matches of every incident."""
    found = matching.matches(found_techniques(spark, root)).select("incident_id", "event_id", "rule_id")
    return matching.top_n(found, ["incident_id"], [F.col("event_id"), F.col("rule_id")], 10)


@query(f"WITH {S.CLEANED} SELECT run_id, array_to_string(list_filter(list_transform(range(1, len(llm_actions) + 1), lambda i: CASE WHEN list_position(llm_actions, llm_actions[i]) = i THEN llm_actions[i] END), lambda x: x IS NOT NULL), ',') AS plan FROM cleaned")
def dedupe_keep_first(spark, root):
    return runs(spark, root).select("run_id", F.array_join(F.array_distinct("llm_actions"), ",").alias("plan"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source NULLS FIRST")
def topk_count_desc(spark, root):
    return table(spark, root, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


@query(f"WITH {S.EVENTS}, p AS (SELECT incident_id, event_id, {S.has_any('lower(coalesce(command, chr(0)) || chr(32) || event_type)', PRIORITY_WORDS)} AS first_, line_no FROM ev) SELECT incident_id, event_id FROM p QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY CASE WHEN first_ THEN 0 ELSE 1 END, line_no) <= 40")
def priority_truncate(spark, root):
    """At most forty events of each incident: those that matter first, then in order of arrival."""
    hit = text.contains_any(F.lower(F.concat(F.coalesce("command", F.lit("\0")), F.lit(" "), F.col("event_type"))), PRIORITY_WORDS)
    return matching.top_n(events(spark, root).select("incident_id", "event_id", "line_no", hit.alias("hit")), ["incident_id"], [F.desc("hit"), F.col("line_no")], 40).select("incident_id", "event_id")


@query(f"WITH {S.ROWS} SELECT incident_key, run_id FROM rows_ QUALIFY row_number() OVER (PARTITION BY incident_key ORDER BY violation_count DESC, total_tokens DESC, run_id) = 1")
def argmax_tuple(spark, root):
    rows = runs(spark, root).select("incident_key", "violation_count", "total_tokens", "run_id")
    return rows.groupBy("incident_key").agg(F.max_by("run_id", F.struct("violation_count", "total_tokens", -F.col("run_id"))).alias("run_id"))


@query(f"WITH {S.ROWS} SELECT DISTINCT llm_deployment, llm_arm, CASE llm_arm WHEN 'llm_zero' THEN 0 WHEN 'llm_policy_prompt' THEN 1 ELSE 2 END AS arm_rank FROM rows_")
def custom_arm_sort(spark, root):
    rank = F.when(F.col("llm_arm") == "llm_zero", 0).when(F.col("llm_arm") == "llm_policy_prompt", 1).otherwise(2)
    return runs(spark, root).select("llm_deployment", "llm_arm").distinct().withColumn("arm_rank", rank).orderBy("llm_deployment", "arm_rank", "llm_arm")


@query(f"WITH {S.CLEANED} SELECT run_id, len({S.both('llm_actions', 'human_actions')}) AS both, len(list_distinct(list_concat(llm_actions, human_actions))) AS either, len({S.minus('llm_actions', 'human_actions')}) AS only_made FROM cleaned")
def array_set_ops(spark, root):
    a, b = "llm_actions", "human_actions"
    sizes = [F.size(f(a, b)).cast("bigint").alias(n) for n, f in (("both", F.array_intersect), ("either", F.array_union), ("only_made", F.array_except))]
    return runs(spark, root).select("run_id", *sizes)


@query("SELECT action_id FROM human_actions WHERE action_id IS NOT NULL EXCEPT SELECT action_id FROM action_catalog")
def set_except(spark, root):
    return table(spark, root, "human_actions").select("action_id").where("action_id is not null").subtract(table(spark, root, "action_catalog").select("action_id"))


@query("SELECT action_id FROM human_actions INTERSECT SELECT action_id FROM action_catalog")
def set_intersect(spark, root):
    return table(spark, root, "human_actions").select("action_id").intersect(table(spark, root, "action_catalog").select("action_id"))


@query("SELECT * FROM (SELECT 'no_text' AS issue, count(*) AS n FROM documents WHERE text IS NULL OR text = '' UNION ALL SELECT 'no_author', count(*) FROM documents WHERE author IS NULL UNION ALL SELECT 'wrong_size', count(*) FROM documents WHERE n_chars <> length(text))")
def union_all_issues(spark, root):
    """Issues of the same rows in one scan."""
    d = table(spark, root, "documents")
    checks = {"no_text": F.col("text").isNull() | (F.col("text") == ""), "no_author": F.col("author").isNull(), "wrong_size": F.col("n_chars") != F.length("text")}
    one = d.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("issue"), F.col(n).alias("n")) for n in checks])).alias("x")).select("x.*")


@query("SELECT incident_id FROM human_actions UNION SELECT incident_id FROM incident_meta")
def union_distinct(spark, root):
    return table(spark, root, "human_actions").select("incident_id").union(table(spark, root, "incident_meta").select("incident_id")).distinct()


# --- Plans -------------------------------------------------------------------------------------

_VIOL = "{rule_id: '%s', kind: '%s', action: '%s', repair: '%s'}"


def _steps(rules, matched: str, defer: str) -> list[tuple[str, str, str]]:
    """(condition, plan, violation) of each step of the fold, in order."""
    out = [("true", "list_filter(plan, lambda a: list_contains(known, a))", "")]
    for r in rules:
        if r.kind == "mandatory":
            out.append((f"list_contains({matched}, '{r.rule_id}') AND NOT list_contains(plan, '{r.action}')", f"list_prepend('{r.action}', plan)", f"{r.rule_id}:missing_mandatory:insert"))
    order = [r for r in rules if r.kind == "prohibit_before"]
    for _ in range(len(order) + 1 if order else 0):
        for r in order:
            at, need = f"coalesce(list_position(plan, '{r.action}'), 0)", f"coalesce(list_position(plan, '{r.before}'), 0)"
            cleared = f"list_filter(plan, lambda a: a <> '{r.before}')"
            place = f"list_position({cleared}, '{r.action}')"
            out.append((f"{at} > 0 AND ({need} = 0 OR {need} > {at})", f"list_concat(list_concat({cleared}[1:{place} - 1], ['{r.before}']), {cleared}[{place}:])", f"{r.rule_id}:order_violation:insert_before"))
    for r in rules:
        if r.kind == "require_approval":
            cond = f"list_contains(plan, '{r.action}') AND list_contains(gated, '{r.action}') AND NOT list_contains(approved, '{r.action}')"
            out.append((f"({cond}) AND ({defer})", "plan", f"{r.rule_id}:approval_deferred:defer_to_human_approval"))
            out.append((f"({cond}) AND NOT ({defer})", f"list_filter(plan, lambda a: a <> '{r.action}')", f"{r.rule_id}:approval_required:remove"))
    out.append(("true", "list_filter(plan, lambda a: list_contains(known, a))", ""))
    return out


_KNOWN = "cat AS (SELECT list(action_id) AS known, list(action_id) FILTER (WHERE requires_approval) AS gated FROM action_catalog)"
_ONCE_EACH = "list_filter(list_transform(range(1, len(plan) + 1), lambda i: CASE WHEN list_position(plan, plan[i]) = i THEN plan[i] END), lambda x: x IS NOT NULL)"


def _fold_sql(start: str, rules, defer: str, name: str = "s") -> tuple[list[str], str]:
    """CTEs that take the plans of ``start`` (run_id, plan, approved, approval_policy_mode, m, known, gated) through all steps, and the last one's name."""
    ctes = [f"{name}0 AS (SELECT run_id, plan, approved, approval_policy_mode, m, CAST([] AS VARCHAR[]) AS v, known, gated FROM ({start}))"]
    steps = _steps(rules, "m", defer)
    for k, (cond, new, told) in enumerate(steps, 1):
        v = f"CASE WHEN {cond} AND NOT list_contains(v, '{told}') THEN list_append(v, '{told}') ELSE v END" if told else "v"
        ctes.append(f"{name}{k} AS MATERIALIZED (SELECT run_id, CASE WHEN {cond} THEN {new} ELSE plan END AS plan, approved, approval_policy_mode, m, {v} AS v, known, gated FROM {name}{k - 1})")
    return ctes, f"{name}{len(steps)}"


def _enforce_sql(rules, defer: str = "false", scoped: bool = True, plan: str = "llm_actions", twice: bool = False) -> str:
    flags = "matched AS (SELECT incident_id, list(DISTINCT rule_id) AS m FROM hit GROUP BY 1)" if scoped else "matched AS (SELECT NULL AS incident_id, CAST([] AS VARCHAR[]) AS m WHERE false)"
    start = f"SELECT run_id, {plan} AS plan, approved, approval_policy_mode, coalesce(m, []) AS m, known, gated FROM cleaned LEFT JOIN matched ON matched.incident_id = cleaned.incident_key CROSS JOIN cat"
    ctes, last = _fold_sql(start, rules, defer)
    if twice:
        again, end = _fold_sql(f"SELECT run_id, {_ONCE_EACH} AS plan, approved, approval_policy_mode, m, known, gated FROM {last}", rules, defer, "t")
        ctes += again
    head = f"WITH {(_SCOPED + ', ') if scoped else ''}{S.CLEANED}, " + ", ".join([flags, _KNOWN, *ctes])
    if twice:
        return f"{head}, both_ AS (SELECT s.plan AS one, t.plan AS two, t.v AS v FROM (SELECT run_id, {_ONCE_EACH} AS plan FROM {last}) s JOIN (SELECT run_id, {_ONCE_EACH} AS plan, v FROM {end}) t USING (run_id)) SELECT count(*) AS checked, count(*) FILTER (one <> two) AS changed, count(*) FILTER (len(list_filter(v, lambda x: NOT contains(x, 'approval_deferred'))) > 0) AS found_again FROM both_"
    return f"{head} SELECT run_id, array_to_string({_ONCE_EACH}, ',') AS enforced, array_to_string(v, ';') AS found FROM {last}"


def enforced(spark: SparkSession, root: str, rules, defer: Column | bool = False, scoped: bool = True) -> DataFrame:
    v = latest_copy(table(spark, root, "verifier_output"), "run_id").select("run_id", F.coalesce(F.nullif("incident_dir_id", F.lit("")), "incident_id").alias("incident_id"), F.col("llm_actions").alias("plan"), F.col("incident_approved_actions").alias("approved"), F.coalesce(F.nullif("approval_policy_mode", F.lit("")), F.lit("remove")).alias("approval_policy_mode"))
    v = v.join(enforce.scope_flags(deliveries(spark, root), rules), "incident_id", "left") if scoped else v.withColumn("matched", F.array().cast("array<string>"))
    return enforce.enforce(v, rules, catalog(spark, root), defer=defer)


def told(df: DataFrame) -> DataFrame:
    lines = F.transform("found", lambda x: F.concat_ws(":", x["rule_id"], x["type"], x["repair"]))
    return df.select("run_id", joined("enforced").alias("enforced"), F.array_join(lines, ";").alias("found"))


_ORDER = [r for r in RULES if r.kind == "prohibit_before"]
_GATES = [r for r in RULES if r.kind == "require_approval"]


@query(_enforce_sql(RULES, "approval_policy_mode = 'defer_to_human_approval'"))
def enforce_policy(spark, root):
    """All steps, each run in its own approval mode."""
    return told(enforced(spark, root, RULES, F.col("approval_policy_mode") == "defer_to_human_approval"))


@query(_enforce_sql(_MANDATORY))
def enforce_mandatory(spark, root):
    return told(enforced(spark, root, _MANDATORY))


@query(_enforce_sql([_ORDER[2]], scoped=False))
def enforce_order(spark, root):
    return told(enforced(spark, root, [_ORDER[2]], scoped=False))


@query(_enforce_sql(_ORDER, scoped=False))
def enforce_order_chain(spark, root):
    return told(enforced(spark, root, _ORDER, scoped=False))


@query(_enforce_sql(_GATES, scoped=False))
def enforce_approval_remove(spark, root):
    return told(enforced(spark, root, _GATES, scoped=False))


@query(_enforce_sql(_GATES, "true", scoped=False))
def enforce_approval_defer(spark, root):
    return told(enforced(spark, root, _GATES, True, scoped=False))


@query(f"SELECT run_id, CASE WHEN len(p) = 0 THEN '' ELSE array_to_string(list_sort(p), ',') END AS pending FROM (SELECT run_id, list_transform(list_filter(string_split(found, ';'), lambda x: contains(x, 'approval_deferred')), lambda x: CASE split_part(x, ':', 1) WHEN 'Q6' THEN 'quarantine_endpoint' ELSE 'suspend_account' END) AS p FROM ({_enforce_sql(_GATES, 'true', scoped=False)}))")
def approval_pending(spark, root):
    deferred = F.transform(F.filter("found", lambda v: v["type"] == "approval_deferred"), lambda v: v["action"])
    return enforced(spark, root, _GATES, True, scoped=False).select("run_id", F.array_join(F.array_sort(F.array_distinct(deferred)), ",").alias("pending"))


@query(_enforce_sql(RULES, "approval_policy_mode = 'defer_to_human_approval'", twice=True))
def enforce_idempotence(spark, root):
    """Enforced plans enforced once more with all rules: how many change, and in how many more is found than deferrals again."""
    defer = F.col("approval_policy_mode") == "defer_to_human_approval"
    once = enforced(spark, root, RULES, defer).select("run_id", F.col("enforced").alias("plan"), "approved", "matched", "approval_policy_mode")
    twice = enforce.enforce(once, RULES, catalog(spark, root), defer=defer)
    again = F.exists("found", lambda v: v["type"] != "approval_deferred")
    return twice.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.array_join("plan", ",") != F.array_join("enforced", ",")).alias("changed"), F.count_if(again).alias("found_again"))


@query("SELECT incident_id, string_agg(DISTINCT action_id, ',' ORDER BY action_id) AS approved FROM human_actions WHERE approval GROUP BY 1")
def approved_actions(spark, root):
    return table(spark, root, "human_actions").where("approval").groupBy("incident_id").agg(F.array_join(F.array_sort(F.collect_set("action_id")), ",").alias("approved"))


@query(f"WITH {S.CLEANED}, c AS (SELECT list(action_id) AS k FROM action_catalog) SELECT run_id, len(list_filter(llm_actions, lambda a: NOT list_contains(k, a))) AS unknown, len(list_distinct(list_filter(llm_actions, lambda a: list_contains(k, a)))) AS known FROM cleaned, c")
def hallucination_split(spark, root):
    """Actions outside of the catalog (with repeats) and distinct ones inside."""
    k = F.array(*[F.lit(a) for a, _ in catalog(spark, root)])
    inside = enforce.in_catalog(F.col("llm_actions"), k)
    return runs(spark, root).select("run_id", (F.size("llm_actions") - F.size(inside)).cast("bigint").alias("unknown"), F.size(F.array_distinct(inside)).cast("bigint").alias("known"))


@query(f"SELECT rule_id, count(*) AS runs FROM (SELECT unnest(string_split(found, ';')) AS x, split_part(x, ':', 1) AS rule_id FROM ({_enforce_sql(RULES)})) WHERE x <> '' GROUP BY 1")
def rule_activation(spark, root):
    """In how many plans each rule fires."""
    return enforced(spark, root, RULES).select(F.explode(F.array_distinct(F.transform("found", lambda v: v["rule_id"]))).alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("runs"))


@query(f"WITH {S.CLEANED}, u AS (SELECT DISTINCT run_id, unnest(llm_actions) AS action_id FROM cleaned) SELECT action_id, count(*) AS runs, bool_or(c.k IS NOT NULL) AS known FROM u LEFT JOIN (SELECT action_id AS k FROM action_catalog) c ON c.k = u.action_id GROUP BY 1")
def action_surface(spark, root):
    used = runs(spark, root).select(F.explode(F.array_distinct("llm_actions")).alias("action_id")).groupBy("action_id").agg(F.count(F.lit(1)).alias("runs"))
    return used.join(table(spark, root, "action_catalog").select("action_id", F.lit(True).alias("known")), "action_id", "left").select("action_id", "runs", F.coalesce("known", F.lit(False)).alias("known"))


# --- Scalars -----------------------------------------------------------------------------------


@query()
def normalize_for_match(spark, root):
    """SQL has neither references nor compatible forms; the tests hold it against a plain version."""
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.sha2(text.match_form("text"), 256).alias("form"))


@query("SELECT DISTINCT source, lang, coalesce(nullif(trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS slug FROM documents")
def safe_slug(spark, root):
    return table(spark, root, "documents").select("source", "lang", text.slug("source").alias("slug")).distinct()


@query(f"WITH {_TOKENS} SELECT doc_id, count(*) AS words, count(DISTINCT word) AS kinds FROM tok GROUP BY 1")
def tokenize(spark, root):
    words = text.tokens("text", STOP)
    out = table(spark, root, "documents").select("doc_id", words.alias("w"))
    return out.select("doc_id", F.size("w").cast("bigint").alias("words"), F.size(F.array_distinct("w")).cast("bigint").alias("kinds")).where("words > 0")


@query("SELECT DISTINCT incident_id, coalesce(nullif(regexp_replace(incident_id, '[^0-9]', '', 'g'), ''), '000000') AS digits FROM incident_meta")
def digits_id(spark, root):
    return table(spark, root, "incident_meta").select("incident_id", text.digits("incident_id").alias("digits")).distinct()


@query(f"WITH {_PAIRS} SELECT model_a, model_b, CASE WHEN p_value < 0.0001 THEN '<0.0001' ELSE printf('%.4f', p_value + 1e-9) END AS p FROM out_")
def format_p_value(spark, root):
    return pairwise_self_join(spark, root).select("model_a", "model_b", text.format_p("p_value").alias("p"))


@query(f"WITH {S.CLEANED} SELECT run_id, strftime(make_timestamp(latency_ms * 1000), '%Y-%m-%dT%H:%M:%S.') || printf('%03d', latency_ms % 1000) || 'Z' AS iso FROM cleaned")
def epoch_ms_to_iso(spark, root):
    return runs(spark, root).select("run_id", F.date_format(F.timestamp_millis("latency_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"))


@query(r"SELECT DISTINCT run_id, epoch_us(try_strptime(regexp_extract(run_tag, '([0-9]{8}T[0-9]{6})[0-9]{6}Z$', 1), '%Y%m%dT%H%M%S')) + TRY_CAST(regexp_extract(run_tag, '([0-9]{6})Z$', 1) AS BIGINT) AS stamp_us FROM verifier_output")
def parse_run_tag_ts(spark, root):
    stamp = F.try_to_timestamp(F.regexp_extract("run_tag", "([0-9]{8}T[0-9]{12})Z$", 1), F.lit("yyyyMMdd'T'HHmmssSSSSSS"))
    return table(spark, root, "verifier_output").select("run_id", F.unix_micros(stamp).alias("stamp_us")).distinct()


@query(f"WITH {S.ROWS}, g AS (SELECT incident_type, count(*) AS n, count(*) FILTER (violation_count > 0) AS k FROM rows_ GROUP BY 1) SELECT incident_type, n, k, {_LOW} AS low, {_HIGH} AS high FROM g")
def wilson_interval(spark, root):
    g = runs(spark, root).groupBy("incident_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("violation_count") > 0).alias("k"))
    low, high = stats.wilson("k", "n")
    return g.withColumns({"low": low, "high": high})


@query("SELECT DISTINCT event_id, TRY_CAST(details.source_summary->'related'->0->>'event_ref' AS BIGINT) AS event_ref FROM telemetry WHERE details.source_summary IS NOT NULL")
def json_extract(spark, root):
    ref = F.get_json_object("details.source_summary", "$.related[0].event_ref").try_cast("bigint")
    return table(spark, root, "telemetry").where("details.source_summary is not null").select("event_id", ref.alias("event_ref")).distinct()


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def sha256_column(spark, root):
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\b[Tt][0-9]{4}(?:\.[0-9]{3})?\b'), lambda x: upper(x)))), ',') AS ids FROM documents WHERE regexp_matches(text, '\b[Tt][0-9]{4}(?:\.[0-9]{3})?\b')")
def technique_id_extract(spark, root):
    ids = F.regexp_extract_all(F.col("text"), F.lit(text.TECHNIQUE), F.lit(0))
    return table(spark, root, "documents").where(F.col("text").rlike(text.TECHNIQUE)).select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(ids, F.upper))), ",").alias("ids"))


@query("SELECT doc_id, nullif(regexp_extract(text, 'INC_[A-Z]+_[0-9]+'), '') AS incident FROM documents WHERE text IS NOT NULL")
def incident_from_path(spark, root):
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.nullif(F.regexp_extract("text", "INC_[A-Z]+_[0-9]+", 0), F.lit("")).alias("incident"))


@query(rf"""WITH h AS (SELECT doc_id, coalesce(incident_id, 'document ' || doc_id) AS incident_id, unnest(regexp_extract_all(text, '{text.IPV4}')) AS v, unnest(range(0, len(regexp_extract_all(text, '{text.IPV4}')))) AS p FROM documents),
n AS (SELECT incident_id, v, row_number() OVER (PARTITION BY incident_id ORDER BY m, v) AS k FROM (SELECT incident_id, v, min((doc_id, p)) AS m FROM h GROUP BY 1, 2)),
t AS (SELECT doc_id, list('ip_' || k ORDER BY p) AS names FROM h JOIN n ON n.v = h.v AND n.incident_id = h.incident_id GROUP BY 1),
c AS (SELECT doc_id, string_split_regex(text, '{text.IPV4}') AS parts, coalesce(names, []) AS names FROM documents LEFT JOIN t USING (doc_id) WHERE text IS NOT NULL)
SELECT doc_id, sha256(array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(names[i], '')), '')) AS masked FROM c""")
def mask_pii_tokens(spark, root):
    """Addresses as numbers that count from 1 in every incident; documents without one count on their own."""
    d = table(spark, root, "documents").where("text is not null").select("doc_id", "incident_id", "text")
    return audit.mask_numbered(d, "doc_id", "incident_id", "doc_id", "text", text.IPV4, "ip_", "m").select("doc_id", F.sha2("m", 256).alias("masked"))


@query("SELECT action_id, CASE WHEN starts_with(action_id, 'reset') OR starts_with(action_id, 'rotate') THEN 'credentials' WHEN starts_with(action_id, 'block') THEN 'network' ELSE 'review_' || substr(sha256(action_id), 1, 8) END AS kind FROM action_catalog")
def infer_action(spark, root):
    a = F.col("action_id")
    kind = F.when(a.startswith("reset") | a.startswith("rotate"), "credentials").when(a.startswith("block"), "network").otherwise(F.concat(F.lit("review_"), F.substring(F.sha2(a, 256), 1, 8)))
    return table(spark, root, "action_catalog").select("action_id", kind.alias("kind"))


@query("SELECT source, count(*) AS declared, count(*) FILTER (n_chars = length(text)) AS right_size, count(DISTINCT sha256(text)) AS contents FROM documents GROUP BY 1")
def manifest_verify(spark, root):
    d = table(spark, root, "documents")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("declared"), F.count_if(F.col("n_chars") == F.length("text")).alias("right_size"), F.count_distinct(F.sha2("text", 256)).alias("contents"))


@query("SELECT DISTINCT event_id, CASE WHEN NOT json_valid(details.raw) THEN 'broken' WHEN json_type(CASE WHEN json_valid(details.raw) THEN details.raw END) <> 'OBJECT' THEN 'no_object' WHEN NOT json_exists(CASE WHEN json_valid(details.raw) THEN details.raw END, '$.agent') THEN 'no_agent' ELSE 'ok' END AS verdict FROM telemetry WHERE details.raw IS NOT NULL")
def parse_response_json(spark, root):
    """What is wrong with a JSON text that should be an object with a key."""
    raw = F.col("details.raw")
    parsed = F.try_parse_json(raw)
    verdict = F.when(parsed.isNull(), "broken").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "no_object").when(F.json_object_keys(raw).isNull() | ~F.array_contains(F.json_object_keys(raw), "agent"), "no_agent").otherwise("ok")
    return table(spark, root, "telemetry").where(raw.isNotNull()).select("event_id", verdict.alias("verdict")).distinct()


# --- Further forms of the above ----------------------------------------------------------------


@query(f"WITH {S.ROWS} SELECT run_id, model_label FROM rows_")
def model_label(spark, root):
    return runs(spark, root).select("run_id", "model_label")


@query(f"WITH {S.EVENTS}, x AS (SELECT ev.event_id, lower(coalesce(t.details.command, '') || ' ' || coalesce(t.details.raw, '') || ' ' || coalesce(t.details.source_summary, '')) AS d FROM ev JOIN telemetry t ON t.event_id = ev.event_id AND t.line_no = ev.line_no AND t.incident_id = ev.incident_id) SELECT event_id FROM x WHERE contains(d, 'keymole') OR contains(d, 'netpeek')")
def details_text_contains(spark, root):
    """Events any of whose details holds one of the needles."""
    return normalize.once(deliveries(spark, root).where(text.contains_any(F.col("details_text"), ["keymole", "netpeek"])).select("event_id"), "event_id")


@query(f"WITH {_CAND} SELECT technique_id, round(score, 3) AS score, count(*) AS n FROM cand GROUP BY 1, 2")
def attack_score(spark, root):
    return found_techniques(spark, root).groupBy("technique_id", F.round("score", 3).alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CAND} SELECT event_id, rule_id, array_to_string(signals, ', ') || ' | ' || coalesce(nullif(substr(command, 1, 120), ''), event_type) AS evidence FROM cand")
def attack_evidence(spark, root):
    return found_techniques(spark, root).select("event_id", "rule_id", matching.evidence().alias("evidence"))


def _of_pairs(name: str, *columns: str):
    def run(spark, root):
        return pairwise_self_join(spark, root).select("model_a", "model_b", *columns)

    query(f"WITH {_PAIRS} SELECT model_a, model_b, {', '.join(columns)} FROM out_", name=name)(run)


for _n, _cols in (("two_prop_z", ("z_score", "p_value")), ("mcnemar", ("only_a", "only_b", "mcnemar_chi2", "mcnemar_p")), ("holm_adjust", ("p_value", "p_value_holm")), ("cohens_h", ("cohens_h",)), ("cliffs_delta_paired", ("cliffs_delta",))):
    _of_pairs(_n, *_cols)


@query(f"WITH {_RANKED} SELECT d2.source, verdict, count(*) AS n FROM v JOIN documents d2 USING (doc_id) GROUP BY 1, 2")
def mapping_support_by_type(spark, root):
    return classified(spark, root).groupBy("source", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_RANKED}, f AS (SELECT d2.incident_id, CASE WHEN verdict IN ('single', 'multi') THEN best END AS a, min(d2.doc_id) AS m FROM v JOIN documents d2 USING (doc_id) WHERE d2.incident_id IS NOT NULL GROUP BY 1, 2),
g AS (SELECT *, count(a) OVER (PARTITION BY incident_id) AS n FROM f)
SELECT incident_id, coalesce(a, 'snapshot_memory') AS action_id, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY m, a) AS INTEGER) AS place FROM g WHERE a IS NOT NULL OR n = 0""")
def human_actions_from_tasks(spark, root):
    d = table(spark, root, "documents").select("doc_id", "incident_id", text.match_form("text").alias("t"))
    return matching.actions_from_texts(matching.ranked_rules(d, "t", TEXT_RULES), "incident_id", ["doc_id"], "snapshot_memory")


@query("SELECT doc_id, regexp_matches(lower(text), 'user_[0-9]+|analyst_[0-9]+') AS redacted, CASE WHEN regexp_matches(lower(text), 'user_[0-9]+|analyst_[0-9]+') THEN '[note withheld]' ELSE text END AS note FROM documents WHERE text IS NOT NULL")
def redact_contact_notes(spark, root):
    """Notes that name a person are withheld, the others are given whole."""
    hit = F.lower("text").rlike("user_[0-9]+|analyst_[0-9]+")
    return table(spark, root, "documents").where("text is not null").select("doc_id", hit.alias("redacted"), F.when(hit, "[note withheld]").otherwise(F.col("text")).alias("note"))


@query(rf"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[\s\x{{0B}}\x{{A0}}\x{{85}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))) AS bare FROM documents WHERE text IS NOT NULL")
def strip_html(spark, root):
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.sha2(text.without_tags("text"), 256).alias("bare"))


@query(_enforce_sql(RULES, "true"))
def replay_defer(spark, root):
    """Saved plans enforced once more, all in the deferring mode."""
    return told(enforced(spark, root, RULES, True))


def _probe_sql() -> str:
    actions = ", ".join(f"('{r.action}', '{r.rule_id}')" for r in _ORDER)
    start = f"SELECT incident_id || ' ' || rule_id AS run_id, [action] AS plan, coalesce(ok, []) AS approved, 'remove' AS approval_policy_mode, coalesce(m, []) AS m, known, gated FROM (SELECT DISTINCT incident_id FROM incident_meta WHERE incident_id IS NOT NULL) CROSS JOIN (VALUES {actions}) r(action, rule_id) LEFT JOIN (SELECT incident_id, list(DISTINCT action_id) AS ok FROM human_actions WHERE approval GROUP BY 1) a USING (incident_id) LEFT JOIN matched USING (incident_id) CROSS JOIN cat"
    ctes, last = _fold_sql(start, RULES, "false")
    return f"WITH {_SCOPED}, matched AS (SELECT incident_id, list(DISTINCT rule_id) AS m FROM hit GROUP BY 1), {_KNOWN}, {', '.join(ctes)} SELECT split_part(run_id, ' ', 2) AS rule_id, array_to_string({_ONCE_EACH}, ',') AS enforced, len(v) AS repairs, count(*) AS incidents FROM {last} GROUP BY ALL"


@query(_probe_sql())
def order_chain_probe(spark, root):
    """For every order rule and incident, a plan of nothing but the rule's action: what all rules make of it."""
    probes = F.explode(F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.array(F.lit(r.action)).alias("plan")) for r in _ORDER]))
    approved = table(spark, root, "human_actions").where("approval").groupBy("incident_id").agg(F.collect_set("action_id").alias("approved"))
    own = table(spark, root, "incident_meta").select("incident_id").where("incident_id is not null").distinct()
    own = own.join(approved, "incident_id", "left").join(enforce.scope_flags(deliveries(spark, root), RULES), "incident_id", "left")
    made = enforce.enforce(own.select("incident_id", "approved", "matched", probes.alias("_p")).select("incident_id", "approved", "matched", "_p.*"), RULES, catalog(spark, root))
    return made.groupBy("rule_id", joined("enforced").alias("enforced"), F.size("found").cast("bigint").alias("repairs")).agg(F.count(F.lit(1)).alias("incidents"))


@query("""WITH t AS (SELECT DISTINCT event_id, details.raw AS raw FROM telemetry WHERE details.raw IS NOT NULL),
j AS (SELECT event_id, raw, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS v FROM t),
x AS (SELECT event_id, CASE WHEN starts_with(trim(raw), '```') THEN 'fenced' WHEN v IS NULL THEN 'broken' WHEN json_type(v) <> 'OBJECT' THEN 'no_object' WHEN NOT json_exists(v, '$.tags') THEN 'no_key' WHEN json_type(v->'tags') <> 'ARRAY' THEN 'no_list' END AS error,
  CASE WHEN json_type(v) = 'OBJECT' AND json_type(v->'tags') = 'ARRAY' THEN list_transform(CAST(v->'tags' AS JSON[]), lambda y: trim(coalesce(y->>'$', 'None'))) ELSE [] END AS items FROM j)
SELECT event_id, error, array_to_string(list_filter(list_transform(range(1, len(items) + 1), lambda i: CASE WHEN list_position(items, items[i]) = i THEN items[i] END), lambda y: y IN ('retest', 'night')), ',') AS actions,
  array_to_string(list_filter(items, lambda y: y NOT IN ('retest', 'night')), ',') AS skipped FROM x""")
def parse_responses(spark, root):
    """JSON texts of mixed quality read as answers with a list: what is wrong with each, and the known and unknown items."""
    raw = table(spark, root, "telemetry").select("event_id", F.col("details.raw").alias("raw")).where("raw is not null").distinct()
    got = raw.select("event_id", matching.parse_response("raw", "tags", ["retest", "night"]).alias("p"))
    return got.select("event_id", "p.error", joined("p.actions").alias("actions"), joined("p.skipped").alias("skipped"))


@query(f"""WITH {S.ROWS}, cells AS (SELECT incident_id AS incident_key, deployment AS model, arm, rep FROM (SELECT DISTINCT incident_id FROM incident_meta WHERE incident_id IS NOT NULL), (SELECT deployment FROM model_registry WHERE enabled), (VALUES ('llm_zero'), ('llm_policy_prompt')) a(arm), (VALUES (1), (2)) r(rep)),
o AS (SELECT *, row_number() OVER (PARTITION BY incident_key, llm_deployment, llm_arm ORDER BY coalesce(run_tag, ''), run_id) AS rep FROM rows_ WHERE llm_deployment IS NOT NULL AND llm_arm IS NOT NULL)
SELECT c.model, c.arm, CASE WHEN o.run_id IS NULL THEN 'missing' WHEN llm_action_count = 0 THEN 'empty_plan' END AS error, count(*) AS n FROM cells c LEFT JOIN o ON o.incident_key = c.incident_key AND o.llm_deployment = c.model AND o.llm_arm = c.arm AND o.rep = c.rep GROUP BY 1, 2, 3""")
def experiment_outcomes(spark, root):
    """All incidents with every enabled model, both arms and two repeats: what ran, what is missing, what came back empty."""
    models = bounded_rows(analysis.select_profiles(table(spark, root, "model_registry")).select("deployment"), 1000)
    if models is None:
        raise ValueError("more than 1000 models")
    incidents = table(spark, root, "incident_meta").select(F.col("incident_id").alias("incident_key")).where("incident_key is not null").distinct()
    cells = analysis.grid(incidents, [m[0] for m in models], list(analysis.ARMS), 2) if models else incidents.select("incident_key", *[F.lit(None).cast("string").alias(c) for c in ("model", "arm")], F.lit(1).alias("repeat")).limit(0)
    return analysis.outcomes(cells, runs(spark, root)).groupBy("model", "arm", "error").agg(F.count(F.lit(1)).alias("n"))


def _vendor(key: str) -> str:
    path = f"$.\"{key}\""
    value = S.present(f"(r->>'{path}')")
    return f"trim(trim({value}, '\"'), '''')" if key in normalize.QUOTED_NAMES else value


_VENDOR = {n: f"coalesce({', '.join(_vendor(k) for k in keys)}, {chr(39) + 'unknown' + chr(39) if n in normalize.UNKNOWN else 'NULL'})" for n, keys in normalize.VENDOR_NAMES.items()}
_LEVEL = "coalesce(" + ", ".join(f"nullif({_vendor(k)}, '')" for k in normalize.SEVERITY_NAMES) + ")"


@query(f"WITH x AS (SELECT DISTINCT event_id, CASE WHEN json_valid(details.raw) THEN CAST(details.raw AS JSON) END AS r FROM telemetry WHERE contains(details.raw, '(custom)')) SELECT event_id, {', '.join(f'{v} AS {n}' for n, v in _VENDOR.items())}, {_LEVEL} AS severity, 'SIEM' AS source_type FROM x WHERE r IS NOT NULL")
def normalize_vendor_event(spark, root):
    """Events from the exporters' flat records in details.raw."""
    raw = table(spark, root, "telemetry").select("event_id", F.col("details.raw").alias("raw")).where(F.contains("raw", F.lit("(custom)"))).distinct()
    flat = raw.where(F.try_parse_json("raw").isNotNull()).select("event_id", F.from_json("raw", "map<string,string>").alias("r"))
    return normalize.vendor_events(flat, "r", "SIEM").drop("r")
