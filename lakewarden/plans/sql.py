"""Pieces of SQL that several checks share."""

from __future__ import annotations

RUNS = "runs AS (SELECT * FROM verifier_output QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY written_at) = 1)"


def present(x: str) -> str:
    return f"(CASE WHEN trim({x}) NOT IN ('', 'N/A', 'null', 'None') THEN trim({x}) END)"


def measured(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR isnan(CAST({x} AS DOUBLE)) OR {x} < 0 THEN 0.0 ELSE CAST({x} AS DOUBLE) END)"


def rate(a: str, b: str, digits: int = 4) -> str:
    return f"round(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END, {digits})"


def minus(a: str, b: str) -> str:
    return f"list_filter(list_distinct({a}), lambda x: NOT list_contains({b}, x))"


def both(a: str, b: str) -> str:
    return f"list_filter(list_distinct({a}), lambda x: list_contains({b}, x))"


_UNKNOWN = ", ".join(f"coalesce(nullif({c}, ''), 'unknown') AS {c}" for c in ("incident_type", "severity", "asset_criticality"))
CLEANED = f"""{RUNS},
cleaned AS (
  SELECT run_id, coalesce(nullif(incident_dir_id, ''), incident_id) AS incident_key, {_UNKNOWN},
    CASE WHEN mode = 'humano' THEN 'human' ELSE mode END AS mode, run_tag, coalesce(nullif(approval_policy_mode, ''), 'remove') AS approval_policy_mode,
    nullif(lower(trim(llm_deployment)), '') AS llm_deployment, nullif(trim(llm_arm), '') AS llm_arm,
    coalesce(violations, []) AS violations, coalesce(llm_actions, []) AS llm_actions, coalesce(human_actions, []) AS human_actions, coalesce(enforced_actions, []) AS enforced_actions,
    coalesce(incident_approved_actions, []) AS approved, coalesce(llm_usage.prompt_tokens, 0) AS prompt_tokens, coalesce(llm_usage.completion_tokens, 0) AS completion_tokens, coalesce(llm_usage.total_tokens, 0) AS total_tokens,
    CAST({measured("llm_latency_ms")} AS BIGINT) AS latency_ms, round({measured("llm_cost_estimated_usd")}, 6) AS cost_usd
  FROM runs)"""


def _agreement(name: str, made: str) -> str:
    b, m, w = f"len({both(made, 'human_actions')})", f"len(list_distinct({made}))", "len(list_distinct(human_actions))"
    return f"{rate(b, m)} AS precision_{name}, {rate(b, w)} AS recall_{name}, {rate(b, f'{m} + {w} - {b}')} AS jaccard_{name}"


_MENDED = (("missing_mandatory", "inserted_count"), ("approval_required", "removed_count"), ("approval_deferred", "deferred_count"), ("order_violation", "reordered_count"))
ROWS = f"""{CLEANED},
counted AS (
  SELECT *, concat_ws('|', CASE WHEN llm_deployment IS NOT NULL AND llm_arm IS NOT NULL THEN llm_deployment || '|' || llm_arm ELSE coalesce(llm_deployment, mode, 'unknown') END,
      CASE WHEN approval_policy_mode <> 'remove' THEN approval_policy_mode END) AS model_label,
    len(violations) AS violation_count, len(list_filter(violations, lambda v: v.severity = 'hard')) AS hard_violation_count,
    {", ".join(f"len(list_filter(violations, lambda v: v.severity = '{x}')) AS {x}_violation_count" for x in ("soft", "warning"))},
    {", ".join(f"len(list_filter(violations, lambda v: v.type = '{k}')) AS {n}" for k, n in _MENDED)},
    len(list_filter(violations, lambda v: v.type IN ({", ".join(f"'{k}'" for k, _ in _MENDED)}))) AS modification_count,
    len(llm_actions) AS llm_action_count, len(human_actions) AS human_action_count, len(enforced_actions) AS enforced_action_count,
    len({minus("llm_actions", "human_actions")}) AS llm_only_action_count, len({minus("human_actions", "llm_actions")}) AS human_only_action_count,
    {_agreement("raw", "llm_actions")}, {_agreement("enforced", "enforced_actions")}
  FROM cleaned),
rows_ AS (
  SELECT *, {", ".join(f"CASE WHEN precision_{x} + recall_{x} = 0 THEN 0.0 ELSE round(2 * precision_{x} * recall_{x} / (precision_{x} + recall_{x}), 4) END AS f1_{x}" for x in ("raw", "enforced"))},
    round(jaccard_enforced - jaccard_raw, 4) AS delta_jaccard, round(recall_enforced - recall_raw, 4) AS coverage_delta
  FROM counted)"""

LATEST = f"""{ROWS},
latest AS (SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY incident_key, model_label ORDER BY coalesce(run_tag, '') DESC, run_id) = 1)"""

EVENTS = f"""ev AS (
  SELECT event_id, incident_id, line_no, coalesce({present("event_type")}, 'unknown') AS event_type, lower({present("category")}) AS category, timestamp,
    {present("source_type")} AS source_type, {present("source_ip")} AS source_ip, {present("dest_ip")} AS dest_ip, {present("username")} AS username,
    trim(trim({present("details.command")}, '"'), '''') AS command, lower({present("details.severity")}) AS severity, {present("details.log_source")} AS log_source,
    details.source_summary AS source_summary, details.raw AS raw
  FROM telemetry QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY line_no) = 1)"""

# The error function by its series in closed form, for z >= 0.
ERF = """CASE WHEN {x} > 6 THEN 1.0 WHEN {x} <= 0 THEN 0.0 ELSE 2 / sqrt(pi()) * exp(-({x}) * ({x})) *
  list_sum(list_transform(range(0, 151), lambda k: exp(2 * k * ln(2.0) + (2 * k + 1) * ln({x}) + lgamma(k + 1) - lgamma(2 * k + 2)))) END"""


def erf(x: str) -> str:
    return ERF.replace("{x}", f"({x})")


def has_any(text: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{n.lower()}')" for n in needles) + ")"


def has_all(text: str, needles: list[str]) -> str:
    return "(" + " AND ".join(f"contains({text}, '{n.lower()}')" for n in needles) + ")"
