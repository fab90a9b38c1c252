"""Runs of recommended plans: cleaning, per-run metrics, grouped rates, paired comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.functions.present import strip
from lakewarden.functions.stats import cohens_h, holm, mcnemar, rate, rounded, two_proportions, wilson
from lakewarden.sources.tables import latest_copy

ARMS = ("llm_zero", "llm_policy_prompt")


def _items(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _measured(c: str) -> Column:
    """A value that is a measurement, else 0."""
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x < 0), F.lit(0.0)).otherwise(x)


def agreement(made: Column, wanted: Column) -> tuple[Column, Column, Column, Column]:
    """Precision, recall, F1 (of the rounded two) and Jaccard of two lists as sets, rounded to 4; 0 where not defined."""
    made, wanted = F.array_distinct(made), F.array_distinct(wanted)
    both = F.size(F.array_intersect(made, wanted))
    p, r = rate(both, F.size(made), 4), rate(both, F.size(wanted), 4)
    f = F.when(p + r == 0, F.lit(0.0)).otherwise(F.round(2 * p * r / F.nullif(p + r, F.lit(0.0)), 4))
    return p, r, f, rate(both, F.size(F.array_union(made, wanted)), 4)


def label() -> Column:
    """deployment|arm, else deployment, else mode; the approval mode is added when it isn't remove."""
    base = F.when(F.col("llm_deployment").isNotNull() & F.col("llm_arm").isNotNull(), F.concat_ws("|", "llm_deployment", "llm_arm")).otherwise(F.coalesce("llm_deployment", "mode", F.lit("unknown")))
    return F.concat_ws("|", base, F.when(F.col("approval_policy_mode") != "remove", F.col("approval_policy_mode")))


# The types of violations and what enforcement does to a plan for each.
MENDED = {"missing_mandatory": "inserted_count", "approval_required": "removed_count", "approval_deferred": "deferred_count", "order_violation": "reordered_count"}


def _having(name: str, value: str) -> Column:
    """How many violations have ``value`` in a field."""
    return F.size(F.filter("violations", lambda v: v[name] == value)).cast("bigint")


def run_rows(verifier: DataFrame) -> DataFrame:
    """One flat row per run: each run once, legacy mode names and deployment spellings unified, metrics from its lists."""
    name = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")) for c in ("incident_type", "severity", "asset_criticality")}
    runs = latest_copy(verifier, "run_id").withColumns(
        {
            **name,
            "incident_key": F.coalesce(F.nullif("incident_dir_id", F.lit("")), "incident_id"),
            "mode": F.when(F.col("mode") == "humano", "human").otherwise(F.col("mode")),
            "approval_policy_mode": F.coalesce(F.nullif("approval_policy_mode", F.lit("")), F.lit("remove")),
            "llm_deployment": F.nullif(F.lower(strip("llm_deployment")), F.lit("")),
            "llm_arm": F.nullif(strip("llm_arm"), F.lit("")),
            "violations": F.coalesce("violations", F.expr("cast(array() as array<struct<rule_id:string,severity:string,type:string,action:string,repair:string,missing_before:string>>)")),
            "llm_actions": _items("llm_actions"),
            "human_actions": _items("human_actions"),
            "enforced_actions": _items("enforced_actions"),
        }
    )
    p1, r1, f1, j1 = agreement(F.col("llm_actions"), F.col("human_actions"))
    p2, r2, f2, j2 = agreement(F.col("enforced_actions"), F.col("human_actions"))
    flat = runs.select(
        "run_id", "incident_key", "incident_type", "severity", "asset_criticality", "mode", "run_tag", "approval_policy_mode", "llm_deployment", "llm_arm",
        label().alias("model_label"), "violations", "llm_actions", "human_actions", "enforced_actions",
        F.size("violations").cast("bigint").alias("violation_count"),
        F.size(F.filter("violations", lambda v: v["severity"] == "hard")).cast("bigint").alias("hard_violation_count"),
        *[_having("severity", level).alias(f"{level}_violation_count") for level in ("soft", "warning")],
        *[_having("type", kind).alias(name) for kind, name in MENDED.items()],
        F.size("llm_actions").cast("bigint").alias("llm_action_count"), F.size("human_actions").cast("bigint").alias("human_action_count"), F.size("enforced_actions").cast("bigint").alias("enforced_action_count"),
        F.size(F.array_except("llm_actions", "human_actions")).cast("bigint").alias("llm_only_action_count"), F.size(F.array_except("human_actions", "llm_actions")).cast("bigint").alias("human_only_action_count"),
        F.coalesce("llm_usage.prompt_tokens", F.lit(0)).alias("prompt_tokens"), F.coalesce("llm_usage.completion_tokens", F.lit(0)).alias("completion_tokens"), F.coalesce("llm_usage.total_tokens", F.lit(0)).alias("total_tokens"),
        _measured("llm_latency_ms").cast("bigint").alias("latency_ms"), F.round(_measured("llm_cost_estimated_usd"), 6).alias("cost_usd"),
        p1.alias("precision_raw"), r1.alias("recall_raw"), f1.alias("f1_raw"), j1.alias("jaccard_raw"),
        p2.alias("precision_enforced"), r2.alias("recall_enforced"), f2.alias("f1_enforced"), j2.alias("jaccard_enforced"),
    )
    flat = flat.withColumn("modification_count", sum((F.col(c) for c in MENDED.values()), F.lit(0)).cast("bigint"))
    return flat.withColumns({"delta_jaccard": F.round(F.col("jaccard_enforced") - F.col("jaccard_raw"), 4), "coverage_delta": F.round(F.col("recall_enforced") - F.col("recall_raw"), 4)})


def latest_runs(rows: DataFrame) -> DataFrame:
    """The run with the greatest run_tag per (incident_key, model_label); equal tags: the smallest run_id.

    max_by keeps one row per group and combines on the map side, so no group is sorted.
    """
    columns = [c for c in rows.columns if c not in ("incident_key", "model_label")]
    best = F.max_by(F.struct(*columns), F.struct(F.coalesce("run_tag", F.lit("")), -F.col("run_id")))
    return rows.groupBy("incident_key", "model_label").agg(best.alias("_r")).select("incident_key", "model_label", "_r.*")


def by_model(rows: DataFrame) -> DataFrame:
    """Counts, sums, means and the violation rate with its interval, per model_label, in one aggregation."""
    violating = F.count_if(F.col("violation_count") > 0)
    sums = ["violation_count", "hard_violation_count", "soft_violation_count", "warning_violation_count", *MENDED.values(), "modification_count", "llm_only_action_count", "human_only_action_count", "prompt_tokens", "completion_tokens", "total_tokens", "latency_ms"]
    means = ["precision_raw", "recall_raw", "f1_raw", "jaccard_raw", "precision_enforced", "recall_enforced", "f1_enforced", "jaccard_enforced", "delta_jaccard", "coverage_delta"]
    out = rows.groupBy("model_label").agg(
        F.count(F.lit(1)).alias("run_count"), violating.alias("runs_with_violations"),
        *[F.sum(c).alias(f"{c}_total") for c in sums], F.round(F.sum(F.col("cost_usd").cast("decimal(18,6)")), 4).cast("double").alias("cost_usd_total"),
        *[rounded(F.avg(c), 4).alias(f"{c}_avg") for c in means], F.count_if(F.col("coverage_delta") < 0).alias("coverage_drop_runs"),
        F.count_if(F.col("modification_count") > 0).alias("modified_runs"),
    )
    low, high = wilson("runs_with_violations", "run_count")
    return out.withColumns({"violation_rate": rate("runs_with_violations", "run_count", 4), "ci_low": low, "ci_high": high})


def violation_rows(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode("violations").alias("_v")).select(*keep, "_v.*")


def by_rule(rows: DataFrame) -> DataFrame:
    return violation_rows(rows, "model_label").groupBy("model_label", "rule_id").agg(F.count(F.lit(1)).alias("violation_count"), F.count_if(F.col("severity") == "hard").alias("hard_violation_count"))


def violation_rate_by(rows: DataFrame, key: str) -> DataFrame:
    """key, support (runs), violating, violation_rate."""
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("violation_count") > 0).alias("violating"))
    return out.withColumn("violation_rate", rate("violating", "support", 4))


def by_rule_treatment(rows: DataFrame) -> DataFrame:
    """Violation rates per rule of the two arms of each deployment that has both; a run counts once per rule."""
    own = rows.where(F.col("llm_deployment").isNotNull() & F.col("llm_arm").isin(*ARMS))
    runs = own.groupBy("llm_deployment").pivot("llm_arm", list(ARMS)).agg(F.count(F.lit(1))).where(" and ".join(f"{a} is not null" for a in ARMS))
    runs = runs.select("llm_deployment", *[F.col(a).alias(f"{a}_runs") for a in ARMS])
    rules = F.array_distinct(F.transform("violations", lambda v: v["rule_id"]))
    hits = own.select("llm_deployment", "llm_arm", F.explode(rules).alias("rule_id")).groupBy("llm_deployment", "rule_id").pivot("llm_arm", list(ARMS)).agg(F.count(F.lit(1))).fillna(0, list(ARMS))
    out = hits.join(runs, "llm_deployment").select("rule_id", F.col("llm_deployment").alias("model"), *[F.col(f"{a}_runs") for a in ARMS], *[F.col(a).alias(f"{a}_violations") for a in ARMS])
    out = out.withColumns({f"{a}_rate": rate(f"{a}_violations", f"{a}_runs", 4) for a in ARMS})
    return out.withColumn("rate_diff", F.round(F.col(f"{ARMS[0]}_rate") - F.col(f"{ARMS[1]}_rate"), 4))


def pairwise(rows: DataFrame) -> DataFrame:
    """Every two models on the incidents that both have: rates, tests, effect sizes, Holm corrections.

    ``rows`` has at most one run per (incident, label); models are few, so an incident brings at
    most models^2 / 2 pairs.  Pairs are counted per flag before anything else, on the map side.
    """
    flags = rows.select("incident_key", "model_label", (F.col("violation_count") > 0).alias("bad"))
    a, b = flags.select("incident_key", F.col("model_label").alias("model_a"), F.col("bad").alias("bad_a")), flags.select("incident_key", F.col("model_label").alias("model_b"), F.col("bad").alias("bad_b"))
    met = a.join(b, "incident_key").where(F.col("model_a") < F.col("model_b"))
    out = met.groupBy("model_a", "model_b").agg(
        F.count(F.lit(1)).alias("paired"), F.count_if("bad_a").alias("violating_a"), F.count_if("bad_b").alias("violating_b"),
        F.count_if(F.col("bad_a") & ~F.col("bad_b")).alias("only_a"), F.count_if(~F.col("bad_a") & F.col("bad_b")).alias("only_b"),
    )
    z, p = two_proportions("violating_a", "paired", "violating_b", "paired")
    chi, mp = mcnemar("only_a", "only_b")
    ra, rb = rate("violating_a", "paired"), rate("violating_b", "paired")
    out = out.withColumns(
        {
            "rate_a": F.round(ra, 4), "rate_b": F.round(rb, 4), "rate_diff": F.round(ra - rb, 4), "z_score": F.round(z, 6), "p_value": F.round(p, 6),
            "cohens_h": F.round(cohens_h(ra, rb), 6), "cliffs_delta": F.round((F.col("only_a") - F.col("only_b")) / F.col("paired"), 6), "mcnemar_chi2": F.round(chi, 6), "mcnemar_p": F.round(mp, 6),
        }
    )
    tie = ["model_a", "model_b"]
    return holm(holm(out, "p_value", "p_value_holm", tie), "mcnemar_p", "mcnemar_p_holm", tie)


def summary(rows: DataFrame) -> DataFrame:
    """One row: totals, averages, distinct incidents and rates.

    Rows are added up per incident and model first, so the distinct counts expand groups, not rows.
    """
    sums = ["violation_count", "hard_violation_count", "llm_action_count", "human_action_count", "total_tokens"]
    per = rows.groupBy("incident_key", "model_label").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("violation_count") > 0).alias("_bad"), *[F.sum(c).alias(c) for c in sums])
    out = per.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("runs"), F.count_distinct("incident_key").alias("incidents"), F.count_distinct("model_label").alias("models"),
        F.coalesce(F.sum("violation_count"), F.lit(0)).alias("violations"), F.coalesce(F.sum("hard_violation_count"), F.lit(0)).alias("hard_violations"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("violating_runs"),
        F.count_distinct(F.when(F.col("_bad") > 0, F.col("incident_key"))).alias("violating_incidents"),
        F.round(F.sum("llm_action_count") / F.sum("_n"), 4).alias("llm_actions_avg"), F.round(F.sum("human_action_count") / F.sum("_n"), 4).alias("human_actions_avg"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"),
    )
    return out.withColumns({"run_violation_rate": rate("violating_runs", "runs", 4), "incident_violation_rate": rate("violating_incidents", "incidents", 4)})


def action_difference(rows: DataFrame, made: str, wanted: str) -> DataFrame:
    """action, n: in how many runs an action is in ``made`` but not in ``wanted``."""
    return rows.select(F.explode(F.array_except(made, wanted)).alias("action")).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def select_profiles(registry: DataFrame, selectors: DataFrame | None = None) -> DataFrame:
    """The models of a registry to run: the enabled ones, or one per row of ``selectors`` (selector).

    A selector means the first model (by name) with that name or deployment, enabled or not; one that fits
    none stands for itself, which ad_hoc tells.
    """
    if selectors is None:
        return registry.where("enabled").select(F.col("name").alias("selector"), "name", "deployment", F.lit(False).alias("ad_hoc"))
    keys = registry.select("name", "deployment", F.explode(F.array_distinct(F.array("name", "deployment"))).alias("selector"))
    first = keys.groupBy("selector").agg(F.min_by(F.struct("name", "deployment"), F.struct("name", "deployment")).alias("_m"))
    met = selectors.join(first, "selector", "left")
    return met.select("selector", F.coalesce("_m.name", "selector").alias("name"), F.coalesce("_m.deployment", "selector").alias("deployment"), F.col("_m").isNull().alias("ad_hoc"))


def grid(incidents: DataFrame, models: list[str], arms: list[str], repeats: int = 1) -> DataFrame:
    """The cells of an experiment: incident_key, model, arm, repeat for every incident.

    Models, arms and repeats are few and known, so each incident row makes its own cells: no join.
    """
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(a).alias("arm"), F.lit(r).alias("repeat")) for m in models for a in arms for r in range(1, repeats + 1)])
    return incidents.select("incident_key", F.explode(cells).alias("_c")).select("incident_key", "_c.*")


def outcomes(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Each cell with its run (the k-th of its incident, model and arm is repeat k) and error: missing, empty_plan or null."""
    order = Window.partitionBy("incident_key", "llm_deployment", "llm_arm").orderBy(F.coalesce("run_tag", F.lit("")), "run_id")
    own = rows.where(F.col("llm_deployment").isNotNull() & F.col("llm_arm").isNotNull())
    own = own.select("incident_key", F.col("llm_deployment").alias("model"), F.col("llm_arm").alias("arm"), F.row_number().over(order).alias("repeat"), "run_id", "llm_action_count")
    met = cells.join(own, ["incident_key", "model", "arm", "repeat"], "left")
    error = F.when(F.col("run_id").isNull(), "missing").when(F.col("llm_action_count") == 0, "empty_plan")
    return met.select("incident_key", "model", "arm", "repeat", "run_id", error.alias("error"))


def first_per(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row per ``keys``; a rank filter, so only the best row of each group is kept while sorting."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") == 1).drop("_rn")
