"""Queries of the corpus and model-run problems, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.functions.present import present, strip
from lakewarden.llm.cooccurrence import pairs
from lakewarden.llm.leakage import leaks, without_leaks
from lakewarden.llm.mixing import mix
from lakewarden.llm.mojibake import repair
from lakewarden.llm.quantiles import build, combine, percentiles, place_of, settle, weighted
from lakewarden.llm.runs import canonical, collapse_runs
from lakewarden.plans.problem_sql import EVENTS, instants
from lakewarden.plans.problems import MINUTE_US, timed_telemetry
from lakewarden.sources.tables import cut, table

PLAN_FIELDS = ["llm_actions", "human_actions", "enforced_actions"]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Copies of a run are alike in what is read here, so distinct rows are distinct runs."""
    runs = table(spark, root, "verifier_output").select("run_id", *PLAN_FIELDS).where(F.col("run_id").isNotNull())
    found = pairs(runs.distinct(), PLAN_FIELDS, min_count=3, min_share=(1, 1000), min_lift=2.0)
    return found.select("field_name", "action_a", "action_b")


def measurements(spark: SparkSession, root: str) -> DataFrame:
    """llm_deployment, week_start, metric_name, value of every run once; what is no measurement is left out."""
    stamp = F.regexp_extract("run_tag", r"(\d{8})T\d{12}Z$", 1)
    day = F.when(stamp != "", F.concat_ws("-", stamp.substr(1, 4), stamp.substr(5, 2), stamp.substr(7, 2)).try_cast("date"))
    runs = (
        table(spark, root, "verifier_output")
        .select(
            "run_id",
            F.lower(strip("llm_deployment")).alias("llm_deployment"),
            F.date_format(F.date_trunc("week", day.cast("timestamp")), "yyyy-MM-dd").alias("week_start"),
            F.col("llm_latency_ms").cast("double").alias("a"),
            F.col("llm_cost_estimated_usd").alias("b"),
        )
        .where((F.col("llm_deployment") != "") & F.col("week_start").isNotNull())
        .distinct()
    )
    metrics = F.array(F.struct(F.lit("llm_latency_ms").alias("metric_name"), F.col("a").alias("value")), F.struct(F.lit("llm_cost_estimated_usd").alias("metric_name"), F.col("b").alias("value")))
    values = runs.select("llm_deployment", "week_start", F.explode(metrics).alias("m")).select("llm_deployment", "week_start", "m.metric_name", "m.value")
    return values.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") >= 0))


# Metric, percentile and what it is held against.
LIMITS = {"llm_latency_ms": (95, 30000.0), "llm_cost_estimated_usd": (50, 0.02)}
GROUP = ["llm_deployment", "week_start", "metric_name"]
#: Values per buffer for weeks and deployments, which hold hundreds to thousands of values: enough buffers collapse.
WEEK_BUFFER = 64


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Groups decided by the sketch's bounds, and the exact count of values for those within its error."""
    decided = p2_verdicts(spark, root)
    values = measurements(spark, root)
    open_groups = decided.where(F.col("over").isNull()).drop("over")
    upto = values.join(open_groups, GROUP).groupBy(*GROUP, "place").agg(F.count_if(F.col("value") <= F.col("limit")).alias("upto"))
    return decided.where("over").select(*GROUP).unionByName(upto.where(F.col("upto") < F.col("place")).select(*GROUP))


def p2_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """Each group's place and limit, and whether its percentile is over the limit: null where the sketch's bounds leave it open."""
    sketches = cut(build(measurements(spark, root), GROUP, "value", WEEK_BUFFER))

    def decide(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                p, limit = LIMITS[row.metric_name]
                place = place_of(p, int(row.n))
                held, ranks = weighted(row)
                upto = int(np.searchsorted(held, limit, side="right"))
                rank = int(ranks[upto - 1]) if upto else 0
                verdict = True if rank + int(row.under) < place else False if rank - int(row.over) >= place else None
                out.append((row.llm_deployment, row.week_start, row.metric_name, place, limit, verdict))
            yield pd.DataFrame(out, columns=[*GROUP, "place", "limit", "over"])

    return sketches.mapInPandas(decide, "llm_deployment string, week_start string, metric_name string, place bigint, limit double, over boolean")


WANTED = [5, 25, 50, 75, 95, 99]


def p2_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles of each deployment over all weeks: weekly sketches are combined, and their bounds then settled exactly."""
    values = measurements(spark, root)
    keys = ["llm_deployment", "metric_name"]
    weekly = build(values, GROUP, "value", WEEK_BUFFER)
    bounds = cut(percentiles(combine(weekly.drop("week_start"), keys, WEEK_BUFFER), keys, WANTED))
    return settle(values, keys, "value", bounds)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    events = timed_telemetry(spark, root, "event_id", "event_type", "source_ip")
    events = events.select("event_id", "instant_us", present("source_ip").alias("source_ip"), canonical("event_type").alias("kind"))
    found = collapse_runs(events, "source_ip", "instant_us", "event_id", "kind", pause_us=15 * MINUTE_US, min_length=2)
    return found.select("source_ip", "first_event_id", "last_event_id", "run_length")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return leaks(table(spark, root, "documents"), table(spark, root, "eval_items"), min_words=12).select("doc_id", "item_id")


def p7_kept(spark: SparkSession, root: str) -> DataFrame:
    """The documents that hold nothing of any item."""
    documents = table(spark, root, "documents")
    return without_leaks(documents, leaks(documents, table(spark, root, "eval_items"), min_words=12)).select("doc_id", "n_chars")


def p8_mixture(spark: SparkSession, root: str) -> DataFrame:
    return mix(table(spark, root, "documents"), table(spark, root, "mix_targets")).rows


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return repair(table(spark, root, "documents")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_percentiles": p2_percentiles, "p4_found": p4_found, "p7_found": p7_found, "p7_kept": p7_kept, "p8_mixture": p8_mixture, "p9_found": p9_found}


P1_SQL = """
WITH runs AS (
  SELECT * FROM verifier_output WHERE run_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY written_at) = 1),
records AS (
  SELECT run_id, 'llm_actions' AS field_name, llm_actions AS items FROM runs
  UNION ALL SELECT run_id, 'human_actions', human_actions FROM runs
  UNION ALL SELECT run_id, 'enforced_actions', enforced_actions FROM runs),
held AS (SELECT * FROM records WHERE len(items) > 0),
n AS (SELECT field_name, count(*) AS n FROM held GROUP BY 1),
single AS (SELECT DISTINCT field_name, run_id, unnest(items) AS action FROM held),
known AS (SELECT * FROM single WHERE action IS NOT NULL),
one AS (SELECT field_name, action, count(*) AS n FROM known GROUP BY 1, 2),
two AS (
  SELECT a.field_name, a.action AS action_a, b.action AS action_b, count(*) AS n_ab
  FROM known a JOIN known b ON a.run_id = b.run_id AND a.field_name = b.field_name AND a.action < b.action GROUP BY 1, 2, 3)
SELECT t.field_name, action_a, action_b FROM two t
JOIN n ON n.field_name = t.field_name
JOIN one a ON a.field_name = t.field_name AND a.action = action_a
JOIN one b ON b.field_name = t.field_name AND b.action = action_b
WHERE n_ab >= 3 AND n_ab * 1000 >= n.n AND n_ab * n.n >= 2 * a.n * b.n
"""

_P2_VALUES = """
WITH runs AS (
  SELECT * FROM verifier_output QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY written_at) = 1),
stamped AS (
  SELECT lower(trim(llm_deployment, chr(32) || chr(9) || chr(10) || chr(13))) AS llm_deployment,
    strftime(date_trunc('week', try_strptime(regexp_extract(run_tag, '([0-9]{8})T[0-9]{12}Z$', 1), '%Y%m%d')), '%Y-%m-%d') AS week_start,
    llm_latency_ms, llm_cost_estimated_usd FROM runs),
v AS (
  SELECT llm_deployment, week_start, 'llm_latency_ms' AS metric_name, CAST(llm_latency_ms AS DOUBLE) AS value, 95 AS p, 30000.0 AS lim FROM stamped
  UNION ALL SELECT llm_deployment, week_start, 'llm_cost_estimated_usd', llm_cost_estimated_usd, 50, 0.02 FROM stamped)"""

P2_SQL = f"""{_P2_VALUES},
placed AS (
  SELECT *, row_number() OVER g AS place, count(*) OVER (PARTITION BY llm_deployment, week_start, metric_name) AS n FROM v
  WHERE value >= 0 AND NOT isnan(value) AND llm_deployment <> '' AND week_start IS NOT NULL
  WINDOW g AS (PARTITION BY llm_deployment, week_start, metric_name ORDER BY value))
SELECT llm_deployment, week_start, metric_name FROM placed WHERE place = (p * n + 99) // 100 AND value > lim
"""

P2_PERCENTILES = f"""{_P2_VALUES},
placed AS (
  SELECT llm_deployment, metric_name, value, row_number() OVER (PARTITION BY llm_deployment, metric_name ORDER BY value) AS place, count(*) OVER (PARTITION BY llm_deployment, metric_name) AS n FROM v
  WHERE value >= 0 AND NOT isnan(value) AND llm_deployment <> '' AND week_start IS NOT NULL),
wanted(percentile) AS (VALUES {", ".join(f"({p})" for p in WANTED)})
SELECT llm_deployment, metric_name, CAST(percentile AS DOUBLE) AS percentile, n, value AS exact FROM placed, wanted WHERE place = (percentile * n + 99) // 100
"""


P4_SQL = f"""WITH {instants(EVENTS)},
e AS (SELECT source_ip, event_id, instant_us AS t, regexp_replace(regexp_replace(lower(event_type), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '\\p{{N}}+$', '') AS v FROM timed WHERE source_ip IS NOT NULL AND instant_us IS NOT NULL),
m AS (SELECT *, CASE WHEN v = lag(v) OVER w AND t - lag(t) OVER w <= 900000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY source_ip ORDER BY t, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY source_ip ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT source_ip, arg_min(event_id, (t, event_id)) AS first_event_id, arg_max(event_id, (t, event_id)) AS last_event_id, count(*) AS run_length FROM s GROUP BY source_ip, k HAVING count(*) > 1"""

# Every stretch of twelve words of an item, looked up among those of every document.
_P7 = r"""
WITH d AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id AS id, text FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT id, regexp_extract_all(lower(regexp_replace(nfc_normalize(text), '[\p{Cf}]', '', 'g')), '[\p{L}\p{N}]+') AS w FROM d),
iw AS (SELECT id, regexp_extract_all(lower(regexp_replace(nfc_normalize(text), '[\p{Cf}]', '', 'g')), '[\p{L}\p{N}]+') AS w FROM i),
dg AS (SELECT id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM dw WHERE len(w) >= 12),
ig AS (SELECT id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM iw WHERE len(w) >= 12)"""
P7_SQL = f"""{_P7}
SELECT DISTINCT dg.id AS doc_id, ig.id AS item_id FROM dg JOIN ig USING (g)"""
P7_KEPT = f"""{_P7}
SELECT doc_id, n_chars FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT dg.id FROM dg JOIN ig USING (g) WHERE dg.id IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p2_found": P2_SQL, "p2_percentiles": P2_PERCENTILES, "p4_found": P4_SQL, "p7_found": P7_SQL, "p7_kept": P7_KEPT}
