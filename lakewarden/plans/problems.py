"""Queries of the general training-data problems: sessions, nested records, mixed time writings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.operators.instants import rewritten, source_zones, with_instant
from lakewarden.operators.nested import candidates, node_rows, objects, pivot
from lakewarden.operators.sessions import actor_events, sessionize
from lakewarden.plans import problem_sql
from lakewarden.sources.tables import table

MINUTE_US = 60 * 1_000_000


def timed_telemetry(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """The named columns of telemetry and the instant of each row's timestamp."""
    zones = source_zones(table(spark, root, "log_sources"))
    events = table(spark, root, "telemetry").select("timestamp", F.col("details.log_source").alias("_log_source"), *columns)
    return with_instant(events, "timestamp", "_log_source", zones).select(*columns, "instant_us")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    events = actor_events(timed_telemetry(spark, root, "event_id", "username", "source_ip"))
    return sessionize(events, "actor", "instant_us", 30 * MINUTE_US).select("actor", "start_us", "end_us", "event_count")


def nested_rows(spark: SparkSession, root: str, lists_only: bool = False) -> DataFrame:
    """owner_table and the rows of all nodes of the nested records; ``lists_only``: only of records that can hold a list.

    Copies of a record are alike in what is read here, so distinct rows are distinct records.
    """
    events = table(spark, root, "telemetry").select("event_id", "details.raw", "details.source_summary")
    if lists_only:
        events = events.where(F.col("raw").rlike(candidates()) | F.col("source_summary").rlike(candidates()))
    events = node_rows(events.distinct(), "event_id", ["raw", "source_summary"])
    runs = table(spark, root, "verifier_output").where(F.size("violations") > 0)
    runs = node_rows(runs.select("run_id", F.to_json("violations", {"ignoreNullFields": "false"}).alias("violations")).distinct(), "run_id", ["violations"])
    return events.select(F.lit("telemetry").alias("owner_table"), "*").unionByName(runs.select(F.lit("verifier_output").alias("owner_table"), "*"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return objects(nested_rows(spark, root, lists_only=True)).select("owner_table", "owner_id", "node_path", "parent_path")


def p5_values(spark: SparkSession, root: str) -> DataFrame:
    """Every scalar of the nested records in the row that it belongs to."""
    found = nested_rows(spark, root)
    return found.select("owner_table", "owner_id", "node_path", F.explode("fields").alias("field", "value"))


def p5_violations(spark: SparkSession, root: str) -> DataFrame:
    """One of the flat tables: a row per violation, with its fields as columns."""
    rows = nested_rows(spark, root).where("owner_table = 'verifier_output'")
    return pivot(rows, "violations[]", ["rule_id", "severity", "type", "action", "repair", "missing_before"])


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    zones = source_zones(table(spark, root, "log_sources"))
    events = table(spark, root, "telemetry").select("event_id", "timestamp", "details.log_source")
    incidents = table(spark, root, "incident_meta")
    return rewritten(events, "event_id", ["timestamp"], "log_source", zones, "telemetry").unionByName(
        rewritten(incidents, "incident_id", ["time_window_start", "time_window_end"], "reporting_source", zones, "incident_meta")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p3_found": p3_found, "p5_found": p5_found, "p5_values": p5_values, "p5_violations": p5_violations, "p6_found": p6_found}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": problem_sql.P3, "p5_found": problem_sql.P5, "p5_values": problem_sql.P5_VALUES, "p5_violations": problem_sql.P5_VIOLATIONS, "p6_found": problem_sql.P6}
