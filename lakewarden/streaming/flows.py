"""Structured Streaming forms of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.operators.enforce import Rule, scope_predicate


def session_stream(events: DataFrame, key: str, at: str, event_id: str, gap_us: int = 30 * 60 * 1_000_000, late: str = "3 days") -> DataFrame:
    """Sessions of a stream: key, start_us, end_us, event_count, given out once the watermark has passed them.

    Every event opens an interval as long as the gap; overlapping intervals of a key merge in the
    state store, so events up to ``late`` behind still join, extend or bridge sessions.  A
    delivery that is repeated within that time counts once.  ``at`` is a TIMESTAMP; rows with a
    null key or time are left out.
    """
    # Intervals that only touch are merged, so a gap of exactly gap_us starts no session.
    kept = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late).dropDuplicatesWithinWatermark([event_id])
    window = F.session_window(F.col(at), f"{gap_us} microseconds")
    found = kept.groupBy(window, F.col(key)).agg(F.count(F.lit(1)).alias("event_count"), F.max(at).alias("_last"))
    return found.select(key, F.unix_micros(F.col("session_window.start")).alias("start_us"), F.unix_micros("_last").alias("end_us"), "event_count")


def scope_stream(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Each event of a stream with the ids of the rules in whose scope it lies; stateless."""
    return events.withColumn("matched", F.array_compact(F.array(*[F.when(scope_predicate(r.scope), r.rule_id) for r in rules])))
