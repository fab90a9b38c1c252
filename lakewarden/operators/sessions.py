"""Sessions: each key's events split where nothing happened for longer than a gap.

Every event opens an interval of one gap; overlapping intervals of a key merge.  Merging
is associative, so it is done twice: first all events of a key that lie in one time slot
no wider than the gap become one interval (they can't be in different sessions), which is
a plain hash aggregation with map-side combine, whatever share of the rows a key has.
Then the intervals of a key are merged in order; there is at most one per slot, so even
the busiest key brings only (time span / gap) rows to a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.functions.numbers import slot
from lakewarden.functions.present import present


def slots(events: DataFrame, key: str, at_us: str, gap_us: int) -> DataFrame:
    """The merged interval of each key and time slot: key, start_us, end_us, event_count."""
    return (
        events.where(F.col(key).isNotNull() & F.col(at_us).isNotNull())
        .groupBy(F.col(key).alias(key), slot(at_us, gap_us).alias("_slot"))
        .agg(F.min(at_us).alias("start_us"), F.max(at_us).alias("end_us"), F.count(F.lit(1)).alias("event_count"))
    )


def merge_intervals(intervals: DataFrame, key: str, gap_us: int) -> DataFrame:
    """Merges the intervals of each key whose distance is at most ``gap_us``.

    Takes and gives key, start_us, end_us, event_count, so results of separate days or
    partitions can be united and merged again.
    """
    by_start = Window.partitionBy(key).orderBy("start_us", "end_us")
    before = F.max("end_us").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = intervals.withColumn("_new", F.when(F.col("start_us") - before <= gap_us, 0).otherwise(1))
    numbered = opened.withColumn("_session", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "_session").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("event_count").alias("event_count")
    ).drop("_session")


def sessionize(events: DataFrame, key: str, at_us: str, gap_us: int = 30 * 60 * 1_000_000) -> DataFrame:
    """One row per session: key, start_us, end_us, duration_us, event_count.

    A gap of more than ``gap_us`` starts a new session; exactly ``gap_us`` does not.  Rows
    with a null key or instant are left out, events at one instant all count, an empty
    table gives no rows.  ``events`` must already be free of copies.
    """
    merged = merge_intervals(slots(events, key, at_us, gap_us), key, gap_us)
    return merged.select(key, "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "event_count")


def actor_events(timed: DataFrame, at_us: str = "instant_us") -> DataFrame:
    """event_id, actor, instant_us of each event once; the actor is the present username, else the present source_ip.

    Deliveries of an event are alike but for line_no and ingested_at, so equal
    (event_id, actor, instant) are one event.
    """
    actor = F.coalesce(present("username"), present("source_ip"))
    return (
        timed.select("event_id", actor.alias("actor"), F.col(at_us).alias("instant_us"))
        .where(F.col("actor").isNotNull() & F.col("instant_us").isNotNull())
        .distinct()
    )
