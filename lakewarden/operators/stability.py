"""Repeated runs: which repeat a run is, filling failed slots, and how stable the metrics are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repeat_index(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds repeat, from 1, in order of ``order`` within the keys."""
    return rows.withColumn("repeat", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def fill_slots(slots: DataFrame, spare: DataFrame, keys: list[str], slot_order: list[str], spare_order: list[str]) -> DataFrame:
    """The k-th free slot of a key takes the k-th spare record of it; slots without one are left out."""
    a = slots.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*slot_order)))
    b = spare.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*spare_order)))
    return a.join(b, [*keys, "_k"]).drop("_k")


def metric_series(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, smallest, largest and range of a metric over its repeats, rounded to 6."""
    v = F.col(value)
    out = values.groupBy(*keys).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("smallest"), F.max(v).alias("largest"))
    return out.withColumn("spread", F.round(F.col("largest") - F.col("smallest"), 6))


def conformance(made: DataFrame, declared: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """keys, made, declared, ok: whether a recomputed value is within ``tolerance`` of the declared one; missing ones aren't."""
    a, b = made.select(*keys, F.col(value).alias("made")), declared.select(*keys, F.col(value).alias("declared"))
    return a.join(b, keys, "full").withColumn("ok", F.coalesce(F.abs(F.col("made") - F.col("declared")) <= tolerance, F.lit(False)))
