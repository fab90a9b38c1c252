"""Repeated consecutive events: each run of alike events becomes one row with count and duration.

Within an entity's ordered events, the row number minus the row number among events of the
same canonical value is constant along a run and differs between runs of that value.

An entity may hold a third of all rows, even within an hour, so the numbering is done per entity
and block: an hour, and within a crowded hour the stretches between split points, which are
every so many events by a hash of their ids.  A block holds about that many rows at most, whatever
the keys are.  Each run that could go on in the next or previous block is then joined to its
neighbour: only a block's first and last run can, so an entity brings at most two rows per
block to the second step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.functions.numbers import slot
from lakewarden.sources.tables import bounded_rows

HOUR_US = 3_600_000_000
#: Events of a block within an hour, about.
BLOCK_ROWS = 1_000_000
#: Split points that may be broadcast; more of them are joined by salts.
BROADCAST_SPLITS, SALTS = 100_000, 64


def canonical(value: Column | str) -> Column:
    """Lower case letters and digits of ``value``, without digits at the end."""
    value = F.col(value) if isinstance(value, str) else value
    return F.regexp_replace(F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]+", "")), r"\p{N}+$", "")


def _in_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Where there are split points, adds _k, the stretch between split points in which a row (_e, _b, _t, _i) lies within its hour, and _ks, the last there is.

    About one event in ``block_rows`` is a split point, by its id.  It begins a stretch.
    """
    split = F.pmod(F.xxhash64("_i"), F.lit(block_rows)) == 0
    points = rows.where(split & F.col("_i").isNotNull()).groupBy(F.col("_e").alias("_pe"), F.col("_b").alias("_pb")).agg(F.sort_array(F.collect_set(F.struct("_t", "_i"))).alias("_at"))
    few = bounded_rows(points.select(F.explode("_at")), BROADCAST_SPLITS)
    if few == []:
        return rows
    if few is not None:
        met = rows.join(F.broadcast(points), (F.col("_e") == F.col("_pe")) & (F.col("_b") == F.col("_pb")), "left")
    else:
        salted = points.withColumn("_ps", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = rows.withColumn("_s", F.pmod(F.xxhash64("_t", "_i"), F.lit(SALTS)))
        met = own.join(salted, (F.col("_e") == F.col("_pe")) & (F.col("_b") == F.col("_pb")) & (F.col("_s") == F.col("_ps")), "left").drop("_s", "_ps")
    passed = F.size(F.filter("_at", lambda p: p <= F.struct(F.col("_t").alias("_t"), F.col("_i").alias("_i"))))
    return met.withColumns({"_k": F.when(F.col("_at").isNull(), 0).otherwise(passed), "_ks": F.when(F.col("_at").isNull(), 0).otherwise(F.size("_at"))}).drop("_pe", "_pb", "_at")


def collapse_runs(
    events: DataFrame, entity: str, at_us: str, order_id: str, value: str, pause_us: int = 15 * 60 * 1_000_000, min_length: int = 1, block_us: int = HOUR_US, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per maximal run: entity, value, first_event_id, last_event_id, start_us, end_us, duration_us, run_length.

    Events of an entity are ordered by ``at_us``, then ``order_id``; neighbours in a run have the
    same ``value`` (already canonical) and are at most ``pause_us`` apart.  Runs of fewer than
    ``min_length`` events are left out.  Rows with a null entity or instant are left out; a null value equals no other,
    so it ends a run and is a run of its own.  Rows alike in all five columns are copies and
    count once.  ``block_us`` must not be less than ``pause_us``; it and ``block_rows`` change no result.
    """
    if block_us < pause_us:
        raise ValueError("block_us must not be less than pause_us")
    keep = F.col(entity).isNotNull() & F.col(at_us).isNotNull()
    rows = events.where(keep).select(F.col(entity).alias("_e"), slot(at_us, block_us).alias("_b"), F.col(at_us).alias("_t"), F.col(order_id).alias("_i"), F.col(value).alias("_v"))
    rows = _in_blocks(rows, block_rows)
    # A constant as a third key would be shuffled for once more.
    block, stretch = (["_e", "_b", "_k"], F.max("_ks")) if "_k" in rows.columns else (["_e", "_b"], F.lit(0))
    rows = rows.repartition(*block).distinct()
    in_block = Window.partitionBy(*block).orderBy("_t", "_i")
    numbered = rows.select(
        "*",
        F.row_number().over(in_block).alias("_n"),
        F.lag("_t").over(in_block).alias("_before"),
    )
    numbered = numbered.withColumn("_s", F.sum(F.when(F.col("_t") - F.col("_before") > pause_us, 1).otherwise(0)).over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    of_value = Window.partitionBy(*block, "_v").orderBy("_n")
    numbered = numbered.withColumn("_d", F.when(F.col("_v").isNull(), -F.col("_n")).otherwise(F.col("_n") - F.row_number().over(of_value)))
    parts = numbered.groupBy(*block, "_v", "_d", "_s").agg(
        F.min("_t").alias("_from"), F.max("_t").alias("_to"),
        F.min_by("_i", "_n").alias("_first"), F.max_by("_i", "_n").alias("_last"),
        F.count(F.lit(1)).alias("_c"), F.min("_n").alias("_lo"), F.max("_n").alias("_hi"), stretch.alias("_ks"),
    )
    # A run may go on over a border only if no event of the entity stands between it and the border.
    size = Window.partitionBy(*block)
    parts = parts.withColumn("_most", F.max("_hi").over(size)).withColumn("_k", F.col("_k") if "_k" in block else F.lit(0))
    # Before the first split point there may be no event, so what follows it can go on from the hour before.
    opens = (F.col("_lo") == 1) & ((F.col("_k") > 0) | (F.col("_from") - F.col("_b") * block_us <= pause_us))
    closes = (F.col("_hi") == F.col("_most")) & ((F.col("_k") < F.col("_ks")) | ((F.col("_b") + 1) * block_us - F.col("_to") <= pause_us))
    parts = parts.withColumn("_open", opens).withColumn("_close", closes)
    parts = parts.where(F.col("_open") | F.col("_close") | (F.col("_c") >= min_length))
    # Edges go to the second step by entity; all others have a key of their own and stay spread.
    edge = F.col("_open") | F.col("_close")
    parts = parts.withColumns({"_edge": edge, "_spread": F.when(edge, F.lit(None).cast("bigint")).otherwise(F.xxhash64("_b", "_k", "_lo"))})
    chain = Window.partitionBy("_e", "_spread").orderBy("_b", "_k", "_lo")
    before = {c: F.lag(c).over(chain) for c in ("_b", "_k", "_ks", "_v", "_to", "_close")}
    next_stretch = (before["_b"] == F.col("_b")) & (before["_k"] == F.col("_k") - 1)
    next_hour = (before["_b"] == F.col("_b") - 1) & (before["_k"] == before["_ks"]) & (F.col("_k") <= 1)
    goes_on = F.col("_edge") & F.col("_open") & before["_close"] & (next_stretch | next_hour) & (before["_v"] == F.col("_v")) & (F.col("_from") - before["_to"] <= pause_us)
    linked = parts.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    linked = linked.withColumn("_run", F.sum("_new").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        linked.groupBy("_e", "_spread", "_run", "_v")
        .agg(
            F.min_by("_first", F.struct("_from", "_k", "_lo")).alias("first_event_id"), F.max_by("_last", F.struct("_from", "_k", "_lo")).alias("last_event_id"),
            F.min("_from").alias("start_us"), F.max("_to").alias("end_us"), F.sum("_c").alias("run_length"),
        )
        .where(F.col("run_length") >= min_length)
        .select(
            F.col("_e").alias(entity), F.col("_v").alias("value"), "first_event_id", "last_event_id", "start_us", "end_us",
            (F.col("end_us") - F.col("start_us")).alias("duration_us"), "run_length",
        )
    )
