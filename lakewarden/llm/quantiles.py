"""Percentiles of very large columns with a proven rank error, in a form that can be combined.

Deterministic buffer collapsing.  A sketch holds sorted buffers of exactly ``k`` values;
a buffer at level l stands for values of weight 2**l.  Two buffers of a level collapse
into one of the next by taking every second value of the merged sequence, starting in
turn with the first and the second.  A collapse at level l moves the estimated rank of
any value by at most 2**l, upwards or downwards according to the start, and the sketch
adds that up (``over``, ``under``): true rank is in [estimate - over, estimate + under].
With n values that is about n * log2(n / k) / (4 k) on either side.

Sketches are made where the rows lie, then merged in a tree (first within salts, then
across), so a group with any share of the rows never comes to one task as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Values per buffer.  2048 keeps the rank error of a billion values below 0.25 %.
BUFFER = 2048
#: Sketches of one group are merged within this many salts first.
SALTS = 64
#: Values that a task holds before it gives away what it has.
HELD = 4_000_000

_FIELDS = "k int, n bigint, over bigint, under bigint, smallest double, largest double, turns array<bigint>, sizes array<int>, data array<double>"


class Sketch:
    """The buffers of one group."""

    def __init__(self, k: int):
        self.k, self.n, self.over, self.under = k, 0, 0, 0
        self.smallest, self.largest = np.inf, -np.inf
        self.tail: list[np.ndarray] = []
        self.held = 0
        self.levels: list[np.ndarray | None] = []
        self.turns: list[int] = []

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.n += len(values)
            self.smallest, self.largest = min(self.smallest, values.min()), max(self.largest, values.max())
            self._loose(values)

    def _loose(self, values: np.ndarray) -> None:
        self.tail.append(values)
        self.held += len(values)
        if self.held >= self.k:
            flat = np.concatenate(self.tail)
            whole = self.held // self.k * self.k
            self.tail, self.held = [flat[whole:]], self.held - whole
            for at in range(0, whole, self.k):
                self._carry(np.sort(flat[at : at + self.k]), 0)

    def _carry(self, buffer: np.ndarray, level: int) -> None:
        while True:
            while len(self.levels) <= level:
                self.levels.append(None)
                self.turns.append(0)
            if self.levels[level] is None:
                self.levels[level] = buffer
                return
            both = np.sort(np.concatenate([self.levels[level], buffer]), kind="stable")
            start = self.turns[level] % 2
            buffer, self.levels[level] = both[start::2], None
            self.turns[level] += 1
            if start:
                self.under += 1 << level
            else:
                self.over += 1 << level
            level += 1

    def merge(self, row: object) -> None:
        """Takes in a stored sketch (a row with the columns of row()); one with another k can't be."""
        if int(row.k) != self.k:
            raise ValueError(f"a sketch with k = {row.k} can't be merged into one with k = {self.k}")
        self.n += int(row.n)
        self.over, self.under = self.over + int(row.over), self.under + int(row.under)
        self.smallest, self.largest = min(self.smallest, row.smallest), max(self.largest, row.largest)
        for level, turns in enumerate(row.turns):
            while len(self.turns) <= level:
                self.levels.append(None)
                self.turns.append(0)
            self.turns[level] += int(turns)
        at = 0
        for level, size in enumerate(row.sizes):
            part = np.asarray(row.data[at : at + size], dtype=float)
            at += size
            if size and level:
                self._carry(part, level - 1)
            elif size:
                self._loose(part)

    def row(self) -> tuple:
        """What is stored: sizes and data hold the values without a buffer first, then the buffer of each level (or none)."""
        parts = [np.sort(np.concatenate(self.tail)) if self.held else np.empty(0), *[b if b is not None else np.empty(0) for b in self.levels]]
        return (self.k, self.n, self.over, self.under, float(self.smallest), float(self.largest), self.turns, [len(p) for p in parts], np.concatenate(parts))


def weighted(row: object) -> tuple[np.ndarray, np.ndarray]:
    """The values of a stored sketch in order, and the estimated rank of each (values up to and with it)."""
    values = np.asarray(row.data, dtype=float)
    weights = np.concatenate([np.full(size, 1 << max(0, i - 1), dtype=np.int64) for i, size in enumerate(row.sizes)])
    order = np.argsort(values, kind="stable")
    return values[order], np.cumsum(weights[order])


def _batch(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def build(df: DataFrame, keys: list[str], value: str, k: int = BUFFER) -> DataFrame:
    """One sketch per group of ``keys``: the keys, k, n, over, under, smallest, largest, turns, sizes, data.

    Null and NaN values are left out; groups without values give no row.  Null keys are a group
    of their own.  Ties and repeated rows all count.  A key named like a column of the sketch is
    refused; other columns may have any name.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_value")).where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    schema = _stored(rows, keys)
    arrow = to_arrow_schema(schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        found: dict[tuple, Sketch] = {}
        held = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            order = pc.sort_indices(table, [(c, "ascending") for c in keys])
            table = table.take(order)
            values = table.column(len(keys)).to_numpy()
            # Where a key differs from the row before, a group begins.
            names = list(zip(*[table.column(i).to_pylist() for i in range(len(keys))], strict=True)) if keys else [()] * len(values)
            starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(names)], strict=True):
                sketch = found.get(names[a])
                if sketch is None:
                    sketch = found[names[a]] = Sketch(k)
                sketch.add(values[a:b].copy())
            held += len(names)
            if held >= HELD:
                yield _batch([(*key, part, *sketch.row()) for key, sketch in found.items()], arrow)
                found, held = {}, 0
        if found:
            yield _batch([(*key, part, *sketch.row()) for key, sketch in found.items()], arrow)

    return combine(rows.mapInArrow(first, schema), keys, k)


def _stored(df: DataFrame, keys: list[str]) -> T.StructType:
    taken = {"_part", "_value", *T.StructType.fromDDL(_FIELDS).names} & set(keys)
    if taken:
        raise ValueError(f"keys with the names of a sketch's own columns: {sorted(taken)}")
    return T.StructType([*[df.schema[c] for c in keys], T.StructField("_part", T.IntegerType()), *T.StructType.fromDDL(_FIELDS).fields])


def combine(sketches: DataFrame, keys: list[str], k: int = BUFFER) -> DataFrame:
    """Merges sketches of the same keys, for instance of separate days, into one each.

    Errors add up as in a single build; a sketch that was built with another ``k`` fails the job.
    Sketches come to a task in the order of their keys and are merged one by one, so a task
    holds one group at a time.
    """
    if "_part" not in sketches.columns:
        sketches = sketches.withColumn("_part", F.spark_partition_id())
    schema = _stored(sketches, keys)
    arrow = to_arrow_schema(schema)
    names = schema.names
    sketches = sketches.select(*names)
    count = int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def merge(batches: Iterator[pa.RecordBatch], salted: bool) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at, sketch, salt = None, None, 0
        for batch in batches:
            columns = {c: batch.column(i) for i, c in enumerate(names)}
            data, ends = columns["data"].values.to_numpy(), columns["data"].offsets.to_numpy()
            plain = {c: columns[c].to_pylist() for c in names if c != "data"}
            for i in range(batch.num_rows):
                key = (*[plain[c][i] for c in keys], plain["_part"][i] % SALTS)
                if key[:-1] != (at[:-1] if at else None) or (salted and key != at):
                    if sketch is not None:
                        out.append((*at[:-1], salt, *sketch.row()))
                        if len(out) >= 64:
                            yield _batch(out, arrow)
                            out = []
                    at, sketch, salt = key, Sketch(k), key[-1]
                row = SimpleNamespace(**{c: plain[c][i] for c in plain}, data=data[ends[i] : ends[i + 1]])
                sketch.merge(row)
        if sketch is not None:
            out.append((*at[:-1], salt, *sketch.row()))
        if out:
            yield _batch(out, arrow)

    for salted in (True, False):
        by = [*[F.col(c) for c in keys], *([F.pmod("_part", F.lit(SALTS))] if salted else [])]
        sketches = sketches.repartition(count, *by).sortWithinPartitions(*by, "_part").mapInArrow(partial(merge, salted=salted), schema)
    return sketches.drop("_part")


def percentiles(sketches: DataFrame, keys: list[str], wanted: list[float]) -> DataFrame:
    """keys, percentile, n, place, estimate, above, at_most, rank_error of each stored sketch.

    The p-th percentile of n values is the one at place ceil(p * n / 100) in ascending order.
    It is certainly greater than ``above`` (null: no bound) and at most ``at_most``.
    """
    schema = T.StructType([*[sketches.schema[c] for c in keys], *T.StructType.fromDDL("percentile double, n bigint, place bigint, estimate double, above double, at_most double, rank_error double").fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, row in zip(frame[keys].itertuples(index=False, name=None), frame.itertuples(index=False), strict=True):
                values, ranks = weighted(row)
                for p in wanted:
                    place = place_of(p, int(row.n))
                    at = np.searchsorted(ranks, place)
                    sure = np.searchsorted(ranks, place + int(row.over))
                    below = np.searchsorted(ranks + int(row.under), place) - 1
                    # Equal values stand in a row: the rank of a value is that of its last place.
                    while below >= 0 and below + 1 < len(values) and values[below + 1] == values[below]:
                        below -= 1
                    out.append((*key, float(p), int(row.n), place, float(values[min(at, len(values) - 1)]), float(values[below]) if below >= 0 else None, float(values[sure]) if sure < len(values) else float(row.largest), max(row.over, row.under) / row.n))
            yield pd.DataFrame(out, columns=schema.names)

    return sketches.mapInPandas(run, schema)


def settle(values: DataFrame, keys: list[str], value: str, bounds: DataFrame) -> DataFrame:
    """keys, percentile, n, exact: the percentiles themselves, from the bounds that percentiles() gave for the same rows.

    Values up to ``above`` are only counted, those beyond ``at_most`` are left out; of the few in
    between, equal ones are counted together on the map side before they are put in order.
    Null keys find no bounds.
    """
    own = values.select(*keys, F.col(value).cast("double").alias("_value")).where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    asked = bounds.select(*keys, "percentile", "n", "place", "above", "at_most")
    met = own.join(asked, keys).where(F.col("_value") <= F.col("at_most"))
    open_ = F.when(F.col("above").isNull() | (F.col("_value") > F.col("above")), F.col("_value"))
    counted = met.groupBy(*keys, "percentile", "n", "place", open_.alias("_open")).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*keys, "percentile").orderBy(F.col("_open").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    reached = counted.withColumn("_upto", F.sum("_c").over(upto)).where(F.col("_open").isNotNull() & (F.col("_upto") >= F.col("place")))
    return reached.groupBy(*keys, "percentile", "n").agg(F.min("_open").alias("exact"))


def place_of(p: float, n: int) -> int:
    """ceil(p * n / 100), exactly for whole p."""
    return max(1, -(-int(p) * n // 100)) if float(p).is_integer() else max(1, int(np.ceil(p * n / 100)))
