"""Mergeable percentile sketches with relative-rank compactors.

A sketch is a stack of levels; an item of level h stands for 2**h values. A level that overflows is sorted and
compacted: its items nearest the protected tail stay as they are, of the others every second goes to the next level.
The longer a level has lived, the less of it is compacted at a time, as in the schedule of relative-error sketches, so
that ranks near the protected tail keep a small multiplicative error. Every compaction can shift a rank by at most the
weight of one item of its level; a sketch adds these up, so that its bounds hold always, not only with high
probability.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tidemill.functions.batches import whole_groups
from tidemill.functions.compare import NUDGE
from tidemill.functions.joins import is_small, sized_join
from tidemill.functions.ranks import grouped_percentiles, pick
from tidemill.operators.readings import CHUNK, valid_readings
from tidemill.sources.scratch import materialise

#: Items a level holds before it is compacted, and the part of it that is cut into sections.
CAPACITY = 1024
SECTIONS = 8
DECIMALS = 6


class Sketch:
    """Percentiles of the values seen, from ``levels`` of sorted items; the greatest values are protected.

    ``n``: values; ``age``: compactions of each level; ``error``: by how much the rank of a value may be off either way.
    """

    __slots__ = ("age", "error", "levels", "n")

    def __init__(self, levels: list[np.ndarray], age: list[int], error: int, n: int) -> None:
        self.levels, self.age, self.error, self.n = levels, age, error, n

    @classmethod
    def of(cls, values: np.ndarray, capacity: int = CAPACITY) -> Sketch:
        return cls([np.sort(values)], [0], 0, len(values)).compacted(capacity)

    @classmethod
    def merged(cls, sketches: list[Sketch], capacity: int = CAPACITY) -> Sketch:
        """Levels join those of the same weight; errors add up. The order of merging doesn't matter for the bounds."""
        height = max(len(s.levels) for s in sketches)
        levels = [np.sort(np.concatenate([s.levels[h] for s in sketches if h < len(s.levels)])) for h in range(height)]
        age = [max(s.age[h] for s in sketches if h < len(s.age)) for h in range(height)]
        return cls(levels, age, sum(s.error for s in sketches), sum(s.n for s in sketches)).compacted(capacity)

    def compacted(self, capacity: int) -> Sketch:
        h = 0
        while h < len(self.levels):
            items = self.levels[h]
            if len(items) > capacity:
                # the more ones end the level's age in binary, the more sections are compacted: old regions rarely
                ones = ((self.age[h] + 1) & -(self.age[h] + 1)).bit_length()
                room = capacity // 2 * min(ones, SECTIONS) // SECTIONS
                free = len(items) - capacity + max(2, room)
                free -= free % 2
                odd = (self.age[h] >> 1 ^ self.age[h]) & 1
                up = items[:free][odd::2]
                self.levels[h] = items[free:]
                self.age[h] += 1
                self.error += 1 << h
                if h + 1 == len(self.levels):
                    self.levels.append(up)
                    self.age.append(0)
                else:
                    self.levels[h + 1] = np.sort(np.concatenate([self.levels[h + 1], up]))
            h += 1
        return self

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        items = np.concatenate(self.levels)
        weights = np.repeat(1 << np.arange(len(self.levels)), [len(x) for x in self.levels])
        order = np.argsort(items, kind="stable")
        return items[order], weights[order]

    def at_rank(self, rank: np.ndarray) -> np.ndarray:
        """The item covering each 0-based rank, clipped to the items there are."""
        items, weights = self.weighted()
        ends = np.cumsum(weights)
        return items[np.minimum(np.searchsorted(ends, rank, side="right"), len(items) - 1)]

    def percentile(self, p: float) -> tuple[float, float, float]:
        """Estimate of the linearly interpolated percentile, and bounds that hold for sure."""
        where = p * (self.n - 1)
        below, above = int(np.floor(where)), int(np.ceil(where))
        ranks = np.array([below, above, max(0, below - self.error), min(self.n - 1, above + self.error)])
        a, b, low, high = self.at_rank(ranks)
        if self.error:  # items dropped at the ends may lie beyond those kept
            low = low if below - self.error >= 0 else -np.inf
            high = high if above + self.error <= self.n - 1 else np.inf
        return float(a + (b - a) * (where - below)), float(low), float(high)


LEVELS = ArrayType(ArrayType(DoubleType()))
SKETCH = [StructField("n", LongType()), StructField("error", LongType()), StructField("levels", LEVELS), StructField("age", ArrayType(IntegerType()))]


def _ragged(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def pack(sketches: list[Sketch]) -> list[pa.Array]:
    counts = np.cumsum([0, *(len(s.levels) for s in sketches)])
    levels = pa.ListArray.from_arrays(
        pa.array(counts, pa.int32()), _ragged([x for s in sketches for x in s.levels], pa.float64())
    )
    return [
        pa.array([s.n for s in sketches], pa.int64()),
        pa.array([s.error for s in sketches], pa.int64()),
        levels,
        _ragged([np.array(s.age, dtype=np.int32) for s in sketches], pa.int32()),
    ]


def unpack(table: pa.Table | pa.RecordBatch) -> list[Sketch]:
    def ends(x: pa.ListArray) -> np.ndarray:
        return x.offsets.to_numpy()

    def whole(name: str) -> pa.Array:
        x = table.column(name)
        return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x

    levels, age = whole("levels"), whole("age")
    inner = levels.values
    outer, middle, flat = ends(levels), ends(inner), inner.values.to_numpy(zero_copy_only=False)
    at, ages = ends(age), age.values.to_numpy(zero_copy_only=False)
    n, error = whole("n").to_numpy(), whole("error").to_numpy()
    return [
        Sketch(
            [flat[middle[h] : middle[h + 1]] for h in range(outer[k], outer[k + 1])],
            [int(x) for x in ages[at[k] : at[k + 1]]],
            int(error[k]),
            int(n[k]),
        )
        for k in range(len(n))
    ]


def _day_sketches(table: pa.Table, first: np.ndarray, capacity: int) -> pa.RecordBatch:
    begin = np.flatnonzero(first)
    v = table.column("v").to_numpy()
    ends = np.append(begin[1:], len(v))
    keys = [table.column(c).combine_chunks().take(pa.array(begin)) for c in ("series_id", "day_no")]
    length = ends - begin
    if length.max(initial=0) <= capacity:  # one level each: sort all groups at once
        flat = v[np.lexsort((v, np.repeat(np.arange(len(begin)), length)))]
        one = pa.array(np.arange(len(begin) + 1, dtype=np.int32))
        inner = pa.ListArray.from_arrays(pa.array(np.append(begin, len(v)).astype(np.int32)), pa.array(flat))
        zero = np.zeros(len(begin), dtype=np.int64)
        packed = [
            pa.array(length), pa.array(zero), pa.ListArray.from_arrays(one, inner),
            pa.ListArray.from_arrays(one, pa.array(zero.astype(np.int32))),
        ]
    else:
        packed = pack([Sketch.of(v[a:b], capacity) for a, b in zip(begin, ends, strict=True)])
    return pa.RecordBatch.from_arrays([keys[0].cast(pa.string()), keys[1], *packed], ["series_id", "day_no", "n", "error", "levels", "age"])


def day_sketches(points: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``series_id, day_no, n, error, levels, age``: a sketch of the valid readings of each series and day."""
    rows = valid_readings(points).sortWithinPartitions(*CHUNK).select("series_id", "day_no", "v")
    schema = StructType([StructField("series_id", StringType()), StructField("day_no", LongType()), *SKETCH])
    return rows.mapInArrow(whole_groups(["series_id", "day_no"], lambda table, first: _day_sketches(table, first, capacity)), schema)


def merge_sketches(sketches: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """One sketch per key from any number of them. Sketches are merged within partitions first, then per key, so a hot
    key sends one bounded sketch per partition."""
    schema = StructType([*(sketches.schema[k] for k in keys), *SKETCH])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _merge(pa.Table.from_batches([batch]), keys, capacity)

    once = sketches.select(*keys, "n", "error", "levels", "age").mapInArrow(partial, schema)
    together = once.repartition(*keys).sortWithinPartitions(*keys)
    return together.mapInArrow(whole_groups(keys, lambda table, first: _merge(table, keys, capacity), rows=2_000), schema)


def _merge(table: pa.Table, keys: list[str], capacity: int) -> pa.RecordBatch:
    groups: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(*(table.column(c).to_pylist() for c in keys), strict=True)):
        groups.setdefault(key, []).append(k)
    all_ = unpack(table)
    merged = [all_[at[0]] if len(at) == 1 else Sketch.merged([all_[k] for k in at], capacity) for at in groups.values()]
    firsts = pa.array([at[0] for at in groups.values()])
    return pa.RecordBatch.from_arrays(
        [*(table.column(c).combine_chunks().take(firsts) for c in keys), *pack(merged)], [*keys, "n", "error", "levels", "age"]
    )


def percentiles(sketches: DataFrame, keys: list[str], ps: tuple[float, ...]) -> DataFrame:
    """``keys, n, error`` and per p in percent ``pXX``, ``pXX_low``, ``pXX_high``: the estimate and bounds that hold for
    sure (``error`` is the most that a rank can be off; 0 means exact)."""
    names = [f"p{p * 100:g}".replace(".", "_") for p in ps]
    columns = [c for name in names for c in (name, f"{name}_low", f"{name}_high")]
    schema = StructType([
        *(sketches.schema[k] for k in keys), StructField("n", LongType()), StructField("error", LongType()),
        *(StructField(c, DoubleType()) for c in columns),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _percentiles(batch, ps)
            fixed = [batch.column(c) for c in (*keys, "n", "error")]
            yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(x) for x in values.T)], [*keys, "n", "error", *columns])

    return sketches.select(*keys, "n", "error", "levels", "age").mapInArrow(run, schema)


def _percentiles(batch: pa.RecordBatch, ps: tuple[float, ...]) -> np.ndarray:
    """Estimate and bounds of each percentile, one row per sketch. Sketches of one level, which are exact, are read
    all at once."""
    out = np.zeros((batch.num_rows, 3 * len(ps)))
    levels, n = batch.column("levels"), batch.column("n").to_numpy()
    simple = levels.value_lengths().to_numpy(zero_copy_only=False) == 1
    outer, inner = levels.offsets.to_numpy(), levels.values.offsets.to_numpy()
    flat = levels.values.values.to_numpy(zero_copy_only=False)
    at = np.flatnonzero(simple)
    begin = inner[outer[at]]
    for k, p in enumerate(ps):
        where = p * (n[at] - 1)
        a, b = flat[begin + np.floor(where).astype(np.int64)], flat[begin + np.ceil(where).astype(np.int64)]
        out[at, 3 * k : 3 * k + 3] = np.stack([a + (b - a) * (where - np.floor(where)), a, b], axis=1)
    rest = np.flatnonzero(~simple)
    for k, s in zip(rest, unpack(batch.take(pa.array(rest))), strict=True):
        out[k] = [x for p in ps for x in s.percentile(p)]
    return out


def day_percentiles(points: DataFrame, ps: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Percentiles per series and day with bounds. NULL and NaN readings take no part; an empty table gives no rows."""
    return percentiles(day_sketches(points), ["series_id", "day_no"], ps)


def series_percentiles(points: DataFrame, series: DataFrame, ps: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Percentiles per series and metric over all days, from the merged day sketches. A series not listed in
    ``series`` has a NULL metric."""
    merged = merge_sketches(day_sketches(points), ["series_id"])
    metrics = series.groupBy("series_id").agg(F.max("metric").alias("metric"))
    return sized_join(percentiles(merged, ["series_id"], ps), metrics, "series_id", "left")


def checked_percentiles(points: DataFrame, ps: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """``series_id, n``, per p the exact percentile ``pXX``, and ``holds``: whether all lie within the bounds that the merged
    sketches give. For measuring the sketches on given data."""
    readings = materialise(valid_readings(points).select("series_id", "v"), "values")
    names = {f"p{p * 100:g}".replace(".", "_"): p for p in ps}
    told = percentiles(merge_sketches(day_sketches(points), ["series_id"]), ["series_id"], ps)
    bounds = told.select("series_id", *(F.col(f"{c}_{side}").alias(f"{c}_{side}") for c in names for side in ("low", "high")))
    exact = sized_join(grouped_percentiles(readings, ["series_id"], names), bounds, "series_id")
    inside = [F.col(c).between(F.col(f"{c}_low"), F.col(f"{c}_high")) for c in names]
    return exact.select("series_id", "n", *names, reduce(operator.and_, inside).alias("holds"))


def exact_percentile(rows: DataFrame, bounds: DataFrame, keys: list[str], p: float, name: str) -> DataFrame:
    """``keys, name``: exact percentiles (linear interpolation), given bounds that hold for sure.

    ``bounds`` has ``keys, n, low, high``. Equal values are counted before the shuffle; of each key only the values between
    its bounds are ordered, cut into parts of their range where they are many, and those below counted as one.
    """
    joined = sized_join(rows.select(*keys, "v"), bounds.select(*keys, "n", "low", "high"), keys).where(F.col("v") <= F.col("high"))
    value = F.when(F.col("v") >= F.col("low"), F.col("v"))
    counted = materialise(joined.groupBy(*keys, value.alias("v")).agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")), "counted")
    where = F.lit(p) * (F.col("n") - 1)
    under = F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0))
    spots = counted.groupBy(*keys).agg(F.max("n").alias("n"), under.alias("under")).select(
        *keys, "n", (F.floor(where) - F.col("under")).alias("below"), (F.ceil(where) - F.col("under")).alias("above"), (where - F.floor(where)).alias("share")
    )
    found = pick(counted.where(F.col("v").isNotNull()).select(*keys, "v", "c"), materialise(spots, "spots"), keys)
    return found.select(*keys, F.col("x").alias(name))


def high_days(points: DataFrame, least: int = 20, capacity: int = CAPACITY) -> DataFrame:
    """``series_id, day_no`` of days with at least ``least`` valid readings whose median is greater than the 90th
    percentile of all valid readings of the series, both rounded to 6 decimals.

    The sketches' bounds decide most days. Only where they leave it open are the percentiles computed exactly, over
    the values between the bounds.
    """
    days = materialise(day_sketches(points, capacity), "days")
    medians = percentiles(days, ["series_id", "day_no"], (0.5,)).where(F.col("n") >= least)
    whole = materialise(percentiles(merge_sketches(days, ["series_id"], capacity), ["series_id"], (0.9,)), "whole")
    tops = whole.select("series_id", F.col("n").alias("all_n"), "p90", "p90_low", "p90_high", (F.col("error") == 0).alias("sure"))
    both = materialise(sized_join(medians, tops, "series_id"), "both")
    # bounds are items, so a decision by them holds for interpolated values too; rounding moves each by half a step
    step = 10.0**-DECIMALS
    exact = (F.col("error") == 0) & F.col("sure")
    greater = F.round(F.col("p50") * NUDGE, DECIMALS) > F.round(F.col("p90") * NUDGE, DECIMALS)
    yes = F.when(exact, greater).otherwise(F.col("p50_low") > F.col("p90_high") + step)
    open_ = ~exact & (F.col("p50_low") <= F.col("p90_high") + step) & (F.col("p50_high") >= F.col("p90_low") - step)
    decided = both.where(yes).select("series_id", "day_no")
    doubtful = both.where(open_)
    if is_small(doubtful, 0):
        return decided
    # only the series with open days are read again
    left = doubtful.select("series_id").distinct()
    readings = valid_readings(sized_join(points.select("series_id", "t", "v", "recv_ms"), left, "series_id"))
    readings = materialise(readings.select("series_id", "day_no", "v"), "left")
    top = exact_percentile(
        readings,
        doubtful.groupBy("series_id").agg(F.max("all_n").alias("n"), F.max("p90_low").alias("low"), F.max("p90_high").alias("high")),
        ["series_id"], 0.9, "p90",
    )
    middle = exact_percentile(
        readings,
        doubtful.select("series_id", "day_no", "n", F.col("p50_low").alias("low"), F.col("p50_high").alias("high")),
        ["series_id", "day_no"], 0.5, "p50",
    )
    checked = sized_join(middle, top, "series_id").where(greater).select("series_id", "day_no")
    return decided.unionByName(checked)
