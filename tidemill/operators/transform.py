"""Series derived from neighbouring readings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.batches import whole_groups
from tidemill.functions.joins import sized_join
from tidemill.operators.readings import CHUNK, STRETCH, consecutive, in_day, join_by_series, laid_out, of_source, ordinal, running_total

#: Readings up to which a window's mean is taken by itself; longer ones are differences of running sums.
FRAME = 64
#: Readings up to which windows are taken in blocks of a series; longer ones use sums by day.
LONG = 1_000_000
ALIGNMENTS = ("left", "center", "right")


def slope(readings: DataFrame) -> DataFrame:
    """First derivative per ms, ``(v' - v) / (t' - t)`` to the next reading, stamped at the earlier one. Holes count by
    their length. A series of n readings gives n - 1."""
    pairs = consecutive(laid_out(readings)).where(F.col("next_t").isNotNull())
    return pairs.select("series_id", "t", ((F.col("next_v") - F.col("v")) / (F.col("next_t") - F.col("t"))).alias("v"))


def discontinuity_of(value: str | float | None) -> float:
    """A threshold as a number, or a text such as ``pi``, ``2*pi`` or ``pi/2``."""
    if value is None:
        raise ValueError("a discontinuity is needed")
    if isinstance(value, str) and "pi" in value:
        text = value.replace(" ", "")
        factor, _, rest = text.partition("pi")
        times = float(factor.rstrip("*")) if factor else 1.0
        over = float(rest.lstrip("/")) if rest.startswith("/") else float(rest.lstrip("*")) ** -1 if rest else 1.0
        number = times * math.pi / over
    else:
        number = float(value)
    if number < 0:
        raise ValueError("the discontinuity can't be negative")
    return number


def unwrap(readings: DataFrame, unit: str = "Radians", discontinuity: str | float = math.pi) -> DataFrame:
    """Phases without jumps: a step of at least ``discontinuity`` is moved by whole turns into half a turn either way.

    The turns are whole numbers, so their running sum over a series can be taken within days and over days without
    rounding.
    """
    turn = {"Radians": 2 * math.pi, "Degrees": 360.0}[unit]
    least = discontinuity_of(discontinuity) * turn / (2 * math.pi)
    rows = laid_out(readings)
    step = consecutive(rows).where(F.col("next_t").isNotNull())
    d = F.col("next_v") - F.col("v")
    half = turn / 2
    whole = F.floor((d + half) / turn)
    # a step of exactly half a turn down, reached from above, counts as half a turn up
    whole = F.when((d > 0) & (d - whole * turn == -half), whole - 1).otherwise(whole)
    turns = F.when(F.abs(d) < least, F.lit(0)).otherwise(-whole).cast("long")
    steps = step.select("series_id", F.col("next_t").alias("t"), F.col("next_v").alias("v"), turns.alias("turns"))
    first = rows.groupBy("series_id", "day_no").agg(F.min(F.struct("t", "v")).alias("f")).groupBy("series_id").agg(F.min("f").alias("f"))
    opening = first.select("series_id", F.col("f.t").alias("t"), F.col("f.v").alias("v"), F.lit(0).cast("long").alias("turns"))
    moved = running_total(laid_out(steps.unionByName(opening)), "turns", "total")
    return moved.select("series_id", "t", (F.col("v") + F.col("total") * turn).alias("v"))


def rolling_mean(readings: DataFrame, size: int, alignment: str = "center") -> DataFrame:
    """Means of ``size`` consecutive readings, stamped at the first, the middle (place ``size // 2``) or the last of them.
    A series of n readings gives n - size + 1; one of no more than ``size`` readings gives none; size 1 changes nothing."""
    if size < 1:
        raise ValueError("a window holds at least one reading")
    if alignment not in ALIGNMENTS:
        raise ValueError(f"alignment must be one of {', '.join(ALIGNMENTS)}")
    rows = laid_out(readings)
    if size == 1:
        return rows.select("series_id", "t", "v")
    lengths = rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size)
    sizes = lengths.select("series_id", F.lit(size).cast("long").alias("size"))
    return _means(join_by_series(ordinal(rows), sizes, readings), alignment, size > LONG)


def _means(place: DataFrame, alignment: str, some_long: bool) -> DataFrame:
    """Means of windows of ``size`` (a column, the same for all of a series) readings, from rows with ``idx``. Windows of no
    more than ``LONG`` readings are taken in blocks of a series, longer ones by the sums of days."""
    short = _block_means(place.where(F.col("size") <= LONG) if some_long else place, alignment)
    return short.unionByName(_joined_means(place.where(F.col("size") > LONG), alignment)) if some_long else short


def _block_means(place: DataFrame, alignment: str) -> DataFrame:
    """Each reading goes to the block that its window starts in, and to that before where windows reach over from it."""
    width = F.greatest(F.col("size") * 4, F.lit(STRETCH).cast("long"))
    rows = place.select("series_id", "idx", "t", "v", "size", width.alias("width"))
    low = F.greatest(F.expr("(idx - size + 1) div width"), F.lit(0).cast("long"))
    spread = rows.select("series_id", "idx", "t", "v", "size", "width", F.explode(F.sequence(low, F.expr("idx div width"))).alias("block"))
    blocks = spread.repartition("series_id", "block").sortWithinPartitions("series_id", "block", "idx")

    def kernel(table: pa.Table, first: np.ndarray) -> pa.Table:
        t, v, idx, size, width, block = (table.column(c).to_numpy() for c in ("t", "v", "idx", "size", "width", "block"))
        starts, sums, stamps = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        begins = np.flatnonzero(first)
        for a, b in zip(begins, [*begins[1:], len(v)], strict=True):
            n = int(size[a])
            count = min(b - a - n + 1, int((block[a] + 1) * width[a] - idx[a]))
            if count <= 0:
                continue
            part = v[a : a + count + n - 1]
            if n <= FRAME:
                means = np.lib.stride_tricks.sliding_window_view(part, n).mean(axis=1)
            else:
                upto = np.concatenate([[0.0], np.cumsum(part - part[0])])
                means = part[0] + (upto[n:] - upto[:-n]) / n
            starts.append(np.arange(a, a + count))
            sums.append(means)
            stamps.append(t[a + {"left": 0, "center": n // 2, "right": n - 1}[alignment] :][:count])
        at = np.concatenate(starts)
        return pa.table([table.column("series_id").take(pa.array(at)), pa.array(np.concatenate(stamps)), pa.array(np.concatenate(sums))], ["series_id", "t", "v"])

    return blocks.select("series_id", "idx", "t", "v", "size", "width", "block").mapInArrow(whole_groups(["series_id", "block"], kernel), "series_id string, t long, v double")


def _joined_means(place: DataFrame, alignment: str) -> DataFrame:
    """Means of windows of ``size`` (a column, the same for all of a series) readings, from rows with ``idx``.

    The first reading of a window meets its last by position. What lies between is the rest of the first's day, the whole
    days between and the beginning of the last's day, or the difference within one day; so sums stay as small as a
    window's, however long the series.
    """
    down = Window.partitionBy(*CHUNK).orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = place.groupBy("series_id", "day_no").agg(F.sum("v").alias("s"))
    days = Window.partitionBy("series_id").orderBy("day_no").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("series_id", "day_no", "s", F.coalesce(F.sum("s").over(days), F.lit(0.0)).alias("before"))
    rows = place.select(
        "series_id", "idx", "t", "v", "size", "day_no",
        F.sum("v").over(in_day().rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("v").over(down).alias("rest"),
    ).join(before, ["series_id", "day_no"])
    first = rows.select("series_id", "idx", "t", "v", "size", "day_no", "upto", "rest", (F.col("before") + F.col("s")).alias("after"))
    last = rows.select(
        "series_id", (F.col("idx") - F.col("size") + 1).alias("idx"), F.col("t").alias("last_t"), F.col("upto").alias("last_upto"),
        F.col("day_no").alias("last_day"), "before",
    )
    both = first.join(last, ["series_id", "idx"])
    total = F.when(F.col("day_no") == F.col("last_day"), F.col("last_upto") - F.col("upto") + F.col("v")).otherwise(
        F.col("rest") + (F.col("before") - F.col("after")) + F.col("last_upto")
    )
    means = both.select("series_id", "idx", "t", "last_t", "size", (total / F.col("size")).alias("mean"))
    if alignment != "center":
        return means.select("series_id", F.col("t" if alignment == "left" else "last_t").alias("t"), F.col("mean").alias("v"))
    middle = place.select("series_id", (F.col("idx") - F.expr("size div 2")).alias("idx"), F.col("t").alias("mid_t"))
    return means.join(middle, ["series_id", "idx"]).select("series_id", F.col("mid_t").alias("t"), F.col("mean").alias("v"))


def rolling_mean_period(readings: DataFrame, periods: DataFrame, window_period: int, alignment: str = "left") -> DataFrame:
    """Rolling means over a duration: each series' window holds ``ceil(window_period / period)`` readings. Series without a
    period, or with no more readings than its window holds, give no rows."""
    if alignment not in ALIGNMENTS:
        raise ValueError(f"alignment must be one of {', '.join(ALIGNMENTS)}")
    rows = laid_out(readings)
    lengths = rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    size = F.ceil(F.lit(window_period) / F.col("period")).cast("long")
    sizes = sized_join(lengths, periods.where("period > 0").select("series_id", size.alias("size")), "series_id")
    sizes = sizes.where((F.col("n") > F.col("size")) | (F.col("size") == 1)).select("series_id", "size")
    shortest = periods.where("period > 0").agg(F.min("period")).first()[0] or window_period
    return _means(join_by_series(ordinal(rows), sizes, readings), alignment, window_period / shortest > LONG)


def scale(readings: DataFrame, with_mean: bool = True, with_std: bool = True, floor: Column | None = None) -> DataFrame:
    """Centred and divided by the population deviation (1 where that is 0; at least ``floor`` where given, an expression
    over ``n``). The moments are added up before the shuffle and joined back."""
    moments = readings.groupBy("series_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count("v").alias("n"))
    dev = F.greatest(F.col("s"), floor) if floor is not None else F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    fixed = moments.select("series_id", "m", dev.alias("dev"))
    v = F.col("v") - F.col("m") if with_mean else F.col("v")
    out = join_by_series(readings, fixed, readings).withColumn("v", v / F.col("dev") if with_std else v)
    return of_source(out.drop("m", "dev"), readings)
