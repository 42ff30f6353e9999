"""Readings as they hold after corrections, laid out by series and day.

A series may hold a third of all rows, so nothing here groups by series alone. Rows are hashed by series and day:
a day of one series is a bounded group (milliseconds are the finest time), and what crosses midnight is settled
on the few rows at the edges of days.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemill.functions.joins import BROADCAST_ROWS, is_small, salted_join

DAY_MS = 86_400_000
#: The hash first: a sort compares eight bytes of it before it looks at the strings.
CHUNK = ["chunk", "series_id", "day_no"]


def day_of(t: str = "t") -> Column:
    return F.expr(f"{t} div {DAY_MS}")


def by_day(points: DataFrame, day: Column | None = None) -> DataFrame:
    """``series_id, t, v, recv_ms, day_no, chunk``, rows of a series and day in one partition. Rows without series
    or time are left out. ``day`` may be another number that never falls with time in a series, such as that of a week."""
    # a cast that changes nothing would leave an alias, and with it two plans of the same rows that share no exchange
    kinds = dict(points.select("t", "v").dtypes)
    cast = [F.col(c) if kinds[c] == kind else F.col(c).cast(kind).alias(c) for c, kind in (("t", "bigint"), ("v", "double"))]
    number = [] if day is None else [day.alias("day_no")]
    rows = points.select("series_id", *cast, "recv_ms", *number)
    rows = rows.where(F.col("series_id").isNotNull() & F.col("t").isNotNull())
    rows = (rows.withColumn("day_no", day_of()) if day is None else rows).repartition("series_id", "day_no")
    return rows.withColumn("chunk", F.xxhash64("series_id", "day_no"))


def valid_readings(points: DataFrame, day: Column | None = None) -> DataFrame:
    """One reading per series and time: ``series_id, t, v, day_no, chunk``.

    Of the rows with the same ``(series_id, t)`` the one with the greatest ``recv_ms`` counts; a NULL ``recv_ms`` is
    the oldest, and of rows tied on it the greatest ``v`` counts (NaN above all, NULL below all). It is left out if
    its ``v`` is NULL or NaN. Further columns are ignored. An empty table gives no rows. ``day`` as for ``by_day``.
    """
    newest = Window.partitionBy(*CHUNK).orderBy(
        F.col("t"), F.col("recv_ms").desc_nulls_last(), F.col("v").desc_nulls_last()
    )
    rows = by_day(points, day).withColumn("before", F.lag("t").over(newest))
    rows = rows.where((F.col("before").isNull() | (F.col("before") != F.col("t"))) & F.col("v").isNotNull() & ~F.isnan("v"))
    return of_source(rows.select("series_id", "t", "v", "day_no", "chunk"), points)


def of_source(rows: DataFrame, source: DataFrame) -> DataFrame:
    """The rows, noted to hold no other series than ``source`` does."""
    rows.__dict__["_source"] = source.__dict__.get("_source", source)
    return rows


def few_series(readings: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether the readings are of at most ``limit`` series. Counted where they were read from, by a scan of the ids alone,
    once for all operators on the same source."""
    source = readings.__dict__.get("_source", readings)
    known = source.__dict__.setdefault("_few_series", {})
    if limit not in known:
        known[limit] = is_small(source.select("series_id").distinct(), limit)
    return known[limit]


def join_by_series(rows: DataFrame, stats: DataFrame, readings: DataFrame, how: str = "inner") -> DataFrame:
    """Joins what was aggregated per series of ``readings`` to rows of these series, in one plan, so that both sides share
    the shuffle of the readings. Of few series the aggregates are broadcast, else the rows of a series are spread."""
    if few_series(readings):
        return rows.join(F.broadcast(stats), "series_id", how)
    return salted_join(rows, stats, "series_id", how)


def in_day() -> WindowSpec:
    return Window.partitionBy(*CHUNK).orderBy("t")


def consecutive(readings: DataFrame, opening: bool = False) -> DataFrame:
    """Each reading with the next of its series: ``series_id, t, v, next_t, next_v``; the last has NULLs there.

    With ``opening``, a further row per series has NULL ``t`` and ``v`` and its first reading as the next. Within a
    day the next reading is found in the day's partition. The last reading of a day finds it among the first readings
    of the days, of which a series has no more than its calendar has days.
    """
    day = in_day()
    rows = readings.select(
        *CHUNK,
        "t",
        "v",
        F.lead("t").over(day).alias("next_t"),
        F.lead("v").over(day).alias("next_v"),
        F.lag("t").over(day).isNull().alias("is_first"),
    )
    inside = rows.where(F.col("next_t").isNotNull()).select("series_id", "t", "v", "next_t", "next_v")
    edges = rows.where(F.col("next_t").isNull() | F.col("is_first"))
    across = Window.partitionBy("series_id").orderBy("t")
    edges = edges.select(
        "series_id",
        "t",
        "v",
        F.lead("t").over(across).alias("after_t"),
        F.lead("v").over(across).alias("after_v"),
        F.col("next_t").isNull().alias("is_last"),
        F.lag("t").over(across).isNull().alias("is_start"),
    )
    none_t, none_v = F.lit(None).cast("long"), F.lit(None).cast("double")

    def pair(t, v, next_t, next_v):
        return F.struct(t.alias("t"), v.alias("v"), next_t.alias("next_t"), next_v.alias("next_v"))

    pairs = [F.when(F.col("is_last"), pair(F.col("t"), F.col("v"), F.col("after_t"), F.col("after_v")))]
    if opening:
        pairs.append(F.when(F.col("is_start"), pair(none_t, none_v, F.col("t"), F.col("v"))))
    over = edges.select("series_id", F.explode(F.array_compact(F.array(*pairs))).alias("p")).select("series_id", "p.*")
    return inside.unionByName(over)


def ordinal(readings: DataFrame, name: str = "idx") -> DataFrame:
    """Adds the 0-based position of each reading in its series.

    Positions in a day are counted in its partition; the readings on the days before are a running sum over one
    count per day, joined back on series and day.
    """
    counts = readings.groupBy("series_id", "day_no").agg(F.count(F.lit(1)).alias("n"))
    days = Window.partitionBy("series_id").orderBy("day_no").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("series_id", "day_no", F.coalesce(F.sum("n").over(days), F.lit(0)).alias("before"))
    placed = readings.withColumn("place", F.row_number().over(in_day()) - 1)
    return (
        placed.join(before, ["series_id", "day_no"])
        .withColumn(name, F.col("before") + F.col("place"))
        .drop("before", "place")
    )


def period_of(series: DataFrame, metadata: DataFrame, number: Callable[[Column], Column]) -> DataFrame:
    """``series_id, period``: ``series.ref_period``, or where that is NULL the newest ``qual_ref_period`` of the
    attribute rows that reads as a whole number above 0. Series with neither are left out. ``number`` reads a text."""
    name = F.lower(F.btrim("name", F.lit(" \t")))
    stated = (
        metadata.where(name == "qual_ref_period")
        .groupBy(F.col("tsuid").alias("series_id"))
        .agg(F.max_by("value", F.struct(F.col("updated_at"), F.col("value"))).alias("text"))
        .select("series_id", number(F.col("text")).cast("long").alias("stated"))
    )
    known = series.where(F.col("series_id").isNotNull()).groupBy("series_id").agg(F.max("ref_period").alias("ref_period"))
    both = known.join(stated, "series_id", "full").select(
        "series_id", F.coalesce("ref_period", "stated").alias("period")
    )
    return both.where(F.col("period") > 0)


def laid_out(readings: DataFrame) -> DataFrame:
    """The readings (``series_id, t, v``, one per series and time) with ``day_no`` and ``chunk``, rows of a day of a
    series in one partition. What ``valid_readings`` gives is so already."""
    if "chunk" in readings.columns:
        return readings
    rows = readings.withColumn("day_no", day_of()).repartition("series_id", "day_no")
    return of_source(rows.withColumn("chunk", F.xxhash64("series_id", "day_no")), readings)


def running_total(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the running sum of a whole-number column over each series in time: a sum over the days before, plus one
    within the day."""
    sums = rows.groupBy("series_id", "day_no").agg(F.sum(value).alias("s"))
    days = Window.partitionBy("series_id").orderBy("day_no").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("series_id", "day_no", F.coalesce(F.sum("s").over(days), F.lit(0)).alias("before"))
    inner = F.sum(value).over(in_day().rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("inner", inner)
        .join(before, ["series_id", "day_no"])
        .withColumn(name, F.col("before") + F.col("inner"))
        .drop("before", "inner")
    )


def series_metadata(readings: DataFrame) -> DataFrame:
    """``series_id, start_ms, end_ms, nb_points`` of derived series."""
    return readings.groupBy("series_id").agg(
        F.min("t").alias("start_ms"), F.max("t").alias("end_ms"), F.count(F.lit(1)).alias("nb_points")
    )


#: Readings that a block of a series' windows begins in, at least.
STRETCH = 4096


def window_blocks(placed: DataFrame, size: int, stride: int) -> tuple[DataFrame, int]:
    """Rows with their position ``idx`` laid out by blocks of windows, sorted by ``series_id, block, idx``, and the number of
    windows in a block. A reading is sent to the block its windows start in and, where they reach into the one after, to
    that too, so that what is shuffled doesn't depend on how windows overlap."""
    each = max(1, max(STRETCH, 4 * size) // stride)
    width = each * stride
    reach = (each - 1) * stride + size  # readings from a block's first to its last window's end
    low = F.greatest(F.expr(f"(idx - {reach} + {width}) div {width}"), F.lit(0).cast("long"))
    spread = placed.select("*", F.explode(F.sequence(low, F.expr(f"greatest(idx div {width}, 0)"))).alias("block"))
    return spread.repartition("series_id", "block").sortWithinPartitions("series_id", "block", "idx"), each


def window_starts(first: np.ndarray, idx: np.ndarray, block: np.ndarray, each: int, size: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the blocks in a batch of whole ones: the row where each window starts, and its rank in its series."""
    begins = np.flatnonzero(first)
    starts, ranks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low, high in zip(begins, [*begins[1:], len(idx)], strict=True):
        rank = np.arange(block[low] * each, min((block[low] + 1) * each, (idx[high - 1] + 1 - size) // stride + 1))
        starts.append(low + rank * stride - idx[low])
        ranks.append(rank)
    return np.concatenate(starts), np.concatenate(ranks)
