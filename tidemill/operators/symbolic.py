"""Piecewise averages and words: PAA, SAX, sliding windows and their words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidemill.functions.batches import whole_groups
from tidemill.functions.ranks import exact_percentiles
from tidemill.operators.readings import join_by_series, laid_out, ordinal, window_blocks, window_starts
from tidemill.operators.transform import scale
from tidemill.sources.scratch import materialise

#: Digits to which averages and break points count, so that a tie doesn't hang on the last bit.
DIGITS = 9


def _checked(n: int, least: int, most: int, what: str) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or not least <= n <= most:
        raise ValueError(f"{what} must be a whole number from {least} to {most}")
    return n


def segments(readings: DataFrame, n: int) -> DataFrame:
    """``series_id, segment, start_ms, mean, points``: averages over ``n`` equal parts of each series' span. A time on a
    border belongs to the part before it. Parts without readings have no row."""
    _checked(n, 1, 1_000_000, "the number of segments")
    spans = readings.groupBy("series_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    rows = join_by_series(readings.select("series_id", "t", "v"), spans, readings)
    width = (F.col("t1") - F.col("t0")) / n
    at = F.coalesce(F.ceil(F.try_divide(F.col("t") - F.col("t0"), width)).cast("int") - 1, F.lit(0))
    part = F.least(F.greatest(at, F.lit(0)), F.lit(n - 1))
    means = rows.groupBy("series_id", part.alias("segment")).agg(
        F.avg("v").alias("mean"), F.min("t").alias("start_ms"), F.count("v").alias("points")
    )
    return means


def filled(parts: DataFrame, n: int) -> DataFrame:
    """``series_id, segment, mean`` of all ``n`` parts: one without readings has the average of the one before. The
    first part holds the first reading, so there is one before."""
    after = F.lead("segment").over(Window.partitionBy("series_id").orderBy("segment"))
    return parts.select("series_id", "segment", "mean", F.coalesce(after, F.lit(n)).alias("after")).select(
        "series_id", F.explode(F.sequence("segment", F.col("after") - 1)).alias("segment"), "mean"
    )


def paa(readings: DataFrame, n: int, fill: bool = False) -> DataFrame:
    """``series_id, paa``: the averages of the ``n`` parts in order; a part without readings is NULL, or with ``fill``
    has the average of the part before."""
    parts = segments(readings, n)
    cells = (filled(parts, n) if fill else parts).groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("segment", "mean"))).alias("m"))
    return cells.select("series_id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.try_element_at("m", k)).alias("paa"))


def paa_series(readings: DataFrame, n: int) -> DataFrame:
    """The readings with their values replaced by the average of their part."""
    spans = readings.groupBy("series_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    means = paa(readings, n)
    width = (F.col("t1") - F.col("t0")) / n
    at = F.coalesce(F.ceil(F.try_divide(F.col("t") - F.col("t0"), width)).cast("int") - 1, F.lit(0))
    rows = join_by_series(readings.select("series_id", "t"), spans.join(means, "series_id"), readings)
    segment = F.least(F.greatest(at, F.lit(0)), F.lit(n - 1))
    return rows.select("series_id", "t", F.element_at("paa", segment + 1).alias("v"))


def paa_sequential(readings: DataFrame, n: int) -> DataFrame:
    """``series_id, segment, mean`` by the one-advance-per-reading rule: a reading later than the rounded next border opens
    a segment and moves the border by one width only. On series with gaps segments lag, and readings after the last
    border can be left out.

    Segment k + 1 opens at the first reading later than border k, at position f(k), or right after segment k opened,
    whichever comes last: at the greatest of f(j) + k - j over all j up to k. So the positions follow from counts of
    readings up to each border, and no series is walked through.
    """
    _checked(n, 1, 10_000, "the number of segments")
    laid = laid_out(readings)
    spans = laid.groupBy("series_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    border = lambda k: F.rint(F.col("t0") + (F.col("t1") - F.col("t0")) / n * (k + 1))
    rows = join_by_series(laid.select("series_id", "t"), spans, readings)
    # the first border that isn't passed is next to the place by division
    near = F.coalesce(F.ceil(F.try_divide(F.col("t") - F.col("t0"), (F.col("t1") - F.col("t0")) / n)).cast("int") - 1, F.lit(0))
    low = F.greatest(near - 1, F.lit(0))
    part = F.when(F.col("t") <= border(low), low).when(F.col("t") <= border(low + 1), low + 1).otherwise(low + 2)
    counts = rows.groupBy("series_id", "t0", "t1", F.least(part, F.lit(n - 1)).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    cells = counts.groupBy("series_id", "t0", "t1").agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("m"))
    # f(k) - k, greatest so far: a running sum and a running maximum over n places
    of = lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("most"), F.array().cast("array<long>").alias("opens"))

    def step(state: Column, k: Column) -> Column:
        seen = state["seen"] + of(k)
        most = F.greatest(state["most"], seen - k)
        return F.struct(seen.alias("seen"), most.alias("most"), F.concat(state["opens"], F.array(most + k)).alias("opens"))

    opens = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, step)["opens"]
    placed = join_by_series(ordinal(laid).select("series_id", "idx", "v"), cells.select("series_id", "t0", "t1", opens.alias("opens")), readings)
    segment = F.size(F.filter("opens", lambda x: x <= F.col("idx")))
    means = placed.groupBy("series_id", segment.alias("segment")).agg(F.avg("v").alias("mean"), F.max("t0").alias("t0"), F.max("t1").alias("t1"))
    # the last segment is given out only where its border reaches the end
    closed = F.max("segment").over(Window.partitionBy("series_id")) > F.col("segment")
    kept = means.withColumn("closed", closed).where(F.col("closed") | (border(F.col("segment")) >= F.col("t1")))
    return kept.select("series_id", "segment", "mean")


def letters_of(values: Column, breaks: Column, strict: bool) -> Column:
    """A word: per value the letter after as many as there are break points below it (or at most at it)."""
    over = lambda x: F.size(F.filter(breaks, lambda b: x > b if strict else x >= b))
    return F.array_join(F.transform(values, lambda x: F.chr((over(x) + 97).cast("long"))), "")


def sax(readings: DataFrame, word_size: int, alphabet: int, normalize: bool = False, fill: bool = False) -> DataFrame:
    """``series_id, paa, breakpoints, word``. Break points are the empirical percentiles ``i / alphabet`` of the series'
    own averages; a letter counts those strictly below. Parts without readings have no letter, or with ``fill`` count
    as the part before. With ``normalize`` the series is scaled first, its deviation taken as at least 1 / n."""
    _checked(alphabet, 1, 26, "the alphabet")
    rows = scale(readings, floor=1.0 / F.col("n")) if normalize else readings
    parts = segments(rows, word_size)
    parts = (filled(parts, word_size) if fill else parts).withColumn("mean", F.round("mean", DIGITS))
    cells = parts.groupBy("series_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("segment", "mean"))), lambda x: x["mean"]).alias("paa"),
        F.percentile("mean", F.array(*(F.lit(k / alphabet) for k in range(1, alphabet)))).alias("b") if alphabet > 1 else F.array().cast("array<double>").alias("b"),
    )
    cells = cells.withColumn("breakpoints", F.transform("b", lambda x: F.round(x, DIGITS))).drop("b")
    return cells.withColumn("word", letters_of(F.col("paa"), F.col("breakpoints"), strict=True))


# By name, the least deviation and the greatest squared correlation with time.
LINEAR_FILTERS = {"NO": None, "LOW": (0.001, 0.99), "MEDIUM": (0.005, 0.95), "STRONG": (0.01, 0.9)}


def sliding_windows(
    readings: DataFrame, size: int, overlap: float = 0.8, with_mean: bool = True, with_std: bool = True,
    local_norm: bool = True, linear_filter: tuple[float, float] | None = None, trivial_radius: float = 0.0,
) -> DataFrame:
    """``series_id, rank, start_ms, values, times, local_mean, local_std, ts_mean, ts_scale``: the windows of ``size``
    readings each, ``max(1, round((1 - overlap) * size))`` apart.

    The series is scaled as asked; with ``local_norm`` each window is scaled too (a deviation of 0 only centres). With
    ``linear_filter`` (a, b) a window is kept if its deviation exceeds ``a`` and the squared correlation of values and
    times stays below ``b``. With a ``trivial_radius``, of windows that follow each other too closely only the first
    stays. Series shorter than ``size`` have no windows.
    """
    _checked(size, 1, 100_000, "the window size")
    stride = max(1, round((1 - overlap) * size))
    laid = laid_out(readings)
    moments = laid.groupBy("series_id").agg(F.avg("v").alias("ts_mean"), F.stddev_pop("v").alias("s"), F.count("v").alias("n"))
    moments = moments.where(F.col("n") >= size).withColumn("ts_scale", F.when((F.col("s") == 0) | (F.col("s") == 1), 1.0).otherwise(F.col("s")))
    dev = F.col("s") / F.col("ts_scale") if with_std else F.col("s")
    moments = moments.select("series_id", "ts_mean", "ts_scale", "n", dev.alias("ts_dev"))
    rows = join_by_series(ordinal(laid).select("series_id", "idx", "t", "v"), moments.drop("n"), readings)
    blocks, each = window_blocks(rows, size, stride)
    raw = trivial_radius > 0
    names = ["series_id", "rank", "start_ms", "values", "times", "local_mean", "local_std", "ts_mean", "ts_scale", "ts_dev"]
    schema = f"series_id string, rank long, start_ms long, values array<double>, times array<long>, {', '.join(f'{c} double' for c in names[5:])}"
    at_once = max(1, 2_000_000 // size)

    def kernel(table: pa.Table, first: np.ndarray) -> pa.Table:
        t, v, idx, block, mean, scale_, dev = (table.column(c).to_numpy() for c in ("t", "v", "idx", "block", "ts_mean", "ts_scale", "ts_dev"))
        if with_mean:
            v = v - mean
        if with_std:
            v = v / scale_
        start, rank = window_starts(first, idx, block, each, size, stride)
        out = []
        for low in range(0, len(start), at_once):
            s, r = start[low : low + at_once], rank[low : low + at_once]
            x, times = v[s[:, None] + np.arange(size)], t[s[:, None] + np.arange(size)]
            local_mean, local_std = x.mean(axis=1), x.std(axis=1)
            if linear_filter:
                a, b = linear_filter
                along = (times - times[:, :1]).astype(float)
                along -= along.mean(axis=1, keepdims=True)
                square = local_std**2 * (along**2).mean(axis=1)
                r2 = np.where(square > 0, ((x - local_mean[:, None]) * along).mean(axis=1) ** 2 / np.where(square > 0, square, 1.0), 0.0)
                keep = (local_std > a) & (r2 < b)
                s, r, x, times, local_mean, local_std = s[keep], r[keep], x[keep], times[keep], local_mean[keep], local_std[keep]
            if local_norm and not raw:
                x = (x - local_mean[:, None]) / np.where(local_std == 0, 1.0, local_std)[:, None]
            ends = pa.array(np.arange(0, len(s) * size + 1, size, dtype=np.int32))
            out.append(pa.table([
                table.column("series_id").take(pa.array(s)), pa.array(r), pa.array(t[s]), pa.ListArray.from_arrays(ends, pa.array(x.ravel())), pa.ListArray.from_arrays(ends, pa.array(times.ravel())),
                pa.array(local_mean), pa.array(local_std), pa.array(mean[s]), pa.array(scale_[s]), pa.array(dev[s]),
            ], names))
        if not out:
            none = pa.array([], pa.float64())
            return pa.table([pa.array([], pa.string()), *[pa.array([], pa.int64())] * 2, pa.array([], pa.list_(pa.float64())), pa.array([], pa.list_(pa.int64())), *[none] * 5], names)
        return pa.concat_tables(out)

    shown = blocks.mapInArrow(whole_groups(["series_id", "block"], kernel, 20_000), schema)
    if not raw:
        return shown.drop("ts_dev")
    shown = without_trivial(shown, size, trivial_radius)
    dev = F.when(F.col("local_std") == 0, 1.0).otherwise(F.col("local_std"))
    value = F.transform("values", lambda x: (x - F.col("local_mean")) / dev) if local_norm else F.col("values")
    return shown.withColumn("values", value).drop("ts_dev")


def without_trivial(windows: DataFrame, size: int, radius: float) -> DataFrame:
    """Leaves out windows too close to the last one kept: of each series the first window stays, then each first later
    one at least ``max(radius, 0.1 * deviation of the series * sqrt(size))`` away from the one kept before; if none is, the
    last. Reads each series as a sorted stream and holds one window."""
    schema, rows = windows.schema, windows.repartition("series_id").sortWithinPartitions("series_id", "rank")
    share = 0.1 * size**0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, kept, waiting = None, None, None
        for batch in batches:
            ids, dev = batch.column("series_id").to_pylist(), batch.column("ts_dev").to_pylist()
            values = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), size)
            chosen = []
            for k, series in enumerate(ids):
                if series != name:
                    if waiting is not None:
                        yield waiting
                    name, kept, waiting = series, values[k], None
                    chosen.append(k)
                elif np.sqrt(((values[k] - kept) ** 2).sum()) >= max(radius, share * dev[k]):
                    kept, waiting = values[k], None
                    chosen.append(k)
                else:
                    waiting = batch.slice(k, 1)
            yield batch.take(pa.array(chosen, pa.int64()))
        if waiting is not None:
            yield waiting

    return rows.mapInArrow(run, schema)


def _part_means(times: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Averages over ``n`` equal parts of each window's time; a time on a border belongs to the part before it. An empty
    part takes the average of the one before."""
    t = (times - times[:, :1]).astype(float)
    width = np.where(t[:, -1:] > 0, t[:, -1:] / n, 1.0)
    part = np.clip(np.ceil(t / width).astype(np.int64) - 1, 0, n - 1)
    cell = (part + np.arange(len(t))[:, None] * n).ravel()
    count = np.bincount(cell, minlength=len(t) * n).reshape(-1, n)
    total = np.bincount(cell, weights=values.ravel(), minlength=len(t) * n).reshape(-1, n)
    means = total / np.maximum(count, 1)
    for k in range(1, n):
        means[:, k] = np.where(count[:, k] == 0, means[:, k - 1], means[:, k])
    return means.round(DIGITS)


def window_averages(windows: DataFrame, paa_size: int) -> DataFrame:
    """Adds ``paa``: averages of each window's values over ``paa_size`` equal parts of its time."""
    columns = windows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            matrix = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)  # noqa: E731, B023
            means = _part_means(matrix("times"), matrix("values"), paa_size) if n else np.zeros((0, paa_size))
            ends = pa.array(np.arange(0, n * paa_size + 1, paa_size, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(means.ravel()))], [*columns, "paa"])

    return windows.mapInArrow(run, StructType([*windows.schema.fields, StructField("paa", ArrayType(DoubleType()))]))


def words_of_windows(windows: DataFrame, paa_size: int, alphabet: int) -> tuple[DataFrame, list[float]]:
    """The windows (without ``values, times``) with ``paa`` and ``word``, and the break points: exact percentiles of all
    averages of all windows. A letter counts those at or below the average. Only the break points come to the driver."""
    _checked(alphabet, 2, 26, "the alphabet")
    averaged = materialise(window_averages(windows, paa_size).drop("values", "times"), "averages")
    every = averaged.select(F.explode("paa").alias("x"))
    breaks = [round(x, DIGITS) for x in exact_percentiles(every, "x", [k / alphabet for k in range(1, alphabet)])]
    marks = F.array(*(F.lit(b) for b in breaks))
    return averaged.withColumn("word", letters_of(F.col("paa"), marks, strict=False)), breaks


def mindist_table(breaks: list[float]) -> list[list[float]]:
    """Distance of letters: 0 for the same or neighbouring ones, else that of the break points between them."""
    n = len(breaks) + 1
    return [[0.0 if abs(i - j) <= 1 else breaks[max(i, j) - 1] - breaks[min(i, j)] for j in range(n)] for i in range(n)]
