"""Series on another period, with the grid anchored at the first reading of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.expand import each_value
from tidemill.functions.joins import sized_join
from tidemill.operators.readings import consecutive, join_by_series, laid_out, of_source

AGGREGATIONS = {
    "MIN": lambda: F.min("v"),
    "MAX": lambda: F.max("v"),
    "MED": lambda: F.percentile("v", F.lit(0.5)),
    "AVG": lambda: F.avg("v"),
    "FIRST": lambda: F.min_by("v", "t"),
    "LAST": lambda: F.max_by("v", "t"),
}
POSITIONS = {"BEG": 0, "MID": 1, "END": 2}
METHODS = ("LINEAR_INTERPOLATION", "VALUE_BEFORE", "VALUE_AFTER")


def _name(value, allowed, what: str) -> str:
    """A member of an enumeration by its name or its number."""
    names = list(allowed)
    name = names[value] if isinstance(value, int) and 0 <= value < len(names) else value
    if name not in names:
        raise ValueError(f"{what} must be one of {', '.join(names)}")
    return name


def _period(period: int) -> int:
    if int(period) <= 0:
        raise ValueError("the period must be above 0")
    return int(period)


def starts(readings: DataFrame) -> DataFrame:
    """``series_id, t0, n``: first time and number of readings; added up before the shuffle."""
    return readings.groupBy("series_id").agg(F.min("t").alias("t0"), F.count(F.lit(1)).alias("n"))


def downsample(readings: DataFrame, period: int, aggregation: str = "AVG", position: str = "BEG") -> DataFrame:
    """One value per slot ``[t0 + k * period, t0 + (k + 1) * period)`` that holds readings, stamped at the slot's
    beginning, middle or end. A series of one reading stays as it is."""
    p, how = _period(period), AGGREGATIONS[_name(aggregation, AGGREGATIONS, "aggregation")]()
    shift = p // 2 * POSITIONS[_name(position, POSITIONS, "position")]
    rows = join_by_series(readings.select("series_id", "t", "v"), starts(readings), readings)
    k = F.expr(f"(t - t0) div {p}")
    slots = rows.groupBy("series_id", "t0", "n", k.alias("k")).agg(how.alias("v"))
    at = F.when(F.col("n") == 1, F.col("t0")).otherwise(F.col("t0") + F.col("k") * p + shift)
    return slots.select("series_id", at.alias("t"), "v")


def upsample(readings: DataFrame, period: int, method: str = "LINEAR_INTERPOLATION") -> DataFrame:
    """Values on the grid ``t0, t0 + period, ...`` up to the last reading: interpolated, the reading before, or the one
    after; a reading on the grid keeps its value."""
    p, how = _period(period), _name(method, METHODS, "method")
    laid = laid_out(readings)
    pairs = join_by_series(consecutive(laid), starts(laid).select("series_id", "t0"), readings)
    first = F.col("t0") + F.ceil((F.col("t") - F.col("t0")) / p).cast("long") * p
    last = F.when(F.col("next_t").isNull(), F.col("t")).otherwise(F.col("next_t") - 1)
    grid = pairs.withColumn("first", first).withColumn("last", last).where(F.col("first") <= F.col("last"))
    rows = each_value(grid, F.col("first"), F.col("last"), "at", p)
    share = (F.col("at") - F.col("t")) / (F.col("next_t") - F.col("t"))
    value = {
        "LINEAR_INTERPOLATION": F.col("v") + (F.col("next_v") - F.col("v")) * share,
        "VALUE_BEFORE": F.col("v"),
        "VALUE_AFTER": F.col("next_v"),
    }[how]
    return rows.select("series_id", F.col("at").alias("t"), F.when(F.col("at") == F.col("t"), F.col("v")).otherwise(value).alias("v"))


def resample(
    readings: DataFrame, periods: DataFrame, period: int, method: str = "LINEAR_INTERPOLATION", position: str = "BEG", aggregation: str = "AVG"
) -> DataFrame:
    """Each series up or down to ``period``: up where its own period is at least as long. ``periods`` has ``series_id,
    period``; a series without one is a ValueError."""
    p = _period(period)
    known = periods.select("series_id", F.col("period").alias("own"))
    missing = readings.select("series_id").distinct().join(known.where("own > 0"), "series_id", "left_anti")
    if missing.limit(1).count():
        raise ValueError("a series has no reference period")
    laid = laid_out(readings)
    rows = sized_join(laid, known, "series_id")
    up = upsample(of_source(rows.where(F.col("own") >= p).drop("own"), readings), p, method)
    down = downsample(of_source(rows.where(F.col("own") < p).drop("own"), readings), p, aggregation, position)
    return up.unionByName(down)
