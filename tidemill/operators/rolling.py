"""Totals and averages over trailing calendar days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.readings import valid_readings


def daily_totals(points: DataFrame) -> DataFrame:
    """``series_id, day_no, total, n`` of the valid readings of each day that has any."""
    return valid_readings(points).groupBy("series_id", "day_no").agg(F.sum("v").alias("total"), F.count("v").alias("n"))


def trailing_totals(points: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """For every series and calendar day, days without readings included, totals and averages over trailing days.

    Columns: ``series_id, day_no, first_day``, and per period p ``total_p``, ``n_p`` (valid readings), ``avg_day_p``
    (total / p) and ``avg_reading_p`` (NULL without readings). A period reaching before the first day holds fewer
    days; ``first_day`` tells. Readings shrink to one row a day before anything is ordered by series; a series then
    has as many rows as its calendar has days. NULL and NaN values count as no reading; an empty table gives no rows;
    infinite values make their totals infinite or NaN.
    """
    daily = daily_totals(points)
    whole = Window.partitionBy("series_id")
    after = Window.partitionBy("series_id").orderBy("day_no")
    rows = daily.select(
        "series_id",
        "day_no",
        "total",
        "n",
        F.min("day_no").over(whole).alias("first_day"),
        F.lead("day_no").over(after).alias("next_day"),
    )
    # each day brings the empty days up to the next one: the calendar of a series, without a cross join
    last_empty = F.coalesce(F.col("next_day") - 1, F.col("day_no"))
    dense = rows.select(
        "series_id",
        "first_day",
        "total",
        "n",
        F.posexplode(F.sequence("day_no", last_empty)).alias("at", "day"),
    ).select(
        "series_id",
        "first_day",
        F.col("day").alias("day_no"),
        F.when(F.col("at") == 0, F.col("total")).otherwise(0.0).alias("total"),
        F.when(F.col("at") == 0, F.col("n")).otherwise(0).alias("n"),
    )
    columns = ["series_id", "day_no", "first_day"]
    for p in periods:
        frame = after.rowsBetween(1 - p, 0)
        total, n = F.sum("total").over(frame), F.sum("n").over(frame)
        columns += [
            total.alias(f"total_{p}"),
            n.alias(f"n_{p}"),
            (total / p).alias(f"avg_day_{p}"),
            F.try_divide(total, n).alias(f"avg_reading_{p}"),
        ]
    return dense.select(*columns)


def surging_days(points: DataFrame) -> DataFrame:
    """Days whose daily average over 7 days is at least twice that over 30 (above 0), once 30 days are full."""
    rows = trailing_totals(points)
    week, month = F.round("avg_day_7", 6), F.round("avg_day_30", 6)
    full = F.col("day_no") >= F.col("first_day") + 29
    return rows.where(full & (week >= 2 * month) & (month > 0)).select("series_id", "day_no")
