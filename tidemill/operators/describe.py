"""Discretised series and data-quality statistics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.readings import consecutive, join_by_series, laid_out

OPERATORS = {"MIN": lambda: F.min("v"), "MAX": lambda: F.max("v"), "AVG": lambda: F.avg("v"), "STD": lambda: F.stddev_pop("v")}
#: Parts in which the gaps of a series are ranked first.
PARTS = 64
TABLE_NAME = re.compile(r"[a-zA-Z0-9-_]+")


def discretize(readings: DataFrame, buckets: int, operators: tuple[str, ...] = ("MIN", "MAX", "AVG", "STD"), table_name: str = "table") -> DataFrame:
    """``series_id, bucket, start_ms`` and one column per operator. Each series' span is cut into ``buckets`` of ``ceil(span
    / buckets)`` ms; bucket i holds the times after its start up to the next start, the first its start too. A bucket
    without readings has NULLs."""
    if not TABLE_NAME.fullmatch(table_name):
        raise ValueError("a table name holds letters, digits, - and _")
    if buckets < 1:
        raise ValueError("at least one bucket is needed")
    unknown = set(operators) - set(OPERATORS)
    if unknown or not operators:
        raise ValueError(f"operators are of {', '.join(OPERATORS)}")
    spans = readings.groupBy("series_id").agg(F.min("t").alias("sd"), F.max("t").alias("ed"))
    spans = spans.withColumn("size", F.greatest(F.ceil((F.col("ed") - F.col("sd")) / buckets).cast("long"), F.lit(1)))
    rows = join_by_series(readings.select("series_id", "t", "v"), spans, readings)
    at = F.greatest(F.ceil((F.col("t") - F.col("sd")) / F.col("size")).cast("int") - 1, F.lit(0))
    cells = rows.groupBy("series_id", at.alias("bucket")).agg(*(OPERATORS[o]().alias(o) for o in operators))
    every = spans.select("series_id", "sd", "size", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return every.join(cells, ["series_id", "bucket"], "left").select(
        "series_id", "bucket", (F.col("sd") + F.col("bucket") * F.col("size")).alias("start_ms"), *operators
    )


def discretized_table(cells: DataFrame, buckets: int, operators: tuple[str, ...]) -> DataFrame:
    """One row per series with columns ``{OP}_B{n}``, buckets first, then operators."""
    columns = [
        F.max(F.when(F.col("bucket") == b, F.col(o))).alias(f"{o}_B{b + 1}") for b in range(buckets) for o in operators
    ]
    return cells.groupBy("series_id").agg(*columns)


def quality_values(readings: DataFrame) -> DataFrame:
    """``qual_min_value, qual_max_value, qual_nb_points, qual_average, qual_variance`` (population; 0 for a constant
    series) per series, in one aggregation."""
    stats = readings.groupBy("series_id").agg(
        F.min("v").alias("qual_min_value"),
        F.max("v").alias("qual_max_value"),
        F.count("v").alias("qual_nb_points"),
        F.avg("v").alias("qual_average"),
        F.var_pop("v").alias("variance"),
    )
    constant = F.col("qual_min_value") == F.col("qual_max_value")
    return stats.withColumn("qual_variance", F.when(constant, 0.0).otherwise(F.col("variance"))).drop("variance")


def gap_histogram(readings: DataFrame) -> DataFrame:
    """``series_id, gap, n``: how often each gap between consecutive readings occurs; counted before the shuffle."""
    gaps = consecutive(laid_out(readings)).where(F.col("next_t").isNotNull())
    return gaps.groupBy("series_id", (F.col("next_t") - F.col("t")).alias("gap")).agg(F.count(F.lit(1)).alias("n"))


def quality_time(readings: DataFrame, bars: int = 20) -> DataFrame:
    """``qual_ref_period`` (the most frequent gap, ties: the smallest), ``qual_min_period, qual_max_period,
    qual_average_period`` and ``qual_hist_period, qual_hist_period_percent`` (JSON of the ``bars`` most frequent gaps).
    A series of one reading gives no row."""
    counts = gap_histogram(readings).withColumn("part", F.pmod(F.xxhash64("gap"), F.lit(PARTS)))
    # a series may have as many gaps as readings: the most frequent are taken in parts first
    first = Window.partitionBy("series_id", "part").orderBy(F.col("n").desc(), F.col("gap"))
    leading = counts.withColumn("place", F.row_number().over(first)).where(F.col("place") <= bars)
    order = Window.partitionBy("series_id").orderBy(F.col("n").desc(), F.col("gap"))
    leading = leading.withColumn("place", F.row_number().over(order)).where(F.col("place") <= bars)
    tops = leading.groupBy("series_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "gap", "n"))).alias("top"), F.max(F.when(F.col("place") == 1, F.col("gap"))).alias("qual_ref_period")
    )

    def json(value):
        entry = lambda x: F.struct(x["gap"].cast("string").alias("k"), value(x).alias("v"))
        return F.to_json(F.map_from_entries(F.transform("top", entry)))

    stats = counts.groupBy("series_id").agg(
        F.min("gap").alias("qual_min_period"),
        F.max("gap").alias("qual_max_period"),
        (F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("qual_average_period"),
        F.sum("n").alias("all"),
    )
    return tops.join(stats, "series_id").select(
        "series_id", "qual_ref_period", "qual_min_period", "qual_max_period", "qual_average_period",
        json(lambda x: x["n"]).alias("qual_hist_period"),
        json(lambda x: F.round(x["n"] * 100.0 / F.col("all"), 3)).alias("qual_hist_period_percent"),
    )


def quality(readings: DataFrame, compute_value: bool = True, compute_time: bool = True) -> DataFrame:
    """The statistics of values, of times, or both, one row per series."""
    if not (compute_value or compute_time):
        raise ValueError("nothing to compute")
    if not compute_time:
        return quality_values(readings)
    if not compute_value:
        return quality_time(readings)
    return quality_values(readings).join(quality_time(readings), "series_id", "left")
