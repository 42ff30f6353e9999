"""Readers. A table is one Parquet file or folder in a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_points(
    spark: SparkSession, directory: str, start_ms: int | None = None, end_ms: int | None = None
) -> DataFrame:
    """The readings of a store, both bounds inclusive. The bounds are compared with the stored column, so
    that they reach the Parquet scan."""
    points = table(spark, directory, "points")
    if start_ms is not None:
        points = points.where(F.col("t") >= start_ms)
    if end_ms is not None:
        points = points.where(F.col("t") <= end_ms)
    return points


def by_dataset(frame: DataFrame, datasets: DataFrame, name: str) -> DataFrame:
    """The rows of the series in the named dataset. A series listed twice counts once; an unknown name
    gives no rows."""
    members = datasets.where(F.col("ds_name") == name).select("series_id")
    return frame.join(members, "series_id", "left_semi")
