"""Writers for derived series and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_points(points: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Derived series as Parquet, rows of one series side by side, so that a scan by series prunes row groups."""
    points.repartitionByRange("series_id", "t").sortWithinPartitions("series_id", "t").write.mode(mode).parquet(path)


def matrix(pairs: DataFrame, row: str, column: str, value: str, labels: list[str]) -> DataFrame:
    """Tall pairs as a square table with the given labels; the caller bounds their number."""
    cells = pairs.select(F.col(row).alias("row"), F.col(column).alias("column"), F.col(value).alias("value"))
    return cells.groupBy("row").pivot("column", labels).agg(F.first("value"))


def write_matrix_csv(pairs: DataFrame, row: str, column: str, value: str, labels: list[str], path: str) -> None:
    """The square table as text with ``;`` between cells and a header row and column."""
    matrix(pairs, row, column, value, labels).orderBy("row").write.csv(path, sep=";", header=True)
