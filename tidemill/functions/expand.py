"""Rows for the values of a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a range that are held at a time.
BLOCK = 100_000


def each_value(frame: DataFrame, first: Column, last: Column, name: str, step: int = 1, block: int = BLOCK) -> DataFrame:
    """A row for each of ``first, first + step, ...`` up to ``last``, as the column ``name``. A long range is laid out in
    blocks, so that no row holds more than ``block`` values. Ranges are not empty."""
    blocks = frame.select("*", F.explode(F.sequence(first, last, F.lit(step * block))).alias("low_of_block"))
    high = F.least(F.col("low_of_block") + step * (block - 1), last)
    return blocks.select("*", F.explode(F.sequence(F.col("low_of_block"), high, F.lit(step))).alias(name)).drop("low_of_block")
