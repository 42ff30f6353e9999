"""Irregular readings on a regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.expand import each_value
from tidemill.functions.joins import sized_join
from tidemill.operators.readings import consecutive, valid_readings


def regular_grid(points: DataFrame, periods: DataFrame, gap_limit: int = 4) -> DataFrame:
    """One row per slot of each series' period: ``series_id, slot_ms, value, status``.

    Slot k is ``[k * period, (k + 1) * period)`` from epoch 0, from the series' first slot with a valid reading to
    its last. The sorted readings and the sorted grid are merged as of each slot's start: ``value`` is the linear
    interpolation in time between the neighbours on both sides, NULL where they lie more than ``gap_limit`` periods
    apart. ``status`` is ``observed`` for a slot that holds a reading, else ``filled`` or, beyond the limit,
    ``missing``. The first slot takes its first reading. Series without a period or without valid readings give no
    rows. ``periods`` has ``series_id, period`` (ms), one row a series.
    """
    pairs = sized_join(consecutive(valid_readings(points), opening=True), periods.select("series_id", "period"), "series_id")
    pairs = pairs.withColumn("k", F.expr("t div period")).withColumn("next_k", F.expr("next_t div period"))
    ahead = F.col("k").isNull() | (F.col("next_k") > F.col("k"))
    opening = F.coalesce(F.col("k") + 1, F.col("next_k"))
    slots = each_value(pairs.where(ahead & F.col("next_k").isNotNull()), opening, F.col("next_k"), "slot")
    at = F.col("slot") * F.col("period")
    share = (at - F.col("t")) / (F.col("next_t") - F.col("t"))
    near = F.col("next_t") - F.col("t") <= F.lit(gap_limit) * F.col("period")
    between = F.when(near, F.col("v") + (F.col("next_v") - F.col("v")) * share)
    observed = F.col("slot") == F.col("next_k")
    return slots.select(
        "series_id",
        at.alias("slot_ms"),
        F.when(F.col("k").isNull(), F.col("next_v")).otherwise(between).alias("value"),
        F.when(observed, "observed").when(near, "filled").otherwise("missing").alias("status"),
    )


def empty_slots(points: DataFrame, periods: DataFrame) -> DataFrame:
    """``series_id, slot_ms`` of the slots that hold no valid reading."""
    return regular_grid(points, periods).where(F.col("status") != "observed").select("series_id", "slot_ms")


