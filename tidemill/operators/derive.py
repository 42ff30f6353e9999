"""What is known of derived series: their name, parent, span and what they take over from the parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.cut import named
from tidemill.operators.readings import series_metadata

# The names that derived series get by default.
NAMES = {
    "cut": "{fid}_cut",
    "cut_y": "{fid}_cutY{compl}",
    "cut_by_metric": "%(fid)s__%(M)s__cut",
    "resample": "{fid}_resampled_to_{period}ms",
    "rolling_mean": "{fid}_rollmean_{size}",
    "slope": "{fid}_slope",
    "unwrap": "%(fid)s__unwrap",
}


def derived_series(result: DataFrame, series: DataFrame, pattern: str, ref_period: Column | None = None, **parts: Column) -> DataFrame:
    """``fid, parent_id, metric, start_ms, end_ms, nb_points, ref_period, tags`` of the series in ``result`` (rows
    ``series_id, t, v`` under their parents' ids). A derived series without rows is not listed.

    ``pattern`` is one of ``NAMES`` or a text with ``{fid}``, ``{M}`` and the places in ``parts``; a parent without a name
    is named by its id. Metric and tags are the parent's; the period is the parent's unless given.
    """
    parents = series.groupBy("series_id").agg(
        F.max("fid").alias("parent_fid"), F.max("metric").alias("metric"), F.max("ref_period").alias("own"), F.first("tags").alias("tags")
    )
    known = series_metadata(result).join(parents, "series_id", "left")
    name = named(NAMES.get(pattern, pattern), fid=F.coalesce("parent_fid", "series_id"), M=F.col("metric"), **parts)
    period = F.col("own") if ref_period is None else ref_period.cast("long")
    return known.select(
        name.alias("fid"), F.col("series_id").alias("parent_id"), "metric", "start_ms", "end_ms", "nb_points", period.alias("ref_period"), "tags"
    )
