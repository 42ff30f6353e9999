"""Parts of series: by time, by count, by value, by the runs of another series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.expand import each_value
from tidemill.functions.joins import sized_join
from tidemill.functions.predicate import criterion
from tidemill.operators.readings import DAY_MS, consecutive, laid_out, ordinal, valid_readings
from tidemill.sources.scratch import materialise
from tidemill.sources.tables import by_dataset


#: Counts up to which a task keeps no more rows of a series than asked for before they are shuffled.
FEW = 1000
#: Series of a group that meet its reference's runs in one task.
TOGETHER = 16


def cut_range(readings: DataFrame, start: int | None, end: int) -> DataFrame:
    """Readings from ``start`` (default: the series' first) to ``end``, both inclusive."""
    if start is not None and end <= start:
        raise ValueError("the end must be after the start")
    inside = F.col("t") <= end
    return readings.where(inside & (F.col("t") >= start) if start is not None else inside)


def cut_first(readings: DataFrame, n: int | str, start: int | None = None) -> DataFrame:
    """The first ``n`` readings of each series, from ``start`` on; fewer where there are fewer."""
    count = int(n)
    if count < 0:
        raise ValueError("a count can't be negative")
    rows = readings if start is None else readings.where(F.col("t") >= start)
    if count <= FEW:  # each task first cuts its own rows to as many
        order = Window.partitionBy("series_id").orderBy("t")
        return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).drop("place")
    return ordinal(laid_out(rows), "place").where(F.col("place") < count).drop("place")


def cut(readings: DataFrame, start: int | None = None, end: int | None = None, nb_points: int | str | None = None) -> DataFrame:
    """Cuts by exactly one of ``end`` and ``nb_points``."""
    if (end is None) == (nb_points is None):
        raise ValueError("give either an end or a number of points")
    return cut_range(readings, start, end) if nb_points is None else cut_first(readings, nb_points, start)


def cut_points(points: DataFrame, start: int | None = None, end: int | None = None, nb_points: int | str | None = None) -> DataFrame:
    """``cut`` of the rows of a store. The bounds are compared with the stored times, so that they reach the scan: corrections
    of a reading have its time, and so a range holds either all or none of them."""
    rows = points
    if start is not None:
        rows = rows.where(F.col("t") >= start)
    if end is not None:
        rows = rows.where(F.col("t") <= end)
    return cut(valid_readings(rows), start, end, nb_points)


def cut_dataset(points: DataFrame, datasets: DataFrame, name: str, **how) -> DataFrame:
    """``cut_points`` of every series of a dataset, in one plan."""
    return cut_points(by_dataset(points, datasets, name), **how)


def cut_y(readings: DataFrame, text: str, fid: Column | None = None, fid_pattern: str = "{fid}_cutY{compl}", metric: Column | None = None) -> DataFrame:
    """Readings with the name of the part they belong to: those whose value meets the criterion over ``Y``, and the
    complement (``compl`` is ``_compl``). Adds ``matches`` and ``new_fid``; a part without readings has no rows."""
    matches = criterion(text, F.col("v"), "Y")
    return readings.withColumn("matches", matches).withColumn(
        "new_fid", named(fid_pattern, fid=fid if fid is not None else F.col("series_id"), M=metric, compl=F.when(F.col("matches"), "").otherwise("_compl"))
    )


def named(pattern: str, **parts: Column | None) -> Column:
    """A name from a pattern with ``{key}`` or ``%(key)s`` places."""
    out = F.lit(pattern)
    for key, value in parts.items():
        value = F.lit("") if value is None else F.coalesce(value.cast("string"), F.lit(""))
        for place in (f"{{{key}}}", f"%({key})s"):
            out = F.replace(out, F.lit(place), value)
    return out


def runs_meeting(readings: DataFrame, text: str) -> DataFrame:
    """``series_id, first_t, last_t``: maximal runs of consecutive readings that meet the criterion over ``M``.

    Openings and closes are paired like readings, within days and across their edges.
    """
    pairs = consecutive(laid_out(readings), opening=True)
    now, then = criterion(text, F.col("v"), "M"), criterion(text, F.col("next_v"), "M")
    now = F.col("t").isNotNull() & now
    then = F.col("next_t").isNotNull() & then
    ends = pairs.select(
        "series_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(now & ~then, F.struct(F.col("t").alias("at"), F.lit(1).alias("closes"))),
                    F.when(then & ~now, F.struct(F.col("next_t").alias("at"), F.lit(0).alias("closes"))),
                )
            )
        ).alias("e"),
    ).select("series_id", "e.at", "e.closes")
    # each opening is followed by its close; a place of its own for each keeps those of one reading apart
    placed = ends.select("series_id", (F.col("at") * 2 + F.col("closes")).alias("t"), F.col("closes").cast("double").alias("v"))
    return consecutive(laid_out(placed)).where("v = 0").select(
        "series_id", F.expr("t div 2").alias("first_t"), F.expr("(next_t - 1) div 2").alias("last_t")
    )


def cut_by_metric(
    readings: DataFrame, series: DataFrame, metric: str, text: str, group_by: str | None = None, fid_pattern: str = "%(fid)s__%(M)s__cut"
) -> DataFrame:
    """Of every other series of a group, the readings within the runs in which the group's reference series, the one
    with ``metric``, meets the criterion.

    ``series`` has ``series_id, fid, metric, tags``. Groups are the values of the tag ``group_by`` (or all series
    together). Adds ``group`` and ``new_fid``. A group without exactly one reference, or a series without the tag, is a
    ValueError. Runs are laid over the days they touch; in the order of time, a reading looks at the last run that opened
    before it on its day. Runs of a reference don't overlap, so that one decides. The series of a group are spread over
    parts of ``TOGETHER`` or so, each with the runs.
    """
    group = F.lit("no_group") if group_by is None else F.element_at("tags", group_by)
    members = materialise(series.select("series_id", "fid", "metric", group.alias("group")), "members")
    if members.where(F.col("group").isNull()).limit(1).count():
        raise ValueError(f"a series has no {group_by}")
    is_reference = F.col("metric") == metric
    counts = members.groupBy("group").agg(F.count(F.when(is_reference, 1)).alias("n"), F.count(F.lit(1)).alias("members"))
    odd = counts.where("n <> 1").limit(1).collect()
    if odd:
        raise ValueError(f"group {odd[0]['group']} has {odd[0]['n']} series of metric {metric}")
    laid = laid_out(readings)
    parts = counts.select("group", F.expr(f"members div {TOGETHER} + 1").alias("parts"))
    reference = members.where(is_reference).select("series_id", "group").join(parts, "group")
    runs = sized_join(runs_meeting(sized_join(laid, reference.select("series_id"), "series_id"), text), reference, "series_id")
    days = each_value(runs, F.expr(f"first_t div {DAY_MS}"), F.expr(f"last_t div {DAY_MS}"), "day_no")
    none = F.lit(None).cast("string")
    opened = days.select(
        "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "day_no",
        F.greatest(F.col("first_t"), F.col("day_no") * DAY_MS).alias("t"), F.col("last_t").alias("until"), none.alias("series_id"), none.alias("fid"), F.lit(None).cast("double").alias("v"),
    )
    others = members.where(~F.coalesce(is_reference, F.lit(False))).select("series_id", F.coalesce("fid", "series_id").alias("fid"), "group")
    rows = sized_join(laid, others.join(parts, "group"), "series_id").select(
        "group", F.pmod(F.xxhash64("series_id"), F.col("parts")).alias("part"), F.expr(f"t div {DAY_MS}").alias("day_no"), "t", F.lit(None).cast("long").alias("until"), "series_id", "fid", "v"
    )
    # a run that opens at a reading's time comes before it: it has no series
    order = Window.partitionBy("group", "part", "day_no").orderBy("t", F.col("series_id").asc_nulls_first())
    upto = F.last("until", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    held = rows.unionByName(opened).withColumn("upto", upto).where(F.col("series_id").isNotNull() & (F.col("t") <= F.col("upto")))
    return held.select("group", "series_id", "t", "v", named(fid_pattern, fid=F.col("fid"), M=F.lit(metric)).alias("new_fid"))
