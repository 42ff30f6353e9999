"""Exact order statistics of a whole column, and of groups of any size."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.joins import BROADCAST_BYTES, BROADCAST_ROWS, fits, is_small, measured_join, sized_join
from tidemill.sources.scratch import materialise

#: Values that one aggregation may hold.
HELD = 1_000_000


def order_statistics(frame: DataFrame, column: str, ranks: list[int], held: int = HELD) -> list[float]:
    """The values at 0-based ranks among the non-NULL values.

    A range known to hold the rank is narrowed by approximate percentiles until few enough values are in it; values
    below it are only counted. No more than ``held`` values are gathered.
    """
    value = F.col(column)
    rows = frame.where(value.isNotNull()).select(value.cast("double").alias("x"))
    out = []
    for rank in ranks:
        low = high = None
        while True:
            inside = F.lit(True)
            if low is not None:
                inside = (F.col("x") >= low) & (F.col("x") <= high)
            below = F.lit(False) if low is None else F.col("x") < low
            n, under, least, most = rows.agg(
                F.count(F.when(inside, 1)), F.count(F.when(below, 1)), F.min(F.when(inside, F.col("x"))), F.max(F.when(inside, F.col("x")))
            ).first()
            if not n:
                raise ValueError("there are no values")
            if least == most:
                out.append(least)
                break
            within = rows.where(inside)
            if n <= held:
                counted = within.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
                p = (rank - under) / max(1, n - 1)
                out.append(counted.agg(F.percentile("x", F.lit(p), F.col("c"))).first()[0])
                break
            p, slack = (rank - under) / n, 2e-4
            low, high = within.agg(F.percentile_approx("x", F.array(F.lit(max(0.0, p - slack)), F.lit(min(1.0, p + slack))), F.lit(20_000))).first()[0]
    return out


def exact_percentiles(frame: DataFrame, column: str, ps: list[float], held: int = HELD) -> list[float]:
    """Percentiles (0 to 1) with linear interpolation between order statistics."""
    n = frame.where(F.col(column).isNotNull()).count()
    if n == 0:
        return [float("nan")] * len(ps)
    if n <= held:
        counted = frame.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c"))
        return list(counted.agg(F.percentile("x", F.array(*map(F.lit, ps)), F.col("c"))).first()[0])
    places = [p * (n - 1) for p in ps]
    ranks = sorted({r for x in places for r in (int(x), min(n - 1, int(x) + 1))})
    values = dict(zip(ranks, order_statistics(frame, column, ranks, held), strict=True))
    return [values[int(x)] + (values[min(n - 1, int(x) + 1)] - values[int(x)]) * (x - int(x)) for x in places]


#: Cells per doubling of a value's size in the first count of groups.
PER_OCTAVE = 16
#: Parts into which a range of values is cut where more is in it than one task orders.
PARTS = 1024


def magnitude(value: Column) -> Column:
    """A whole number that never falls as the value grows: the sign and the logarithm of its size, in ``PER_OCTAVE`` steps.
    Counts of it are a sketch that merges by adding up, the same in whatever order."""
    size = F.least(F.abs(value), F.lit(1.7e308))
    step = F.when(size > 0, F.floor(F.log2(size) * PER_OCTAVE) + (1075 * PER_OCTAVE + 1)).otherwise(F.lit(0))
    return F.when(value < 0, -step).otherwise(step).cast("int")


def _placed(cells: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The cells (``keys``, ``order``, ``c``) with ``upto``, the count up to and with each."""
    running = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("upto", F.sum("c").over(running))


def _at(rank: Column, what: str) -> Column:
    """``what`` of the cell that holds a 0-based rank."""
    return F.max(F.when((rank >= F.col("upto") - F.col("c")) & (rank < F.col("upto")), F.col(what)))


def pick(inner: DataFrame, spots: DataFrame, keys: list[str], held: int = HELD, small: bool | None = None) -> DataFrame:
    """``keys, n, x``: the values between two neighbouring ranks of each group, ``share`` of the way.

    ``inner`` has ``keys, v, c`` (values and how often they occur, each once), ``spots`` has ``keys, n, below, above, share``,
    one row a group; ``small`` tells whether these can be broadcast, if that is known. Groups of more than ``held`` values are cut into parts of their range, of which only those that hold
    the ranks go on, until no task orders more.
    """
    while not is_small(inner, held):
        ends = inner.groupBy(*keys).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count(F.lit(1)).alias("values"))
        ends = materialise(ends, "ends")
        if is_small(ends.where(F.col("values") > held), 0):
            break
        # halves first, as the difference of two doubles may not be one
        along = (F.col("v") / 2 - F.col("least") / 2) / (F.col("most") / 2 - F.col("least") / 2)
        part = F.when(F.col("least") < F.col("most"), F.least(F.floor(along * PARTS), F.lit(PARTS - 1))).otherwise(F.lit(0)).cast("int")
        parted = sized_join(inner, ends, keys).select(*keys, "v", "c", part.alias("part"))
        cells = _placed(parted.groupBy(*keys, "part").agg(F.sum("c").alias("c")), keys, "part").withColumn("under", F.col("upto") - F.col("c"))
        known = sized_join(cells, spots, keys)
        chosen = materialise(
            known.groupBy(*keys).agg(
                _at(F.col("below"), "part").alias("low"), _at(F.col("above"), "part").alias("high"), _at(F.col("below"), "under").alias("under"),
                F.max("below").alias("below"), F.max("above").alias("above"), F.max("share").alias("share"), F.max("n").alias("n"),
            ), "spots",
        )
        kept = sized_join(parted, chosen.select(*keys, "low", "high"), keys).where(F.col("part").between(F.col("low"), F.col("high")))
        inner = materialise(kept.select(*keys, "v", "c"), "inner")
        spots = chosen.select(*keys, "n", (F.col("below") - F.col("under")).alias("below"), (F.col("above") - F.col("under")).alias("above"), "share")
        small = fits(chosen)
    placed = _placed(inner, keys, "v")
    placed = sized_join(placed, spots, keys) if small is None else measured_join(placed, spots, keys, small)
    found = placed.groupBy(*keys).agg(_at(F.col("below"), "v").alias("a"), _at(F.col("above"), "v").alias("b"), F.max("share").alias("share"), F.max("n").alias("n"))
    return found.select(*keys, "n", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("x"))


def _ordered(rows: DataFrame, keys: list[str], ps: dict[str, float]) -> DataFrame:
    """The percentiles of groups that a task can order, with one shuffle."""
    counted = rows.repartition(*keys).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    placed = _placed(counted, keys, "v").withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    columns = []
    for k, p in enumerate(ps.values()):
        where = F.lit(float(p)) * (F.col("n") - 1)
        columns += [_at(F.floor(where), "v").alias(f"a_{k}"), _at(F.ceil(where), "v").alias(f"b_{k}")]
    ends = placed.groupBy(*keys).agg(F.max("n").alias("n"), *columns)
    between = []
    for k, (name, p) in enumerate(ps.items()):
        where, a, b = F.lit(float(p)) * (F.col("n") - 1), F.col(f"a_{k}"), F.col(f"b_{k}")
        between.append(F.when(a == b, a).otherwise(a + (b - a) * (where - F.floor(where))).alias(name))
    return ends.select(*keys, "n", *between)


def grouped_percentiles(
    rows: DataFrame, keys: list[str], ps: dict[str, float], value: str = "v", held: int = HELD, sparse: bool = False
) -> DataFrame:
    """``keys, n`` and a column per name in ``ps``: exact percentiles (0 to 1, linear between order statistics) of the
    non-NULL values of each group; groups without any have no row.

    Read twice: first values are counted by ``magnitude``, before any shuffle; then the values in the cells that hold the
    ranks are ordered. However large a group, no more than ``held`` of its values meet in a task. Where groups are ``sparse``,
    counting them first saves nothing: of first keys with at most ``held`` values the groups are ordered at once.
    """
    rows = rows.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    if sparse:
        large = rows.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > held).select(keys[0])
        large = materialise(large, "large")
        if is_small(large, 0):
            return _ordered(rows, keys, ps)
        side = F.broadcast(large) if fits(large) else large
        rest = grouped_percentiles(rows.join(side, keys[0], "left_semi"), keys, ps, "v", held)
        return _ordered(rows.join(side, keys[0], "left_anti"), keys, ps).unionByName(rest)
    cells = rows.groupBy(*keys, magnitude(F.col("v")).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    cells = _placed(cells, keys, "b").withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    cells = cells.withColumn("under", F.col("upto") - F.col("c"))
    columns = []
    for k, p in enumerate(ps.values()):
        where = F.lit(float(p)) * (F.col("n") - 1)
        below, above = F.floor(where), F.ceil(where)
        columns += [_at(below, "b").alias(f"low_{k}"), _at(above, "b").alias(f"high_{k}"), _at(below, "under").alias(f"under_{k}")]
    spots = materialise(cells.groupBy(*keys).agg(F.max("n").alias("n"), *columns), "cells")
    b = magnitude(F.col("v"))
    inside = [b.between(F.col(f"low_{k}"), F.col(f"high_{k}")) for k in range(len(ps))]
    small = fits(spots, BROADCAST_ROWS // len(ps), BROADCAST_BYTES // len(ps))
    some = measured_join(rows, spots.drop("n", *(f"under_{k}" for k in range(len(ps)))), keys, small).where(reduce(operator.or_, inside))
    wanted = some.select(*keys, "v", F.explode(F.array_compact(F.array(*(F.when(x, F.lit(k)) for k, x in enumerate(inside))))).alias("q"))
    inner = materialise(wanted.groupBy(*keys, "q", "v").agg(F.count(F.lit(1)).alias("c")), "inner")
    each = spots.select(*keys, "n", F.explode(F.array(*(F.struct(F.lit(k).alias("q"), F.lit(float(p)).alias("p"), F.col(f"under_{k}").alias("under")) for k, p in enumerate(ps.values())))).alias("s"))
    where = F.col("s.p") * (F.col("n") - 1)
    ranks = each.select(
        *keys, "n", F.col("s.q").alias("q"), (F.floor(where) - F.col("s.under")).alias("below"), (F.ceil(where) - F.col("s.under")).alias("above"), (where - F.floor(where)).alias("share")
    )
    found = pick(inner, ranks, [*keys, "q"], held, small)
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("q") == k, F.col("x"))).alias(name) for k, name in enumerate(ps)))
