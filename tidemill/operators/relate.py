"""Relations between series: correlation and distance matrices, cross-correlation, correlation by context.

Series are aligned by position and cut to the shorter. A matrix over S series has S * S / 2 cells, so it is meant for
the series of a dataset. Series become arrays no longer than the second longest of them (what lies beyond meets nothing),
which are compared block against block, and part by part where the relation is a sum over positions. Neither blocks nor
cells are shuffled: blocks are written once and each pair of them is read where it is compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.joins import is_small, sized_join
from tidemill.operators.readings import laid_out, ordinal
from tidemill.sources.scratch import materialise

#: Series in a block.
BLOCK = 256
#: Series in a block where there are many and the kernel is a product of matrices, and the blocks there are at least before they grow.
WIDE = 2048
LEAST = 4
#: Values of a series in a part.
PART = 65_536
#: Values that the series of a block hold together. A pair of blocks is in memory several times: as rows, as Arrow, as matrices.
HELD = 196_608
#: Series on the left of a product of matrices, and cells in a batch of rows.
STRIP = 512
CELLS = 65_536
#: Products of spectra that are held at a time.
SPECTRA = 4_000_000
#: A sum of squared differences this much smaller than the squares it is the rest of is taken from the differences.
CLOSE = 256


def series_arrays(readings: DataFrame, equal: bool = False, part_rows: int | None = None) -> DataFrame:
    """``series_id, part, values``: each series' values in order of time, cut to the second longest series, or with
    ``equal`` to the shortest; in parts of ``part_rows``, or whole as part 0. The readings are gathered once, into files
    that tell how long the series are."""
    step = part_rows or PART
    part = F.floor(F.col("idx") / step).cast("long")
    gathered = ordinal(laid_out(readings)).groupBy("series_id", part.alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "v"))), lambda x: x["v"]).alias("values")
    )
    parts = materialise(gathered.withColumn("n", F.size("values")), "parts")
    counts = parts.groupBy("series_id").agg(F.sum("n").alias("n"))
    if equal:
        cap = counts.agg(F.min("n")).first()[0] or 0
    else:
        top = [r["n"] for r in counts.orderBy(F.col("n").desc()).limit(2).collect()]
        cap = top[-1] if top else 0
    left = F.lit(cap) - F.col("part") * step
    values = F.when(F.col("n") > left, F.slice("values", F.lit(1), left.cast("int"))).otherwise(F.col("values"))
    cut = parts.where(left > 0).select("series_id", "part", values.alias("values"))
    if part_rows or cap <= step:
        return cut
    joined = F.array_sort(F.collect_list(F.struct("part", "values")))
    return cut.groupBy("series_id").agg(F.flatten(F.transform(joined, lambda x: x["values"])).alias("values")).select("series_id", F.lit(0).cast("long").alias("part"), "values")


def _packed(table: pa.Table, each: Callable[[np.ndarray], np.ndarray] | None) -> pa.Table:
    """The series of a block as one row, ``each`` turned into other values."""
    values = table.column("values").combine_chunks()
    ends, flat = values.offsets.to_numpy(), values.values.to_numpy(zero_copy_only=False)
    flat, ends = flat[ends[0] : ends[-1]], ends - ends[0]
    if each:
        flat = np.concatenate([each(x) for x in np.split(flat, ends[1:-1])]).astype(np.float64)
    row = {"ids": table.column("series_id").to_pylist(), "sizes": np.diff(ends).tolist(), "data": flat.tobytes()}
    keys = {k: table.column(k)[0].as_py() for k in ("h", "part", "far")}
    return pa.Table.from_pylist([keys | row], pa.schema({"h": pa.int32(), "part": pa.int64(), "far": pa.bool_(), "ids": pa.list_(pa.string()), "sizes": pa.list_(pa.int32()), "data": pa.binary()}))


def _unpacked(batch: pa.RecordBatch, k: int, side: str) -> tuple[list[str], list[np.ndarray]]:
    sizes = batch.column(f"sizes_{side}")[k].values.to_numpy()
    flat = np.frombuffer(batch.column(f"data_{side}")[k].as_buffer(), dtype=np.float64)
    return batch.column(f"ids_{side}")[k].as_py(), np.split(flat, np.cumsum(sizes)[:-1])


def pairwise(arrays: DataFrame, kernel: Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]], names: list[str], block: int | None = None, wide: bool = False, each: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``id_a, id_b`` (``id_a < id_b``) and the kernel's columns for all pairs of series and parts. The kernel gets two
    lists of arrays, of which ``each`` may have made others before, and gives matrices. Blocks have ``block`` series or
    so, else ``BLOCK``, and with ``wide`` more where there are many. Arrays may
    be marked as ``far``: then pairs of two that are get no row."""
    apart = "far" in arrays.columns
    size = F.size("values")
    total, held = arrays.agg(F.count_distinct("series_id"), F.coalesce(F.sum(F.when(F.col("part") == 0, size)), F.lit(0))).first()
    most = block or (min(WIDE, max(BLOCK, -(-total // LEAST))) if wide else BLOCK)
    blocks = max(1, -(-total // most), -(-held // (HELD if wide else 4 * HELD)))
    placed = arrays.withColumn("h", F.pmod(F.xxhash64("series_id"), F.lit(blocks)).cast("int"))
    placed = (placed if apart else placed.withColumn("far", F.lit(False))).repartition(blocks, "h")
    packed = placed.groupBy("h", "part", "far").applyInArrow(lambda table: _packed(table, each), "h int, part long, far boolean, ids array<string>, sizes array<int>, data binary")
    written = materialise(packed, "blocks")
    a, b = (written.select(*(F.col(c).alias(f"{c}_{side}") for c in written.columns)) for side in "ab")
    # of a pair of blocks one order counts, in turns, so that every task has some
    once = (F.col("h_a") == F.col("h_b")) & (~F.col("far_a") | F.col("far_b")) | (F.col("h_a") != F.col("h_b")) & ((F.col("h_a") < F.col("h_b")) == (F.pmod(F.col("h_a") + F.col("h_b"), F.lit(2)) == 0))
    met = (F.col("part_a") == F.col("part_b")) & once
    pairs = a.join(b.hint("shuffle_replicate_nl"), met & ~(F.col("far_a") & F.col("far_b")) if apart else met)
    schema = pa.schema({"id_a": pa.string(), "id_b": pa.string(), **dict.fromkeys(names, pa.float64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for k in range(batch.num_rows):
                (ids_a, left), (ids_b, right) = _unpacked(batch, k, "a"), _unpacked(batch, k, "b")
                ids = pa.array(ids_a + ids_b, pa.string())
                rank = np.unique(np.array(ids_a + ids_b, dtype=object), return_inverse=True)[1]
                at_b = np.arange(len(ids_a), len(rank), dtype=np.int32)
                within = batch.column("h_a")[k] == batch.column("h_b")[k] and batch.column("far_a")[k] == batch.column("far_b")[k]
                step = max(1, CELLS // len(right))
                for low in range(0, len(left), STRIP):
                    cells = kernel(left[low : low + STRIP], right)
                    for start in range(0, len(cells[0]), step):
                        some = [c[start : start + step].ravel() for c in cells]
                        at_a = np.arange(low + start, low + min(start + step, len(cells[0])), dtype=np.int32)
                        x, y = np.repeat(at_a, len(right)), np.tile(at_b, len(at_a))
                        turn = rank[x] > rank[y]
                        if within:
                            keep = rank[x] < rank[y]
                            x, y, some = x[keep], y[keep], [c[keep] for c in some]
                        else:
                            x, y = np.where(turn, y, x), np.where(turn, x, y)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), *map(pa.array, some)], schema=schema)

    return pairs.mapInArrow(run, "id_a string, id_b string, " + ", ".join(f"{n} double" for n in names))


def _alike(rows: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of like length together: their places, lengths, the rows padded with 0, and the sums of squares up to each place."""
    size = np.array([len(x) for x in rows])
    order, out, start = np.argsort(size, kind="stable"), [], 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and stop - start < BLOCK and size[order[stop]] <= 2 * size[order[start]] + 16 and size[order[stop]] * (stop + 1 - start) <= HELD:
            stop += 1
        at = order[start:stop]
        x = np.zeros((len(at), size[at[-1]]))
        for k, place in enumerate(at):
            x[k, : size[place]] = rows[place]
        sums = np.zeros((len(at), x.shape[1] + 1))
        np.cumsum(x * x, axis=1, out=sums[:, 1:])
        out.append((at, size[at], x, sums))
        start = stop
    return out


def _squares(left: list[np.ndarray], right: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of squared differences up to the shorter, as what the products leave of the squares; where that is little, or
    isn't a number, from the differences themselves."""
    out = np.zeros((len(left), len(right)))
    with np.errstate(over="ignore", invalid="ignore"):
        others = _alike(right)
        for at_a, size_a, x, sums_a in _alike(left):
            for at_b, size_b, y, sums_b in others:
                n = min(x.shape[1], y.shape[1])
                squares = sums_a[:, np.minimum(size_b, x.shape[1])] + sums_b[:, np.minimum(size_a, y.shape[1])].T
                s = squares - 2 * (x[:, :n] @ y[:, :n].T)
                for i, j in zip(*np.nonzero(~(s > squares / CLOSE)), strict=True):
                    k = min(size_a[i], size_b[j])
                    d = x[i, :k] - y[j, :k]
                    s[i, j] = d @ d
                out[np.ix_(at_a, at_b)] = s
    return [out]


def _distances(left: list[np.ndarray], right: list[np.ndarray]) -> list[np.ndarray]:
    return [np.sqrt(_squares(left, right)[0])]


def euclidean_distances(readings: DataFrame, part_rows: int = PART) -> DataFrame:
    """``id_a, id_b, distance`` of all pairs, aligned by position and cut to the shorter series. Two series of several parts
    are compared part by part, and the sums of squares added up; other pairs meet in their first part alone."""
    arrays = series_arrays(readings, part_rows=part_rows)
    far = materialise(arrays.where("part > 0").select("series_id").distinct().withColumn("far", F.lit(True)), "far")
    if is_small(far, 0):
        return pairwise(arrays, _distances, ["distance"], wide=True)
    marked = sized_join(arrays, far, "series_id", "left").withColumn("far", F.coalesce("far", F.lit(False)))
    first = pairwise(marked.where("part = 0"), _distances, ["distance"], wide=True)
    sums = pairwise(marked.where("far").drop("far"), _squares, ["s"])
    return first.unionByName(sums.groupBy("id_a", "id_b").agg(F.sqrt(F.sum("s")).alias("distance")))


def _standard(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of deviations from the mean with length one; NaN where a row is constant."""
    x = np.stack(rows)
    flat = x.max(axis=1) == x.min(axis=1)
    x = x - x.mean(axis=1, keepdims=True)
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.where(flat[:, None], np.nan, x / np.where(length == 0, 1.0, length))


def _pearson(left: list[np.ndarray], right: list[np.ndarray]) -> list[np.ndarray]:
    return [np.clip(_standard(left) @ _standard(right).T, -1.0, 1.0)]


def _products(left: list[np.ndarray], right: list[np.ndarray]) -> list[np.ndarray]:
    return [np.stack(left) @ np.stack(right).T]


def _ranks(x: np.ndarray) -> np.ndarray:
    """Mean ranks of tied values."""
    names, at, counts = np.unique(x, return_inverse=True, return_counts=True)
    upto = np.cumsum(counts)
    return (upto - (counts - 1) / 2)[at]


def correlation_matrix(readings: DataFrame, method: str = "pearson", part_rows: int = PART) -> DataFrame:
    """``id_a, id_b, correlation`` of all pairs, all series cut to the shortest; NaN where one is constant. For Pearson,
    series of several parts are standardised first, multiplied part by part and added up; ranks need a series whole."""
    name = method.lower()
    if name not in ("pearson", "spearman"):
        raise ValueError("the method is pearson or spearman")
    if name == "pearson":
        parts = series_arrays(readings, True, part_rows)
        if is_small(parts.where("part > 0"), 0):
            return pairwise(parts, _pearson, ["correlation"], wide=True)
        values = parts.select("series_id", F.explode("values").alias("v"))
        moments = values.groupBy("series_id").agg(
            F.avg("v").alias("m"), (F.stddev_pop("v") * F.sqrt(F.count("v"))).alias("s"), (F.min("v") == F.max("v")).alias("flat")
        )
        scale = F.when(F.col("flat"), F.lit(float("nan"))).otherwise(F.col("s"))
        joined = sized_join(parts, moments.select("series_id", "m", scale.alias("s")), "series_id")
        z = F.transform("values", lambda x: (x - F.col("m")) / F.col("s"))
        sums = pairwise(joined.select("series_id", "part", z.alias("values")), _products, ["c"], wide=True)
        r = F.greatest(F.least(F.sum("c"), F.lit(1.0)), F.lit(-1.0))
        return sums.groupBy("id_a", "id_b").agg(F.when(F.isnan(F.sum("c")), F.lit(float("nan"))).otherwise(r).alias("correlation"))
    arrays = series_arrays(readings, equal=True)
    return pairwise(arrays, _pearson, ["correlation"], wide=True, each=_ranks)


def cross_correlation(readings: DataFrame, lag_max: int | None = None) -> DataFrame:
    """``id_a, id_b, correlation``: of the normalised cross-correlations at all lags (up to ``lag_max`` either way) the
    one of greatest size; of two as great the positive. All series cut to the shortest; NaN where one is constant."""

    def kernel(left: list[np.ndarray], right: list[np.ndarray]) -> list[np.ndarray]:
        a, b = _standard(left), _standard(right)
        n = a.shape[1]
        reach = n - 1 if lag_max is None or lag_max < 0 or lag_max > n - 1 else lag_max
        low, high = np.full((len(a), len(b)), np.inf), np.full((len(a), len(b)), -np.inf)
        if reach < n - 1:
            for lag in range(-reach, reach + 1):
                c = a[:, max(0, lag) : n + min(0, lag)] @ b[:, max(0, -lag) : n - max(0, lag)].T
                low, high = np.minimum(low, c), np.maximum(high, c)
        else:  # all lags at once; over these the products sum to 0, so that places beyond them, which are 0, don't matter
            size = 1 << (2 * n - 1).bit_length()
            fa, fb = np.fft.rfft(a, size), np.conj(np.fft.rfft(b, size))
            step = max(1, SPECTRA // size)
            for i in range(len(a)):
                for j in range(0, len(b), step):
                    c = np.fft.irfft(fa[i] * fb[j : j + step], size)
                    low[i, j : j + step], high[i, j : j + step] = c.min(axis=1), c.max(axis=1)
        return [np.where(np.abs(low) > high + 1e-12, low, high)]

    return pairwise(series_arrays(readings, equal=True), kernel, ["correlation"])


def natural_key(text: Column) -> Column:
    """A key that orders texts with their digits taken as numbers: ``v2`` before ``v10``."""
    runs = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def padded(x: Column) -> Column:
        bare = F.ltrim(x, F.lit("0"))
        return F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare).cast("string"), 6, "0"), F.lit(" "), bare)).otherwise(x)

    keys = F.transform(runs, padded)
    return F.when(text.rlike("^[0-9]"), F.concat(F.array(F.lit("")), keys)).otherwise(keys)


def correlation_by_context(readings: DataFrame, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Correlations of variables within contexts, and their mean and variance over contexts.

    ``series`` has ``series_id, context, variable``. Gives ``context, var_a, var_b, id_a, id_b, correlation`` (pairs in
    natural order, the same variable too), and per pair ``var_a, var_b, mean_correlation, variance, contexts``
    over the contexts where the correlation is defined (NaN where none). Series are aligned by position and cut to the
    shorter; a constant series has no correlation (NaN). Series without context or variable, and contexts with one
    series, are left out; two series of one variable in a context are a ValueError. Readings meet within a context and
    position, at most one per variable.
    """
    known = series.where(F.col("context").isNotNull() & F.col("variable").isNotNull()).select("series_id", "context", "variable")
    if known.groupBy("context", "variable").count().where("count > 1").limit(1).count():
        raise ValueError("a context has two series of one variable")
    several = known.groupBy("context").count().where("count > 1").select("context")
    chosen = known.join(several, "context", "left_semi")
    rows = ordinal(laid_out(readings)).select("series_id", "idx", "v").join(chosen, "series_id")
    a = rows.select("context", "idx", F.col("series_id").alias("id_a"), F.col("variable").alias("var_a"), F.col("v").alias("x"))
    b = rows.select("context", "idx", F.col("series_id").alias("id_b"), F.col("variable").alias("var_b"), F.col("v").alias("y"))
    in_order = F.struct(natural_key(F.col("var_a")), F.col("var_a")) <= F.struct(natural_key(F.col("var_b")), F.col("var_b"))
    met = a.join(b, ["context", "idx"]).where(in_order)
    moments = met.groupBy("context", "var_a", "var_b", "id_a", "id_b").agg(
        F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"),
        (F.min("x") == F.max("x")).alias("flat_x"), (F.min("y") == F.max("y")).alias("flat_y"),
    )
    r = F.coalesce(F.when(~(F.col("flat_x") | F.col("flat_y")), F.try_divide("c", F.col("sx") * F.col("sy"))), F.lit(float("nan")))
    each = moments.select("context", "var_a", "var_b", "id_a", "id_b", r.alias("correlation"))
    defined = F.when(~F.isnan("correlation"), F.col("correlation"))
    summary = each.groupBy("var_a", "var_b").agg(
        F.coalesce(F.avg(defined), F.lit(float("nan"))).alias("mean_correlation"),
        F.coalesce(F.var_pop(defined), F.lit(float("nan"))).alias("variance"),
        F.count(defined).alias("contexts"),
    )
    return each, summary


def context_profiles(each: DataFrame, digits: int = 4) -> DataFrame:
    """Per pair of variables ``var_a, var_b, profile``: JSON of the contexts in natural order with the rounded correlation
    (``"NaN"`` where undefined) and the two series."""
    shown = F.when(F.isnan("correlation"), F.lit("NaN")).otherwise(F.round("correlation", digits).cast("string"))
    entry = F.struct(natural_key(F.col("context")).alias("key"), F.struct("context", shown.alias("correlation"), "id_a", "id_b").alias("entry"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["entry"])
    return each.groupBy("var_a", "var_b").agg(F.to_json(listed).alias("profile"))


def _link() -> Column:
    """What a pair of variables is referred to by."""
    return F.md5(F.concat_ws("\u0000", "var_a", "var_b"))


def correlation_documents(each: DataFrame, label: str = "context", digits: int = 4) -> DataFrame:
    """Per pair of variables ``link, var_a, var_b, document``: JSON with ``variables``, ``x_value`` (the contexts in natural
    order), ``y_values`` (the rounded correlations, null where undefined) and ``ts_lists`` (the pairs of series)."""
    r = F.when(~F.isnan("correlation"), F.round("correlation", digits))
    entry = F.struct(natural_key(F.col("context")).alias("key"), F.col("context").alias("x"), r.alias("y"), F.array("id_a", "id_b").alias("ids"))
    pairs = each.groupBy("var_a", "var_b").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    of = lambda name: F.transform("rows", lambda x: x[name])
    document = F.to_json(F.struct(
        F.array("var_a", "var_b").alias("variables"),
        F.struct(F.struct(F.lit(label).alias("label")).alias("desc"), of("x").alias("data")).alias("x_value"),
        F.array(F.struct(F.struct(F.lit("Pearson correlation").alias("label")).alias("desc"), of("y").alias("data"))).alias("y_values"),
        of("ids").alias("ts_lists"),
    ))
    return pairs.select(_link().alias("link"), "var_a", "var_b", document.alias("document"))


def correlation_dataset(each: DataFrame, summary: DataFrame, label: str = "context") -> DataFrame:
    """One row ``document``: JSON with the ``variables`` in natural order, the ``context`` (its name and how many there are)
    and three triangular ``matrices``, whose row i holds the cells from the diagonal on: mean correlations (1.0 on the
    diagonal where undefined), variances (0.0 there) and the links of ``correlation_documents``. Undefined cells are null."""
    contexts = each.agg(F.count_distinct("context")).first()[0]
    cell = F.struct(
        F.concat_ws("\u0000", "var_a", "var_b").alias("key"), F.struct(F.nanvl("mean_correlation", F.lit(None)).alias("mean"), F.nanvl("variance", F.lit(None)).alias("variance"), _link().alias("link"))
    )
    whole = summary.agg(F.collect_set("var_a").alias("a"), F.collect_set("var_b").alias("b"), F.map_from_entries(F.collect_list(cell)).alias("cells"))
    keyed = F.transform(F.array_union("a", "b"), lambda x: F.struct(natural_key(x).alias("key"), x.alias("name")))
    named = whole.select("cells", F.transform(F.array_sort(keyed), lambda x: x["name"]).alias("variables"))

    def triangle(field: str, diagonal: float | None) -> Column:
        def at(a: Column, b: Column) -> Column:
            found = F.try_element_at("cells", F.concat_ws("\u0000", a, b))[field]
            return found if diagonal is None else F.coalesce(found, F.when(a == b, F.lit(diagonal)))

        rest = lambda a: F.slice("variables", F.array_position("variables", a).cast("int"), F.size("variables"))
        return F.transform("variables", lambda a: F.transform(rest(a), lambda b: at(a, b)))

    def matrix(desc: Column, data: Column) -> Column:
        return F.to_json(F.struct(desc.alias("desc"), data.alias("data")))

    matrices = F.concat_ws(
        ",", matrix(F.struct(F.lit("Mean Correlation").alias("label")), triangle("mean", 1.0)), matrix(F.struct(F.lit("Variance").alias("label")), triangle("variance", 0.0)),
        matrix(F.struct(F.lit(True).alias("is_rid_link")), triangle("link", None)),
    )
    about = F.struct(F.lit(label).alias("identifier"), F.lit(contexts).alias("number_of_contexts"), F.lit(label).alias("label"))
    document = F.concat(F.lit('{"variables":'), F.to_json("variables"), F.lit(',"context":'), F.to_json(about), F.lit(',"matrices":['), matrices, F.lit("]}"))
    return named.select(document.alias("document"))


__all__ = [
    "context_profiles", "correlation_by_context", "correlation_dataset", "correlation_documents", "correlation_matrix", "cross_correlation", "euclidean_distances", "natural_key", "pairwise", "series_arrays",
]
