"""The most similar vectors of every query vector, whatever level and gain.

A vector becomes its deviations from its mean, scaled to length one, so that the Pearson correlation r of two is their
dot product and their squared distance d2 = 2 (1 - r). Gaussian (2-stable) projections to a few dimensions keep distances in
law: the projected squared distance over d2 is chi-square with as many degrees of freedom as dimensions. The rows are
laid out in cells of a kd-tree over the projections; inside a cell a kd-tree gives the projected neighbours of a
query in growing distance, each is verified by its true similarity, and the search stops once the next projected
distance is so large that a closer row would lie beyond it only with probability ``1 - sure``.

A query first searches the cell it lies in, which holds most of its neighbours; the similarity of the k-th found there
bounds the ball that the others must lie in, and only the cells which that ball reaches are searched in a second round.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidemill.functions.joins import sized_join
from tidemill.sources.scratch import materialise

UNIT = ArrayType(DoubleType())
DIMENSIONS = 12
SURE = 0.9999
#: Rows a cell is planned for. Beyond ``MOST_CELLS`` cells they grow instead, as a query is copied to each it reaches, up to
#: ``LARGEST_CELL`` rows, what a task holds well; beyond that there are more cells again. A cell larger than planned, as of
#: copies that no plane divides, is split by a hash of the id, and each part is searched.
CELL_ROWS = 8192
MOST_CELLS = 4096
LARGEST_CELL = 262_144
#: Rows the cells are fitted on, at least, and per cell. Of these only the projections are collected; every row is indexed.
SAMPLE_ROWS = 4096
SAMPLE_OF_CELL = 16
LEAF_ROWS = 256
#: Similarities count to this many decimals; ties go to the smaller id.
DECIMALS = 6
SLACK = 2e-6


def chi_square_quantile(p: float, df: int) -> float:
    """Inverse of the chi-square distribution, by bisection on its regularised gamma series."""
    from math import exp, lgamma, log

    a = df / 2

    def below(x: float) -> float:
        if x <= 0:
            return 0.0
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / 2 / n
            total += term
        return total * exp(-x / 2 + a * log(x / 2) - lgamma(a))

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


@lru_cache(maxsize=4)
def directions(width: int, dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dimensions))


def unit_rows(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Standardised rows of the lists of exactly ``width`` finite values that aren't constant, and their positions."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fit = np.flatnonzero(sizes == width)
    values = lists.take(pa.array(fit)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(fit), width)
    sound = np.isfinite(values).all(axis=1)
    sound[sound] = values[sound].max(axis=1) > values[sound].min(axis=1)
    values, fit = values[sound], fit[sound]
    # first to size one, so that squares neither vanish nor overflow
    peak = np.abs(values).max(axis=1, keepdims=True) if len(values) else np.ones((0, 1))
    values = values / np.where(peak > 0, peak, 1.0)
    values = values - values.mean(axis=1, keepdims=True)
    length = np.sqrt((values * values).sum(axis=1, keepdims=True))
    whole = length[:, 0] > 0
    return values[whole] / length[whole], fit[whole]


class Cells:
    """A kd-tree over projected sample rows; its leaves tile the space."""

    def __init__(self, sample: np.ndarray, count: int) -> None:
        self.dimensions = sample.shape[1] if sample.size else DIMENSIONS
        self.axis, self.cut, self.child = [-1], [0.0], [(-1, -1)]
        parts = {0: np.arange(len(sample))}
        largest = [(-len(sample), 0)]
        while len(parts) < count and largest:
            _, node = heapq.heappop(largest)
            rows = sample[parts[node]]
            spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) > 1 else np.zeros(self.dimensions)
            axis = int(spread.argmax()) if len(rows) > 1 else 0
            if len(rows) < 8 or spread[axis] <= 0:
                continue
            cut = float(np.median(rows[:, axis]))
            if (rows[:, axis] < cut).sum() == 0:
                cut = float(rows[:, axis][rows[:, axis] > cut].min())
            left, right = len(self.axis), len(self.axis) + 1
            self.axis[node], self.cut[node], self.child[node] = axis, cut, (left, right)
            self.axis += [-1, -1]
            self.cut += [0.0, 0.0]
            self.child += [(-1, -1), (-1, -1)]
            inside = rows[:, axis] < cut
            members = parts.pop(node)
            for side, own in ((left, members[inside]), (right, members[~inside])):
                parts[side] = own
                heapq.heappush(largest, (-len(own), side))
        self.nodes = sorted(parts)
        self.number = {n: i for i, n in enumerate(self.nodes)}
        self.share = np.array([len(parts[n]) for n in self.nodes]) / max(1, len(sample))

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        out = np.zeros(len(rows), dtype=np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if self.axis[node] < 0:
                out[at] = self.number[node]
                continue
            less = rows[at, self.axis[node]] < self.cut[node]
            todo += [(self.child[node][0], at[less]), (self.child[node][1], at[~less])]
        return out

    def reached(self, rows: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the cells whose box lies within their squared distance ``limit``: down the tree as far as boxes do. On
        the way the distance grows by what a plane adds to the one crossed before on its axis."""
        who, cell = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(0, np.arange(len(rows)), np.zeros(len(rows)), {})]
        while todo:
            node, at, far, gaps = todo.pop()
            if self.axis[node] < 0:
                who.append(at)
                cell.append(np.full(len(at), self.number[node], dtype=np.int64))
                continue
            axis = self.axis[node]
            off = rows[at, axis] - self.cut[node]
            known = gaps.get(axis, np.zeros(len(at)))
            for side, beyond in zip(self.child[node], (np.maximum(off, 0.0), np.maximum(-off, 0.0)), strict=True):
                gap = np.maximum(known, beyond)
                now = far + gap * gap - known * known
                keep = now <= limit[at] + 1e-9
                if keep.any():
                    todo.append((side, at[keep], now[keep], {k: x[keep] for k, x in gaps.items()} | {axis: gap[keep]}))
        return np.concatenate(who), np.concatenate(cell)


def squared_gap(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each box."""
    total = np.zeros((len(rows), len(low)))
    for j in range(rows.shape[1]):
        x = rows[:, j : j + 1]
        gap = np.maximum(np.maximum(low[:, j] - x, x - high[:, j]), 0.0)
        total += gap * gap
    return total


class Tree:
    """A kd-tree with its rows in leaf order and tight boxes around the leaves."""

    def __init__(self, rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        leaves, todo = [], [np.arange(len(rows))]
        while todo:
            at = todo.pop()
            spread = rows[at].max(axis=0) - rows[at].min(axis=0)
            if len(at) <= leaf_rows or spread.max() <= 0:
                leaves.append(at)
                continue
            along = rows[at, int(spread.argmax())]
            middle = np.argpartition(along, len(at) // 2)
            todo += [at[middle[len(at) // 2 :]], at[middle[: len(at) // 2]]]
        self.order = np.concatenate(leaves) if leaves else np.zeros(0, dtype=np.int64)
        self.ends = np.cumsum([len(x) for x in leaves])
        self.begins = self.ends - [len(x) for x in leaves]
        self.low = np.stack([rows[x].min(axis=0) for x in leaves])
        self.high = np.stack([rows[x].max(axis=0) for x in leaves])


def _better(q: np.ndarray, s: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query: greatest similarity, then smallest id."""
    by = np.lexsort((i, -s, q))
    begin = np.flatnonzero(np.concatenate([[True], np.diff(q[by]) != 0])) if len(by) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(by)) - np.repeat(begin, np.diff(np.append(begin, len(by))))
    return by[place < k]


def search(
    queries: np.ndarray, query_points: np.ndarray, bound: np.ndarray, rows: np.ndarray, points: np.ndarray, ids: np.ndarray,
    k: int, quantile: float, floor: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k most similar rows of each query among those of similarity ``floor`` or more: positions of queries, ids
    and similarities. ``bound`` is a squared distance that the k-th neighbour of a query is known not to exceed."""
    tree = Tree(points)
    rows, points, ids = rows[tree.order], points[tree.order], ids[tree.order]
    gap = squared_gap(query_points, tree.low, tree.high)
    turn = np.argsort(gap, axis=1, kind="stable")
    bound = bound.copy()
    best_q, best_s, best_i = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=ids.dtype)
    row_norm = (points * points).sum(axis=1)
    query_norm = (query_points * query_points).sum(axis=1)
    open_ = np.arange(len(queries))
    for step in range(len(tree.begins)):
        leaf_of = turn[open_, step]
        # the stopping test: no row left is projected close enough
        going = gap[open_, leaf_of] <= bound[open_] * quantile
        open_, leaf_of = open_[going], leaf_of[going]
        if not len(open_):
            break
        new_q, new_s, new_i = [best_q], [best_s], [best_i]
        by = np.argsort(leaf_of, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(leaf_of[by])) + 1):
            leaf, who = leaf_of[part[0]], open_[part]
            at = slice(tree.begins[leaf], tree.ends[leaf])
            distance = query_norm[who, None] + row_norm[None, at] - 2 * (query_points[who] @ points[at].T)
            near_q, near_r = np.nonzero(distance <= (bound[who] * quantile + 1e-9)[:, None])
            if not len(near_q):
                continue
            if len(near_q) * 30 > distance.size:
                s = (queries[who] @ rows[at].T)[near_q, near_r]
            else:
                s = np.einsum("ij,ij->i", queries[who[near_q]], rows[at][near_r])
            s = np.round(s, DECIMALS)
            good = (s >= floor) & (2 * (1 - s) <= bound[who[near_q]] + SLACK)
            new_q.append(who[near_q[good]])
            new_s.append(s[good])
            new_i.append(ids[at][near_r[good]])
        if len(new_q) > 1:
            best_q, best_s, best_i = (np.concatenate(x) for x in (new_q, new_s, new_i))
            keep = _better(best_q, best_s, best_i, k)
            best_q, best_s, best_i = best_q[keep], best_s[keep], best_i[keep]
            count = np.bincount(best_q, minlength=len(queries))
            last = np.cumsum(count) - 1
            full = np.flatnonzero(count == k)
            bound[full] = np.minimum(bound[full], 2 * (1 - best_s[last[full]]) + SLACK)
    return best_q, best_i, best_s


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    offsets = pa.array(np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)


def most_similar(
    queries: DataFrame, base: DataFrame, query_id: str, query_vector: str, base_id: str, base_vector: str, width: int, k: int = 5,
    min_similarity: float = -1.0, dimensions: int = DIMENSIONS, sure: float = SURE, cell_rows: int = CELL_ROWS,
    sample_rows: int = SAMPLE_ROWS, seed: int = 11,
) -> DataFrame:
    """``query_id, base_id, similarity, place``: of each query the k most similar rows with at least ``min_similarity``.

    Similarity is the Pearson correlation to 6 decimals; ties go to the smaller id. Vectors that are NULL, of another
    length, constant, or hold NULL, NaN or an infinity take no part, nor do rows without id. Repeated rows count each. A
    neighbour is missed with probability at most ``1 - sure``. The sample only shapes cells; every row is searched. A cell too
    large for one task is split by a hash of the id, so many copies of one vector don't meet in one task.
    """
    quantile = chi_square_quantile(sure, dimensions)
    floor = max(-1.0, min_similarity)
    widest = 2 * (1 - floor) + SLACK
    rows = base.select(base_id, base_vector).where(F.col(base_id).isNotNull() & (F.size(base_vector) == width))
    total = rows.count()
    wanted = max(1, min(-(-total // cell_rows), MOST_CELLS), -(-total // LARGEST_CELL))
    planned = -(-total // wanted)
    lines = directions(width, dimensions, seed)
    cells = Cells(_projected(rows.select(base_vector), total, max(sample_rows, SAMPLE_OF_CELL * wanted), width, lines, seed), wanted)
    parts = np.maximum(1, np.ceil(cells.share * total / (2 * max(planned, cell_rows)))).astype(np.int64)
    schema = base.select(base_id).schema

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, at = unit_rows(batch.column(1), width)
            taken = batch.take(pa.array(at))
            cell = cells.of(unit @ lines)
            part = taken.column(2).to_numpy(zero_copy_only=False) % parts[cell]
            yield pa.RecordBatch.from_arrays(
                [taken.column(0), pa.array(cell), pa.array(part), _lists(unit)], [base_id, "cell", "part", "unit"]
            )

    def send(home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit, at = unit_rows(batch.column(1), width)
                if not len(unit):
                    continue
                bound = batch.column(2).to_numpy(zero_copy_only=False)[at]
                own = cells.of(unit @ lines)
                if home:
                    who, cell = np.arange(len(unit)), own
                else:
                    who, cell = cells.reached(unit @ lines, bound * quantile)
                    who, cell = who[cell != own[who]], cell[cell != own[who]]
                times = parts[cell]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                who, cell = np.repeat(who, times), np.repeat(cell, times)
                names = batch.column(0).take(pa.array(at))
                for low in range(0, len(who), 20_000):
                    w = who[low : low + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(w)), pa.array(cell[low : low + 20_000]), pa.array(part[low : low + 20_000]), pa.array(bound[w]), _lists(unit[w])],
                        [query_id, "cell", "part", "bound", "unit"],
                    )

        return run

    hashed = rows.withColumn("h", F.pmod(F.xxhash64(base_id), F.lit(1 << 40)))
    laid = hashed.mapInArrow(
        lay_out, rows.select(base_id).schema.add("cell", "long").add("part", "long").add("unit", UNIT)
    )
    asked = queries.select(query_id, query_vector).where(F.col(query_id).isNotNull() & (F.size(query_vector) == width))
    sent_schema = asked.select(query_id).schema.add("cell", "long").add("part", "long").add("bound", "double").add("unit", UNIT)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            q, i, s = np.zeros(0, dtype=np.int64), None, np.zeros(0)
            ids = right.column(base_id).slice(0, 0)
        else:
            ask, unit = _matrix(left.column("unit"), width), _matrix(right.column("unit"), width)
            place = np.arange(right.num_rows)
            order = np.asarray(pa.compute.sort_indices(right.column(base_id)))
            place[order] = np.arange(right.num_rows)  # ids as ranks, so that any type of id can be ordered
            q, i, s = search(ask, ask @ lines, left.column("bound").to_numpy(), unit, unit @ lines, place, k, quantile, floor)
            ids = right.column(base_id).take(pa.array(order[i]))
        return pa.Table.from_arrays([left.column(query_id).take(pa.array(q)), ids, pa.array(s)], [query_id, base_id, "similarity"])

    def found(asking: DataFrame, home: bool) -> DataFrame:
        sent = asking.select(query_id, query_vector, "bound").mapInArrow(send(home), sent_schema)
        both = sent.groupBy("cell", "part").cogroup(laid.groupBy("cell", "part"))
        return both.applyInArrow(meet, asked.select(query_id).schema.add(schema[0]).add("similarity", "double"))

    best = Window.partitionBy(query_id).orderBy(F.col("similarity").desc(), F.col(base_id))
    placed = lambda x: x.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    near = materialise(placed(found(asked.withColumn("bound", F.lit(widest)), True)), "near")
    if wanted == 1:
        return near
    known = near.where(F.col("place") == k).select(query_id, (2 * (1 - F.col("similarity")) + SLACK).alias("kth"))
    bound = F.least(F.coalesce("kth", F.lit(widest)), F.lit(widest))
    further = found(sized_join(asked, known, query_id, "left").withColumn("bound", bound), False)
    return placed(near.drop("place").unionByName(further))


def _projected(vectors: DataFrame, total: int, size: int, width: int, lines: np.ndarray, seed: int) -> np.ndarray:
    """The projections of about ``size`` rows, drawn at random; only these come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = unit_rows(batch.column(0), width)[0] @ lines
            yield pa.RecordBatch.from_arrays([_lists(points)], ["point"])

    drawn = vectors.sample(min(1.0, 1.3 * size / max(1, total)), seed=seed).mapInArrow(run, "point array<double>").limit(size).toArrow()
    return _matrix(drawn.column(0), lines.shape[1]) if drawn.num_rows else np.zeros((0, lines.shape[1]))
