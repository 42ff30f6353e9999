"""Where a pattern occurs in series: Manhattan, DTW or FastDTW distance of sliding windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.batches import whole_groups
from tidemill.operators.readings import join_by_series, laid_out, ordinal, window_blocks, window_starts

# Per normalisation, whether the pattern is centred and scaled, and whether each window is.
NORMALISATIONS = {
    "NO_NORM": (False, False, False, False),
    "MEAN_VARIANCE": (True, True, True, True),
    "MEAN_VARIANCE_ONLY_SEARCH": (False, False, True, True),
    "MEAN": (True, False, True, False),
    "MEAN_ONLY_SEARCH": (False, False, True, False),
    "VARIANCE": (False, True, False, True),
    "VARIANCE_ONLY_SEARCH": (False, False, False, True),
}
DISTANCES = ("MANHATTAN", "DTW", "FAST_DTW")
PATTERN_LIMIT = 5000
FAST_RADIUS = 2
#: Cells of cost that are held at a time.
CELLS = 4_000_000
#: Windows that are warped at a time.
WARPED = 512


def scaled(x: np.ndarray, centre: bool, spread: bool) -> np.ndarray:
    """Along the last axis: centred, and divided by the population deviation (1 where that is 0)."""
    dev = x.std(axis=-1, keepdims=True)
    y = x - x.mean(axis=-1, keepdims=True) if centre else x
    return y / np.where(dev == 0, 1.0, dev) if spread else y


def dtw(x: np.ndarray, y: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Dynamic time warping, with absolute differences, of each row of ``x`` against ``y``: the costs, and the cells of
    the paths as a mask (rows, length of x, length of y). Only ``allowed`` cells are used, if given. All rows go forward
    one diagonal at a time; ties prefer a step in x, then in y, then in both."""
    rows, n = x.shape
    m = len(y)
    cost = np.full((rows, n + 1, m + 1), np.inf)
    cost[:, 0, 0] = 0.0
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        j = d - i
        before = np.minimum(np.minimum(cost[:, i, j + 1], cost[:, i + 1, j]), cost[:, i, j])
        gap = np.abs(x[:, i] - y[j])
        if allowed is not None:
            gap = np.where(allowed[:, i, j], gap, np.inf)
        cost[:, i + 1, j + 1] = gap + before
    path = np.zeros((rows, n, m), dtype=bool)
    at, i, j = np.arange(rows), np.full(rows, n), np.full(rows, m)
    while len(at):
        path[at, i - 1, j - 1] = True
        step = np.argmin(np.stack([cost[at, i - 1, j], cost[at, i, j - 1], cost[at, i - 1, j - 1]]), axis=0)
        i, j = i - (step != 1), j - (step != 0)
        on = (i > 0) & (j > 0)
        at, i, j = at[on], i[on], j[on]
    return cost[:, n, m], path


def fast_dtw(x: np.ndarray, y: np.ndarray, radius: int = FAST_RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Warping found on halved series and refined within ``radius`` cells of the path found there; exact for short
    series. Costs and path cells as for ``dtw``."""
    (rows, n), m = x.shape, len(y)
    if min(n, m) < radius + 2:
        return dtw(x, y)
    half = lambda z: (z[..., : z.shape[-1] // 2 * 2 : 2] + z[..., 1 : z.shape[-1] // 2 * 2 : 2]) / 2
    _, coarse = fast_dtw(half(x), half(y), radius)
    near = np.pad(coarse, ((0, 0), (radius, 2 * radius), (radius, 2 * radius)))
    tall, wide = coarse.shape[1] + radius, coarse.shape[2] + radius
    around = np.zeros((rows, tall, wide), dtype=bool)
    for a in range(2 * radius + 1):
        for b in range(2 * radius + 1):
            around |= near[:, a : a + tall, b : b + wide]
    allowed = np.repeat(np.repeat(around, 2, axis=1), 2, axis=2)[:, :n, :m]
    return dtw(x, y, allowed)


def matched(path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each window that is aligned: without all but the last of the leading readings on the pattern's first
    value, and likewise at the end."""
    return path[:, :, 0].sum(axis=1) - 1, path.shape[1] - path[:, :, -1].sum(axis=1)


def warped(x: np.ndarray, y: np.ndarray, spans: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The costs of ``dtw`` and what ``matched`` gives for its paths. Holds three diagonals: the path's last place on the
    first value and its first place on the last value are carried along, with the same ties, unless without ``spans``."""
    (rows, n), m = x.shape, len(y)
    across, back = np.ascontiguousarray(x.T), np.ascontiguousarray(y[::-1])[:, None]
    costs = [np.full((n + 1, rows), np.inf) for _ in range(3)]
    left_at = [np.zeros((n + 1, rows), np.int16) for _ in range(3 if spans else 0)]
    gaps, end = np.empty((n, rows)), np.zeros(rows, np.int16)
    costs[0][1] = np.abs(across[0] - y[0])
    for d in range(1, n + m - 1):
        a, b = max(0, d - m + 1), min(n, d + 1)
        now, one, two = (costs[(d - k) % 3] for k in range(3))
        up, left, both = one[a:b], one[a + 1 : b + 1], two[a:b]
        gap, out = gaps[: b - a], now[a + 1 : b + 1]
        if spans:
            at, at_one, at_two = (left_at[(d - k) % 3] for k in range(3))
            in_x = up <= np.minimum(left, both)
            at[a + 1 : b + 1] = np.where(in_x, at_one[a:b], np.where(left <= both, at_one[a + 1 : b + 1], at_two[a:b]))
            if b == d + 1:
                at[b] = d
            if a == d - m + 1:
                end = np.where(in_x[0], end, np.int16(a))
        np.subtract(across[a:b], back[m - 1 - d + a : m - 1 - d + b], out=gap)
        np.abs(gap, out=gap)
        np.minimum(left, both, out=out)
        np.minimum(up, out, out=out)
        np.add(gap, out, out=out)
    last = (n + m - 2) % 3
    begin = left_at[last][n].astype(np.int64) if spans else np.zeros(rows, np.int64)
    return costs[last][n], begin, end.astype(np.int64)


def _greedy(score: np.ndarray, rank: np.ndarray, size: int, stride: int, limit: int) -> list[int]:
    """Places of the best windows that share no reading with a better one taken, at most ``limit``."""
    taken: list[int] = []
    for k in np.lexsort((rank, score)):
        if all(abs(rank[k] - rank[o]) * stride >= size for o in taken):
            taken.append(int(k))
            if len(taken) == limit:
                break
    return taken


def _ceiling(score: np.ndarray, rank: np.ndarray, size: int, stride: int, limit: int) -> float:
    """A score above which none of these windows is among a series' best ``limit`` apart. Each of the at most ``limit - 1``
    better ones taken overlaps at most two of ``2 * limit - 1`` windows apart, so that one of these would come first."""
    taken = _greedy(score, rank, size, stride, 2 * limit - 1)
    return float(score[taken[-1]]) if len(taken) == 2 * limit - 1 else np.inf


def _blocks(readings: DataFrame, size: int, stride: int) -> tuple[DataFrame, int]:
    """Series of at least five windows in blocks of windows."""
    laid = laid_out(readings)
    lengths = laid.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 5 * size)
    rows = join_by_series(ordinal(laid), lengths.select("series_id"), readings)
    return window_blocks(rows.select("series_id", "idx", "t", "v"), size, stride)


def _apart(scores: DataFrame, size: int, stride: int, limit: int) -> DataFrame:
    """The best windows of each series that share no reading with a better one taken, at most ``limit``. Reads each
    series as a sorted stream and holds the ranks taken."""
    rows = scores.repartition("series_id").sortWithinPartitions("series_id", "score", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, taken = None, []
        for batch in batches:
            chosen = []
            for k, (series, rank) in enumerate(zip(batch.column("series_id").to_pylist(), batch.column("rank").to_pylist(), strict=True)):
                if series != name:
                    name, taken = series, []
                if len(taken) < limit and all(abs(rank - other) * stride >= size for other in taken):
                    taken.append(rank)
                    chosen.append(k)
            yield batch.take(pa.array(chosen, pa.int64()))

    return rows.mapInArrow(run, scores.schema)


def find_pattern(
    readings: DataFrame, pattern: list[float], distance: str = "MANHATTAN", rate_sliding: float = 1.0, rate_size_window: float = 1.0,
    normalisation: str = "MEAN_VARIANCE", limit: int | None = None,
) -> DataFrame:
    """``series_id, rank, start_t, end_t, score``: windows of each series, scored against the pattern; with ``limit``
    the best of each series only that don't overlap (ties: the earlier).

    A window holds ``ceil(m * rate_size_window)`` readings of a pattern of m, windows start ``ceil(m * rate_sliding)``
    apart, with ``1 / m`` at every reading; an occurrence off that grid is met by halves only. Manhattan compares the
    first m and takes windows of m. Windows are normalised each. Series shorter than five windows give none.
    """
    m = len(pattern)
    if not 2 <= m <= PATTERN_LIMIT:
        raise ValueError(f"a pattern has from 2 to {PATTERN_LIMIT} values")
    if distance not in DISTANCES or normalisation not in NORMALISATIONS:
        raise ValueError("unknown distance or normalisation")
    if rate_sliding <= 0 or rate_size_window < 1:
        raise ValueError("the rate of sliding must be above 0, that of the window at least 1")
    size = m if distance == "MANHATTAN" else math.ceil(m * rate_size_window)
    stride = math.ceil(round(m * rate_sliding, 9))
    centre, spread, own_centre, own_spread = NORMALISATIONS[normalisation]
    target = scaled(np.asarray(pattern, dtype=float), centre, spread)
    blocks, each = _blocks(readings, size, stride)

    def score_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = scaled(x, own_centre, own_spread)
        if distance == "MANHATTAN":
            return np.abs(z - target).sum(axis=1), np.zeros(len(z), np.int64), np.full(len(z), size - 1)
        if distance == "DTW":
            return warped(z, target)
        score, path = fast_dtw(z, target)
        return score, *matched(path)

    step = max(1, min(CELLS if distance == "FAST_DTW" else WARPED, CELLS // (size * m)))

    def scored(v: np.ndarray, start: np.ndarray, how: Callable, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.zeros(len(start)), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        for low in range(0, len(start), step):
            part = slice(low, low + step)
            for to, what in zip(out, how(v[start[part, None] + np.arange(size)]), strict=True):
                to[part] = what
        return out

    def candidates(v: np.ndarray, start: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Of a block's windows the places that can be among the best. FastDTW costs no less than
        DTW, so it is found in the order of DTW as far as that stays below the ceiling."""
        cheap = scored(v, start, lambda x: warped(scaled(x, own_centre, own_spread), target, False), max(1, min(WARPED, CELLS // (size * m))))[0]
        if distance == "DTW":
            return np.flatnonzero(cheap <= _ceiling(cheap, rank, size, stride, limit))
        order, apart = np.lexsort((rank, cheap)), _greedy(cheap, rank, size, stride, 2 * limit - 1)
        ceiling = _ceiling(scored(v, start[apart], score_of, step)[0], rank[apart], size, stride, limit)
        found, done, batch = np.full(len(start), np.inf), 0, 64
        while done < len(order) and cheap[order[done]] <= ceiling + 1e-9:
            some = order[done : done + batch]
            found[some] = scored(v, start[some], score_of, step)[0]
            done += len(some)
            ceiling = min(ceiling, _ceiling(found[order[:done]], rank[order[:done]], size, stride, limit))
        return np.flatnonzero(np.isfinite(found) & (found <= ceiling))

    def kernel(table: pa.Table, first: np.ndarray) -> pa.Table:
        t, v, idx, block = (table.column(c).to_numpy() for c in ("t", "v", "idx", "block"))
        start, rank = window_starts(first, idx, block, each, size, stride)
        if limit and distance != "MANHATTAN" and len(rank):
            cuts = np.flatnonzero(np.diff(np.cumsum(first)[start]))  # a block at a time
            kept = [part[candidates(v, start[part], rank[part])] for part in np.split(np.arange(len(rank)), cuts + 1)]
            start, rank = start[np.concatenate(kept)], rank[np.concatenate(kept)]
        score, begin, end = scored(v, start, score_of, step)
        return pa.table({
            "series_id": table.column("series_id").take(pa.array(start)), "rank": pa.array(rank, pa.int64()),
            "start_t": pa.array(t[start + begin], pa.int64()), "end_t": pa.array(t[start + end], pa.int64()), "score": pa.array(score),
        })

    scores = blocks.mapInArrow(whole_groups(["series_id", "block"], kernel, 20_000), "series_id string, rank long, start_t long, end_t long, score double")
    return scores if limit is None else _apart(scores, size, stride, limit)
