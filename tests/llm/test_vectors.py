"""Neighbours, clusters and sketches against exact results."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import clusters, neighbours, quantiles
from tidemill.operators.readings import DAY_MS, valid_readings


# ---- neighbours
def standard(x):
    x = x - x.mean(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("p", "df", "want"), [(0.95, 1, 3.841), (0.5, 2, 1.386), (0.9999, 12, 39.134), (0.99, 30, 50.892)])
def test_chi_square(p, df, want):
    assert math.isclose(neighbours.chi_square_quantile(p, df), want, rel_tol=1e-3)


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(5)
    shapes = rng.normal(size=(12, 16)).cumsum(axis=1)
    base = [(k, list(shapes[k % 12] * rng.uniform(0.5, 3) + rng.normal(0, 0.4, 16) + rng.normal(0, 50))) for k in range(600)]
    base += [(1000 + k, base[7][1]) for k in range(300)]  # a third are copies
    base += [(5000, None), (5001, [1.0] * 16), (5002, [1.0] * 15), (5003, [float("nan")] + [1.0] * 15), (5004, [None] + [2.0] * 15), (5005, []), (5006, [float("inf")] + [0.0] * 15), (None, base[0][1])]
    asked = [(k, list(shapes[k % 12] + rng.normal(0, 0.3, 16))) for k in range(40)] + [(50, None), (51, [3.0] * 16), (52, base[7][1]), (None, base[1][1])]
    floats = lambda v: None if v is None else [None if y is None else float(y) for y in v]
    base, asked = [(i, floats(v)) for i, v in base], [(i, floats(v)) for i, v in asked]
    b = spark.createDataFrame([(i, v, 1, "x") for i, v in base], "seq_id long, np_values array<double>, cell int, unit string")
    q = spark.createDataFrame([(i, v, 2) for i, v in asked], "pattern_id long, vector array<double>, bound int")
    return b, q, base, asked


def exact(base, asked, k, least):
    rows = [(i, v) for i, v in base if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and min(v) < max(v)]
    ids, x = np.array([i for i, _ in rows]), standard(np.array([v for _, v in rows]))
    out = {}
    for i, v in asked:
        if i is None or v is None or min(v) == max(v):
            continue
        r = np.round(x @ standard(np.array([v]))[0], 6)
        for place, j in enumerate(np.lexsort((ids, -r))[:k]):
            if r[j] >= least:
                out[i, int(ids[j])] = (float(r[j]), place + 1)
    return out


@pytest.mark.parametrize("least", [-1.0, 0.9])
@pytest.mark.parametrize("cell_rows", [8192, 40])
def test_neighbours_are_the_exact_ones(windows, least, cell_rows):
    b, q, base, asked = windows
    rows = neighbours.most_similar(q, b, "pattern_id", "vector", "seq_id", "np_values", 16, 5, least, cell_rows=cell_rows, sample_rows=200).collect()
    got = {(r.pattern_id, r.seq_id): r.place for r in rows}
    want = exact(base, asked, 5, least)
    assert len(got) == len(rows)
    assert set(got) == set(want) and all(got[x] == want[x][1] for x in want)


def test_neighbours_of_nothing(windows):
    b, q, _, _ = windows
    args = ("pattern_id", "vector", "seq_id", "np_values", 16)
    assert neighbours.most_similar(q.where("false"), b, *args).count() == 0
    assert neighbours.most_similar(q, b.where("false"), *args).count() == 0


# ---- clusters
def linked(x, alike):
    u = standard(x)
    near = u @ u.T >= alike - 1e-12
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[k]].min() for k in range(len(x))])
        new = new[new]
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("local_rows", [4096, 12])
def test_clusters_are_the_linked_components(spark, local_rows):
    rng = np.random.default_rng(9)
    shapes = rng.normal(size=(6, 24))
    x = np.concatenate([shapes[rng.integers(0, 6, 150)] + rng.normal(0, 0.17, (150, 24)), rng.normal(size=(30, 24))])
    chain = np.array([np.cos(0.05 * k) * shapes[0] + np.sin(0.05 * k) * shapes[1] for k in range(25)])
    x = np.concatenate([x, chain, np.repeat(x[:1], 80, axis=0)])  # a chain longer than any leaf, and many copies
    names = [f"s{k:04d}" for k in range(len(x))]
    rows = [(n, list(map(float, v)), "leaf") for n, v in zip(names, x)]
    rows += [("flat", [1.0] * 24, ""), ("none", None, ""), ("short", [1.0], ""), ("nan", [float("nan")] * 24, ""), (None, [1.0] * 24, ""), rows[3]]
    frame = spark.createDataFrame(rows, "series_id string, course array<double>, unit string")
    out = clusters.alike_clusters(frame, local_rows=local_rows)
    got = {r.series_id: (r.cluster_id, r["size"]) for r in out.collect()}
    label = linked(x, 0.95)
    want = {}
    for k, n in enumerate(names):
        members = [names[j] for j in np.flatnonzero(label == label[k])]
        want[n] = (min(members), len(members))
    assert got == want and max(s for _, s in want.values()) > 80
    leaf = {}
    for r in out.collect():
        leaf.setdefault(r.leaf, []).append(r.unit)
    assert all(np.min(np.array(u) @ np.array(u).T) >= 0.95 - 1e-9 for u in leaf.values())
    typical = {r.cluster_id: r for r in clusters.typical_members(out).collect()}
    assert sum(r["size"] for r in typical.values()) == len(x) and all(1 <= len(r.typical) <= 3 for r in typical.values())
    assert clusters.alike_clusters(frame.where("false")).count() == 0


def test_visitors_in_parts(spark, monkeypatch):
    monkeypatch.setattr(clusters, "VISITORS", 5)
    rng = np.random.default_rng(2)
    base = rng.normal(size=24)
    x = base + rng.normal(0, 0.22, (120, 24))
    frame = spark.createDataFrame([(f"s{k:03d}", list(map(float, v))) for k, v in enumerate(x)], "series_id string, course array<double>")
    got = {r.series_id: r.cluster_id for r in clusters.alike_clusters(frame, local_rows=10).collect()}
    label = linked(x, 0.95)
    assert got == {f"s{k:03d}": f"s{label[k]:03d}" for k in range(120)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(200)]
    frame = spark.createDataFrame([(a, b) for a, b in edges if a != b], "a long, b long").repartition(7)
    got = {r.node: r.component for r in clusters.components(frame).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    assert got == {x: root(x) for x in parent}
    assert clusters.components(frame.where("false")).count() == 0


def test_courses_are_medians(spark, points):
    rng = np.random.default_rng(3)
    t = np.sort(rng.choice(12 * 24 * 60, 3000, replace=False)) * 60_000
    v = rng.integers(0, 9, 3000).astype(float)
    frame = points({"a": list(zip(t, v)), "few": list(zip(t[:60], v[:60])), "slow": list(zip(t, v))})
    periods = spark.createDataFrame([("a", 60_000), ("few", 60_000), ("slow", 7_200_000)], "series_id string, period long")
    rows = clusters.daily_courses(frame, periods).collect()
    assert [r.series_id for r in rows] == ["a"]
    hour = t // 3_600_000 % 24
    assert rows[0].course == [float(np.median(v[hour == h])) for h in range(24)]


# ---- sketches
@pytest.mark.parametrize("n", [1, 2, 1024, 1025, 5000, 60_000])
def test_bounds_hold_however_merged(n):
    rng = np.random.default_rng(n)
    for values in (rng.normal(size=n), np.sort(rng.exponential(size=n)), rng.integers(0, 3, n).astype(float)):
        parts = [x for x in np.array_split(values, 23) if len(x)]
        whole = [quantiles.Sketch.of(values), quantiles.Sketch.merged([quantiles.Sketch.of(x) for x in parts])]
        step = whole[0]
        for x in parts[:5]:
            step = quantiles.Sketch.merged([step, quantiles.Sketch.of(x)])
        for s, data in ((whole[0], values), (whole[1], values), (step, np.concatenate([values, *parts[:5]]))):
            assert s.n == len(data) == sum(len(x) << h for h, x in enumerate(s.levels)) and s.error <= 0.02 * s.n
            assert all(len(x) <= quantiles.CAPACITY for x in s.levels)
            for p in (0.0, 0.01, 0.5, 0.9, 0.99, 0.999, 1.0):
                estimate, low, high = s.percentile(p)
                assert low <= np.quantile(data, p) <= high and low <= estimate <= high
                if s.error == 0:
                    assert math.isclose(estimate, np.quantile(data, p), abs_tol=1e-12)


def test_upper_tail_is_kept_finer():
    data = np.random.default_rng(0).normal(size=200_000)
    s = quantiles.Sketch.merged([quantiles.Sketch.of(x) for x in np.array_split(data, 50)])
    for p in (0.9, 0.99, 0.999):
        assert abs((data <= s.percentile(p)[0]).mean() - p) <= 0.05 * (1 - p) + 1e-5


def test_pack_and_unpack():
    sketches = [quantiles.Sketch.of(np.arange(float(n))) for n in (1, 3000, 10)]
    table = pa.Table.from_arrays(quantiles.pack(sketches), ["n", "error", "levels", "age"])
    for a, b in zip(sketches, quantiles.unpack(table)):
        assert a.n == b.n and a.error == b.error and a.age == b.age and all((x == y).all() for x, y in zip(a.levels, b.levels))


def test_day_and_series_percentiles(spark, points):
    rng = np.random.default_rng(8)
    data = {"a": [(int(t), float(v)) for t, v in zip(np.sort(rng.choice(4 * DAY_MS // 1000, 9000, replace=False)) * 1000, rng.normal(size=9000))], "b": [(5, 1.0), (6, None), (7, float("nan"))]}
    frame = points(data)
    days = {(r.series_id, r.day_no): r for r in quantiles.day_percentiles(frame).collect()}
    assert ("b", 0) in days and days["b", 0].n == 1 and days["b", 0].p50 == 1.0
    for day in range(4):
        v = [v for t, v in data["a"] if t // DAY_MS == day]
        r = days["a", day]
        assert r.n == len(v) and r.p50_low <= np.quantile(v, 0.5) <= r.p50_high and r.p99_low <= np.quantile(v, 0.99) <= r.p99_high
    series = spark.createDataFrame([("a", "m")], "series_id string, metric string")
    whole = {r.series_id: r for r in quantiles.series_percentiles(frame, series).collect()}
    v = [v for _, v in data["a"]]
    assert whole["a"].metric == "m" and whole["b"].metric is None and whole["a"].p90_low <= np.quantile(v, 0.9) <= whole["a"].p90_high
    assert quantiles.day_percentiles(frame.where("false")).count() == 0


def test_high_days_where_bounds_leave_it_open(points):
    rng = np.random.default_rng(11)
    data = {}
    for s in "abcd":
        level = rng.normal(0, 1.0, 30)
        data[s] = [(d * DAY_MS + k * 60_000, round(float(level[d] + rng.normal(0, 0.8)), 2)) for d in range(30) for k in range(rng.integers(15, 60))]
    got = {tuple(r) for r in quantiles.high_days(points(data), capacity=16).collect()}
    want = set()
    for s, rows in data.items():
        top = round(float(np.quantile([v for _, v in rows], 0.9)), 6)
        for d in range(30):
            v = [v for t, v in rows if t // DAY_MS == d]
            if len(v) >= 20 and round(float(np.median(v)), 6) > top:
                want.add((s, d))
    assert want and got == want
    assert quantiles.high_days(points({})).count() == 0


def test_exact_percentile_between_bounds(points):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 40, 500).astype(float)
    rows = valid_readings(points({"a": [(k, x) for k, x in enumerate(v)]}))
    for p in (0.1, 0.5, 0.9):
        low, high = np.quantile(v, max(0, p - 0.1)) // 1, np.quantile(v, min(1, p + 0.1)) // 1 + 1
        bounds = rows.sparkSession.createDataFrame([("a", 500, float(low), float(high))], "series_id string, n long, low double, high double")
        assert math.isclose(quantiles.exact_percentile(rows, bounds, ["series_id"], p, "x").first().x, np.quantile(v, p))
