"""The general data-preparation operators on small tables, against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from tidemill.functions.typed import instant, number
from tidemill.operators import grid, rolling, spikes, wide
from tidemill.operators.readings import DAY_MS
from tidemill.plans import pipeline


# ---- wide tables
METADATA = "tsuid string, name string, value string, data_type string, at long, unfilled string"
TYPES = [("gain", "number"), ("Seen On", "date"), ("note", "string"), ("tsuid", "string")]


@pytest.fixture(scope="module")
def attributes(spark):
    def make(rows):
        frame = spark.createDataFrame([(a, b, c, "string", at, "clash") for a, b, c, at in rows], METADATA)
        return frame.selectExpr("tsuid", "name", "value", "data_type", "timestamp_millis(at) as updated_at", "unfilled")

    return make


@pytest.fixture(scope="module")
def types(spark):
    return spark.createDataFrame(TYPES, "name string, data_type string")


def test_newest_cell_is_typed_and_failures_are_told(attributes, types):
    rows = [
        ("a", " Gain\t", "1e2", 5), ("a", "gain", "7", 4), ("a", "gain", "1e2", 5), ("a", "note", "", 1), ("a", "odd", "x", 1),
        ("b", "gain", "12 V", 9), ("b", "gain", "3", 8), ("b", "seen on", "2020-02-30", 1), ("b", "note", None, 3), ("b", "note", "old", 2),
        ("c", "gain", "4", None), ("c", "gain", "5", 0), ("c", "tsuid", "t", 0), (None, "gain", "4", 1), ("c", None, "4", 1), ("c", " ", "4", 1),
    ]
    out = {r["tsuid"]: r for r in wide.widen(attributes(rows), types).collect()}
    assert set(out) == {"a", "b", "c"}
    assert out["a"]["gain"] == 100.0 and out["a"]["note"] == "" and out["a"]["other"] == {"odd": "x"}
    assert out["b"]["gain"] is None and sorted(out["b"]["unfilled"]) == ["gain", "seen on"] and "note" in out["b"]["absent"]
    assert out["c"]["gain"] == 5.0 and out["c"]["tsuid_"] == "t" and out["c"]["unfilled"] == []
    found = {tuple(r) for r in wide.unreadable_cells(attributes(rows), types).collect()}
    assert found == {("b", "gain"), ("b", "seen on")}


def test_wide_of_nothing(attributes, types, spark):
    assert wide.widen(attributes([]), types).count() == 0
    rows = wide.widen(attributes([("a", "gain", "1", 1)]), spark.createDataFrame([], types.schema)).collect()
    assert [(r["tsuid"], r["other"], r["unfilled"]) for r in rows] == [("a", {"gain": "1"}, [])]


def test_numbers_and_dates(spark):
    texts = {
        "1": 1.0, " -2.5 ": -2.5, "+.5": 0.5, "5.": 5.0, "1e3": 1000.0, "1E-2": 0.01, "\t7": 7.0, "": None, " ": None, "NaN": None,
        "Infinity": None, "1e999": None, "1f": None, "0x10": None, "1,5": None, "1 000": None, "e5": None, ".": None, "--": None, "1d": None, "+-1": None,
    }
    frame = spark.createDataFrame([(t,) for t in texts], "x string")
    assert {r.x: r.n for r in frame.select("x", number(frame.x).alias("n")).collect()} == texts
    moments = {
        "1546300800000": dt.datetime(2019, 1, 1), "999999999999": dt.datetime(2001, 9, 9, 1, 46, 39, 999000), "2020-02-29": dt.datetime(2020, 2, 29),
        "2019-01-01T10:20:30Z": dt.datetime(2019, 1, 1, 10, 20, 30), "2019-01-01 10:20": dt.datetime(2019, 1, 1, 10, 20),
        "2019-01-01T10:20:30.5+01:00": dt.datetime(2019, 1, 1, 9, 20, 30, 500000), "2019-01-01T00:00:00-0130": dt.datetime(2019, 1, 1, 1, 30),
        "2021-02-29": None, "2019-13-01": None, "0000-00-00": None, "2019-01-01T25:00:00Z": None, "2019-01-01T10:61:00": None, "2019-01-": None,
        "12345678901": None, "12345678901234": None, "yesterday": None, "": None, "01/02/2019": None, "2019-01-01T": None, "2019-1-1": None,
    }
    frame = spark.createDataFrame([(t,) for t in moments], "x string")
    assert {r.x: r.m for r in frame.select("x", instant(frame.x).alias("m")).collect()} == moments


# ---- trailing totals
def test_trailing_totals_against_python(points):
    rng = random.Random(5)
    days = {}
    series = {}
    for s in "abc":
        chosen = sorted(rng.sample(range(18_000, 18_080), 25 if s != "c" else 1))
        for day in chosen:
            for k in range(rng.randint(1, 3)):
                v = rng.choice([1.5, -2.0, 10.0, 0.25])
                series.setdefault(s, []).append((day * DAY_MS + k, v))
                total, n = days.get((s, day), (0.0, 0))
                days[s, day] = (total + v, n + 1)
    rows = {(r.series_id, r.day_no): r for r in rolling.trailing_totals(points(series), (7, 30)).collect()}
    for s in series:
        own = [d for x, d in days if x == s]
        assert {d for x, d in rows if x == s} == set(range(min(own), max(own) + 1))
        for day in range(min(own), max(own) + 1):
            for p in (7, 30):
                got = [days.get((s, d), (0.0, 0)) for d in range(day - p + 1, day + 1)]
                total, n = sum(x for x, _ in got), sum(x for _, x in got)
                r = rows[s, day]
                assert math.isclose(r[f"total_{p}"], total, abs_tol=1e-9) and r[f"n_{p}"] == n
                assert math.isclose(r[f"avg_day_{p}"], total / p, abs_tol=1e-9)
                assert r[f"avg_reading_{p}"] is None if n == 0 else math.isclose(r[f"avg_reading_{p}"], total / n, abs_tol=1e-9)


def test_totals_skip_null_and_nan(points):
    frame = points({"a": [(0, None), (DAY_MS, 2.0), (DAY_MS + 1, float("nan"))], "b": [(0, None)]})
    assert [(r.series_id, r.day_no, r.total_7, r.n_7) for r in rolling.trailing_totals(frame).collect()] == [("a", 1, 2.0, 1)]
    assert rolling.surging_days(points({})).count() == 0


# ---- regular grid
def test_grid_fills_marks_and_keeps(spark, points):
    frame = points({"a": [(1000, 1.0), (1400, 2.0), (3500, 4.0), (9_900, 0.0)], "b": [(0, 1.0)], "c": [(5, 1.0)], "d": [(0, None)]})
    periods = spark.createDataFrame([("a", 1000, "x"), ("b", 500, "x"), ("d", 10, "x")], "series_id string, period long, value string")
    rows = {(r.series_id, r.slot_ms): (r.value, r.status) for r in grid.regular_grid(frame, periods, gap_limit=4).collect()}
    assert rows["a", 1000] == (1.0, "observed")
    assert rows["a", 2000][1] == "filled" and math.isclose(rows["a", 2000][0], 2 + 2 * 600 / 2100)
    assert rows["a", 3000][1] == "observed" and math.isclose(rows["a", 3000][0], 2 + 2 * 1600 / 2100)
    assert [rows["a", k * 1000] for k in range(4, 9)] == [(None, "missing")] * 5 and rows["a", 9000] == (None, "observed")
    assert rows["b", 0] == (1.0, "observed") and not [k for k in rows if k[0] in "cd"]
    assert {(r.series_id, r.slot_ms) for r in grid.empty_slots(frame, periods).collect()} == {("a", k * 1000) for k in (2, 4, 5, 6, 7, 8)}


def test_grid_across_days(spark, points):
    frame = points({"a": [(k * DAY_MS + 7, k) for k in (0, 1, 4)]})
    periods = spark.createDataFrame([("a", DAY_MS)], "series_id string, period long")
    assert {r.slot_ms // DAY_MS for r in grid.empty_slots(frame, periods).collect()} == {2, 3}


# ---- implausible readings
def _brute(v):
    """Bursts of up to three that stand off, and runs of eight, by plain loops."""
    n = len(v)

    def nb(ks):
        xs = [v[k] for k in ks if 0 <= k < n]
        return float(np.median(xs)) if xs else None

    resid = [v[i] - nb([i - 2, i - 1, i + 1, i + 2]) for i in range(n)]
    scatter = (np.percentile(resid, 75) - np.percentile(resid, 25)) / (1.349 * 1.139)
    off = [0.0] * n
    for a in range(n):
        for b in range(a, min(n, a + 3)):
            levels = [nb(range(a - 5, a)), nb(range(b + 1, b + 6)), v[a - 1] if a else None, v[b + 1] if b + 1 < n else None]
            levels = [x for x in levels if x is not None]
            least = min((abs(v[k] - x) for k in range(a, b + 1) for x in levels), default=0.0)
            for k in range(a, b + 1):
                off[k] = max(off[k], least)
    return scatter, off


def test_spikes_and_stuck_values_against_loops(points):
    rng = np.random.default_rng(1)
    # several days of one series, so that bursts and runs lie across midnight
    n = 600
    v = rng.normal(50, 1, n).round(3)
    t = np.arange(n) * 900_000 + 500_000
    v[100], v[200:202], v[300:303] = 90, -9999, 1e6
    v[400:404] = 80  # a level of four isn't a burst
    v[450:460] = 51.234  # stuck
    day = int(np.searchsorted(t, DAY_MS * 4))
    v[day - 1 : day + 1] = 75  # across midnight
    v[day + 90 : day + 98] = 49.5
    series = {"a": list(zip(t, v)), "flat": [(k * 1000, k // 20) for k in range(200)], "one": [(5, 1.0)], "two": [(5, 1.0), (6, 100.0)]}
    got = {(r.series_id, r.t): r for r in spikes.implausible(points(series)).collect()}
    scatter, off = _brute(list(v))
    spiky = {("a", int(t[k])) for k in range(n) if off[k] > 8 * scatter}
    assert {k for k, r in got.items() if r.spike} == spiky
    planted = {100, 200, 201, 300, 301, 302, day - 1, day}
    assert {("a", int(t[k])) for k in planted} <= spiky and not {("a", int(t[k])) for k in range(400, 404)} & spiky
    stuck = {k[1] for k, r in got.items() if r.stuck}
    assert stuck == {int(t[k]) for k in [*range(450, 460), *range(day + 90, day + 98)]}
    assert not [k for k in got if k[0] != "a"]


def test_spikes_of_nothing(points):
    assert spikes.implausible(points({})).count() == 0
    assert spikes.implausible(points({"a": [(1, None), (2, float("nan"))]})).count() == 0


def test_features_cut_by_day_equal_whole(points):
    rng = np.random.default_rng(2)
    t = np.sort(rng.choice(5 * 24 * 60, 700, replace=False)) * 60_000
    v = rng.integers(0, 3, 700).astype(float)
    rows = {r.t: r for r in spikes.neighbourhood(points({"a": list(zip(t, v))})).collect()}
    whole = spikes.reading_features(v, np.arange(700) == 0)
    assert len(rows) == 700
    for k in range(700):
        assert math.isclose(rows[int(t[k])].off, whole["off"][k], abs_tol=1e-6) and math.isclose(rows[int(t[k])].resid, whole["resid"][k], abs_tol=1e-9)
        assert rows[int(t[k])].run == whole["run"][k] and rows[int(t[k])].same == whole["same"][k]


def test_registered_queries_have_their_columns(spark):
    d = "/root/testdata/sf0.001"
    want = {"p3_found": {"tsuid", "name"}, "p4_found": {"series_id", "day_no"}, "p6_found": {"series_id", "slot_ms"}, "p7_found": {"series_id", "t"}}
    for name, columns in want.items():
        assert set(pipeline.QUERIES[name](spark, d).columns) == columns
