"""The time-series operators: known vectors, properties and errors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions.predicate import criterion
from tidemill.functions.ranks import exact_percentiles, order_statistics
from tidemill.operators import cut, describe, match, relate, resample, symbolic, transform
from tidemill.operators.readings import DAY_MS

B = 1_000_000_000_000
V14 = [5, 6, 6, 8, -15, 2, 6, 3, 2, 42, 8, 8, 8, 8]
DS1 = [(B + 1000 * k, v) for k, v in enumerate(V14)]
DS2 = [(B + t, v) for t, v in zip([0, 1000, 2000, 3600, 4000, 5000, 6000, 7200, 8000, 9000, 13000], [5, 6, 6, 8, -15, 2, 6, 3, 2, 5, 10])]
DS3 = [(B + 1000 * t, v) for t, v in zip([0, 1, 2, 3, 100, 101, 102, 103], [5, 6, 6, 8, 5, 9, 5, 10])]
QS1 = list(zip((B + t for t in [0, 1200, 1500, 2000, 2500, 3000, 4000, 5000, 6000, 10000, 11000, 11001, 12000, 13000]), [5, 6.2, 6, 8, -15, 2, 6, 3, 2, 42, 8, 8, 8, 8]))
RAMP = [(B + 1000 * k, k + 1) for k in range(10)]


def flat(values, frame, series="a"):
    return values(frame).get(series, [])


# ---- resampling
@pytest.mark.parametrize(
    ("data", "period", "how", "position", "want"),
    [
        (DS1, 2000, "MAX", "BEG", list(zip(range(0, 14000, 2000), [6, 8, 2, 6, 42, 8, 8]))),
        (DS1, 1400, "MAX", "BEG", list(zip(range(0, 14000, 1400), [6, 6, 8, 2, 6, 3, 42, 8, 8, 8]))),
        (DS1, 10000, "MED", "BEG", [(0, 5.5), (10000, 8)]),
        (DS1, 6000, "MAX", "END", [(6000, 8), (12000, 42), (18000, 8)]),
        (DS2, 2000, "AVG", "BEG", list(zip([0, 2000, 4000, 6000, 8000, 12000], [5.5, 7, -6.5, 4.5, 3.5, 10]))),
        (DS3, 2000, "AVG", "BEG", list(zip([0, 2000, 100000, 102000], [5.5, 7, 7, 7.5]))),
        ([(B, 42)], 2000, "MAX", "END", [(0, 42)]),
        (DS1, 5000, "FIRST", "MID", [(2500, 5), (7500, 2), (12500, 8)]),
        (DS1, 5000, "LAST", "BEG", [(0, -15), (5000, 42), (10000, 8)]),
    ],
)
def test_downsample(points, values, data, period, how, position, want):
    assert [(t - B, v) for t, v in flat(values, resample.downsample(points({"a": data}), period, how, position))] == want


def test_upsample_and_dispatch(spark, points, values):
    data = [(B, 0), (B + 1000, 10), (B + 2500, 40)]
    frame = points({"a": data})
    at = lambda m: [(t - B, v) for t, v in flat(values, resample.upsample(frame, 500, m))]
    assert at("LINEAR_INTERPOLATION") == [(0, 0), (500, 5), (1000, 10), (1500, 20), (2000, 30), (2500, 40)]
    assert at("VALUE_BEFORE") == [(0, 0), (500, 0), (1000, 10), (1500, 10), (2000, 10), (2500, 40)]
    assert at("VALUE_AFTER") == [(0, 0), (500, 10), (1000, 10), (1500, 40), (2000, 40), (2500, 40)]
    assert [t - B for t, _ in flat(values, resample.upsample(frame, 700))] == [0, 700, 1400, 2100]
    periods = spark.createDataFrame([("a", 1000)], "series_id string, period long")
    assert flat(values, resample.resample(frame, periods, 1000)) == flat(values, resample.upsample(frame, 1000))
    assert flat(values, resample.resample(frame, periods, 2000)) == flat(values, resample.downsample(frame, 2000))
    with pytest.raises(ValueError):
        resample.resample(frame, periods.where("false"), 1000)
    with pytest.raises(ValueError):
        resample.downsample(frame, 0)
    with pytest.raises(ValueError):
        resample.downsample(frame, 10, "MODE")


# ---- transforms
def test_slope_counts_holes_by_their_length(points, values):
    data = [(0, 0), (1000, 4), (96_000, 8), (196_000, 5), (390_000, 99_997)]
    got = flat(values, transform.slope(points({"a": data})))
    assert [t for t, _ in got] == [0, 1000, 96_000, 196_000]
    assert np.allclose([v for _, v in got], [4 / 1000, 4 / 95000, -3 / 100000, 99992 / 194000], rtol=1e-12)


def test_rolling_mean(points, values):
    v = [1, 2, 10, 3, 4, 5, 6, 7, 8, 9, 10]
    frame = points({"a": [(B + 1000 * k, x) for k, x in enumerate(v)]})
    for alignment, shift in (("left", 0), ("center", 1), ("right", 1)):
        got = flat(values, transform.rolling_mean(frame, 2, alignment))
        assert [x for _, x in got][:4] == [1.5, 6, 6.5, 3.5] and got[0][0] == B + 1000 * shift and len(got) == 10
    assert flat(values, transform.rolling_mean(frame, 1)) == [(B + 1000 * k, x) for k, x in enumerate(v)]
    assert flat(values, transform.rolling_mean(frame, 11)) == []
    for bad in (0, -1):
        with pytest.raises(ValueError):
            transform.rolling_mean(frame, bad)


@pytest.mark.parametrize("size", [2, 7, 90])
@pytest.mark.parametrize("alignment", ["left", "center", "right"])
def test_rolling_mean_across_days(points, values, size, alignment):
    rng = np.random.default_rng(size)
    t = np.sort(rng.choice(6 * 24 * 12, 150, replace=False)) * 300_000
    v = rng.normal(size=150)
    got = flat(values, transform.rolling_mean(points({"a": list(zip(t, v))}), size, alignment))
    at = {"left": 0, "center": size // 2, "right": size - 1}[alignment]
    want = [(int(t[k + at]), v[k : k + size].mean()) for k in range(150 - size + 1)]
    assert [x for x, _ in got] == [x for x, _ in want] and np.allclose([x for _, x in got], [x for _, x in want])


def test_rolling_mean_over_a_duration(spark, points, values):
    periods = spark.createDataFrame([("a", 1000), ("b", 500)], "series_id string, period long")
    frame = points({s: [(1000 * k, k) for k in range(9)] for s in "abc"})
    got = values(transform.rolling_mean_period(frame, periods, 2000))
    assert set(got) == {"a", "b"} and [v for _, v in got["a"]] == [k + 0.5 for k in range(8)] and [v for _, v in got["b"]] == [k + 1.5 for k in range(6)]


@pytest.mark.parametrize("unit", ["Radians", "Degrees"])
def test_unwrap_like_numpy(points, values, unit):
    rng = np.random.default_rng(4)
    turn = 2 * math.pi if unit == "Radians" else 360.0
    v = rng.uniform(-turn / 2, turn / 2, 400)
    t = np.cumsum(rng.integers(1, 7_000_000, 400))
    got = [x for _, x in flat(values, transform.unwrap(points({"a": list(zip(t, v))}), unit))]
    assert np.allclose(got, np.unwrap(v, period=turn), atol=1e-8)
    wrapped = [(k * 1000, x) for k, x in enumerate([-180.0, -90, 0, 90, 180] * 3)]
    got = [x for _, x in flat(values, transform.unwrap(points({"a": wrapped}), "Degrees"))]
    assert np.allclose(got, np.degrees(np.unwrap(np.radians([x for _, x in wrapped]))))


def test_discontinuity_texts():
    for text, want in (("pi", math.pi), ("2*pi", 2 * math.pi), ("pi/2", math.pi / 2), ("1.5", 1.5), (2, 2.0)):
        assert math.isclose(transform.discontinuity_of(text), want)
    for bad in (None, -1, "x"):
        with pytest.raises(ValueError):
            transform.discontinuity_of(bad)


def test_scale(points, values):
    got = values(transform.scale(points({"a": [(0, 1), (1, 3)], "b": [(0, 5), (1, 5)]})))
    assert [v for _, v in got["a"]] == [-1, 1] and [v for _, v in got["b"]] == [0, 0]


# ---- cuts
def test_cuts(points, values, spark):
    data = [(1000 * k, k) for k in range(1, 49)]
    frame = points({"a": data, "b": data[:3]})
    assert len(flat(values, cut.cut(frame, 1000, 15000))) == 15
    assert values(cut.cut(frame, nb_points="5")) == {"a": data[:5], "b": data[:3]}
    assert flat(values, cut.cut(frame, 10_500, nb_points=2)) == data[10:12]
    assert cut.cut(frame, nb_points=0).count() == 0
    for bad in ({}, {"end": 5, "nb_points": 3}, {"start": 10, "end": 10}, {"nb_points": -1}, {"nb_points": "x"}):
        with pytest.raises(ValueError):
            cut.cut(frame, **bad)
    datasets = spark.createDataFrame([("d", "b"), ("d", "b"), ("e", "a")], "ds_name string, series_id string")
    assert values(cut.cut_dataset(frame, datasets, "d", nb_points=9)) == {"b": data[:3]}
    assert cut.cut_dataset(frame, datasets, "none", end=9).count() == 0


def test_cut_y_is_a_partition(points):
    rows = cut.cut_y(points({"a": DS1}), "1<Y<=8.009", F.lit("fid"), "{fid}_{M}{compl}", F.lit("m")).collect()
    assert len(rows) == 14 and {(r.new_fid, r.matches) for r in rows} == {("fid_m", True), ("fid_m_compl", False)}
    assert sorted(r.v for r in rows if r.matches) == sorted(v for v in V14 if 1 < v <= 8.009)


def test_criteria(spark):
    frame = spark.createDataFrame([(float(k),) for k in range(-3, 12)] + [(None,)], "v double")
    for text in ("M > 7 and M not in [1, 2, 6]", "not (M < 2 or M == 5)", "-2 <= M < 3 and M != 0", "M * 2 + 1 > 4", "M in (1, 2)", "abs(M) > 2", "M % 2 == 1"):
        got = [r.v for r in frame.where(criterion(text, F.col("v"), "M")).collect()]
        assert got == [float(k) for k in range(-3, 12) if eval(text, {"M": k, "abs": abs})], text  # noqa: S307
    for bad in ("__import__('os')", "M.x", "X > 1", "M >", "M if M else 1", "M in 3", "lambda: 1", "'a' < M"):
        with pytest.raises(ValueError):
            criterion(bad, F.col("v"), "M")


def test_runs_and_cut_by_metric(points, spark):
    values_ = [0, 2, 3, 4, 0, 1, 1, 1, -1, -2, 3, 3, 3, 0]
    times = [0, 1000, 2000, 3600, 4000, 5000, 6000, 7000, 8000, 9000, 10000, 11000, 12000, 13000]
    runs = cut.runs_meeting(points({"r": list(zip(times, values_))}), "M > 0").orderBy("first_t").collect()
    assert [(r.first_t, r.last_t) for r in runs] == [(1000, 3600), (5000, 7000), (10000, 12000)]
    long = [(k * DAY_MS // 3, 1 if 2 <= k <= 11 else 0) for k in range(15)]
    assert [(r.first_t, r.last_t) for r in cut.runs_meeting(points({"r": long}), "M > 0").collect()] == [(2 * DAY_MS // 3, 11 * DAY_MS // 3)]
    frame = points({"r": list(zip(times, values_)), "x": [(500, 1), (1000, 2), (3600, 3), (3601, 4), (10_500, 5)], "y": [(4500, 1)], "q": [(0, 1), (50, 1)], "z": [(20, 9), (60, 9)]})
    rows = [("r", "ref", "m", {"g": "1"}), ("x", "fx", "o", {"g": "1"}), ("y", "fy", "o", {"g": "1"}), ("q", "fq", "m", {"g": "2"}), ("z", "fz", None, {"g": "2"})]
    series = spark.createDataFrame(rows, "series_id string, fid string, metric string, tags map<string,string>")
    got = {(r.group, r.series_id, r.t, r.new_fid) for r in cut.cut_by_metric(frame, series, "m", "M > 0", "g").collect()}
    assert got == {("1", "x", t, "fx__m__cut") for t in (1000, 3600, 10_500)} | {("2", "z", 20, "fz__m__cut")}
    with pytest.raises(ValueError):
        cut.cut_by_metric(frame, series, "m", "M > 0")
    with pytest.raises(ValueError):
        cut.cut_by_metric(frame, series, "m", "M > 0", "other")


# ---- description
def test_discretize(points):
    t0 = 1449759331000
    us1 = [(0, 5), (500, 7.5)]
    rows = describe.discretize(points({"a": [(t0 + t, v) for t, v in us1] + [(t0 + 10, 3.0)], "b": [(0, 1)]}), 2).orderBy("series_id", "bucket").collect()
    assert [(r.MIN, r.MAX) for r in rows if r.series_id == "a"] == [(3.0, 5.0), (7.5, 7.5)]
    assert [(r.MIN, r.MAX) for r in rows if r.series_id == "b"] == [(1.0, 1.0), (None, None)]
    few = describe.discretize(points({"a": [(k, k) for k in range(11)]}), 6).count()
    assert few == 6
    wide = describe.discretized_table(describe.discretize(points({"a": [(0, 1), (10, 2)]}), 2, ("MAX",)), 2, ("MAX",)).first()
    assert (wide["MAX_B1"], wide["MAX_B2"]) == (1.0, 2.0)
    for bad in ({"buckets": 0}, {"buckets": 2, "operators": ("MODE",)}, {"buckets": 2, "table_name": "a b"}):
        with pytest.raises(ValueError):
            describe.discretize(points({"a": [(0, 1)]}), **bad)


def test_quality(points):
    r = describe.quality(points({"a": QS1, "c": [(k, 0.088) for k in range(5)]})).orderBy("series_id").collect()
    a, c = r
    assert (a.qual_nb_points, a.qual_min_value, a.qual_max_value, a.qual_ref_period) == (14, -15, 42, 1000)
    assert math.isclose(a.qual_average, 6.942857143, rel_tol=1e-9) and math.isclose(a.qual_variance, 127.613877551, rel_tol=1e-8)
    assert c.qual_variance == 0.0 and a.qual_hist_period == '{"1000":5,"500":3,"1":1,"300":1,"999":1,"1200":1,"4000":1}'
    regular = describe.quality_time(points({"a": DS1})).first()
    assert (regular.qual_hist_period, regular.qual_hist_period_percent) == ('{"1000":13}', '{"1000":100.0}')
    tie = describe.quality_time(points({"a": [(0, 1), (5, 1), (8, 1), (13, 1), (16, 1)]})).first()
    assert (tie.qual_ref_period, tie.qual_min_period, tie.qual_max_period, tie.qual_average_period) == (3, 3, 5, 4.0)
    with pytest.raises(ValueError):
        describe.quality(points({}), False, False)


# ---- words
@pytest.mark.parametrize(("n", "alphabet", "word"), [(5, 5, "abcde"), (10, 5, "aabbccddee"), (10, 10, "abcdefghij"), (5, 10, "acehj")])
def test_sax_of_a_ramp(points, n, alphabet, word):
    assert symbolic.sax(points({"a": RAMP}), n, alphabet).first().word == word
    assert symbolic.sax(points({"a": RAMP}), n, alphabet, normalize=True).first().word == word


def test_paa(points, values):
    assert symbolic.paa(points({"a": RAMP}), 5).first().paa == [1.5, 3.5, 5.5, 7.5, 9.5]
    gappy = points({"a": [(1000 * t, v) for t, v in zip([0, 1, 2, 50, 51, 52], [1, 2, 3, 4, 5, 6])]})
    assert symbolic.paa(gappy, 5).first().paa == [2.0, None, None, None, 5.0]
    assert [r["mean"] for r in symbolic.paa_sequential(gappy, 5).orderBy("segment").collect()] == [2.0, 4.0, 5.0]
    assert [r["mean"] for r in symbolic.paa_sequential(points({"a": RAMP}), 5).orderBy("segment").collect()] == [1.5, 3.5, 5.5, 7.5, 9.5]
    assert [v for _, v in flat(values, symbolic.paa_series(points({"a": RAMP}), 5))] == [x for x in (1.5, 3.5, 5.5, 7.5, 9.5) for _ in range(2)]
    for bad in (0, -1, 2.5):
        with pytest.raises(ValueError):
            symbolic.paa(points({"a": RAMP}), bad)


def test_sliding_windows(points):
    v = np.array([3.0, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5])
    frame = points({"a": [(DAY_MS // 4 * k, x) for k, x in enumerate(v)], "short": [(0, 1), (1, 2)]})
    rows = symbolic.sliding_windows(frame, 4, 0.5, False, False, True).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [0, 1, 2, 3] and {r.series_id for r in rows} == {"a"}
    for r in rows:
        w = v[r["rank"] * 2 : r["rank"] * 2 + 4]
        assert np.allclose(r["values"], (w - w.mean()) / w.std()) and math.isclose(r.local_mean, w.mean())
    line = points({"a": [(k, k) for k in range(8)]})
    assert symbolic.sliding_windows(line, 4, 0.5, linear_filter=(0.01, 0.9)).count() == 0
    same = points({"a": [(k, k % 2) for k in range(20)]})
    kept = symbolic.sliding_windows(same, 4, 0.5, trivial_radius=0.5).orderBy("rank").collect()
    assert [r["rank"] for r in kept] == [0, 8]


def test_window_words_and_mindist(points):
    frame = points({"a": [(1000 * k, math.sin(k / 3)) for k in range(60)]})
    words, breaks = symbolic.words_of_windows(symbolic.sliding_windows(frame, 10, 0.5), 5, 4)
    rows = words.collect()
    assert len(breaks) == 3 and all(len(r.word) == 5 for r in rows)
    for r in rows:
        assert r.word == "".join(chr(97 + sum(x >= b for b in breaks)) for x in r.paa)
    table = symbolic.mindist_table([-1.1, -1, 0, 1.501])
    assert table[0][0] == table[0][1] == 0 and math.isclose(table[0][4], 2.601) and math.isclose(table[2][0], 0.1)


def test_exact_percentiles(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 500, 20_000).astype(float)
    frame = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    ps = [0.0, 0.123, 0.5, 0.9, 1.0]
    assert np.allclose(exact_percentiles(frame, "x", ps), np.percentile(x, [100 * p for p in ps]))
    assert np.allclose(exact_percentiles(frame, "x", ps, held=500), np.percentile(x, [100 * p for p in ps]))
    assert order_statistics(frame, "x", [0, 7777, 19_999], held=300) == [np.sort(x)[k] for k in (0, 7777, 19_999)]


# ---- matches
def test_dtw_against_plain_recursion():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(5, 9)), rng.normal(size=7)
    cost, path = match.dtw(x, y)
    for row in range(5):
        d = np.full((10, 8), np.inf)
        d[0, 0] = 0
        for i in range(1, 10):
            for j in range(1, 8):
                d[i, j] = abs(x[row, i - 1] - y[j - 1]) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
        assert math.isclose(cost[row], d[9, 7])
        i, j = np.nonzero(path[row])
        assert math.isclose(np.abs(x[row][i] - y[j]).sum(), cost[row]) and path[row, 0, 0] and path[row, 8, 6]
    fast, _ = match.fast_dtw(rng.normal(size=(4, 33)), rng.normal(size=31))
    assert np.isfinite(fast).all()
    for n, m in ((20, 20), (21, 17), (8, 30)):
        a, b = rng.normal(size=(6, n)).cumsum(axis=1), rng.normal(size=m).cumsum()
        assert (match.fast_dtw(a, b)[0] >= match.dtw(a, b)[0] - 1e-9).all()
    assert np.allclose(match.fast_dtw(x[:, :3], y[:3])[0], match.dtw(x[:, :3], y[:3])[0])


def test_find_pattern(points):
    rng = np.random.default_rng(3)
    v = rng.normal(size=300)
    shape = np.sin(np.arange(20) / 2)
    v[100:120] = 5 + 3 * shape
    frame = points({"a": [(3_600_000 * k, x) for k, x in enumerate(v)], "short": [(k, 1) for k in range(50)]})
    for distance in match.DISTANCES:
        best = match.find_pattern(frame, list(shape), distance, 0.5, 1.0, "MEAN_VARIANCE", limit=1).collect()
        assert [(r.series_id, r.start_t, r.end_t) for r in best] == [("a", 100 * 3_600_000, 119 * 3_600_000)] and best[0].score < 1e-6
    wide = match.find_pattern(frame, list(shape), "DTW", 0.5, 1.2)
    assert {r["rank"] for r in wide.collect()} == set(range(28))
    for bad in ({"pattern": [1.0]}, {"pattern": [1.0, 2.0], "distance": "L2"}, {"pattern": [1.0, 2.0], "rate_sliding": 0}, {"pattern": [1.0, 2.0], "rate_size_window": 0.5}):
        with pytest.raises(ValueError):
            match.find_pattern(frame, **bad)


def test_warped_has_the_costs_and_spans_of_paths():
    rng = np.random.default_rng(5)
    for n, m in ((9, 7), (7, 9), (2, 2), (64, 64), (1, 4)):
        for x, y in ((rng.normal(size=(6, n)), rng.normal(size=m)), (rng.integers(0, 3, (6, n)).astype(float), rng.integers(0, 3, m).astype(float))):
            cost, path = match.dtw(x, y)
            got, want = match.warped(x, y), match.matched(path)
            assert np.array_equal(got[0], cost) and np.array_equal(got[1], want[0]) and np.array_equal(got[2], want[1])
            assert np.array_equal(match.warped(x, y, False)[0], cost)


def test_every_window_of_a_series_longer_than_a_block(points):
    rng = np.random.default_rng(6)
    v, y = rng.normal(size=9000), rng.normal(size=16)
    frame = points({"a": [(3_600_000 * k, x) for k, x in enumerate(v)]})
    z = match.scaled(np.lib.stride_tricks.sliding_window_view(v, 16), True, True)
    want = np.abs(z - match.scaled(y, True, True)).sum(axis=1)
    for stride in (1, 5, 16, 40):
        rows = match.find_pattern(frame, list(y), rate_sliding=stride / 16).orderBy("rank").collect()
        assert [r["rank"] for r in rows] == list(range((9000 - 16) // stride + 1))
        assert all(r.start_t == r["rank"] * stride * 3_600_000 and r.end_t == r.start_t + 15 * 3_600_000 and math.isclose(r.score, want[r["rank"] * stride]) for r in rows)


@pytest.mark.parametrize("distance", ["DTW", "FAST_DTW"])
def test_the_best_apart_are_those_of_all_windows(points, distance):
    rng = np.random.default_rng(11)
    y = rng.normal(size=12).cumsum()
    frame = points({"a": [(1000 * k, x) for k, x in enumerate(rng.normal(size=4700).cumsum())], "b": [(1000 * k, x) for k, x in enumerate(rng.integers(0, 2, 70))]})
    every = match.find_pattern(frame, list(y), distance, 1 / 12).collect()
    assert len(every) == 4700 - 11 + 70 - 11
    want = []
    for name in "ab":
        taken = []
        for r in sorted((r for r in every if r.series_id == name), key=lambda r: (r.score, r["rank"])):
            if len(taken) < 3 and all(abs(r["rank"] - o["rank"]) >= 12 for o in taken):
                taken.append(r)
        want += taken
    assert sorted(match.find_pattern(frame, list(y), distance, 1 / 12, limit=3).collect()) == sorted(want)


def test_registered_matches_meet_occurrences_off_the_grid(spark, points, tmp_path):
    from tidemill.plans import series

    rng = np.random.default_rng(8)
    shape, v = rng.normal(size=64).cumsum(), rng.normal(size=700)
    for at in (32, 421):
        v[at : at + 64] = 5 + 3 * shape
    points({"a": [(1000 * k, x) for k, x in enumerate(v)]}).write.parquet(str(tmp_path / "points.parquet"))
    spark.createDataFrame([("p", [float(x) for x in shape])], "pattern_id string, np_pattern_values array<double>").write.parquet(str(tmp_path / "patterns.parquet"))
    for name in ("match_dtw", "match_fastdtw", "match_manhattan_dense"):
        rows = series.QUERIES[name](spark, str(tmp_path)).orderBy("score", "rank").collect()
        assert [(r["rank"], r.start_t, r.score) for r in rows[:2]] == [(32, 32_000, 0.0), (421, 421_000, 0.0)], name


# ---- relations
CO = {"a": [1, 2, 3], "b": [4, 5, 7], "c": [7, 6, 5], "d": [7, 6, 4]}


def test_matrices(points):
    frame = points({s: [(k, x) for k, x in enumerate(v)] for s, v in CO.items()})
    ccf = {(r.id_a, r.id_b): r.correlation for r in relate.cross_correlation(frame).collect()}
    assert len(ccf) == 6 and math.isclose(ccf["a", "b"], 0.981980506061966) and math.isclose(ccf["a", "c"], -1) and math.isclose(ccf["b", "d"], -1)
    pearson = {(r.id_a, r.id_b): r.correlation for r in relate.correlation_matrix(frame).collect()}
    assert math.isclose(pearson["a", "d"], np.corrcoef(CO["a"], CO["d"])[0, 1])
    spearman = {(r.id_a, r.id_b): r.correlation for r in relate.correlation_matrix(frame, "SPEARMAN").collect()}
    assert math.isclose(spearman["a", "b"], 1) and math.isclose(spearman["a", "d"], -1)
    with pytest.raises(ValueError):
        relate.correlation_matrix(frame, "kendall")
    longer = points({"a": [(0, 0), (1, 3), (2, 4)], "b": [(5, 0), (6, 7)], "k": [(0, 1), (1, 1), (2, 1), (3, 1)]})
    d = {(r.id_a, r.id_b): r.distance for r in relate.euclidean_distances(longer).collect()}
    assert d == {("a", "b"): 4.0, ("a", "k"): math.sqrt(1 + 4 + 9), ("b", "k"): math.sqrt(1 + 36)}
    assert math.isnan({(r.id_a, r.id_b): r.correlation for r in relate.correlation_matrix(longer).collect()}["a", "k"])
    assert relate.euclidean_distances(points({})).count() == 0
    rng = np.random.default_rng(2)
    x = {s: rng.normal(size=40) for s in "abc"}
    walk = points({s: [(3_600_000 * k, y) for k, y in enumerate(v)] for s, v in x.items()})
    parts = {(r.id_a, r.id_b): r.correlation for r in relate.correlation_matrix(walk, part_rows=7).collect()}
    far = {(r.id_a, r.id_b): r.distance for r in relate.euclidean_distances(walk, part_rows=7).collect()}
    for a, b in ("ab", "ac", "bc"):
        assert math.isclose(parts[a, b], np.corrcoef(x[a], x[b])[0, 1]) and math.isclose(far[a, b], np.linalg.norm(x[a] - x[b]))


def test_cells_of_a_correlation_matrix_are_not_shuffled(points, monkeypatch):
    monkeypatch.setattr(relate, "BLOCK", 3)
    monkeypatch.setattr(relate, "STRIP", 2, raising=False)
    monkeypatch.setattr(relate, "CELLS", 4, raising=False)
    rng = np.random.default_rng(6)
    x = {f"s{k}": rng.normal(size=30 + k) for k in range(25)}
    got = relate.correlation_matrix(points({s: [(3_600_000 * k, y) for k, y in enumerate(v)] for s, v in x.items()}))
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    cells = {(r.id_a, r.id_b): r.correlation for r in got.collect()}
    assert got.count() == len(cells) == 300 and all(a < b for a, b in cells)
    assert all(math.isclose(r, np.corrcoef(x[a][:30], x[b][:30])[0, 1], abs_tol=1e-12) for (a, b), r in cells.items())


def test_cells_of_a_distance_matrix_are_summed_only_for_pairs_of_long_series(points, monkeypatch):
    monkeypatch.setattr(relate, "BLOCK", 3)
    rng = np.random.default_rng(7)
    x = {f"s{k}": 1e4 + rng.normal(size=int(n)) for k, n in enumerate([1, 4, 9, 10, 10, 9, 3, 17, 23, 30, 31, 80])}
    x |= {"same": x["s8"].copy(), "near": x["s8"] + 1e-7, "endless": np.array([1.0, np.inf, 2.0]), "vast": np.full(12, 1e200)}
    frame = points({s: [(3_600_000 * k, float(y)) for k, y in enumerate(v)] for s, v in x.items()})

    def want(a, b):
        n = min(len(a), len(b))
        with np.errstate(over="ignore", invalid="ignore"):
            return float(np.sqrt(((a[:n] - b[:n]) ** 2).sum()))

    for part_rows in (10, 65_536):
        got = relate.euclidean_distances(frame, part_rows=part_rows)
        if part_rows > 80:
            assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        cells = {(r.id_a, r.id_b): r.distance for r in got.collect()}
        assert got.count() == len(cells) == 16 * 15 // 2 and cells["s8", "same"] == 0
        for (a, b), r in cells.items():
            d = want(x[a], x[b])
            assert a < b and (r == d or (math.isnan(r) and math.isnan(d)) or math.isclose(r, d, rel_tol=1e-10)), (a, b, r, d)


def test_cells_are_rounded_as_other_values(spark):
    from tidemill.functions.compare import settled, settled_cells

    rng = np.random.default_rng(11)
    x = [0.0, -0.0, -1e-9, 0.0000005, -0.0000005, 1.5e-6, 2.5e-6, 1.0, -1.0, 1e9, 123456789.1234565, 1e300, math.inf, -math.inf, math.nan]
    frame = spark.createDataFrame([(float(y),) for y in [*x, *rng.normal(size=2000), *(1000 * rng.normal(size=2000))]] + [(None,)], "x double")
    for digits in (4, 6):
        rows = frame.select(settled("x", digits).alias("a"), settled_cells("x", digits).alias("b")).collect()
        assert all(str(r.a) == str(r.b) for r in rows)


def test_registered_cross_correlation_over_all_lags(spark, points, tmp_path):
    from tidemill.plans import series

    rng = np.random.default_rng(4)
    x = rng.normal(size=60)
    v = {"a": x[:40], "b": x[17:57], "c": np.full(40, 3.0), "d": -x[9:49], "e": rng.normal(size=40)}
    points({s: [(1000 * k, y) for k, y in enumerate(values)] for s, values in v.items()}).write.parquet(str(tmp_path / "points.parquet"))
    got = {(r.id_a, r.id_b): r.correlation for r in series.QUERIES["cross_correlation_all"](spark, str(tmp_path)).collect()}
    z = {s: (y - y.mean()) / (y.std() or 1) for s, y in v.items()}
    assert set(got) == {(p, q) for p in v for q in v if p < q}
    for (p, q), r in got.items():
        every = np.correlate(z[p], z[q], "full") / 40
        want = math.nan if "c" in (p, q) else every[np.abs(every).argmax()]
        assert (math.isnan(r) and math.isnan(want)) or abs(r - want) < 2e-6
    assert got["a", "b"] > 0.5 and got["a", "d"] < -0.5


def test_blocks_cover_all_pairs(points):
    series = {f"s{k:02d}": [(0, k), (1, 2 * k % 7)] for k in range(23)}
    arrays = relate.series_arrays(points(series))
    got = relate.pairwise(arrays, relate._squares, ["distance"], block=4).collect()
    assert len(got) == 23 * 22 // 2 == len({(r.id_a, r.id_b) for r in got}) and all(r.id_a < r.id_b for r in got)


def test_correlation_by_context(points, spark):
    data = {"1x": [1, 2, 3, 4], "1y": [2, 4, 6, 9], "1z": [5, 5, 5, 5], "2x": [1, 2, 3], "2y": [3, 2, 1, 7], "3x": [1, 2]}
    frame = points({s: [(k, x) for k, x in enumerate(v)] for s, v in data.items()})
    series = spark.createDataFrame([(s, s[0], s[1]) for s in data] + [("n", None, "x")], "series_id string, context string, variable string")
    each, summary = relate.correlation_by_context(frame, series)
    r1 = np.corrcoef([1, 2, 3, 4], [2, 4, 6, 9])[0, 1]
    got = {(r.var_a, r.var_b): r for r in summary.collect()}
    assert math.isclose(got["x", "y"].mean_correlation, (r1 - 1) / 2) and math.isclose(got["x", "y"].variance, ((r1 + 1) / 2) ** 2)
    assert math.isnan(got["x", "z"].mean_correlation) and got["z", "z"].contexts == 0 and math.isclose(got["x", "x"].mean_correlation, 1)
    assert {r.context for r in each.collect()} == {"1", "2"}
    profile = {(r.var_a, r.var_b): r.profile for r in relate.context_profiles(each).collect()}
    assert '"correlation":"NaN"' in profile["x", "z"] and '"correlation":"-1.0"' in profile["x", "y"]
    with pytest.raises(ValueError):
        relate.correlation_by_context(frame, series.unionByName(series))


def test_derived_names_and_spans(points, spark):
    from tidemill.operators import derive

    series = spark.createDataFrame([("a", "fa", "m", 1000, {"k": "v"}), ("b", None, None, None, None)], "series_id string, fid string, metric string, ref_period long, tags map<string,string>")
    result = points({"a": [(5, 1), (9, 1)], "b": [(1, 1)], "c": [(2, 2)]})
    rows = {r.parent_id: r for r in derive.derived_series(result, series, "resample", F.lit(500), period=F.lit(500)).collect()}
    assert rows["a"].fid == "fa_resampled_to_500ms" and (rows["a"].start_ms, rows["a"].end_ms, rows["a"].nb_points, rows["a"].ref_period) == (5, 9, 2, 500)
    assert rows["a"].tags == {"k": "v"} and rows["b"].fid == "b_resampled_to_500ms" and rows["c"].fid == "c_resampled_to_500ms"
    assert derive.derived_series(result, series, "unwrap").where("parent_id = 'a'").first().fid == "fa__unwrap"


def test_long_ranges_come_in_blocks(spark):
    from tidemill.functions.expand import each_value

    frame = spark.createDataFrame([(0, 0), (5, 47), (100, 130)], "a long, b long")
    got = sorted((r.a, r.x) for r in each_value(frame, F.col("a"), F.col("b"), "x", 3, block=4).collect())
    assert got == [(a, x) for a, b in ((0, 0), (5, 47), (100, 130)) for x in range(a, b + 1, 3)]
