"""Hot groups, long series and what must not depend on how rows are laid out."""

import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.functions import batches, joins, ranks
from tidemill.operators import cut, match, motif, readings, relate, spikes, symbolic, transform
from tidemill.sources import scratch


@pytest.fixture(scope="module")
def hot(spark):
    """Groups of which one holds a third of the values, with ties, infinities and both zeros."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=6000), rng.integers(-3, 3, 2000), [1e300, -1e300, 0.0, -0.0, np.inf], np.full(1500, 7.25)]).astype(float)
    g = rng.integers(0, 6, len(x))
    g[rng.random(len(x)) < 0.33] = 0
    frame = spark.createDataFrame([(f"g{a}", float(b)) for a, b in zip(g, x)] + [("g1", None), ("none", None)], "k string, v double")
    return frame.repartition(5), {f"g{k}": x[g == k] for k in range(6)}


@pytest.mark.parametrize(("held", "sparse"), [(1_000_000, False), (300, False), (1_000_000, True), (2000, True)])
def test_percentiles_of_groups(hot, held, sparse):
    frame, data = hot
    got = {r.k: r for r in ranks.grouped_percentiles(frame, ["k"], {"low": 0.01, "half": 0.5, "high": 0.9}, held=held, sparse=sparse).collect()}
    assert set(got) == set(data)
    for k, x in data.items():
        assert got[k].n == len(x) and np.allclose([got[k].low, got[k].half, got[k].high], np.quantile(x, [0.01, 0.5, 0.9]), atol=1e-12)
    assert ranks.grouped_percentiles(frame.where("false"), ["k"], {"half": 0.5}).count() == 0


def test_magnitude_never_falls(spark):
    x = np.sort(np.concatenate([np.random.default_rng(1).normal(size=300) * 10.0 ** np.arange(-150, 150), [0.0, 5e-324, -5e-324, np.inf, -np.inf]]))
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k long, v double").select("k", ranks.magnitude(F.col("v")).alias("m")).orderBy("k").collect()
    assert all(a.m <= b.m for a, b in zip(rows, rows[1:]))


def test_salted_join_is_the_plain_one(spark):
    left = spark.createDataFrame([("a" if k % 3 else "b", k) for k in range(200)] + [(None, 1), ("c", 2)], "k string, x long")
    right = spark.createDataFrame([("a", 1.5), ("b", 2.5), ("d", 3.5)], "k string, y double")
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right, "k", how).collect()), key=repr)
        assert sorted(map(tuple, joins.salted_join(left, right, "k", how).collect()), key=repr) == want
        assert sorted(map(tuple, joins.sized_join(left, right, "k", how, rows=1).select("k", "x", "y").collect()), key=repr) == want
        assert sorted(map(tuple, joins.sized_join(left, right, "k", how).select("k", "x", "y").collect()), key=repr) == want


def test_many_series_are_joined_without_broadcast(points, values):
    frame = readings.valid_readings(points({f"s{k}": [(j * 1000, j + k) for j in range(6)] for k in range(5)}))
    plain = values(transform.scale(frame))
    frame.__dict__["_source"].__dict__["_few_series"] = {joins.BROADCAST_ROWS: False}
    assert {s: np.round([v for _, v in x], 9).tolist() for s, x in values(transform.scale(frame)).items()} == {s: np.round([v for _, v in x], 9).tolist() for s, x in plain.items()}


def test_pieces_overlap():
    x = np.random.default_rng(3).normal(size=1000).cumsum()
    keys = np.repeat([0, 1, 2], [700, 250, 50])
    whole = spikes.reading_features(x, np.concatenate([[True], np.diff(keys) > 0]))

    def kernel(table, first, out):
        return pa.table({"off": spikes.reading_features(table.column("x").to_numpy(), first)["off"]}).slice(out.start, out.stop - out.start)

    rows = pa.table({"key": keys, "x": x}).to_batches(max_chunksize=37)
    got = np.concatenate([b.column("off").to_numpy() for b in batches.overlapping(["key"], kernel, 16, rows=64)(iter(rows))])
    assert np.array_equal(got, whole["off"])


def test_flags_of_hours_and_rates(points):
    rng = np.random.default_rng(4)
    n = 24 * 80
    t = np.arange(n) * 3_600_000
    v = 10 * np.sin(np.arange(n) / 24 * 2 * np.pi) + rng.normal(0, 0.1, n)
    v[24 * 40 : 24 * 40 + 6] += 40  # a level of six: no burst, but outside its hours and reached too fast
    got = {r.t: r for r in spikes.implausible(points({"a": list(zip(t, v))}), context=True).collect()}
    level = [int(x) for x in t[24 * 40 : 24 * 40 + 6]]
    assert all(got[x].outside and not got[x].spike for x in level) and got[level[0]].fast and not got[level[1]].fast
    assert {x for x, r in got.items() if r.outside} == set(level) and spikes.implausible(points({}), context=True).count() == 0


def test_ranges_reach_the_scan(spark, points, values, tmp_path):
    rows = points({"a": [(k * 1000, k) for k in range(50)], "b": [(5000, None), (6000, 1)]})
    rows.unionByName(rows.where("t = 7000").withColumns({"v": F.lit(99.0), "recv_ms": F.lit(10**9)})).write.parquet(str(tmp_path / "points.parquet"))
    store = spark.read.parquet(str(tmp_path / "points.parquet"))
    some = cut.cut_points(store, 3000, 9000)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t,3000)" in plan and "LessThanOrEqual(t,9000)" in plan
    assert values(some) == values(cut.cut_range(readings.valid_readings(store), 3000, 9000)) and dict(values(some)["a"])[7000] == 99
    many = [(k * 1000, float(k)) for k in range(50)]
    assert [t for t, _ in values(cut.cut_points(store, 2000, nb_points=3))["a"]] == [2000, 3000, 4000]
    cut.FEW, kept = 2, cut.FEW
    try:
        assert [t for t, _ in values(cut.cut_first(readings.valid_readings(store), 5))["a"]] == [t for t, _ in many[:5]]
    finally:
        cut.FEW = kept


def test_rolling_means_of_every_length(points, values):
    rng = np.random.default_rng(7)
    v = rng.normal(size=9500)
    frame = points({"a": [(k * 60_000, x) for k, x in enumerate(v)], "b": [(k, 1.0) for k in range(70)]})
    for size, alignment in ((3, "left"), (64, "right"), (65, "center"), (5000, "left")):
        got = values(transform.rolling_mean(frame, size, alignment))
        want = np.lib.stride_tricks.sliding_window_view(v, size).mean(axis=1)
        shift = {"left": 0, "center": size // 2, "right": size - 1}[alignment]
        assert [t for t, _ in got["a"]] == [(k + shift) * 60_000 for k in range(len(want))] and np.allclose([x for _, x in got["a"]], want)
        assert ("b" in got) == (size < 70)
    transform.LONG, kept = 100, transform.LONG
    try:
        long = values(transform.rolling_mean(frame, 5000, "left"))["a"]
    finally:
        transform.LONG = kept
    assert np.allclose([x for _, x in long], want)


def test_windows_that_start_at_every_reading(points):
    rng = np.random.default_rng(8)
    v = rng.normal(size=6000)
    rows = symbolic.sliding_windows(points({"a": [(k * 1000, x) for k, x in enumerate(v)]}), 50, 0.99, False, False, False)
    got = rows.orderBy("rank").select("rank", "start_ms", "values", F.element_at("times", -1).alias("end")).toPandas()
    want = np.lib.stride_tricks.sliding_window_view(v, 50)
    assert got["rank"].tolist() == list(range(5951)) and np.array_equal(np.stack(got["values"]), want)
    assert (got["start_ms"] == got["rank"] * 1000).all() and (got["end"] == got["start_ms"] + 49_000).all()


@pytest.mark.parametrize("n", [1, 4, 9])
def test_sequential_averages_against_a_walk(points, n):
    rng = np.random.default_rng(n)
    data = {"one": [(5, 2.0)]}
    for s in "abcdef":
        t = np.sort(rng.choice(200, rng.integers(2, 40), replace=False))
        if s > "c":
            t[len(t) // 2 :] += 5000  # a long silence, after which segments lag
        data[s] = [(int(x), float(y)) for x, y in zip(t, rng.normal(size=len(t)))]
    want = {}
    for s, rows in data.items():
        t0, t1 = rows[0][0], rows[-1][0]
        part, held, border = 0, [], t0 + (t1 - t0) / n
        for t, v in rows:
            if t > round(border):
                want[s, part] = np.mean(held)
                part, held = part + 1, []
                border = t0 + (t1 - t0) / n * (part + 1)
            held.append(v)
        if round(border) >= t1:
            want[s, part] = np.mean(held)
    got = {(r.series_id, r.segment): r["mean"] for r in symbolic.paa_sequential(points(data), n).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("name", list(match.NORMALISATIONS))
def test_normalisations_against_loops(points, name):
    rng = np.random.default_rng(12)
    v, y = rng.normal(3, 2, 90), rng.normal(-1, 4, 8)
    centre, spread, own_centre, own_spread = match.NORMALISATIONS[name]

    def fit(x, c, s):
        x = x - np.mean(x) * c
        return x / np.std(x) if s else x

    target = fit(y, centre, spread)
    frame = points({"a": [(k, x) for k, x in enumerate(v)]})
    for distance, size in (("MANHATTAN", 8), ("DTW", 12)):
        rows = match.find_pattern(frame, list(y), distance, 3 / 8, 1.5, name).collect()
        assert {r["rank"] for r in rows} == set(range((90 - size) // 3 + 1))
        for r in rows:
            x = fit(v[r["rank"] * 3 :][:size], own_centre, own_spread)
            if distance == "MANHATTAN":
                want = sum(abs(a - b) for a, b in zip(x, target))
            else:
                cost = np.full((size + 1, 9), np.inf)
                cost[0, 0] = 0
                for i in range(size):
                    for j in range(8):
                        cost[i + 1, j + 1] = abs(x[i] - target[j]) + min(cost[i, j + 1], cost[i + 1, j], cost[i, j])
                want = cost[size, 8]
            assert math.isclose(r.score, want, rel_tol=1e-9)


def test_seeds_and_partners_of_words(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc"), 5)) for _ in range(60)]
    words = spark.createDataFrame([(w,) for w in texts], "word string")
    every = {(r.word_a, r.word_b): r.n for r in motif.collisions(words, 2).collect()}
    for above in (0, 1, 3, 6, 10):
        assert {(r.word_a, r.word_b): r.n for r in motif.collisions(words, 2, above=above).collect()} == {k: n for k, n in every.items() if n > above}
        sampled = {(r.word_a, r.word_b): r.n for r in motif.collisions(words, 2, 4, 1, above=0).collect()}
        assert {(r.word_a, r.word_b): r.n for r in motif.collisions(words, 2, 4, 1, above=above).collect()} == {k: n for k, n in sampled.items() if n > above}
    own = words.where("word < 'b'").distinct()
    got = {(r.word_a, r.word_b): r.n for r in motif.partners(own, motif.word_classes(words), 2, 5).collect()}
    both = every | {(b, a): n for (a, b), n in every.items()}
    assert got == {k: n for k, n in both.items() if k[0] < "b"}


def test_natural_order_and_the_result_of_the_loop(points, spark):
    frame = spark.createDataFrame([(x,) for x in ("v10", "v2", "v2a", "10", "9", "a", "v02", "b1-2")], "x string")
    got = [r.x for r in frame.orderBy(relate.natural_key(F.col("x")), "x").collect()]
    assert got == ["9", "10", "a", "b1-2", "v02", "v2", "v2a", "v10"]
    data = {(c, v): np.random.default_rng(len(c) + k).normal(size=12) for c in ("2", "10", "1") for k, v in enumerate(("x10", "x9"))}
    rows = points({f"{c}|{v}": [(k, y) for k, y in enumerate(x)] for (c, v), x in data.items()})
    series = spark.createDataFrame([(f"{c}|{v}", c, v) for c, v in data], "series_id string, context string, variable string")
    each, summary = relate.correlation_by_context(rows, series)
    r = [np.corrcoef(data[c, "x9"], data[c, "x10"])[0, 1] for c in ("1", "2", "10")]
    whole = json.loads(relate.correlation_dataset(each, summary, "flight").first().document)
    assert whole["variables"] == ["x9", "x10"] and whole["context"] == {"identifier": "flight", "number_of_contexts": 3, "label": "flight"}
    mean, variance, link = (m["data"] for m in whole["matrices"])
    assert [len(x) for x in mean] == [2, 1] and math.isclose(mean[0][1], np.mean(r)) and math.isclose(variance[0][1], np.var(r)) and math.isclose(mean[0][0], 1) and abs(variance[1][0]) < 1e-12
    documents = {x.link: json.loads(x.document) for x in relate.correlation_documents(each, "flight").collect()}
    one = documents[link[0][1]]
    assert one["variables"] == ["x9", "x10"] and one["x_value"] == {"desc": {"label": "flight"}, "data": ["1", "2", "10"]}
    assert np.allclose(one["y_values"][0]["data"], r, atol=1e-4) and one["ts_lists"][2] == ["10|x9", "10|x10"]


def test_a_folder_that_executors_share_is_needed_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = Context

    with pytest.raises(RuntimeError):
        scratch.shared_folder(Session)
    held = scratch.materialise(spark.range(5), "few")
    assert scratch.is_written(held) and not scratch.is_written(held.where("id > 1")) and held.count() == 5


def test_sides_are_broadcast_by_the_bytes_of_their_texts(spark):
    def side(prefix):
        return scratch.materialise(spark.range(40_000).select(F.concat(F.lit(prefix), "id").alias("series_id"), F.col("id").alias("n")), "side")

    # 40 MB of ids, which the driver holds twice, take a few hundred kB as a file
    assert joins.fits(side("s")) and not joins.fits(side("s" * 1000))


def test_spikes_of_long_ids_without_broadcast(points, monkeypatch):
    rng = np.random.default_rng(5)
    data = {name * 300: [(k * 3_600_000, x) for k, x in enumerate(rng.normal(size=200))] for name in "abc"}
    data["a" * 300][70] = (70 * 3_600_000, 99.0)
    want = spikes.implausible(points(data)).collect()
    sides, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda frame: sides.append(frame.columns) or broadcast(frame))
    monkeypatch.setattr(joins, "fits", lambda *_: False)
    monkeypatch.setattr(ranks, "fits", lambda *_: False)
    got = spikes.implausible(points(data)).collect()
    assert sorted(got) == sorted(want) and ("a" * 300, 70 * 3_600_000) in {(r.series_id, r.t) for r in got}
    assert sides and not any("series_id" in x for x in sides)
