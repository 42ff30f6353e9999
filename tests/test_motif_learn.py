"""Motifs, clustering, classification, streams, sinks and the registry."""

import importlib.util
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemill.operators import learn, motif, symbolic
from tidemill.sources import sinks
from tidemill.streaming import downsample_stream, latest_reading_stream


@pytest.fixture(scope="module")
def words(spark):
    def make(*texts):
        return spark.createDataFrame([(w,) for w in texts], "word string")

    return make


def test_collisions(words):
    got = {(r.word_a, r.word_b): r.n for r in motif.collisions(words("aaaaa", "abbbb", "abccc", "abcdd", "abcde"), 2).collect()}
    assert got == {("abbbb", "abccc"): 1, ("abbbb", "abcdd"): 1, ("abbbb", "abcde"): 1, ("abccc", "abcdd"): 3, ("abccc", "abcde"): 3, ("abcdd", "abcde"): 6}
    many = {(r.word_a, r.word_b): (r.n, r.size_a, r.size_b) for r in motif.collisions(words(*["abcd"] * 50, "abce", "abce"), 2).collect()}
    assert many == {("abcd", "abce"): (3, 50, 2)}
    assert motif.collisions(words(), 2).count() == 0
    assert motif.masks_of(6, 2, 4, seed=1) == motif.masks_of(6, 2, 4, seed=1) and len(motif.masks_of(6, 2)) == 15
    with pytest.raises(ValueError):
        motif.masks_of(3, 4)


def test_expected_collisions():
    p = sum((1 - i / 5) ** 2 * math.comb(5, i) * 0.8**i * 0.2 ** (5 - i) for i in range(2))
    assert math.isclose(motif.expected_collisions(4, 5, 5, 1, 2, 10), min(9, p * 6 * 10))
    assert motif.expected_collisions(10**6, 2, 5, 1, 2, 10) == 9


def test_recognition_and_regex(words, spark):
    texts = ["abcde", "abcdd", "abcdc", "abcdb", "abcda"]
    table = symbolic.mindist_table([-1.1, -1, 0, 1.501])
    classes = motif.word_classes(words(*texts))
    cells = motif.collisions(words(*texts), 2)

    def distance(a, b):
        return math.sqrt(10 / 5) * math.sqrt(sum(table[ord(x) - 97][ord(y) - 97] ** 2 for x, y in zip(a, b)))

    for radius in (0.1, 1.9, 2.5, 3.5, 6.0):
        for brute in (False, True):
            got = {tuple(r.words) for r in motif.recognise(classes, cells, cells, table, 10, radius, brute).collect()}
            want = set()
            for i, a in enumerate(texts):
                for b in texts[i + 1 :]:
                    if distance(a, b) < radius:
                        want.add(tuple(sorted({a, b} | {w for w in texts if distance(w, a) < radius or distance(w, b) < radius})))
            assert got == want
    frame = spark.createDataFrame([(["abc", "abd"],), (["aaa"],), (["ab", "bb", "cb"],)], "words array<string>")
    assert [r[0] for r in frame.select(motif.pattern_regex(frame.words, 3)).collect()] == ["ab[cd]", "aaa", "*b"]


def test_motifs_find_a_repeated_shape(points):
    rng = np.random.default_rng(1)
    v = rng.normal(size=400)
    for at in (40, 200, 320):
        v[at : at + 20] = 6 * np.sin(np.arange(20) / 3) + 0.05 * rng.normal(size=20)
    settings = motif.MotifSettings(20, 0.75, 5, 4, linear_filter=None, radius=1.0)
    rows = motif.motifs(points({"a_b": [(1000 * k, x) for k, x in enumerate(v)]}), settings).collect()
    places = {}
    for r in rows:
        places.setdefault(r.pattern_id, set()).add(r.location.t // 1000)
    assert any({40, 200, 320} <= p for p in places.values())
    assert {r.location.series_id for r in rows} == {"a_b"} and all(len(r.location.paa) == 5 for r in rows)
    for bad in ({"paa": 1}, {"alphabet": 30}, {"collision_places": 9}, {"overlap": 1.0}, {"radius": 0}):
        with pytest.raises(ValueError):
            motif.MotifSettings(**{"size": 20, **bad}).checked()


def test_kmeans_and_projection(spark):
    rows = [("a", [0.0, 0.0]), ("b", [0.1, 0.0]), ("c", [9.0, 9.0]), ("d", [9.0, 9.1]), ("n", None), ("m", [None, 1.0])]
    frame = spark.createDataFrame(rows, "id string, x array<double>")
    members, centres = learn.kmeans(frame, "id", "x", 2, seed=3)
    of = {r.id: r.cluster for r in members.collect()}
    assert set(of) == {"a", "b", "c", "d"} and of["a"] == of["b"] != of["c"] == of["d"] and sorted(r["size"] for r in centres.collect()) == [2, 2]
    flat = {(r.id, r.cluster): (r.x, r.y) for r in learn.project(members, centres, "id").collect()}
    xy = {k[0]: v for k, v in flat.items() if k[0]}
    assert math.isclose(math.dist(xy["a"], xy["c"]), math.dist((0, 0), (9, 9)), rel_tol=1e-6) and sum(k[0] is None for k in flat) == 2
    one, _ = learn.kmeans(frame, "id", "x", 1)
    assert {r.cluster for r in one.collect()} == {0}
    few, _ = learn.kmeans(frame.where("id = 'a'"), "id", "x", 3)
    assert few.count() == 1
    for bad in (0, 1.5, True):
        with pytest.raises(ValueError):
            learn.kmeans(frame, "id", "x", bad)


def test_projection_of_many_vectors(spark):
    x = np.random.default_rng(9).normal(size=(3500, 5)) * [3, 1, 5, 0.5, 2] + 100
    members = spark.createDataFrame([(f"s{k}", k % 2, [float(y) for y in v]) for k, v in enumerate(x)], "id string, cluster int, vector array<double>")
    middles = [x[k::2].mean(axis=0) for k in range(2)]
    centres = spark.createDataFrame([(k, [float(y) for y in m], 1750) for k, m in enumerate(middles)], learn.CENTRES)
    got = {(r.id, r.cluster): (r.x, r.y) for r in learn.project(members, centres, "id").collect()}
    every = np.vstack([x, middles])
    u, s, _ = np.linalg.svd(every - every.mean(axis=0), full_matrices=False)
    want = (u * s)[:, :2]
    want *= np.sign(want[np.abs(want).argmax(axis=0), [0, 1]])
    assert len(got) == 3502 and np.allclose([got[f"s{k}", k % 2] for k in range(3500)], want[:3500]) and np.allclose([got[None, k] for k in range(2)], want[3500:])
    one = learn.project(members.select("id", "cluster", F.slice("vector", 1, 1).alias("vector")).limit(3), centres.where("false"), "id").collect()
    assert len(one) == 3 and all(r.y == 0 for r in one)
    assert learn.project(members.where("false"), centres.where("false"), "id").count() == 0


def test_registered_projection_has_every_series(spark, points, tmp_path):
    from tidemill.plans import series

    rng = np.random.default_rng(3)
    points({f"s{k}": [(1000 * t, y) for t, y in enumerate(rng.normal(size=20))] for k in range(9)}).write.parquet(str(tmp_path / "points.parquet"))
    rows = series.QUERIES["kmeans_projection"](spark, str(tmp_path)).collect()
    assert {r.series_id for r in rows} == {None, *(f"s{k}" for k in range(9))} and len(rows) == 12


def test_series_with_silences_have_clusters_and_words(spark, points, tmp_path):
    from tidemill.plans import series

    rng = np.random.default_rng(3)
    data = {f"s{k}": [(1000 * t, y) for t, y in enumerate(rng.normal(size=20))] for k in range(5)}
    data |= {"gappy": [(0, 1), (1000, 3), (50_000, 5), (80_000, 6)], "one": [(7, 2.5)]}
    frame = points(data)
    frame.write.parquet(str(tmp_path / "points.parquet"))
    assert {r.series_id: r.paa for r in symbolic.paa(frame, 4, fill=True).where("series_id in ('gappy', 'one')").collect()} == {"gappy": [2, 2, 5, 6], "one": [2.5] * 4}
    words = {r.series_id: r.word for r in symbolic.sax(frame, 8, 5, fill=True).collect()}
    assert set(words) == set(data) and all(len(w) == 8 for w in words.values()) and words["one"] == "aaaaaaaa"
    members = series.QUERIES["kmeans_paa"](spark, str(tmp_path)).collect()
    assert sorted(r.series_id for r in members) == sorted(data)
    met = series.QUERIES["collisions_all"](spark, str(tmp_path)).collect()
    seen = {w for r in met for w in (r.word_a, r.word_b)}
    assert {words["gappy"], words["one"]} <= seen and series.QUERIES["collision_threshold_all"](spark, str(tmp_path)).first().sequences == 7


def test_decision_tree(spark):
    rows = [(str(k), str(k % 10), float(k % 7), "low" if k % 10 < 5 else "high") for k in range(200)]
    frame = spark.createDataFrame(rows, "id string, x string, noise double, label string")
    model = learn.tree_fit(frame, "label", "id", 3, balanced=True)
    told = learn.tree_predict(model, frame, "label", "id")
    assert learn.accuracy(told) == 1.0
    cells = {(r.actual, r.predicted): r.n for r in learn.confusion(told).collect()}
    assert cells == {("high", "high"): 100, ("low", "low"): 100, ("high", "low"): 0, ("low", "high"): 0}
    assert "class = low" in learn.tree_dot(model, ["x", "noise"])
    grid, best = learn.tree_grid(frame, "label", "id", "1;3", "True;False", 3)
    got = grid.collect()
    assert len(got) == 4 and got[0]["rank"] == 1 and json.loads(best)["max_depth"] in (1, 3)
    assert learn.depths_of("range(3)") == [0, 1, 2] and learn.depths_of("range(6,4)") == [4, 5] and learn.depths_of("2;0") == [2, 0]
    with pytest.raises(ValueError):
        learn.tree_fit(frame, "missing", "id")


def test_streams_equal_batches(spark, tmp_path):
    base = 1_600_000_000_000
    rows = [("a", base + k * 1000, float(k), 0) for k in range(40)] + [("a", base + 5000, 5.0, 0), ("a", base + 9_990_000, 1.0, 0), ("b", base, None, 0)]
    schema = "series_id string, t long, v double, recv_ms long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, frame in (("slots", downsample_stream(source, 10_000, "avg")), ("once", latest_reading_stream(source))):
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("once").where("series_id = 'a'").count() == 41
    slots = {(r.series_id, r.t): r.v for r in spark.table("slots").collect()}
    assert len(slots) == 4 and all(math.isclose(slots["a", base + k * 10_000], k * 10 + (4.5 if k else 50 / 11)) for k in range(4))


def test_sinks(spark, tmp_path, points):
    pairs = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5)], "x string, y string, c double")
    sinks.write_matrix_csv(pairs, "x", "y", "c", ["a", "b"], str(tmp_path / "m"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("*.csv"))).splitlines()
    assert "row;a;b" in lines and "a;;0.5" in lines
    sinks.write_points(points({"a": [(2, 1), (1, 1)]}), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_registry():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert (importlib.util.find_spec("tidemill.llm") is not None) == ("p1_found" in queries)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
