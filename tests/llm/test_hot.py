"""Hot groups and large cells of the training-data operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import clusters, glyphs, leakage, mixing, neighbours, quantiles
from tidemill.operators.readings import DAY_MS


def test_cells_reached_are_all_within_the_ball():
    rng = np.random.default_rng(1)
    sample, rows = rng.normal(size=(3000, 5)), rng.normal(size=(2000, 5))
    cells = neighbours.Cells(sample, 60)
    asked, limit = rng.normal(size=(40, 5)), rng.uniform(0.05, 1.0, 40)
    home = cells.of(rows)
    who, cell = cells.reached(asked, limit)
    reached = set(zip(who.tolist(), cell.tolist()))
    assert len(reached) == len(who) < 40 * 60 and cells.share.sum() == pytest.approx(1)
    for k, q in enumerate(asked):
        near = ((rows - q) ** 2).sum(axis=1) <= limit[k]
        assert {(k, int(c)) for c in home[near]} <= reached
    assert {(k, int(c)) for k, c in enumerate(cells.of(asked))} <= reached


def test_more_cells_than_the_old_sample_would_shape(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    frame = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], "seq_id long, np_values array<double>")
    asked = spark.createDataFrame([(k, list(map(float, x[k] + 0.1 * rng.normal(size=16)))) for k in range(0, 1500, 60)], "pattern_id long, vector array<double>")
    rows = neighbours.most_similar(asked, frame, "pattern_id", "vector", "seq_id", "np_values", 16, 5, cell_rows=10).collect()
    z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True)
    q = np.array([r.vector for r in asked.orderBy("pattern_id").collect()])
    q = (q - q.mean(axis=1, keepdims=True)) / q.std(axis=1, keepdims=True)
    want = {(60 * i, int(j)) for i, r in enumerate(np.round(q @ z.T / 16, 6)) for j in np.lexsort((np.arange(1500), -r))[:5]}
    assert len(rows) == 125 and len({(r.pattern_id, r.seq_id) for r in rows} & want) >= 0.99 * len(want)


def test_a_cluster_of_a_third_of_all(spark):
    rng = np.random.default_rng(4)
    base, others = rng.normal(size=24), rng.normal(size=(200, 24))
    x = np.concatenate([base + rng.normal(0, 0.05, (60, 24)), np.repeat(base[None], 60, axis=0), others])
    frame = spark.createDataFrame([(f"s{k:03d}", list(map(float, v))) for k, v in enumerate(x)], "series_id string, course array<double>")
    rows = clusters.typical_members(clusters.alike_clusters(frame, local_rows=16), k=3).collect()
    top = max(rows, key=lambda r: r["size"])
    assert top["size"] == 120 and top.cluster_id == "s000" and sum(r["size"] for r in rows) == len(x) and top.leaves >= 1
    u = x[:120] - x[:120].mean(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    off = np.round(((u - u.mean(axis=0)) ** 2).sum(axis=1), 9)
    assert top.typical == [f"s{k:03d}" for k in np.lexsort((np.arange(120), off))[:3]] and abs(top.spread - off.mean()) < 1e-9


def test_components_that_do_not_settle_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(clusters, "ROUNDS", 1)
    frame = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long").repartition(8)
    with pytest.raises(RuntimeError):
        clusters.components(frame)


def test_unions_of_few_edges_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(clusters, "EDGES", 3)
    frame = spark.createDataFrame([(0, k) for k in range(1, 60)] + [(100 + k, 101 + k) for k in range(30)], "a long, b long").repartition(4)
    got = {r.node: r.component for r in clusters.components(frame).collect()}
    assert got == {k: 0 for k in range(60)} | {k: 100 for k in range(100, 131)}


def test_percentile_of_a_hot_series_in_parts(points):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=3000), np.full(900, 0.5)])
    rows = points({"a": [(k, x) for k, x in enumerate(v)], "b": [(k, float(k)) for k in range(40)]}).select("series_id", "v")
    spark = rows.sparkSession
    bounds = spark.createDataFrame([("a", 3900, -0.2, 3.0), ("b", 40, 10.0, 39.0)], "series_id string, n long, low double, high double")
    kept, quantiles.pick = quantiles.pick, lambda inner, spots, keys: kept(inner, spots, keys, held=50)
    try:
        got = {r.series_id: r.x for r in quantiles.exact_percentile(rows, bounds, ["series_id"], 0.8, "x").collect()}
    finally:
        quantiles.pick = kept
    assert got["a"] == pytest.approx(np.quantile(v, 0.8)) and got["b"] == pytest.approx(np.quantile(np.arange(40), 0.8))


def test_bounds_hold_on_given_data(points):
    rng = np.random.default_rng(6)
    v = rng.exponential(size=4000)
    rows = quantiles.checked_percentiles(points({"a": [(k * DAY_MS // 1000, x) for k, x in enumerate(v)], "b": [(1, 2.0)]})).collect()
    got = {r.series_id: r for r in rows}
    assert all(r.holds for r in rows) and got["a"].p99 == pytest.approx(np.quantile(v, 0.99)) and got["b"].p50 == 2.0


def test_copies_of_two_spellings(spark):
    texts = ["café au lait"] * 30 + ["café au lait"] * 20 + ["other"] * 5 + [None, ""]
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "other", "x")], "doc_id long, text string, look string")
    pairs = glyphs.lookalike_pairs(frame).collect()
    assert {tuple(r) for r in pairs} == {(a, b) for a in range(30) for b in range(30, 50)} and len(pairs) == 600
    rows = glyphs.lookalike_classes(frame).collect()
    assert len(rows) == 50 and {(r.copies, r.spellings, r.alike) for r in rows} == {(30, 2, 50), (20, 2, 50)} and len({r.look for r in rows}) == 1
    assert glyphs.lookalike_pairs(frame.where("false")).count() == glyphs.lookalike_classes(frame.where("false")).count() == 0


@pytest.mark.parametrize("meeting", [2_000_000, 5, 40])
def test_longest_run_of_repetitive_texts(monkeypatch, meeting):
    monkeypatch.setattr(leakage, "MEETING", meeting)
    rng = np.random.default_rng(meeting)
    for _ in range(80):
        a, b = (rng.integers(0, 2, rng.integers(0, 50)).astype(np.uint64) for _ in range(2))
        best, before = 0, np.zeros(len(b) + 1, int)
        for x in a:
            now = np.zeros(len(b) + 1, int)
            now[1:] = np.where(b == x, before[:-1] + 1, 0)
            best, before = max(best, now.max()), now
        assert leakage.longest_shared(a, b, 4) == (best if best >= 4 else 0)


def test_tokens_counted_once(spark):
    frame = spark.createDataFrame([(k, f"word {k}", " A\t" if k % 2 else "b", 9) for k in range(20)] + [(50, "x", None, 1), (51, "y", "c", 1)], "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 3), ("B", 0.5, 3)], "source string, target_share double, max_repeats int")
    sized = mixing.sized_documents(frame, targets)
    assert sized.count() == 20 and {r["key"] for r in sized.select("key").distinct().collect()} == {"a", "b"}
    plans = [mixing.mixing_plan(frame, targets, sized=s).collect() for s in (None, sized)]
    assert plans[0] == plans[1]
    plan = mixing.mixing_plan(frame, targets, sized=sized)
    rows = [sorted(map(tuple, mixing.mixed_sample(frame, plan, sized=s).collect())) for s in (None, sized)]
    assert rows[0] == rows[1] and mixing.sized_documents(frame, targets.where("false")).where(F.lit(True)).count() == 0
