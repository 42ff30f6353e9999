"""What counts as a valid reading, and helpers that split hot series by day."""

import random

from tidemill.operators import readings as R

POINTS = "series_id string, t long, v double, recv_ms long, chunk string, day_no string"
NAN = float("nan")


def test_newest_row_counts_and_nulls_are_left_out(spark):
    rows = [
        ("a", 1, 5.0, 10, "x", "y"), ("a", 1, 6.0, 20, "x", "y"), ("a", 2, 1.0, 10, None, None), ("a", 2, None, 11, None, None),
        ("a", 3, 1.0, 1, "", ""), ("a", 3, NAN, 2, "", ""), ("a", 4, 7.0, None, "", ""), ("a", 4, 8.0, 0, "", ""),
        ("a", 5, 2.0, 3, "", ""), ("a", 5, 2.0, 3, "", ""), (None, 5, 2.0, 3, "", ""), ("a", None, 2.0, 3, "", ""), ("b", 1, float("inf"), 1, "", ""),
    ]
    got = {(r.series_id, r.t, r.v) for r in R.valid_readings(spark.createDataFrame(rows, POINTS)).collect()}
    assert got == {("a", 1, 6.0), ("a", 4, 8.0), ("a", 5, 2.0), ("b", 1, float("inf"))}


def test_empty(spark):
    empty = spark.createDataFrame([], POINTS)
    valid = R.valid_readings(empty)
    assert valid.count() == 0
    assert R.consecutive(valid, opening=True).count() == 0
    assert R.ordinal(valid).count() == 0


def test_neighbours_and_positions_across_days(points):
    rng = random.Random(3)
    series = {s: [(t, t % 97) for t in sorted(rng.sample(range(0, 6 * R.DAY_MS, 60_000), n))] for s, n in (("a", 300), ("b", 1), ("c", 9))}
    valid = R.valid_readings(points(series))
    got = {(r.series_id, r.t): r.next_t for r in R.consecutive(valid, opening=True).collect()}
    for s, xs in series.items():
        times = [None, *(t for t, _ in xs), None]
        for a, b in zip(times, times[1:]):
            assert got[s, a] == b
    places = {(r.series_id, r.t): r.idx for r in R.ordinal(valid).collect()}
    assert all(places[s, t] == k for s, xs in series.items() for k, (t, _) in enumerate(xs))


def test_period_is_the_newest_readable_one(spark):
    series = spark.createDataFrame([("a", 1000), ("b", None), ("c", None), ("d", None)], "series_id string, ref_period long")
    rows = [("b", " QUAL_ref_period\t", "5e2", 1), ("b", "qual_ref_period", "7", 0), ("c", "qual_ref_period", "NaN", 5), ("e", "qual_ref_period", "3", 1), ("a", "qual_ref_period", "9", 1)]
    metadata = spark.createDataFrame(rows, "tsuid string, name string, value string, at long").selectExpr("tsuid", "name", "value", "timestamp_millis(at) as updated_at")
    from tidemill.functions.typed import number

    assert {r.series_id: r.period for r in R.period_of(series, metadata, number).collect()} == {"a": 1000, "b": 500, "e": 3}
