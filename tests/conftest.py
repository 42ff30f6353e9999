import pytest

from tidemill.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def points(spark):
    """A function from ``{series: [(t, v), ...]}`` to a table of readings."""

    def make(series):
        rows = [(s, int(t), None if v is None else float(v), int(t) + 5) for s, xs in series.items() for t, v in xs]
        return spark.createDataFrame(rows, "series_id string, t long, v double, recv_ms long")

    return make


@pytest.fixture(scope="session")
def values():
    """Values by series in order of time."""

    def read(frame, column="v"):
        out = {}
        for r in frame.orderBy("series_id", "t").collect():
            out.setdefault(r["series_id"], []).append((r["t"], r[column]))
        return out

    return read
