"""The rolling archive: windows ready together, late channels, holds that end, restarts and expiry of state."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import codes as C
from strandline.streaming import rolling

S = 10**9
SCHEMA = "codes string, tmin_ns long, deltat double, ydata array<double>"


@pytest.fixture
def stream(spark, tmp_path):
    """feed(rows) adds chunks, runs the stream from its checkpoint until they are read, stops it and returns all rows given out so far."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    places = [str(tmp_path / p) for p in ("in", "out", "state")]

    def feed(rows, wait=0.0, **how):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(places[0])
        out = rolling.rolling(spark.readStream.schema(SCHEMA).parquet(places[0]), C.grouping_key(F.col("codes"), "station"), 10.0, **how)
        query = out.writeStream.format("parquet").option("path", places[1]).option("checkpointLocation", places[2]).trigger(processingTime="1 second").start()
        end = time.time() + 60
        while sum(p["numInputRows"] for p in query.recentProgress) < len(rows):
            assert time.time() < end and query.isActive
            time.sleep(0.1)
        time.sleep(wait)
        query.stop()
        return sorted((tuple(r) for r in spark.read.schema(rolling.SCHEMA).parquet(places[1]).collect()), key=lambda r: (r[6], *r[:4]))

    yield feed
    spark.conf.set(name, before)


def chunk(c, start, n, first=0.0):
    return f"XX.A..{c}.", start * S, 1.0, [first + i for i in range(n)]


def test_windows_and_restart(stream):
    assert stream([chunk("Z", 0, 15), chunk("N", 0, 8)]) == []  # the other channel hasn't passed the first window's end
    got = stream([chunk("N", 8, 7, 8.0), (None, 0, 1.0, [1.0]), ("XX.A..E.", 0, 1.0, []), ("XX.A..E.", 0, 1.0, None)])  # run from the checkpoint
    ten = [float(i) for i in range(10)]
    assert got == [("XX.A", 0, "XX.A..N.", 0, 1.0, ten, False), ("XX.A", 0, "XX.A..Z.", 0, 1.0, ten, False)]
    got = stream([chunk("Z", 15, 6, 15.0), chunk("N", 17, 4, 17.0), chunk("E", 5, 2, 1.0)])  # a gap, and a channel that comes late
    assert [r[2:] for r in got if r[6]] == [("XX.A..E.", 5 * S, 1.0, [1.0, 2.0], True)]
    second = [(r[2], r[3] // S, r[5]) for r in got if r[1] == 10 * S]  # two of three agree, so that the new one holds up nothing
    assert second == [("XX.A..N.", 10, [10.0, 11.0, 12.0, 13.0, 14.0]), ("XX.A..N.", 17, [17.0, 18.0, 19.0]), ("XX.A..Z.", 10, [float(i) for i in range(10, 20)])]


def test_late_channels_hold_for_their_patience(stream):
    rows = [chunk(c, 0, 30) for c in "ZNEF"] + [chunk("G", 0, 3)]
    got = stream(rows, hold=600.0)
    assert len(got) == 4 * 3 + 1  # most channels agree, so that one is not waited for
    assert [r for r in got if r[2] == "XX.A..G."] == [("XX.A", 0, "XX.A..G.", 0, 1.0, [0.0, 1.0, 2.0], False)]


def test_hold_ends_and_state_expires(stream):
    how = {"hold": 3.0, "keep": 6.0, "wait": 12.0}
    got = stream([chunk("Z", 0, 15), chunk("N", 0, 2)], **how)
    # nothing was ready, and after three seconds everything was given out
    assert {(r[2], r[3], len(r[5]), r[6]) for r in got} == {("XX.A..Z.", 0, 10, False), ("XX.A..Z.", 10 * S, 5, False), ("XX.A..N.", 0, 2, False)}
    got = stream([chunk("Z", 20, 10, 7.0)], **how | {"wait": 0.0})
    assert [(r[2], r[3], len(r[5])) for r in got[3:]] == [("XX.A..Z.", 20 * S, 10)]  # the silent channel is gone and holds up nothing


def test_parts():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, step, size, t = int(rng.integers(1, 60)), int(rng.integers(1, 9)), int(rng.integers(1, 40)), int(rng.integers(-200, 200))
        y = np.arange(n, dtype=float)
        parts = list(rolling.cut_at_windows(t, step, y, size))
        assert np.concatenate([p[2] for p in parts]).tolist() == y.tolist()
        assert all(w <= a and a + (len(p) - 1) * step < w + size and w % size == 0 and p[0] == (a - t) / step for w, a, p in parts)
    assert rolling.ready_before([50], 1.0) == 50 and rolling.ready_before([10, 30], 1.0) == 10
    assert rolling.ready_before([100, 100, 100, 0], 1.0) == 100 and rolling.ready_before([100, 98, 96, 94, 0], 1.0) == 92
