"""Recursive filters as prefix scans: kernels against a loop over samples, channels in pieces against one trace."""

import time

import numpy as np
from pyspark.sql import functions as F

from strandline.functions import kernels as K
from strandline.operators import recursion

T0 = 1_577_836_800 * 10**9


def plain(b, a, x, z=None):
    n = max(len(a), len(b))
    b, a = (np.pad(np.asarray(c, float), (0, n - len(c))) / a[0] for c in (b, a))
    z = np.zeros(n - 1) if z is None else np.array(z, float)
    out = []
    for v in x:
        y = b[0] * v + z[0]
        z = np.append(z[1:], 0) + b[1:] * v - a[1:] * y
        out.append(y)
    return np.array(out), z


def test_blocks_equal_a_loop():
    rng = np.random.default_rng(1)
    for b, a in (K.butter(4, [0.1, 0.3], "bandpass"), K.butter(2, [0.2], "lowpass"), K.butter(3, [0.4], "highpass"), K.butter(2, [0.2, 0.3], "bandstop"), (np.array([1.0]), np.array([1.0, -0.999])), (np.array([0.0, 0.5, 0.1, 0.2]), np.array([2.0, -0.4]))):
        rows = K.sections_of(b, a)
        for n in (1, 100, 4095, 4096, 10_007):
            x = rng.standard_normal((2, n))
            y, end = K.sosfilt(rows, x)
            again, _ = K.sosfilt(rows, x[:, : n // 3])
            rest, last = K.sosfilt(rows, x[:, n // 3 :], K.sosfilt(rows, x[:, : n // 3])[1])
            for i in range(2):
                assert np.allclose(y[i], plain(b, a, x[i])[0], atol=1e-8)
            assert np.allclose(np.concatenate([again, rest], axis=1), y, atol=1e-9) and np.allclose(last, end, atol=1e-9)
    narrow = K.butter_sections(4, [0.002, 0.004], "bandpass")  # direct forms of order eight fail here
    y, _ = K.sosfilt(narrow, np.sin(np.pi * 0.003 * np.arange(200_000))[None])
    assert 0.9 < np.abs(y[0, -5000:]).max() < 1.1


def test_a_million_samples():
    b, a = K.butter(4, [0.1], "lowpass")
    x = np.random.default_rng(2).standard_normal((1, 1_000_000))
    took = []
    for _ in range(3):
        start = time.perf_counter()
        y = K.iir(x, 0.5, "lowpass", [0.1], 4, demean=False)
        took.append(time.perf_counter() - start)
    assert min(took) < 0.5 and np.allclose(y[0, :3000], plain(b, a, x[0, :3000])[0], atol=1e-9)


def test_channels_in_pieces(spark):
    rng = np.random.default_rng(3)
    b, a = K.butter(3, [0.15], "lowpass")
    rows, want = [], {}
    for code in ("A", "B", None):
        t = T0
        state, x = None, None
        for k in range(60):
            x = rng.standard_normal(int(rng.integers(1, 200)))
            if k % 17 == 9:
                t, state = t + 5 * 10**9, None  # a gap
            if k % 23 == 20:
                t, state = t - 3 * 10**9, None  # an overlap
            y, state = plain(b, a, x, state)
            want[code, t] = y
            rows.append((code, t, 1.0, x.tolist(), k))
            t += len(x) * 10**9
    rows += [("A", T0 - 10**12, 1.0, [], 0), ("C", T0, 1.0, None, 0), ("C", T0 + 10**9, 1.0, [1.0, None], 0), (None, None, 1.0, [1.0], 0)]
    df = spark.createDataFrame(rows, "codes string, tmin_ns long, deltat double, ydata array<double>, state long").repartition(7)
    for width in (40 * 10**9, 10**12, 10**16):
        got = recursion.filter_channels(df, K.butter_sections(3, [0.15], "lowpass"), ["codes"], width).collect()
        assert len(got) == len(rows)
        for r in got:
            if (r["codes"], r["tmin_ns"]) in want:
                assert np.allclose(r["ydata"], want[r["codes"], r["tmin_ns"]], atol=1e-9)
            else:
                assert r["ydata"] is None
    assert recursion.filter_channels(df.limit(0), K.sections_of(b, a), ["codes"]).count() == 0


def test_one_channel_over_many_tasks(spark):
    """Pieces of one channel are filtered in as many tasks as they are dealt to."""
    b, a = K.butter(2, [0.2], "lowpass")
    df = spark.range(400).select(F.lit("A").alias("codes"), (F.col("id") * 100 * 10**9 + T0).alias("tmin_ns"), F.lit(1.0).alias("deltat"), F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.sin(i * F.col("id"))).alias("ydata"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = recursion.filter_channels(df.repartition(8), K.sections_of(b, a), ["codes"], width=1000 * 10**9)
    got = np.concatenate([r["ydata"] for r in out.orderBy("tmin_ns").collect()])
    x = np.concatenate([r["ydata"] for r in df.orderBy("tmin_ns").collect()])
    assert np.allclose(got, plain(b, a, x)[0], atol=1e-9)
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
