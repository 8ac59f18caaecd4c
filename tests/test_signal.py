"""Kernels, joins of traces, streams and files against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import kernels as K
from strandline.functions import response as R
from strandline.operators import greens, intervals, joining, pairs, signal
from strandline.sources import mseed, sac, tables
from strandline.streaming import chunks

T0 = 1_600_000_000_000_000_000


def gain(b, a, f):
    z = np.exp(-1j * np.pi * np.asarray(f))
    return abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z))


@pytest.mark.parametrize("order", [1, 2, 4, 5])
def test_butterworth(order):
    half = np.sqrt(0.5)
    assert gain(*K.butter(order, [0.3], "lowpass"), [0, 0.3, 1]) == pytest.approx([1, half, 0], abs=1e-6)
    assert gain(*K.butter(order, [0.3], "highpass"), [0, 0.3, 1]) == pytest.approx([0, half, 1], abs=1e-6)
    assert gain(*K.butter(order, [0.2, 0.4], "bandpass"), [0, 0.2, 0.4, 1]) == pytest.approx([0, half, half, 0], abs=1e-6)
    assert gain(*K.butter(order, [0.2, 0.4], "bandstop"), [0, 0.2, 0.4, 1]) == pytest.approx([1, half, half, 1], abs=1e-6)
    b, a = K.cheby1(order, 0.05, 0.4)
    assert gain(b, a, [0.4]) == pytest.approx([10 ** (-0.05 / 20)], abs=1e-6)


def slow_filter(b, a, x):
    y = np.zeros(len(x))
    for i in range(len(x)):
        y[i] = sum(b[k] * x[i - k] for k in range(len(b)) if i >= k) - sum(a[k] * y[i - k] for k in range(1, len(a)) if i >= k)
    return y


def test_lfilter_and_its_state():
    x = np.random.default_rng(1).standard_normal((3, 80))
    for b, a in (K.butter(3, [0.2], "lowpass"), (np.ones(7) / 7, np.array([1.0])), (np.array([2.0]), np.array([1.0]))):
        whole, _ = K.lfilter(b, a, x)
        assert np.allclose(whole[1], slow_filter(b, a, x[1]))
        z, parts = None, []
        for lo, hi in ((0, 5), (5, 6), (6, 50), (50, 80)):
            y, z = K.lfilter(b, a, x[:, lo:hi], z)
            parts.append(y)
        assert np.allclose(np.concatenate(parts, axis=1), whole)


def test_spectral_kernels():
    t = np.arange(400) * 0.01
    y = np.stack([np.sin(2 * np.pi * 5 * t), np.sin(2 * np.pi * 20 * t)])
    assert np.allclose(K.envelope(y, 0.01), 1)
    assert np.allclose(K.bandpass_fft(y, 0.01, 3, 8), [y[0], 0 * t], atol=1e-9)
    assert np.allclose(K.resample(y[:1], 0.01, 0.005)[:, ::2], y[:1])
    d = K.transfer(y, 0.01, R.multiply(R.differentiation(), R.integration()), None)
    assert np.allclose(d, y, atol=1e-6)
    back = K.transfer(K.transfer(y, 0.01, R.butterworth(30, 2)), 0.01, R.butterworth(30, 2), invert=True)
    assert np.abs(back - y)[:, 50:350].max() < 0.2
    c, first = K.correlate(np.array([1.0, 2]), np.array([0.0, 1, 2, 0]))
    assert c[np.argmax(c)] == 5 and first + int(np.argmax(c)) == 1
    assert list(K.correlate(np.ones(2), np.ones(4), "valid")[0]) == [2, 2, 2]
    assert K.peaks(np.array([0, 3, 5, 1, 4, 0.0]), 1.0, 2.0, 2.0, 1.5) == ([2, 4], [5.0, 4.0])
    assert K.top_peaks(np.array([0, 3, 5, 1, 4, 0.0]), 1.0, 0.5, 1.0) == ([2, 4], [5.0, 4.0])


def test_responses():
    f = np.array([0.1, 1.0, 7.0])
    s = 2j * np.pi * f
    assert np.allclose(R.pole_zero([1], [-2, -3], 4)(f), 4 * (s - 1) / ((s + 2) * (s + 3)))
    assert np.allclose(np.abs(R.butterworth(1.0, 3)(f))[1], np.sqrt(0.5)) and np.allclose(R.inverse(R.gain(4))(f), 0.25)
    assert np.allclose(R.converter("displacement", "acceleration")(f), s**2) and np.allclose(R.converter("velocity", "displacement")(f), 1 / s)
    assert np.allclose(R.analog([1, 0], [1, 2])(f), s / (s + 2)) and np.allclose(np.abs(R.digital_butterworth(1.0, 2, 0.05)(f))[1], np.sqrt(0.5), atol=1e-6)
    assert np.allclose(R.sampled([0, 10], [0, 10])(f), f)


def frame(spark, rows):
    return spark.createDataFrame([(c, T0 + t * 500_000_000, 0.5, [float(v) for v in y]) for c, t, y in rows], "codes string, tmin_ns long, deltat double, ydata array<double>")


def got(df):
    return sorted((r["codes"], (r["tmin_ns"] - T0) // 500_000_000, r["ydata"]) for r in df.collect())


def test_degap(spark):
    df = frame(spark, [("a", 0, [1, 2]), ("a", 2, [3, 4]), ("a", 6, [7, 8]), ("a", 7, [20, 9]), ("a", 40, [1]), ("b", 1, [5]), ("b", 1, []), ("a", 6, [7, 8])])
    assert got(joining.degap(df, ["codes"])) == [("a", 0, [1, 2, 3, 4, 5, 6, 7, 20, 9]), ("a", 40, [1]), ("b", 1, [5])]
    assert got(joining.degap(df, ["codes"], fill="zeros", overlap="use_first"))[0] == ("a", 0, [1, 2, 3, 4, 0, 0, 7, 8, 9])
    assert got(joining.degap(df, ["codes"], overlap="add"))[0][2][-3:] == [7, 28, 9]  # the repeated piece ends no later: it goes
    far = frame(spark, [("a", 0, [1]), ("a", 1, [2])]).withColumn("tmin_ns", F.col("tmin_ns") + F.when(F.get("ydata", F.lit(0)) == 2, 100_000_000).otherwise(0))
    assert joining.degap(far, ["codes"]).count() == 2


def test_deoverlap(spark):
    df = frame(spark, [("a", 0, [1, 2, 3]), ("a", 1, [9, 9, 9, 9, 9]), ("a", 2, [7])])
    assert got(joining.deoverlap(df, ["codes"])) == [("a", 0, [1]), ("a", 1, [9] * 5)]
    assert got(joining.deoverlap(df, ["codes"], "first")) == [("a", 0, [1, 2, 3]), ("a", 3, [9, 9, 9])]
    inner = frame(spark, [("a", 3, [5, 5]), ("a", 0, [1] * 9)])
    assert got(joining.deoverlap(inner.where("size(ydata) = 2").unionAll(inner), ["codes"], "longest")) == [("a", 0, [1] * 9)]


def test_merge_archives(spark):
    a, b = frame(spark, [("x", 2, [1, 1]), ("y", 0, [3])]), frame(spark, [("x", 0, [2] * 7), ("z", 0, [4])])
    assert got(joining.merge_archives(a, b, ["codes"])) == [("x", 0, [2, 2, 1, 1, 2, 2, 2]), ("y", 0, [3]), ("z", 0, [4])]


def test_interval_join_brute_force(spark):
    rng = np.random.default_rng(5)
    def spans(n):
        start = rng.integers(0, 10**14, n)
        return [(int(i), int(s), int(s + 10 ** rng.uniform(0, 17)) if rng.random() > 0.2 else int(s)) for i, s in enumerate(start)]

    c, q = spans(120), spans(80)
    cdf = spark.createDataFrame(c, "i long, tmin_ns long, tmax_ns long").withColumn("k", F.col("i") % 2)
    qdf = spark.createDataFrame(q, "j long, qmin_ns long, qmax_ns long").withColumn("k", F.col("j") % 2)
    want = sorted((i, j) for i, a, b in c for j, u, v in q if i % 2 == j % 2 and a < max(v, u + 1) and max(b, a + 1) > u)
    assert sorted(tuple(r) for r in intervals.interval_join(cdf, qdf, ["k"]).select("i", "j").collect()) == want
    assert intervals.interval_join(cdf.limit(0), qdf, ["k"]).count() == 0


def test_project_blocks():
    m = [[0.6, -0.8, 0], [0.8, 0.6, 0], [0, 0, 1]]
    assert pairs.independent_parts(m, list("NEZ"), list("ABU")) == [([0, 1], [0, 1]), ([2], [2])]


def test_filters_on_frames(spark):
    y = np.random.default_rng(3).standard_normal(60)
    df = frame(spark, [("a", 0, y), ("b", 3, y[:40]), ("c", 0, [])]).withColumn("x", F.lit(1))
    out = {r["codes"]: r["ydata"] for r in signal.lowpass(df, 0.3, 3).collect()}
    b, a = K.butter(3, [0.3], "lowpass")
    assert np.allclose(out["a"], slow_filter(b, a, y - y.mean())) and len(out["b"]) == 40 and out["c"] is None
    d = {r["codes"]: r for r in signal.downsample(df, 4).collect()}
    assert d["a"]["deltat"] == 2.0 and d["a"]["tmin_ns"] % 2_000_000_000 == 0 and len(d["a"]["ydata"]) == 15
    s = signal.spectrum(df.where("codes = 'a'")).first()
    assert np.allclose(np.array(s["re"]) + 1j * np.array(s["im"]), np.fft.rfft(y)) and np.allclose(s["freq"], np.fft.rfftfreq(60, 0.5))


def test_delayed_sum_brute_force(spark):
    rng = np.random.default_rng(7)
    store = {i: (int(rng.integers(-3, 4)), rng.standard_normal(rng.integers(1, 6))) for i in range(6)}
    terms = [(int(t), int(rng.integers(0, 6)), float(rng.uniform(0, 3)), float(rng.standard_normal())) for t in range(3) for _ in range(4)]
    sdf = spark.createDataFrame([(i, a, [float(v) for v in y]) for i, (a, y) in store.items()], "irecord long, itmin int, data array<double>")
    tdf = spark.createDataFrame(terms, "target long, irecord long, delay double, weight double")
    out = {(r["target"], r["it"]): r["y"] for r in greens.delayed_sum(sdf, tdf, ["target"], 0.5).collect()}
    for t in range(3):
        own = []
        for _, i, d, w in (x for x in terms if x[0] == t):
            k, f = int(np.floor(d / 0.5)), d / 0.5 - np.floor(d / 0.5)
            own += [(store[i], k, w * (1 - f)), (store[i], k + 1, w * f)]
        its = [it for (u, it) in out if u == t]
        for it in its:
            want = sum(w * y[min(max(it - a - k, 0), len(y) - 1)] for (a, y), k, w in own)
            assert out[(t, it)] == pytest.approx(want)


def test_stf_weights():
    for kind in ("boxcar", "triangular", "half_sinusoid"):
        w = greens.stf_weights(kind, 4.0, 0.5)
        assert sum(x for _, x in w) == pytest.approx(1) and sum(t * x for t, x in w) == pytest.approx(-0.0, abs=1e-9)
    assert greens.stf_weights("boxcar", 0, 0.5) == [(0.0, 1.0)]


def stream(spark, tmp_path, rows, op, name):
    for i, batch in enumerate(rows):
        frame(spark, batch).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    source = spark.readStream.schema(chunks.SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = op(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return got(spark.table(name))


def test_stream_filter_equals_one_shot(spark, tmp_path):
    y = np.random.default_rng(2).standard_normal(30)
    b, a = K.butter(2, [0.3], "lowpass")
    out = stream(spark, tmp_path, [[("a", 0, y[:10]), ("b", 0, y[:5])], [("a", 10, y[10:17]), ("b", 9, y[5:9])], [("a", 17, y[17:])]], lambda s: chunks.lfilter(s, b, a), "filtered")
    assert np.allclose(np.concatenate([o[2] for o in out if o[0] == "a"]), slow_filter(b, a, y))
    assert np.allclose([o[2] for o in out if o[:2] == ("b", 9)][0], slow_filter(b, a, y[5:9]))  # a gap: anew


def test_stream_fixation(spark, tmp_path):
    out = stream(spark, tmp_path, [[("a", 3, range(4))], [("a", 7, range(4, 12))]], lambda s: chunks.fixate(s, 2.0), "fixed")
    assert [o[1] for o in out] == [3, 4, 8] and sum((o[2] for o in out), []) == [float(v) for v in range(9)]


def test_ready(spark):
    df = spark.createDataFrame([(t,) for t in (10, 12, 14, 100)], "t_ns long")
    assert chunks.ready_until(df).first()["ready_ns"] == 13 - 2 * 2


def test_mseed(spark, tmp_path):
    y = np.random.default_rng(1).standard_normal(1200)
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.mseed").write_bytes(mseed.encode("XX.ABC..HHZ", T0 + 123_456_000, 0.01, y))
    df = mseed.read(spark, str(tmp_path / "m"))
    assert df.count() == 3
    one = joining.degap(df, ["codes"]).first()
    assert one["codes"] == "XX.ABC..HHZ." and one["tmin_ns"] == T0 + 123_456_000 and one["ydata"] == list(y) and one["deltat"] == 0.01


def test_steim():
    import struct

    y = [5, 6, 4, 100, 90, -200, 70000]
    d = [0, 1, -2, 96, -10, -290, 70200]
    words = [0, y[0] & 0xFFFFFFFF, y[-1], struct.unpack(">I", struct.pack(">4b", *d[:4]))[0], struct.unpack(">I", struct.pack(">2h", *d[4:6]))[0], d[6]]
    words[0] = 1 << (30 - 2 * 3) | 2 << (30 - 2 * 4) | 3 << (30 - 2 * 5)
    assert list(mseed.steim(struct.pack(">16I", *words, *[0] * 10), 7, 1)) == y
    small = [3, 3, 4, 2, 2, 1, 0]
    w = 0
    for v in np.diff([3, *small]):
        w = w << 4 | (int(v) & 15)
    words = [3 << (30 - 2 * 3), 3, 0, 2 << 30 | w]
    assert list(mseed.steim(struct.pack(">16I", *words, *[0] * 12), 7, 2)) == small
    with pytest.raises(ValueError):
        mseed.steim(struct.pack(">16I", *words[:2], 9, words[3], *[0] * 12), 7, 2)


def test_sac(spark, tmp_path):
    y = np.arange(20, dtype=float)
    (tmp_path / "a.sac").write_bytes(sac.encode("XX.STA.00.BHZ", T0 + 250_000_000, 0.05, y))
    r = sac.read(spark, str(tmp_path)).first()
    assert (r["codes"], r["tmin_ns"], r["deltat"], r["ydata"], r["stla"]) == ("XX.STA.00.BHZ.", T0 + 250_000_000, 0.05, list(y), None)


def test_text_sources(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# comment\nXX.AA. 1.5 2 3 0 Some place\n\nXX.BB.10 -4 5 x 0\n")
    rows = tables.read_stations_text(spark, str(tmp_path / "s.txt")).orderBy("station").collect()
    assert [(r["station"], r["location"], r["lat"], r["elevation"], r["description"]) for r in rows] == [("AA", "", 1.5, 3.0, "Some place"), ("BB", "10", -4.0, None, "")]
    (tmp_path / "e.txt").write_text("name = one\ntime = 2020-01-01 00:00:01.5\nlatitude = 1\n----------\nname = two\ntime = 2020-01-02 00:00:00\nmagnitude = 5.5\n------\n")
    rows = tables.read_events_text(spark, str(tmp_path / "e.txt")).orderBy("name").collect()
    assert [(r["name"], r["time_ns"], r["lat"], r["magnitude"]) for r in rows] == [("one", 1577836801500000000, 1.0, None), ("two", 1577923200000000000, None, 5.5)]
    (tmp_path / "p.txt").write_text("#Network | Station|Lat\nXX|AA|1\n")
    assert tables.read_pipe_table(spark, str(tmp_path / "p.txt")).first().asDict() == {"network": "XX", "station": "AA", "lat": "1"}
    (tmp_path / "x.xml").write_text('<FDSNStationXML><Network code="XX"><Station code="AA"><Channel code="HHZ" locationCode="" startDate="2020-01-01T00:00:00Z"><Latitude>1</Latitude><Longitude>2</Longitude><Elevation>3</Elevation><Depth>0</Depth><Azimuth>0</Azimuth><Dip>-90</Dip><SampleRate>100</SampleRate></Channel></Station></Network></FDSNStationXML>')
    r = tables.read_stationxml(spark, str(tmp_path / "x.xml")).first()
    assert (r["network"], r["station"], r["location"], r["channel"], r["dip"], r["rate"], r["tmin_ns"], r["tmax_ns"]) == ("XX", "AA", "", "HHZ", -90.0, 100.0, 1577836800000000000, None)


def test_archive(spark, tmp_path):
    day = 86_400 * 10**9
    df = spark.createDataFrame([("XX.A..Z.", T0 // day * day + day - 2 * 10**9, 1.0, [1.0, 2.0, 3.0, 4.0, 5.0])], "codes string, tmin_ns long, deltat double, ydata array<double>")
    tables.save_archive(df, str(tmp_path / "arc"))
    back = tables.read_archive(spark, str(tmp_path / "arc"))
    assert sorted(r["ydata"] for r in back.collect()) == [[1, 2], [3, 4, 5]]
    assert [r["ydata"] for r in joining.degap(back.select(*df.columns), ["codes"]).collect()] == [[1, 2, 3, 4, 5]]


def test_stretch_and_delay(spark):
    t = np.arange(300)
    y = np.sin(2 * np.pi * t / 20)
    at = np.linspace(60, 240, 500)
    assert np.allclose(K.stretch(y[None], at)[0], np.sin(2 * np.pi * at / 20), atol=1e-4)
    assert np.allclose(K.stretch(y[None], t.astype(float))[0], y)
    x = np.random.default_rng(1).standard_normal(2000)
    late = K.stretch(x[None], np.arange(2000) - 7.3)[0]
    d, c, spread = K.delay(x, late, 0.1)
    assert d == pytest.approx(0.73, abs=0.01) and c > 0.5
    df = frame(spark, [("a", 0, y)]).withColumn("end_ns", F.col("tmin_ns") + 299 * 501_000_000)
    r = signal.antidrift(df, "tmin_ns", "end_ns").first()
    inner = np.arange(60, 240)
    assert np.allclose(np.array(r["ydata"])[inner], np.sin(2 * np.pi * inner * 0.5 / 0.501 / 20), atol=1e-4)


def test_pole_zero_files(spark, tmp_path):
    from strandline.operators import metadata

    (tmp_path / "a.pz").write_text("* comment\nZEROS 3\n-1.0 2.0\nPOLES 2\n-0.2 0.2\n-0.2 -0.2\nCONSTANT 1.5e3\n")
    r = metadata.read_pole_zero_files(spark, str(tmp_path)).first()
    assert [(z["re"], z["im"]) for z in r["zeros"]] == [(-1.0, 2.0), (0.0, 0.0), (0.0, 0.0)]
    assert [(p["re"], p["im"]) for p in r["poles"]] == [(-0.2, 0.2), (-0.2, -0.2)] and r["gain"] == 1500.0


def test_station_text_round_trip(spark, tmp_path):
    from strandline.operators import metadata

    df = spark.createDataFrame([("XX", "AA", "", 1.5, -2.0, 3.0, 0.0, "a b"), ("XX", "BB", "10", 0.0, 0.0, 1.0, 2.0, None)], "network string, station string, location string, lat double, lon double, elevation double, depth double, description string")
    metadata.write_stations_text(df, str(tmp_path / "out"))
    back = tables.read_stations_text(spark, str(tmp_path / "out")).orderBy("station").collect()
    assert [(r["station"], r["location"], r["lat"], r["description"]) for r in back] == [("AA", "", 1.5, "a b"), ("BB", "10", 0.0, "")]


def test_contains(spark):
    from strandline.operators import metadata

    df = spark.createDataFrame([(1, 9, 2, 8), (1, 9, 0, 8), (None, 9, None, 9), (None, None, 1, None), (1, None, None, 5), (1, 9, 2, None)], "a long, b long, c long, d long")
    assert [r[0] for r in df.select(metadata.contains(*map(F.col, "abcd"))).collect()] == [True, False, True, True, False, False]


def test_kagan_angle():
    from strandline.operators import mechanisms as M

    rng = np.random.default_rng(2)
    m6 = rng.standard_normal((40, 6))
    a = M.matrices(m6)
    assert np.allclose(M.kagan_angle(a, a), 0, atol=1e-3)
    axis = np.array([0, 0, 1.0])
    for deg in (10, 35):
        c, s = np.cos(np.radians(deg)), np.sin(np.radians(deg))
        r = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
        assert np.allclose(M.kagan_angle(a, r @ a @ r.T), deg, atol=1e-4) and axis @ r @ axis == 1
    parts = M.decompose(a)
    assert np.allclose(parts[:, 0], parts[:, 1] + parts[:, 2]) and np.allclose(parts[:, 2], parts[:, 3] + parts[:, 4]) and (parts >= -1e-12).all()


def test_files_are_told_apart(spark, tmp_path):
    from strandline.sources import files, sac

    y = np.arange(100.0)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.mseed").write_bytes(mseed.encode("XX.AB..BHZ.", T0, 0.5, y))
    (tmp_path / "b.sac").write_bytes(sac.encode("XX.CD..BHZ.", T0, 0.5, y))
    (tmp_path / "c.xml").write_text("<?xml version='1.0'?><FDSNStationXML/>")
    (tmp_path / "d.txt").write_text("none of these")
    kinds = {r["path"].rsplit("/", 1)[1]: r["format"] for r in files.detect(spark, str(tmp_path)).collect()}
    assert kinds == {"a.mseed": "mseed", "b.sac": "sac", "c.xml": "stationxml", "d.txt": None}
    rows = files.load(spark, str(tmp_path)).collect()
    assert sorted(r["codes"] for r in rows) == ["XX.AB..BHZ.", "XX.CD..BHZ."] and all(list(r["ydata"]) == list(y) for r in rows)
    assert files.load(spark, str(tmp_path / "b.sac"), "sac").count() == 1
    chosen = files.select_files(spark, str(tmp_path), r"/[abd]\.", "txt$").collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in chosen) == ["a.mseed", "b.sac"]
