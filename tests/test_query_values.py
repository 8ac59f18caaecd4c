"""Queries that SQL can't express, against plain versions of what they compute: trace by trace, with sums over frequencies."""

import __spark_entry__ as entry
import duckdb
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
MADE = entry._own()[0]
DT = 0.5


@pytest.fixture(scope="module")
def ys():
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    return {i: np.array(v, float) for i, v in rows}


def dft(y, n=None):
    """Coefficients of all whole frequencies, by the sum itself."""
    y = np.pad(y, (0, (n or len(y)) - len(y)))
    k = np.arange(len(y))
    return np.exp(-2j * np.pi * np.outer(k, k) / len(y)) @ y


def back(c):
    k = np.arange(len(c))
    return np.exp(2j * np.pi * np.outer(k, k) / len(c)) @ c / len(c)


def signed(n):
    k = np.arange(n)
    return np.where(k > n / 2, k - n, k) / (n * DT)


def shaped(y, h, n=None):
    """y with its spectrum times h(frequency) on the positive side and the conjugate on the other."""
    c = dft(y, n)
    f = signed(len(c))
    g = np.array([h(v) if v >= 0 else np.conj(h(-v)) for v in f])
    if len(c) % 2 == 0:
        g[len(c) // 2] = np.real(g[len(c) // 2])
    return back(c * g).real[: len(y)]


def butterworth(y, kind, corners, order=4):
    """The response of the bilinear design, from the analog prototype, over a span long enough to forget."""
    n = 1 << 13
    f = np.fft.rfftfreq(n, DT)
    with np.errstate(divide="ignore", invalid="ignore"):
        s = 4j * np.tan(np.pi * f * DT)
        w = [4 * np.tan(np.pi * c * DT) for c in corners]
        p = {"low": s / w[0], "high": w[0] / s}.get(kind)
        if p is None:
            p = (s * s + w[0] * w[1]) / (s * (w[1] - w[0]))
            p = p if kind == "band" else 1 / p
        poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
        h = np.prod([-q / (p - q) for q in poles], axis=0)
    h[~np.isfinite(h)] = 0
    return np.fft.irfft(np.fft.rfft(y - y.mean(), n) * h, n)[: len(y)]


def analytic(y):
    c, f = dft(y), signed(len(y))
    return back(c * np.where(f < 0, 0, np.where((f == 0) | (np.arange(len(y)) == len(y) // 2), 1, 2)))


def whiten(y, order=6):
    x = y - y.mean()
    r = [sum(x[i] * x[i + k] for i in range(len(x) - k)) / len(x) for k in range(order + 1)]
    c = np.linalg.solve([[r[abs(i - j)] for j in range(order)] for i in range(order)], r[1:])
    return np.array([x[i] - sum(c[k] * x[i - 1 - k] for k in range(order) if i > k) for i in range(len(x))])


def spectral_whiten(y, width):
    c = dft(y - y.mean())
    half = np.abs(c[: len(y) // 2 + 1])
    k = max(1, round(width * len(y) * DT)) | 1
    smooth = [np.mean([half[min(max(i + j, 0), len(half) - 1)] for j in range(-(k // 2), k // 2 + 1)]) for i in range(len(half))]
    return back(c / np.array([smooth[min(i, len(y) - i)] for i in range(len(y))])).real


def sta_lta(y):
    s = l = 0.0
    out = []
    for v in y:
        s += DT / 1.0 * (v * v - s)
        l += DT / 5.0 * (v * v - l)
        out.append(s / l if l else s)
    return np.array(out)


def finer(y, factor):
    c, n = dft(y), len(y)
    t = np.arange(n * factor) / factor
    out = np.full(n * factor, c[0].real / n) + c[n // 2].real / n * np.cos(np.pi * t)
    for k in range(1, n // 2):
        out += 2 / n * (c[k] * np.exp(2j * np.pi * k * t / n)).real
    return out


def fade(f, a, b, c, d):
    up, down = np.clip((f - a) / (b - a), 0, 1), np.clip((d - f) / (d - c), 0, 1)
    return (0.5 - 0.5 * np.cos(np.pi * up)) * (0.5 - 0.5 * np.cos(np.pi * down))


def transfer(y):
    poles = np.exp(1j * np.pi * np.array([4, 6, 8]) / 6)
    return shaped(y - y.mean(), lambda f: fade(f, 0.01, 0.02, 0.6, 0.9) * np.exp(-1j * np.pi * f) / np.prod(1j * f / 0.3 - poles))


def restitution(y):
    x = y - y.mean()
    for i in range(4):
        ramp = 0.5 - 0.5 * np.cos(np.pi * i / 4)
        x[i], x[63 - i] = x[i] * ramp, x[63 - i] * ramp

    def h(f):
        s = 2j * np.pi * f
        return fade(f, 0.02, 0.05, 0.5, 0.8) * ((s + 0.2) ** 2 + 0.04) / (2 * s * s) if f else 0

    return shaped(x, h)


PLAIN = {
    "filter_lowpass": lambda y: butterworth(y, "low", [0.3]),
    "filter_highpass": lambda y: butterworth(y, "high", [0.2]),
    "filter_bandpass": lambda y: butterworth(y, "band", [0.1, 0.5]),
    "filter_bandstop": lambda y: butterworth(y, "stop", [0.3, 0.5]),
    "filter_bandpass_fft": lambda y: shaped(y, lambda f: float(0.1 <= f <= 0.5)),
    "envelope": lambda y: np.abs(analytic(y)),
    "whiten": whiten,
    "spectral_whiten": lambda y: spectral_whiten(y, 0.1),
    "recursive_sta_lta": sta_lta,
    "resample": lambda y: finer(y, 2),
    "transfer": transfer,
    "restitution": restitution,
}


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_values(name, spark, ys):
    rows = MADE[name](spark, SF).collect()
    assert {r["trace_id"] for r in rows} == set(ys)
    for r in rows:
        want = PLAIN[name](ys[r["trace_id"]])
        assert r["n"] == len(want)
        scale = np.abs(want).sum() + 1e-3
        assert abs(r["total"] - want.sum()) < 1e-4 * scale + 2e-6 and r["energy"] == pytest.approx((want * want).sum(), rel=2e-4, abs=2e-6)


def test_filter_bank(spark, ys):
    got = {}
    for r in MADE["filter_bank"](spark, SF).collect():
        got.setdefault(r["trace_id"], []).append(r["energy"])
    for i, y in ys.items():
        c, f = dft(y), np.fft.fftfreq(len(y), DT)
        want = [(np.abs(back(c * np.exp(-(((f - m) / (0.5 * m)) ** 2)) * (f > 0) * 2)) ** 2).sum() for m in (0.1, 0.2, 0.4)]
        assert sorted(got[i]) == pytest.approx(sorted(want), rel=1e-4, abs=2e-6)


def test_downsample(spark, ys):
    k = np.arange(81) - 40
    h = 0.375 * np.sinc(0.375 * k) * (0.54 + 0.46 * np.cos(np.pi * k / 40))
    h /= h.sum()
    for r in MADE["downsample"](spark, SF).collect():
        y = ys[r["trace_id"]]
        smooth = [sum(h[j + 40] * y[min(max(i + j, 0), 63)] for j in range(-40, 41)) for i in range(0, 64, 2)]  # whole seconds from the start on
        assert r["n"] == 32 and r["deltat"] == 1.0 and r["tmin_ns"] == 1_577_836_800_000_000_000 + r["trace_id"] * 10**9
        assert r["total"] == pytest.approx(sum(smooth), abs=1e-5)


def test_deconvolve(spark, ys):
    for r in MADE["deconvolve"](spark, SF).collect():
        a, b = ys[r["trace_id"]], ys[r["trace_id"] + 1][:50]
        fa, fb = dft(a, 128), dft(b, 128)
        power = np.abs(fb) ** 2
        want = back(fa * fb.conj() / np.maximum(power, 0.01 * power.max())).real[:64]
        assert r["total"] == pytest.approx(want.sum(), abs=1e-4)


def test_peaks(spark, ys):
    got = {}
    for name in ("peaks_dead_time", "peaks_by_size"):
        for r in MADE[name](spark, SF).collect():
            got.setdefault((name, r["trace_id"]), []).append((r["peak_ns"], r["peak"]))
    for i, y in ys.items():
        t0 = 1_577_836_800_000_000_000 + i * 10**9
        dead, free = [], -1.0
        for k in range(1, 64):
            if y[k] > 0.2 >= y[k - 1] and k * DT >= free:
                best = max(range(k, min(k + 4, 64)), key=lambda j: (y[j], -j))
                dead.append((t0 + best * 500_000_000, round(y[best], 6)))
                free = best * DT + 4.0
        by_size, left = [], dict(enumerate(y))
        while left and max(left.values()) > 0.2:
            best = max(left, key=lambda j: (left[j], -j))
            by_size.append((t0 + best * 500_000_000, round(y[best], 6)))
            left = {j: v for j, v in left.items() if abs(j - best) > 4}
        for name, want in (("peaks_dead_time", dead), ("peaks_by_size", by_size)):
            assert got.get((name, i), []) == [(t, pytest.approx(v, abs=2e-6)) for t, v in want]


def test_clock_drift(spark, ys):
    def window(u):
        return 0.3635819 - 0.4891775 * np.cos(2 * np.pi * u) + 0.1365995 * np.cos(4 * np.pi * u) - 0.0106411 * np.cos(6 * np.pi * u)

    for r in MADE["clock_drift"](spark, SF).collect():
        y = ys[r["trace_id"]]
        want = 0.0
        for n in range(64):
            x = n / 1.001
            k0 = int(np.floor(x))
            for k in range(k0 - 31, k0 + 33):
                want += y[min(max(k, 0), 63)] * np.sinc(x - k) * window((x - k + 32) / 64)
        assert r["n"] == 64 and r["total"] == pytest.approx(want, abs=1e-4)


def test_mechanism_angles(spark):
    """Angles between double couples and isotropic parts: by all rotations of one set of axes onto the other's."""

    def axes(k):
        s, d, r = np.radians([k * 7 % 360, k * 11 % 81 + 5, k * 13 % 340 - 170])
        slip = np.array([np.cos(r) * np.cos(s) + np.cos(d) * np.sin(r) * np.sin(s), np.cos(r) * np.sin(s) - np.cos(d) * np.sin(r) * np.cos(s), -np.sin(d) * np.sin(r)])
        normal = np.array([-np.sin(d) * np.sin(s), np.sin(d) * np.cos(s), -np.cos(d)])
        t, p = (slip + normal) / np.sqrt(2), (slip - normal) / np.sqrt(2)
        return np.array([t, np.cross(p, t), p]).T

    rows = MADE["mechanism_angles"](spark, SF).collect()
    assert len(rows) > 100
    for r in rows:
        a, b = axes(r["p_partkey"]), axes(r["p_partkey"] + 1)
        turns = [np.degrees(np.arccos(np.clip((np.trace(b @ np.diag(f) @ a.T) - 1) / 2, -1, 1))) for f in ([1, 1, 1], [1, -1, -1], [-1, 1, -1], [-1, -1, 1])]
        assert r["angle"] == pytest.approx(min(turns), abs=2e-3)


def test_gf_seismograms_add_up(spark):
    """The source time function has unit sum and delays move samples only, so the last sample is the static sum."""
    from pyspark.sql import functions as F

    from strandline.functions import scalars as S
    from strandline.operators import greens as gf
    from strandline.plans import signal_queries as q

    p = q._pairs_gf(spark, SF)
    m6 = S.dc_to_m6(F.col("azi"), F.lit(60.0), F.lit(90.0), F.lit(1.0))
    terms = gf.component_terms(p, ["pair"], gf.vicinity(q._axes(), 10), gf.elastic10_weights(m6, F.col("azi"), F.col("bazi")), F.col("delay"))
    late = {(r["pair"], r["component"]): r["y"] for r in gf.static_sum(q._store(spark, SF), terms, ["pair", "component"], 10_000).collect()}
    last = {}
    for r in MADE["gf_seismograms"](spark, SF).collect():
        key = (r["pair"], r["component"])
        last[key] = max(last.get(key, (-1, 0)), (r["it"], r["y"]))
    assert set(last) == set(late) and len(late) > 100
    assert all(last[k][1] == pytest.approx(late[k], abs=2e-5) for k in late)


def test_convert_archive(spark, ys):
    """Ten codes of 128 seconds, renamed and at half the rate: the chain of the plain filter and decimation."""
    rows = MADE["convert_archive"](spark, SF).collect()
    k = np.arange(81) - 40
    h = 0.375 * np.sinc(0.375 * k) * (0.54 + 0.46 * np.cos(np.pi * k / 40))
    h /= h.sum()
    assert sorted(r["codes"] for r in rows) == [f"YY.L{i}..Z." for i in range(10)]
    for r in rows:
        i = int(r["codes"][4])
        y = butterworth(np.concatenate([ys[i + 10 * j] for j in range(4)]), "band", [0.05, 0.3])
        want = [sum(h[j + 40] * y[min(max(n + j, 0), len(y) - 1)] for j in range(-40, 41)) for n in range(0, len(y), 2)]
        assert r["n"] == len(want) and r["deltat"] == 1.0 and r["total"] == pytest.approx(sum(want), abs=1e-4)
