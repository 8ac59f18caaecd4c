"""Points in polygons, selections and filter designs against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandline.functions import kernels as K
from strandline.operators import polygons, selections, signal


def _unit(lat, lon):
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)


def _held(corners, points):
    """Fans of triangles from a pole that sees all corners."""
    v, p, pole = _unit(*np.array(corners).T), _unit(*np.array(points).T), np.array([0, 0, 1.0])
    out = np.zeros(len(p), bool)
    for a, b in zip(v, np.roll(v, -1, axis=0)):
        out |= (p @ np.cross(pole, a) >= 0) & (p @ np.cross(a, b) > 0) & (p @ np.cross(b, pole) > 0)
    return out


POLY = "id int, corners array<struct<lat: double, lon: double>>"


def test_coastline_around_a_pole(spark):
    rng = np.random.default_rng(1)
    lon = np.sort(rng.uniform(-180, 180, 3000))
    line = [(float(a), float(b)) for a, b in zip(40 + rng.uniform(0, 4, 3000), lon)]
    places = [(float(a), float(b)) for a, b in zip(rng.uniform(35, 50, 4000), rng.uniform(-180, 180, 4000))]
    df = spark.createDataFrame([(1, line), (2, line[::-1])], POLY)
    pts = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "i int, lat double, lon double")
    got = polygons.points_in_polygons(pts, df, "id").select("i", "polygon").collect()
    want = _held(line, places)
    assert 500 < want.sum() < 3500
    assert {r.i for r in got if r.polygon == 1} == set(np.flatnonzero(want))
    assert {r.i for r in got if r.polygon == 2} == set(np.flatnonzero(~want))
    cells = polygons.cover(df, "id")
    assert cells.agg(F.max(F.size("edges"))).first()[0] <= 8


def test_polygon_edge_cases(spark):
    square = [(0.0, 179.0), (0.0, -179.0), (2.0, -179.0), (2.0, 179.0)]
    rows = [(1, square), (1, square), (2, [(0.0, 0.0), (1.0, 1.0)]), (3, []), (4, None), (5, [square[0], *square, None, square[-1]])]
    df = spark.createDataFrame(rows, POLY)
    pts = spark.createDataFrame([(1, 1.0, 180.0), (1, 1.0, 180.0), (2, 1.0, -180.0), (3, None, 1.0), (4, 1.0, 0.0), (5, 1.0, 540.0)], "polygon int, lat double, lon double")
    got = polygons.points_in_polygons(pts.withColumnRenamed("polygon", "id"), df, "id")
    assert sorted(map(tuple, got.select("id", "polygon").collect())) == sorted([(1, 1)] * 4 + [(1, 5)] * 2 + [(2, 1)] * 2 + [(2, 5)] + [(5, 1)] * 2 + [(5, 5)])
    assert polygons.points_in_polygons(pts.drop("polygon"), df.limit(0), "id").count() == 0
    assert polygons.points_in_polygons(pts.drop("polygon").limit(0), df, "id").count() == 0


def test_selections_cover_once(spark):
    rng = np.random.default_rng(2)
    rows = [(*(str(int(k)) for k in rng.integers(0, 3, 4)), int(t) * 10, int(t) * 10 + int(w)) for t, w in zip(rng.integers(0, 12, 600), rng.choice([10, 20, 10, 0], 600))]
    rows += [(None, "0", "0", "0", 5, 9), ("0", "0", "0", "0", 30, 20), ("0", "0", "0", "0", None, 20)]
    asked = spark.createDataFrame(rows, "network string, station string, location string, channel string, tmin_ns long, tmax_ns long")
    out = selections.merge_selections(asked)
    ticks = F.explode(F.sequence("tmin_ns", F.col("tmax_ns") - 1))
    got = [tuple(r) for r in selections.expand_selections(out).select(*sorted(selections.AXES), ticks).collect()]
    want = {(r[3], r[2], r[0] or "", r[1], t) for r in rows if r[4] is not None for t in range(r[4], max(r[5], r[4] + 1) if r[5] >= r[4] else 0)}
    assert len(got) == len(set(got)) and set(got) == want
    found = [{k: (tuple(v) if isinstance(v, list) else v) for k, v in r.asDict().items()} for r in out.collect()]
    for axis in selections.AXES:
        rest = [tuple(v for k, v in r.items() if k != axis) for r in found]
        assert len(rest) == len(set(rest))
    codes = {}
    for r in found:
        codes.setdefault(tuple(r[a] for a in selections.AXES), []).append((r["tmin_ns"], r["tmax_ns"]))
    assert all(a[1] < b[0] for spans in codes.values() for a, b in zip(sorted(spans), sorted(spans)[1:]))
    assert selections.merge_selections(asked.limit(0)).count() == 0


@pytest.mark.parametrize("factor", [2, 3, 5, 10])
def test_equiripple_alternates(factor):
    bands = ((0, 0.75 / factor), (1 / factor, 1))
    taps = 45 * factor // 2 * 2 + 1
    h = K.equiripple(taps, bands, (1.0, 0.0), (1.0, 50.0))
    assert len(h) == taps and np.allclose(h, h[::-1], atol=0, rtol=0)
    # the weighted error's local extremes, each refined on a grid of its own
    amp = lambda f: h[taps // 2] + 2 * np.cos(np.pi * np.outer(f, np.arange(1, taps // 2 + 1))) @ h[taps // 2 + 1 :]
    peaks = []
    for (lo, hi), gain, weight in zip(bands, (1.0, 0.0), (1.0, 50.0)):
        f = np.linspace(lo, hi, int(60 * taps * (hi - lo)))
        e = weight * (amp(f) - gain)
        inner = np.flatnonzero((np.abs(e[1:-1]) >= np.abs(e[:-2])) & (np.abs(e[1:-1]) >= np.abs(e[2:]))) + 1
        for k in [0, *inner, len(f) - 1]:
            near = np.linspace(f[max(k - 1, 0)], f[min(k + 1, len(f) - 1)], 401)
            v = weight * (amp(near) - gain)
            peaks.append(v[np.argmax(np.abs(v))])
    peaks = np.array(peaks)
    top = np.abs(peaks).max()
    full = peaks[np.abs(peaks) > top - 1e-9]
    assert len(full) >= taps // 2 + 2
    assert (np.sign(full[1:]) != np.sign(full[:-1])).sum() >= taps // 2 + 1


def test_equiripple_refuses():
    for taps, bands in ((10, ((0, 0.2), (0.4, 1))), (11, ((0, 0.5), (0.4, 1))), (11, ((0, 0.5),))):
        with pytest.raises(ValueError):
            K.equiripple(taps, bands, (1.0, 0.0), (1.0, 1.0))


def test_downsample_equiripple(spark):
    """A tone in the pass band is kept to the ripple, one beyond the new highest frequency goes; samples are the filter's own sums."""
    t = np.arange(2000) * 0.5
    rows = [(1, 10**9, 0.5, np.sin(2 * np.pi * 0.1 * t).tolist()), (2, 10**9, 0.5, np.sin(2 * np.pi * 0.8 * t).tolist()), (3, 10**9, 0.5, None)]
    df = spark.createDataFrame(rows, "id int, tmin_ns long, deltat double, ydata array<double>")
    got = {r.id: r for r in signal.downsample(df, 2, filter="equiripple").collect()}
    h = K.equiripple(91, ((0, 0.375), (0.5, 1)), (1.0, 0.0), (1.0, 50.0))
    for k in (1, 2):
        y = np.array(rows[k - 1][3])
        plain = np.array([sum(h[j] * y[min(max(i + j - 45, 0), len(y) - 1)] for j in range(91)) for i in range(len(y))])
        assert got[k].deltat == 1.0 and np.allclose(got[k].ydata, plain[(got[k].tmin_ns - 10**9) // 500_000_000 :: 2], atol=1e-12)
    assert np.abs(np.array(got[1].ydata)[50:-50]).max() > 0.95 and np.abs(np.array(got[2].ydata)[50:-50]).max() < 1e-3
    assert got[3].ydata is None
