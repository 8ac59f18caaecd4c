"""Columns and sweeps on small literal tables: patterns, times, open spans, running sums, geometry."""

import fnmatch
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.functions import codes as C
from strandline.functions import geo as G
from strandline.functions import scalars as S
from strandline.functions import times as T
from strandline.operators import coverage as cov
from strandline.operators import index as ix
from strandline.operators import intervals as iv
from strandline.operators import prefix
from strandline.operators import windows as wn


def test_globs(spark):
    names = ["XX.AB..HHZ.", "XX.ab..HHZ.", "X.AB.00.BHN.x", "[a].b", "a+b.c", "", "XX.A-C..Z."]
    patterns = ["*", "XX.*", "XX.?B..*", "*.[BH]H[NZ]*", "*.[!B]*", "[[]a*", "a+b.c", "X*.A[-B]*"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for p in patterns:
        for same in (False, True):
            got = [r["n"] for r in df.where(C.match_codes(F.col("n"), [p], ignore_case=same)).collect()]
            assert got == [n for n in names if (fnmatch.fnmatchcase(n.lower(), p.lower()) if same else fnmatch.fnmatchcase(n, p))], p
    assert df.where(C.match_codes(F.col("n"), [])).count() == 0
    assert C.station_patterns(["XX.AB", "XX.AB."]) == ["XX.AB", "XX.AB.*", "XX.AB.", "XX.AB.[*]"]


def test_time_strings(spark):
    rows = [("2020-02-29 23:59:59.999999999", 1583020799999999999), ("2020-02-29", 1582934400000000000), ("1969-12-31T23:59:59.5Z", -500000000), ("2020-01-01 10:30", 1577874600000000000), ("nonsense", None), ("2020-1-1", None), (None, None)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "s string")
    assert [r[0] for r in df.select(T.str_to_time(F.col("s"))).collect()] == [b for _, b in rows]
    one = spark.createDataFrame([(-500000001,)], "t long")
    assert one.select(T.time_to_str(F.col("t"), 9), T.time_to_str(F.col("t"), 0), T.time_to_str(F.col("t"), 6)).first()[:] == ("1969-12-31 23:59:59.499999999", "1969-12-31 23:59:59", "1969-12-31 23:59:59.500000")
    assert one.select(T.start_of(F.col("t"), "day")).first()[0] == -T.DAY
    assert [one.select(T.kscale(F.lit(x * T.SECOND))).first()[0] for x in (0, 1, 19, 20, 400)] == [0, 1, 1, 2, 3]


def test_open_and_instant_spans(spark):
    rows = [(1, 5, 9), (2, None, 3), (3, 8, None), (4, None, None), (5, 6, 6), (6, 9, 12)]
    df = spark.createDataFrame(rows, "i long, tmin_ns long, tmax_ns long")

    def hit(a, b):
        return [r["i"] for r in df.where(ix.overlaps(a, b)).orderBy("i").collect()]

    assert hit(3, 5) == [4] and hit(2, 6) == [1, 2, 4] and hit(6, 7) == [1, 4, 5] and hit(6, 6) == [1, 4, 5]
    assert hit(9, 10) == [3, 4, 6] and hit(None, 5) == [2, 4] and hit(9, None) == [3, 4, 6] and hit(None, None) == [1, 2, 3, 4, 5, 6]


def test_running_sum_is_a_window(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(-500, 500), rng.randrange(-3, 4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    got = sorted((str(r["k"]), r["t"], r["v"], r["s"]) for r in prefix.running_sum(df, ["k"], "t", {"v": "s"}, 37).collect())
    assert got == sorted((str(k), t, v, sum(w for x, u, w in rows if x == k and u <= t)) for k, t, v in rows)


def spans(spark, rows):
    return spark.createDataFrame(rows, "k string, tmin_ns long, tmax_ns long")


def test_coverage_for_all_bounds(spark):
    rows = [("a", 0, 10), ("a", 5, 15), ("a", 15, 20), ("b", 3, 4), ("a", 30, 31), ("b", 4, 9)]
    df = spans(spark, rows)
    at = lambda k, t: sum(1 for x, a, b in rows if x == k and a <= t < b)
    full = {(r["k"], r["t_ns"]): r["count"] for r in cov.coverage(df, ["k"], block=7).collect()}
    assert full == {(k, t): at(k, t) for k in "ab" for t in range(-1, 40) if at(k, t) != at(k, t - 1)}
    for lo, hi in ((-1, 5), (0, 30), (7, 16), (5, None), (None, 15)):
        got = {(r["k"], r["t_ns"]): r["count"] for r in cov.coverage(df, ["k"], lo, hi, block=7).collect()}
        assert all(got[k, t] == at(k, t) for k, t in got)
        assert {t for k, t in got if k == "a"} >= {t for t in (lo, hi) if t is not None}
        assert {(k, t) for k, t in full if (lo is None or t > lo) and (hi is None or t <= hi)} <= set(got)
    assert {tuple(r) for r in iv.gaps(df, ["k"], 2, 40).collect()} == {("a", 20, 30), ("a", 31, 40), ("b", 2, 3), ("b", 9, 40)}
    assert {r["k"]: r["covered_ns"] for r in cov.total(cov.coverage(df, ["k"]), ["k"]).collect()} == {"a": 21, "b": 6}
    bare = cov.uncovered_by(df, spans(spark, [("a", 2, 7), ("a", 8, 12), ("b", 0, 100)]), ["k"], block=5).collect()
    assert sorted((r["tmin_ns"], r["tmax_ns"]) for r in bare) == [(0, 2), (7, 8), (12, 20), (30, 31)]
    assert {r["k"]: r["count"] for r in cov.contiguous(cov.coverage(df, ["k"]), ["k"], 5, 9).collect()} == {"a": 2, "b": 1}
    assert {r["k"]: r["count"] for r in cov.contiguous(cov.coverage(df, ["k"]), ["k"], 5, 11).collect()} == {"a": -1, "b": -1}


def test_split_and_merge(spark):
    df = spans(spark, [("a", 0, 10), ("a", 4, 6), ("a", 9, 12), ("b", 20, 30)])
    assert sorted(tuple(r) for r in iv.split(df, 5, 10).collect()) == [("a", 0, 5), ("a", 4, 5), ("a", 10, 12), ("b", 20, 30)]
    assert sorted(tuple(r) for r in iv.merge_spans(df, ["k"]).collect()) == [("a", 0, 12), ("b", 20, 30)]
    cut = iv.cut_at_boundaries(df, ["k"])
    assert sorted(tuple(r) for r in cut.collect()) == [("a", 0, 4), ("a", 4, 6), ("a", 4, 6), ("a", 6, 9), ("a", 9, 10), ("a", 9, 10), ("a", 10, 12), ("b", 20, 30)]


def test_sync(spark):
    index = spark.createDataFrame([("a", 1.0, 5), ("a", 1.0, 5), ("b", 1.0, 5), ("c", 1.0, None)], "path string, mtime double, size long")
    files = spark.createDataFrame([("a", 1.0, 5), ("b", 2.0, 5), ("d", 3.0, 1), ("c", 1.0, None)], "path string, mtime double, size long")
    assert {r["path"]: r["state"] for r in ix.sync(index, files).collect()} == {"a": 2, "b": 0, "d": 0, "c": 2}
    assert {r["path"]: r["state"] for r in ix.sync(index, files.where("path <> 'a'")).collect()}["a"] == -1


@pytest.mark.parametrize("n, size", [(4, 30), (5, 30), (7, 8), (6, 6), (9, 4)])
def test_moving_average(spark, n, size):
    y = np.random.default_rng(n).standard_normal(size)
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(y)], "k string, i long, y double")
    got = [r["avg"] for r in wn.moving_avg(df, "y", n, ["k"], "i").orderBy("i").collect()]
    h, want = n // 2, np.zeros(size)
    if n < size:
        for k in range(h, h + size - n):
            want[k] = y[k - h + 1 : k - h + n + 1].mean()
        want[:h] = want[h]
        want[h + size - n :] = want[h + size - n - 1]
    assert np.allclose(got, want)
    dealt = [r["avg"] for r in wn.moving_avg(df, "y", n, ["k"], "i", width=6, rows=4).orderBy("i").collect()]
    assert np.allclose(dealt, want)


def test_frames_in_runs_of_ranks(spark):
    """Keys cut into runs give what windows over whole keys give."""
    rng = np.random.default_rng(5)
    rows = [(k, int(t), float(v)) for k, size in (("a", 90), ("b", 7), (None, 25)) for t, v in zip(np.sort(rng.choice(10_000, size, replace=False)), rng.standard_normal(size) * 3, strict=True)]
    df = spark.createDataFrame(rows, "k string, t long, y double")
    for f in (lambda **d: wn.moving_sum(df, "y", 6, ["k"], "t", **d), lambda **d: wn.sta_lta_right(df, "y", 2, 9, ["k"], "t", **d), lambda **d: wn.crossings(df, "y", 0.5, ["k"], "t", **d), lambda **d: wn.peak_candidates(df, "y", 0.5, 5, ["k"], "t", **d)):
        want, got = ([tuple(r) for r in f(**d).orderBy("k", "t").collect()] for d in ({}, {"width": 500, "rows": 12}))
        assert len(want) == len(got) > 10
        assert all(a[:2] == b[:2] and np.allclose([x or 0 for x in a[2:]], [x or 0 for x in b[2:]]) for a, b in zip(want, got, strict=True))


def test_polygon(spark):
    corners = [(10, 170), (20, -170), (-5, -160), (-15, 175)]
    rng = np.random.default_rng(1)
    points = [(float(a), float(b)) for a, b in zip(rng.uniform(-30, 30, 200), (rng.uniform(150, 220, 200) + 180) % 360 - 180, strict=True)]
    df = spark.createDataFrame(points, "lat double, lon double")
    got = [r[0] for r in df.select(G.contains_point(corners, F.col("lat"), F.col("lon"))).collect()]

    def xyz(lat, lon):
        return np.array([math.cos(math.radians(lat)) * math.cos(math.radians(lon)), math.cos(math.radians(lat)) * math.sin(math.radians(lon)), math.sin(math.radians(lat))])

    def inside(p):  # the corners' directions as seen from the point turn once around
        v = xyz(*p)
        total = 0.0
        for a, b in zip(corners, corners[1:] + corners[:1]):
            s, t = (np.cross(v, xyz(*c)) for c in (a, b))
            total += math.atan2(np.dot(v, np.cross(s, t)), np.dot(s, t))
        return abs(total) > math.pi

    assert got == [inside(p) for p in points] and 20 < sum(got) < 180


def test_array_edges(spark):
    df = spark.createDataFrame([(0, 0.5, [1.0, 2.0, 3.0])], "t long, dt double, y array<double>")
    t, dt, y = F.col("t"), F.col("dt"), F.col("y")

    def value(c):
        return df.select(c).first()[0]

    assert value(A.chop(t, dt, y, F.lit(2_000_000_000), F.lit(3_000_000_000))) is None
    assert value(A.chop(t, dt, y, F.lit(250_000_000), F.lit(750_000_000))).asDict() == {"tmin_ns": 0, "ydata": [1.0, 2.0]}  # half to even
    assert value(A.chop(t, dt, y, F.lit(500_000_000), F.lit(1_000_000_000), include_last=True))["ydata"] == [2.0, 3.0]
    assert value(A.crop_zeros(t, dt, F.transform(y, lambda v: v * 0))) is None and value(A.sample_at(t, dt, y, F.lit(-1))) is None
    assert value(A.valid_samples(F.array(F.lit(float("nan"))))) is False and value(A.valid_samples(F.slice(y, 1, 0))) is False
    assert value(A.content_hash(F.lit("a"), t, dt, y)) != value(A.content_hash(F.lit("b"), t, dt, y))


def test_scalars(spark):
    df = spark.createDataFrame([(0,), (1,), (999,), (1000,), (9449,), (123456,), (5 * 10**9,), (-2,)], "n long")
    assert [r[0] for r in df.where("n >= 0").select(S.human_bytesize(F.col("n"))).collect()] == ["0 Bytes", "1 Byte", "999 Bytes", "1.0 kB", "9.4 kB", "123 kB", "5.0 GB"]
    assert df.select(S.in_range(F.when(F.col("n") > 0, F.col("n")), 1, None)).where("not 1 = 2").first()[0] is False
    q = spark.createDataFrame([(["a", "", "b c", "it's", "x\\y"],)], "a array<string>")
    assert q.select(S.quoted_join(F.col("a"))).first()[0] == "a '' 'b c' 'it\\'s' 'x\\\\y'"
    assert [r[0] for r in spark.createDataFrame([(35,), (36,), (123456789,)], "n long").select(S.base36decode(S.base36encode(F.col("n")))).collect()] == [35, 36, 123456789]


def test_epoch_lookup(spark):
    epochs = spark.createDataFrame([("a", 0, 10, "x"), ("a", 5, 10, "y"), ("b", 0, 5, "z")], "k string, tmin_ns long, tmax_ns long, v string")
    points = spark.createDataFrame([("a", 3, 1), ("a", 7, 2), ("a", 10, 3), ("b", 4, 4), ("b", 4, 4), (None, 4, 5), ("a", None, 6), ("c", 1, 7)], "k string, t_ns long, n_matches long").withColumnRenamed("n_matches", "i")
    got = sorted((r["i"], r["n_matches"], r["epoch_v"]) for r in iv.epoch_lookup(points, epochs, ["k"]).collect())
    assert got == [(1, 1, "x"), (2, 2, "y"), (3, 0, None), (4, 1, "z"), (4, 1, "z"), (5, 0, None), (6, 0, None), (7, 0, None)]
