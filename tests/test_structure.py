"""Thinning, components and response chains against plain versions, with what tables don't hold: poles, date line, gaps, nulls."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import components, stages, thinning

T0 = 1_577_836_800 * 10**9


def angle(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return math.degrees(2 * math.asin(min(1, math.sqrt(h))))


@pytest.mark.parametrize("radius", [0.7, 12.0, 95.0])
def test_thinning(spark, radius):
    rng = np.random.default_rng(4)
    rows = [(i, float(math.degrees(math.asin(rng.uniform(-1, 1)))), float(rng.uniform(-180, 180)), float(rng.integers(0, 50))) for i in range(250)]
    rows += [(300 + i, 89.9 - i / 50, float(rng.uniform(-180, 180)), 5.0) for i in range(40)] + [(400 + i, float(rng.uniform(-2, 2)), float(180 - rng.uniform(-1, 1)) - 360 * int(rng.integers(2)), 1.0) for i in range(80)]
    rows += [(500 + i, 10.0, 10.0, float(i % 3)) for i in range(60)] + [(600, 90.0, 0.0, 9.0), (601, -90.0, 77.0, 9.0), (602, 0.0, 180.0, None), (603, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, badness double").withColumns({"cell": F.lit(1), "b": F.lit("x")})
    kept = []
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (math.inf if r[3] is None else r[3], r[0])):
        if all(angle(r[1:3], k[1:3]) > radius for k in kept):
            kept.append(r)
    got = thinning.thin_by_radius(df, radius)
    assert sorted(r["id"] for r in got.collect()) == sorted(k[0] for k in kept)
    assert got.columns == df.columns and thinning.thin_by_radius(df.limit(0), radius).count() == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    rows, have = [], {}
    for code in ("A", "B"):
        for c in "ZNE":
            t = 0
            for _ in range(12):
                n = int(rng.integers(1, 40))
                y = rng.standard_normal(n).tolist()
                rows.append((code, c, 0.5, T0 + t * 500_000_000, y))
                have |= {(code, c, t + i): v for i, v in enumerate(y)}
                t += n + int(rng.choice([0, 0, 3, 9]))
    rows += [("A", "X", 0.5, T0, [1.0]), ("A", "Z", 0.5, T0 - 10**12, []), ("A", "Z", 0.5, T0 - 10**12, None), ("A", "Z", 1.0, T0, [4.0, 5.0]), (None, "Z", 0.5, T0, [1.0])]
    df = spark.createDataFrame(rows, "codes string, channel string, deltat double, tmin_ns long, ydata array<double>").repartition(3)
    for mode, longest in (("common", 7), ("any", 1 << 20)):
        got = {}
        for r in components.multi_component(df, ["codes"], "channel", ["Z", "N", "E"], mode, longest, width=20 * 10**9).where("deltat = 0.5").collect():
            assert all((y is None) == (not r["mask"] >> i & 1) for i, y in enumerate(r["ydata"]))
            for c, y in zip("ZNE", r["ydata"], strict=True):
                for i, v in enumerate(y or []):
                    key = (r["codes"], c, (r["tmin_ns"] - T0) // 500_000_000 + i)
                    assert key not in got
                    got[key] = v
        want = have if mode == "any" else {k: v for k, v in have.items() if all((k[0], c, k[2]) in have for c in "ZNE")}
        assert got == want
    with pytest.raises(ValueError, match="mode"):
        components.multi_component(df, ["codes"], "channel", ["Z"], "some")
    assert components.multi_component(df.limit(0), ["codes"], "channel", ["Z"]).count() == 0


def test_component_overlaps(spark):
    """Overlaps within a component leave no ends behind in the spans."""
    rows = [("A", "Z", 0, 10), ("A", "Z", 5, 20), ("A", "Z", 20, 30), ("A", "N", 3, 25), ("A", "N", 4, 6)]
    df = spark.createDataFrame(rows, "codes string, channel string, tmin_ns long, tmax_ns long")
    got = sorted(map(tuple, components.component_spans(df, ["codes"], "channel", ["Z", "N"], 7).collect()))
    assert got == [("A", 0, 3, 1), ("A", 3, 25, 3), ("A", 25, 30, 1)]


STAGES = "codes string, stage int, input string, output string, rate_in double, rate_out double, constant double, zeros array<struct<re: double, im: double>>, poles array<struct<re: double, im: double>>"


def test_chains(spark):
    pair = [(-0.5, 0.6), (-0.5, -0.6)]
    rows = [("A", 2, "voltage", "counts", None, 100.0, 2.0, [], []), ("A", 1, "velocity", "voltage", None, None, 3.0, [(0.0, 0.0), (0.0, 0.0)], pair), ("A", 3, "counts", "counts", 100.0, 50.0, None, pair[:1], [(-9.0, 0.0)])]
    rows += [("B", 1, "velocity", "voltage", None, 100.0, 1.0, None, None), ("B", 3, "counts", "counts", 50.0, 20.0, 1.0, [], [])]
    c = stages.chains(spark.createDataFrame(rows, STAGES), ["codes"]).withColumn("whole", stages.combined(F.col("stages"))).withColumn("short", stages.simplified(F.col("whole")))
    f = 0.3
    got = {r["codes"]: r for r in c.select("codes", stages.faults(F.col("stages")).alias("faults"), F.transform("stages", stages.stage_type).alias("types"), "short", stages.evaluate(F.col("whole"), f).alias("h"), stages.evaluate(F.col("short"), f).alias("hs"), stages.evaluate(stages.combined(stages.between(F.col("stages"), 1, 1)), f).alias("first"), stages.evaluate(stages.sensor_only(F.col("stages"), 0.3), f).alias("sensor"), stages.evaluate(stages.to_quantity(F.col("whole"), "velocity", "displacement"), f).alias("d")).collect()}
    s = 2j * math.pi * f
    first = 3 * s * s / np.prod([s - complex(*p) for p in pair])
    whole = first * 2 * (s - complex(*pair[0])) / (s + 9)
    z = lambda x: complex(x["re"], x["im"])
    a = got["A"]
    assert [z(a[k]) for k in ("h", "hs", "first", "d")] == pytest.approx([whole, whole, first, whole * s])
    assert abs(z(a["sensor"])) == pytest.approx(abs(whole)) and [tuple(x) for x in a["faults"]] == [] and a["types"] == ["sensor", "digitizer", "decimation"]
    assert len(a["short"]["zeros"]) == 2 and len(a["short"]["poles"]) == 2
    assert [tuple(x) for x in got["B"]["faults"]] == [(3, "number"), (3, "units"), (3, "rate")] and z(got["B"]["h"]) == 1
    with pytest.raises(ValueError, match="no way"):
        stages.to_quantity(F.col("whole"), "counts", "velocity")
