"""Operator graphs: what reaches the scan, patterns that go back, and equality with the same steps by hand."""

import fnmatch
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import expressions
from strandline.operators import archive, graph

T0 = 1_577_836_800 * 10**9
SCHEMA = "codes string, deltat double, tmin_ns long, ydata array<double>"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    rows = [(f"XX.{s}..BH{c}.", 0.5, T0 + k * 100 * 10**9, rng.normal(size=200).tolist()) for s in ("A", "B") for c in "ENZ" for k in range(3)]
    path = str(tmp_path_factory.mktemp("graph") / "t")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return spark.read.parquet(path), rows


def pieces(df):
    return {(r["codes"], r["tmin_ns"]): r["ydata"] for r in df.collect()}


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    return df._jdf.queryExecution().executedPlan().toString()


def responses(spark):
    pole = lambda re, im: F.struct(F.lit(re).alias("re"), F.lit(im).alias("im"))
    out = spark.createDataFrame([(f"XX.{s}..BH{c}.STrtz",) for s in "AB" for c in "RTZ"], "codes string")
    return out.withColumns({"tmin_ns": F.lit(0).cast("long"), "tmax_ns": F.lit(4 * 10**18), "zeros": F.array(pole(0.0, 0.0)), "poles": F.array(pole(-0.2, 0.2), pole(-0.2, -0.2)), "gain": F.lit(2.0)})


def test_only_what_is_needed_is_read(spark, stored):
    t, _ = stored
    shifted = graph.shift(graph.Stored(t, longest=100 * 10**9), 3.0)
    end = graph.restitution(graph.to_rtz(shifted, 30.0), responses(spark), 0.2, 0.8)
    vertical = graph.Graph([end]).get(["XX.A..BHZ.STrtzRd"], T0 + 120 * 10**9, T0 + 150 * 10**9)
    text = plan(vertical)
    pad = 10 * 10**9
    assert "EqualTo(codes,XX.A..BHZ.)" in text and "BHE" not in text
    assert f"LessThan(tmin_ns,{T0 + 147 * 10**9 + pad})" in text and f"GreaterThan(tmin_ns,{T0 + 17 * 10**9 - pad})" in text
    assert "Exchange hashpartitioning(codes" in text or "BroadcastExchange" in text  # the epochs' join, and no shuffle for turning
    radial = graph.Graph([graph.to_rtz(shifted, 30.0)]).get(["XX.A..BHR.STrtz"], T0, T0 + 10**9)
    assert "In(codes, [XX.A..BHE.,XX.A..BHN.])" in plan(radial)


def test_same_as_by_hand(spark, stored):
    t, rows = stored
    tmin, tmax = T0 + 60 * 10**9, T0 + 140 * 10**9
    chain = graph.to_rtz(graph.shift(graph.Stored(t), 3.0), 30.0)
    by = {(c, s): np.concatenate([r[3] for r in rows if r[0] == f"XX.{s}..BH{c}."]) for c in "ENZ" for s in "AB"}
    lo, hi = 2 * 57, 2 * 137
    b = np.deg2rad(30)
    got = {}
    for r in graph.Graph([chain]).get(["XX.*..BH?.STrtz"], tmin, tmax).collect():
        got.setdefault(r["codes"], []).append((r["tmin_ns"], r["ydata"]))
    assert set(got) == {f"XX.{s}..BH{c}.STrtz" for s in "AB" for c in "RTZ"}
    for s in "AB":
        e, n, z = (by[c, s][lo:hi] for c in "ENZ")
        for c, want in (("R", -np.sin(b) * e - np.cos(b) * n), ("T", -np.cos(b) * e + np.sin(b) * n), ("Z", z)):
            parts = sorted(got[f"XX.{s}..BH{c}.STrtz"])
            assert parts[0][0] == tmin
            np.testing.assert_allclose(np.concatenate([y for _, y in parts]), want, atol=1e-12)
    done = graph.Graph([graph.restitution(chain, responses(spark), 0.2, 0.8)]).get(["XX.B..BHT.STrtzRd"], tmin, tmax)
    wider = graph.Graph([chain]).get(["XX.B..BHT.STrtz"], tmin - 10 * 10**9, tmax + 10 * 10**9)
    by_hand = pieces(archive.restitute(wider, responses(spark), (0.2 / 1.5, 0.2, 0.8, 1.2), tfade=10.0))
    (start, y), = ((k[1], v) for k, v in by_hand.items())
    own = pieces(done)
    assert list(own) == [("XX.B..BHT.STrtzRd", tmin)]
    np.testing.assert_allclose(own["XX.B..BHT.STrtzRd", tmin], np.array(y)[(tmin - start) // (5 * 10**8) :][:160], atol=1e-12)


def test_patterns_go_back():
    """Whatever matches under its new name is read; exact patterns stay exact."""
    node = graph.to_rtz(None, 10.0)
    channels = ["", "E", "N", "Z", "BHE", "BHN", "BHZ", "R", "BTE", "BTN", "BRZ"]
    codes = [".".join(p) for p in itertools.product(["X", "XS"], ["A", "S"], ["", "S"], channels, ["", "S", "TS", "q"])]
    outs = lambda c: [".".join([*p[:3], p[3][:-1] + o, p[4] + "Trtz"]) for p in [c.split(".")] for o in "RTZ"]
    patterns = ["*", "X.*", "X*", "*S", "*.S", "?.A..BH?.*", "X.A..*.STrtz", "X.A..BT*.*", "X.A..R.Trtz", "X.A..*R.*", "X.*.*.?.?Trtz", "X.A..BHZ.S", "X.A..BHZ.S*", "[XS].A..BHR.*", "X.A..BH[RT].STrtz", "X.S.S.*.TSTrtz", "X.A.nothing", "X.A..B*T.T*z"]
    for p in patterns:
        back = graph._without_suffix([p], "S")
        for c in codes:
            if fnmatch.fnmatchcase(c + "S", p):
                assert any(fnmatch.fnmatchcase(c, q) for q in back), (p, c, back)
        read = {i: node._back([p], [i])[0] for i in range(3)}
        for c in codes:
            for i, o in enumerate(outs(c)):
                if c.split(".")[3][-1:] in ("E", "N", "Z") and fnmatch.fnmatchcase(o, p) and (c.split(".")[3][-1] == "Z") == (i == 2):
                    assert any(fnmatch.fnmatchcase(c, q) for q in read[i]), (p, c, o, read)
    assert graph._without_suffix(["X.A..BHZ.S", "X.B..BHZ."], "S") == ["X.A..BHZ."]
    assert node._back(["X.A..BHR.Trtz"], [0, 1]) == (["X.A..BHE.", "X.A..BHN."], [0])


def test_matrices_and_odd_rows(spark):
    """Nulls, empty traces, extra columns and no rows; directions of the turned components."""
    rows = [("X.A..BHE.", 1.0, T0, [1.0]), ("X.A..BHN.", 1.0, T0, [0.0]), ("X.A..BHZ.", 1.0, T0, [2.0]), (None, 1.0, T0, [1.0]), ("X.B..BHE.", None, T0, [1.0]), ("X.B..BHN.", 1.0, None, [1.0]), ("X.B..BHZ.", 1.0, T0, None), ("X.C..BHZ.", 1.0, T0, [])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"__c": F.lit("x"), "__group": F.lit("y"), "y": F.lit(1)})
    east = graph.to_rtz(graph.Stored(df), 270.0)  # from the west, so that radial is east
    got = {k[0]: round(v[0], 9) + 0.0 for k, v in pieces(graph.Graph([east]).get(["*"], T0, T0 + 10**9)).items()}
    assert got == {"X.A..BHR.Trtz": 1.0, "X.A..BHT.Trtz": 0.0, "X.A..BHZ.Trtz": 2.0}
    up = graph.to_ltq(graph.Stored(df), 270.0, 0.0)  # straight from below: along the ray is up, across it is back to the source
    got = {k[0]: round(v[0], 9) + 0.0 for k, v in pieces(graph.Graph([up]).get(["X.A..BH?.Tltq"], T0, T0 + 10**9)).items()}
    assert got == {"X.A..BHL.Tltq": 2.0, "X.A..BHT.Tltq": 0.0, "X.A..BHQ.Tltq": -1.0}
    skew = graph.to_enz(graph.Stored(df), [90.0, 0.0, 0.0], [0.0, 0.0, 90.0], "ENZ")  # a vertical that points down
    got = {k[0]: round(v[0], 9) + 0.0 for k, v in pieces(graph.Graph([skew]).get(["X.A..BH?.Tenz"], T0, T0 + 10**9)).items()}
    assert got == {"X.A..BHE.Tenz": 1.0, "X.A..BHN.Tenz": 0.0, "X.A..BHZ.Tenz": -2.0}
    assert graph.Graph([graph.to_rtz(graph.Stored(df.limit(0)), 1.0)]).get(["*"], T0, T0 + 10**9).count() == 0
    with pytest.raises(ValueError):
        graph.Graph([east]).get(["X.A..BHE.Trtz"], T0, T0 + 10**9)
    m = {r["group"]: r for r in graph.mappings(df, east).collect()}
    assert m["X.A..BH."]["in_codes"] == ["X.A..BHE.", "X.A..BHN.", "X.A..BHZ."] and m["X.A..BH."]["out_codes"] == ["X.A..BHR.Trtz", "X.A..BHT.Trtz", "X.A..BHZ.Trtz"]


@pytest.mark.parametrize("text", ["", "{}", "{P}", "{P|}", "{stored:A||stored:B}", "P-10%", "{stored:1}", "vel:x", "{vel:0}", "mid{stored:P}", "first(stored:P)", "1,2"])
def test_bad_timings(text):
    with pytest.raises(ValueError):
        expressions.Timing.parse(text)


@pytest.mark.parametrize("text", ["1:2:3@4", "1@0", "1:2:0", "k", "1:2:3:4", "a", "1@2@3", "1@x", "1@-2"])
def test_bad_grids(text):
    with pytest.raises(ValueError):
        expressions.parse_grid(text)


def test_timings(spark):
    t = expressions.Timing.parse(" first{ stored:P | vel:4 } - 2.5 S ")
    assert t == expressions.Timing((("stored", "P"), ("vel", "4")), "first", -2.5, "S") and expressions.Timing.parse(str(t)) == t
    df = spark.createDataFrame([({"P": 10.0, "cake:p": 7.0}, 8000.0), ({"S": 30.0}, 8000.0), (None, 8000.0), ({"P": 1.0}, None)], "a map<string, double>, m double")
    of = lambda s: [r[0] for r in df.select(expressions.timing(s, F.col("a"), F.col("m"))).collect()]
    assert of("P-1") == [9.0, None, None, 0.0]
    assert of("{stored:S|stored:P}+50%") == [15.0, 45.0, None, 1.5]
    assert of("first{stored:P|vel_surface:2}") == [4.0, 4.0, 4.0, 1.0]
    assert of("last{stored:P|cake:p}+1S") == [18.0, None, None, None]
    assert of("2S") == [16.0, 16.0, 16.0, None] and of("-3") == [-3.0] * 4
    with pytest.raises(ValueError):
        expressions.timing("{stored:Q}", {"P": F.lit(1.0)}, F.lit(0.0))
    with pytest.raises(ValueError):
        expressions.timing("{vel:5}", {}, F.lit(0.0))


def test_grids(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0, 4.0), (2, 5.0, 5.0, 1.0), (3, None, 1.0, 1.0)], "id int, lo double, hi double, inc double")
    axes = lambda text: {r["id"]: r["x"] for r in df.select("id", expressions.parse_grid(text)[0].column(F.col("lo"), F.col("hi"), F.col("inc")).alias("x")).collect()}
    assert axes(":") == {1: [0.0, 4.0, 8.0], 2: [5.0], 3: None}
    assert axes("@3")[1] == [0.0, 5.0, 10.0] and axes("2@3")[1] == [2.0] and axes("0:1k@2")[2] == [0.0, 1000.0]
    assert axes("1:1.3:.1")[3] == pytest.approx([1.0, 1.1, 1.2, 1.3])
    assert axes("20::-5")[1] == [20.0, 15.0, 10.0, 5.0, 0.0]
    with pytest.raises(Exception, match="steps lead away"):
        axes("0:10:-1")
