"""Small cases of what failed on larger tables."""

import contextlib
import random
import io
import math
from collections import Counter

from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.functions.times import DAY
from strandline.operators import coverage as cov
from strandline.operators import greens as gf
from strandline.operators import intervals as iv
from strandline.operators import polygons, prefix


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_sizes_of_ranges_without_ranges(spark):
    """a count of two thousand million values is a number, not an array."""
    df = spark.createDataFrame([(8e9,), (7.0,), (8.0,), (-5.0,), (None,)], "stop double")
    n = {e: S.even_size(F.lit(0.0), F.col("stop"), F.lit(4.0), e) for e in ("raise", "round", "floor", "ceil")}
    got = [tuple(r) for r in df.select(*n.values()).collect()]
    assert got == [(2000000001,) * 4, (None, 3, 2, 3), (3, 3, 3, 3), (None, 0, 0, 0), (None,) * 4]
    small = df.where("stop < 10")
    for e, c in n.items():
        assert small.where(~c.eqNullSafe(F.size(S.even_range(F.lit(0.0), F.col("stop"), F.lit(4.0), e)))).count() == 0


def test_overlaps_counted_without_pairs(spark):
    """counts, first start and last end of overlapping spans, by key and without; no join of spans with queries."""
    rng = random.Random(5)
    spans = [(rng.choice("ab"), t := rng.randrange(200), t + rng.choice([0, 1, 3, 30])) for _ in range(150)] + [("a", None, 3), ("b", 3, None)]
    asked = [(rng.choice("abc"), t := rng.randrange(-10, 250), t + rng.choice([0, 2, 20])) for _ in range(60)] + [("a", 5, 9)] * 2
    c, q = spark.createDataFrame(spans, "k string, tmin_ns long, tmax_ns long"), spark.createDataFrame(asked, "k string, qmin_ns long, qmax_ns long")
    for keys in (["k"], []):
        want = set()
        for k, lo, hi in set(asked):
            own = [(a, b) for kk, a, b in spans if a is not None and b is not None and (kk == k or not keys) and a < max(hi, lo + 1) and max(b, a + 1) > lo]
            if own:
                want.add(((k,) if keys else ()) + (lo, hi, len(own), min(a for a, _ in own), max(b for _, b in own)))
        df = iv.overlap_stats(c, q, keys, block=13)
        assert sorted(map(tuple, df.collect())) == sorted(want)
        assert "Join" not in _plan(df)


def test_twin_spans_stay_apart(spark):
    """two equal spans after a gap of 53 days join each other and not what lies before the gap."""
    df = spark.createDataFrame([("x", a * DAY, b * DAY) for a, b in ((9338, 9354), (9407, 9430), (9407, 9430), (9408, 9438))], "codes string, tmin_ns long, tmax_ns long")
    got = sorted((r.tmin_ns // DAY, r.tmax_ns // DAY) for r in iv.merge_spans(df, ["codes"], 3 * DAY).collect())
    assert got == [(9338, 9354), (9407, 9438)]


def test_pieces_of_epochs_need_no_window_over_them(spark):
    """F8, F12: pieces go from boundary to boundary; repeats count once, what has no group or start stays whole."""
    rows = [("a", 1, 0, 10), ("a", 1, 0, 10), ("a", 2, 4, 6), ("a", 3, 5, 5), ("a", 4, 8, None), (None, 5, 0, 10), ("b", 6, None, 4), ("b", 7, 2, 9)]
    df = spark.createDataFrame(rows, "g string, i int, tmin_ns long, tmax_ns long")
    out = iv.cut_at_boundaries(df, ["g"], block=3)
    want = [("a", 1, 0, 4), ("a", 1, 4, 5), ("a", 1, 5, 6), ("a", 1, 6, 8), ("a", 1, 8, 10), ("a", 2, 4, 5), ("a", 2, 5, 6), ("a", 3, 5, 5), ("a", 4, 8, None), (None, 5, 0, 10), ("b", 6, None, 4), ("b", 7, 2, 4), ("b", 7, 4, 9)]
    assert sorted(map(tuple, out.select("g", "i", "tmin_ns", "tmax_ns").collect()), key=repr) == sorted(want, key=repr)
    assert _plan(out).count("Window [") == 2  # both over boundaries: within blocks and over them


def test_block_lengths_are_worked_out_before_blocks(spark):
    """the length of blocks belongs to a span and isn't worked out again for each block."""
    df = spark.range(3).select(F.lit("x").alias("codes"), (F.col("id") + 0.5).alias("deltat"), (F.col("id") * DAY).alias("tmin_ns"), ((F.col("id") + 30) * DAY).alias("tmax_ns"))
    plan = _plan(iv.blocks(df).select("codes", "block_min_ns", "block_max_ns"))
    assert "CASE WHEN" not in plan.split("Generate explode")[0]


def test_running_sums_join_nothing(spark):
    """the long table is dealt out once, with what lies before a block as a row of its own, and is not joined."""
    df = spark.createDataFrame([(k, t, v) for k in ("a", None) for t, v in ((0, 1), (5, None), (12, 3), (40, -2), (41, 7))] + [("a", None, 9)], "k string, t long, v int")
    out = prefix.running_sum(df.withColumn("w", F.col("v")), ["k"], "t", {"v": "s"}, 10, following="next", largest={"w": "top"})
    want = [(0, 1, 1, 1, 5), (5, None, 1, 1, 12), (12, 3, 4, 3, 40), (40, -2, 2, 3, 41), (41, 7, 9, 7, None)]
    got = out.select("k", "t", "v", "s", "top", "next").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((k, *w) for k in ("a", None) for w in want), key=repr)
    assert "Join" not in _plan(out) and out.schema["v"].dataType == df.schema["v"].dataType
    spans = spark.createDataFrame([("a", 0, 10), ("a", 10, 15), ("a", 12, 40)], "codes string, tmin_ns long, tmax_ns long")
    steps = cov.coverage(spans, ["codes"], block=7, until="tmax_ns")
    assert [r.covered_ns for r in cov.total(steps, ["codes"]).collect()] == [40] and "Join" not in _plan(cov.total(steps, ["codes"]))


def test_component_sums_are_sums_of_terms(spark):
    """sums by corner equal those of single terms, with records of several lengths and starts, missing and repeated ones; a
    pair's rows before the sum are its corners."""
    rng = random.Random(1)
    records = [(i, rng.randrange(-3, 4), [rng.uniform(-1, 1) for _ in range(rng.choice([4, 4, 4, 6]))]) for i in range(20) if i != 7] + [(3, 1, [0.5] * 4)]
    store = spark.createDataFrame(records, "irecord long, itmin int, data array<double>")
    pairs = spark.createDataFrame([(i, rng.uniform(0, 3), rng.choice([0.0, 0.5, 0.35, -1.2])) for i in range(8)], "pair long, at double, delay double")
    corners = gf.vicinity([(F.col("at"), 0.0, 1.0, 4)], 5)
    weights = {"n": [F.lit(0.0), F.col("at"), F.lit(-0.7), F.lit(0.0), F.lit(0.0)], "d": [F.lit(0.0)] * 3 + [F.lit(0.3), F.lit(0.9)]}
    stf = gf.stf_weights("triangular", 3.0, 0.5)
    terms = list(map(tuple, gf.component_terms(pairs, ["pair"], corners, weights, F.col("delay")).collect()))
    placed, still = {}, {}
    for pair, component, irecord, delay, w in terms:
        for _, itmin, data in (r for r in records if r[0] == irecord):
            still[pair, component] = still.get((pair, component), 0) + w * data[min(max(2 - itmin, 0), len(data) - 1)]
            for t, s in stf:
                x = (delay + t) / 0.5
                for k, p in ((math.floor(x), 1 - x + math.floor(x)), (math.floor(x) + 1, x - math.floor(x))):
                    if p * s * w:
                        placed.setdefault((pair, component), []).append((itmin + k, w * s * p, data))
    want = {}
    for key, all_of in placed.items():
        for it in range(min(f for f, _, _ in all_of), max(f + len(y) for f, _, y in all_of)):
            want[*key, it] = sum(w * y[min(max(it - f, 0), len(y) - 1)] for f, w, y in all_of)
    out = gf.component_sum(store, pairs, ["pair"], corners, weights, F.col("delay"), 0.5, 5, stf)
    plain = gf.delayed_sum(store, gf.with_stf(gf.component_terms(pairs, ["pair"], corners, weights, F.col("delay")), stf), ["pair", "component"], 0.5)
    for df in (out, plain):
        got = {(r.pair, r.component, r.it): r.y for r in df.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    got = {(r.pair, r.component): r.y for r in gf.component_static(store, pairs, ["pair"], corners, weights, 2, 5).collect()}
    assert got.keys() == still.keys() and all(abs(got[k] - still[k]) < 1e-12 for k in still)


def test_copies_are_matched_once(spark, monkeypatch):
    """equal places and equal polygons meet once for all their copies, and every copy is in the result; no more than a block goes together."""
    covered, whole = [], polygons.cover

    def cover(rows, *args, **more):
        covered.append(rows.count())
        return whole(rows, *args, **more)

    monkeypatch.setattr(polygons, "cover", cover)
    square = [(0.0, 179.0), (0.0, -179.0), (2.0, -179.0), (2.0, 179.0)]
    rows = [(i, square) for i in range(150)] + [(150, square[::-1]), (None, square), (151, None)]
    df = spark.createDataFrame(rows, "id int, corners array<struct<lat: double, lon: double>>")
    pts = spark.createDataFrame([(i % 1199, (0.0, 1.0, -0.0)[i % 3], (0.0, 180.0)[i % 2]) for i in range(2400)] + [(1, None, 1.0)], "i int, lat double, lon double")
    got = polygons.points_in_polygons(pts.where("lat = 1 or lat is null"), df, "id")
    assert covered == [-(-151 // polygons.POLYGONS) + 2]
    want = Counter((i % 1199, 1.0, lon, p) for i in range(2400) if i % 3 == 1 for lon in [(0.0, 180.0)[i % 2]] for p in ([*range(150), None] if lon else [150]))
    assert Counter(map(tuple, got.select("i", "lat", "lon", "polygon").collect())) == want
    met = polygons.points_in_polygons(pts.withColumn("w", F.array("i")), df, "id")
    assert met.columns == ["i", "lat", "lon", "w", "polygon"] and met.where("w[0] <> i").count() == 0
    sizes = polygons._together(pts, ["lat", "lon"], F.col("i"), "held", 300).select("lat", F.size("held"))
    assert max(n for _, n in sizes.collect()) <= 300 and sizes.groupBy().sum("size(held)").first()[0] == 2401


def test_lines_are_not_filtered_before_they_are_dealt_out(spark):
    """polygons of fewer than three edges are left out while covering; a filter on edges would go below the shuffle before it."""
    square = [(0.0, 179.0), (0.0, -179.0), (2.0, -179.0), (2.0, 179.0)]
    df = spark.createDataFrame([(1, square), (2, square[:2]), (3, []), (4, None)], "id int, corners array<struct<lat: double, lon: double>>")
    cells = polygons.cover(df.repartition(3, "id"), "id", numbers=True)
    assert "Filter" not in _plan(cells)
    assert {r.id for r in cells.collect()} == {1}
