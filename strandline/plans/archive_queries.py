"""Queries over whole archive operations and mechanisms, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scalars as S
from ..operators import archive as ar
from ..operators import mechanisms as me
from ..operators import metadata as md
from ..operators import signal as sg
from . import tables
from .trace_queries import T0, r6

_T, _N = tables.SQL["traces"], tables.SQL["nuts"]
QUERIES, ORACLE_SQL = {}, {}


def register(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _laid(spark, d):
    """Traces of 64 samples end to end under ten codes."""
    k = F.col("trace_id")
    return tables.traces(spark, d).select(F.concat(F.lit("XX.L"), (k % 10).cast("string"), F.lit("..Z.")).alias("codes"), "deltat", (F.lit(T0) + F.floor(k / 10) * 32_000_000_000).alias("tmin_ns"), "ydata")


_LAID = f"{_T}, laid AS (SELECT 'XX.L' || (trace_id % 10) || '..Z.' AS codes, {T0} + (trace_id // 10) * 32000000000 AS t0, ydata FROM traces), pts AS (SELECT codes, t0 + k * 500000000 AS t, ydata[k + 1] AS y FROM laid, range(64) r(k))"


@register("waveforms_window", f"WITH {_LAID} SELECT codes, min(t) AS tmin_ns, count(*) AS n, round(sum(y), 5) + 0.0 AS total FROM pts WHERE codes GLOB 'XX.L[1-7]*' AND codes <> 'XX.L3..Z.' AND t >= {T0 + 10 * 10**9} AND t < {T0 + 90 * 10**9} GROUP BY codes")
def waveforms_window(spark, d):
    w = ar.waveforms(_laid(spark, d), T0 + 10 * 10**9, T0 + 90 * 10**9, ["XX.L[1-7]*"], ["XX.L3..Z."], want_incomplete=False)
    return w.select("codes", "tmin_ns", F.size("ydata").cast("long").alias("n"), (F.round(A.total(F.col("ydata")), 5) + 0.0).alias("total"))


@register("virtual_channels", f"WITH {_LAID} SELECT codes || 'neg' AS codes, count(*) AS n, round(sum(-y), 5) + 0.0 AS total FROM pts WHERE codes GLOB 'XX.L[12]*' GROUP BY codes UNION ALL SELECT codes, count(*), round(sum(y), 5) + 0.0 FROM pts WHERE codes = 'XX.L5..Z.' GROUP BY codes")
def virtual_channels(spark, d):
    r = ar.Registry(_laid(spark, d))
    r.add(ar.VirtualChannels(["XX.L[123]*"], lambda t: t.withColumn("ydata", F.transform("ydata", lambda v: -v)), "neg"))
    got = r.get(["XX.L[12]..Z.neg", "XX.L5..Z."])
    return got.groupBy("codes").agg(F.sum(F.size("ydata")).alias("n"), (F.round(F.sum(A.total(F.col("ydata"))), 5) + 0.0).alias("total"))


@register("restitution_epochs", f"WITH {_T} SELECT trace_id % 4 AS k, count(*) AS n, sum(CASE trace_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END)::BIGINT AS matches FROM traces GROUP BY 1")
def restitution_epochs(spark, d):
    """One epoch for codes 0 and 1, two for 2, none for 3."""
    t = tables.traces(spark, d).withColumn("codes", (F.col("trace_id") % 4).cast("string"))
    pole = F.array(F.struct(F.lit(-0.2).alias("re"), F.lit(0.2).alias("im")), F.struct(F.lit(-0.2).alias("re"), F.lit(-0.2).alias("im")))
    zero = F.array(F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im")))
    e = spark.createDataFrame([("0", 0), ("1", 0), ("2", 0), ("2", 5)], "codes string, tmin_ns long").withColumns({"tmax_ns": F.lit(4 * 10**18), "zeros": zero, "poles": pole, "gain": F.lit(2.0)})
    out = ar.restitute(t, e, (0.02, 0.05, 0.5, 0.8))
    return out.where((F.col("n_matches") == 1) == F.col("ydata").isNotNull()).groupBy(F.col("codes").cast("long").alias("k")).agg(F.count("*").alias("n"), F.sum("n_matches").alias("matches"))


@register("sensors", f"""WITH {_N}, c AS (SELECT DISTINCT string_split(codes, '.')[1] || '.' || string_split(codes, '.')[2] || '...' AS sensor, codes, tmin_ns, tmax_ns FROM nuts WHERE kind = 'channel'), b AS (SELECT sensor, tmin_ns AS t FROM c UNION SELECT sensor, tmax_ns FROM c),
k AS (SELECT c.sensor, codes, tmin_ns, tmax_ns, t FROM c JOIN b ON c.sensor = b.sensor AND t >= tmin_ns AND t < tmax_ns), p AS (SELECT sensor, codes, t, coalesce(lead(t) OVER (PARTITION BY sensor, codes, tmin_ns, tmax_ns ORDER BY t), tmax_ns) AS u FROM k)
SELECT sensor, t AS tmin_ns, u AS tmax_ns, string_agg(DISTINCT codes, ',' ORDER BY codes) AS components FROM p GROUP BY sensor, t, u""")
def sensors(spark, d):
    c = tables.nuts(spark, d).where("kind = 'channel'").select("codes", "tmin_ns", "tmax_ns").distinct()
    return ar.sensors(c, [])


@register("promises_redeemed", f"""WITH {_N}, x AS (SELECT codes, tmin_ns, tmax_ns, kind = 'response' AS a, element::INT AS rank, 's' || part % 3 AS source FROM nuts WHERE kind IN ('response', 'waveform')),
ev AS (SELECT codes, t, sum(a) AS a, sum(b) AS b FROM (SELECT codes, tmin_ns AS t, a::INT AS a, (NOT a)::INT AS b FROM x UNION ALL SELECT codes, tmax_ns, -a::INT, -(NOT a)::INT FROM x) GROUP BY codes, t), r AS (SELECT codes, t, sum(a) OVER w > 0 AND sum(b) OVER w = 0 AS bare FROM ev WINDOW w AS (PARTITION BY codes ORDER BY t)),
m AS (SELECT * FROM (SELECT *, lag(bare, 1, false) OVER (PARTITION BY codes ORDER BY t) AS before FROM r) WHERE bare <> before), gone AS (SELECT codes, t AS lo, u AS hi FROM (SELECT *, lead(t) OVER (PARTITION BY codes ORDER BY t) AS u FROM m) WHERE bare)
SELECT gone.codes AS codes, lo AS tmin_ns, hi AS tmax_ns, arg_min(source, (rank, source)) AS source FROM gone JOIN x ON a AND x.codes = gone.codes AND tmin_ns < hi AND tmax_ns > lo GROUP BY ALL""")
def promises_redeemed(spark, d):
    n = tables.nuts(spark, d)
    p = n.where("kind = 'response'").select("codes", "tmin_ns", "tmax_ns", F.col("element").cast("int").alias("rank"), F.concat(F.lit("s"), (F.col("part") % 3).cast("string")).alias("source"))
    return ar.redeem(p, n.where("kind = 'waveform'"), ["codes"])


@register("path_templates", f"WITH {_N} SELECT file_id, element, string_split(codes, '.')[1] || '/' || string_split(codes, '.')[2] || '/' || strftime(make_timestamp(tmin_ns // 1000), '%Y-%m-%d_%j') || '.x' AS path FROM nuts")
def path_templates(spark, d):
    return tables.nuts(spark, d).select("file_id", "element", ar.fill_template("{network}/{station}/{year}-{month}-{day}_{jday}.x", F.col("codes"), F.col("tmin_ns")).alias("path"))


def _tensors(spark, d):
    k = F.col("p_partkey")
    m = S.dc_to_m6(k * 7 % 360, k * 11 % 81 + 5, k * 13 % 340 - 170, F.lit(1e15))
    iso = (k % 3) * 2e14
    return tables.read(spark, d, "part").select("p_partkey", *((c + (iso if i < 3 else 0)).alias(n) for i, (c, n) in enumerate(zip(m, me.M6, strict=True))))


@register("mechanism_planes", "SELECT p_partkey, true AS plane_found, round(1e15 + (p_partkey % 3) * 2e14, 0) / 1e12 AS moment, (p_partkey % 3) * 200.0 AS moment_iso, 1000.0 AS moment_dc, 0.0 AS moment_clvd FROM part")
def mechanism_planes(spark, d):
    """The given plane is one of the two, and the parts are those that were put together."""
    k = F.col("p_partkey")
    out = me.with_planes(_tensors(spark, d))

    def near(i):
        def turn(a, b):
            return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)

        return (turn(F.col(f"strike{i}"), k * 7 % 360) < 1e-3) & (F.abs(F.col(f"dip{i}") - (k * 11 % 81 + 5)) < 1e-3) & (turn(F.col(f"rake{i}"), k * 13 % 340 - 170) < 1e-3)

    scaled = [(F.round(F.col(c) / 1e12, 3) + 0.0).alias(c) for c in ("moment", "moment_iso", "moment_dc", "moment_clvd")]
    return out.select("p_partkey", (near(1) | near(2)).alias("plane_found"), *scaled)


@register("mechanism_angles", None)
def mechanism_angles(spark, d):
    t = _tensors(spark, d)
    b = t.select((F.col("p_partkey") - 1).alias("p_partkey"), *(F.col(c).alias(f"b_{c}") for c in me.M6))
    return me.with_angle(t.join(b, "p_partkey")).select("p_partkey", (F.round("angle", 4) + 0.0).alias("angle"))


@register("nested_properties", "SELECT event_type, count(*) AS n, sum((props->>'k')::INT)::BIGINT AS total FROM events WHERE (props->>'k')::INT >= 50 GROUP BY event_type")
def nested_properties(spark, d):
    """A path into typed trees: the declared schema, then the field."""
    e = tables.read(spark, d, "events").withColumn("p", F.from_json("props", "k int"))
    return e.where("p.k >= 50").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


@register("computed_columns", "WITH t AS (SELECT o_orderkey, o_totalprice, o_totalprice * 1e13 AS m0, log10(o_totalprice * 1e20) / 1.5 - 10.7 AS mw FROM orders) SELECT o_orderkey, round(mw, 6) + 0.0 AS mw, mw > 8.0 AS big FROM t WHERE o_totalprice > 50000")
def computed_columns(spark, d):
    """Derived columns of a table, used as a mask."""
    o = tables.read(spark, d, "orders").withColumn("m0", F.col("o_totalprice") * 1e13)
    mw = S.moment_to_magnitude(F.col("m0"))
    return o.where("o_totalprice > 50000").select("o_orderkey", r6(mw).alias("mw"), (mw > 8.0).alias("big"))


@register("parameter_grid", """WITH r AS (SELECT s_nationkey AS region, floor(min(s_acctbal) / 1000)::BIGINT AS lo, floor(max(s_acctbal) / 1000)::BIGINT AS hi FROM supplier GROUP BY 1)
SELECT region, d * 1000.0::DOUBLE AS depth, strike, count(*) OVER (PARTITION BY region) AS n FROM (SELECT region, strike, unnest(range(lo, hi + 1, 2)) AS d FROM (SELECT region, lo, hi, unnest(range(0, 360, 45)) AS strike FROM r))""")

def parameter_grid(spark, d):
    """Grids of source parameters: every combination of two ranges, the first as wide as each nation's suppliers' balances."""
    s = tables.read(spark, d, "supplier")
    r = s.groupBy(F.col("s_nationkey").alias("region")).agg(F.floor(F.min("s_acctbal") / 1000).cast("long").alias("lo"), F.floor(F.max("s_acctbal") / 1000).cast("long").alias("hi"))
    depth, strike = F.sequence("lo", "hi", F.lit(2).cast("long")), F.sequence(F.lit(0), F.lit(315), F.lit(45))
    g = r.withColumns({"n": (F.size(depth) * F.size(strike)).cast("long"), "depth": F.explode(depth)}).withColumn("strike", F.explode(strike))
    return g.select("region", (F.col("depth") * 1000.0).alias("depth"), F.col("strike").cast("long").alias("strike"), "n")


@register("convert_archive", None)
def convert_archive(spark, d):
    """Select, cut, filter, decimate, rename: what a conversion of an archive chains."""
    w = ar.waveforms(_laid(spark, d), T0, T0 + 128 * 10**9, ["XX.*"])
    out = sg.downsample(sg.bandpass(w, 0.05, 0.3), 2)
    return out.select(F.regexp_replace("codes", r"^XX\.", "YY.").alias("codes"), "tmin_ns", "deltat", F.size("ydata").alias("n"), r6(A.total(F.col("ydata"))).alias("total"))


@register("constraints", "WITH o AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE epoch_us(o_orderdate) * 1000 END AS a, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE epoch_us(o_orderdate) * 1000 + 86400000000000 END AS b FROM orders) SELECT k, coalesce(CASE WHEN bool_or(a IS NULL) THEN NULL ELSE min(a) END, -1) AS tmin_ns, coalesce(CASE WHEN bool_or(b IS NULL) THEN NULL ELSE max(b) END, -1) AS tmax_ns FROM o GROUP BY k")
def constraints(spark, d):
    from ..functions.times import DAY, ns_of

    o = tables.read(spark, d, "orders")
    t = ns_of(F.col("o_orderdate"))
    spans = o.select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 11 != 0, t).alias("tmin_ns"), F.when(F.col("o_orderkey") % 13 != 0, t + DAY).alias("tmax_ns"))
    return md.hull(spans, ["k"]).fillna(-1)


@register("orientations", "SELECT p_partkey, round(sin(radians((p_partkey * 7) % 360)) * cos(radians((p_partkey * 11) % 181 - 90)), 6) + 0.0 AS e, round(cos(radians((p_partkey * 7) % 360)) * cos(radians((p_partkey * 11) % 181 - 90)), 6) + 0.0 AS n, round(-sin(radians((p_partkey * 11) % 181 - 90)), 6) + 0.0 AS u FROM part")
def orientations(spark, d):
    k = F.col("p_partkey")
    return tables.read(spark, d, "part").select("p_partkey", *(r6(c).alias(n) for c, n in zip(md.orientation(k * 7 % 360, k * 11 % 181 - 90), "enu", strict=True)))


@register("station_tree", f"WITH {_N}, c AS (SELECT DISTINCT string_split(codes, '.')[1] AS network, string_split(codes, '.')[2] AS station, codes, tmin_ns, tmax_ns FROM nuts WHERE kind = 'channel') SELECT network, count(DISTINCT station) AS n_stations, count(*) AS n_channels FROM c GROUP BY network")
def station_tree(spark, d):
    tree = md.station_tree(tables.nuts(spark, d).where("kind = 'channel'"))
    n = F.aggregate("stations", F.lit(0), lambda a, s: a + F.size(s["channels"]))
    return tree.select("network", F.size("stations").cast("long").alias("n_stations"), n.cast("long").alias("n_channels"))


@register("timing_table", """WITH p AS (SELECT c_custkey AS pair, ((c_custkey * 7) % 41)::DOUBLE AS depth, ((c_custkey * 13) % 201 + 100)::DOUBLE AS dist FROM customer) SELECT pair, round(depth * 0.2 + dist * 0.13, 6) + 0.0 AS t FROM p""")
def timing_table(spark, d):
    """A travel-time table that is linear between its points, so that interpolation is exact."""
    k = F.col("c_custkey")
    p = tables.read(spark, d, "customer").select(k.alias("pair"), (k * 7 % 41).cast("double").alias("depth"), (k * 13 % 201 + 100).cast("double").alias("dist"), F.lit("P").alias("phase"))
    grid = spark.range(25).select(F.lit("P").alias("phase"), F.floor(F.col("id") / 5).alias("i0"), (F.col("id") % 5).alias("i1")).withColumn("t", F.col("i0") * 10 * 0.2 + (F.col("i1") * 50 + 100) * 0.13)
    out = md.interpolate(p, grid, [("depth", 0.0, 10.0, 5), ("dist", 100.0, 50.0, 5)], "t", ["phase"])
    return out.select("pair", r6(F.col("t")).alias("t"))


@register("homogeneous_set", f"WITH {_T}, s AS (SELECT trace_id // 20 AS k, trace_id, tmin_ns, ydata FROM traces), r AS (SELECT k, max(tmin_ns) AS lo, min(tmin_ns + 31500000000) AS hi FROM s GROUP BY k) SELECT trace_id, lo AS tmin_ns, (hi - lo) // 500000000 + 1 AS n, round(list_sum(ydata[(lo - tmin_ns) // 500000000 + 1:(hi - tmin_ns) // 500000000 + 1]), 6) + 0.0 AS total FROM s JOIN r USING (k) WHERE lo <= hi")
def homogeneous_set(spark, d):
    t = tables.traces(spark, d).withColumn("k", F.floor(F.col("trace_id") / 20))
    return md.homogeneous(t, ["k"]).select("trace_id", "tmin_ns", F.size("ydata").cast("long").alias("n"), r6(A.total(F.col("ydata"))).alias("total"))


@register("stations_thinned", """WITH p AS (SELECT c_custkey AS place, ((c_custkey * 37) % 170) - 85.0::DOUBLE AS lat, ((c_custkey * 101) % 360) - 180.0::DOUBLE AS lon, c_acctbal AS w FROM customer), r AS (SELECT *, floor((lat + 90) / 10) AS r FROM p),
c AS (SELECT *, floor(((lon + 180) % 360 + 360) % 360 / 360 * greatest(1.0, floor(36 * cos(radians((r + 0.5) * 10 - 90))))) AS c FROM r) SELECT place, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY w, lat, lon) AS k FROM c) WHERE k = 1""")
def stations_thinned(spark, d):
    return md.thin_out(tables.places(spark, d), "lat", "lon", "w", 10.0).select("place", "lat", "lon")


@register("dispersion", "WITH p AS (SELECT c_mktsegment AS region, c_acctbal AS a, c_nationkey::DOUBLE AS b FROM customer) SELECT region, 'a' AS a, 'b' AS b, round(covar_samp(a, b), 4) + 0.0 AS covariance, round(corr(a, b), 6) + 0.0 AS correlation FROM p GROUP BY region")
def dispersion(spark, d):
    c = tables.read(spark, d, "customer").select(F.col("c_mktsegment").alias("region"), F.col("c_acctbal").alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    out = md.dispersion(c, ["a", "b"], ["region"]).where("a <> b")
    return out.select("region", "a", "b", (F.round("covariance", 4) + 0.0).alias("covariance"), r6(F.col("correlation")).alias("correlation"))


@register("clock_drift", None)
def clock_drift(spark, d):
    """Clocks that run fast by a thousandth."""
    t = tables.traces(spark, d).withColumn("end_ns", (F.col("tmin_ns") + 63 * 500_500_000).cast("long"))
    out = sg.antidrift(t, "tmin_ns", "end_ns")
    return out.select("trace_id", F.size("ydata").alias("n"), r6(A.total(F.col("ydata"))).alias("total"))
