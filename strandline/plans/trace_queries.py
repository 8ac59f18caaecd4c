"""Queries over traces, samples and windows, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import times as T
from ..operators import pairs
from ..operators import windows as wn
from . import tables
from .index_queries import JUN98, Y1997, Y1999

_T, _P, _S, _N = tables.SQL["traces"], tables.SQL["samples"], tables.SQL["group_spans"], tables.SQL["nuts"]
QUERIES, ORACLE_SQL = {}, {}
HOUR = 3600 * T.SECOND


def register(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _cols():
    return F.col("ydata"), F.col("tmin_ns"), F.col("deltat")


def r6(c):
    return F.round(c, 6) + 0.0


T0 = 1_577_836_800_000_000_000


@register("trace_chop", f"""WITH {_T}, i AS (SELECT *, greatest(0, round_even(({T0} + 20300000000 - tmin_ns) / 5e8, 0)::BIGINT) AS a, least(64, round_even(({T0} + 41900000000 - tmin_ns) / 5e8, 0)::BIGINT) AS b FROM traces)
SELECT trace_id, tmin_ns + a * 500000000 AS tmin_ns, b - a AS n, round(list_sum(ydata[a + 1:b]), 6) + 0.0 AS total FROM i WHERE a < b""")
def trace_chop(spark, d):
    Y, TMIN, DT = _cols()
    c = A.chop(TMIN, DT, Y, F.lit(T0 + 20_300_000_000), F.lit(T0 + 41_900_000_000))
    return tables.traces(spark, d).withColumn("c", c).where("c is not null").select("trace_id", "c.tmin_ns", F.size("c.ydata").cast("long").alias("n"), r6(A.total(F.col("c.ydata"))).alias("total"))


@register("trace_sample_at", f"""WITH {_T}, x AS (SELECT trace_id, ydata, (({T0} + 30200000000 - tmin_ns) / 5e8) AS x FROM traces) SELECT trace_id, round(ydata[floor(x)::INT + 1] + (x - floor(x)) * (ydata[least(floor(x)::INT + 2, 64)] - ydata[floor(x)::INT + 1]), 6) + 0.0 AS linear, round(ydata[round_even(x, 0)::INT + 1], 6) + 0.0 AS nearest FROM x WHERE x >= 0 AND x <= 63""")
def trace_sample_at(spark, d):
    Y, TMIN, DT = _cols()
    t = F.lit(T0 + 30_200_000_000)
    out = tables.traces(spark, d).select("trace_id", r6(A.sample_at(TMIN, DT, Y, t)).alias("linear"), r6(A.nearest(TMIN, DT, Y, t)).alias("nearest"))
    return out.where("linear is not null")


@register("trace_extremes", f"""WITH {_T}, e AS (SELECT trace_id, ydata, list_max(ydata) AS hi, list_min(ydata) AS lo FROM traces) SELECT trace_id, list_position(ydata, hi) - 1 AS imax, round(hi, 6) + 0.0 AS max, list_position(ydata, lo) - 1 AS imin, round(lo, 6) + 0.0 AS min, CASE WHEN abs(hi) >= abs(lo) THEN list_position(ydata, hi) - 1 ELSE list_position(ydata, lo) - 1 END AS iabs, round(greatest(abs(hi), abs(lo)), 6) + 0.0 AS absmax FROM e""")
def trace_extremes(spark, d):
    Y, _, _ = _cols()
    return tables.traces(spark, d).select("trace_id", A.extremes(Y).alias("e")).select("trace_id", "e.imax", r6(F.col("e.max")).alias("max"), "e.imin", r6(F.col("e.min")).alias("min"), "e.iabs", r6(F.col("e.absmax")).alias("absmax"))


@register("trace_extend", f"""WITH {_T}, i AS (SELECT *, trace_id % 7 AS a, (trace_id % 5) * 3 AS b FROM traces)
SELECT trace_id, tmin_ns - a * 500000000 AS tmin_ns, 64 + a + b AS n, round(list_sum(ydata), 6) + 0.0 AS zeros, round(list_sum(ydata) + a * ydata[1] + b * ydata[64], 6) + 0.0 AS repeats, round(list_sum(ydata) * (1 + (a + b) / 64), 6) + 0.0 AS means, round(list_sum(ydata) + (a + b) * list_median(ydata), 6) + 0.0 AS medians FROM i""")
def trace_extend(spark, d):
    Y, TMIN, DT = _cols()
    step = 500_000_000
    lo, hi = TMIN - F.col("trace_id") % 7 * step, TMIN + (63 + F.col("trace_id") % 5 * 3) * step
    e = {f: A.extend(TMIN, DT, Y, lo, hi, f) for f in ("zeros", "repeat", "mean", "median")}
    t = tables.traces(spark, d).withColumns({f"e_{k}": v for k, v in e.items()})
    return t.select("trace_id", "e_zeros.tmin_ns", F.size("e_zeros.ydata").cast("long").alias("n"), *(r6(A.total(F.col(f"e_{k}.ydata"))).alias(n) for k, n in (("zeros", "zeros"), ("repeat", "repeats"), ("mean", "means"), ("median", "medians"))))


@register("trace_shift_snap", f"WITH {_T} SELECT trace_id, tmin_ns + 130000000 AS shifted, (round_even((tmin_ns + 130000000) / 5e8, 0)::BIGINT) * 500000000 AS snapped FROM traces")
def trace_shift_snap(spark, d):
    _, TMIN, DT = _cols()
    s = A.shift(TMIN, 0.13)
    return tables.traces(spark, d).select("trace_id", s.alias("shifted"), A.snap(s, DT).alias("snapped"))


@register("trace_crop_zeros", f"WITH {_T}, z AS (SELECT trace_id, tmin_ns, [CASE WHEN v > 0.15 THEN v ELSE 0 END for v in ydata] AS y FROM traces), i AS (SELECT *, [CASE WHEN y[k] <> 0 THEN k END for k in range(1, 65)] AS nz FROM z) SELECT trace_id, tmin_ns + (list_min(nz) - 1) * 500000000 AS tmin_ns, list_max(nz) - list_min(nz) + 1 AS n FROM i WHERE list_min(nz) IS NOT NULL")
def trace_crop_zeros(spark, d):
    Y, TMIN, DT = _cols()
    y = F.transform(Y, lambda v: F.when(v > 0.15, v).otherwise(0.0))
    return tables.traces(spark, d).withColumn("c", A.crop_zeros(TMIN, DT, y)).where("c is not null").select("trace_id", "c.tmin_ns", F.size("c.ydata").cast("long").alias("n"))


@register("trace_add", f"WITH {_T}, p AS (SELECT a.trace_id AS trace_id, a.ydata AS ya, b.ydata AS yb FROM traces a JOIN traces b ON b.trace_id = a.trace_id + 1) SELECT trace_id, round(list_sum([ya[k] + coalesce(CASE WHEN k > 2 THEN yb[k - 2] END, 0) for k in range(1, 65)]), 6) + 0.0 AS added, round(list_sum([ya[k] * coalesce(CASE WHEN k > 2 THEN yb[k - 2] END, 1) for k in range(1, 65)]), 6) + 0.0 AS multiplied FROM p")
def trace_add(spark, d):
    _, TMIN, _ = _cols()
    t = tables.traces(spark, d)
    p = t.select("trace_id", F.col("ydata").alias("ya"), TMIN.alias("ta")).join(t.select((F.col("trace_id") - 1).alias("trace_id"), F.col("ydata").alias("yb"), TMIN.alias("tb")), "trace_id")
    at = ((F.col("tb") - F.col("ta")) / 500_000_000).cast("int")
    return p.select("trace_id", r6(A.total(A.add(F.col("ya"), F.col("yb"), at))).alias("added"), r6(A.total(A.add(F.col("ya"), F.col("yb"), at, product=True))).alias("multiplied"))


@register("trace_taper", f"""WITH {_T} SELECT trace_id, round(list_sum([ydata[k + 1] * CASE WHEN k < 6 OR k >= 58 THEN 0 WHEN k < 20 THEN 0.5 - 0.5 * cos((k * 0.5 - 3) / 7 * pi()) WHEN k < 50 THEN 1 ELSE 0.5 + 0.5 * cos((k * 0.5 - 25) / 4 * pi()) END for k in range(64)]), 6) + 0.0 AS cosine, round(list_sum([ydata[k + 1] * exp(-power(pi() / 5, 2) * (k * 0.1) * (k * 0.1)) for k in range(64)]), 6) + 0.0 AS gauss FROM traces""")
def trace_taper(spark, d):
    Y, _, _ = _cols()
    return tables.traces(spark, d).select("trace_id", r6(A.total(A.cosine_taper(Y, 3.0, 10.0, 25.0, 29.0, 0.0, 0.5))).alias("cosine"), r6(A.total(A.gauss_taper(Y, 5.0, 0.0, 0.1))).alias("gauss"))


def _diff_sql(expr: str) -> str:
    return f"round(list_sum([abs({expr}) for i in range(64)]), 6) + 0.0"


_D1 = "CASE WHEN i = 0 THEN (y[2] - y[1]) / 0.5 WHEN i = 63 THEN (y[64] - y[63]) / 0.5 WHEN i IN (1, 62) THEN (y[i + 2] - y[i]) / 1.0 ELSE (-y[i + 3] + 8 * y[i + 2] - 8 * y[i] + y[i - 1]) / 6.0 END"
_D1B = "CASE WHEN i = 0 THEN (y[2] - y[1]) / 0.5 WHEN i = 63 THEN (y[64] - y[63]) / 0.5 ELSE (y[i + 2] - y[i]) / 1.0 END"
_D2 = "CASE WHEN i IN (0, 1) THEN (y[3] - 2 * y[2] + y[1]) / 0.25 WHEN i IN (62, 63) THEN (y[64] - 2 * y[63] + y[62]) / 0.25 ELSE (-y[i + 3] + 16 * y[i + 2] - 30 * y[i + 1] + 16 * y[i] - y[i - 1]) / 3.0 END"


@register("trace_differentiate", f"WITH {_T}, y AS (SELECT trace_id, ydata AS y FROM traces) SELECT trace_id, {_diff_sql(_D1)} AS first4, {_diff_sql(_D1B)} AS first2, {_diff_sql(_D2)} AS second4 FROM y")
def trace_differentiate(spark, d):
    Y, _, DT = _cols()
    def size(y):
        return r6(A.total(F.transform(y, F.abs)))

    return tables.traces(spark, d).select("trace_id", size(A.diff(Y, DT)).alias("first4"), size(A.diff(Y, DT, order=2)).alias("first2"), size(A.diff(Y, DT, n=2)).alias("second4"))


@register("trace_misfit", f"WITH {_T}, p AS (SELECT a.trace_id AS trace_id, a.ydata AS u, b.ydata AS v FROM traces a JOIN traces b ON b.trace_id = a.trace_id + 1) SELECT trace_id, round(sqrt(list_sum([power(abs(v[k] - u[k]), 2) for k in range(1, 65)])), 6) + 0.0 AS m2, round(sqrt(list_sum([power(abs(v[k]), 2) for k in range(1, 65)])), 6) + 0.0 AS n2, round(list_sum([abs(v[k] - u[k]) for k in range(1, 65)]), 6) + 0.0 AS m1 FROM p")
def trace_misfit(spark, d):
    t = tables.traces(spark, d)
    p = t.select("trace_id", F.col("ydata").alias("u")).join(t.select((F.col("trace_id") - 1).alias("trace_id"), F.col("ydata").alias("v")), "trace_id")
    m, n = A.lx_norm(F.col("u"), F.col("v"))
    return p.select("trace_id", r6(m).alias("m2"), r6(n).alias("n2"), r6(A.lx_norm(F.col("u"), F.col("v"), 1)[0]).alias("m1"))


@register("trace_validate", f"WITH {_T} SELECT trace_id, len(ydata) > 0 AS ok, tmin_ns + (len(ydata) - 1) * 500000000 AS tmax_ns, true AS equal FROM traces")
def trace_validate(spark, d):
    Y, TMIN, DT = _cols()
    return tables.traces(spark, d).select("trace_id", A.valid_samples(Y).alias("ok"), A.tmax_ns(TMIN, DT, Y).alias("tmax_ns"), A.almost_equal(Y, F.transform(Y, lambda v: v * (1 + 1e-7))).alias("equal"))


@register("trace_time_axis", f"WITH {_T} SELECT trace_id, unnest([tmin_ns + k * 500000000 for k in range(64)]) AS t_ns, round(unnest(ydata), 6) + 0.0 AS y FROM traces")
def trace_time_axis(spark, d):
    Y, TMIN, DT = _cols()
    t = tables.traces(spark, d)
    return t.select("trace_id", F.explode(F.arrays_zip(A.time_axis(TMIN, DT, Y).alias("t_ns"), Y.alias("y"))).alias("z")).select("trace_id", "z.t_ns", r6(F.col("z.y")).alias("y"))


@register("trace_range", f"""WITH {_T}, e AS (SELECT codes, list_min(ydata) AS lo, list_max(ydata) AS hi, list_sum(ydata) / 64 AS m, sqrt(list_sum([(v - list_sum(ydata) / 64) * (v - list_sum(ydata) / 64) for v in ydata]) / 64) AS s FROM traces)
SELECT codes, round(min(lo), 6) + 0.0 AS lo, round(max(hi), 6) + 0.0 AS hi, round(min(m - 2 * s), 6) + 0.0 AS lo_std, round(max(m + 2 * s), 6) + 0.0 AS hi_std, round(quantile_cont(lo, 0.1), 6) + 0.0 AS lo_robust, round(quantile_cont(hi, 0.9), 6) + 0.0 AS hi_robust FROM e GROUP BY codes""")
def trace_range(spark, d):
    t = tables.traces(spark, d)
    out = None
    for name, mode, outer in (("", "minmax", "minmax"), ("_std", "std", "minmax"), ("_robust", "minmax", "robust")):
        one = pairs.value_range(t, ["codes"], mode, outer, 2.0).select("codes", r6(F.col("lo")).alias(f"lo{name}"), r6(F.col("hi")).alias(f"hi{name}"))
        out = one if out is None else out.join(one, "codes")
    return out


@register("trace_time_range", f"WITH {_T} SELECT codes, min(tmin_ns) AS tmin_ns, max(tmin_ns + 31500000000) AS tmax_ns, count(*) AS n FROM traces GROUP BY codes")
def trace_time_range(spark, d):
    Y, TMIN, DT = _cols()
    return tables.traces(spark, d).groupBy("codes").agg(F.min("tmin_ns").alias("tmin_ns"), F.max(A.tmax_ns(TMIN, DT, Y)).alias("tmax_ns"), F.count("*").alias("n"))


_PAIR = f"""WITH {_T}, c AS (SELECT trace_id // 3 AS station, trace_id % 3 AS comp, {T0} + (trace_id // 3) * 1000000000 + (trace_id % 3) * 500000000 AS tmin_ns, ydata FROM traces),
w AS (SELECT station, max(CASE WHEN comp = 0 THEN ydata END) AS n, max(CASE WHEN comp = 1 THEN ydata END) AS e, max(CASE WHEN comp = 2 THEN ydata END) AS z FROM c GROUP BY station)"""


def _components(spark, d):
    t = F.col("trace_id")
    return tables.traces(spark, d).select(F.floor(t / 3).alias("station"), F.get(F.array(F.lit("N"), F.lit("E"), F.lit("Z")), (t % 3).cast("int")).alias("channel"), (F.lit(T0) + F.floor(t / 3) * T.SECOND + (t % 3) * 500_000_000).alias("tmin_ns"), "deltat", "ydata")


@register("rotate", _PAIR + """ SELECT station, u.channel AS channel, """ + f"{T0}" + """ + station * 1000000000 + 500000000 AS tmin_ns, 63 AS n, round(list_sum(u.y), 6) + 0.0 AS total FROM w, (SELECT 1) one, LATERAL (SELECT 'R' AS channel, [n[k + 1] * cos(radians(30)) + e[k] * sin(radians(30)) for k in range(1, 64)] AS y UNION ALL SELECT 'T', [-n[k + 1] * sin(radians(30)) + e[k] * cos(radians(30)) for k in range(1, 64)]) u WHERE n IS NOT NULL AND e IS NOT NULL""")
def rotate(spark, d):
    out = pairs.rotate(_components(spark, d), ["station"], "channel", 30.0, ("N", "E"), ("R", "T"))
    return out.select("station", "channel", "tmin_ns", F.size("ydata").alias("n"), r6(A.total(F.col("ydata"))).alias("total"))


@register("project", _PAIR + """ SELECT station, 'A' AS channel, round(list_sum([0.6 * n[k + 1] - 0.8 * e[k] for k in range(1, 64)]), 6) + 0.0 AS total FROM w WHERE n IS NOT NULL AND e IS NOT NULL
UNION ALL SELECT station, 'B', round(list_sum([0.8 * n[k + 1] + 0.6 * e[k] for k in range(1, 64)]), 6) + 0.0 FROM w WHERE n IS NOT NULL AND e IS NOT NULL UNION ALL SELECT station, 'U', round(list_sum([-v for v in z]), 6) + 0.0 FROM w WHERE z IS NOT NULL""")
def project(spark, d):
    out = pairs.project(_components(spark, d), ["station"], "channel", [[0.6, -0.8, 0.0], [0.8, 0.6, 0.0], [0.0, 0.0, -1.0]], ["N", "E", "Z"], ["A", "B", "U"])
    return out.select("station", "channel", r6(A.total(F.col("ydata"))).alias("total"))


_STACK = f"""WITH {_T}, s AS (SELECT codes, trace_id % 5 AS array_id, unnest(range(64)) AS i, unnest(ydata) AS y FROM traces), h AS (SELECT k AS ishift, a AS array_id, (k * a) % 7 AS shift, 1.0 / (1 + a) AS weight FROM range(4) t(k), range(5) u(a)), f AS (SELECT codes, ishift, i + shift AS i, sum(y * weight) AS y FROM s JOIN h USING (array_id) GROUP BY codes, ishift, i + shift)"""


def _stack(spark, d, method):
    s = tables.traces(spark, d).select("codes", (F.col("trace_id") % 5).alias("array_id"), F.posexplode("ydata").alias("i", "y"))
    h = spark.range(20).select(F.floor(F.col("id") / 5).alias("ishift"), (F.col("id") % 5).alias("array_id")).withColumns({"shift": F.col("ishift") * F.col("array_id") % 7, "weight": 1 / (1 + F.col("array_id"))})
    return pairs.stack(s, h, ["codes"], method)


@register("stack", _STACK + " SELECT codes, ishift, i, round(y, 6) + 0.0 AS y FROM f")
def stack(spark, d):
    return _stack(spark, d, 0).select("codes", "ishift", "i", r6(F.col("y")).alias("y"))


@register("stack_max", _STACK + " SELECT codes, ishift, round(max(y), 6) + 0.0 AS y FROM f GROUP BY codes, ishift")
def stack_max(spark, d):
    return _stack(spark, d, 1).select("codes", "ishift", r6(F.col("y")).alias("y"))


@register("consistency", """WITH e AS (SELECT o_custkey AS k, 'status' AS "column", o_orderstatus AS value FROM orders UNION ALL SELECT o_custkey, 'priority', o_orderpriority FROM orders), c AS (SELECT k, "column", value, count(*) AS n FROM e WHERE value IS NOT NULL GROUP BY ALL) SELECT k, "column", count(*) AS n_values, arg_min(value, (-n, value)) AS merged FROM c GROUP BY k, "column" """)
def consistency(spark, d):
    o = tables.read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return pairs.consistency(o, ["k"], ["status", "priority"])


@register("moving_average", f"""WITH {_P}, w AS (SELECT codes, i, row_number() OVER o - 1 AS j, count(*) OVER (PARTITION BY codes) AS n, avg(y) OVER (PARTITION BY codes ORDER BY i ROWS BETWEEN 2 PRECEDING AND 4 FOLLOWING) AS m FROM samples WINDOW o AS (PARTITION BY codes ORDER BY i)),
e AS (SELECT *, max(m) FILTER (j = 3) OVER (PARTITION BY codes) AS lo, max(m) FILTER (j = n - 5) OVER (PARTITION BY codes) AS hi FROM w) SELECT codes, i, round(CASE WHEN n <= 7 THEN 0 WHEN j < 3 THEN lo WHEN j > n - 5 THEN hi ELSE m END, 6) + 0.0 AS avg FROM e""")
def moving_average(spark, d):
    return wn.moving_avg(tables.samples(spark, d), "y", 7, ["codes"], "i").select("codes", "i", r6(F.col("avg")).alias("avg"))


@register("moving_sum", f"WITH {_P} SELECT codes, i, round(sum(y) OVER (PARTITION BY codes ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS total FROM samples")
def moving_sum(spark, d):
    return wn.moving_sum(tables.samples(spark, d), "y", 5, ["codes"], "i").select("codes", "i", r6(F.col("total")).alias("total"))


@register("sta_lta", f"""WITH {_P}, w AS (SELECT codes, i, row_number() OVER (PARTITION BY codes ORDER BY i) AS j, avg(y * y) OVER (PARTITION BY codes ORDER BY i ROWS 3 PRECEDING) AS s, avg(y * y) OVER (PARTITION BY codes ORDER BY i ROWS 15 PRECEDING) AS l FROM samples) SELECT codes, i, round(s / l * 4 / 16, 6) + 0.0 AS ratio FROM w WHERE j >= 16""")
def sta_lta(spark, d):
    return wn.sta_lta_right(tables.samples(spark, d), "y", 4, 16, ["codes"], "i").select("codes", "i", r6(F.col("ratio")).alias("ratio"))


@register("sta_lta_centered", f"""WITH {_P}, sq AS (SELECT codes, i, y * y AS y2 FROM samples),
sw AS (SELECT *, row_number() OVER (PARTITION BY codes ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY codes) AS nn, avg(y2) OVER (PARTITION BY codes ORDER BY i ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS m FROM sq),
se AS (SELECT *, max(m) FILTER (j = 2) OVER (PARTITION BY codes) AS lo, max(m) FILTER (j = nn + -3) OVER (PARTITION BY codes) AS hi FROM sw),
s AS (SELECT * EXCLUDE (j, nn, m, lo, hi), CASE WHEN nn <= 4 THEN 0 WHEN j < 2 THEN lo WHEN j > nn + -3 THEN hi ELSE m END AS sv FROM se),
lw AS (SELECT *, row_number() OVER (PARTITION BY codes ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY codes) AS nn, avg(y2) OVER (PARTITION BY codes ORDER BY i ROWS BETWEEN 7 PRECEDING AND 8 FOLLOWING) AS m FROM s),
le AS (SELECT *, max(m) FILTER (j = 8) OVER (PARTITION BY codes) AS lo, max(m) FILTER (j = nn + -9) OVER (PARTITION BY codes) AS hi FROM lw),
l AS (SELECT * EXCLUDE (j, nn, m, lo, hi), CASE WHEN nn <= 16 THEN 0 WHEN j < 8 THEN lo WHEN j > nn + -9 THEN hi ELSE m END AS lv FROM le)
SELECT codes, i, round(CASE WHEN lw IS NULL THEN 0.0 ELSE greatest((sv / lw - 1) / 3, 0.0) END, 6) + 0.0 AS ratio FROM (SELECT *, CASE WHEN lv = 0 THEN NULL ELSE lv END AS lw FROM l)""")
def sta_lta_centered(spark, d):
    return wn.sta_lta_centered(tables.samples(spark, d), "y", 4, 16, ["codes"], "i", scaling=3).select("codes", "i", r6(F.col("ratio")).alias("ratio"))


@register("peaks", f"""WITH {_P}, w AS (SELECT codes, i, y, lag(y) OVER (PARTITION BY codes ORDER BY i) AS before, max(y) OVER (PARTITION BY codes ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS peak, arg_max(i, (y, -i)) OVER (PARTITION BY codes ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS peak_at FROM samples) SELECT codes, i, peak, peak_at FROM w WHERE before <= 15 AND y > 15""")
def peaks(spark, d):
    return wn.peak_candidates(tables.samples(spark, d), "y", 15.0, 5, ["codes"], "i").select("codes", "i", "peak", "peak_at")


@register("chopper", f"""WITH {_N}, w AS (SELECT k AS iwin, {Y1997} + k * {30 * T.DAY} AS wmin_ns, least({Y1997} + (k + 1) * {30 * T.DAY}, {JUN98}) AS wmax_ns FROM range(0, {-(-(JUN98 - Y1997) // (30 * T.DAY))}) t(k))
SELECT iwin, string_split(codes, '.')[1] || '.' || string_split(codes, '.')[2] AS "group", count(*) AS n, sum((least(tmax_ns, wmax_ns + {T.DAY}) - greatest(tmin_ns, wmin_ns - {T.DAY})) // 1000000000)::BIGINT AS seconds FROM nuts JOIN w ON tmin_ns < wmax_ns + {T.DAY} AND tmax_ns > wmin_ns - {T.DAY} GROUP BY ALL""")
def chopper(spark, d):
    out = wn.chopper(tables.nuts(spark, d), Y1997, JUN98, 30 * T.DAY, T.DAY, grouping="station")
    return out.groupBy(F.col("iwin").cast("long").alias("iwin"), "group").agg(F.count("*").alias("n"), F.sum(F.floor((F.col("cut_max_ns") - F.col("cut_min_ns")) / T.SECOND)).alias("seconds"))


@register("window_list", f"""WITH {_N}, w AS (SELECT k::INT AS iwin, {Y1997 // (7 * T.DAY) * 7 * T.DAY} + k * {7 * T.DAY} AS wmin_ns, {Y1997 // (7 * T.DAY) * 7 * T.DAY} + (k + 1) * {7 * T.DAY} AS wmax_ns FROM range(0, {-(-Y1999 // (7 * T.DAY)) - Y1997 // (7 * T.DAY)}) t(k))
SELECT iwin, wmin_ns, wmax_ns, count(tmin_ns) AS n FROM w LEFT JOIN nuts ON tmin_ns >= wmin_ns AND tmin_ns < wmax_ns GROUP BY ALL""")
def window_list(spark, d):
    """Weeks, and how many entries begin in each."""
    begun = tables.nuts(spark, d).groupBy((T.floor_div(F.col("tmin_ns"), 7 * T.DAY) * (7 * T.DAY)).alias("wmin_ns")).agg(F.count("*").alias("n"))
    return wn.windows(spark, Y1997, Y1999, 7 * T.DAY, snap=True).join(begun, "wmin_ns", "left").select("iwin", "wmin_ns", "wmax_ns", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@register("calendar_months", f"""WITH {_S}, x AS (SELECT codes, element, tmin_ns, tmax_ns, unnest(generate_series(date_trunc('month', make_timestamp(tmin_ns // 1000)), date_trunc('month', make_timestamp((tmax_ns - 1) // 1000)), INTERVAL 1 MONTH)) AS w FROM spans) SELECT codes, element, epoch_us(w) * 1000 AS wmin_ns, epoch_us(w + INTERVAL 1 MONTH) * 1000 AS wmax_ns, greatest(tmin_ns, epoch_us(w) * 1000) AS cut_min_ns, least(tmax_ns, epoch_us(w + INTERVAL 1 MONTH) * 1000) AS cut_max_ns FROM x""")
def calendar_months(spark, d):
    return wn.calendar(tables.group_spans(spark, d), "month").select("codes", "element", "wmin_ns", "wmax_ns", "cut_min_ns", "cut_max_ns")
