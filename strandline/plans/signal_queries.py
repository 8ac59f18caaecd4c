"""Queries over signal, joining and Green's function operators; SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import response as R
from ..functions import scalars as S
from ..operators import greens as gf
from ..operators import joining as jn
from ..operators import signal as sg
from . import tables
from .trace_queries import T0, r6

_T = tables.SQL["traces"]
QUERIES, ORACLE_SQL = {}, {}


def register(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _size(df, *more):
    return df.select("trace_id", *more, F.size("ydata").alias("n"), r6(A.total(F.col("ydata"))).alias("total"), r6(A.total(F.transform("ydata", lambda v: v * v))).alias("energy"))


def _plain(name, f):
    register(name, None)(lambda spark, d: _size(f(tables.traces(spark, d))))


_plain("filter_lowpass", lambda t: sg.lowpass(t, 0.3))
_plain("filter_highpass", lambda t: sg.highpass(t, 0.2))
_plain("filter_bandpass", lambda t: sg.bandpass(t, 0.1, 0.5))
_plain("filter_bandstop", lambda t: sg.bandstop(t, 0.3, 0.5))
_plain("filter_bandpass_fft", lambda t: sg.bandpass_fft(t, 0.1, 0.5))
_plain("envelope", sg.envelope)
_plain("whiten", sg.whiten)
_plain("spectral_whiten", lambda t: sg.spectral_whiten(t, 0.1))
_plain("recursive_sta_lta", lambda t: sg.recursive_sta_lta(t, 1.0, 5.0))
_plain("resample", lambda t: sg.resample(t, 0.25))
_plain("transfer", lambda t: sg.transfer(t, R.multiply(R.butterworth(0.3, 3), R.delay(0.5)), (0.01, 0.02, 0.6, 0.9)))
_plain("restitution", lambda t: sg.transfer(t, R.pole_zero([0, 0], [-0.2 + 0.2j, -0.2 - 0.2j], 2.0), (0.02, 0.05, 0.5, 0.8), invert=True, tfade=2.0))
_plain("filter_bank", lambda t: sg.filter_bank(t, [0.1, 0.2, 0.4], 0.5).drop("centre"))


@register("downsample", None)
def downsample(spark, d):
    return _size(sg.downsample(tables.traces(spark, d), 2), "tmin_ns", "deltat")


@register("spectrum", f"""WITH {_T}, s AS (SELECT trace_id, ydata, k FROM traces, range(33) r(k))
SELECT trace_id, round(k / 32.0, 6) + 0.0 AS freq, round(list_sum([ydata[j + 1] * cos(2 * pi() * k * j / 64) for j in range(64)]), 5) + 0.0 AS re, round(-list_sum([ydata[j + 1] * sin(2 * pi() * k * j / 64) for j in range(64)]), 5) + 0.0 AS im FROM s""")
def spectrum(spark, d):
    s = sg.spectrum(tables.traces(spark, d))
    z = F.explode(F.arrays_zip("freq", "re", "im"))
    return s.select("trace_id", z.alias("z")).select("trace_id", r6(F.col("z.freq")).alias("freq"), (F.round("z.re", 5) + 0.0).alias("re"), (F.round("z.im", 5) + 0.0).alias("im"))


@register("autocorrelation", f"""WITH {_T}, c AS (SELECT trace_id, [v - list_sum(ydata) / 64 for v in ydata] AS y FROM traces) SELECT trace_id, k::INT AS lag, round(list_sum([y[j] * y[j + k] for j in range(1, 65 - k)]) / 64, 6) + 0.0 AS c FROM c, range(5) r(k)""")
def autocorrelation(spark, d):
    return sg.autocorr(tables.traces(spark, d), 5).select("trace_id", F.posexplode("ydata").alias("lag", "c")).select("trace_id", "lag", r6(F.col("c")).alias("c"))


def _pairs(spark, d):
    t = tables.traces(spark, d)
    return t.select("trace_id", F.col("ydata").alias("ya"), F.col("tmin_ns").alias("ta_ns"), "deltat").join(t.select((F.col("trace_id") - 1).alias("trace_id"), F.slice("ydata", 1, 50).alias("yb"), F.col("tmin_ns").alias("tb_ns")), "trace_id")


_PAIRS = f"WITH {_T}, p AS (SELECT a.trace_id AS trace_id, a.ydata AS ya, b.ydata[1:50] AS yb, b.tmin_ns - a.tmin_ns AS dt FROM traces a JOIN traces b ON b.trace_id = a.trace_id + 1)"


@register("correlate", _PAIRS + """ SELECT trace_id, dt + k * 500000000 AS t_ns, round(list_sum([ya[j] * yb[j + k] for j in range(greatest(1, 1 - k), least(64, 50 - k) + 1)]), 6) + 0.0 AS c FROM p, range(-63, 50) r(k)""")
def correlate(spark, d):
    c = sg.correlate(_pairs(spark, d))
    return c.select("trace_id", "tmin_ns", F.posexplode("c").alias("k", "c")).select("trace_id", (F.col("tmin_ns") + F.col("k").cast("long") * 500_000_000).alias("t_ns"), r6(F.col("c")).alias("c"))


@register("correlate_normal_valid", _PAIRS + """ SELECT trace_id, dt + k * 500000000 AS t_ns, round(list_sum([ya[j] * yb[j + k] for j in range(1 - k, 50 - k + 1)]) / sqrt(list_sum([v * v for v in ya]) * list_sum([v * v for v in yb])), 6) + 0.0 AS c FROM p, range(-14, 1) r(k)""")
def correlate_normal_valid(spark, d):
    c = sg.correlate(_pairs(spark, d), "valid", normal=True)
    return c.select("trace_id", "tmin_ns", F.posexplode("c").alias("k", "c")).select("trace_id", (F.col("tmin_ns") + F.col("k").cast("long") * 500_000_000).alias("t_ns"), r6(F.col("c")).alias("c"))


@register("deconvolve", None)
def deconvolve(spark, d):
    return sg.deconvolve(_pairs(spark, d), 0.01).select("trace_id", r6(A.total(F.col("c"))).alias("total"))


@register("peaks_dead_time", None)
def peaks_dead_time(spark, d):
    return sg.peaks(tables.traces(spark, d), 0.2, 2.0, 4.0).select("trace_id", "peak_ns", r6(F.col("peak")).alias("peak"))


@register("peaks_by_size", None)
def peaks_by_size(spark, d):
    return sg.peaks(tables.traces(spark, d), 0.2, 2.0, by_size=True).select("trace_id", "peak_ns", r6(F.col("peak")).alias("peak"))


def _chunks(spark, d, gap: int):
    """Traces of one code laid end to end, with gaps (or, below 0, overlaps) of as many samples."""
    k = F.col("trace_id")
    return tables.traces(spark, d).select((k % 10).alias("codes"), "deltat", (F.lit(T0) + F.floor(k / 10) * ((64 + gap) * 500_000_000)).alias("tmin_ns"), "ydata")


def _each(df, *keys):
    """One row for each sample, with the start of its trace."""
    return df.select(*keys, "tmin_ns", F.posexplode("ydata").alias("i", "y")).select(*keys, "tmin_ns", (F.col("tmin_ns") + F.col("i") * F.lit(500_000_000).cast("long")).alias("t_ns"), r6(F.col("y")).alias("y"))


def _laid(gap: int) -> str:
    """The samples of _chunks: number j of the trace, place k in it."""
    return f"WITH {_T}, x AS (SELECT trace_id % 10 AS codes, trace_id // 10 AS j, k, {T0} + ((trace_id // 10) * {64 + gap} + k) * 500000000 AS t_ns, ydata[k + 1] AS y FROM traces, range(64) r(k))"


@register("degap", f"{_laid(0)} SELECT codes, {T0} AS tmin_ns, t_ns, round(y, 6) + 0.0 AS y FROM x")
def degap(spark, d):
    return _each(jn.degap(_chunks(spark, d, 0), ["codes"]), "codes")


@register("degap_fill", f"""{_laid(2)}, l AS (SELECT a.codes, a.t_ns + h * 500000000 AS t_ns, a.y + (b.y - a.y) * h / 3.0 AS y FROM x a JOIN x b ON a.codes = b.codes AND b.j = a.j + 1 AND a.k = 63 AND b.k = 0, range(1, 3) r(h))
SELECT codes, {T0} AS tmin_ns, t_ns, round(y, 6) + 0.0 AS y FROM (SELECT codes, t_ns, y FROM x UNION ALL SELECT * FROM l)""")
def degap_fill(spark, d):
    return _each(jn.degap(_chunks(spark, d, 2), ["codes"]), "codes")


@register("degap_overlap", f"{_laid(-3)} SELECT codes, {T0} AS tmin_ns, t_ns, round(arg_max(y, j), 6) + 0.0 AS y FROM x GROUP BY codes, t_ns")
def degap_overlap(spark, d):
    """Where two traces overlap the second one's samples stay."""
    return _each(jn.degap(_chunks(spark, d, -3), ["codes"]), "codes")


@register("deoverlap", f"{_laid(-10)} SELECT codes, {T0} + (j * 54 + CASE WHEN j > 0 THEN 10 ELSE 0 END) * 500000000 AS tmin_ns, t_ns, round(y, 6) + 0.0 AS y FROM x WHERE j = 0 OR k >= 10")
def deoverlap(spark, d):
    return _each(jn.deoverlap(_chunks(spark, d, -10), ["codes"], "first"), "codes")


@register("merge_archives", f"{_laid(0)} SELECT codes, {T0} AS tmin_ns, t_ns, round(y + CASE WHEN j % 2 = 0 THEN 1 ELSE 0 END, 6) + 0.0 AS y FROM x")
def merge_archives(spark, d):
    """Even chunks, whose samples are one more, against all chunks: one trace per code comes out, with theirs where both are."""
    all_of = _chunks(spark, d, 0)
    even = all_of.where((F.col("tmin_ns") - T0) % (2 * 64 * 500_000_000) == 0).withColumn("ydata", F.transform("ydata", lambda v: v + 1))
    return _each(jn.merge_archives(even, all_of, ["codes"]), "codes")


@register("event_groups", """WITH g AS (SELECT user_id AS codes, event_id, epoch_us(ts) * 1000 AS t_ns, coalesce(epoch_us(ts) * 1000 - lag(epoch_us(ts) * 1000) OVER (PARTITION BY user_id ORDER BY ts) >= 7200000000000, true)::INT AS fresh FROM events) SELECT codes, event_id, (sum(fresh) OVER (PARTITION BY codes ORDER BY t_ns ROWS UNBOUNDED PRECEDING))::BIGINT AS "group" FROM g""")
def event_groups(spark, d):
    s = tables.samples(spark, d)
    return jn.group_events(s, ["codes"], 7200 * 10**9).select("codes", F.col("i").alias("event_id"), "group")


# Green's functions: the traces are records of grids of 5 depths and 5 distances with 10 components, one grid behind the other.
# Every customer is a target, of one of the grids.
def _store(spark, d):
    return tables.traces(spark, d).select(F.col("trace_id").alias("irecord"), (F.col("trace_id") % 7).cast("int").alias("itmin"), F.col("ydata").alias("data"))


def _axes():
    return [(F.col("grid"), 0.0, 1.0, 1 << 40), (F.col("depth"), 0.0, 10.0, 5), (F.col("dist"), 100.0, 50.0, 5)]


def _n_grids(spark, d):
    return tables.traces(spark, d).agg(F.floor(F.count("*") / 250).alias("n_grids"))


def _pairs_gf(spark, d):
    k = F.col("c_custkey")
    return tables.read(spark, d, "customer").join(F.broadcast(_n_grids(spark, d)), F.lit(True)).select(k.alias("pair"), (k % F.col("n_grids")).cast("double").alias("grid"), (k * 7 % 41).cast("double").alias("depth"), (k * 13 % 201 + 100).cast("double").alias("dist"), (k * 17 % 360).cast("double").alias("azi"), (k * 29 % 360).cast("double").alias("bazi"), (k % 9 * 0.35).alias("delay"))


_GF = """WITH """ + _T + """, p AS (SELECT c_custkey AS pair, ((c_custkey * 7) % 41)::DOUBLE AS depth, ((c_custkey * 13) % 201 + 100)::DOUBLE AS dist, (c_custkey % 9) * 0.35::DOUBLE AS delay, (c_custkey % (SELECT count(*) // 250 FROM embeddings)) * 25 AS g FROM customer),
x AS (SELECT *, depth / 10 AS x, (dist - 100) / 50 AS y FROM p), v AS (SELECT pair, delay, g, floor(x) AS a, ceil(x) AS b, floor(y) AS c, ceil(y) AS e, x, y FROM x),
k AS (SELECT pair, delay, ((g + a * 5 + c) * 10)::BIGINT AS irecord, (1 - (x - a)) * (1 - (y - c)) AS w FROM v UNION ALL SELECT pair, delay, ((g + b * 5 + c) * 10)::BIGINT, (1 - (b - x)) * (b - a) * (1 - (y - c)) FROM v
 UNION ALL SELECT pair, delay, ((g + a * 5 + e) * 10)::BIGINT, (1 - (x - a)) * (1 - (e - y)) * (e - c) FROM v UNION ALL SELECT pair, delay, ((g + b * 5 + e) * 10)::BIGINT, (1 - (b - x)) * (b - a) * (1 - (e - y)) * (e - c) FROM v),
t AS (SELECT pair, irecord, delay, sum(w) AS w FROM k WHERE w <> 0 GROUP BY ALL)"""


@register("gf_vicinity", _GF + " SELECT pair, irecord, round(w, 6) + 0.0 AS weight FROM t")
def gf_vicinity(spark, d):
    p = _pairs_gf(spark, d)
    return p.select("pair", F.explode(gf.vicinity(_axes(), 10)).alias("c")).select("pair", "c.irecord", r6(F.col("c.weight")).alias("weight"))


@register("gf_nearest", "WITH p AS (SELECT c_custkey AS pair, ((c_custkey * 7) % 41)::DOUBLE AS depth, ((c_custkey * 13) % 201 + 100)::DOUBLE AS dist, (c_custkey % (SELECT count(*) // 250 FROM embeddings)) * 25 AS g FROM customer) SELECT pair, ((g + round_even(depth / 10, 0) * 5 + round_even((dist - 100) / 50, 0)) * 10)::BIGINT AS irecord FROM p")
def gf_nearest(spark, d):
    return _pairs_gf(spark, d).select("pair", gf.nearest_record(_axes(), 10).alias("irecord"))


def _terms(spark, d):
    p = _pairs_gf(spark, d)
    return p.select("pair", "delay", F.explode(gf.vicinity(_axes(), 10)).alias("c")).select("pair", "c.irecord", "delay", "c.weight")


@register("gf_sum", _GF + """, h AS (SELECT pair, irecord, floor(delay / 0.5)::BIGINT AS s, w * (1 - (delay / 0.5 - floor(delay / 0.5))) AS w FROM t UNION ALL SELECT pair, irecord, floor(delay / 0.5)::BIGINT + 1, w * (delay / 0.5 - floor(delay / 0.5)) FROM t),
m AS (SELECT pair, h.irecord, trace_id % 7 + s AS first, w, ydata FROM h JOIN traces ON trace_id = h.irecord WHERE w <> 0), r AS (SELECT pair, min(first) AS lo, max(first + 63) AS hi FROM m GROUP BY pair),
z AS (SELECT m.pair AS pair, unnest(range(lo, hi + 1)) AS it, first, w, ydata FROM m JOIN r ON m.pair = r.pair) SELECT pair, it, round(sum(w * ydata[least(greatest(it - first, 0), 63) + 1]), 6) + 0.0 AS y FROM z GROUP BY pair, it""")
def gf_sum(spark, d):
    return gf.delayed_sum(_store(spark, d), _terms(spark, d), ["pair"], 0.5).select("pair", "it", r6(F.col("y")).alias("y"))


@register("gf_static", _GF + " SELECT pair, round(sum(w * ydata[least(greatest(40 - trace_id % 7, 0), 63) + 1]), 6) + 0.0 AS y FROM t JOIN traces ON trace_id = irecord GROUP BY pair")
def gf_static(spark, d):
    return gf.static_sum(_store(spark, d), _terms(spark, d), ["pair"], 40).select("pair", r6(F.col("y")).alias("y"))


@register("gf_seismograms", None)
def gf_seismograms(spark, d):
    """Three components of double couples, with a triangular source time function."""
    p = _pairs_gf(spark, d)
    m6 = S.dc_to_m6(F.col("azi"), F.lit(60.0), F.lit(90.0), F.lit(1.0))
    weights, stf = gf.elastic10_weights(m6, F.col("azi"), F.col("bazi")), gf.stf_weights("triangular", 3.0, 0.5)
    out = gf.component_sum(_store(spark, d), p, ["pair"], gf.vicinity(_axes(), 10), weights, F.col("delay"), 0.5, 10, stf)
    return out.select("pair", "component", "it", r6(F.col("y")).alias("y"))


_FORCE = """, f AS (SELECT c_custkey AS pair, radians(c_custkey * 17 % 360) AS a, radians(c_custkey * 29 % 360) - pi() AS b, -0.2 AS d FROM customer), g AS (SELECT pair, b, d, cos(a) + 0.5 * sin(a) AS along, 0.5 * cos(a) - sin(a) AS across FROM f),
o AS (SELECT pair, 'n' AS component, unnest([0, 1, 2]) AS ig, unnest([cos(b) * d, cos(b) * along, -sin(b) * across]) AS c FROM g UNION ALL SELECT pair, 'e', unnest([0, 1, 2]), unnest([sin(b) * d, sin(b) * along, cos(b) * across]) FROM g UNION ALL SELECT pair, 'd', unnest([3, 4]), unnest([d, along]) FROM g)
SELECT pair, component, round(sum(w * c * ydata[least(greatest(40 - trace_id % 7, 0), 63) + 1]), 6) + 0.0 AS y FROM t JOIN o USING (pair) JOIN traces ON trace_id = irecord + ig WHERE c <> 0 GROUP BY pair, component"""


@register("gf_force", _GF + _FORCE)
def gf_force(spark, d):
    p = _pairs_gf(spark, d)
    weights = gf.elastic5_weights([F.lit(1.0), F.lit(0.5), F.lit(-0.2)], F.col("azi"), F.col("bazi"))
    return gf.component_static(_store(spark, d), p, ["pair"], gf.vicinity(_axes(), 10), weights, 40, 10).select("pair", "component", r6(F.col("y")).alias("y"))


@register("gf_check", f"WITH {_T}, s AS (SELECT CASE WHEN trace_id % 17 = 0 THEN trace_id // 2 ELSE trace_id END AS k, trace_id % 13 = 0 AS empty, trace_id % 13 <> 0 AND trace_id % 11 = 0 AS bad FROM traces), r AS (SELECT k, count(*) AS n, bool_and(empty) AS empty, bool_or(bad) AS bad FROM s GROUP BY k) SELECT count(*) AS n_records, count(*) FILTER (empty) AS n_empty, count(*) FILTER (n > 1) AS n_repeated, count(*) FILTER (bad) AS n_bad FROM r")
def gf_check(spark, d):
    """A store with faults: records without samples, some with a sample that is no number, some under a number that is taken."""
    k, s = F.col("irecord"), _store(spark, d)
    data = F.when(k % 13 == 0, F.array().cast("array<double>")).when(k % 11 == 0, F.transform("data", lambda v, i: F.when(i == 3, float("nan")).otherwise(v))).otherwise(F.col("data"))
    return gf.check_store(s.withColumns({"data": data, "irecord": F.when(k % 17 == 0, F.floor(k / 2)).otherwise(k)}))


@register("rectangular_source", """WITH s AS (SELECT p_partkey AS source, radians((p_partkey * 7) % 360) AS st, radians((p_partkey * 11) % 91) AS dp, 1000.0 + p_size * 100 AS l, 500.0 + p_size * 40 AS w FROM part), g AS (SELECT *, ((il + 0.5) / 4 - 0.5) * l AS x, ((iw + 0.5) / 3 - 0.5) * w AS y FROM s, range(4) a(il), range(3) b(iw))
SELECT source, il::INT AS il, iw::INT AS iw, round(x * cos(st) - y * cos(dp) * sin(st), 4) + 0.0 AS north, round(x * sin(st) + y * cos(dp) * cos(st), 4) + 0.0 AS east, round(y * sin(dp), 4) + 0.0 AS depth, round(sqrt(pow(x - 0.5 * l / 2, 2) + y * y) / 2500, 6) + 0.0 AS time FROM g""")
def rectangular_source(spark, d):
    k = F.col("p_partkey")
    s = tables.read(spark, d, "part").select(k.alias("source"), (k * 7 % 360).alias("strike"), (k * 11 % 91).alias("dip"), (1000.0 + F.col("p_size") * 100).alias("length"), (500.0 + F.col("p_size") * 40).alias("width"), F.lit(0.5).alias("nucleation_x"))
    out = gf.rectangular_source(s, 4, 3, 2500.0)
    return out.select("source", "il", "iw", *((F.round(c, 4) + 0.0).alias(c) for c in ("north", "east", "depth")), r6(F.col("time")).alias("time"))
