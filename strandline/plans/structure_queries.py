"""Queries over archives as a data source, filters along channels, thinning, components and response chains; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions
from ..functions import kernels as K
from ..functions.times import ns_of
from ..operators import components, deltas, graph, index, polygons, recursion, selections, settle, stages, thinning
from ..sources import archive_source
from . import tables
from .signal_queries import _chunks
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


def _samples(df, *keys: str):
    """One row for each sample of (keys, tmin_ns, deltat, ydata)."""
    return df.select(*keys, "tmin_ns", "deltat", F.posexplode("ydata").alias("i", "y")).select(*keys, (F.col("tmin_ns") + F.col("i") * F.round(F.col("deltat") * 1e9).cast("long")).alias("t_ns"), "y")


LO, HI = T0 + 100 * 10**9, T0 + 700 * 10**9


@register("archive_scan", f"""WITH {_T} SELECT 'XX.C' || (trace_id % 10) || '..Z.' AS codes, {T0} + (trace_id // 10) * 33000000000 + k * 500000000 AS t_ns, round(ydata[k + 1], 6) + 0.0 AS y FROM traces, range(64) r(k) WHERE trace_id % 10 IN (1, 2, 3) AND {T0} + (trace_id // 10) * 33000000000 + k * 500000000 BETWEEN {LO} AND {HI - 1}""")
def archive_scan(spark, d):
    """Traces written as records through the data source, and read back by codes and time."""
    path = settle.new_path(spark, "archive")
    laid = _chunks(spark, d, 2).withColumn("codes", F.concat(F.lit("XX.C"), F.col("codes").cast("string"), F.lit("..Z.")))
    archive_source.save(laid.repartition("codes"), path, power=9)
    found = archive_source.scan(spark, path, LO, HI, r"XX\.C[123]\..*")
    return _samples(found, "codes").where(F.col("t_ns").between(LO, HI - 1)).select("codes", "t_ns", r6(F.col("y")).alias("y"))


@register("filter_channels", f"""WITH RECURSIVE {_T},
x AS (SELECT trace_id % 10 AS codes, (trace_id // 10) * 64 + k AS i, {T0} + (trace_id // 10) * 32000000000 + k * 500000000 AS t_ns, ydata[k + 1] AS x, ydata[k + 1] AS now FROM traces, range(64) r(k)),
l AS (SELECT codes, list(x ORDER BY i) AS xs, count(*) AS n FROM x GROUP BY codes),
s AS (SELECT codes, 0::BIGINT AS i, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM l
      UNION ALL SELECT s.codes, s.i + 1, 0.2 * l.xs[s.i + 1] + s.z AS y, 0.1 * l.xs[s.i + 1] + 0.7 * (0.2 * l.xs[s.i + 1] + s.z) AS z FROM s JOIN l USING (codes) WHERE s.i < l.n)
SELECT s.codes, {T0} + (s.i - 1) * 500000000 AS t_ns, round(s.y, 6) + 0.0 AS y FROM s WHERE s.i > 0""")
def filter_channels(spark, d):
    """A recursive filter over channels that lie in many pieces."""
    rows = K.sections_of([0.2, 0.1], [1.0, -0.7])
    out = recursion.filter_channels(_chunks(spark, d, 0), rows, ["codes"], width=300 * 10**9)
    return _samples(out, "codes").select("codes", "t_ns", r6(F.col("y")).alias("y"))


@register("filter_channels_gaps", f"""WITH RECURSIVE {_T},
l AS (SELECT trace_id, trace_id % 10 AS codes, {T0} + (trace_id // 10) * 33500000000 AS t0, ydata AS xs FROM traces),
s AS (SELECT trace_id, 0::BIGINT AS i, 0.0::DOUBLE AS y FROM l UNION ALL SELECT s.trace_id, s.i + 1, 0.5 * l.xs[s.i + 1] + 0.5 * s.y FROM s JOIN l USING (trace_id) WHERE s.i < 64)
SELECT l.codes, l.t0 + (s.i - 1) * 500000000 AS t_ns, round(s.y, 6) + 0.0 AS y FROM s JOIN l USING (trace_id) WHERE s.i > 0""")
def filter_channels_gaps(spark, d):
    """The same where every piece is followed by a gap: each starts from rest."""
    out = recursion.filter_channels(_chunks(spark, d, 3), K.sections_of([0.5], [1.0, -0.5]), ["codes"], width=300 * 10**9)
    return _samples(out, "codes").select("codes", "t_ns", r6(F.col("y")).alias("y"))


@register("stations_by_radius", f"""WITH RECURSIVE {tables.SQL['places']},
o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY w, place) AS i, place, lat, lon FROM places),
near AS MATERIALIZED (SELECT a.i, list(b.i) AS nb FROM o a JOIN o b ON b.i < a.i AND abs(a.lat - b.lat) <= 9
  AND degrees(2 * asin(least(1.0, sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)))) <= 8.3 GROUP BY a.i),
g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept
      UNION ALL SELECT g.i + 1, CASE WHEN near.nb IS NOT NULL AND list_has_any(g.kept, near.nb) THEN g.kept ELSE list_append(g.kept, g.i + 1) END FROM g LEFT JOIN near ON near.i = g.i + 1 WHERE g.i < (SELECT max(i) FROM o))
SELECT o.place, o.lat, o.lon FROM o WHERE o.i IN (SELECT unnest(kept) FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1))""")
def stations_by_radius(spark, d):
    """Of places within 8.3 degrees of each other the one with the least balance stays."""
    return thinning.thin_by_radius(tables.places(spark, d), 8.3, "place", badness="w").select("place", "lat", "lon")


def _components(spark, d):
    """Three components under each code; their pieces follow each other with gaps of 0, 3 and 5 samples."""
    k = F.col("trace_id")
    c = (k / 4).cast("long") % 3
    gap = F.get(F.array(F.lit(0), F.lit(3), F.lit(5)), c.cast("int"))
    return tables.traces(spark, d).select((k % 4).alias("codes"), F.get(F.array(F.lit("Z"), F.lit("N"), F.lit("E")), c.cast("int")).alias("channel"), "deltat", (F.lit(T0) + (k / 12).cast("long") * (64 + gap) * F.lit(500_000_000).cast("long")).alias("tmin_ns"), "ydata")


_PTS = f"{_T}, pts AS (SELECT trace_id % 4 AS codes, (trace_id // 4) % 3 AS c, {T0} + ((trace_id // 12) * (64 + [0, 3, 5][(trace_id // 4) % 3 + 1]) + k) * 500000000 AS t_ns, ydata[k + 1] AS y FROM traces, range(64) r(k))"


@register("components_common", f"WITH {_PTS} SELECT codes, t_ns, round(max(y) FILTER (c = 0), 6) + 0.0 AS z, round(max(y) FILTER (c = 1), 6) + 0.0 AS n, round(max(y) FILTER (c = 2), 6) + 0.0 AS e FROM pts GROUP BY ALL HAVING count(DISTINCT c) = 3")
def components_common(spark, d):
    """Samples that all three components have."""
    m = components.multi_component(_components(spark, d), ["codes"], "channel", ["Z", "N", "E"], longest=100)
    rows = m.select("codes", "tmin_ns", F.posexplode(F.arrays_zip(*(F.get("ydata", F.lit(i)).alias(c) for i, c in enumerate("zne")))).alias("i", "v"))
    return rows.select("codes", (F.col("tmin_ns") + F.col("i") * F.lit(500_000_000).cast("long")).alias("t_ns"), *(r6(F.col(f"v.{c}")).alias(c) for c in "zne"))


@register("components_masks", f"WITH {_PTS}, m AS (SELECT codes, t_ns, sum(1 << c)::INT AS mask FROM (SELECT DISTINCT codes, t_ns, c FROM pts) GROUP BY ALL), s AS (SELECT *, CASE WHEN lag(mask) OVER w = mask AND lag(t_ns) OVER w = t_ns - 500000000 THEN 0 ELSE 1 END AS fresh FROM m WINDOW w AS (PARTITION BY codes ORDER BY t_ns)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY codes ORDER BY t_ns) AS k FROM s) SELECT codes, min(t_ns) AS tmin_ns, max(t_ns) + 500000000 AS tmax_ns, any_value(mask) AS mask FROM r GROUP BY codes, k")
def components_masks(spark, d):
    """Spans over which the same components are there."""
    t = _components(spark, d).withColumn("tmax_ns", F.col("tmin_ns") + F.size("ydata") * F.lit(500_000_000).cast("long"))
    return components.component_spans(t, ["codes"], "channel", ["Z", "N", "E"], 10**12)


@register("response_chain", """WITH s AS (SELECT DISTINCT l_orderkey AS epoch, l_linenumber AS stage, CASE WHEN l_linenumber = 1 THEN 'velocity' ELSE 'voltage' END AS input, CASE WHEN l_returnflag = 'R' THEN 'counts' ELSE 'voltage' END AS output, 1 + l_linenumber / 10.0::DOUBLE AS g,
  (l_partkey % 4 + 1)::DOUBLE AS z, (l_suppkey % 4 + 1)::DOUBLE AS p FROM lineitem WHERE l_orderkey % 9 <> 0 OR l_linenumber <> 2),
f AS (SELECT epoch, stage, lag(stage) OVER w <> stage - 1 AS missing, lag(output) OVER w <> input AS units FROM s WINDOW w AS (PARTITION BY epoch ORDER BY stage, input, output)),
n AS (SELECT epoch, (count(*) FILTER (missing) + count(*) FILTER (units))::INT AS n_faults FROM f GROUP BY epoch),
a AS (SELECT epoch, count(*) AS k, exp(sum(ln(g) + 0.5 * ln((4 * pi() * pi() + z * z) / (4 * pi() * pi() + p * p)))) AS amp, sum(atan2(2 * pi(), z) - atan2(2 * pi(), p)) AS arg, exp(sum(CASE WHEN stage <= 2 THEN ln(g) + 0.5 * ln((4 * pi() * pi() + z * z) / (4 * pi() * pi() + p * p)) ELSE 0 END)) AS front FROM s GROUP BY epoch),
v AS (SELECT epoch, v, sum(nz) AS nz, sum(np) AS np FROM (SELECT epoch, z AS v, 1 AS nz, 0 AS np FROM s UNION ALL SELECT epoch, p, 0, 1 FROM s) GROUP BY ALL),
c AS (SELECT epoch, sum(greatest(nz - np, 0))::INT AS n_zeros FROM v GROUP BY epoch)
SELECT epoch, n_faults, n_zeros, round(amp * cos(arg), 6) + 0.0 AS re, round(amp * sin(arg), 6) + 0.0 AS im, round(amp * cos(arg), 6) + 0.0 AS re_short, round(front, 6) + 0.0 AS front FROM a JOIN n USING (epoch) JOIN c USING (epoch)""")
def response_chain(spark, d):
    """Chains of stages from order lines: faults along them, the response before and after simplification, and that of the first two stages."""
    li = tables.read(spark, d, "lineitem").where("l_orderkey % 9 <> 0 or l_linenumber <> 2")
    root = lambda c: F.array(F.struct((-(F.col(c) % 4 + 1)).cast("double").alias("re"), F.lit(0.0).alias("im")))
    rows = li.select(
        F.col("l_orderkey").alias("epoch"), F.col("l_linenumber").alias("stage"), F.when(F.col("l_linenumber") == 1, "velocity").otherwise("voltage").alias("input"), F.when(F.col("l_returnflag") == "R", "counts").otherwise("voltage").alias("output"),
        F.lit(100.0).alias("rate_in"), F.lit(100.0).alias("rate_out"), (1 + F.col("l_linenumber") / 10).alias("constant"), root("l_partkey").alias("zeros"), root("l_suppkey").alias("poles"),
    )
    c = stages.chains(rows, ["epoch"]).withColumn("whole", stages.combined(F.col("stages")))
    c = c.withColumns({"short": stages.simplified(F.col("whole")), "front": stages.evaluate(stages.combined(stages.between(F.col("stages"), last=2)), 1.0), "h": stages.evaluate(F.col("whole"), 1.0)}).withColumn("hs", stages.evaluate(F.col("short"), 1.0))
    amp = lambda h: F.sqrt(F.col(f"{h}.re") ** 2 + F.col(f"{h}.im") ** 2)
    return c.select("epoch", F.size(stages.faults(F.col("stages"))).alias("n_faults"), F.size("short.zeros").alias("n_zeros"), r6(F.col("h.re")).alias("re"), r6(F.col("h.im")).alias("im"), r6(F.col("hs.re")).alias("re_short"), r6(amp("front")).alias("front"))


_STARS = """stars AS MATERIALIZED (SELECT p_partkey AS polygon, 5 + p_partkey % 4 AS n, radians((p_partkey * 53) % 180 - 89.5) AS la, radians((p_partkey * 149) % 360 - 179.5) AS lo, radians(1.3 + p_partkey % 7 * 1.1) AS r, radians(p_partkey % 61) AS turn, p_partkey % 197 = 0 AS outer_side FROM part),
corners AS MATERIALIZED (SELECT polygon, k, n, outer_side, cos(rr) * cos(la) * cos(lo) + sin(rr) * (-cos(az) * sin(la) * cos(lo) - sin(az) * sin(lo)) AS x, cos(rr) * cos(la) * sin(lo) + sin(rr) * (-cos(az) * sin(la) * sin(lo) + sin(az) * cos(lo)) AS y, cos(rr) * sin(la) + sin(rr) * cos(az) * cos(la) AS z, cos(la) * cos(lo) AS cx, cos(la) * sin(lo) AS cy, sin(la) AS cz
  FROM (SELECT *, r * (CASE WHEN k % 2 = 1 THEN 0.5 ELSE 1 END) AS rr, turn - 2 * pi() * k / n AS az FROM stars, range(9) t(k) WHERE k < n))"""


def _stars(spark, d):
    """Stars and other polygons around places made from parts; some hold all but their middle.

    Keys are dealt out before corners are made of them: a million keys lie in one or two partitions of their file.
    """
    k = F.col("p_partkey")
    parts = tables.read(spark, d, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    la, lo = F.radians(k * 53 % 180 - 89.5), F.radians(k * 149 % 360 - 179.5)
    stars = parts.select(k.alias("polygon"), (5 + k % 4).cast("int").alias("n"), F.radians(1.3 + k % 7 * 1.1).alias("r"), F.radians(k % 61).alias("turn"), F.cos(la).alias("cla"), F.sin(la).alias("sla"), F.cos(lo).alias("clo"), F.sin(lo).alias("slo"))
    n, r, turn, cla, sla, clo, slo = (F.col(c) for c in ("n", "r", "turn", "cla", "sla", "clo", "slo"))

    # in steps, so that each angle's sine and cosine is worked out once for a corner
    def angles(i):
        rr, az = r * F.when(i % 2 == 1, 0.5).otherwise(1.0), turn - 2 * F.pi() * i / n
        return F.struct(F.cos(rr).alias("cr"), F.sin(rr).alias("sr"), F.cos(az).alias("ca"), F.sin(az).alias("sa"))

    def place(c):
        x = c["cr"] * cla * clo + c["sr"] * (-c["ca"] * sla * clo - c["sa"] * slo)
        y = c["cr"] * cla * slo + c["sr"] * (-c["ca"] * sla * slo + c["sa"] * clo)
        return F.struct(x.alias("x"), y.alias("y"), (c["cr"] * sla + c["sr"] * c["ca"] * cla).alias("z"))

    def corner(p):
        return F.struct(F.degrees(F.atan2(p["z"], F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]))).alias("lat"), F.degrees(F.atan2(p["y"], p["x"])).alias("lon"))

    line = F.transform(F.transform(F.transform(F.sequence(F.lit(0), n - 1), angles), place), corner)
    return stars.select("polygon", F.when(F.col("polygon") % 197 == 0, F.reverse(line)).otherwise(line).alias("corners"))


@register("places_in_polygons", f"""WITH {tables.SQL['places']}, {_STARS},
p AS MATERIALIZED (SELECT place, cos(radians(lat)) * cos(radians(lon)) AS px, cos(radians(lat)) * sin(radians(lon)) AS py, sin(radians(lat)) AS pz FROM places),
e AS MATERIALIZED (SELECT a.polygon, a.outer_side, a.cx, a.cy, a.cz, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz FROM corners a JOIN corners b ON a.polygon = b.polygon AND b.k = (a.k + 1) % a.n),
held AS (SELECT place, polygon, any_value(outer_side) AS outer_side, bool_or((cy * az - cz * ay) * px + (cz * ax - cx * az) * py + (cx * ay - cy * ax) * pz >= 0
  AND (ay * bz - az * by_) * px + (az * bx - ax * bz) * py + (ax * by_ - ay * bx) * pz > 0 AND (by_ * cz - bz * cy) * px + (bz * cx - bx * cz) * py + (bx * cy - by_ * cx) * pz > 0) AS held FROM p, e GROUP BY place, polygon)
SELECT place, polygon FROM held WHERE held <> outer_side""")
def places_in_polygons(spark, d):
    """Places in as many polygons as there are parts, at the poles and across the date line too."""
    return polygons.points_in_polygons(tables.places(spark, d).select("place", "lat", "lon"), _stars(spark, d), "polygon").select("place", "polygon")


@register("polygon_cells", f"WITH {_STARS} SELECT polygon, n::INT AS n_edges, true AS whole FROM stars")
def polygon_cells(spark, d):
    """Every edge of a polygon lies in cells of its cover, and no cell lies in another of the same polygon."""
    c = polygons.cover(_stars(spark, d), "polygon", numbers=True).select("id", "cell", "edges")
    n = F.size(F.array_distinct(F.flatten(F.collect_list("edges"))))
    whole = F.count("*") == F.size(F.array_distinct(F.collect_list("cell")))
    return c.groupBy(F.col("id").alias("polygon")).agg(n.alias("n_edges"), whole.alias("whole"))


_ASKED = """asked AS (SELECT l_returnflag AS network, 'S' || (l_suppkey % 20) AS station, '' || (l_linenumber % 2) AS location, 'C' || (l_partkey % 7) AS channel, epoch_us(date_trunc('month', l_shipdate)) * 1000 AS tmin_ns, epoch_us(date_trunc('month', l_shipdate) + INTERVAL 1 MONTH) * 1000 AS tmax_ns FROM lineitem)"""


@register("selections_merged", f"""WITH {_ASKED},
f AS (SELECT *, coalesce(lag(tmax_ns) OVER (PARTITION BY network, station, location, channel ORDER BY tmin_ns) < tmin_ns, true)::INT AS fresh FROM (SELECT DISTINCT * FROM asked)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY network, station, location, channel ORDER BY tmin_ns) AS k FROM f),
t AS (SELECT network, station, location, channel, min(tmin_ns) AS tmin_ns, max(tmax_ns) AS tmax_ns FROM g GROUP BY network, station, location, channel, k),
c AS (SELECT network, station, location, list(channel ORDER BY channel) AS channel, tmin_ns, tmax_ns FROM t GROUP BY ALL),
l AS (SELECT network, station, list(location ORDER BY location) AS location, channel, tmin_ns, tmax_ns FROM c GROUP BY network, station, channel, tmin_ns, tmax_ns),
s AS (SELECT network, list(station ORDER BY station) AS station, location, channel, tmin_ns, tmax_ns FROM l GROUP BY network, location, channel, tmin_ns, tmax_ns)
SELECT array_to_string(list(network ORDER BY network), '|') AS network, array_to_string(station, '|') AS station, array_to_string(location, '|') AS location, array_to_string(channel, '|') AS channel, tmin_ns, tmax_ns FROM s GROUP BY station, location, channel, tmin_ns, tmax_ns""")
def selections_merged(spark, d):
    """Months asked for by order lines as the rectangles to request."""
    month = F.date_trunc("month", "l_shipdate")
    asked = tables.read(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("network"), F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string")).alias("station"), (F.col("l_linenumber") % 2).cast("string").alias("location"), F.concat(F.lit("C"), (F.col("l_partkey") % 7).cast("string")).alias("channel"),
        ns_of(month).alias("tmin_ns"), ns_of(month + F.expr("INTERVAL 1 MONTH")).alias("tmax_ns"),
    )
    return selections.merge_selections(asked).select(*(F.array_join(a, "|").alias(a) for a in selections.AXES), "tmin_ns", "tmax_ns")


# Order lines as entries of files, in two states: in the second, files are new, gone or have other ends of their entries.
_LATER = f"WITH {tables.SQL['nuts']}, later AS (SELECT kind, substr(codes, 1, 1) AS codes, tmin_ns, tmax_ns + (CASE WHEN file_id % 6 = 0 THEN 86400000000000 ELSE 0 END) AS tmax_ns FROM nuts WHERE file_id % 5 <> 0)"


def _maintained(spark, d):
    """The tables after a first filling, an update and a compaction."""
    n = tables.nuts(spark, d).select("file_id", F.col("file_id").cast("string").alias("path"), "kind", F.substring("codes", 1, 1).alias("codes"), "tmin_ns", "tmax_ns")
    old = n.where("file_id % 4 <> 0")
    new = n.where("file_id % 5 <> 0").withColumn("tmax_ns", F.col("tmax_ns") + F.when(F.col("file_id") % 6 == 0, 86_400_000_000_000).otherwise(0))
    listed = lambda df, m: df.select("path", m.alias("mtime"), F.lit(1).alias("size")).distinct()
    states = index.sync(listed(old, F.lit(0)), listed(new, F.when(F.col("file_id") % 6 == 0, 1).otherwise(0)))
    path, to = settle.new_path(spark, "index"), settle.new_path(spark, "index")
    deltas.append(old.withColumn("sign", F.lit(1).cast("long")), path, 0)
    deltas.append(deltas.changes(old, states, new), path, 1)
    deltas.compact(spark, path, to)
    return deltas.bounds(spark, to)


@register("index_maintained", f"{_LATER} SELECT kind, codes, count(*) AS n, min(tmin_ns) AS tmin_ns, max(tmax_ns) AS tmax_ns FROM later GROUP BY ALL")
def index_maintained(spark, d):
    """Counts and spans from signed changes, against a rebuild."""
    return deltas.summary(_maintained(spark, d))


@register("coverage_maintained", f"{_LATER}, s AS (SELECT kind, codes, t_ns, sum(step) AS step FROM (SELECT kind, codes, tmin_ns AS t_ns, 1 AS step FROM later UNION ALL SELECT kind, codes, tmax_ns, -1 FROM later) GROUP BY ALL HAVING sum(step) <> 0) SELECT kind, codes, t_ns, (sum(step) OVER (PARTITION BY kind, codes ORDER BY t_ns))::BIGINT AS count FROM s")
def coverage_maintained(spark, d):
    return deltas.coverage(_maintained(spark, d))


@register("timing_instants", """WITH a AS (SELECT l_orderkey AS k, min(l_quantity) FILTER (l_returnflag = 'A')::DOUBLE AS a, min(l_quantity) FILTER (l_returnflag = 'N')::DOUBLE AS n, min(l_quantity) FILTER (l_returnflag = 'R')::DOUBLE AS r FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, o_totalprice::DOUBLE AS d, a, n, r FROM orders LEFT JOIN a ON k = o_orderkey)
SELECT o_orderkey, round(least(a, n, d / 3500) - 1.5, 6) + 0.0 AS early, round(coalesce(r, a) * 1.1, 6) + 0.0 AS either, round(greatest(a, n, r) - 0.002142857 * d / 1000, 6) + 0.0 AS late, round(d * 1.1 / 7000 + 1, 6) + 0.0 AS direct, 100.0::DOUBLE AS fixed FROM o""")
def timing_instants(spark, d):
    """Instants by texts over the arrival times of order lines."""
    li = tables.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("phase"), F.col("l_quantity").alias("t"))
    o = tables.read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("m")).join(expressions.arrival_map(li, ["o_orderkey"], "phase", "t"), "o_orderkey", "left")
    texts = {"early": "first{stored:A|stored:N|vel_surface:3.5}-1.5", "either": "{stored:R|stored:A}+10%", "late": "last{stored:A|stored:N|stored:R}-2.142857e-3S", "direct": "vel:7 + 1", "fixed": "100"}
    return o.select("o_orderkey", *(r6(expressions.timing(t, F.col("arrivals"), F.col("m"), F.col("m") * 1.1)).alias(n) for n, t in texts.items()))


@register("grid_points", """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS lo, p_size + p_partkey % 17::DOUBLE AS hi FROM part)
SELECT p_partkey, lo + i * 5 AS depth, 1000.0 + j * 1000 AS distance, hi - k * 2 AS component FROM p, unnest(range(0, floor((hi - lo) / 5)::BIGINT + 1)) a(i), range(3) b(j), unnest(range(0, floor((hi - lo) / 2)::BIGINT + 1)) c(k)""")
def grid_points(spark, d):
    """Parts as stores of which each has ranges of its own, asked for by one text."""
    lo = F.col("p_size").cast("double")
    hi = lo + F.col("p_partkey") % 17
    axis = lambda step: (F.col("lo"), F.col("hi"), F.lit(step))
    p = tables.read(spark, d, "part").select("p_partkey", lo.alias("lo"), hi.alias("hi"))
    return expressions.grid(p, "::,1k:3k@3,::-2", {"depth": axis(5.0), "distance": axis(1.0), "component": axis(1.0)}).drop("lo", "hi")


@register("graph_channels", f"""{'WITH ' + _PTS}, w AS (SELECT 'XX.C' || codes || '..BH' AS head, t_ns + 1000000000 AS t_ns, max(y) FILTER (c = 0) AS z, max(y) FILTER (c = 1) AS n, max(y) FILTER (c = 2) AS e FROM pts GROUP BY ALL),
r AS (SELECT head || 'R.STrtz' AS codes, t_ns, -0.5 * e - sqrt(0.75) * n AS y FROM w UNION ALL SELECT head || 'T.STrtz', t_ns, -sqrt(0.75) * e + 0.5 * n FROM w UNION ALL SELECT head || 'Z.STrtz', t_ns, z FROM w)
SELECT codes, t_ns, round(y, 6) + 0.0 AS y FROM r WHERE y IS NOT NULL""")
def graph_channels(spark, d):
    """All channels of a shift and a rotation after it."""
    t = _components(spark, d).withColumn("codes", F.concat(F.lit("XX.C"), F.col("codes").cast("string"), F.lit("..BH"), "channel", F.lit("."))).drop("channel")
    shifted = graph.shift(graph.Stored(t), 1.0)
    g = graph.Graph([shifted, graph.to_rtz(shifted, 30.0, longest=100)])
    return _samples(g.get(["XX.*..BH?.STrtz"], T0 - 10**15, T0 + 10**17), "codes").select("codes", "t_ns", r6(F.col("y")).alias("y"))


@register("graph_mappings", f"""WITH {tables.SQL['nuts']}, b AS (SELECT DISTINCT codes, string_split(codes, '.')[1] || '.' || string_split(codes, '.')[2] || '..' AS head FROM nuts WHERE file_id % 3 <> 1 OR part % 2 = 0)
SELECT head || '.' AS group, string_agg(codes, '|' ORDER BY codes) AS in_codes, head || 'R.Trt|' || head || 'T.Trt' AS out_codes FROM b GROUP BY head""")
def graph_mappings(spark, d):
    """What a rotation reads and gives, kept up from one state of the available codes to another."""
    n = tables.nuts(spark, d)
    old = n.where("file_id % 3 <> 0").select("codes").distinct()
    new = n.where("file_id % 3 <> 1 or part % 2 = 0").select("codes").distinct()
    node = graph.Turned(None, [[0.6, 0.8], [-0.8, 0.6]], "FO", "RT")
    after = graph.update_mappings(graph.mappings(old, node), new.join(old, "codes", "left_anti"), old.join(new, "codes", "left_anti"), node)
    return after.select("group", *(F.array_join(c, "|").alias(c) for c in ("in_codes", "out_codes")))
