"""The archive data source: planned ranges, headers that spare decoding, and writes that leave all or nothing."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan, StringStartsWith

from strandline.sources import archive_source as src
from strandline.sources import mseed

T0 = 1_577_836_800 * 10**9


def day_file(folder: Path, codes="XX.AB..HHZ.", hz=1, power=9, hours=24):
    y = np.arange(hours * 3600 * hz, dtype=float)
    path = folder / f"{codes}mseed"
    path.write_bytes(mseed.encode(codes, T0, 1 / hz, y, power))
    return path, y


def test_an_hour_of_a_day(tmp_path):
    path, y = day_file(tmp_path)
    r = src.Reader({"path": str(tmp_path), "tmin_ns": str(T0 + 3600 * 10**9), "tmax_ns": str(T0 + 7200 * 10**9), "splitbytes": "100000"})
    parts = r.partitions()
    assert len(parts) == -(-path.stat().st_size // 100_000)
    got = [v for p in parts for b in r.read(p) for row in b.column("ydata").to_pylist() for v in row]
    assert set(range(3600, 7200)) <= set(got) and len(got) <= 3600 + 2 * 56
    assert r.decoded == -(-3600 // 56) + 1 or r.decoded == -(-3600 // 56)
    assert r.decoded < 0.05 * path.stat().st_size / 512


@pytest.mark.parametrize("split", [700, 4096, 5000, 1 << 20])
def test_every_record_once(tmp_path, split):
    """Ranges of any size meet each record once, also where lengths are mixed and rubbish lies between."""
    rng = np.random.default_rng(1)
    data, want = b"", []
    for k in range(40):
        y = rng.integers(-1000, 1000, int(rng.integers(1, 900)))
        t = T0 + k * 10**12
        data += mseed.encode("XX.A..BHZ", t, 0.5, y, [9, 12, 10][k % 3], 3)
        want += [(t + i * 5 * 10**8, float(v)) for i, v in enumerate(y)]
        if k % 7 == 3:
            data += b"\0" * 64 * int(rng.integers(1, 30))
    (tmp_path / "a.mseed").write_bytes(data)
    (tmp_path / "empty.mseed").write_bytes(b"")
    (tmp_path / "_hidden.mseed").write_bytes(data)
    r = src.Reader({"path": str(tmp_path), "splitbytes": str(split)})
    got = []
    for p in r.partitions():
        for b in r.read(p):
            for row in b.to_pylist():
                got += [(row["tmin_ns"] + i * 5 * 10**8, v) for i, v in enumerate(row["ydata"])]
    assert sorted(got) == sorted(want)


def test_pushed_filters():
    r = src.PushingReader({"path": "x"})
    other = EqualTo(("quality",), "D")
    assert list(r.pushFilters([EqualTo(("codes",), "A"), StringStartsWith(("codes",), "A"), GreaterThan(("tmax_ns",), 5), LessThan(("tmin_ns",), 9), other])) == [other]
    head = lambda codes, t: mseed.Header(0, 512, codes, t, 1e-9, "D", 2, 3, 64, True)
    assert [r.wanted(head(*x)) for x in (("A", 8), ("A", 9), ("B", 8), ("A", 3), ("A", 4))] == [True, False, False, False, True]


def test_scan_and_save(spark, tmp_path):
    rows = [("XX.A..BHZ.", T0 + k * 86_400 * 10**9, 0.5, [float(v) for v in range(k, k + 1500)]) for k in range(4)] + [("YY.B.00.BHN.", T0, 1.0, [1.5]), ("XX.A..BHZ.", T0, 1.0, []), (None, T0, 1.0, [1.0]), ("XX.A..BHZ.", None, 1.0, [1.0])]
    traces = spark.createDataFrame(rows, "codes string, tmin_ns long, deltat double, ydata array<double>").repartition(3)
    out = str(tmp_path / "archive")
    src.save(traces, out)
    files = [p for p in Path(out).rglob("*") if p.is_file()]
    assert len({p.name.rsplit(".", 2)[0] for p in files}) == 5 and not list(Path(out).glob("_temporary"))
    explode = lambda df: sorted(map(tuple, df.select("codes", "tmin_ns", "deltat", F.posexplode("ydata")).select("codes", (F.col("tmin_ns") + F.col("pos") * F.col("deltat") * 10**9).cast("long"), "col").collect()))
    want = explode(traces.where("codes is not null and tmin_ns is not null and size(ydata) > 0"))
    assert explode(src.scan(spark, out, split=3000)) == want
    part = src.scan(spark, out, T0 + 86_400 * 10**9, T0 + 86_401 * 10**9, r"XX\..*")
    assert {r["codes"] for r in part.collect()} == {"XX.A..BHZ."} and 1 <= part.count() < 3
    src.save(traces, out)
    assert len(explode(src.scan(spark, out))) == 2 * len(want)
    src.save(traces.where("codes like 'YY%'"), out, mode="overwrite")
    assert src.scan(spark, out).count() == 1


def test_failed_write_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "archive")
    good = spark.range(20).select(F.lit("XX.A..BHZ.").alias("codes"), (F.col("id") * 10**9 + T0).alias("tmin_ns"), F.lit(1.0).alias("deltat"), F.array(F.lit(1.0)).alias("ydata"))
    src.save(good, out)
    before = sorted(p for p in Path(out).rglob("*") if p.is_file())
    bad = good.withColumn("deltat", F.when(F.col("tmin_ns") == T0 + 19 * 10**9, F.lit(0.777777)).otherwise(1.0))
    with pytest.raises(Exception, match="sampling rate"):
        src.save(bad.repartition(4), out)
    assert sorted(p for p in Path(out).rglob("*") if p.is_file()) == before and not list(Path(out).glob("_temporary"))


def test_filters_reach_the_source(spark, tmp_path):
    day_file(tmp_path, hours=2)
    src.scan(spark, str(tmp_path))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("miniseed").options(path=str(tmp_path), pushdown="true").load().where(f"codes = 'XX.AB..HHZ.' and tmax_ns > {T0 + 3600 * 10**9} and tmin_ns < {T0 + 3660 * 10**9}")
        assert 1 <= df.count() <= 3
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert " < " not in plan and " > " not in plan  # Spark has nothing left to compare
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
