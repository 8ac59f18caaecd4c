"""Tables kept up by signed changes against a rebuild after each update."""

import random

from pyspark.sql import functions as F
from strandline.operators import deltas, index, settle

ENTRY = "path string, kind string, codes string, tmin_ns long, tmax_ns long"


def _plain(entries):
    counts, cover = {}, {}
    for _, kind, codes, lo, hi in entries:
        n, a, b = counts.get((kind, codes), (0, [], []))
        counts[kind, codes] = (n + 1, [*a, lo], [*b, hi])
        for t, s in ((-index.FAR if lo is None else lo, 1), (index.FAR if hi is None else hi, -1)):
            cover[kind, codes, t] = cover.get((kind, codes, t), 0) + s
    spans = {(*k, n, None if None in a else min(a), None if None in b else max(b)) for k, (n, a, b) in counts.items()}
    steps, open_ = set(), {}
    for (kind, codes, t), s in sorted(cover.items(), key=lambda x: (str(x[0][:2]), x[0][2])):
        if s:
            open_[kind, codes] = open_.get((kind, codes), 0) + s
            steps.add((kind, codes, t, open_[kind, codes]))
    return spans, steps


def test_any_sequence_equals_a_rebuild(spark):
    rng = random.Random(3)
    files: dict[str, tuple[int, list]] = {}
    path, number = settle.new_path(spark, "deltas"), 0
    for turn in range(4):
        old = {k: v for k, v in files.items()}
        for name in [k for k in files if rng.random() < 0.3]:
            del files[name]
        for name in [f"f{k}" for k in range(12) if rng.random() < 0.5]:
            rows = [(name, rng.choice(["waveform", "channel"]), rng.choice(["a", "b", None]), rng.choice([None, *range(5)]), rng.choice([None, *range(5, 9)])) for _ in range(rng.randint(0, 3))]
            files[name] = (turn + 1, rows + rows[:1])
        rows_of = lambda fs: spark.createDataFrame([r for _, rs in fs.values() for r in rs], ENTRY)
        listed = lambda fs: spark.createDataFrame([(k, float(m), 1) for k, (m, _) in fs.items()], "path string, mtime double, size long")
        states = index.sync(listed(old), listed(files))
        changed = deltas.changes(rows_of(old), states, rows_of(files))
        deltas.append(changed, path, number)
        deltas.append(changed, path, number)  # tried again
        number += 1
        if turn == 2:
            to = settle.new_path(spark, "deltas")
            deltas.compact(spark, path, to)
            path = to
        sums = deltas.bounds(spark, path)
        spans, steps = _plain([r for _, rs in files.values() for r in rs])
        assert {tuple(r) for r in deltas.summary(sums).collect()} == spans
        assert {tuple(r) for r in deltas.coverage(sums).collect()} == steps


def test_an_update_costs_what_changed(spark):
    path = settle.new_path(spark, "deltas")
    rows = spark.range(5000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.lit("waveform").alias("kind"), F.lit("a").alias("codes"), F.col("id").alias("tmin_ns"), (F.col("id") + 3).alias("tmax_ns"))
    deltas.append(rows.withColumn("sign", F.lit(1).cast("long")), path, 0)
    states = spark.createDataFrame([("f7", -1), ("f8", 2)], "path string, state int")
    deltas.append(deltas.changes(rows, states, rows), path, 1)
    assert spark.read.parquet(f"{path}/run=1").count() == 2
    assert deltas.summary(deltas.bounds(spark, path)).first()["n"] == 4999
