"""Chunked scans against the scans that sort a run in one task, and what the largest task gets of one long run."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.operators import align as A
from loam.operators import long_runs as R
from loam.operators import qc
from loam.operators import segments as G
from loam.operators import transitions as T


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def samples(spark):
    r, rows = random.Random(5), []
    for run, n in ((1, 900), (2, 40), (3, 1), (4, 260)):
        t = 0.0
        for i in range(n):
            t += r.choice([0.0, 1.0, 1.0, 1.0, 1.0, 2.0, 7.0]) if run != 4 else (1.0 if i < 200 else 0.001)
            rows.append((run, i, t, r.choice([None, "a", "a", "b"] if i % 90 > 60 else ["a"]), r.choice("aab"), float(r.random()), "clash"))
    rows += [(5, i, 1.0, "a", "a", 0.5, "clash") for i in range(70)]  # one time
    rows += [(None, 0, 1.0, "a", "a", 0.0, "clash"), (6, 0, None, "a", "a", 0.0, "x"), (6, 1, None, "b", "b", 0.0, "x"), (6, 2, 4.0, "b", "b", 0.0, "x")]
    return spark.createDataFrame(rows, "run_id int, i long, t double, label string, pred string, v double, n string").repartition(5).cache()


@pytest.mark.parametrize("chunk", [7, 64, 10_000])
def test_segments_and_windows(samples, chunk):
    got = R.with_segments(samples, 5.0, tie=("i",), chunk_rows=chunk, counted=True)
    want = G.with_segments(samples, 5.0, tie=("i",))
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns)
    sizes = want.groupBy("run_id", "segment_id").agg(F.count(F.lit(1)).alias("size"))
    assert got.join(sizes, ["run_id", "segment_id"]).where("size <> segment_rows").count() == 0
    windows = lambda rows, **k: rows_of(G.window_rows(rows, 6, 3, **k), "run_id", "segment_id", "k", "i")
    assert windows(got, count="segment_rows") == windows(want)


@pytest.mark.parametrize("chunk", [5, 33, 10_000])
def test_transitions_and_islands(samples, chunk):
    known = samples.where("run_id is not null")
    got, want = R.true_transitions(known, chunk_rows=chunk), T.true_transitions(known)
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns) and want.count() > 20
    kind = {"keys": ["run_id"], "label": "label", "pred": "pred", "position": "i", "time": "t"}
    got, want = R.prediction_islands(known, chunk_rows=chunk, **kind), T.prediction_islands(known, **kind)
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns) and want.count() > 20


def test_an_island_over_many_chunks(spark):
    rows = spark.createDataFrame([(1, i, float(i), "a" if i < 3 else "b", "b") for i in range(100)], "run_id int, i int, t double, label string, pred string")
    got = R.prediction_islands(rows, keys=["run_id"], label="label", pred="pred", position="i", time="t", chunk_rows=4).collect()
    assert [(r.epoch, r.start_idx, r.length) for r in got] == [(3, 3, 97)]


@pytest.mark.parametrize("how", ["backward", "forward", "nearest", "linear"])
@pytest.mark.parametrize("chunk", [9, 10_000])
def test_align(samples, how, chunk):
    unique = samples.dropDuplicates(["run_id", "t"]).where("run_id is not null and t is not null")
    points = A.grid(unique, 1.7)
    points = points.unionByName(points.where("i < 3").withColumn("t", F.col("t") - 100).withColumn("i", -1 - F.col("i")))  # before the first sample
    points = points.unionByName(points.where("i = 0").withColumn("run_id", F.lit(99)))  # a run without samples
    got, want = R.align(unique, points, ["v"], how, chunk_rows=chunk), A.align(unique, points, ["v"], how)
    cut = lambda df: rows_of(df.withColumn("v", F.round("v", 9)), "run_id", "i", "t", "v")
    assert cut(got) == cut(want)


def test_merge_sensors(samples):
    two = samples.dropDuplicates(["run_id", "t"]).where("run_id is not null and t is not null").withColumn("sensor", F.when(F.col("i") % 3 == 0, "acc").otherwise("odo"))
    got = R.merge_sensors(two, A.grid(two, 1.7), ("acc", "odo"), chunk_rows=20)
    want = A.merge_sensors(two, 1.7, ("acc", "odo"))
    cut = lambda df: rows_of(df.select("run_id", "i", F.round("acc", 9), F.round("odo", 9)), "*")
    assert cut(got) == cut(want)


def test_one_long_run_is_even_chunks(spark):
    """A third of a run's rows within a thousandth of its time: chunks are of about equal size all the same."""
    rows = spark.range(60_000).select(F.lit(1).alias("run_id"), F.when(F.col("id") < 20_000, F.col("id") * 0.00005).otherwise(F.col("id") * 0.02).alias("t"))
    sizes = [r[1] for r in R.with_chunks(rows, ["run_id"], "t", 1000).groupBy("_chunk").count().collect()]
    assert len(sizes) == 60 and max(sizes) < 1300


def test_empty(spark):
    empty = spark.createDataFrame([], "run_id int, i long, t double, label string, pred string, v double")
    assert R.with_segments(empty, 1.0).collect() == R.true_transitions(empty).collect() == []
    assert R.align(empty, empty.select("run_id", "i", "t"), ["v"]).collect() == []


def test_steps(samples):
    own = samples.where("run_id is not null and t is not null")
    line = Window.partitionBy("run_id").orderBy("t")
    want = own.withColumn("_dt", F.col("t") - F.lag("t").over(line))
    for chunk in (6, 10_000):
        assert rows_of(R.with_steps(own, ["run_id"], "t", chunk).select("run_id", "t", F.round("_dt", 9)), "*") == rows_of(want.select("run_id", "t", F.round("_dt", 9)), "*")
    a, b = (qc.qc_stats(own, keys=["run_id"], chunk_rows=c) for c in (6, 10_000))
    assert rows_of(a, *b.columns) == rows_of(b, *b.columns)
