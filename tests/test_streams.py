"""Streams as streams: several files, a micro-batch each, late and equal times, state that is read back."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators import cusum
from loam.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "run_id string, ts timestamp, t double, x double, event_id bigint, proba array<double>, pred string, lbl string"


def rows(n=120):
    rng = np.random.default_rng(2)
    out = []
    for i in range(n):
        s = float(i // 2 * 2)  # two rows at each time
        k = (i // 30) % 3
        p = rng.dirichlet(np.eye(3)[k] * 4 + 0.5)
        out.append((f"r{i % 2 if i < 60 else 0}", T0 + dt.timedelta(seconds=s), s, float(i % 7), i, [float(v) for v in p], "abc"[int(p.argmax())], "abc"[k]))
    return out


@pytest.fixture
def stream(spark, tmp_path):
    """(the stream, all rows that are not late): four files, the third of which also holds rows long past, and one row
    far ahead that lets the last windows close."""
    data = rows()
    late = [("r0", T0 + dt.timedelta(seconds=1), 1.0, 99.0, 1000, [0.1, 0.1, 0.8], "c", "c")]
    end = [("end", T0 + dt.timedelta(days=9), 9 * 86400.0, 0.0, 2000, [1.0, 0.0, 0.0], "a", "a")]
    for k, part in enumerate((data[:40], data[40:80], data[80:] + late, end, [(*end[0][:4], 2001, *end[0][5:])])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    return read, spark.createDataFrame(data, SCHEMA)


def rounded(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.where("run_id <> 'end'").collect()), key=str)


@pytest.mark.parametrize("job", ["session", "sliding", "qc", "dedup", "label"])
def test_windows(spark, stream, job):
    read, batch = stream
    marks = spark.createDataFrame([("r0", "m", 0, 0, 10.0, 40.0), ("r1", "n", 0, 0, 0.0, 5.0)], "run_id string, label string, label_ord int, range_ord int, t0 double, t1 double")
    run = {
        "session": lambda d: jobs.session_segments(d, "15 seconds", watermark="5 seconds"),
        "sliding": lambda d: jobs.sliding_stats(d, "x", "20 seconds", "10 seconds", watermark="5 seconds"),
        "qc": lambda d: jobs.stream_qc(d, "30 seconds", watermark="5 seconds"),
        "dedup": lambda d: jobs.stream_dedup(d, watermark="5 seconds").select("run_id", "t"),
        "label": lambda d: jobs.stream_label(d.where("event_id < 1000"), marks).select("run_id", "event_id", "label"),
    }[job]
    got = rounded(jobs.drain(run(read), job))
    assert got == rounded(run(batch)) and len(got) > 1


@pytest.mark.parametrize("tie", ["event_id", None])
def test_cusum_is_the_batch_detectors(spark, stream, tie):
    read, batch = stream
    got = jobs.drain(jobs.stream_cusum(read, "abc", 2.0, keys=("run_id",), tie=tie, watermark="5 seconds"), "cusum").where("run_id <> 'end'")
    ordered = batch.withColumn("o", F.col("event_id"))
    want = cusum.cusum_alarms(ordered, "abc", [2.0], keys=("run_id",), position="o", time="t")
    a = {(r.run_id, r.k_a, r.c_hat, r.k0_hat, round(r.g_max, 6)) for r in got.collect()}
    assert a == {(r.run_id, r.k_a, r.c_hat, r.k0_hat, round(r.g_max, 6)) for r in want.collect()} and len(a) > 3


def test_stable_predictions(spark, stream):
    read, batch = stream
    got = jobs.drain(jobs.stream_stable(read, 3, keys=("run_id",), tie="event_id", watermark="5 seconds"), "stable").where("run_id <> 'end'")
    want, runs = set(), {}
    for r in sorted(batch.collect(), key=lambda r: r.event_id):
        label, n, start = runs.get(r.run_id, (None, 0, None))
        runs[r.run_id] = (label, n + 1, start) if label == r.pred else (r.pred, 1, r.ts)
        if runs[r.run_id][1] == 3:
            want.add((r.run_id, r.pred, runs[r.run_id][2], r.ts))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 3


def test_state_ends_and_a_restart_goes_on(spark, tmp_path):
    """Idle keys leave the state; a query that is started again from its folder goes on with those that stay."""
    schema, sent = "run_id string, ts timestamp, pred string, proba array<double>", []

    def put(*rows):
        sent.append(rows)
        frame = [(run, T0 + dt.timedelta(seconds=s), pred, [1.0, 0.0] if pred == "a" else [0.0, 1.0]) for run, s, pred in rows]
        spark.createDataFrame(frame, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{len(sent):03d}"))

    def go(job, name):
        read = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = job(read).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-progress")).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    jobs_ = {
        "stable": lambda d: jobs.stream_stable(d, 3, keys=("run_id",), watermark="1 second", idle="1 minute"),
        "cusum": lambda d: jobs.stream_cusum(d, "ab", 30.0, keys=("run_id",), watermark="1 second", idle="1 minute"),
    }
    put(("stays", 0, "a"), ("idle", 0, "a"))
    put(("stays", 1, "a"), ("idle", 1, "a"))
    assert [go(job, name) for name, job in jobs_.items()] == [2, 2]
    put(("stays", 30, "a"))
    for s in (55, 80, 100, 120):
        put(("stays", s, "b"))
    assert [go(job, name) for name, job in jobs_.items()] == [1, 1]  # "idle" has left
    put(("idle", 121, "a"), ("stays", 121, "b"))
    assert [go(job, name) for name, job in jobs_.items()] == [2, 2]
    seconds = lambda t: (t - T0).total_seconds()
    stable = {(r.run_id, r.label, seconds(r.start), seconds(r.confirmed)) for r in spark.read.parquet(str(tmp_path / "stable")).collect()}
    assert stable == {("stays", "a", 0, 30), ("stays", "b", 55, 100)}  # the third of "idle" came too late: it starts anew
    alarms = [(r.run_id, r.k_a, r.c_hat) for r in spark.read.parquet(str(tmp_path / "cusum")).collect()]
    assert alarms == [("stays", 4, "b")]  # rows 3 and 4 say b: the sum was carried over the restart
