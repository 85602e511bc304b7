"""The same detectors and checks on streams: every job takes a streaming (or batch) DataFrame and returns one.

Event time is a timestamp column; rows later than the watermark are dropped by Spark. The stateful jobs need rows in
order: they sort what a micro-batch brings by time (and `tie`, a column of whole numbers, if there is one) and drop
rows that lie before the last one they have seen of their key. Their state ends: a key whose last row lies `idle` behind
the watermark leaves, and starts anew if it comes back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loam.operators.cusum import Sums, advance, log_probabilities
from loam.operators.labelling import label_samples
from loam.shared import shared_path


def _fresh(frames: Iterator[pd.DataFrame], ts: str, tie: str | None, last: tuple[int, int] | None) -> tuple[pd.DataFrame, np.ndarray, tuple[int, int] | None]:
    """The micro-batch's rows in order without those before the last one seen, their microseconds, the new last one.

    With a tie column no row is taken twice; without one, rows at the last time count, in order of arrival."""
    frame = pd.concat(list(frames)).sort_values([ts, tie] if tie else [ts], kind="stable")
    us = frame[ts].astype("datetime64[us]").astype("int64").to_numpy()
    if last is not None:
        late = us < last[0]
        if tie:
            late |= (us == last[0]) & (frame[tie].to_numpy() <= last[1])
        frame, us = frame[~late], us[~late]
    if len(us):
        last = int(us[-1]), int(frame[tie].iloc[-1]) if tie else 0
    return frame, us, last


def _kept(state: GroupState, values: tuple, last_us: int, idle_ms: int) -> None:
    """Keep a key's state until the watermark has passed its last row by so much."""
    state.update(values)
    state.setTimeoutTimestamp(max(last_us // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))


def _milliseconds(time: str) -> int:
    return int(pd.Timedelta(time) / pd.Timedelta(milliseconds=1))


def stream_cusum(rows: DataFrame, classes: Sequence[str], h: float, *, keys: Sequence[str] = ("model", "run_id"), ts: str = "ts", proba: str = "proba", watermark: str = "1 hour", label: str | None = None, tie: str | None = None, warmup: int = 0, eps: float = 1e-9, idle: str = "7 days") -> DataFrame:
    """keys, k_a, alarm_time, c_hat, k0_hat, g_max as alarms happen; state per key: its sums, row count and last row.

    The active class of a key's start is the first known label of its first micro-batch, else the most probable class
    of its first row."""
    out = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys] + ["k_a bigint", "alarm_time timestamp", "c_hat string", "k0_hat bigint", "g_max double"])
    names, n, idle_ms = [c.split()[0] for c in out.split(", ")], len(classes), _milliseconds(idle)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        active, g, s, low, low_at, k, *last = state.get if state.exists else (None, [0.0] * n, [0.0] * n, [0.0] * n, [0] * n, 0)
        frame, us, last = _fresh(frames, ts, tie, tuple(last) if last else None)
        if not len(frame):
            return
        p = np.stack(frame[proba].to_numpy()).astype(float)
        if active is None:
            known = frame[label].dropna() if label else ()
            active = list(classes).index(known.iloc[0]) if len(known) and known.iloc[0] in classes else int(np.nan_to_num(p[0]).argmax())
        sums = Sums(*(np.array([x]) for x in (active, g, s, low, low_at)))
        at = k + np.arange(len(frame))
        _, row, to, start, top = advance(sums, log_probabilities(p, eps), at, np.array([0]), np.array([len(frame)]), np.array([h]), warmup)
        _kept(state, (*(x[0].tolist() for x in sums.all()), k + len(frame), *last), last[0], idle_ms)
        times = frame[ts].to_numpy()
        yield pd.DataFrame([(*key, int(at[i]), times[i], classes[c], int(k0), float(x)) for i, c, k0, x in zip(row, to, start, top, strict=True)], columns=names)

    kept = "active int, g array<double>, s array<double>, low array<double>, low_at array<bigint>, k bigint, last_us bigint, last_tie bigint"
    wide = rows.withWatermark(ts, watermark).select(*keys, ts, proba, *(c for c in (label, tie) if c))
    return wide.groupBy(*keys).applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def stream_stable(rows: DataFrame, n_stable: int, *, keys: Sequence[str] = ("model", "run_id"), ts: str = "ts", pred: str = "pred", watermark: str = "1 hour", tie: str | None = None, idle: str = "7 days") -> DataFrame:
    """keys, label, start, confirmed: each time a prediction has come n_stable times in a row, with the first one's time.
    Missing predictions break a row of equal ones and are never confirmed."""
    out = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys] + ["label string", "start timestamp", "confirmed timestamp"])
    names, idle_ms = [c.split()[0] for c in out.split(", ")], _milliseconds(idle)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        label, length, start, *last = state.get if state.exists else (None, 0, 0)
        frame, us, last = _fresh(frames, ts, tie, tuple(last) if last else None)
        if not len(frame):
            return
        value = frame[pred].to_numpy(dtype=object)
        new = np.r_[value[0] != label or length == 0, value[1:] != value[:-1]]
        # where each row's stretch of equal predictions begins; -1: before this micro-batch
        begin = np.maximum.accumulate(np.where(new, np.arange(len(value)), -1))
        lengths = np.arange(len(value)) - begin + np.where(begin < 0, length, 1)
        starts = np.where(begin < 0, start, us[np.maximum(begin, 0)])
        hit = np.flatnonzero((lengths == n_stable) & ~pd.isna(value))
        _kept(state, (None if pd.isna(value[-1]) else value[-1], int(lengths[-1]), int(starts[-1]), *last), last[0], idle_ms)
        yield pd.DataFrame([(*key, value[i], pd.Timestamp(starts[i], unit="us"), pd.Timestamp(us[i], unit="us")) for i in hit], columns=names)

    wide = rows.withWatermark(ts, watermark).select(*keys, ts, pred, *([tie] if tie else []))
    return wide.groupBy(*keys).applyInPandasWithState(run, out, "label string, length int, start bigint, last_us bigint, last_tie bigint", "append", GroupStateTimeout.EventTimeTimeout)


def session_segments(rows: DataFrame, gap: str, *, run: str = "run_id", ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """run, start, end, n: segments as sessions; a step of exactly the gap stays joined, a greater one starts anew."""
    per = rows.withWatermark(ts, watermark).groupBy(run, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return per.select(run, "start", "end", "n")


def sliding_stats(rows: DataFrame, value: str, size: str = "2 seconds", step: str = "1 second", *, run: str = "run_id", ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """Time windows aligned to the epoch: run, start, n, mean, std. Not the windows by row count of segments."""
    per = rows.withWatermark(ts, watermark).groupBy(run, F.window(ts, size, step)).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return per.select(run, F.col("window.start").alias("start"), "n", "mean", "std")


def stream_dedup(rows: DataFrame, *, run: str = "run_id", ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """One row per run and time, within the watermark."""
    if rows.isStreaming:
        return rows.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([run, ts])
    return rows.dropDuplicates([run, ts])


def stream_label(rows: DataFrame, intervals: DataFrame, *, run: str = "run_id", time: str = "t") -> DataFrame:
    """Stream rows with the label of a static table of intervals."""
    return label_samples(rows, intervals, run=run, time=time)


def stream_qc(rows: DataFrame, size: str, *, run: str = "run_id", ts: str = "ts", time: str = "t", watermark: str = "1 hour") -> DataFrame:
    """run, start, n, span_s, mean_dt, median_dt, max_dt per tumbling window: steps between neighbouring times within it.
    A window's times are held as one array, so size bounds the state; a window of one row has no steps."""
    per = rows.withWatermark(ts, watermark).groupBy(run, F.window(ts, size)).agg(F.sort_array(F.collect_list(time)).alias("_t"))
    steps = F.zip_with(F.slice("_t", 2, F.size("_t")), F.slice("_t", 1, F.greatest(F.size("_t") - 1, F.lit(0))), lambda a, b: a - b)
    per = per.select(run, F.col("window.start").alias("start"), F.size("_t").cast("long").alias("n"), (F.array_max("_t") - F.array_min("_t")).alias("span_s"), F.sort_array(steps).alias("_d"))
    m = F.size("_d")
    middle = (F.get("_d", F.floor((m - 1) / 2).cast("int")) + F.get("_d", F.floor(m / 2).cast("int"))) / 2
    mean = F.when(F.col("n") > 1, F.col("span_s") / (F.col("n") - 1))
    return per.select(run, "start", "n", "span_s", mean.alias("mean_dt"), F.when(m > 0, middle).alias("median_dt"), F.array_max("_d").alias("max_dt"))


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a streaming DataFrame over all that is there now; its rows, written as Parquet by the tasks to the folder that
    all machines share. The query's progress is kept there too."""
    folder = shared_path(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
