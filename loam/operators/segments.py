"""Gap-free segments, sliding windows over their rows, and window labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.features import in_order


def with_segments(samples: DataFrame, gap: float, *, run: str = "run_id", time: str = "t", tie: Sequence[str] = ()) -> DataFrame:
    """Adds segment_id (dense, from 0: a step over `gap` starts a new one) and row (from 0 within the segment).

    Samples of a null run are dropped. One sort by run and time."""
    line = Window.partitionBy(run).orderBy(time, *tie)
    cut = F.coalesce((F.col(time) - F.lag(time).over(line) > gap).cast("bigint"), F.lit(0))
    out = samples.where(F.col(run).isNotNull()).withColumn("_cut", cut).withColumn("segment_id", F.sum("_cut").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")
    return out.withColumn("row", (F.row_number().over(Window.partitionBy(run, "segment_id").orderBy(time, *tie)) - 1).cast("bigint"))


def segments(samples: DataFrame, *, run: str = "run_id", time: str = "t") -> DataFrame:
    """A row per segment of a table that has segment_id: n_samples, start_time, end_time."""
    return samples.groupBy(run, "segment_id").agg(F.count(F.lit(1)).alias("n_samples"), F.min(time).alias("start_time"), F.max(time).alias("end_time"))


def stationary_segments(samples: DataFrame, *, run: str = "run_id", acc: Sequence[str] = ("ax", "ay", "az"), gyro: Sequence[str] = ("gx", "gy", "gz"), acc_below: float = 0.1, gyro_below: float = 0.1) -> DataFrame:
    """run, segment_id, acc_level, gyro_level, stationary: both mean magnitudes below their bounds, the acceleration's
    after taking away each axis' mean over the segment."""
    means = samples.groupBy(run, "segment_id").agg(*(F.avg(c).alias(f"_m_{c}") for c in acc))
    both = samples.join(means, [run, "segment_id"])
    norm = lambda cols: F.sqrt(sum((c * c for c in cols[1:]), cols[0] * cols[0]))
    levels = both.groupBy(run, "segment_id").agg(F.avg(norm([F.col(c) - F.col(f"_m_{c}") for c in acc])).alias("acc_level"), F.avg(norm([F.col(c) for c in gyro])).alias("gyro_level"))
    return levels.withColumn("stationary", (F.col("acc_level") < acc_below) & (F.col("gyro_level") < gyro_below))


def remove_stationary(samples: DataFrame, found: DataFrame, run: str = "run_id") -> DataFrame:
    return samples.join(found.where("stationary").select(run, "segment_id"), [run, "segment_id"], "left_anti")


def window_rows(samples: DataFrame, size: int, step: int, *, run: str = "run_id", count: str | None = None) -> DataFrame:
    """Each row of a segmented table once per full window that holds it, with k, the window's number in its segment.

    Window k has rows k step to k step + size - 1. How many rows a segment has tells which windows are full, so no
    window is built to be thrown away; windows spread over the cluster by (run, segment, k). count: a column that has
    the number already, so that a segment need not meet in one task (`long_runs.with_segments`)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(run, "segment_id")) if count is None else F.col(count)
    counted = samples.withColumn("_last", F.floor((n - size) / step)).where("_last >= 0")
    first = F.greatest(F.lit(0), F.ceil((F.col("row") - size + 1) / step))
    last = F.least(F.floor(F.col("row") / step), F.col("_last"))
    held = counted.withColumn("_a", first.cast("bigint")).withColumn("_b", last.cast("bigint")).where("_a <= _b")
    return held.withColumn("k", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b", "_last")


def window_labels(rows: DataFrame, *, keys: Sequence[str] = ("run_id", "segment_id", "k"), label: str = "label", position: str = "row", how: str = "majority") -> DataFrame:
    """keys, label of each window: nulls don't count, windows without any label are left out.

    how: 'majority' (the most frequent, of equals the one that comes first) or 'last'."""
    known = rows.where(F.col(label).isNotNull())
    if how == "last":
        return known.groupBy(*keys).agg(F.max_by(label, position).alias("label"))
    if how != "majority":
        raise ValueError(f"unknown strategy: {how}")
    per = known.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"), F.min(position).alias("_first"))
    return per.groupBy(*keys).agg(F.max_by(label, F.struct(F.col("_n"), -F.col("_first"))).alias("label"))


def sliding_windows(samples: DataFrame, size: int, step: int, *, run: str = "run_id", time: str = "t", series: Sequence[str] = ()) -> DataFrame:
    """run, segment_id, k, window_start_idx, window_end_idx (inclusive), t_start, t_end, n_samples and, if asked for,
    <channel>__series: the window's values in order."""
    rows = window_rows(samples, size, step, run=run)
    arrays = [in_order(c, "row").alias(f"{c}__series") for c in series]
    return rows.groupBy(run, "segment_id", "k").agg(F.min("row").alias("window_start_idx"), F.max("row").alias("window_end_idx"), F.min(time).alias("t_start"), F.max(time).alias("t_end"), F.count(F.lit(1)).alias("n_samples"), *arrays)


def window_ids(windows: DataFrame, *, run: str = "run_id", order: Sequence[str] = ("segment_id", "k")) -> DataFrame:
    """Adds window_id, from 0 over sorted runs: counts per run give offsets, rows are numbered within a run only."""
    counts = windows.groupBy(run).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(run, F.coalesce(F.sum("_n").over(Window.orderBy(run).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per run
    number = F.row_number().over(Window.partitionBy(run).orderBy(*order)) - 1
    return windows.join(offsets, run).withColumn("window_id", F.col("_before") + number).drop("_before")


def windows_to_samples(windows: DataFrame, samples: DataFrame, *, run: str = "run_id", time: str = "t", bucket: float) -> DataFrame:
    """Range join run = run and t_start <= time <= t_end (both ends belong): windows go to the time buckets they touch,
    so that it is an equi-join. All columns of samples and the windows' keys window_id, t_start, t_end."""
    touched = windows.select(run, "window_id", "t_start", "t_end", F.explode(F.sequence(F.floor(F.col("t_start") / bucket), F.floor(F.col("t_end") / bucket))).alias("_bucket"))
    placed = samples.withColumn("_bucket", F.floor(F.col(time) / bucket))
    return placed.join(touched, [run, "_bucket"]).where(F.col(time).between(F.col("t_start"), F.col("t_end"))).drop("_bucket")


def align_by_key(table: DataFrame, keys: DataFrame, key: str = "window_id") -> DataFrame:
    """Rows of table whose key the other table has, once per row there."""
    return keys.select(key).join(table, key)
