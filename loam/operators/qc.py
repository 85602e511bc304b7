"""Quality control of raw recordings: timing, channels, pass or fail."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.long_runs import CHUNK_ROWS, with_steps
from loam.operators.quantiles import exact_quantiles

#: Accepted sample rates in hertz.
FS_RANGES = {"acc": (70.0, 100.0), "gyro": (70.0, 100.0), "odo": (80.0, 130.0)}


def qc_stats(samples: DataFrame, *, keys: Sequence[str] = ("run_id", "sensor"), time: str = "t", gap_factor: float = 5.0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per key: n, duration_s, fs_med_hz, dt_med, dt_p99, dt_max, gap_ratio, n_gaps (steps over gap_factor medians).

    Steps come from chunks of a key (`long_runs.with_steps`) and their quantiles from `exact_quantiles`, so neither a sort
    nor a buffer holds a key's rows; fewer than two rows give nulls, duration 0 and no gaps. Keys have no nulls.
    """
    steps = with_steps(samples.select(*keys, time), keys, time, chunk_rows)
    q = exact_quantiles(steps, "_dt", [0.5, 0.99], keys).select(*keys, F.col("q")[0].alias("dt_med"), F.col("q")[1].alias("dt_p99"))
    with_q = steps.join(q, list(keys), "left")
    long = (F.col("dt_med") > 0) & (F.col("_dt") > gap_factor * F.col("dt_med"))
    out = with_q.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) > 1, F.max(time) - F.min(time)).otherwise(0.0).alias("duration_s"), F.first("dt_med").alias("dt_med"), F.first("dt_p99").alias("dt_p99"), F.max("_dt").alias("dt_max"), F.count_if(long).alias("n_gaps"))
    med = F.when(F.col("dt_med") > 0, F.col("dt_med"))
    return out.select(*keys, "n", "duration_s", (1 / med).alias("fs_med_hz"), "dt_med", "dt_p99", "dt_max", (F.col("dt_max") / med).alias("gap_ratio"), "n_gaps")


def qc_table(stats: DataFrame, sensors: Sequence[str], *, run: str = "run_id", sensor: str = "sensor", min_duration: float = 30.0, ranges: Mapping[str, tuple[float, float]] = FS_RANGES) -> DataFrame:
    """A row per run: each sensor's figures as <sensor>__<figure>, and pass_dt_gaps, pass_duration, pass_fs, pass_all."""
    low, high = (F.coalesce(*(F.when(F.col(sensor) == s, F.lit(r[i])) for s, r in ranges.items()), F.lit((0.0, float("inf"))[i])) for i in (0, 1))
    flagged = stats.withColumn("_fs", F.coalesce(F.col("fs_med_hz").between(low, high), F.lit(False)))
    figures = [c for c in stats.columns if c not in (run, sensor)]
    wide = flagged.groupBy(run).agg(
        *(F.max(F.when(F.col(sensor) == s, F.col(c))).alias(f"{s}__{c}") for s in sensors for c in figures),
        F.bool_and(F.coalesce(F.col("n_gaps"), F.lit(1)) == 0).alias("pass_dt_gaps"), F.bool_and(F.coalesce(F.col("duration_s"), F.lit(0.0)) >= min_duration).alias("pass_duration"), F.bool_and("_fs").alias("pass_fs"),
    )
    return wide.withColumn("pass_all", F.col("pass_dt_gaps") & F.col("pass_duration") & F.col("pass_fs"))


def split_pass_fail(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    return table.where("pass_all"), table.where("not pass_all")


def bias(samples: DataFrame, columns: Sequence[str], *, run: str = "run_id", time: str = "t_rel", seconds: float = 5.0) -> DataFrame:
    """Means over the first seconds; null where a run has no such samples."""
    return samples.groupBy(run).agg(*(F.avg(F.when(F.col(time) <= seconds, F.col(c))).alias(f"bias_{c}") for c in columns))


def time_range(samples: DataFrame, *, run: str = "run_id", time: str = "t") -> DataFrame:
    return samples.groupBy(run).agg(F.min(time).alias("t_min"), F.max(time).alias("t_max"))


def _close(a: Column, b: Column, relative: float) -> Column:
    return F.abs(a - b) <= 1e-8 + relative * F.abs(b)


def channel_checks(samples: DataFrame, channels: Sequence[str], *, keys: Sequence[str] = ("run_id",), order: Sequence[str] = ("t",)) -> DataFrame:
    """Per key and channel: max_abs, n, n_unique, repeat_ratio, longest_constant_run, clip_candidates and the flags.

    Unchanged means within 1e-8 for the ratio, and within 1e-8 plus 1e-5 of the former value for runs. Missing values
    are passed over; a channel without any value has n = 0, no max_abs and no ratio, and is frozen.
    """
    long = samples.select(*keys, *order, F.explode(F.create_map(*(y for c in channels for y in (F.lit(c), F.col(c))))).alias("channel", "v"))
    line = Window.partitionBy(*keys, "channel").orderBy(F.col("v").isNull(), *order)  # missing ones last
    before = F.lag("v").over(line)
    long = long.withColumn("_same", F.coalesce(F.abs(F.col("v") - before) <= 1e-8, F.lit(False))).withColumn("_new", (F.col("v").isNotNull() & ~F.coalesce(_close(F.col("v"), before, 1e-5), F.lit(False))).cast("int"))
    group = Window.partitionBy(*keys, "channel")
    long = long.withColumn("_island", F.sum("_new").over(line)).withColumn("_top", F.max(F.abs("v")).over(group))
    near = F.abs(F.abs("v") - F.col("_top")) <= F.greatest(F.lit(1e-9), 0.001 * F.col("_top"))
    per = long.groupBy(*keys, "channel", "_island").agg(F.count("v").alias("_len"), F.first("_top").alias("_top"), F.count_if("_same").alias("_same"), F.count_if(near).alias("_near"))
    unique = long.groupBy(*keys, "channel").agg(F.count_distinct("v").alias("n_unique"))
    out = per.groupBy(*keys, "channel").agg(F.first("_top").alias("max_abs"), F.sum("_len").alias("n"), F.try_divide(F.sum("_same"), F.sum("_len")).alias("repeat_ratio"), F.max("_len").alias("longest_constant_run"), F.sum("_near").alias("clip_candidates")).join(unique, [*keys, "channel"])
    frozen = (F.col("n_unique") <= 2) | F.coalesce(F.col("repeat_ratio") > 0.98, F.lit(False)) | (F.col("longest_constant_run") >= F.greatest(F.lit(20), F.floor(0.1 * F.col("n"))))
    flat = F.col("clip_candidates") >= F.greatest(F.lit(10), F.floor(0.01 * F.col("n")))
    return out.withColumn("flag_frozen", frozen).withColumn("flag_flat_top", flat)


def qc_reports(stats: DataFrame, *, run: str = "run_id", sensor: str = "sensor") -> DataFrame:
    """A report per run, ready for `write_runs(..., "json")`: run_id and qc_report, each sensor's figures by its name."""
    figures = [c for c in stats.columns if c not in (run, sensor)]
    return stats.groupBy(run).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(sensor), F.struct(*figures).alias("figures"))))).alias("qc_report"))


def dt_histogram(samples: DataFrame, *, run: str = "run_id", time: str = "t", bins: int = 80) -> DataFrame:
    """Steps between samples in `bins` equal bins from the least to the greatest of all: bin (1 to bins), n."""
    steps = samples.select((F.col(time) - F.lag(time).over(Window.partitionBy(run).orderBy(time))).alias("dt")).dropna()
    return histogram(steps, "dt", bins)


def histogram(rows: DataFrame, column: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    span = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    place = F.least(F.lit(bins), F.floor((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1)
    placed = rows.dropna(subset=[column]).join(F.broadcast(span)).withColumn("bin", F.when(F.col("_hi") > F.col("_lo"), place).otherwise(F.lit(1)).cast("bigint"))
    return placed.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
