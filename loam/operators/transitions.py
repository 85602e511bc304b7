"""True transitions between classes, and when a stream of predictions settles on the new class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def true_transitions(rows: DataFrame, *, keys: Sequence[str] = ("run_id",), label: str = "label", position: str = "i", time: str = "t") -> DataFrame:
    """keys, transition_idx, from_label, to_label, gt_time, next_idx (the next transition's, or the run's row count),
    n_rows: where a label differs from the last known one before. Rows without label count as rows only."""
    line = Window.partitionBy(*keys).orderBy(position)
    before = F.last(label, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    changed = rows.withColumn("_before", before).withColumn("n_rows", n).where(F.col(label).isNotNull() & F.col("_before").isNotNull() & (F.col(label) != F.col("_before")))
    out = changed.select(*keys, F.col(position).alias("transition_idx"), F.col("_before").alias("from_label"), F.col(label).alias("to_label"), F.col(time).alias("gt_time"), "n_rows")
    return out.withColumn("next_idx", F.coalesce(F.lead("transition_idx").over(Window.partitionBy(*keys).orderBy("transition_idx")), F.col("n_rows")))


def prediction_islands(rows: DataFrame, *, keys: Sequence[str], label: str, pred: str, position: str, time: str) -> DataFrame:
    """keys, epoch (transition_idx it follows), start_idx, start_time, length of each run of predictions that are right
    within an epoch. Whatever the number asked for, islands are found once."""
    line = Window.partitionBy(*keys).orderBy(position)
    before = F.last(label, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    changed = (F.col(label).isNotNull() & before.isNotNull() & (F.col(label) != before)).cast("int")
    marked = rows.withColumn("_c", changed).withColumn("epoch", F.last(F.when(F.col("_c") == 1, F.col(position)), ignorenulls=True).over(line))
    target = F.last(F.when(F.col("_c") == 1, F.col(label)), ignorenulls=True).over(line)
    marked = marked.withColumn("_hit", F.col(pred) == target).where("epoch is not null")
    epoch = Window.partitionBy(*keys, "epoch").orderBy(position)
    hits = marked.withColumn("_no", F.row_number().over(epoch)).where("_hit").withColumn("_island", F.col("_no") - F.row_number().over(epoch))
    return hits.groupBy(*keys, "epoch", "_island").agg(F.min(position).alias("start_idx"), F.min(time).alias("start_time"), F.count(F.lit(1)).alias("length")).drop("_island")


def stable_detections(islands: DataFrame, n_stable: int | DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first start of n_stable or more right predictions in each epoch; n_stable: a number, or a table with a column
    of that name for a sweep."""
    if isinstance(n_stable, DataFrame):
        islands = islands.join(F.broadcast(n_stable), F.col("length") >= F.col("n_stable"))
        keys = [*keys, "n_stable"]
    else:
        islands = islands.where(F.col("length") >= n_stable)
    first = islands.groupBy(*keys, "epoch").agg(F.min(F.struct("start_idx", "start_time")).alias("_x"))
    return first.select(*keys, F.col("epoch").alias("transition_idx"), F.col("_x.start_idx").alias("detection_idx"), F.col("_x.start_time").alias("detection_time"))


def transition_outcomes(rows: DataFrame, n_stable: int | DataFrame = 3, late_after: float = 10.0, *, least_remaining: int | None = None, keys: Sequence[str] = ("model", "run_id"), label: str = "label", pred: str = "pred", position: str = "i", time: str = "t") -> DataFrame:
    """Each transition's outcome: boundary (too few rows left), detected, or missed; delay in seconds and is_late.

    The delay counts to the start of the stable run, so it may be 0. With a table of n_stable, one row for each. A
    transition is a boundary if fewer than least_remaining rows (unless given, n_stable) are left from it on."""
    found = true_transitions(rows, keys=keys, label=label, position=position, time=time)
    on = [*keys, "transition_idx"]
    if not isinstance(n_stable, DataFrame):
        n = F.lit(n_stable)
    else:
        found, n, on = found.join(F.broadcast(n_stable)), F.col("n_stable"), [*on, "n_stable"]
    islands = prediction_islands(rows, keys=keys, label=label, pred=pred, position=position, time=time)
    joined = found.join(stable_detections(islands, n_stable, keys), on, "left")
    edge = F.col("transition_idx") + (n if least_remaining is None else F.lit(least_remaining)) > F.col("n_rows")
    hit = ~edge & F.col("detection_time").isNotNull()
    delay = F.when(hit, F.col("detection_time") - F.col("gt_time"))
    return joined.select(*on, "from_label", "to_label", "gt_time", F.when(hit, F.col("detection_time")).alias("detection_time"), delay.alias("delay"), F.when(edge, "boundary").when(hit, "detected").otherwise("missed").alias("outcome"), F.coalesce(delay > late_after, F.lit(False)).alias("is_late"))


def summary_of(rows: Column | None = None) -> list[Column]:
    """Aggregates over outcomes: counts of each and figures of the detected ones' delay (deviation: sample); with a
    condition, over the rows that meet it."""
    there = F.lit(True) if rows is None else rows
    count = lambda x: F.count_if(there & (F.col("outcome") == x))
    delay = F.when(there & (F.col("outcome") == "detected"), F.col("delay"))
    return [
        F.count_if(there).alias("n_transitions"), count("detected").alias("n_detected"), count("missed").alias("n_missed"), count("boundary").alias("n_boundary"), count("wrong_class").alias("n_wrong_class"),
        F.avg(delay).alias("mean_delay"), F.percentile(delay, F.lit(0.5)).alias("median_delay"), F.stddev_samp(delay).alias("std_delay"), F.max(delay).alias("max_delay"), F.count_if(there & F.col("is_late")).alias("n_late"),
    ]


def transition_summary(outcomes: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Counts of outcomes, detection_rate = detected / (total - boundary), and figures of the detected ones' delay."""
    out = outcomes.groupBy(*keys).agg(*summary_of())
    return out.withColumn("detection_rate", F.try_divide(F.col("n_detected"), F.col("n_transitions") - F.col("n_boundary")))


def pair_delays(outcomes: DataFrame, models: Sequence, model: str = "model") -> DataFrame:
    """transition (from->to), and per model the mean delay and number of detections."""
    hits = outcomes.where("outcome = 'detected'").withColumn("transition", F.concat("from_label", F.lit("->"), "to_label"))
    return hits.groupBy("transition").pivot(model, list(models)).agg(F.avg("delay").alias("mean"), F.count(F.lit(1)).alias("n"))


def exposure(rows: DataFrame, *, keys: Sequence[str] = ("model",), run: str = "run_id", time: str = "t") -> DataFrame:
    """keys, minutes: time spans of the runs, added up."""
    return rows.groupBy(*keys, run).agg((F.max(time) - F.min(time)).alias("_s")).groupBy(*keys).agg((F.sum("_s") / 60).alias("minutes"))


def false_alarm_rate(false_alarms: DataFrame, rows: DataFrame, *, keys: Sequence[str] = ("model",), run: str = "run_id", time: str = "t") -> DataFrame:
    n = false_alarms.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_false_alarms"))
    out = exposure(rows, keys=keys, run=run, time=time).join(n, list(keys), "left").withColumn("n_false_alarms", F.coalesce("n_false_alarms", F.lit(0)))
    return out.withColumn("per_minute", F.try_divide(F.col("n_false_alarms"), F.col("minutes")))
