"""Derived channels and cleaning of samples and feature tables, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def magnitude(*channels: str) -> Column:
    return F.sqrt(sum((F.col(c) * F.col(c) for c in channels[1:]), F.col(channels[0]) * F.col(channels[0])))


def wheel_speed(left: str, right: str) -> Column:
    return 0.5 * (F.col(left) + F.col(right))


def clean_samples(samples: DataFrame, *, min_speed: float, max_yaw_rate: float, left: str = "v1", right: str = "v2", yaw_rate: str | None = None, track_width: float | None = None) -> DataFrame:
    """Samples at or above a speed and at or below a yaw rate: a column, or (right - left) / track_width."""
    rate = F.col(yaw_rate) if yaw_rate else (F.col(right) - F.col(left)) / track_width
    return samples.withColumn("net_speed", wheel_speed(left, right)).withColumn("yaw_rate", rate).where((F.col("net_speed") >= min_speed) & (F.abs("yaw_rate") <= max_yaw_rate))


def slow_and_steady(features: DataFrame, mean: str = "mean_speed", std: str = "speed_std", below: float = 0.6, std_below: float = 0.1) -> DataFrame:
    """Windows of low, near-constant speed; the second test is left out where the column is missing."""
    kept = features.where(F.col(mean) < below)
    return kept.where(F.col(std) < std_below) if std in features.columns else kept


def class_report(part: DataFrame, whole: DataFrame, label: str = "label") -> DataFrame:
    """label, n, n_all, percent_kept, status of each class of the whole: CRITICAL below 50 rows, WARNING below 100."""
    n, n_all = (x.groupBy(label).agg(F.count(F.lit(1)).alias(c)) for x, c in ((part, "n"), (whole, "n_all")))
    joined = n_all.join(n, label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select(label, "n", "n_all", (100.0 * F.col("n") / F.col("n_all")).alias("percent_kept"), F.when(F.col("n") < 50, "CRITICAL").when(F.col("n") < 100, "WARNING").otherwise("OK").alias("status"))


def log_transform(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """ln(1 + max(x, 0)) of the columns that are there; nulls stay null, NaN stays NaN."""
    return features.withColumns({c: F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c), F.lit(0.0)))) for c in columns if c in features.columns})


def per_speed(features: DataFrame, columns: Sequence[str], speed: str = "mean_speed", least: float = 0.05) -> DataFrame:
    return features.withColumns({f"{c}_over_speed": F.col(c) / F.greatest(F.col(speed), F.lit(least)) for c in columns})


def finite(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN, infinities and nulls become 0."""
    return features.withColumns({c: F.when(F.isnan(c) | (F.abs(c) == float("inf")) | F.col(c).isNull(), 0.0).otherwise(F.col(c)) for c in columns})


def split_run(features: DataFrame, runs: Sequence, *, run: str = "run_id", time: str = "t_start") -> DataFrame:
    """The named runs cut in two at their median time: <run>_partA up to it, <run>_partB after."""
    middle = features.where(F.col(run).isin(*runs)).groupBy(run).agg(F.percentile(time, F.lit(0.5)).alias("_mid"))
    name = F.col(run).cast("string")
    part = F.when(F.col("_mid").isNull(), name).when(F.col(time) <= F.col("_mid"), F.concat(name, F.lit("_partA"))).otherwise(F.concat(name, F.lit("_partB")))
    return features.join(middle, run, "left").withColumn(run, part).drop("_mid")


def merge_labels(rows: DataFrame, groups: dict[str, Sequence[str]], label: str = "label") -> DataFrame:
    out = F.col(label)
    for name, members in groups.items():
        out = F.when(F.col(label).isin(*members), name).otherwise(out)
    return rows.withColumn(label, out)


def feature_columns(columns: Sequence[str], ids: Sequence[str], drop_prefixes: Sequence[str] = (), only_prefixes: Sequence[str] = ()) -> list[str]:
    """Feature names of a table: no id columns, none with a dropped prefix, and, if given, only of some prefixes."""
    kept = [c for c in columns if c not in ids and not c.startswith(tuple(drop_prefixes) or ("\0",))]
    return [c for c in kept if c.startswith(tuple(only_prefixes))] if only_prefixes else kept
