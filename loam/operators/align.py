"""Irregular sensors on one regular grid: as-of joins and linear interpolation in one window pass per run.

A sensor's samples carry what follows them, grid points and samples are united and sorted once by run, and the last
sample at or before each grid point is filled forward: no range join, no frame that grows to the run's end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grid(samples: DataFrame, step: float, *, run: str = "run_id", time: str = "t") -> DataFrame:
    """run, i, time: t_min + i step up to half a step past the run's last sample, over all its sensors."""
    span = samples.groupBy(run).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    n = F.ceil((F.col("_hi") + step / 2 - F.col("_lo")) / step)
    return span.select(run, "_lo", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("i")).select(run, "i", (F.col("_lo") + F.col("i") * F.lit(step)).alias(time))


def align(samples: DataFrame, points: DataFrame, values: Sequence[str], how: str = "linear", *, keys: Sequence[str] = ("run_id",), time: str = "t", point: str = "i") -> DataFrame:
    """Values at each grid point of the same keys. Samples have unique times per keys; points have keys, point, time.

    how: 'backward' (last sample at or before, else the first), 'forward' (first sample at or after, else the last),
    'nearest' (the closer of both, the earlier on ties) or 'linear' (clamped to the first and last sample).
    """
    if how not in ("backward", "forward", "nearest", "linear"):
        raise ValueError(f"unknown method: {how}")
    line = Window.partitionBy(*keys).orderBy(time)
    own = F.struct(F.col(time).alias("t"), *values)
    known = samples.withColumn("_next", F.lead(own).over(line)).withColumn("_first", F.lag(F.lit(1)).over(line).isNull())
    known = known.select(*keys, F.col(time).alias("_t"), F.lit(None).cast("bigint").alias(point), own.alias("_own"), "_next", F.when(F.col("_first"), own).alias("_head"))
    asked = points.select(*keys, F.col(time).alias("_t"), F.col(point).cast("bigint").alias(point), *(F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("_own", "_next", "_head")))
    # a sample sorts before a grid point of the same time
    past = Window.partitionBy(*keys).orderBy("_t", F.col(point).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = known.unionByName(asked).select(*keys, "_t", point, F.last("_own", ignorenulls=True).over(past).alias("_a"), F.last(F.when(F.col("_own").isNotNull(), F.struct("_next")), ignorenulls=True).over(past)["_next"].alias("_b"))
    head = known.where("_head is not null").select(*keys, "_head")  # a row per run
    found = both.where(F.col(point).isNotNull()).join(head, list(keys))
    a, b = F.coalesce("_a", "_head"), F.when(F.col("_a").isNull(), F.col("_head")).otherwise(F.coalesce("_b", "_a"))
    found = found.withColumn("_lo", a).withColumn("_hi", b)
    t = F.col("_t")
    exact = F.col("_lo.t") == t
    out = []
    for v in values:
        lo, hi = F.col(f"_lo.{v}"), F.col(f"_hi.{v}")
        if how == "backward":
            x = lo
        elif how == "forward":
            x = F.when(exact | F.col("_a").isNull(), lo).otherwise(hi)
        elif how == "nearest":
            x = F.when(exact | (t - F.col("_lo.t") <= F.col("_hi.t") - t) | (F.col("_hi.t") <= t), lo).otherwise(hi)
        else:
            width = F.col("_hi.t") - F.col("_lo.t")
            x = F.when(width > 0, lo + (hi - lo) / width * (t - F.col("_lo.t"))).otherwise(lo)
        out.append(x.alias(v))
    return found.select(*keys, point, t.alias(time), *out)


def merge_sensors(samples: DataFrame, step: float, names: Sequence[str], *, run: str = "run_id", sensor: str = "sensor", time: str = "t", value: str = "v") -> DataFrame:
    """run, i, t and one interpolated column per sensor, on the run's common grid."""
    points = grid(samples, step, run=run, time=time)
    asked = points.withColumn(sensor, F.explode(F.array(*map(F.lit, names))))
    long = align(samples.where(F.col(sensor).isin(*names)), asked, [value], "linear", keys=(run, sensor), time=time)
    return long.groupBy(run, "i").pivot(sensor, list(names)).agg(F.first(value)).join(points, [run, "i"]).select(run, "i", time, *names)
