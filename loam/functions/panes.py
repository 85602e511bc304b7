"""Window features from panes: a row of samples is read once, however many windows hold it.

A pane is as many rows as divide both a window's size and its step. Rows are summed up per pane (counts, means, central
moments, extremes, and arrays only of signals whose values are asked for); a window merges the summaries of its panes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _summary(s: str) -> Column:
    """Count, mean, sums of powers of what lies about it, extremes and the sum of amounts of a signal."""
    n, m2 = F.count(s), F.var_pop(s) * F.count(s)
    shape = lambda f, power: F.coalesce(F.nullif(f(s), F.lit(float("nan"))) * F.pow(m2, power / 2) / F.pow(n, power / 2 - 1), F.lit(0.0))
    return F.struct(n.alias("n"), F.coalesce(F.avg(s), F.lit(0.0)).alias("mean"), F.coalesce(m2, F.lit(0.0)).alias("m2"), shape(F.skewness, 3).alias("m3"), shape(lambda c: F.kurtosis(c) + 3, 4).alias("m4"), F.min(s).alias("low"), F.max(s).alias("high"), F.coalesce(F.sum(F.abs(s)), F.lit(0.0)).alias("amount")).alias(s)


def _total(parts: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + of(x))


def pane_windows(samples: DataFrame, size: int, step: int, signals: Sequence[str], *, values: Sequence[str] = (), label: str | None = None, run: str = "run_id", row: str = "row") -> DataFrame:
    """run, segment_id, k of the full windows of a segmented table, a struct per signal (n, mean, m2, m3, m4, low, high,
    amount), an array <signal>__values for each of `values`, and with a label the window's majority label (nulls do not
    count; of equally frequent ones the first; null if there is none). Missing values are passed over."""
    width = gcd(size, step)
    per, stride = size // width, step // width
    rows = samples.withColumn("_pane", F.floor(F.col(row) / width))
    own = [F.array_sort(F.collect_list(F.when(F.col(v).isNotNull(), F.struct(F.col(row).alias("o"), F.col(v).alias("v"))))).alias(f"_v_{v}") for v in values]
    if label:
        own.append(F.collect_list(F.when(F.col(label).isNotNull(), F.struct(F.col(label).alias("l"), F.col(row).alias("o")))).alias("_labels"))
    panes = rows.groupBy(run, "segment_id", "_pane").agg(F.count(F.lit(1)).alias("_n"), *map(_summary, signals), *own)
    first, last = F.greatest(F.lit(0), F.ceil((F.col("_pane") - per + 1) / stride)), F.floor(F.col("_pane") / stride)
    held = panes.where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    kept = F.struct("_pane", *signals, *(f"_v_{v}" for v in values), *(["_labels"] if label else []))
    full = held.groupBy(run, "segment_id", "k").agg(F.sum("_n").alias("_n"), F.array_sort(F.collect_list(kept)).alias("_p")).where(F.col("_n") == size)
    p = F.col("_p")
    out = full.withColumns({f"_n_{s}": F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + x[s]["n"]) for s in signals})
    out = out.withColumns({f"_m_{s}": F.try_divide(_total(p, lambda x: x[s]["n"] * x[s]["mean"]), F.col(f"_n_{s}")) for s in signals})

    def merged(s: str) -> Column:
        mean = F.col(f"_m_{s}")

        def power(x: Column, k: int) -> Column:
            d, n, m2, m3, m4 = x[s]["mean"] - mean, x[s]["n"], x[s]["m2"], x[s]["m3"], x[s]["m4"]
            return m2 + n * d * d if k == 2 else m3 + 3 * d * m2 + n * d * d * d if k == 3 else m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d

        moments = [_total(p, lambda x: F.when(x[s]["n"] > 0, power(x, k)).otherwise(0.0)).alias(f"m{k}") for k in (2, 3, 4)]
        ends = [F.array_min(F.transform(p, lambda x: x[s]["low"])).alias("low"), F.array_max(F.transform(p, lambda x: x[s]["high"])).alias("high")]
        return F.struct(F.col(f"_n_{s}").alias("n"), mean.alias("mean"), *moments, *ends, _total(p, lambda x: x[s]["amount"]).alias("amount")).alias(s)

    columns = [merged(s) for s in signals]
    columns += [F.transform(F.flatten(F.transform(p, lambda x: x[f"_v_{v}"])), lambda x: x["v"]).alias(f"{v}__values") for v in values]
    if label:
        seen = F.flatten(F.transform(p, lambda x: x["_labels"]))
        of = lambda name: F.filter(seen, lambda x: x["l"] == name)
        votes = F.transform(F.array_distinct(F.transform(seen, lambda x: x["l"])), lambda name: F.struct(F.size(of(name)).alias("n"), (-F.array_min(F.transform(of(name), lambda x: x["o"]))).alias("first"), name.alias("name")))
        columns.append(F.array_max(votes)["name"].alias(label))
    return out.select(run, "segment_id", "k", *columns)


def _n(x: Column) -> Column:
    return F.nullif(x["n"], F.lit(0))


def basic_of(s: str) -> list[Column]:
    """The features of `features.basic` of a signal of `pane_windows`."""
    x = F.col(s)
    square = x["m2"] + x["n"] * x["mean"] * x["mean"]
    return [x["mean"].alias(f"{s}_mean"), F.sqrt(x["m2"] / _n(x)).alias(f"{s}_std"), x["low"].alias(f"{s}_min"), x["high"].alias(f"{s}_max"), (x["high"] - x["low"]).alias(f"{s}_range"), F.sqrt(square / _n(x)).alias(f"{s}_rms"), square.alias(f"{s}_energy"), (x["amount"] / _n(x)).alias(f"{s}_mean_abs")]


def centred_basic_of(s: str) -> list[Column]:
    """The same of the signal less its mean over the window, which takes its values; its mean is left out, as it is 0."""
    x, v = F.col(s), F.col(f"{s}__values")
    square = _total(v, lambda y: (y - x["mean"]) * (y - x["mean"]))
    return [F.sqrt(x["m2"] / _n(x)).alias(f"{s}_std"), (x["low"] - x["mean"]).alias(f"{s}_min"), (x["high"] - x["mean"]).alias(f"{s}_max"), (x["high"] - x["low"]).alias(f"{s}_range"), F.sqrt(square / _n(x)).alias(f"{s}_rms"), square.alias(f"{s}_energy"), (_total(v, lambda y: F.abs(y - x["mean"])) / _n(x)).alias(f"{s}_mean_abs")]


def moments_of(s: str) -> list[Column]:
    """The features of `features.moments`."""
    x = F.col(s)
    n, varies = x["n"], x["m2"] > 0
    m2 = F.when(varies, x["m2"])
    g1, g2 = F.sqrt(n) * x["m3"] / F.pow(m2, 1.5), n * x["m4"] / (m2 * m2) - 3
    return [F.when((n >= 3) & varies, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))).alias(f"{s}_skew"), F.when((n >= 4) & varies, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * g2 + 6)).alias(f"{s}_kurt")]


def odometry_of(s: str, fs: float) -> list[Column]:
    """The features of `features.odometry`."""
    x = F.col(s)
    return [x["mean"].alias("mean_speed"), F.sqrt(x["m2"] / _n(x)).alias("speed_std"), (x["amount"] / fs).alias("distance")]
