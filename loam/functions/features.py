"""Features of windows: moments and shapes as SQL aggregates, spectra on stacked arrays.

Aggregates take rows that belong to a window (keys) with the signals as columns; each bundle is one pass. Deviations are
population deviations, as everywhere in this module."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hertz, both ends belong to a band.
BANDS = {"band_1_5": (1.0, 5.0), "band_5_20": (5.0, 20.0), "band_20_40": (20.0, 40.0), "band_40_80": (40.0, 80.0)}
TINY = 1e-12


def centred(rows: DataFrame, channels: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Channels less their mean over the window (gravity)."""
    whole = Window.partitionBy(*keys)
    return rows.withColumns({c: F.col(c) - F.avg(c).over(whole) for c in channels})


def basic(s: str) -> list[Column]:
    x = F.col(s)
    return [F.avg(x).alias(f"{s}_mean"), F.stddev_pop(x).alias(f"{s}_std"), F.min(x).alias(f"{s}_min"), F.max(x).alias(f"{s}_max"), (F.max(x) - F.min(x)).alias(f"{s}_range"), F.sqrt(F.avg(x * x)).alias(f"{s}_rms"), F.sum(x * x).alias(f"{s}_energy"), F.avg(F.abs(x)).alias(f"{s}_mean_abs")]


def quantiles(s: str) -> list[Column]:
    q = F.percentile(s, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [q[1].alias(f"{s}_median"), (q[2] - q[0]).alias(f"{s}_iqr")]


def moments(s: str) -> list[Column]:
    """Skewness and excess kurtosis, corrected for bias; null for fewer than 3 or 4 values or a constant signal."""
    n = F.count(s)
    g1, g2 = F.nullif(F.skewness(s), F.lit(float("nan"))), F.nullif(F.kurtosis(s), F.lit(float("nan")))
    varies = F.stddev_pop(s) > 0
    skew = F.when((n >= 3) & varies, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((n >= 4) & varies, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return [skew.alias(f"{s}_skew"), kurt.alias(f"{s}_kurt")]


def with_steps(rows: DataFrame, signals: Sequence[str], keys: Sequence[str], order: str) -> DataFrame:
    """Adds per signal its first and second difference and whether it crosses zero here, all in one sort.

    A zero has the sign before it; zeros at the start cross nothing."""
    line = Window.partitionBy(*keys).orderBy(order)
    past = line.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_d_{s}": F.col(s) - F.lag(s).over(line) for s in signals} | {f"_s_{s}": F.last(F.nullif(F.signum(s), F.lit(0.0)), ignorenulls=True).over(past) for s in signals})
    return out.withColumns({f"_dd_{s}": F.col(f"_d_{s}") - F.lag(f"_d_{s}").over(line) for s in signals} | {f"_z_{s}": F.coalesce((F.col(f"_s_{s}") * F.lag(f"_s_{s}").over(line) < 0).cast("int"), F.lit(0)) for s in signals})


def crossings(s: str) -> list[Column]:
    n = F.count(F.lit(1))
    return [F.when(n > 1, F.sum(f"_z_{s}") / (n - 1)).alias(f"{s}_zcr")]


def jerk_hjorth(s: str, fs: float) -> list[Column]:
    sd, sd1, sd2 = F.stddev_pop(s), F.stddev_pop(f"_d_{s}"), F.stddev_pop(f"_dd_{s}")
    mobility = F.when(sd < TINY, 0.0).otherwise(sd1 / sd)
    complexity = F.when((sd1 < TINY) | (mobility < TINY), 0.0).otherwise(sd2 / sd1 / mobility)
    enough = F.count(s) >= 3
    return [(F.sqrt(F.avg(F.col(f"_d_{s}") * F.col(f"_d_{s}"))) * fs).alias(f"{s}_jerk_rms"), F.when(enough, F.var_pop(s)).alias(f"{s}_activity"), F.when(enough, mobility).alias(f"{s}_mobility"), F.when(enough, complexity).alias(f"{s}_complexity")]


def in_order(signal: str, order: str) -> Column:
    """The signal's values as an array, sorted by `order`."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(signal).alias("v")))), lambda x: x["v"])


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation, 0 if one is constant, null for fewer than two rows."""
    flat = (F.stddev_pop(a) < TINY) | (F.stddev_pop(b) < TINY)
    return F.when(F.count(F.lit(1)) > 1, F.when(flat, 0.0).otherwise(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))))


def odometry(speed: str, fs: float) -> list[Column]:
    return [F.avg(speed).alias("mean_speed"), F.stddev_pop(speed).alias("speed_std"), (F.sum(F.abs(speed)) / fs).alias("distance")]


def _trapezoid(y: np.ndarray, step: float) -> np.ndarray:
    return (y[:, 1:] + y[:, :-1]).sum(1) * step / 2 if y.shape[1] > 1 else np.zeros(len(y))


def spectrum(x: np.ndarray, fs: float, bands: dict[str, tuple[float, float]] = BANDS) -> dict[str, np.ndarray]:
    """Spectral features of equally long signals (rows): power |rfft|^2 / n of the signal less its mean, one-sided.

    dominant, centroid and entropy (bits) are NaN where there is no power above frequency 0."""
    n = x.shape[1]
    psd = np.abs(np.fft.rfft(x - x.mean(1, keepdims=True), axis=1)) ** 2 / n
    psd[psd < 1e-20] = 0.0
    f = np.arange(psd.shape[1]) * fs / n
    step = fs / n
    out = {"spectral_energy": _trapezoid(psd, step)}
    above, fa = psd[:, 1:], f[1:]
    total = above.sum(1)
    some = total > 0
    share = np.divide(above, total[:, None], out=np.zeros_like(above), where=some[:, None])
    logs = np.log2(share, out=np.zeros_like(share), where=share > 0)
    nan = np.where(some, 0.0, np.nan)
    out["dominant_freq"] = fa[above.argmax(1)] + nan if above.shape[1] else nan
    out["spectral_centroid"] = share @ fa + nan
    out["spectral_entropy"] = -(share * logs).sum(1) + nan
    for name, (low, high) in bands.items():
        out[name] = _trapezoid(psd[:, (f >= low) & (f <= high)], step)
    return out


def spectral_features(windows: DataFrame, series: Sequence[str], fs: float, *, keys: Sequence[str], bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """keys and, per array column <s>__series (or <s>), the features of `spectrum` as <s>_<feature>; NaN becomes null.

    Windows of equal length are stacked and transformed together, batch by batch; nothing is shuffled."""
    names = [(c, c.removesuffix("__series"), f) for c in series for f in ("spectral_energy", "dominant_freq", "spectral_centroid", "spectral_entropy", *bands)]
    kind = ", ".join([f"`{k}` {windows.schema[k].dataType.simpleString()}" for k in keys] + [f"`{s}_{f}` double" for _, s, f in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for c in series:
                column = batch.column(batch.schema.get_field_index(c))
                sizes = np.asarray(pc.list_value_length(column).fill_null(0))
                ends = np.cumsum(sizes)
                flat = np.asarray(pc.list_flatten(column)).astype(np.float64)
                for n in np.unique(sizes):
                    if n == 0:
                        continue
                    at = np.flatnonzero(sizes == n)
                    x = flat[(ends[at] - n)[:, None] + np.arange(n)]
                    for f, v in spectrum(x, fs, bands).items():
                        found.setdefault((c, f), np.full(batch.num_rows, np.nan))[at] = v
            columns = [pa.array(found.get((c, f), np.full(batch.num_rows, np.nan)), from_pandas=True) for c, _, f in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keys), *columns], names=[*keys, *(f"{s}_{f}" for _, s, f in names)])

    return windows.select(*keys, *series).mapInArrow(run, kind)


def stacked_features(x: np.ndarray, fs: float, bands: dict[str, tuple[float, float]] = BANDS) -> dict[str, np.ndarray]:
    """The bundles `basic`, `quantiles`, `moments`, `crossings`, `jerk_hjorth` and `spectrum` of equally long signals
    (rows), by name, as the aggregates give them; missing values (NaN) are passed over, but have no spectrum."""
    rows, n = x.shape
    whole = not np.isnan(x).any()
    mean, std, var, least, most, total, part = (np.mean, np.std, np.var, np.min, np.max, np.sum, np.percentile) if whole else (np.nanmean, np.nanstd, np.nanvar, np.nanmin, np.nanmax, np.nansum, np.nanpercentile)
    count = np.full(rows, float(n)) if whole else (~np.isnan(x)).sum(1).astype(float)
    m, low, high, square = mean(x, 1), least(x, 1), most(x, 1), x * x
    flat = low == high
    sd = np.where(flat, 0.0, std(x, 1))
    out = {"mean": m, "std": sd, "min": low, "max": high, "range": high - low, "rms": np.sqrt(mean(square, 1)), "energy": total(square, 1), "mean_abs": mean(np.abs(x), 1)}
    q = part(x, (25, 50, 75), axis=1)
    out |= {"median": q[1], "iqr": q[2] - q[0]}
    z = x - m[:, None]
    m2, m3, m4 = (mean(z**k, 1) for k in (2, 3, 4))
    with np.errstate(invalid="ignore", divide="ignore"):
        g1, g2 = m3 / m2**1.5, m4 / m2**2 - 3
        out["skew"] = np.where((count >= 3) & ~flat, g1 * np.sqrt(count * (count - 1)) / (count - 2), np.nan)
        out["kurt"] = np.where((count >= 4) & ~flat, (count - 1) / ((count - 2) * (count - 3)) * ((count + 1) * g2 + 6), np.nan)
        sign = np.sign(np.nan_to_num(x))
        at = np.maximum.accumulate(np.where(sign != 0, np.arange(n), 0), axis=1)
        held = np.take_along_axis(sign, at, 1)  # a zero has the sign before it
        out["zcr"] = (held[:, 1:] * held[:, :-1] < 0).sum(1) / (n - 1) if n > 1 else np.full(rows, np.nan)
        none = np.full(rows, np.nan)
        d = np.diff(x, axis=1)
        dd = np.diff(d, axis=1)
        sd1, sd2 = std(d, 1) if n > 1 else none, std(dd, 1) if n > 2 else none
        out["jerk_rms"] = np.sqrt(mean(d * d, 1)) * fs if n > 1 else none
        mobility = np.where(sd < TINY, 0.0, sd1 / sd)
        complexity = np.where((sd1 < TINY) | (mobility < TINY), 0.0, sd2 / sd1 / mobility)
        enough = count >= 3
        out |= {"activity": np.where(enough, np.where(flat, 0.0, var(x, 1)), np.nan), "mobility": np.where(enough, mobility, np.nan), "complexity": np.where(enough, complexity, np.nan)}
    there = ~np.isnan(x).any(1)
    for name, v in spectrum(np.where(there[:, None], x, 0.0), fs, bands).items():
        out[name] = np.where(there, v, np.nan)
    return out


def _stacked_corr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`safe_corr` of rows."""
    if a.shape[1] < 2:
        return np.full(len(a), np.nan)
    both = ~np.isnan(a) & ~np.isnan(b)
    n = np.maximum(both.sum(1), 1)[:, None]
    x, y = (np.where(both, v - np.where(both, v, 0.0).sum(1, keepdims=True) / n, 0.0) for v in (a, b))
    sa, sb = (np.where(np.nanmin(v, 1) == np.nanmax(v, 1), 0.0, np.nanstd(v, 1)) for v in (a, b))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((sa < TINY) | (sb < TINY), 0.0, (x * y).sum(1) / n[:, 0] / (sa * sb))


def window_features(rows: DataFrame, fs: float, *, keys: Sequence[str] = ("run_id", "segment_id", "k"), order: str = "row", acc: Sequence[str] = ("ax", "ay", "az"), gyro: Sequence[str] = ("gx", "gz"), speed: str | None = None, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """The whole feature row of each window: n_samples, every bundle for each axis and both magnitudes, correlations
    within and between sensors, odometry. Accelerations are taken less their window mean.

    One exchange by window: a window's rows become one array, sorted once, and windows of equal length are worked on
    together, batch by batch. Missing values are passed over; what can't be computed is null; empty gives empty."""
    channels = [*acc, *gyro, *([speed] if speed else [])]
    row = F.struct(F.col(order).alias("_o"), *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(channels)))
    wide = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    signals = [*acc, *gyro, "acc_mag", "gyro_mag"]
    pairs = [(a, b) for i, a in enumerate(acc) for b in acc[i + 1 :]] + [(gyro[0], gyro[1])] + [(acc[0], gyro[0]), (acc[1], gyro[0]), (acc[2], gyro[1]), ("acc_mag", "gyro_mag")]
    shape = ("mean", "std", "min", "max", "range", "rms", "energy", "mean_abs", "median", "iqr", "skew", "kurt", "zcr", "jerk_rms", "activity", "mobility", "complexity")
    above = ("spectral_energy", "dominant_freq", "spectral_centroid", "spectral_entropy", *bands)
    names = [f"{s}_{f}" for s in signals for f in shape] + [f"corr_{a}_{b}" for a, b in pairs] + (["mean_speed", "speed_std", "distance"] if speed else []) + [f"{s}_{f}" for s in signals for f in above]
    kind = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + ["n_samples bigint"] + [f"`{n}` double" for n in names])

    def features_of(x: np.ndarray) -> dict[str, np.ndarray]:
        """x: windows, rows, channels."""
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # a window may miss a channel altogether
            of = {c: x[:, :, i] - np.nanmean(x[:, :, i], 1, keepdims=True) if c in acc else x[:, :, i] for i, c in enumerate(channels)}
            of["acc_mag"], of["gyro_mag"] = (np.sqrt(sum(of[c] * of[c] for c in g)) for g in (acc, gyro))
            out = {f"{s}_{f}": v for s in signals for f, v in stacked_features(of[s], fs, bands).items()}
            out |= {f"corr_{a}_{b}": _stacked_corr(of[a], of[b]) for a, b in pairs}
            if speed:
                v = of[speed]
                out |= {"mean_speed": np.nanmean(v, 1), "speed_std": np.nanstd(v, 1), "distance": np.nansum(np.abs(v), 1) / fs}
            return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            sizes = np.asarray(pc.list_value_length(lists))
            ends, flat = np.cumsum(sizes), lists.flatten()
            values = np.stack([flat.field(i + 1).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(channels))], axis=1)
            found = {name: np.full(batch.num_rows, np.nan) for name in names}
            for n in np.unique(sizes).tolist():
                same = np.flatnonzero(sizes == n)
                for at in np.array_split(same, -(-len(same) * n // 200_000)):
                    for name, v in features_of(values[(ends[at] - n)[:, None] + np.arange(n)]).items():
                        found[name][at] = v
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(sizes, pa.int64()), *(pa.array(found[n], from_pandas=True) for n in names)], names=[*keys, "n_samples", *names])

    return wide.mapInArrow(run, kind)


def mean_of(values: Column) -> Column:
    """Mean of an array, added up from its front: of values `in_order` the same to the last bit (a bound that means often
    meet may hang on it) whatever order tasks and spills bring rows in. Nulls are left out."""
    there = F.filter(values, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.size(there))


def std_of(values: Column) -> Column:
    """Population deviation of an array by Welford's updates from its front; nulls are left out."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("d"))

    def step(a: Column, x: Column) -> Column:
        mean = a["m"] + (x - a["m"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("m"), (a["d"] + (x - mean) * (x - a["m"])).alias("d"))

    return F.aggregate(F.filter(values, lambda x: x.isNotNull()), start, step, lambda a: F.when(a["n"] > 0, F.sqrt(a["d"] / a["n"])))
