"""Queries of segments, windows, features and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam import views as V
from loam.functions import channels as C
from loam.functions import features as X
from loam.functions import panes as P
from loam.operators import long_runs as R
from loam.operators import segments as G

QUERIES, ORACLES = {}, {}
SIZE, STEP = 8, 4
KEYS = ("run_id", "segment_id", "k")
#: DuckDB: segments, rows in them and windows of the events view.
SEG = V.with_views("signals_ev", "epochs_ev") + """, cut AS (SELECT * EXCLUDE (k), k AS kv, CASE WHEN t - lag(t) OVER w > 90000 THEN 1 ELSE 0 END AS c FROM signals_ev WINDOW w AS (PARTITION BY run_id ORDER BY t, event_id)),
seg0 AS (SELECT *, CAST(sum(c) OVER (PARTITION BY run_id ORDER BY t, event_id) AS BIGINT) AS segment_id FROM cut),
seg AS (SELECT *, row_number() OVER (PARTITION BY run_id, segment_id ORDER BY t, event_id) - 1 AS "row", count(*) OVER (PARTITION BY run_id, segment_id) AS n FROM seg0),
win AS (SELECT * FROM (SELECT *, unnest(range(0, 60)) AS k FROM seg) WHERE "row" BETWEEN k * 4 AND k * 4 + 7 AND k * 4 + 8 <= n)"""
W = "PARTITION BY run_id, segment_id, k"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _seg(spark: SparkSession, d: str) -> DataFrame:
    return G.with_segments(V.signals_ev(spark, d), V.GAP, tie=("event_id",))


def _win(spark: SparkSession, d: str) -> DataFrame:
    return G.window_rows(_seg(spark, d), SIZE, STEP)


def r(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" and c not in keep else F.col(c) for c, kind in df.dtypes))


@query(SEG + " SELECT run_id, segment_id, count(*) AS n_samples, round(min(t), 6) AS start_time, round(max(t), 6) AS end_time FROM seg GROUP BY ALL")
def segments(spark: SparkSession, d: str) -> DataFrame:
    return r(G.segments(_seg(spark, d)))


@query(SEG + " SELECT run_id, segment_id, k, min(\"row\") AS window_start_idx, max(\"row\") AS window_end_idx, round(min(t), 6) AS t_start, round(max(t), 6) AS t_end, count(*) AS n_samples FROM win GROUP BY run_id, segment_id, k")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return r(G.sliding_windows(_seg(spark, d), SIZE, STEP))


def _long(spark: SparkSession, d: str) -> DataFrame:
    return R.with_segments(V.signals_ev(spark, d), V.GAP, tie=("event_id",), chunk_rows=V.CHUNK, counted=True)


@query(ORACLES["segments"])
def long_segments(spark: SparkSession, d: str) -> DataFrame:
    """`segments` by scans of chunks."""
    return r(G.segments(_long(spark, d)))


@query(SEG + ", w AS (SELECT run_id, segment_id, k, event_id FROM win) SELECT * FROM w")
def long_windows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all windows by scans of chunks."""
    return G.window_rows(_long(spark, d).drop("k"), SIZE, STEP, count="segment_rows").select(*KEYS, "event_id")


@query(SEG + " SELECT row_number() OVER (ORDER BY run_id, segment_id, k) - 1 AS window_id, run_id, segment_id, k FROM (SELECT DISTINCT run_id, segment_id, k FROM win)")
def window_ids(spark: SparkSession, d: str) -> DataFrame:
    return G.window_ids(G.sliding_windows(_seg(spark, d), SIZE, STEP)).select("window_id", *KEYS)


@query(SEG + " SELECT run_id, segment_id, k, label FROM (SELECT *, row_number() OVER (PARTITION BY run_id, segment_id, k ORDER BY c DESC, f) AS rn FROM (SELECT run_id, segment_id, k, label, count(*) AS c, min(\"row\") AS f FROM win WHERE label <> 'signup' GROUP BY ALL)) WHERE rn = 1")
def window_majority_label(spark: SparkSession, d: str) -> DataFrame:
    return G.window_labels(_win(spark, d).withColumn("label", F.nullif("label", F.lit("signup"))))


@query(SEG + ", w AS (SELECT row_number() OVER (ORDER BY run_id, segment_id, k) - 1 AS window_id, run_id, min(t) AS t_start, max(t) AS t_end FROM win GROUP BY run_id, segment_id, k) SELECT window_id, event_id FROM w JOIN signals_ev s ON s.run_id = w.run_id AND s.t BETWEEN t_start AND t_end")
def window_signal_range_join(spark: SparkSession, d: str) -> DataFrame:
    windows = G.window_ids(G.sliding_windows(_seg(spark, d), SIZE, STEP))
    return G.windows_to_samples(windows, V.signals_ev(spark, d), bucket=200_000.0).select("window_id", "event_id")


@query(SEG + ", w AS (SELECT row_number() OVER (ORDER BY run_id, segment_id, k) - 1 AS window_id, count(*) AS n_samples FROM win GROUP BY run_id, segment_id, k) SELECT * FROM w WHERE window_id % 3 = 1")
def align_by_key(spark: SparkSession, d: str) -> DataFrame:
    windows = G.window_ids(G.sliding_windows(_seg(spark, d), SIZE, STEP)).select("window_id", "n_samples")
    return G.align_by_key(windows, windows.where("window_id % 3 = 1").select("window_id"))


BASIC = "round(avg({x}), 6) AS {s}_mean, round(stddev_pop({x}), 6) AS {s}_std, round(min({x}), 6) AS {s}_min, round(max({x}), 6) AS {s}_max, round(max({x}) - min({x}), 6) AS {s}_range, round(sqrt(avg({x} * {x})), 6) AS {s}_rms, round(sum({x} * {x}), 2) AS {s}_energy, round(avg(abs({x})), 9) AS {s}_mean_abs"
CENTRED = SEG + f", cx AS (SELECT *, x - avg(x) OVER ({W}) AS xc FROM win)"


@query(CENTRED + ", lab AS (SELECT run_id, segment_id, k, label FROM (SELECT *, row_number() OVER (PARTITION BY run_id, segment_id, k ORDER BY c DESC, f) AS rn FROM (SELECT run_id, segment_id, k, label, count(*) AS c, min(\"row\") AS f FROM win GROUP BY ALL)) WHERE rn = 1) SELECT cx.run_id, cx.segment_id, cx.k, any_value(lab.label) AS label, " + BASIC.format(x="xc", s="x").replace("round(avg(xc), 6) AS x_mean, ", "") + ", " + BASIC.format(x="kv", s="k") + " FROM cx JOIN lab USING (run_id, segment_id, k) GROUP BY cx.run_id, cx.segment_id, cx.k")
def tf_basic(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: events to gap-free segments to labelled windows with their basic features."""
    rows = _seg(spark, d).withColumnRenamed("k", "kv")
    windows = P.pane_windows(rows, SIZE, STEP, ["x", "kv"], values=["x"], label="label")
    found = windows.select(*KEYS, "label", *P.centred_basic_of("x"), *P.basic_of("kv"))
    found = found.withColumnsRenamed({c: c.replace("kv_", "k_") for c in found.columns if c.startswith("kv_")})
    other = {"x_energy": 2, "k_energy": 2, "x_mean_abs": 9, "k_mean_abs": 9}  # averages of eight numbers of two decimals can lie halfway
    return r(found, *other).withColumns({c: F.round(c, n) for c, n in other.items()})


@query(SEG + " SELECT run_id, segment_id, k, round(quantile_cont(x, 0.5), 6) AS x_median, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS x_iqr FROM win GROUP BY run_id, segment_id, k")
def tf_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return r(_win(spark, d).groupBy(*KEYS).agg(*X.quantiles("x")))


@query(SEG + " SELECT run_id, segment_id, k, round(skewness(x), 6) AS x_skew, round(kurtosis(x), 6) AS x_kurt FROM win GROUP BY run_id, segment_id, k")
def tf_moments(spark: SparkSession, d: str) -> DataFrame:
    return r(P.pane_windows(_seg(spark, d).drop("k"), SIZE, STEP, ["x"]).select(*KEYS, *P.moments_of("x")))


@query(SEG + ", y AS (SELECT *, CASE WHEN x > 12 THEN 1 WHEN x < 8 THEN -1 END AS sg FROM win), z AS (SELECT *, last_value(sg IGNORE NULLS) OVER (PARTITION BY run_id, segment_id, k ORDER BY \"row\" ROWS UNBOUNDED PRECEDING) AS s FROM y) SELECT run_id, segment_id, k, round(CAST(count(*) FILTER (s * p < 0) AS DOUBLE) / (count(*) - 1), 6) AS y_zcr FROM (SELECT *, lag(s) OVER (PARTITION BY run_id, segment_id, k ORDER BY \"row\") AS p FROM z) GROUP BY run_id, segment_id, k")
def tf_zcr(spark: SparkSession, d: str) -> DataFrame:
    rows = _win(spark, d).withColumn("y", F.when(F.col("x") > 12, F.col("x")).when(F.col("x") < 8, -F.col("x") - 1).otherwise(0.0))
    return r(X.with_steps(rows, ["y"], KEYS, "row").groupBy(*KEYS).agg(*X.crossings("y")))


@query(SEG + f", a AS (SELECT *, x - lag(x) OVER ({W} ORDER BY \"row\") AS d FROM win), b AS (SELECT *, d - lag(d) OVER ({W} ORDER BY \"row\") AS dd FROM a) SELECT run_id, segment_id, k, round(sqrt(avg(d * d)) * 8, 6) AS x_jerk_rms, round(var_pop(x), 6) AS x_activity, round(stddev_pop(d) / stddev_pop(x), 6) AS x_mobility, round(stddev_pop(dd) / stddev_pop(d) / (stddev_pop(d) / stddev_pop(x)), 6) AS x_complexity FROM b GROUP BY run_id, segment_id, k")
def tf_jerk_hjorth(spark: SparkSession, d: str) -> DataFrame:
    return r(X.with_steps(_win(spark, d), ["x"], KEYS, "row").groupBy(*KEYS).agg(*X.jerk_hjorth("x", 8.0)))


@query(V.with_views("signals_li") + ", b AS (SELECT *, CAST(floor(i / 50) AS BIGINT) AS k FROM signals_li) SELECT run_id, k, round(CASE WHEN stddev_pop(ax) < 1e-12 OR stddev_pop(ay) < 1e-12 THEN 0 ELSE corr(ax, ay) END, 6) AS corr_ax_ay, round(CASE WHEN stddev_pop(ax) < 1e-12 OR stddev_pop(gx) < 1e-12 THEN 0 ELSE corr(ax, gx) END, 6) AS corr_ax_gx, CAST(0 AS DOUBLE) AS corr_ax_flat FROM b GROUP BY run_id, k HAVING count(*) > 1")
def window_correlations(spark: SparkSession, d: str) -> DataFrame:
    rows = V.signals_li(spark, d).withColumn("k", F.floor(F.col("i") / 50)).withColumn("flat", F.lit(1.0))
    out = rows.groupBy("run_id", "k").agg(X.safe_corr("ax", "ay").alias("corr_ax_ay"), X.safe_corr("ax", "gx").alias("corr_ax_gx"), X.safe_corr("ax", "flat").alias("corr_ax_flat"))
    return r(out.where("corr_ax_flat is not null"))


@query(V.with_views("signals_li") + " SELECT run_id, CAST(floor(i / 50) AS BIGINT) AS k, round(avg(v), 6) AS mean_speed, round(stddev_pop(v), 6) AS speed_std, round(sum(abs(v)) / 100, 6) AS distance FROM (SELECT *, 0.5 * (v1 + v2) AS v FROM signals_li) GROUP BY ALL")
def odom_features(spark: SparkSession, d: str) -> DataFrame:
    rows = V.signals_li(spark, d).withColumn("v", C.wheel_speed("v1", "v2"))
    return r(rows.groupBy("run_id", F.floor(F.col("i") / 50).alias("k")).agg(*X.odometry("v", 100.0)))


STATIONARY = V.with_views("signals_li") + ", s AS (SELECT *, CAST(floor(i / 40) AS BIGINT) AS segment_id FROM signals_li), m AS (SELECT *, ax - avg(ax) OVER w AS cx, ay - avg(ay) OVER w AS cy, az - avg(az) OVER w AS cz FROM s WINDOW w AS (PARTITION BY run_id, segment_id)), l AS (SELECT run_id, segment_id, avg(sqrt(cx * cx + cy * cy + cz * cz)) AS acc_level, avg(sqrt(gx * gx + gy * gy + gz * gz)) AS gyro_level FROM m GROUP BY ALL), f AS (SELECT *, acc_level < 30 AND gyro_level < 5.4 AS stationary FROM l)"


def _stationary(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = V.signals_li(spark, d).withColumn("segment_id", F.floor(F.col("i") / 40))
    return rows, G.stationary_segments(rows, acc_below=30.0, gyro_below=5.4)


@query(STATIONARY + " SELECT run_id, segment_id, round(acc_level, 6) AS acc_level, round(gyro_level, 6) AS gyro_level, stationary FROM f")
def stationary_segments(spark: SparkSession, d: str) -> DataFrame:
    return r(_stationary(spark, d)[1])


MOVING = STATIONARY + ", gone AS MATERIALIZED (SELECT run_id, segment_id FROM f WHERE stationary) SELECT run_id, segment_id, i FROM s ANTI JOIN gone USING (run_id, segment_id)"


@query(MOVING)
def remove_stationary(spark: SparkSession, d: str) -> DataFrame:
    return G.remove_stationary(*_stationary(spark, d)).select("run_id", "segment_id", "i")


@query(MOVING)
def moving_rows(spark: SparkSession, d: str) -> DataFrame:
    """`remove_stationary` by another name."""
    return remove_stationary(spark, d)


#: A discrete Fourier transform by sums: frequencies k / 64 of 64 values at 100 hertz.
DFT = V.with_views("series_emb") + ", v AS (SELECT vec_id, unnest(series) AS x, unnest(range(64)) AS n FROM series_emb), c AS (SELECT vec_id, n, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM v), p AS (SELECT vec_id, f, (sum(x * cos(2 * pi() * f * n / 64)) ^ 2 + sum(x * sin(2 * pi() * f * n / 64)) ^ 2) / 64 AS psd FROM c, (SELECT unnest(range(33)) AS f) GROUP BY vec_id, f), q AS (SELECT *, f * 100 / 64.0 AS hz, psd / sum(psd) FILTER (f > 0) OVER (PARTITION BY vec_id) AS share FROM p)"


@query(DFT + " SELECT vec_id, round((sum(psd) - max(psd) FILTER (f = 0) / 2 - max(psd) FILTER (f = 32) / 2) * 100 / 64, 4) AS series_spectral_energy, round(arg_max(hz, psd) FILTER (f > 0), 4) AS series_dominant_freq, round(sum(hz * share) FILTER (f > 0), 4) AS series_spectral_centroid, round(-sum(share * log2(share)) FILTER (f > 0 AND share > 0), 4) AS series_spectral_entropy FROM q GROUP BY vec_id")
def spectral_features(spark: SparkSession, d: str) -> DataFrame:
    return r(X.spectral_features(V.series_emb(spark, d), ["series"], 100.0, keys=["vec_id"], bands={}), digits=4)


BAND = "round(coalesce(sum(psd) FILTER (hz BETWEEN {a} AND {b}) - (arg_min(psd, f) FILTER (hz BETWEEN {a} AND {b}) + arg_max(psd, f) FILTER (hz BETWEEN {a} AND {b})) / 2, 0) * 100 / 64, 4) AS series_{n}"


@query(DFT + " SELECT vec_id, " + ", ".join(BAND.format(a=a, b=b, n=n) for n, (a, b) in X.BANDS.items()) + " FROM q GROUP BY vec_id")
def band_power(spark: SparkSession, d: str) -> DataFrame:
    found = X.spectral_features(V.series_emb(spark, d), ["series"], 100.0, keys=["vec_id"])
    return r(found.select("vec_id", *(f"series_{b}" for b in X.BANDS)), digits=4)


def window_features(spark: SparkSession, d: str) -> DataFrame:
    """All features of 200-row windows, half overlapping, of the suppliers' lines."""
    rows = G.with_segments(V.signals_li(spark, d), 0.025).withColumn("v", C.wheel_speed("v1", "v2"))
    return X.window_features(G.window_rows(rows, 200, 100), 100.0, speed="v")


QUERIES["window_features"] = window_features

#: A small feature table: 50-row blocks of the lines.
FT = V.with_views("signals_li") + ", ft AS (SELECT run_id, CAST(floor(i / 50) AS BIGINT) AS k, min(t) AS t_start, mode(label ORDER BY label) AS lab0, max(label) AS label, avg(v) AS mean_speed, stddev_pop(v) AS speed_std, sum(ax * ax) AS energy, avg(gx) AS gx_mean, max(az) AS az_max FROM (SELECT *, 0.5 * (v1 + v2) AS v FROM signals_li) GROUP BY 1, 2)"
FT = FT.replace("mode(label ORDER BY label) AS lab0, max(label) AS label", "CASE WHEN avg(ax) < 23 THEN 'A' WHEN avg(ax) < 26 THEN 'N' ELSE 'R' END AS label")


def features_li(spark: SparkSession, d: str) -> DataFrame:
    """Means and deviations are taken in the order of a window's rows, as they meet the bounds of later queries exactly."""
    rows = V.signals_li(spark, d).withColumn("v", C.wheel_speed("v1", "v2"))
    label = F.when(F.avg("ax") < 23, "A").when(F.avg("ax") < 26, "N").otherwise("R")
    per = rows.groupBy("run_id", F.floor(F.col("i") / 50).alias("k")).agg(F.min("t").alias("t_start"), label.alias("label"), X.in_order("v", "i").alias("_v"), F.sum(F.col("ax") * F.col("ax")).alias("energy"), X.in_order("gx", "i").alias("_gx"), F.max("az").alias("az_max"))
    return per.select("run_id", "k", "t_start", "label", X.mean_of(F.col("_v")).alias("mean_speed"), X.std_of(F.col("_v")).alias("speed_std"), "energy", X.mean_of(F.col("_gx")).alias("gx_mean"), "az_max")


@query("SELECT suffix, w.* FROM (" + ORACLES["sliding_windows"] + ") w, (SELECT unnest(['csv', 'parquet']) AS suffix)")
def written_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows written as CSV and as Parquet by the path's suffix, and read again."""
    from loam.shared import shared_path
    from loam.sources import logs

    root, windows = shared_path(spark, "written-windows"), sliding_windows(spark, d)
    for suffix in ("csv", "parquet"):
        logs.write_table(windows, f"{root}/windows.{suffix}")
    back = {"csv": spark.read.schema(windows.schema).option("header", True).csv(f"{root}/windows.csv"), "parquet": spark.read.parquet(f"{root}/windows.parquet")}
    return back["csv"].withColumn("suffix", F.lit("csv")).unionByName(back["parquet"].withColumn("suffix", F.lit("parquet")))


@query(FT + " SELECT feature, count(value) AS n, round(avg(value), 4) AS mean FROM (SELECT unnest(['energy', 'gx_mean', 'az_max']) AS feature, unnest([energy, gx_mean, az_max]) AS value FROM ft) GROUP BY feature")
def feature_columns(spark: SparkSession, d: str) -> DataFrame:
    """What the columns that are features hold: neither ids nor speeds."""
    from loam.operators.selection import melt

    table = features_li(spark, d)
    names = C.feature_columns(table.columns, ("run_id", "k", "t_start", "label"), drop_prefixes=("mean_speed", "speed_"))
    return melt(table, [], names).groupBy("feature").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query(FT + " SELECT run_id, k FROM ft WHERE mean_speed < 0.78 AND speed_std < 0.32")
def speed_regime_split(spark: SparkSession, d: str) -> DataFrame:
    return C.slow_and_steady(features_li(spark, d), below=0.78, std_below=0.32).select("run_id", "k")


@query(FT + " SELECT label, n, n_all, round(100.0 * n / n_all, 6) AS percent_kept, CASE WHEN n < 50 THEN 'CRITICAL' WHEN n < 100 THEN 'WARNING' ELSE 'OK' END AS status FROM (SELECT label, count(*) FILTER (mean_speed < 0.78 AND speed_std < 0.32) AS n, count(*) AS n_all FROM ft GROUP BY label)")
def regime_class_report(spark: SparkSession, d: str) -> DataFrame:
    whole = features_li(spark, d)
    return r(C.class_report(C.slow_and_steady(whole, below=0.78, std_below=0.32), whole))


@query(FT + " SELECT run_id, k, round(ln(1 + greatest(energy, 0)), 6) AS energy, round(CASE WHEN gx_mean > 4 THEN NULL ELSE ln(1 + greatest(gx_mean - 3.8, 0)) END, 6) AS gx_mean FROM ft")
def log_transform(spark: SparkSession, d: str) -> DataFrame:
    table = features_li(spark, d).withColumn("gx_mean", F.when(F.col("gx_mean") <= 4, F.col("gx_mean") - 3.8))
    return r(C.log_transform(table, ("energy", "gx_mean", "absent")).select("run_id", "k", "energy", "gx_mean"))


@query(FT + " SELECT run_id, k, round(energy / greatest(mean_speed - 0.7, 0.05), 4) AS energy_over_speed, round(gx_mean / greatest(mean_speed - 0.7, 0.05), 4) AS gx_mean_over_speed FROM ft")
def speed_normalised(spark: SparkSession, d: str) -> DataFrame:
    table = features_li(spark, d).withColumn("mean_speed", F.col("mean_speed") - 0.7)
    return r(C.per_speed(table, ("energy", "gx_mean")).select("run_id", "k", "energy_over_speed", "gx_mean_over_speed"), digits=4)


@query(FT + " SELECT run_id, k FROM ft WHERE label IN ('A', 'R') AND run_id NOT IN (1, 5, 9)")
def filter_labels_runs(spark: SparkSession, d: str) -> DataFrame:
    return features_li(spark, d).where(F.col("label").isin("A", "R") & ~F.col("run_id").isin(1, 5, 9)).select("run_id", "k")


@query(FT + " SELECT CASE WHEN label IN ('A', 'N') THEN 'dirt' ELSE label END AS label, count(*) AS n FROM ft GROUP BY 1")
def merge_labels(spark: SparkSession, d: str) -> DataFrame:
    return C.merge_labels(features_li(spark, d), {"dirt": ("A", "N")}).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(FT + " SELECT CASE WHEN run_id NOT IN (2, 3) THEN CAST(run_id AS VARCHAR) WHEN t_start <= (SELECT quantile_cont(t_start, 0.5) FROM ft m WHERE m.run_id = ft.run_id) THEN run_id || '_partA' ELSE run_id || '_partB' END AS run_id, k FROM ft")
def split_run_at_median(spark: SparkSession, d: str) -> DataFrame:
    return C.split_run(features_li(spark, d), (2, 3)).select("run_id", "k")


@query(FT + " SELECT run_id, k, CASE WHEN k % 3 = 0 THEN 0 ELSE round(energy, 4) END AS energy FROM ft")
def nan_to_num(spark: SparkSession, d: str) -> DataFrame:
    bad = F.when(F.col("k") % 9 == 0, float("nan")).when(F.col("k") % 9 == 3, float("inf")).when(F.col("k") % 9 == 6, F.lit(None)).otherwise(F.col("energy"))
    return r(C.finite(features_li(spark, d).withColumn("energy", bad), ["energy"]).select("run_id", "k", "energy"), digits=4)


@query(FT + " SELECT label, count(*) AS n, round(avg(energy), 4) AS energy, round(avg(gx_mean), 6) AS gx_mean, count(*) FILTER (k % 4 = 0) AS energy_missing FROM ft GROUP BY label".replace("avg(energy)", "avg(energy) FILTER (k % 4 <> 0)"))
def feature_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    from loam.operators.selection import feature_diagnostics as diagnose

    table = features_li(spark, d).withColumn("energy", F.when(F.col("k") % 4 != 0, F.col("energy")).otherwise(float("nan")))
    out = diagnose(table, ("energy", "gx_mean")).select("label", "n", "energy", "gx_mean", "energy_missing")
    return out.withColumn("energy", F.round("energy", 4)).withColumn("gx_mean", F.round("gx_mean", 6))


@query(FT + ", m AS (SELECT label, run_id, 'energy' AS feature, avg(energy) AS v FROM ft GROUP BY ALL UNION ALL SELECT label, run_id, 'gx_mean', avg(gx_mean) FROM ft GROUP BY ALL) SELECT label, feature, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(stddev_pop(v) / (abs(avg(v)) + 1e-9), 6) AS cv FROM m GROUP BY ALL")
def run_shift_stability(spark: SparkSession, d: str) -> DataFrame:
    from loam.operators.selection import run_shift

    return run_shift(features_li(spark, d), ("energy", "gx_mean")).select("label", "feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("cv", 6).alias("cv"))


@query(V.with_views("signals_li") + " SELECT run_id, i, round(sum(ax) OVER (PARTITION BY run_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS ax FROM signals_li")
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    from loam.operators.filters import moving_average as smooth

    return r(smooth(V.signals_li(spark, d), ["ax"], 5, keys=["run_id"], order="i").select("run_id", "i", "ax"))
