"""Queries of ingest, alignment, labelling and quality control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam import views as V
from loam.operators import align as A
from loam.operators import long_runs as R
from loam.operators import labelling as L
from loam.operators import qc as Q
from loam.sources import label_config as C
from loam.sources import logs as S

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, *needs: str):
    """Register a function under its name, with the DuckDB SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (V.with_views(*needs) + " " if needs else "") + sql
        return f

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]



def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as text lines: some with comments, some too short, times of every seventh cut to the day."""
    ev = V.signals_ev(spark, d).withColumn("tt", F.when(F.col("event_id") % 7 == 0, F.floor(F.col("t") / 86400) * 86400).otherwise(F.col("t")))
    line = F.when(F.col("event_id") % 11 == 0, F.format_string("  %.6f  %.2f", "tt", "x")).otherwise(F.format_string("%.6f \t %.2f %.1f%s", "tt", "x", "k", F.when(F.col("event_id") % 5 == 0, " % a note 7").otherwise("")))
    return ev.select("run_id", "event_id", line.alias("value"))


@query("SELECT run_id, event_id, round(tt, 6) AS t, x, CASE WHEN event_id % 11 = 0 THEN NULL ELSE k END AS k FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN floor(t / 86400) * 86400 ELSE t END AS tt FROM signals_ev)", "signals_ev")
def parse_log(spark: SparkSession, d: str) -> DataFrame:
    return S.parse_lines(_lines(spark, d), ("t", "x", "k")).withColumn("t", F.round("t", 6))


@query("SELECT run_id, round(tt, 6) AS t, x, k FROM (SELECT *, row_number() OVER (PARTITION BY run_id, tt ORDER BY event_id) AS rn FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN floor(t / 86400) * 86400 ELSE t END AS tt FROM signals_ev) WHERE event_id % 11 <> 0) WHERE rn = 1", "signals_ev")
def dedup_first_per_ts(spark: SparkSession, d: str) -> DataFrame:
    rows = S.parse_lines(_lines(spark, d), ("t", "x", "k"))
    return S.clean_rows(rows, ("t", "x", "k"), arrival=["event_id"]).select("run_id", F.round("t", 6).alias("t"), "x", "k")


@query("SELECT s.run_id, sensor, event_id, round(t - t0, 6) AS t_rel FROM sensors s JOIN (SELECT run_id, min(t) AS t0 FROM sensors GROUP BY run_id) USING (run_id)", "sensors")
def relative_time(spark: SparkSession, d: str) -> DataFrame:
    return S.relative_time(V.sensors(spark, d)).select("run_id", "sensor", "event_id", *r6("t_rel"))


@query("SELECT run_id, sensor, event_id FROM s WHERE run_id IN (SELECT run_id FROM s GROUP BY run_id HAVING count(DISTINCT sensor) = 3)".replace(" s ", " (SELECT * FROM sensors WHERE v > 10 * (run_id % 5)) "), "sensors")
def complete_runs(spark: SparkSession, d: str) -> DataFrame:
    return S.complete_runs(V.sensors(spark, d).where("v > 10 * (run_id % 5)")).select("run_id", "sensor", "event_id")


def _configs(spark: SparkSession, d: str) -> DataFrame:
    """The intervals as one JSON per run, labels and ranges in order."""
    ranges = V.intervals(spark, d).groupBy("run_id", "label", "label_ord").agg(F.array_sort(F.collect_list(F.struct("range_ord", "t0", "t1"))).alias("r"))
    ranges = ranges.select("run_id", "label_ord", F.concat(F.lit('"'), "label", F.lit('": '), F.to_json(F.transform("r", lambda x: F.array(x["t0"], x["t1"])))).alias("json"))
    per = ranges.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("label_ord", "json"))).alias("all"))
    return per.select("run_id", F.concat(F.lit("{"), F.array_join(F.transform("all", lambda x: x["json"]), ", "), F.lit("}")).alias("config"))


@query("SELECT run_id, label, CAST(dense_rank() OVER (PARTITION BY run_id ORDER BY label_ord) - 1 AS BIGINT) AS label_ord, CAST(range_ord AS BIGINT) AS range_ord, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM intervals", "intervals")
def label_intervals(spark: SparkSession, d: str) -> DataFrame:
    return C.label_intervals(_configs(spark, d)).select("run_id", "label", F.col("label_ord").cast("bigint"), F.col("range_ord").cast("bigint"), *r6("t0", "t1"))


@query("SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'own' || run_id WHEN run_id % 4 = 1 THEN 'p' || (run_id % 8) END AS config, CASE WHEN run_id % 2 = 0 THEN 'run' WHEN run_id % 4 = 1 THEN 'parent' END AS level FROM (SELECT DISTINCT run_id FROM signals_ev)", "signals_ev")
def label_config_fallback(spark: SparkSession, d: str) -> DataFrame:
    runs = V.signals_ev(spark, d).select("run_id", (F.col("run_id") % 8).alias("parent")).distinct()
    own = runs.where("run_id % 2 = 0").select("run_id", F.concat(F.lit("own"), F.col("run_id").cast("string")).alias("config"))
    parents = runs.where("parent % 4 = 1").select("parent", F.concat(F.lit("p"), F.col("parent").cast("string")).alias("config")).distinct()
    return C.config_of_runs(runs, own, parents)


@query("SELECT run_id, i, round(sqrt(ax * ax + ay * ay + az * az), 6) AS acc_mag, round(sqrt(gx * gx + gy * gy + gz * gz), 6) AS gyro_mag, round(0.5 * (v1 + v2), 6) AS wheel_speed FROM signals_li", "signals_li")
def derived_channels(spark: SparkSession, d: str) -> DataFrame:
    from loam.functions.channels import magnitude, wheel_speed

    return V.signals_li(spark, d).select("run_id", "i", F.round(magnitude("ax", "ay", "az"), 6).alias("acc_mag"), F.round(magnitude("gx", "gy", "gz"), 6).alias("gyro_mag"), F.round(wheel_speed("v1", "v2"), 6).alias("wheel_speed"))


@query("SELECT run_id, i FROM signals_li WHERE 0.5 * (v1 + v2) >= 0.4 AND abs((v2 - v1) / 0.5) <= 1.5", "signals_li")
def clean_samples(spark: SparkSession, d: str) -> DataFrame:
    from loam.functions.channels import clean_samples as clean

    return clean(V.signals_li(spark, d), min_speed=0.4, max_yaw_rate=1.5, track_width=0.5).select("run_id", "i")



@query("SELECT run_id, event_id, name AS label FROM (SELECT s.run_id, event_id, v.label AS name, row_number() OVER (PARTITION BY s.run_id, event_id ORDER BY label_ord, range_ord) AS rn FROM signals_ev s LEFT JOIN intervals v ON v.run_id = s.run_id AND v.t0 <= s.t AND s.t <= v.t1) WHERE rn = 1", "signals_ev", "intervals")
def interval_label_join(spark: SparkSession, d: str) -> DataFrame:
    return L.label_samples(V.signals_ev(spark, d), V.intervals(spark, d)).select("run_id", "event_id", "label")


# nanoseconds would tell times apart that microseconds do not: samples are unique per (run, sensor, t) in the view
GRID = "span AS (SELECT run_id, min(t) AS lo, max(t) AS hi FROM sensors GROUP BY run_id), points AS (SELECT run_id, i, lo + i * 21600 AS t FROM (SELECT run_id, lo, unnest(range(CAST(ceil((hi + 10800 - lo) / 21600) AS BIGINT))) AS i FROM span)), acc AS (SELECT run_id, t, v FROM sensors WHERE sensor = 'acc')"
PAIR = "a AS (SELECT p.run_id, p.i, p.t, s.t AS t0, s.v AS v0 FROM points p ASOF LEFT JOIN acc s ON s.run_id = p.run_id AND s.t <= p.t), b AS (SELECT p.run_id, p.i, s.t AS t1, s.v AS v1 FROM points p ASOF LEFT JOIN acc s ON s.run_id = p.run_id AND s.t >= p.t), ab AS (SELECT * FROM a JOIN b USING (run_id, i) WHERE run_id IN (SELECT run_id FROM acc))"


def _aligned(spark: SparkSession, d: str, how: str) -> DataFrame:
    sensors = V.sensors(spark, d)
    return A.align(sensors.where("sensor = 'acc'"), A.grid(sensors, V.GRID_S), ["v"], how).select("run_id", "i", *r6("v"))


def _grid_sql(body: str) -> str:
    return V.with_views("sensors") + ", " + GRID + ", " + PAIR + " SELECT run_id, i, round(" + body + ", 6) AS v FROM ab"


def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d, "backward")


def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d, "forward")


def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d, "linear")


LINEAR = "CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) / (t1 - t0) * (t - t0) END"
for _f, _sql in ((asof_backward, "coalesce(v0, v1)"), (asof_forward, "coalesce(v1, v0)"), (resample_linear, LINEAR)):
    QUERIES[_f.__name__], ORACLES[_f.__name__] = _f, _grid_sql(_sql)


def merge_sensors(spark: SparkSession, d: str) -> DataFrame:
    return A.merge_sensors(V.sensors(spark, d), V.GRID_S, ("acc", "gyro", "odo")).select("run_id", "i", *r6("acc", "gyro", "odo"))


QUERIES["merge_sensors"] = merge_sensors
_one = "SELECT run_id, i, round({x}, 6) AS {s} FROM (SELECT p.run_id, p.i, p.t, s.t AS t0, s.v AS v0, r.t AS t1, r.v AS v1 FROM points p ASOF LEFT JOIN (SELECT * FROM sensors WHERE sensor = '{s}') s ON s.run_id = p.run_id AND s.t <= p.t ASOF LEFT JOIN (SELECT * FROM sensors WHERE sensor = '{s}') r ON r.run_id = p.run_id AND r.t >= p.t)"
ORACLES["merge_sensors"] = V.with_views("sensors") + ", " + GRID + "".join(f", {s}_ AS (" + _one.format(s=s, x=LINEAR) + ")" for s in ("acc", "gyro", "odo")) + " SELECT run_id, i, acc, gyro, odo FROM acc_ JOIN gyro_ USING (run_id, i) JOIN odo_ USING (run_id, i)"


@query(ORACLES["resample_linear"])
def long_resample(spark: SparkSession, d: str) -> DataFrame:
    """`resample_linear` by scans of chunks."""
    sensors = V.sensors(spark, d)
    return R.align(sensors.where("sensor = 'acc'"), A.grid(sensors, V.GRID_S), ["v"], chunk_rows=V.CHUNK).select("run_id", "i", *r6("v"))


@query(ORACLES["merge_sensors"])
def long_merge(spark: SparkSession, d: str) -> DataFrame:
    """`merge_sensors` by scans of chunks."""
    sensors = V.sensors(spark, d)
    return R.merge_sensors(sensors, A.grid(sensors, V.GRID_S), ("acc", "gyro", "odo"), chunk_rows=V.CHUNK).select("run_id", "i", *r6("acc", "gyro", "odo"))


STATS = "st AS (SELECT *, t - lag(t) OVER (PARTITION BY run_id, sensor ORDER BY t) AS dt FROM sensors), s0 AS (SELECT run_id, sensor, count(*) AS n, CASE WHEN count(*) > 1 THEN max(t) - min(t) ELSE 0.0 END AS duration_s, quantile_cont(dt, 0.5) AS dt_med, quantile_cont(dt, 0.99) AS dt_p99, max(dt) AS dt_max FROM st GROUP BY run_id, sensor), stats AS (SELECT s0.*, CASE WHEN dt_med > 0 THEN 1 / dt_med END AS fs_med_hz, CASE WHEN dt_med > 0 THEN dt_max / dt_med END AS gap_ratio, (SELECT count(*) FROM st WHERE st.run_id = s0.run_id AND st.sensor = s0.sensor AND dt_med > 0 AND dt > 5 * dt_med) AS n_gaps FROM s0)"
FIGURES = ("duration_s", "fs_med_hz", "dt_med", "dt_p99", "dt_max", "gap_ratio")


def qc_stats(spark: SparkSession, d: str) -> DataFrame:
    return Q.qc_stats(V.sensors(spark, d)).select("run_id", "sensor", "n", *(F.round(c, 9 if c == "fs_med_hz" else 6).alias(c) for c in FIGURES), "n_gaps")


QUERIES["qc_stats"] = qc_stats
ORACLES["qc_stats"] = V.with_views("sensors") + ", " + STATS + " SELECT run_id, sensor, n, " + ", ".join(f"round({c}, {9 if c == 'fs_med_hz' else 6}) AS {c}" for c in FIGURES) + ", n_gaps FROM stats"


def qc_report(spark: SparkSession, d: str) -> DataFrame:
    """The runs' reports as JSON, read back."""
    reports = Q.qc_reports(Q.qc_stats(V.sensors(spark, d))).select("run_id", F.to_json("qc_report").alias("report"))
    kind = "map<string, struct<n: bigint, " + ", ".join(f"{c}: double" for c in FIGURES) + ", n_gaps: bigint>>"
    back = reports.select("run_id", F.explode(F.from_json("report", kind)).alias("sensor", "x")).select("run_id", "sensor", "x.*")
    return back.select("run_id", "sensor", "n", *(F.round(c, 9 if c == "fs_med_hz" else 6).alias(c) for c in FIGURES), "n_gaps")


QUERIES["qc_report"], ORACLES["qc_report"] = qc_report, ORACLES["qc_stats"]


#: Rates of the event sensors are far below hertz; the ranges of the query fit them.
EV_RANGES = {"acc": (0.0, 2.5e-5), "gyro": (0.5e-5, 2e-5), "odo": (1e-5, 1.0)}


def qc_pass_fail(spark: SparkSession, d: str) -> DataFrame:
    table = Q.qc_table(Q.qc_stats(V.sensors(spark, d), gap_factor=8.0), ("acc", "gyro", "odo"), min_duration=2e6, ranges=EV_RANGES)
    return table.select("run_id", "acc__n", F.round("gyro__dt_med", 6).alias("gyro__dt_med"), "odo__n_gaps", "pass_dt_gaps", "pass_duration", "pass_fs", "pass_all")


QUERIES["qc_pass_fail"] = qc_pass_fail
PASS = STATS.replace("dt > 5 * dt_med", "dt > 8 * dt_med") + ", qc AS (SELECT run_id, max(n) FILTER (sensor = 'acc') AS acc__n, round(max(dt_med) FILTER (sensor = 'gyro'), 6) AS gyro__dt_med, max(n_gaps) FILTER (sensor = 'odo') AS odo__n_gaps, bool_and(n_gaps = 0) AS pass_dt_gaps, bool_and(duration_s >= 2e6) AS pass_duration, bool_and(coalesce(fs_med_hz BETWEEN CASE sensor WHEN 'acc' THEN 0 WHEN 'gyro' THEN 0.5e-5 ELSE 1e-5 END AND CASE sensor WHEN 'acc' THEN 2.5e-5 WHEN 'gyro' THEN 2e-5 ELSE 1 END, false)) AS pass_fs FROM stats GROUP BY run_id)"
ORACLES["qc_pass_fail"] = V.with_views("sensors") + ", " + PASS + " SELECT *, pass_dt_gaps AND pass_duration AND pass_fs AS pass_all FROM qc"


def keep_passing_runs(spark: SparkSession, d: str) -> DataFrame:
    sensors = V.sensors(spark, d)
    passed, _ = Q.split_pass_fail(Q.qc_table(Q.qc_stats(sensors, gap_factor=8.0), ("acc", "gyro", "odo"), min_duration=2e6, ranges=EV_RANGES))
    return sensors.join(passed.select("run_id"), "run_id", "left_semi").select("run_id", "sensor", "event_id")


QUERIES["keep_passing_runs"] = keep_passing_runs
ORACLES["keep_passing_runs"] = V.with_views("sensors") + ", " + PASS + " SELECT run_id, sensor, event_id FROM sensors WHERE run_id IN (SELECT run_id FROM qc WHERE pass_dt_gaps AND pass_duration AND pass_fs)"


@query("SELECT r.run_id, count(*) AS n FROM signals_ev r WHERE r.run_id NOT IN (SELECT run_id FROM intervals WHERE label = 'err' AND t0 - 1700000000 > 5500000) GROUP BY r.run_id", "signals_ev", "intervals")
def unlabelled_runs(spark: SparkSession, d: str) -> DataFrame:
    configs = V.intervals(spark, d).where("label = 'err' and t0 - 1700000000 > 5500000")
    return L.without_config(V.signals_ev(spark, d), configs)[1].groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT run_id, round(avg(x) FILTER (t - t0 <= 200000), 6) AS bias_x, round(avg(k) FILTER (t - t0 <= 200000), 6) AS bias_k FROM signals_ev JOIN (SELECT run_id, min(t) AS t0 FROM signals_ev GROUP BY run_id) USING (run_id) GROUP BY run_id", "signals_ev")
def bias_first_seconds(spark: SparkSession, d: str) -> DataFrame:
    return Q.bias(S.relative_time(V.signals_ev(spark, d)), ("x", "k"), seconds=200_000.0).select("run_id", *r6("bias_x", "bias_k"))


@query("SELECT run_id, round(min(t), 6) AS t_min, round(max(t), 6) AS t_max FROM signals_ev GROUP BY run_id", "signals_ev")
def time_range(spark: SparkSession, d: str) -> DataFrame:
    return Q.time_range(V.signals_ev(spark, d)).select("run_id", *r6("t_min", "t_max"))


CHANNEL = """, long AS (SELECT run_id, i, 'ax' AS channel, ax AS v FROM signals_li UNION ALL SELECT run_id, i, 'az', az FROM signals_li UNION ALL SELECT run_id, i, 'gx', gx FROM signals_li),
l1 AS (SELECT *, coalesce(abs(v - lag(v) OVER w) <= 1e-8, false) AS same, CASE WHEN coalesce(abs(v - lag(v) OVER w) <= 1e-8 + 1e-5 * abs(lag(v) OVER w), false) THEN 0 ELSE 1 END AS fresh, max(abs(v)) OVER (PARTITION BY run_id, channel) AS top FROM long WINDOW w AS (PARTITION BY run_id, channel ORDER BY i)),
l2 AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id, channel ORDER BY i) AS island FROM l1), runs AS (SELECT run_id, channel, island, count(*) AS len FROM l2 GROUP BY ALL),
c AS (SELECT run_id, channel, max(top) AS max_abs, count(*) AS n, count(DISTINCT v) AS n_unique, round(avg(CAST(same AS INT)), 6) AS repeat_ratio, CAST(sum(CASE WHEN abs(abs(v) - top) <= greatest(1e-9, 0.001 * top) THEN 1 ELSE 0 END) AS BIGINT) AS clip_candidates FROM l2 GROUP BY ALL)
SELECT c.*, longest_constant_run, n_unique <= 2 OR repeat_ratio > 0.98 OR longest_constant_run >= greatest(20, floor(0.1 * n)) AS flag_frozen, clip_candidates >= greatest(10, floor(0.01 * n)) AS flag_flat_top FROM c JOIN (SELECT run_id, channel, max(len) AS longest_constant_run FROM runs GROUP BY ALL) USING (run_id, channel)"""


@query(CHANNEL, "signals_li")
def channel_checks(spark: SparkSession, d: str) -> DataFrame:
    return Q.channel_checks(V.signals_li(spark, d), ("ax", "az", "gx"), order=("i",)).withColumn("repeat_ratio", F.round("repeat_ratio", 6))


@query("SELECT coalesce(name, 'unlabeled') AS label, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM signals_ev), 6) AS percent FROM (SELECT v.label AS name, row_number() OVER (PARTITION BY s.run_id, event_id ORDER BY label_ord, range_ord) AS rn FROM signals_ev s LEFT JOIN intervals v ON v.run_id = s.run_id AND v.t0 <= s.t AND s.t <= v.t1) WHERE rn = 1 GROUP BY 1", "signals_ev", "intervals")
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return L.label_distribution(L.label_samples(V.signals_ev(spark, d), V.intervals(spark, d))).withColumn("percent", F.round("percent", 6))


@query("SELECT run_id, count(*) FILTER (label = 'click') AS click, count(*) FILTER (label = 'error') AS error, count(*) FILTER (label = 'view') AS \"view\" FROM signals_ev GROUP BY run_id", "signals_ev")
def run_label_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return L.crosstab(V.signals_ev(spark, d), "run_id", "label", ("click", "error", "view"))


CHANGES = ", c AS (SELECT *, sum(change) OVER (PARTITION BY run_id ORDER BY i) AS no FROM (SELECT run_id, i, lbl, CASE WHEN i > 0 AND lbl IS DISTINCT FROM lag(lbl) OVER (PARTITION BY run_id ORDER BY i) THEN 1 ELSE 0 END AS change FROM epochs_ev)) SELECT a.run_id, CAST(a.no AS BIGINT) AS change, b.i, b.i - a.i AS \"offset\", b.lbl FROM c a JOIN epochs_ev b ON b.run_id = a.run_id AND b.i BETWEEN a.i - 2 AND a.i + 2 WHERE a.change = 1 AND a.no <= 3"


@query(CHANGES, "epochs_ev")
def label_change_context(spark: SparkSession, d: str) -> DataFrame:
    return L.label_changes(V.epochs_ev(spark, d), label="lbl")


@query("SELECT DISTINCT label, 'unexpected' AS issue FROM signals_ev WHERE label NOT IN ('view', 'click', 'rest') UNION ALL SELECT 'rest', 'missing'", "signals_ev")
def label_set_check(spark: SparkSession, d: str) -> DataFrame:
    expected = V.signals_ev(spark, d).select(F.explode(F.array(*map(F.lit, ("view", "click", "rest")))).alias("label")).distinct()
    return L.unexpected_labels(V.signals_ev(spark, d), expected)


@query("SELECT CASE WHEN hi > lo THEN least(80, CAST(floor((dt - lo) / (hi - lo) * 80) AS BIGINT) + 1) ELSE 1 END AS bin, count(*) AS n FROM (SELECT t - lag(t) OVER (PARTITION BY run_id ORDER BY t) AS dt FROM signals_ev), (SELECT min(dt) AS lo, max(dt) AS hi FROM (SELECT t - lag(t) OVER (PARTITION BY run_id ORDER BY t) AS dt FROM signals_ev)) WHERE dt IS NOT NULL GROUP BY 1", "signals_ev")
def dt_histogram(spark: SparkSession, d: str) -> DataFrame:
    return Q.dt_histogram(V.signals_ev(spark, d))


@query("SELECT run_id, sensor, event_id FROM sensors", "sensors")
def union_runs(spark: SparkSession, d: str) -> DataFrame:
    parts = [V.sensors(spark, d).where(F.col("sensor") == s) for s in ("acc", "gyro", "odo")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select("run_id", "sensor", "event_id")


@query("SELECT 'log_' || (run_id % 16) AS run_id, round(t, 6) AS t, first(round(x, 6) ORDER BY event_id) AS ax, first(k ORDER BY event_id) AS ay, first(label ORDER BY event_id) AS label FROM (SELECT * FROM signals_ev WHERE x IS NOT NULL AND k IS NOT NULL AND t IS NOT NULL ORDER BY event_id) GROUP BY ALL", "signals_ev")
def csv_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs written as CSV, a folder each, and found and read again: times are unique, further columns are kept."""
    from loam.shared import shared_path

    rows = V.signals_ev(spark, d).where("x is not null and k is not null and t is not null")
    rows = rows.select(F.concat(F.lit("log_"), (F.col("run_id") % 16).cast("string")).alias("run"), F.round("t", 6).alias("t"), F.round("x", 6).alias("ax"), F.col("k").alias("ay"), F.lit(0.0).alias("az"), "label", "event_id")
    first = S.clean_rows(rows, ("t", "ax", "ay"), keys=("run",), arrival=["event_id"])
    root = shared_path(spark, "csv-runs")
    first.drop("event_id").withColumnRenamed("run", "folder").withColumn("folder", F.col("folder")).write.partitionBy("folder").option("header", True).csv(root)
    back = spark.read.option("header", True).csv(root)
    S.require_columns(back, S.SENSOR_COLUMNS["acc"])
    return back.select(F.col("folder").alias("run_id"), *(F.col(c).cast("double").alias(c) for c in ("t", "ax", "ay")), "label")


@query("SELECT run_id, feature FROM (SELECT run_id, unnest(list_distinct(list(label))) AS feature FROM signals_ev GROUP BY run_id)", "signals_ev")
def top_feature_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of names as JSON of three shapes (a list, a map, a map with top_features), read alike."""
    from loam.sources import label_config

    names = V.signals_ev(spark, d).groupBy("run_id").agg(F.collect_set("label").alias("n"))
    keyed = F.to_json(F.map_from_arrays("n", F.transform("n", lambda x: F.lit(1))))
    text = F.when(F.col("run_id") % 3 == 0, F.to_json("n")).when(F.col("run_id") % 3 == 1, F.to_json(F.struct(F.col("n").alias("top_features")))).otherwise(keyed)
    return label_config.top_features(names.select("run_id", text.alias("value")), keep=["run_id"])


@query("SELECT 'log_' || run_id AS run_id, sensor, round(t, 6) AS t, round(v, 6) AS v FROM sensors", "sensors")
def written_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs written sensor by sensor, a folder per run, then found below the root and read again."""
    from loam.shared import shared_path

    root = shared_path(spark, "written-runs")
    rows = V.sensors(spark, d).select(F.concat(F.lit("log_"), F.col("run_id").cast("string")).alias("run_id"), "sensor", F.round("t", 6).alias("t"), F.round("v", 6).alias("v"))
    for s in ("acc", "gyro", "odo"):
        S.write_runs(rows.where(F.col("sensor") == s), f"{root}/{s}", "csv")
    return S.read_runs(spark, root, "sensor string, t double, v double")
