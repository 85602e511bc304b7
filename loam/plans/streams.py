"""Queries of the streaming jobs: each runs over the events as a batch of the same DataFrame code, and the stateful
ones as streams over the table's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam import views as V
from loam.plans import detection
from loam.streaming import jobs as J

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str, stream: bool = False) -> DataFrame:
    """run_id, ts, t, x, k, event_id, of a batch or of the table's files as a stream."""
    path = f"{d}/events.parquet"
    table = spark.read.parquet(path)
    # a file source watches folders: this one the table's file, by name
    rows = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(d) if stream else table
    ts = F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))")
    return rows.select(F.col("user_id").alias("run_id"), ts.alias("ts"), F.expr(V.EPOCH).alias("t"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("k"), "event_id")


def _secs(column: str):
    return F.round(F.unix_micros(column) / 1_000_000, 6).alias(column)


@query("SELECT run_id, round(min(t), 6) AS start, round(max(t), 6) AS \"end\", count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY run_id ORDER BY t) AS s FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY run_id ORDER BY t) > 90000 THEN 1 ELSE 0 END AS c FROM signals_ev)) GROUP BY run_id, s")
def session_segments(spark: SparkSession, d: str) -> DataFrame:
    return J.session_segments(events(spark, d), "90000 seconds").select("run_id", _secs("start"), _secs("end"), "n")


@query("SELECT run_id, CAST(w AS DOUBLE) AS start, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT *, unnest([floor(t / 43200) * 43200, floor(t / 43200) * 43200 - 43200]) AS w FROM signals_ev) GROUP BY run_id, w")
def stream_sliding_stats(spark: SparkSession, d: str) -> DataFrame:
    return J.sliding_stats(events(spark, d), "x", "1 day", "12 hours").select("run_id", _secs("start"), "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT run_id, round(t, 6) AS t FROM (SELECT DISTINCT run_id, floor(t / 3600) * 3600 AS t FROM signals_ev)")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("ts", F.date_trunc("hour", "ts"))
    return J.stream_dedup(rows).select("run_id", F.round(F.unix_micros("ts") / 1_000_000, 6).alias("t"))


@query("SELECT run_id, event_id, name AS label FROM (SELECT s.run_id, event_id, v.label AS name, row_number() OVER (PARTITION BY s.run_id, event_id ORDER BY label_ord, range_ord) AS rn FROM signals_ev s LEFT JOIN intervals v ON v.run_id = s.run_id AND v.t0 <= s.t AND s.t <= v.t1) WHERE rn = 1")
def stream_label(spark: SparkSession, d: str) -> DataFrame:
    return J.stream_label(events(spark, d), V.intervals(spark, d)).select("run_id", "event_id", "label")


@query("SELECT run_id, CAST(floor(t / 86400) * 86400 AS DOUBLE) AS start, count(*) AS n, round(max(t) - min(t), 6) AS span_s, round(CASE WHEN count(*) > 1 THEN (max(t) - min(t)) / (count(*) - 1) END, 6) AS mean_dt FROM signals_ev GROUP BY run_id, floor(t / 86400)")
def stream_qc(spark: SparkSession, d: str) -> DataFrame:
    return J.stream_qc(events(spark, d), "1 day").select("run_id", _secs("start"), "n", F.round("span_s", 6).alias("span_s"), F.round("mean_dt", 6).alias("mean_dt"))


@query("SELECT run_id, CAST(floor(t / 86400) * 86400 AS DOUBLE) AS start, count(*) AS n, round(quantile_cont(dt, 0.5), 6) AS median_dt, round(max(dt), 6) AS max_dt FROM (SELECT run_id, t, t - lag(t) OVER (PARTITION BY run_id, floor(t / 86400) ORDER BY t) AS dt FROM signals_ev) GROUP BY run_id, floor(t / 86400)")
def stream_qc_steps(spark: SparkSession, d: str) -> DataFrame:
    return J.stream_qc(events(spark, d), "1 day").select("run_id", _secs("start"), "n", F.round("median_dt", 6).alias("median_dt"), F.round("max_dt", 6).alias("max_dt"))


for _n in ("session_segments", "stream_sliding_stats", "stream_dedup", "stream_qc", "stream_qc_steps"):
    ORACLES[_n] = V.with_views("signals_ev") + " " + ORACLES[_n]
ORACLES["stream_label"] = V.with_views("signals_ev", "intervals") + " " + ORACLES["stream_label"]


def _classes(rows: DataFrame) -> DataFrame:
    """model 0 with lbl, pred and proba as in the views, from columns of the row alone."""
    c = (F.floor(F.col("t") / V.EPOCH_S) % 3).cast("int")
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    target = F.when(F.col("k") < 30, (c + 1) % 3).otherwise(c)
    w = [1 + 8 * (target == i).cast("int") + (F.col("k") * (i + 3)) % 5 for i in range(3)]
    return rows.withColumn("lbl", name(c)).withColumn("pred", F.when(F.col("k") % 10 < 3, name((c + 1) % 3)).otherwise(F.col("lbl"))).withColumn("_w", F.array(*w)).withColumn("proba", F.transform("_w", lambda x: x / (F.col("_w")[0] + F.col("_w")[1] + F.col("_w")[2]))).drop("_w")


@query()
def stream_cusum(spark: SparkSession, d: str) -> DataFrame:
    """Alarms of a stream over the events' files; the tests hold them against the batch detector's."""
    found = J.stream_cusum(_classes(events(spark, d, stream=True)), V.CLASSES, 3.0, keys=("run_id",), label="lbl", tie="event_id")
    return J.drain(found, "stream-cusum").select("run_id", "k_a", _secs("alarm_time"), "c_hat", "k0_hat", F.round("g_max", 6).alias("g_max"))


@query()
def stream_stable(spark: SparkSession, d: str) -> DataFrame:
    found = J.stream_stable(_classes(events(spark, d, stream=True)), 3, keys=("run_id",), tie="event_id")
    return J.drain(found, "stream-stable").select("run_id", "label", _secs("start"), _secs("confirmed"))


ORACLES["stream_stable"] = V.with_views("preds") + ", g AS (SELECT *, i - row_number() OVER (PARTITION BY run_id, pred ORDER BY i) AS g FROM preds WHERE model = 0), h AS (SELECT *, row_number() OVER (PARTITION BY run_id, pred, g ORDER BY i) AS j, min(t) OVER (PARTITION BY run_id, pred, g) AS st FROM g) SELECT run_id, pred AS label, round(st, 6) AS start, round(t, 6) AS confirmed FROM h WHERE j = 3"
ORACLES["stream_cusum"] = detection.ORACLES["cusum_alarms"].rpartition(" SELECT model, run_id, h")[0] + " SELECT run_id, k_a, round(alarm_time, 6) AS alarm_time, c_hat, k0_hat, round(g_max, 6) AS g_max FROM alarm WHERE h = 3 AND model = 0"
