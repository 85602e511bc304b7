"""

Every view reads its table whole. Times are seconds since 1970 whatever the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1000000D"
#: Seconds: a gap between events that parts segments, a bin of the epochs view, a step of the common grid.
GAP, EPOCH_S, GRID_S = 90_000.0, 432_000.0, 21_600.0
CLASSES = ("c0", "c1", "c2")
#: Rows of a chunk in the queries of long runs: few, as the test tables' runs are short.
CHUNK = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, t, x, k, label, event_id: a run per user, a sample per event."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.expr(EPOCH).alias("t"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("k"), F.col("event_type").alias("label"), "event_id")


def signals_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, i, t, ax, ay, az, gx, gy, gz, v1, v2, label: a run per supplier, lines in a total order, 100 a second."""
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    li = table(spark, sf_dir, "lineitem").withColumn("i", (F.row_number().over(order) - 1).cast("bigint"))
    return li.select(
        F.col("l_suppkey").alias("run_id"), "i", (F.col("i") * 0.01).alias("t"), F.col("l_quantity").alias("ax"), (F.col("l_extendedprice") / 1000).alias("ay"), (F.col("l_discount") * 100).alias("az"),
        (F.col("l_tax") * 100).alias("gx"), (F.col("l_quantity") / 10).alias("gy"), ((F.col("l_discount") - F.col("l_tax")) * 50).alias("gz"), (F.col("l_quantity") / 25).alias("v1"), (F.col("l_discount") * 10).alias("v2"), F.col("l_returnflag").alias("label"),
    )


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, sensor (acc, gyro, odo), t, v, event_id: three event types as irregular sensors of unequal rates."""
    ev = signals_ev(spark, sf_dir).where(F.col("label").isin("view", "click", "purchase"))
    return ev.select("run_id", F.when(F.col("label") == "view", "acc").when(F.col("label") == "click", "gyro").otherwise("odo").alias("sensor"), "t", F.col("x").alias("v"), "event_id")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, label, label_ord, range_ord, t0, t1: six hours from each purchase (by k modulo 3), then from each error."""
    ev = signals_ev(spark, sf_dir)
    order = Window.partitionBy("run_id", "label_ord").orderBy("t", "event_id")
    kinds = ev.where(F.col("label").isin("purchase", "error")).withColumn("label_ord", F.when(F.col("label") == "error", 3).otherwise((F.col("k") % 3).cast("int")))
    return kinds.select("run_id", F.when(F.col("label_ord") == 3, "err").otherwise(F.concat(F.lit("p"), F.col("label_ord").cast("string"))).alias("label"), "label_ord", (F.row_number().over(order) - 1).alias("range_ord"), F.col("t").alias("t0"), (F.col("t") + GRID_S).alias("t1"))


def epochs_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signals_ev with lbl, a class that changes every five days, and i, the row's number in its run."""
    order = Window.partitionBy("run_id").orderBy("t", "event_id")
    ev = signals_ev(spark, sf_dir).withColumn("lbl", F.concat(F.lit("c"), (F.floor(F.col("t") / EPOCH_S) % 3).cast("string")))
    return ev.withColumn("i", (F.row_number().over(order) - 1).cast("bigint"))


def _next(column: str):
    return F.concat(F.lit("c"), ((F.substring(column, 2, 1).cast("int") + 1) % 3).cast("string"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epochs_ev for models 0 to 2 with pred: the next class where (k + model) % 10 < 3."""
    ev = epochs_ev(spark, sf_dir).withColumn("model", F.explode(F.array(*map(F.lit, range(3)))))
    return ev.withColumn("pred", F.when((F.col("k") + F.col("model")) % 10 < 3, _next("lbl")).otherwise(F.col("lbl")))


def posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epochs_ev for models 0 to 2 with proba, three class probabilities that follow lbl (or, for k < 30, the next)."""
    ev = epochs_ev(spark, sf_dir).withColumn("model", F.explode(F.array(*map(F.lit, range(3)))))
    target = F.when(F.col("k") < 30, (F.substring("lbl", 2, 1).cast("int") + 1) % 3).otherwise(F.substring("lbl", 2, 1).cast("int"))
    weights = [1 + 8 * (target == c).cast("int") + (F.col("k") * (c + 3) + F.col("model")) % 5 for c in range(3)]
    ev = ev.withColumn("_w", F.array(*weights))
    total = F.col("_w")[0] + F.col("_w")[1] + F.col("_w")[2]
    return ev.withColumn("proba", F.array(*(F.col("_w")[c] / total for c in range(3)))).drop("_w")


def series_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, run_id, label, series (64 doubles): a window per vector."""
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 5).alias("run_id"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("label"), F.col("embedding").cast("array<double>").alias("series"))


#: The same views for DuckDB: names to prepend as WITH clauses.
SQL = {
    "signals_ev": "signals_ev AS (SELECT user_id AS run_id, epoch_us(ts) / 1000000.0 AS t, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type AS label, event_id FROM events)",
    "signals_li": "signals_li AS (SELECT *, i * CAST(0.01 AS DOUBLE) AS t FROM (SELECT l_suppkey AS run_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS i, l_quantity AS ax, l_extendedprice / 1000 AS ay, l_discount * 100 AS az, l_tax * 100 AS gx, l_quantity / 10 AS gy, (l_discount - l_tax) * 50 AS gz, l_quantity / 25 AS v1, l_discount * 10 AS v2, l_returnflag AS label FROM lineitem))",
    "sensors": "sensors AS (SELECT run_id, CASE label WHEN 'view' THEN 'acc' WHEN 'click' THEN 'gyro' ELSE 'odo' END AS sensor, t, x AS v, event_id FROM signals_ev WHERE label IN ('view', 'click', 'purchase'))",
    "intervals": "intervals AS (SELECT run_id, CASE WHEN label_ord = 3 THEN 'err' ELSE 'p' || label_ord END AS label, label_ord, row_number() OVER (PARTITION BY run_id, label_ord ORDER BY t, event_id) - 1 AS range_ord, t AS t0, t + 21600 AS t1 FROM (SELECT *, CASE WHEN label = 'error' THEN 3 ELSE CAST(k % 3 AS INT) END AS label_ord FROM signals_ev WHERE label IN ('purchase', 'error')))",
    "epochs_ev": "epochs_ev AS (SELECT *, 'c' || CAST(CAST(floor(t / 432000) AS BIGINT) % 3 AS VARCHAR) AS lbl, row_number() OVER (PARTITION BY run_id ORDER BY t, event_id) - 1 AS i FROM signals_ev)",
    "preds": "preds AS (SELECT *, CASE WHEN (k + model) % 10 < 3 THEN 'c' || ((CAST(lbl[2] AS INT) + 1) % 3) ELSE lbl END AS pred FROM epochs_ev, (SELECT unnest([0, 1, 2]) AS model))",
    "posteriors": "posteriors AS (SELECT *, w0 / (w0 + w1 + w2) AS p0, w1 / (w0 + w1 + w2) AS p1, w2 / (w0 + w1 + w2) AS p2 FROM (SELECT *, 1 + 8 * CAST(target = 0 AS INT) + (k * 3 + model) % 5 AS w0, 1 + 8 * CAST(target = 1 AS INT) + (k * 4 + model) % 5 AS w1, 1 + 8 * CAST(target = 2 AS INT) + (k * 5 + model) % 5 AS w2 FROM (SELECT *, CASE WHEN k < 30 THEN (CAST(lbl[2] AS INT) + 1) % 3 ELSE CAST(lbl[2] AS INT) END AS target FROM epochs_ev, (SELECT unnest([0, 1, 2]) AS model))))",
    "series_emb": "series_emb AS (SELECT vec_id, vec_id % 5 AS run_id, 'l' || label AS label, CAST(embedding AS DOUBLE[]) AS series FROM embeddings)",
}
_NEEDS = {"sensors": ["signals_ev"], "intervals": ["signals_ev"], "epochs_ev": ["signals_ev"], "preds": ["signals_ev", "epochs_ev"], "posteriors": ["signals_ev", "epochs_ev"]}


def with_views(*names: str) -> str:
    """'WITH ...' of the views and all they need, for DuckDB."""
    order = list(dict.fromkeys(x for n in names for x in [*_NEEDS.get(n, []), n]))
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in order)
