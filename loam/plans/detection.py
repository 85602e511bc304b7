"""Queries of transitions and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam import views as V
from loam.operators import cusum as U
from loam.operators import long_cusum as LC
from loam.operators import long_runs as R
from loam.operators import transitions as T

QUERIES, ORACLES = {}, {}
HS = (1.0, 3.0, 6.0)
KEYS = ("model", "run_id")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


TR = ", tr AS (SELECT *, coalesce(lead(transition_idx) OVER (PARTITION BY {k} ORDER BY transition_idx), n_rows) AS next_idx FROM (SELECT {k}, i AS transition_idx, prev AS from_label, lbl AS to_label, t AS gt_time, n_rows FROM (SELECT *, lag(lbl) OVER (PARTITION BY {k} ORDER BY i) AS prev, count(*) OVER (PARTITION BY {k}) AS n_rows FROM {v}) WHERE lbl <> prev))"


@query(V.with_views("epochs_ev") + TR.format(k="run_id", v="epochs_ev") + " SELECT run_id, transition_idx, from_label, to_label, round(gt_time, 6) AS gt_time, n_rows, next_idx FROM tr")
def gt_transitions(spark: SparkSession, d: str) -> DataFrame:
    return r(T.true_transitions(V.epochs_ev(spark, d), label="lbl"))


PREDS = V.with_views("preds") + TR.format(k="model, run_id", v="preds") + ", hit AS (SELECT tr.model, tr.run_id, transition_idx, p.i, p.t, p.i - row_number() OVER (PARTITION BY tr.model, tr.run_id, transition_idx ORDER BY p.i) AS isl FROM tr JOIN preds p ON p.model = tr.model AND p.run_id = tr.run_id AND p.i >= transition_idx AND p.i < next_idx AND p.pred = to_label), island AS (SELECT model, run_id, transition_idx, min(i) AS i, min(t) AS t, count(*) AS len FROM hit GROUP BY model, run_id, transition_idx, isl)"
OUT = ", det AS (SELECT model, run_id, transition_idx, n_stable, min(i) AS detection_idx, min(t) AS detection_time FROM island, (SELECT unnest({ns}) AS n_stable) WHERE len >= n_stable GROUP BY ALL), o AS (SELECT tr.*, ns.n_stable, CASE WHEN transition_idx + ns.n_stable > n_rows THEN 'boundary' WHEN detection_time IS NULL THEN 'missed' ELSE 'detected' END AS outcome, CASE WHEN transition_idx + ns.n_stable <= n_rows THEN detection_time END AS dt FROM tr CROSS JOIN (SELECT unnest({ns}) AS n_stable) ns LEFT JOIN det USING (model, run_id, transition_idx, n_stable)), oo AS (SELECT *, dt - gt_time AS delay, coalesce(dt - gt_time > 100000, false) AS is_late FROM o)"
SUMMARY = "count(*) AS n_transitions, count(*) FILTER (outcome = 'detected') AS n_detected, count(*) FILTER (outcome = 'missed') AS n_missed, count(*) FILTER (outcome = 'boundary') AS n_boundary, count(*) FILTER (outcome = 'wrong_class') AS n_wrong_class, round(avg(delay) FILTER (outcome = 'detected'), 4) AS mean_delay, round(quantile_cont(delay, 0.5) FILTER (outcome = 'detected'), 4) AS median_delay, round(stddev_samp(delay) FILTER (outcome = 'detected'), 4) AS std_delay, round(max(delay) FILTER (outcome = 'detected'), 4) AS max_delay, count(*) FILTER (is_late) AS n_late, round(CAST(count(*) FILTER (outcome = 'detected') AS DOUBLE) / nullif(count(*) - count(*) FILTER (outcome = 'boundary'), 0), 6) AS detection_rate"


@query(PREDS + " SELECT model, run_id, transition_idx, min(i) AS detection_idx, round(min(t), 6) AS detection_time FROM island WHERE len >= 3 GROUP BY ALL")
def stable_detection(spark: SparkSession, d: str) -> DataFrame:
    islands = T.prediction_islands(V.preds(spark, d), keys=KEYS, label="lbl", pred="pred", position="i", time="t")
    return r(T.stable_detections(islands, 3, KEYS))


@query(ORACLES["gt_transitions"])
def long_transitions(spark: SparkSession, d: str) -> DataFrame:
    """`gt_transitions` by scans of chunks."""
    return r(R.true_transitions(V.epochs_ev(spark, d), label="lbl", chunk_rows=V.CHUNK))


@query(ORACLES["stable_detection"])
def long_stable_detection(spark: SparkSession, d: str) -> DataFrame:
    """`stable_detection` by scans of chunks."""
    islands = R.prediction_islands(V.preds(spark, d), keys=KEYS, label="lbl", pred="pred", position="i", time="t", chunk_rows=V.CHUNK)
    return r(T.stable_detections(islands, 3, KEYS))


def _outcomes(spark: SparkSession, d: str, n: int | DataFrame = 3) -> DataFrame:
    return T.transition_outcomes(V.preds(spark, d), n, 100_000.0, label="lbl")


@query(PREDS + OUT.format(ns="[3]") + " SELECT model, run_id, transition_idx, from_label, to_label, round(gt_time, 6) AS gt_time, round(dt, 6) AS detection_time, round(delay, 6) AS delay, outcome, is_late FROM oo")
def transition_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return r(_outcomes(spark, d))


@query(PREDS + OUT.format(ns="[3]") + " SELECT model, " + SUMMARY + " FROM oo GROUP BY model")
def transition_summary(spark: SparkSession, d: str) -> DataFrame:
    return _r4(T.transition_summary(_outcomes(spark, d)))


def _r4(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("mean_delay", "median_delay", "std_delay", "max_delay")} | {"detection_rate": F.round("detection_rate", 6)})


@query(PREDS + OUT.format(ns="[1, 2, 3, 5, 7]") + " SELECT model, CAST(n_stable AS BIGINT) AS n_stable, " + SUMMARY + " FROM oo GROUP BY model, n_stable")
def nstable_sweep(spark: SparkSession, d: str) -> DataFrame:
    ns = spark.createDataFrame([(n,) for n in (1, 2, 3, 5, 7)], "n_stable bigint")
    return _r4(T.transition_summary(_outcomes(spark, d, ns), ("model", "n_stable")))


@query(PREDS + OUT.format(ns="[3]") + " SELECT from_label || '->' || to_label AS transition, " + ", ".join(f"round(avg(delay) FILTER (model = {m}), 4) AS mean_{m}, count(*) FILTER (model = {m}) AS n_{m}" for m in range(3)) + " FROM oo WHERE outcome = 'detected' GROUP BY 1")
def transition_pair_delay(spark: SparkSession, d: str) -> DataFrame:
    wide = T.pair_delays(_outcomes(spark, d), (0, 1, 2))
    return wide.select("transition", *(F.round(f"{m}_mean", 4).alias(f"mean_{m}") for m in range(3)), *(F.col(f"{m}_n").alias(f"n_{m}") for m in range(3)))


#: The bank as a recursion over rows of (model, run), one per threshold: sums of the two classes besides the active one.
CUSUM = V.with_views("posteriors") + """, lp AS (SELECT model, run_id, i, t, lbl, [ln(p0), ln(p1), ln(p2)] AS l FROM posteriors),
bank AS (SELECT lp.model, lp.run_id, h, CAST(-1 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS t, list_position(['c0', 'c1', 'c2'], lbl) AS c0, [0.0::DOUBLE, 0.0, 0.0] AS g, [0.0::DOUBLE, 0.0, 0.0] AS s, [0.0::DOUBLE, 0.0, 0.0] AS low, [0::BIGINT, 0, 0] AS lowat, false AS alarm, CAST(NULL AS BIGINT) AS c_hat, CAST(NULL AS BIGINT) AS k0_hat, CAST(NULL AS DOUBLE) AS g_max FROM lp, (SELECT unnest([1.0, 3.0, 6.0])::DOUBLE AS h) WHERE lp.i = 0
UNION ALL
SELECT model, run_id, h, i, t, CASE WHEN top > h THEN best ELSE c0 END, CASE WHEN top > h THEN [0.0, 0.0, 0.0] ELSE g2 END, CASE WHEN top > h THEN [0.0, 0.0, 0.0] ELSE s2 END, CASE WHEN top > h THEN [0.0, 0.0, 0.0] ELSE [least(s2[1], low[1]), least(s2[2], low[2]), least(s2[3], low[3])] END, CASE WHEN top > h THEN [i, i, i] ELSE at2 END, top > h, best, at2[best], top FROM (
  SELECT *, list_max(g2) AS top, list_position(g2, list_max(g2)) AS best FROM (
    SELECT b.model, b.run_id, b.h, lp.i, lp.t, b.c0, b.low, [CASE WHEN c0 = 1 THEN 0.0 ELSE greatest(0.0, g[1] + (l[1] - l[c0])) END, CASE WHEN c0 = 2 THEN 0.0 ELSE greatest(0.0, g[2] + (l[2] - l[c0])) END, CASE WHEN c0 = 3 THEN 0.0 ELSE greatest(0.0, g[3] + (l[3] - l[c0])) END] AS g2,
      [s[1] + (l[1] - l[c0]), s[2] + (l[2] - l[c0]), s[3] + (l[3] - l[c0])] AS s2,
      [CASE WHEN s[1] + (l[1] - l[c0]) < low[1] THEN lp.i ELSE lowat[1] END, CASE WHEN s[2] + (l[2] - l[c0]) < low[2] THEN lp.i ELSE lowat[2] END, CASE WHEN s[3] + (l[3] - l[c0]) < low[3] THEN lp.i ELSE lowat[3] END] AS at2
    FROM bank b JOIN lp ON lp.model = b.model AND lp.run_id = b.run_id AND lp.i = b.i + 1))),
alarm AS (SELECT model, run_id, h, i AS k_a, t AS alarm_time, ['c0', 'c1', 'c2'][c_hat] AS c_hat, k0_hat, g_max FROM bank WHERE alarm)"""


@query(CUSUM + " SELECT model, run_id, h, k_a, round(alarm_time, 6) AS alarm_time, c_hat, k0_hat, round(g_max, 6) AS g_max FROM alarm")
def cusum_alarms(spark: SparkSession, d: str) -> DataFrame:
    return r(U.cusum_alarms(V.posteriors(spark, d), V.CLASSES, HS, label="lbl"))


@query(ORACLES["cusum_alarms"])
def long_cusum_alarms(spark: SparkSession, d: str) -> DataFrame:
    """`cusum_alarms` by chunks of runs."""
    return r(LC.cusum_alarms(V.posteriors(spark, d), V.CLASSES, HS, label="lbl", chunk_rows=V.CHUNK))


@query(CUSUM.replace("list_position(['c0', 'c1', 'c2'], lbl) AS c0", "list_position(l, list_max(l)) AS c0") + " SELECT model, run_id, k_a, c_hat, round(g_max, 6) AS g_max FROM (SELECT *, row_number() OVER (PARTITION BY model, run_id ORDER BY k_a) AS rn FROM alarm WHERE h = 3) WHERE rn = 1")
def cusum_first_alarm(spark: SparkSession, d: str) -> DataFrame:
    return r(U.first_alarm(V.posteriors(spark, d), V.CLASSES, 3.0))


#: Without grace a transition's window ends where the next begins: the first alarm in it is its own.
MATCH = CUSUM + TR.format(k="model, run_id", v="posteriors") + ", m AS (SELECT tr.*, a.h, a.k_a, a.alarm_time, a.c_hat, a.g_max, row_number() OVER (PARTITION BY tr.model, tr.run_id, transition_idx, a.h ORDER BY a.k_a) AS rn FROM tr JOIN alarm a ON a.model = tr.model AND a.run_id = tr.run_id AND a.k_a >= transition_idx AND a.k_a < next_idx AND transition_idx + 3 <= n_rows), took AS (SELECT * FROM m WHERE rn = 1), oo AS (SELECT tr.model, tr.run_id, hs.h, transition_idx, tr.from_label, tr.to_label, tr.gt_time, k.alarm_time AS detection_time, k.alarm_time - tr.gt_time AS delay, CASE WHEN transition_idx + 3 > tr.n_rows THEN 'boundary' WHEN k.k_a IS NULL THEN 'missed' WHEN k.c_hat = tr.to_label THEN 'detected' ELSE 'wrong_class' END AS outcome, coalesce(k.alarm_time - tr.gt_time > 100000, false) AS is_late, k.g_max FROM tr CROSS JOIN (SELECT unnest([1.0, 3.0, 6.0])::DOUBLE AS h) hs LEFT JOIN took k USING (model, run_id, transition_idx, h)), fa AS (SELECT model, run_id, h, k_a, alarm_time, c_hat, g_max FROM alarm a WHERE NOT EXISTS (SELECT 1 FROM took k WHERE k.model = a.model AND k.run_id = a.run_id AND k.h = a.h AND k.k_a = a.k_a))"


def _matched(spark: SparkSession, d: str, grace: int = 0) -> tuple[DataFrame, DataFrame]:
    return U.cusum_outcomes(V.posteriors(spark, d), V.CLASSES, HS, label="lbl", grace=grace, late_after=100_000.0)


@query(MATCH + " SELECT model, run_id, h, transition_idx, from_label, to_label, round(gt_time, 6) AS gt_time, round(detection_time, 6) AS detection_time, round(delay, 6) AS delay, outcome, is_late, round(g_max, 6) AS g_max FROM oo")
def cusum_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return r(_matched(spark, d)[0])


@query(MATCH + " SELECT model, run_id, h, k_a, round(alarm_time, 6) AS alarm_time, c_hat, round(g_max, 6) AS g_max FROM fa")
def false_alarms(spark: SparkSession, d: str) -> DataFrame:
    return r(_matched(spark, d)[1])


def match_alarms(spark: SparkSession, d: str) -> DataFrame:
    """With a grace of one row, where a transition may take the alarm just before it."""
    return r(_matched(spark, d, grace=1)[0]).withColumn("delay", F.round("delay", 4))


QUERIES["match_alarms"] = match_alarms


@query(MATCH + ", ex AS (SELECT model, sum(s) / 60 AS minutes FROM (SELECT model, run_id, max(t) - min(t) AS s FROM posteriors GROUP BY ALL) GROUP BY model) SELECT model, round(minutes, 4) AS minutes, n AS n_false_alarms, round(n / minutes, 9) AS per_minute FROM ex JOIN (SELECT model, count(*) AS n FROM fa WHERE h = 3 GROUP BY model) USING (model)")
def false_alarm_rate(spark: SparkSession, d: str) -> DataFrame:
    out = T.false_alarm_rate(_matched(spark, d)[1].where("h = 3"), V.posteriors(spark, d))
    return out.select("model", F.round("minutes", 4).alias("minutes"), "n_false_alarms", F.round("per_minute", 9).alias("per_minute"))


@query(MATCH + ", ex AS (SELECT model, sum(s) / 60 AS minutes FROM (SELECT model, run_id, max(t) - min(t) AS s FROM posteriors GROUP BY ALL) GROUP BY model) SELECT s.*, coalesce(f.n, 0) AS n_false_alarms, round(coalesce(f.n, 0) / minutes, 9) AS false_alarms_per_minute FROM (SELECT model, h, " + SUMMARY + " FROM oo GROUP BY model, h) s LEFT JOIN (SELECT model, h, count(*) AS n FROM fa GROUP BY ALL) f USING (model, h) JOIN ex USING (model)")
def operating_curve(spark: SparkSession, d: str) -> DataFrame:
    curve = U.operating_curve(V.posteriors(spark, d), V.CLASSES, HS, label="lbl", grace=0, late_after=100_000.0)
    return _r4(curve).withColumn("false_alarms_per_minute", F.round("false_alarms_per_minute", 9))


STRETCH = CUSUM.replace("WITH RECURSIVE ", "WITH RECURSIVE ").replace(", lp AS (SELECT model, run_id, i, t, lbl, [ln(p0), ln(p1), ln(p2)] AS l FROM posteriors)", ", st0 AS (SELECT *, CASE WHEN lbl IS DISTINCT FROM lag(lbl) OVER (PARTITION BY model, run_id ORDER BY i) THEN 1 ELSE 0 END AS new FROM posteriors), st AS (SELECT *, sum(new) OVER (PARTITION BY model, run_id ORDER BY i) AS stretch FROM st0), st2 AS (SELECT *, count(*) OVER (PARTITION BY model, run_id, stretch) AS n, row_number() OVER (PARTITION BY model, run_id, stretch ORDER BY i) - 1 AS j FROM st), lp AS (SELECT model, run_id * 1000000 + CAST(stretch AS BIGINT) AS run_id, j AS i, t, lbl, [ln(p0), ln(p1), ln(p2)] AS l FROM st2 WHERE n >= 5)").replace("[1.0, 3.0, 6.0]", "[1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]")


@query(STRETCH + ", c AS (SELECT model, h, seconds, coalesce(n, 0) AS n FROM (SELECT model, count(*) AS seconds FROM lp GROUP BY model) CROSS JOIN (SELECT unnest([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0])::DOUBLE AS h) LEFT JOIN (SELECT model, h, count(*) AS n FROM alarm GROUP BY ALL) USING (model, h)) SELECT model, coalesce(min(h) FILTER (n = 0 OR seconds / n >= 5), max(h)) AS h FROM c GROUP BY model")
def calibrate_threshold(spark: SparkSession, d: str) -> DataFrame:
    return U.calibrate_threshold(V.posteriors(spark, d), V.CLASSES, 5.0, [float(h) for h in range(1, 9)], label="lbl")[0]


@query(V.with_views("posteriors") + " SELECT model, run_id, i, [round(p1, 6), round(p0, 6), 0.0::DOUBLE, round(p2, 6)] AS proba, CASE WHEN p1 >= p0 AND p1 >= p2 THEN 'c1' WHEN p0 >= p2 THEN 'c0' ELSE 'c2' END AS pred FROM posteriors")
def align_posteriors(spark: SparkSession, d: str) -> DataFrame:
    out = U.align_posteriors(V.posteriors(spark, d), V.CLASSES, ("c1", "c0", "cx", "c2"))
    return out.select("model", "run_id", "i", F.transform("proba", lambda x: F.round(x, 6)).alias("proba"), "pred")
