"""Queries of fold evaluation and model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam import views as V
from loam.operators import evaluation as E

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def rounded(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c.split(' AS ')[0]}, {digits}) AS {c.split(' AS ')[-1]}" for c in columns.split("; "))


#: Predictions with a fold (held-out run group), and a class that only fold 3 has.
P = V.with_views("preds") + ", p AS (SELECT model, user_fold AS fold, CASE WHEN user_fold = 3 AND k > 95 THEN 'rare' ELSE lbl END AS label, pred FROM (SELECT *, run_id % 5 AS user_fold FROM preds))"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    fold = F.col("run_id") % 5
    return V.preds(spark, d).select("model", fold.alias("fold"), F.when((fold == 3) & (F.col("k") > 95), "rare").otherwise(F.col("lbl")).alias("label"), "pred")


@query(P + " SELECT model, label, pred, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY model, label), 6) AS share FROM p GROUP BY model, label, pred")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return r(E.confusion(predictions(spark, d)))


CM = P + ", cls AS (SELECT DISTINCT model, fold, label AS class FROM p UNION SELECT DISTINCT model, fold, pred FROM p), cm AS (SELECT c.model, c.fold, c.class, (SELECT count(*) FROM p WHERE p.model = c.model AND p.fold = c.fold AND p.label = c.class) AS support, (SELECT count(*) FROM p WHERE p.model = c.model AND p.fold = c.fold AND p.pred = c.class) AS predicted, (SELECT count(*) FROM p WHERE p.model = c.model AND p.fold = c.fold AND p.label = c.class AND p.pred = c.class) AS tp FROM cls c), ev AS (SELECT *, support > 0 AND sum(support) OVER (PARTITION BY model, class) > support AS ok FROM cm), pc AS (SELECT model, fold, class, support, CASE WHEN ok THEN coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0) END AS precision, CASE WHEN ok THEN coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0) END AS recall, CASE WHEN ok THEN coalesce(2.0 * tp / nullif(predicted + support, 0), 0) END AS f1 FROM ev), fm AS (SELECT model, fold, count(*) AS n_test, avg(CAST(label = pred AS INT)) AS accuracy, (SELECT avg(f1) FROM pc WHERE pc.model = p.model AND pc.fold = p.fold) AS macro_f1 FROM p GROUP BY model, fold)"


def folds(spark: SparkSession, d: str) -> DataFrame:
    return E.fold_metrics(predictions(spark, d))


@query(CM + " SELECT model, fold, n_test, " + rounded("accuracy; macro_f1") + " FROM fm")
def fold_metrics(spark: SparkSession, d: str) -> DataFrame:
    return r(folds(spark, d))


SUM = "avg({m}) AS {m}_mean; stddev_pop({m}) AS {m}_std; quantile_cont({m}, 0.5) AS {m}_median; quantile_cont({m}, 0.75) - quantile_cont({m}, 0.25) AS {m}_iqr; min({m}) AS worst_fold_{m}"


@query(CM + " SELECT model, " + rounded(SUM.format(m="accuracy") + "; " + SUM.format(m="macro_f1") + "; avg(macro_f1) - 0.5 * stddev_pop(macro_f1) AS robustness_score") + ", count(macro_f1) AS evaluable_folds FROM fm GROUP BY model")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return r(E.metric_summary(folds(spark, d), ["model"]))


PCS = "; ".join(f"{f}({m}) AS {m}_{n}" for m in ("precision", "recall", "f1") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + "; " + "; ".join(f"quantile_cont({m}, 0.5) AS {m}_median" for m in ("precision", "recall", "f1"))


@query(CM + " SELECT model, class, " + rounded(PCS) + ", count(f1) AS folds_evaluated, CASE WHEN count(f1) < 5 THEN 'WARN' ELSE 'OK' END AS flag FROM pc GROUP BY model, class")
def per_class_summary(spark: SparkSession, d: str) -> DataFrame:
    return r(E.per_class_summary(E.class_metrics(predictions(spark, d)), 5))


@query(CM + " SELECT model, printf('%.3f +/- %.3f', avg(macro_f1), stddev_pop(macro_f1)) AS macro_f1 FROM fm GROUP BY model")
def fmt_mean_std(spark: SparkSession, d: str) -> DataFrame:
    return folds(spark, d).groupBy("model").agg(E.mean_std_text(F.avg("macro_f1"), F.stddev_pop("macro_f1")).alias("macro_f1"))


#: Five folds: t(0.975, 4).
T4 = "2.7764451051977987"


@query(CM + f" SELECT model, count(*) AS n, {rounded('avg(macro_f1) AS mean; stddev_samp(macro_f1) AS std; min(macro_f1) AS worst; ' + T4 + ' * stddev_samp(macro_f1) / sqrt(5) AS margin')} FROM fm GROUP BY model")
def ci95(spark: SparkSession, d: str) -> DataFrame:
    return r(E.ci95(folds(spark, d), ["model"], "macro_f1"))


@query(V.with_views("epochs_ev") + ", f AS (SELECT run_id % 4 AS run_id, label, x AS speed FROM epochs_ev WHERE NOT (run_id % 4 = 2 AND label = 'error')), q AS (SELECT quantile_cont(speed, 1 / 3) AS e1, quantile_cont(speed, 2 / 3) AS e2 FROM f) SELECT run_id, label, CAST(CASE WHEN speed <= e1 THEN 0 WHEN speed <= e2 THEN 1 ELSE 2 END AS BIGINT) AS speed_bin, count(*) AS n FROM f, q GROUP BY ALL")
def speed_bins(spark: SparkSession, d: str) -> DataFrame:
    return E.speed_bins(_speeds(spark, d), "speed").groupBy("run_id", "label", "speed_bin").agg(F.count(F.lit(1)).alias("n"))


def _speeds(spark: SparkSession, d: str) -> DataFrame:
    run = F.col("run_id") % 4
    return V.epochs_ev(spark, d).where(~((run == 2) & (F.col("label") == "error"))).select(run.alias("run_id"), "label", F.col("x").alias("speed"))


@query(ORACLES["speed_bins"].split(" SELECT run_id, label, CAST")[0] + ", b AS (SELECT run_id, label, CASE WHEN speed <= e1 THEN 0 WHEN speed <= e2 THEN 1 ELSE 2 END AS bin FROM f, q), g AS (SELECT r.run_id, c.label, c.bin, (SELECT count(*) FROM b WHERE b.run_id = r.run_id AND b.label = c.label AND b.bin = c.bin) AS n, (SELECT count(*) FROM b WHERE b.run_id <> r.run_id AND b.label = c.label AND b.bin = c.bin) AS m FROM (SELECT DISTINCT run_id FROM b) r, (SELECT DISTINCT label, bin FROM b) c), s AS (SELECT run_id, label, CAST(sum(m) AS BIGINT) AS train_count, CAST(sum(n) AS BIGINT) AS test_count FROM g GROUP BY ALL) SELECT s.*, round(0.5 * (SELECT sum(abs(CAST(m AS DOUBLE) / nullif(train_count, 0) - CAST(n AS DOUBLE) / nullif(test_count, 0))) FROM g WHERE g.run_id = s.run_id AND g.label = s.label), 6) AS speed_tvd, CASE WHEN train_count < 30 THEN 'CRITICAL' WHEN train_count < 80 THEN 'LOW' ELSE 'OK' END AS count_flag, CASE WHEN 0.5 * (SELECT sum(abs(CAST(m AS DOUBLE) / nullif(train_count, 0) - CAST(n AS DOUBLE) / nullif(test_count, 0))) FROM g WHERE g.run_id = s.run_id AND g.label = s.label) > 0.05 THEN 'WARN' ELSE 'OK' END AS speed_flag FROM s")
def fold_quality_tvd(spark: SparkSession, d: str) -> DataFrame:
    return r(E.fold_quality(E.speed_bins(_speeds(spark, d), "speed"), warn=0.05))


@query(P + ", c AS (SELECT fold, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY label) AS a FROM p GROUP BY fold, label) SELECT label, count(*) FILTER (a > n) AS evaluable_folds, count(*) FILTER (a = n) AS missing_in_train FROM c GROUP BY label")
def fold_missing_classes(spark: SparkSession, d: str) -> DataFrame:
    return E.class_folds(predictions(spark, d), run="fold")


@query(P + ", q AS (SELECT fold, label, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT f.fold, l.label, coalesce(q.n, 0) AS n, sum(coalesce(q.n, 0)) OVER (PARTITION BY l.label) - coalesce(q.n, 0) AS tr FROM (SELECT DISTINCT fold FROM q) f CROSS JOIN (SELECT DISTINCT label FROM q) l LEFT JOIN q ON q.fold = f.fold AND q.label = l.label), h AS (SELECT *, sum(n) OVER (PARTITION BY fold) AS nn, sum(tr) OVER (PARTITION BY fold) AS tt, row_number() OVER (PARTITION BY fold ORDER BY tr DESC, label) = 1 AS top FROM g) SELECT fold, " + rounded("max(n / nn) FILTER (top) AS frequent_accuracy; avg(CASE WHEN top THEN 2 * n / (n + nn) ELSE 0 END) FILTER (n > 0) AS frequent_macro_f1; sum(n / nn * tr / tt) AS stratified_accuracy; avg(coalesce(2 * n * (tr / tt) / nullif(n + nn * (tr / tt), 0), 0)) FILTER (n > 0) AS stratified_macro_f1; 1 / count(*) AS uniform_accuracy") + " FROM h GROUP BY fold")
def dummy_baseline(spark: SparkSession, d: str) -> DataFrame:
    return r(E.chance_baselines(predictions(spark, d), run="fold"))


#: The folds' metrics for three settings of each model: the setting takes 0, 0.01 or 0.02 off by fold.
CFG = CM + ", cfg AS (SELECT model, s AS setting, fold, accuracy, macro_f1 - 0.01 * ((fold + s + model) % 3) AS macro_f1 FROM fm, (SELECT unnest([0, 1, 2]) AS s))"


def settings(spark: SparkSession, d: str) -> DataFrame:
    s = folds(spark, d).withColumn("setting", F.explode(F.array(*map(F.lit, range(3)))))
    return s.withColumn("macro_f1", F.col("macro_f1") - 0.01 * ((F.col("fold") + F.col("setting") + F.col("model")) % 3))


@query(CFG + ", b AS (SELECT model, CAST(setting AS BIGINT) AS setting, round(avg(macro_f1), 6) AS mean FROM cfg GROUP BY ALL) SELECT model, setting, mean FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mean DESC, setting) AS rn FROM b) WHERE rn = 1")
def best_config_per_model(spark: SparkSession, d: str) -> DataFrame:
    mean = settings(spark, d).groupBy("model", F.col("setting").cast("bigint").alias("setting")).agg(F.round(F.avg("macro_f1"), 6).alias("mean"))
    return E.best_per_group(mean, ["model"], "mean", ["setting"])


@query(CFG + f", b AS (SELECT model, CAST(setting AS BIGINT) AS setting, count(*) AS n, {rounded('avg(macro_f1) AS mean; stddev_samp(macro_f1) AS std; min(macro_f1) AS worst; ' + T4 + ' * stddev_samp(macro_f1) / sqrt(5) AS margin', 5)} FROM cfg GROUP BY ALL) SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mean DESC, setting) AS rn FROM b) WHERE rn = 1")
def master_table(spark: SparkSession, d: str) -> DataFrame:
    per = settings(spark, d).withColumn("setting", F.col("setting").cast("bigint"))
    return E.best_per_group(r(E.ci95(per, ["model", "setting"], "macro_f1"), 5), ["model"], "mean", ["setting"])


@query(CFG + ", b AS (SELECT model, CAST(setting AS BIGINT) AS setting, round(avg(macro_f1) - 0.5 * stddev_pop(macro_f1), 5) AS robustness_score, round(avg(macro_f1), 5) AS macro_f1_mean, round(min(macro_f1), 5) AS worst_fold_macro_f1 FROM cfg GROUP BY ALL) SELECT * FROM b ORDER BY coalesce(worst_fold_macro_f1 >= 0.6, false) DESC, robustness_score DESC, macro_f1_mean DESC, model, setting LIMIT 1")
def robust_select(spark: SparkSession, d: str) -> DataFrame:
    summary = r(E.metric_summary(settings(spark, d).withColumn("setting", F.col("setting").cast("bigint")), ["model", "setting"]), 5)
    return E.robust_choice(summary, ties=("model", "setting")).select("model", "setting", "robustness_score", "macro_f1_mean", "worst_fold_macro_f1")


@query(CFG + " SELECT t.model, t.fold, round(t.macro_f1, 6) AS macro_f1, round(b.macro_f1, 6) AS base_macro_f1, round(t.macro_f1 - b.macro_f1, 6) AS delta_macro_f1 FROM (SELECT * FROM cfg WHERE setting = 1) t LEFT JOIN (SELECT * FROM cfg WHERE setting = 0 AND model < 2) b USING (model, fold)")
def metric_delta_join(spark: SparkSession, d: str) -> DataFrame:
    s = settings(spark, d)
    out = E.metric_deltas(s.where("setting = 1"), s.where("setting = 0 and model < 2"), ["model", "fold"], ["macro_f1"])
    return r(out.select("model", "fold", "macro_f1", "base_macro_f1", "delta_macro_f1"))


@query(CFG + ", m AS (SELECT model, setting, avg(macro_f1) AS v FROM cfg GROUP BY ALL) SELECT model, " + rounded("a; b; c; b - a AS b_less_a; c - a AS c_less_a") + " FROM (SELECT model, v AS a FROM m WHERE setting = 0 AND model <> 0) FULL JOIN (SELECT model, v AS b FROM m WHERE setting = 1 AND model <> 1) USING (model) FULL JOIN (SELECT model, v AS c FROM m WHERE setting = 2) USING (model)")
def outer_compare(spark: SparkSession, d: str) -> DataFrame:
    m = settings(spark, d).groupBy("model", "setting").agg(F.avg("macro_f1").alias("v"))
    a, b, c = m.where("setting = 0 and model <> 0"), m.where("setting = 1 and model <> 1"), m.where("setting = 2")
    return r(E.compare_three(a, b, c, "model", "v"))


@query(CM + ", s AS (SELECT model, class, avg(f1) AS f1 FROM pc GROUP BY ALL), a AS (SELECT class AS class_a, f1 AS a FROM s WHERE model = 0), b AS (SELECT 'z' || class AS class_b, f1 AS b FROM s WHERE model = 1 AND class <> 'c1') SELECT class_a, class_b, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta FROM a FULL JOIN b ON class_b = 'z' || class_a AND class_a IN ('c0', 'c1')")
def class_map_compare(spark: SparkSession, d: str) -> DataFrame:
    s = E.class_metrics(predictions(spark, d)).groupBy("model", "class").agg(F.avg("f1").alias("f1"))
    b = s.where("model = 1 and class <> 'c1'").withColumn("class", F.concat(F.lit("z"), "class"))
    pairs = spark.createDataFrame([("c0", "zc0"), ("c1", "zc1")], "class_a string, class_b string")
    return r(E.compare_classes(s.where("model = 0"), b, pairs, "f1"))


@query(CM + " SELECT model, round(avg(macro_f1) FILTER (fold IN (0, 1)), 6) AS d1, round(avg(macro_f1) FILTER (fold IN (2, 4)), 6) AS d2 FROM fm GROUP BY model")
def cross_day_pivot(spark: SparkSession, d: str) -> DataFrame:
    days = spark.createDataFrame([(0, "d1"), (1, "d1"), (2, "d2"), (4, "d2")], "fold bigint, day string")
    return r(E.day_pivot(folds(spark, d), days, ("d1", "d2")))


#: Five folds: the exact p-value is twice the share of the 32 sign patterns with as small a sum of ranks.
@query(CFG + ", f AS (SELECT model * 3 + setting AS m, fold, round(macro_f1, 12) + 0.0001 * fold * (model * 3 + setting) AS v FROM cfg), dd AS (SELECT x.m AS a, y.m AS b, x.v - y.v AS d FROM f x JOIN f y USING (fold) WHERE x.m < y.m), rk AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) AS rk FROM dd), w AS (SELECT a, b, avg(d) AS mean_difference, least(sum(rk) FILTER (d > 0), 15 - coalesce(sum(rk) FILTER (d > 0), 0)) AS w0, coalesce(least(sum(rk) FILTER (d > 0), 15 - sum(rk) FILTER (d > 0)), 0) AS w FROM rk GROUP BY ALL) SELECT a, b, CAST(5 AS BIGINT) AS n, round(mean_difference, 6) AS mean_difference, round(least(1, 2 * [1, 2, 3, 5, 7, 10, 13, 16][CAST(w AS INT) + 1] / 32.0), 6) AS p FROM w")
def wilcoxon_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = (F.col("model") * 3 + F.col("setting")).alias("model")
    f = settings(spark, d).withColumn("_m", m).select(F.col("_m").alias("model"), "fold", (F.round("macro_f1", 12) + 0.0001 * F.col("fold") * F.col("_m")).alias("v"))
    return r(E.wilcoxon_pairs(f, "v"))


#: Train figures of a fold by subtraction from the whole.
@query(P.replace("pred FROM (SELECT", "pred, x FROM (SELECT") + ", q AS (SELECT fold, count(*) AS n, sum(x) AS s FROM p WHERE model = 0 GROUP BY fold) SELECT fold, CAST((SELECT sum(n) FROM q) - n AS BIGINT) AS n_train, n AS n_test FROM q")
def loro_fold_sizes(spark: SparkSession, d: str) -> DataFrame:
    from loam.plans.crossval import fold_sizes

    return fold_sizes(predictions(spark, d).where("model = 0"), "fold")


@query(V.with_views("epochs_ev") + ", e AS (SELECT run_id % 5 AS fold, event_id, x, k FROM epochs_ev) SELECT e.event_id, round((x - (SELECT avg(x) FROM e o WHERE o.fold <> e.fold)) / (SELECT stddev_pop(x) FROM e o WHERE o.fold <> e.fold), 6) AS x FROM e".replace("SELECT e.event_id, round((x - (SELECT avg(x) FROM e o WHERE o.fold <> e.fold)) / (SELECT stddev_pop(x) FROM e o WHERE o.fold <> e.fold), 6) AS x FROM e", "SELECT e.event_id, round((x - m) / s, 6) AS x FROM e JOIN (SELECT f.fold, avg(o.x) AS m, stddev_pop(o.x) AS s FROM (SELECT DISTINCT fold FROM e) f JOIN e o ON o.fold <> f.fold GROUP BY f.fold) USING (fold)"))
def loro_standardise(spark: SparkSession, d: str) -> DataFrame:
    from loam.plans.crossval import standardise

    e = V.epochs_ev(spark, d).select((F.col("run_id") % 5).alias("fold"), "event_id", "x")
    return r(standardise(e, ["x"], "fold").select("event_id", "x"))


@query(P + ", q AS (SELECT fold, label, count(*) AS n FROM p WHERE model = 0 GROUP BY ALL), g AS (SELECT f.fold, l.label, (SELECT coalesce(sum(n), 0) FROM q WHERE q.fold <> f.fold AND q.label = l.label) AS tr FROM (SELECT DISTINCT fold FROM q) f, (SELECT DISTINCT label FROM q) l) SELECT fold, label, round(CAST(sum(tr) OVER (PARTITION BY fold) AS DOUBLE) / (count(*) OVER (PARTITION BY fold) * tr), 6) AS weight FROM g WHERE tr > 0")
def balanced_weights(spark: SparkSession, d: str) -> DataFrame:
    from loam.plans.crossval import balanced_weights as weights

    return r(weights(predictions(spark, d).where("model = 0"), "fold"))
