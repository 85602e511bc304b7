"""Evaluation over folds of held-out runs: confusion, metrics, summaries, comparisons, rankings."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.quantiles import exact_quantiles


def speed_bins(table: DataFrame, speed: str) -> DataFrame:
    """Adds speed_bin 0, 1 or 2 by tertile edges, right ends and the very least included; where tertiles collapse, by
    three bins of equal width. One row of edges is broadcast."""
    edges = exact_quantiles(table, speed, [0, 1 / 3, 2 / 3, 1]).select(F.col("q").alias("_e"))
    e = lambda i: F.col("_e")[i]
    width = (e(3) - e(0)) / 3
    flat = (e(0) >= e(1)) | (e(1) >= e(2)) | (e(2) >= e(3))
    one, two = F.when(flat, e(0) + width).otherwise(e(1)), F.when(flat, e(0) + 2 * width).otherwise(e(2))
    place = F.when(F.col(speed) <= one, 0).when(F.col(speed) <= two, 1).otherwise(2)
    return table.join(F.broadcast(edges), F.lit(True), "left").withColumn("speed_bin", F.when(F.col(speed).isNotNull(), place).cast("bigint")).drop("_e")


def fold_quality(binned: DataFrame, *, run: str = "run_id", label: str = "label", warn: float = 0.35) -> DataFrame:
    """Per held-out run and class: train and test counts, a flag (CRITICAL below 30, LOW below 80 training rows), and
    the total-variation distance between the speed bins of both. Training rows are all less the run's: nothing is copied.
    The grid has a row per run, class and speed bin: it grows with the runs' number, never with rows."""
    cell = binned.groupBy(run, label, "speed_bin").agg(F.count(F.lit(1)).alias("n"))
    runs, cells = binned.select(run).distinct(), binned.select(label, "speed_bin").distinct()
    grid = runs.join(cells).join(cell, [run, label, "speed_bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of_bin = F.sum("n").over(Window.partitionBy(label, "speed_bin"))
    grid = grid.withColumn("_train", of_bin - F.col("n"))
    per = Window.partitionBy(run, label)
    grid = grid.withColumn("_nt", F.sum("_train").over(per)).withColumn("_ns", F.sum("n").over(per))
    gap = F.abs(F.try_divide(F.col("_train"), F.col("_nt")) - F.try_divide(F.col("n"), F.col("_ns")))
    out = grid.groupBy(run, label).agg(F.sum("_train").alias("train_count"), F.sum("n").alias("test_count"), (0.5 * F.sum(gap)).alias("speed_tvd"))
    return out.withColumn("count_flag", F.when(F.col("train_count") < 30, "CRITICAL").when(F.col("train_count") < 80, "LOW").otherwise("OK")).withColumn("speed_flag", F.when(F.col("speed_tvd") > warn, "WARN").otherwise("OK"))


def class_folds(rows: DataFrame, *, run: str = "run_id", label: str = "label") -> DataFrame:
    """label, evaluable_folds, missing_in_train: of the runs with the class, how many leave it in the training rows."""
    per = rows.groupBy(run, label).agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.sum("n").over(Window.partitionBy(label)))
    return per.groupBy(label).agg(F.count_if(F.col("_all") > F.col("n")).alias("evaluable_folds"), F.count_if(F.col("_all") == F.col("n")).alias("missing_in_train"))


def confusion(rows: DataFrame, *, keys: Sequence[str] = ("model",), label: str = "label", pred: str = "pred") -> DataFrame:
    """keys, label, pred, n, share (of the label's rows)."""
    cell = rows.groupBy(*keys, label, pred).agg(F.count(F.lit(1)).alias("n"))
    return cell.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, label)))


def class_metrics(rows: DataFrame, *, keys: Sequence[str] = ("model",), fold: str = "fold", label: str = "label", pred: str = "pred", classes: str = "evaluable", count: str | None = None) -> DataFrame:
    """keys, fold, class, support, precision, recall, f1; figures are null for a class that doesn't count.

    classes: 'evaluable' (in the fold and in the other folds) or 'in_test' (in the fold). A class that is never
    predicted has precision 0. count: a column that says how many rows a row stands for."""
    cell = rows.groupBy(*keys, fold, label, pred).agg((F.sum(count) if count else F.count(F.lit(1))).alias("n"))
    true = cell.groupBy(*keys, fold, F.col(label).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"))
    said = cell.groupBy(*keys, fold, F.col(pred).alias("class")).agg(F.sum("n").alias("predicted"))
    out = true.join(said, [*keys, fold, "class"], "full").fillna(0, ["support", "tp", "predicted"])
    counts = F.col("support") > 0
    if classes == "evaluable":
        counts &= F.sum("support").over(Window.partitionBy(*keys, "class")) > F.col("support")
    elif classes != "in_test":
        raise ValueError(f"unknown classes: {classes}")
    ratio = lambda a, b: F.when(counts, F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    tp = F.col("tp")
    return out.select(*keys, fold, "class", "support", ratio(tp, F.col("predicted")).alias("precision"), ratio(tp, F.col("support")).alias("recall"), ratio(2 * tp, F.col("predicted") + F.col("support")).alias("f1"))


def fold_metrics(rows: DataFrame, *, keys: Sequence[str] = ("model",), fold: str = "fold", label: str = "label", pred: str = "pred", classes: str = "evaluable", count: str | None = None) -> DataFrame:
    """keys, fold, n_test, accuracy, macro_f1 (over the classes that count; null without any). count: a column that says
    how many rows a row stands for."""
    macro = class_metrics(rows, keys=keys, fold=fold, label=label, pred=pred, classes=classes, count=count).groupBy(*keys, fold).agg(F.avg("f1").alias("macro_f1"))
    right = F.col(label) == F.col(pred)
    if count:
        hits = rows.groupBy(*keys, fold).agg(F.sum(count).alias("n_test"), F.try_divide(F.sum(right.cast("double") * F.col(count)), F.sum(F.when(right.isNotNull(), F.col(count)))).alias("accuracy"))
    else:
        hits = rows.groupBy(*keys, fold).agg(F.count(F.lit(1)).alias("n_test"), F.avg(right.cast("double")).alias("accuracy"))
    return hits.join(macro, [*keys, fold])


def metric_summary(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, population deviation, median, interquartile range and worst fold of both metrics; robustness_score = mean
    less half the deviation of macro_f1; evaluable_folds: those with a macro_f1."""
    columns = []
    for m, worst in (("accuracy", "worst_fold_accuracy"), ("macro_f1", "worst_fold_macro_f1")):
        q = F.percentile(m, F.array(F.lit(0.25), F.lit(0.75)))
        columns += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), F.percentile(m, F.lit(0.5)).alias(f"{m}_median"), (q[1] - q[0]).alias(f"{m}_iqr"), F.min(m).alias(worst)]
    out = folds.groupBy(*keys).agg(*columns, F.count("macro_f1").alias("evaluable_folds"))
    return out.withColumn("robustness_score", F.col("macro_f1_mean") - 0.5 * F.col("macro_f1_std"))


def per_class_summary(metrics: DataFrame, n_folds: int, keys: Sequence[str] = ("model",)) -> DataFrame:
    columns = [f(m).alias(f"{m}_{n}") for m in ("precision", "recall", "f1") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    columns += [F.percentile(m, F.lit(0.5)).alias(f"{m}_median") for m in ("precision", "recall", "f1")]
    out = metrics.groupBy(*keys, "class").agg(*columns, F.count("f1").alias("folds_evaluated"))
    return out.withColumn("flag", F.when(F.col("folds_evaluated") < n_folds, "WARN").otherwise("OK"))


def mean_std_text(mean: Column, std: Column) -> Column:
    return F.format_string("%.3f +/- %.3f", mean, std)


def t_cdf(t: float, df: int) -> float:
    """Student's t distribution, by numerical integration of its density over an angle (t = sqrt(df) tan u)."""
    u = math.atan(abs(t) / math.sqrt(df))
    n = 4000
    x = np.linspace(0, u, n + 1)
    y = np.cos(x) ** (df - 1)
    w = np.ones(n + 1)
    w[1:-1:2], w[2:-1:2] = 4, 2
    area = float((y * w).sum() * u / n / 3)
    norm = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 0.5 + math.copysign(area * norm, t)


def t_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def ci95(folds: DataFrame, keys: Sequence[str], metric: str, most: int = 200) -> DataFrame:
    """keys, n, mean, std (sample), worst, margin = t(0.975, n - 1) std / sqrt(n), null below two folds; beyond `most`
    folds the normal quantile serves. The quantiles' table has `most` rows."""
    table = folds.sparkSession.createDataFrame([(d, t_quantile(0.975, d)) for d in range(1, most + 1)], "_df int, _t double")
    per = folds.groupBy(*keys).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.min(metric).alias("worst"))
    joined = per.join(F.broadcast(table), F.col("n") - 1 == F.col("_df"), "left")
    t = F.coalesce("_t", F.when(F.col("n") - 1 > most, 1.959963984540054))
    return joined.withColumn("margin", F.when(F.col("n") > 1, t * F.col("std") / F.sqrt("n"))).drop("_df", "_t")


def best_per_group(rows: DataFrame, group: Sequence[str], metric: str, ties: Sequence[str] = ()) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col(metric).desc_nulls_last(), *ties)
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def robust_choice(summary: DataFrame, least_worst: float = 0.6, ties: Sequence[str] = ("model",)) -> DataFrame:
    """The configuration of best robustness, then best mean, among those whose worst fold reaches the bound, or among
    all if none does."""
    ok = F.coalesce(F.col("worst_fold_macro_f1") >= least_worst, F.lit(False))
    return summary.orderBy(ok.desc(), F.col("robustness_score").desc_nulls_last(), F.col("macro_f1_mean").desc_nulls_last(), *ties).limit(1)


def metric_deltas(tuned: DataFrame, base: DataFrame, on: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """tuned with the base's metrics as base_<m> and delta_<m>; rows without a base keep nulls."""
    other = base.select(*on, *(F.col(m).alias(f"base_{m}") for m in metrics))
    return tuned.join(other, list(on), "left").select("*", *((F.col(m) - F.col(f"base_{m}")).alias(f"delta_{m}") for m in metrics))


def compare_three(a: DataFrame, b: DataFrame, c: DataFrame, key: str, metric: str) -> DataFrame:
    """Full outer join of three tables: key, a, b, c and differences b - a, c - a."""
    x, y, z = (t.select(key, F.col(metric).alias(n)) for t, n in ((a, "a"), (b, "b"), (c, "c")))
    return x.join(y, key, "full").join(z, key, "full").select(key, "a", "b", "c", (F.col("b") - F.col("a")).alias("b_less_a"), (F.col("c") - F.col("a")).alias("c_less_a"))


def compare_classes(a: DataFrame, b: DataFrame, pairs: DataFrame, metric: str, name: str = "class") -> DataFrame:
    """class_a, class_b, a, b, delta: mapped classes side by side, classes without a partner by themselves."""
    x, y = a.select(F.col(name).alias("class_a"), F.col(metric).alias("a")), b.select(F.col(name).alias("class_b"), F.col(metric).alias("b"))
    both = pairs.join(x, "class_a").join(y, "class_b")
    only_a, only_b = x.join(both.select("class_a"), "class_a", "left_anti"), y.join(both.select("class_b"), "class_b", "left_anti")
    out = both.unionByName(only_a, allowMissingColumns=True).unionByName(only_b, allowMissingColumns=True)
    return out.select("class_a", "class_b", "a", "b", (F.col("b") - F.col("a")).alias("delta"))


def day_pivot(folds: DataFrame, days: DataFrame, names: Sequence[str], *, run: str = "fold", metric: str = "macro_f1", row: str = "model") -> DataFrame:
    """Mean metric per row and day; runs without a day drop out."""
    return folds.join(F.broadcast(days), run).groupBy(row).pivot("day", list(names)).agg(F.avg(metric))


def chance_baselines(rows: DataFrame, *, run: str = "run_id", label: str = "label") -> DataFrame:
    """Per held-out run: accuracy and macro-F1 (over its classes) of the most frequent training class (ties by name)
    and, expected, of guesses in the training classes' proportions. Counts per run and class only."""
    per = rows.groupBy(run, label).agg(F.count(F.lit(1)).alias("n"))
    grid = per.select(run).distinct().join(per.select(label).distinct()).join(per, [run, label], "left").fillna(0, ["n"])
    grid = grid.withColumn("_train", F.sum("n").over(Window.partitionBy(label)) - F.col("n"))
    w = Window.partitionBy(run)
    grid = grid.withColumn("_n", F.sum("n").over(w)).withColumn("_all", F.sum("_train").over(w)).withColumn("_top", F.row_number().over(w.orderBy(F.col("_train").desc(), label)) == 1)
    p = F.col("_train") / F.col("_all")
    hit = F.when(F.col("_top"), 2 * F.col("n") / (F.col("n") + F.col("_n"))).otherwise(0.0)
    guess = F.try_divide(2 * F.col("n") * p, F.col("n") + F.col("_n") * p)
    there = F.col("n") > 0
    return grid.groupBy(run).agg(
        F.max(F.when(F.col("_top"), F.col("n") / F.col("_n"))).alias("frequent_accuracy"), F.avg(F.when(there, hit)).alias("frequent_macro_f1"),
        F.sum(F.col("n") / F.col("_n") * p).alias("stratified_accuracy"), F.avg(F.when(there, F.coalesce(guess, F.lit(0.0)))).alias("stratified_macro_f1"), (1 / F.count(F.lit(1))).alias("uniform_accuracy"),
    )


def wilcoxon_p(d: np.ndarray) -> float:
    """Two-sided signed-rank p-value: exact by the ranks' sums where there are no ties and up to 50 differences, else
    by the normal approximation; zeros are left out, all zeros give 1."""
    d = d[d != 0]
    n = len(d)
    if n == 0:
        return 1.0
    order = np.argsort(np.abs(d), kind="stable")
    ranks = np.empty(n)
    size = np.abs(d)[order]
    ties = 0.0
    i = 0
    while i < n:
        j = i
        while j + 1 < n and size[j + 1] == size[i]:
            j += 1
        ranks[order[i : j + 1]] = (i + j) / 2 + 1
        ties += (j - i + 1) ** 3 - (j - i + 1)
        i = j + 1
    plus = ranks[d > 0].sum()
    least = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and not ties:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(min(1.0, 2 * ways[: int(least) + 1].sum() / 2.0**n))
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return float(min(1.0, math.erfc(abs(least - n * (n + 1) / 4) / math.sqrt(var) / math.sqrt(2))))


def wilcoxon_pairs(folds: DataFrame, metric: str, *, model: str = "model", fold: str = "fold") -> DataFrame:
    """a, b, n, mean_difference (a - b), p for all pairs of models over the folds that both have."""
    x, y = (folds.select(F.col(model).alias(n), F.col(fold).alias("_f"), F.col(metric).alias(f"_{n}")) for n in ("a", "b"))
    pairs = x.join(y, "_f").where(F.col("a") < F.col("b")).withColumn("_d", F.col("_a") - F.col("_b")).dropna(subset=["_d"])
    kind = f"a {folds.schema[model].dataType.simpleString()}, b {folds.schema[model].dataType.simpleString()}, n bigint, mean_difference double, p double"

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        d = frame["_d"].to_numpy()
        return pd.DataFrame([[*key, len(d), float(d.mean()), wilcoxon_p(d)]], columns=["a", "b", "n", "mean_difference", "p"])

    return pairs.groupBy("a", "b").applyInPandas(one, kind)


def master_table(folds: DataFrame, config: Sequence[str], metric: str = "macro_f1", model: str = "model") -> DataFrame:
    """The best configuration of each model with mean, deviation (sample), margin, worst fold and number of folds."""
    return best_per_group(ci95(folds, [model, *config], metric), [model], "mean", config)

