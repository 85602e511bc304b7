"""Choosing features: diagnostics, stability, mutual information, correlation pruning, samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.qc import histogram
from loam.operators.quantiles import exact_quantiles


def melt(table: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """keys, feature, value; NaN becomes null."""
    pairs = F.create_map(*(y for c in features for y in (F.lit(c), F.nullif(F.col(c).cast("double"), F.lit(float("nan"))))))
    return table.select(*keys, F.explode(pairs).alias("feature", "value"))


def feature_diagnostics(table: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Per label: n, the mean of each feature without NaN, and how many are missing."""
    clean = table.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in features})
    return clean.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in features), *(F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in features))


def run_shift(table: DataFrame, features: Sequence[str], *, run: str = "run_id", label: str = "label") -> DataFrame:
    """label, feature, mean, std (population) and cv = std / (|mean| + 1e-9) of the runs' means."""
    means = melt(table, [label, run], features).groupBy(label, run, "feature").agg(F.avg("value").alias("v"))
    out = means.groupBy(label, "feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return out.withColumn("cv", F.col("std") / (F.abs("mean") + 1e-9))


def class_histogram(table: DataFrame, feature: str, *, label: str = "label", bins: int = 25) -> DataFrame:
    return histogram(table.select(label, feature), feature, bins, [label])


def _psi(n: np.ndarray) -> np.ndarray:
    """The digamma function of whole numbers above 0."""
    n = np.asarray(n, dtype=np.int64)
    harmonic = np.r_[0.0, np.cumsum(1 / np.arange(1, max(int(n.max(initial=1)), 1) + 1))]
    return harmonic[n - 1] - np.euler_gamma


def knn_information(x: np.ndarray, y: np.ndarray, k: int = 5) -> float:
    """Mutual information (nats) of a number and a class by nearest neighbours (Ross 2014); classes of one are left out."""
    order = np.argsort(x, kind="stable")
    x, (_, y) = x[order], np.unique(y[order], return_inverse=True)
    sizes = np.bincount(y)
    keep = sizes[y] > 1
    x, y = x[keep], y[keep]
    if not len(x):
        return 0.0
    psi_k, psi_n, radius = np.empty(len(x)), np.empty(len(x)), np.empty(len(x))
    for c in np.unique(y):
        at = np.flatnonzero(y == c)
        v, m = x[at], len(at)
        near = min(k, m - 1)
        padded = np.r_[np.full(near, -np.inf), v, np.full(near, np.inf)]
        reach = np.min([np.maximum(v - padded[near - j : near - j + m], padded[2 * near - j : 2 * near - j + m] - v) for j in range(near + 1)], axis=0)
        radius[at], psi_k[at], psi_n[at] = np.nextafter(reach, 0), _psi(np.array([near]))[0], _psi(np.array([m]))[0]
    # ends of the neighbourhood by distance itself: x + radius rounds, and could take in the k-th neighbour
    n = len(x)
    right, left = np.searchsorted(x, x + radius, side="right"), np.searchsorted(x, x - radius, side="left")
    while (far := (right > 0) & (x[right - 1] - x > radius)).any():
        right[far] -= 1
    while (near := (right < n) & (x[np.minimum(right, n - 1)] - x <= radius)).any():
        right[near] += 1
    while (far := (left < n) & (x - x[np.minimum(left, n - 1)] > radius)).any():
        left[far] += 1
    while (near := (left > 0) & (x - x[left - 1] <= radius)).any():
        left[near] -= 1
    m = right - left
    return max(0.0, float(_psi(np.array([len(x)]))[0] + psi_k.mean() - psi_n.mean() - _psi(m).mean()))


def mi_binned(table: DataFrame, features: Sequence[str], *, label: str = "label", bins: int = 10) -> DataFrame:
    """feature, mi (nats) of quantile bins (edges by interpolation, a value belongs above the edges below it): counts only."""
    long = melt(table, [label], features).dropna(subset=["value"])
    edges = exact_quantiles(long, "value", [i / bins for i in range(1, bins)], ["feature"]).select("feature", F.col("q").alias("_edges"))
    cell = long.join(edges, "feature").groupBy("feature", label, F.size(F.filter("_edges", lambda e: e < F.col("value"))).alias("_bin")).agg(F.count(F.lit(1)).alias("c"))
    of, by, all_ = Window.partitionBy("feature", label), Window.partitionBy("feature", "_bin"), Window.partitionBy("feature")
    cell = cell.withColumn("a", F.sum("c").over(of)).withColumn("b", F.sum("c").over(by)).withColumn("n", F.sum("c").over(all_))
    return cell.groupBy("feature").agg(F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("a") * F.col("b")))).alias("mi"))


def fold_information(table: DataFrame, features: Sequence[str], *, run: str = "run_id", label: str = "label", bins: int = 10) -> DataFrame:
    """run, feature, mi: mutual information as `mi_binned` over the rows of all other runs. One pass counts cells per
    run; a fold's training counts are the total less its run. Edges are quantiles of all rows, which know no labels."""
    long = melt(table, [run, label], features).dropna(subset=["value"])
    edges = exact_quantiles(long, "value", [i / bins for i in range(1, bins)], ["feature"]).select("feature", F.col("q").alias("_edges"))
    cell = long.join(edges, "feature").groupBy(run, "feature", label, F.size(F.filter("_edges", lambda e: e < F.col("value"))).alias("_bin")).agg(F.count(F.lit(1)).alias("_own"))
    every = cell.groupBy("feature", label, "_bin").agg(F.sum("_own").alias("_all"), F.map_from_entries(F.collect_list(F.struct(run, "_own"))).alias("_of"))
    runs = cell.select(run).distinct().agg(F.collect_list(run).alias("_runs"))  # one row: runs are few
    left = every.join(runs).select("feature", label, "_bin", F.explode("_runs").alias(run), "_all", "_of")
    left = left.withColumn("c", F.col("_all") - F.coalesce(F.col("_of")[F.col(run)], F.lit(0))).where("c > 0")
    of, by, all_ = Window.partitionBy(run, "feature", label), Window.partitionBy(run, "feature", "_bin"), Window.partitionBy(run, "feature")
    left = left.withColumn("a", F.sum("c").over(of)).withColumn("b", F.sum("c").over(by)).withColumn("n", F.sum("c").over(all_))
    return left.groupBy(run, "feature").agg(F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("a") * F.col("b")))).alias("mi"))


def hash_rank(rows: DataFrame, groups: Sequence[str], key: Sequence[str], seed: int, parts: int = 256) -> DataFrame:
    """Adds _h, a hash of the key, and _rank, from 1, by it within each group. Counts of `parts` equal ranges of the hash
    lie below row numbers within a range, so a group that holds most rows is not sorted by one task."""
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), *key)).withColumn("_part", F.shiftrightunsigned("_h", 64 - (parts - 1).bit_length()))
    # unsigned order of the ranges; within one, all hashes have one sign
    up_to = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    below = hashed.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"))
    below = below.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_below"))
    within = hashed.withColumn("_no", F.row_number().over(Window.partitionBy(*groups, "_part").orderBy("_h", *key)))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return within.join(below, same).withColumn("_rank", F.col("_no") + F.col("_below")).select(*rows.columns, "_h", "_rank")


def top_features(scores: DataFrame, n: int, score: str = "mi", feature: str = "feature", keys: Sequence[str] = ()) -> DataFrame:
    """The n best per key, ties by name; adds rank."""
    if not keys:
        return scores.orderBy(F.col(score).desc(), feature).limit(n)
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), feature)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def correlations(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """a, b, r of all pairs of features (a before b in the list) over rows where both are there.

    One pass: each task adds up products of its rows with masks for what is missing, relative to a rough centre;
    features x features numbers leave it."""
    p = len(features)
    cols = [F.col(c).cast("double").alias(c) for c in features]
    centre = table.select(*cols).agg(*(F.avg(F.nullif(F.col(c), F.lit(float("nan")))).alias(c) for c in features)).first()
    mid = np.array([0.0 if centre[c] is None else centre[c] for c in features])

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, p, p))
        for frame in frames:
            x = frame.to_numpy(dtype=float) - mid
            there = np.isfinite(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        i, j = np.triu_indices(p, 1)
        yield pd.DataFrame({"i": i, "j": j, **{f"s{k}": total[k][i, j] for k in range(6)}})

    parts = table.select(*cols).mapInPandas(sums, "i int, j int, " + ", ".join(f"s{k} double" for k in range(6)))
    s = parts.groupBy("i", "j").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(6)))
    n, xy = F.col("s0"), F.col("s5") - F.col("s1") * F.col("s2") / F.col("s0")
    xx, yy = F.col("s3") - F.col("s1") * F.col("s1") / n, F.col("s4") - F.col("s2") * F.col("s2") / n
    names = F.array(*map(F.lit, features))
    return s.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), F.when((n > 1) & (xx > 0) & (yy > 0), xy / F.sqrt(xx * yy)).alias("r"))


def prune_walk(features: Sequence[str], r: dict[tuple[str, str], float], variance: dict[str, float], threshold: float) -> list[str]:
    """Names to drop: going through the features in order, each pair above the threshold with an earlier one loses the
    one of less variance (of equals the earlier); what is dropped already takes no part, but a feature that is dropped
    on its turn still meets its remaining partners."""
    gone: set[str] = set()
    for at, name in enumerate(features):
        if name in gone:
            continue
        for other in features[:at]:
            if other not in gone and abs(r.get((other, name)) or 0.0) > threshold:
                gone.add(name if variance[name] < variance[other] else other)
    return [f for f in features if f in gone]


def correlation_prune(table: DataFrame, features: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """feature, dropped: only features x features numbers come to the driver."""
    r = {(x["a"], x["b"]): x["r"] for x in correlations(table, features).collect()}
    v = table.agg(*(F.var_samp(F.nullif(F.col(c).cast("double"), F.lit(float("nan")))).alias(c) for c in features)).first()
    gone = set(prune_walk(features, r, {c: v[c] or 0.0 for c in features}, threshold))
    return table.sparkSession.createDataFrame([(c, c in gone) for c in features], "feature string, dropped boolean")


def top_pairs(table: DataFrame, features: Sequence[str], n: int = 15, among: int = 25) -> DataFrame:
    """a, b, r: the n pairs of greatest |r| among the `among` features of greatest deviation."""
    spread = table.agg(*(F.stddev_samp(c).alias(c) for c in features)).first().asDict()
    widest = sorted(features, key=lambda c: (-(spread[c] or 0.0), c))[:among]
    return correlations(table, [c for c in features if c in widest]).orderBy(F.abs("r").desc(), "a", "b").limit(n)


def explained_variance(table: DataFrame, features: Sequence[str], k: int = 2) -> DataFrame:
    """component, ratio of a PCA of the standardised features; rows with nulls or NaN count them as 0."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    from loam.functions.channels import finite

    vectors = VectorAssembler(inputCols=list(features), outputCol="_x").transform(finite(table, features)).select("_x")
    scaled = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(vectors).transform(vectors)
    model = PCA(k=k, inputCol="_z", outputCol="_p").fit(scaled)
    return table.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(model.explainedVariance)], "component bigint, ratio double")


def stratified_sample(table: DataFrame, cap: int, *, label: str = "label", key: Sequence[str], seed: int = 42) -> DataFrame:
    """At most `cap` rows in the classes' proportions (each at least one), filled up from the rest; by hash of the key
    and seed, so that runs agree. A table of no more rows is returned whole. No class is brought to one task."""
    total = table.count()
    if total <= cap:
        return table
    quota = table.groupBy(F.col(label).alias("_label")).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * cap / total)).alias("_quota"))
    ranked = hash_rank(table, [label], key, seed).join(quota, F.col(label).eqNullSafe(F.col("_label"))).withColumn("_extra", F.col("_rank") > F.col("_quota"))
    return ranked.orderBy("_extra", "_h", *key).limit(cap).select(*table.columns)


def overlap(a: DataFrame, b: DataFrame, column: str = "feature") -> DataFrame:
    """column, where: 'both', 'a' or 'b'."""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    return x.intersect(y).withColumn("where", F.lit("both")).unionByName(x.subtract(y).withColumn("where", F.lit("a"))).unionByName(y.subtract(x).withColumn("where", F.lit("b")))


def mean_importance(rows: DataFrame, n_folds: int, top: int, *, model: str = "model", feature: str = "feature", value: str = "importance") -> DataFrame:
    """model, feature, mean importance over all folds (0 where a fold lacks it), rank: the top ones of each model."""
    mean = rows.groupBy(model, feature).agg((F.sum(F.coalesce(value, F.lit(0.0))) / n_folds).alias("importance"))
    return top_features(mean, top, "importance", feature, [model])
