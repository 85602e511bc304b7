"""Small cases with expected values worked out by hand or with NumPy."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loam.functions import features as X
from loam.operators import align, cusum, evaluation, filters, labelling, qc, segments, selection, transitions
from loam.sources import label_config, logs


def test_parse_and_clean(spark):
    lines = spark.createDataFrame([("% head",), ("2.0 1 2 3",), ("1.0 4 5 6 % note",), ("1.0 7 8 9",), ("3.0 1 2",)], "value string").withColumn("run_id", F.lit("r")).withColumn("n", F.monotonically_increasing_id())
    rows = logs.clean_rows(logs.parse_lines(lines, logs.SENSOR_COLUMNS["acc"]), logs.SENSOR_COLUMNS["acc"], arrival=["n"])
    assert sorted((r.t, r.ax, r.ay, r.az) for r in rows.collect()) == [(1.0, 4, 5, 6), (2.0, 1, 2, 3)]


def test_files(spark, tmp_path):
    for run in ("log_1", "log_2"):
        folder = tmp_path / "site" / run
        folder.mkdir(parents=True)
        (folder / "acc_x.txt").write_text("% a\n0.5 1 2 3\n0.25 1 1 1\n")
        (folder / "odo_x.csv").write_text("t,v1,v2,extra\n1,2,3,q\n1,9,9,z\n")
    acc = logs.read_log(spark, str(tmp_path), "acc").collect()
    assert {r.run_id for r in acc} == {"log_1", "log_2"} and len(acc) == 4
    odo = logs.read_csv(spark, str(tmp_path), "odo")
    assert sorted((r.run_id, r.t, r.v1, r.extra) for r in odo.collect()) == [("log_1", 1, 2, "q"), ("log_2", 1, 2, "q")]
    with pytest.raises(KeyError):
        logs.read_csv(spark, str(tmp_path), "odo").transform(lambda d: logs.require_columns(d, ["nope"]))
    for fmt in ("parquet", "csv", "json"):
        logs.write_runs(odo, str(tmp_path / fmt), fmt)
        assert (tmp_path / fmt / "run_id=log_1").is_dir()
    logs.write_table(odo, str(tmp_path / "w.parquet"))
    assert spark.read.parquet(str(tmp_path / "w.parquet")).count() == 2


def test_top_features(spark):
    for text in ('["a", "b"]', '{"top_features": ["a", "b"]}', '{"a": 1, "b": 2}'):
        rows = label_config.top_features(spark.createDataFrame([(text,)], "value string"))
        assert [r.feature for r in rows.collect()] == ["a", "b"]


def test_interval_labels(spark):
    config = spark.createDataFrame([("r", '{"a":[[0,5],[9,9]],"b":[[4,8]]}')], "run_id string, config string")
    times = [0, 4.5, 5, 5.1, 8, 8.5, 9]
    rows = spark.createDataFrame([("r", float(t)) for t in times], "run_id string, t double")
    got = {r.t: r.label for r in labelling.label_samples(rows, label_config.label_intervals(config)).collect()}
    assert [got[t] for t in times] == ["a", "a", "a", "b", "b", None, "a"]


def test_alignment(spark):
    knots = spark.createDataFrame([("r", 0.0, 0.0, "a"), ("r", 0.012, 12.0, "b"), ("r", 0.031, 31.0, "c")], "run_id string, t double, v double, l string")
    at = [-0.01, 0.0, 0.01, 0.02, 0.03, 0.04]
    points = spark.createDataFrame([("r", i, t) for i, t in enumerate(at)], "run_id string, i bigint, t double")
    get = lambda how, c: [r[c] for r in sorted(align.align(knots, points, [c], how).collect(), key=lambda r: r.i)]
    assert get("linear", "v") == pytest.approx([0, 0, 10, 20, 30, 31])
    assert get("forward", "v") == [0, 0, 12, 31, 31, 31]
    assert get("backward", "l") == ["a", "a", "a", "b", "b", "c"]
    assert get("nearest", "v") == [0, 0, 12, 12, 31, 31]


def test_qc(spark):
    rows = spark.createDataFrame([("r", "acc", t) for t in (0.0, 0.01, 0.02, 0.03, 0.10, 0.11)] + [("r", "one", 0.0)], "run_id string, sensor string, t double")
    got = {r.sensor: r for r in qc.qc_stats(rows).collect()}
    a = got["acc"]
    assert (a.n, a.n_gaps) == (6, 1) and (a.dt_med, a.dt_p99, a.dt_max, a.gap_ratio) == pytest.approx((0.01, 0.0676, 0.07, 7))
    assert (got["one"].n, got["one"].duration_s, got["one"].dt_med, got["one"].n_gaps) == (1, 0.0, None, 0)
    v = spark.createDataFrame([("r", float(i), float(x)) for i, x in enumerate((1, 1, 1, 2, 2, 5, 5, 5, 5, -5))], "run_id string, t double, x double")
    c = qc.channel_checks(v, ["x"]).first()
    assert (c.n_unique, c.repeat_ratio, c.longest_constant_run, c.clip_candidates, c.flag_frozen, c.flag_flat_top) == (4, 0.6, 4, 5, False, False)


def test_segments_windows_labels(spark):
    rows = spark.createDataFrame([("r", float(t)) for t in (0, 1, 2, 5, 6, 9)], "run_id string, t double")
    got = segments.segments(segments.with_segments(rows, 2.0)).collect()
    assert sorted((r.segment_id, r.n_samples) for r in got) == [(0, 3), (1, 2), (2, 1)]
    seven = segments.with_segments(spark.createDataFrame([("r", float(t), x) for t, x in enumerate("baabccc")], "run_id string, t double, label string"), 2.0)
    w = segments.sliding_windows(seven, 4, 2, series=["label"]).collect()
    assert sorted((r.window_start_idx, r.window_end_idx, tuple(r.label__series)) for r in w) == [(0, 3, tuple("baab")), (2, 5, tuple("abcc"))]
    labels = {r.k: r.label for r in segments.window_labels(segments.window_rows(seven, 4, 2)).collect()}
    assert labels == {0: "b", 1: "c"}
    nulls = spark.createDataFrame([("r", 0, 0, i, x) for i, x in enumerate((None, None, "c", None))] + [("r", 0, 1, 0, None)], "run_id string, segment_id int, k int, row int, label string")
    assert [(r.k, r.label) for r in segments.window_labels(nulls).collect()] == [(0, "c")]


def test_features(spark):
    x = [1.0, 3.0, 2.0, 5.0, 4.0, 4.0, 0.0, 1.0]
    rows = spark.createDataFrame([Row(w=0, row=i, x=v) for i, v in enumerate(x)])
    f = X.with_steps(rows, ["x"], ["w"], "row").groupBy("w").agg(*X.basic("x"), *X.quantiles("x"), *X.jerk_hjorth("x", 8.0)).first()
    assert (f.x_mean, f.x_std, f.x_median, f.x_iqr, f.x_rms, f.x_energy, f.x_jerk_rms, f.x_activity, f.x_mobility, f.x_complexity) == pytest.approx((2.5, 1.658312, 2.5, 3, 3, 72, 17.104719, 2.75, 1.289317, 1.347849), abs=1e-5)
    s = X.spectrum(np.array([x]), 8.0, {"b": (1.0, 3.0)})
    assert [float(s[k][0]) for k in ("spectral_energy", "dominant_freq", "spectral_centroid", "spectral_entropy", "b")] == pytest.approx([11, 1, 2.118897, 1.341, 5.0], abs=1e-4)
    m = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 8.0, 9.0, 15.0, 3.3)], "x double").agg(*X.moments("x")).first()
    assert (m.x_skew, m.x_kurt) == pytest.approx((1.024452, 0.501183), abs=1e-5)
    z = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate((0, 1, 0, -2, 0, 0, 3, -1))], "w int, row int, x double")
    assert X.with_steps(z, ["x"], ["w"], "row").agg(*X.crossings("x")).first().x_zcr == pytest.approx(3 / 7)


def test_filters(spark):
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate((1, 2, 3, 4, 5))], "s int, i int, x double")
    assert [r.x for r in sorted(filters.moving_average(rows, ["x"], 3, keys=["s"], order="i").collect(), key=lambda r: r.i)] == pytest.approx([1, 2, 3, 4, 3])
    short = [r.x for r in sorted(filters.moving_average(rows, ["x"], 11, keys=["s"], order="i").collect(), key=lambda r: r.i)]
    assert short == pytest.approx(np.convolve([1, 2, 3, 4, 5], np.ones(5) / 5, "same"))
    b, a = filters.butterworth_design(4, 10.0, 100.0)
    gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 100)) / np.polyval(a, np.exp(2j * np.pi * f / 100)))
    assert gain(0.0) == pytest.approx(1) and gain(10.0) == pytest.approx(np.sqrt(0.5))
    t = np.arange(400) / 100
    slow, fast = np.sin(2 * np.pi * t), np.sin(2 * np.pi * 40 * t)
    y = filters.zero_phase(b, a, np.stack([slow + fast, np.full(400, 3.0)], axis=1))
    assert np.abs(y[50:-50, 0] - slow[50:-50]).max() < 0.01 and y[:, 1] == pytest.approx(np.full(400, 3.0))
    cube = np.arange(60.0)[:, None] ** 2
    assert filters.savgol(cube, 11, 2)[5:-5] == pytest.approx(cube[5:-5])


def test_transitions(spark):
    true, pred = "aabbbbcc", "aababbcc"
    rows = spark.createDataFrame([(0, "r", i, float(i), x, y) for i, (x, y) in enumerate(zip(true, pred))], "model int, run_id string, i bigint, t double, label string, pred string")
    get = lambda n: sorted((r.transition_idx, r.outcome, r.delay) for r in transitions.transition_outcomes(rows, n).collect())
    assert get(2) == [(2, "detected", 2.0), (6, "detected", 0.0)]
    assert get(3) == [(2, "missed", None), (6, "boundary", None)]
    gaps = spark.createDataFrame([("r", i, float(i), x) for i, x in enumerate(("a", "a", None, "b", "b", "a"))], "run_id string, i bigint, t double, label string")
    assert sorted((r.transition_idx, r.from_label, r.to_label) for r in transitions.true_transitions(gaps).collect()) == [(3, "a", "b"), (5, "b", "a")]


def test_cusum(spark):
    p = [(0.8, 0.1, 0.1), (0.7, 0.2, 0.1), (0.2, 0.7, 0.1), (0.1, 0.8, 0.1), (0.1, 0.8, 0.1), (0.1, 0.7, 0.2)] + [(0.1, 0.1, 0.8)] * 3
    rows = spark.createDataFrame([(0, "r", i, float(i), list(x)) for i, x in enumerate(p)], "model int, run_id string, i bigint, t double, proba array<double>")
    got = cusum.cusum_alarms(rows, ("a", "b", "c"), (1.0, 2.0, 3.0, 5.0)).collect()
    want = {1: [(2, "b", 1, 1.252763), (6, "c", 5, 2.079442)], 2: [(3, "b", 1, 3.332205), (6, "c", 5, 2.079442)], 3: [(3, "b", 1, 3.332205), (7, "c", 5, 4.158883)], 5: [(4, "b", 1, 5.411646), (8, "c", 5, 6.238325)]}
    for h, alarms in want.items():
        assert sorted((r.k_a, r.c_hat, r.k0_hat, round(r.g_max, 6)) for r in got if r.h == h) == alarms


def test_match(spark):
    t = spark.createDataFrame([("r", 4, 8, 12, "a", "b", 4.0), ("r", 8, 12, 12, "b", "c", 8.0)], "run_id string, transition_idx bigint, next_idx bigint, n_rows bigint, from_label string, to_label string, gt_time double")
    alarms = lambda *ks: spark.createDataFrame([("r", k, float(k), c, 1.0) for k, c in ks], "run_id string, k_a bigint, alarm_time double, c_hat string, g_max double")
    done, false = cusum.match_alarms(t, alarms((3, "b"), (7, "c"), (9, "c")), keys=["run_id"], grace=1)
    assert sorted((r.transition_idx, r.outcome, r.delay) for r in done.collect()) == [(4, "detected", 0.0), (8, "detected", 0.0)] and [r.k_a for r in false.collect()] == [9]
    done, false = cusum.match_alarms(t, alarms((7, "c"), (9, "c")), keys=["run_id"], grace=1)
    assert sorted((r.transition_idx, r.outcome) for r in done.collect()) == [(4, "wrong_class"), (8, "detected")] and not false.collect()


def test_metrics(spark):
    rows = spark.createDataFrame([(0, 1, x, y) for x, y in zip("aabc", "abbb")] + [(0, 2, x, x) for x in "ab"], "model int, fold int, label string, pred string")
    one = evaluation.fold_metrics(rows).where("fold = 1").first()
    assert (one.accuracy, one.macro_f1) == pytest.approx((0.5, 0.583333), abs=1e-5)
    per = {r["class"]: r for r in evaluation.class_metrics(rows).where("fold = 1").collect()}
    assert per["c"].f1 is None and per["c"].support == 1 and per["a"].f1 == pytest.approx(2 / 3)


def test_published_relations(spark):
    """Figures that the published fold scores lead to."""
    scores = [0.958450, 0.888209, 0.846168, 0.805641, 0.819622]
    folds = spark.createDataFrame([("svm", i, x, x) for i, x in enumerate(scores)], "model string, fold int, accuracy double, macro_f1 double")
    s = evaluation.metric_summary(folds, ["model"]).first()
    assert (s.macro_f1_mean, s.macro_f1_std, s.macro_f1_median, s.macro_f1_iqr, s.worst_fold_macro_f1, s.robustness_score) == pytest.approx((0.863618, 0.055135, 0.846168, 0.068587, 0.805641, 0.836051), abs=2e-6)
    assert evaluation.t_quantile(0.975, 4) == pytest.approx(2.776445105)
    assert evaluation.wilcoxon_p(np.array([1.0, 2, 3, 4, 5])) == pytest.approx(0.0625)
    assert evaluation.wilcoxon_p(np.zeros(3)) == 1.0


def test_information():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 2000)
    assert selection.knn_information(y + rng.normal(0, 0.01, 2000), y.astype(str)) == pytest.approx(np.log(2), abs=0.01)
    assert selection.knn_information(rng.normal(0, 1, 2000), y.astype(str)) < 0.05


def test_prune_walk():
    r = {("a", "b"): 0.99, ("a", "c"): 0.97, ("b", "c"): 0.5}
    assert selection.prune_walk(["a", "b", "c"], r, {"a": 1.0, "b": 2.0, "c": 3.0}, 0.95) == ["a"]
    assert selection.prune_walk(["a", "b", "c"], r, {"a": 3.0, "b": 2.0, "c": 1.0}, 0.95) == ["b", "c"]


def test_random_search(spark):
    from loam.plans import crossval

    rng = np.random.default_rng(1)
    rows = [(int(i % 6), "a" if i % 2 else "b", float(rng.normal(3 * (i % 2), 1)), float(rng.normal())) for i in range(120)]
    table = spark.createDataFrame(rows, "run_id bigint, label string, x double, y double").cache()
    got = crossval.random_search(table, ("x", "y"), draws=2, k=3).collect()
    assert len(got) == 2 and got[0].macro_f1 >= got[1].macro_f1 > 0.8
    assert {r.fold for r in crossval.group_folds(table, "run_id", 3).collect()} == {0, 1, 2}


def test_dead_channel(spark):
    rows = spark.createDataFrame([("r", float(i), None, None if i % 2 else float(i)) for i in range(6)], "run_id string, t double, x double, y double")
    got = {r.channel: r for r in qc.channel_checks(rows, ["x", "y"]).collect()}
    x = got["x"]
    assert (x.n, x.n_unique, x.max_abs, x.repeat_ratio, x.longest_constant_run, x.clip_candidates, x.flag_frozen, x.flag_flat_top) == (0, 0, None, None, 0, 0, True, False)
    assert (got["y"].n, got["y"].n_unique, got["y"].max_abs, got["y"].flag_frozen) == (3, 3, 4.0, False)


def test_remaining_rows(spark):
    rows = spark.createDataFrame([(0, "r", i, float(i), x, x) for i, x in enumerate("aabbbb")], "model int, run_id string, i bigint, t double, label string, pred string")
    outcome = lambda **o: transitions.transition_outcomes(rows, 2, **o).first().outcome
    assert (outcome(), outcome(least_remaining=5), outcome(least_remaining=1)) == ("detected", "boundary", "detected")


def test_config_discovery_and_reports(spark, tmp_path):
    for path, text in {"a/labels_config.json": "A", "a/log_1/acc_x.txt": "1", "a/log_2/labels_config.json": "own", "a/log_2/acc.txt": "1", "b/log_3/acc.txt": "1", "b/Run1/labels_config.json": "farm", "b/Run1/log_t0_acc.csv": "1", "b/Run2/log_t0_acc.csv": "1", "a/notes/x.txt": "1"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = {(r.run_id, r.config, r.level) for r in label_config.discover_configs(spark, str(tmp_path)).collect()}
    assert got == {("log_1", "A", "parent"), ("log_2", "own", "run"), ("Run1", "farm", "run")}
    rows = spark.createDataFrame([("r", s, t) for s in ("acc", "odo") for t in (0.0, 0.01, 0.02)], "run_id string, sensor string, t double")
    logs.write_runs(qc.qc_reports(qc.qc_stats(rows)), str(tmp_path / "qc"), "json")
    import json

    report = json.loads(next((tmp_path / "qc" / "run_id=r").glob("*.json")).read_text())["qc_report"]
    assert set(report) == {"acc", "odo"} and report["acc"]["n"] == 3 and report["odo"]["n_gaps"] == 0


def test_feature_columns():
    from loam.functions.channels import feature_columns

    names = ["run_id", "ax_mean", "gy_mean", "mean_speed", "speed_std"]
    assert feature_columns(names, ["run_id"], drop_prefixes=("gy_",)) == ["ax_mean", "mean_speed", "speed_std"]
    assert feature_columns(names, ["run_id"], only_prefixes=("speed", "mean_speed")) == ["mean_speed", "speed_std"]


def test_alarms_across_batches(spark):
    """A run longer than an Arrow batch, warm-up, and a missing probability, against a plain recursion."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet((1, 1, 1), 900)
    p[5, 1] = np.nan
    rows = spark.createDataFrame([(0, f"r{i // 450}", i % 450, float(i), [float(x) for x in v]) for i, v in enumerate(p)], "model int, run_id string, i bigint, t double, proba array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = cusum.cusum_alarms(rows.repartition(5), ("a", "b", "c"), (2.0, 4.0), warmup=7).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for run in range(2):
        log_p = np.log(np.clip(np.nan_to_num(p[450 * run : 450 * run + 450]), 1e-9, 1))
        for h in (2.0, 4.0):
            c, g = int(log_p[0].argmax()), np.zeros(3)
            for k, row in enumerate(log_p):
                g = np.maximum(0, g + row - row[c])
                g[c] = 0
                if k >= 7 and g.max() > h:
                    want.add((f"r{run}", h, k, "abc"[g.argmax()], round(g.max(), 6)))
                    c, g = int(g.argmax()), np.zeros(3)
    assert {(r.run_id, r.h, r.k_a, r.c_hat, round(r.g_max, 6)) for r in got} == want and len(want) > 50


def test_matching_is_greedy(spark):
    """One pass over sorted events gives what the rule says: each transition in order takes the first alarm left."""
    rng = np.random.default_rng(5)
    ts, alarms, want, left = [], [], set(), set()
    for run in range(30):
        at = sorted(rng.choice(60, 6, replace=False).tolist())
        al = sorted(rng.choice(60, 9, replace=False).tolist())
        used = set()
        for i, a in enumerate(at):
            end = at[i + 1] if i < 5 else 60
            ts.append((run, a, end, 60, "x", "y", float(a)))
            hit = next((k for k in al if k not in used and a - 4 <= k < end), None) if a + 3 <= 60 else None
            used |= {hit} - {None}
            want.add((run, a, None if hit is None else float(hit)))
        alarms += [(run, k, float(k), "y", 1.0) for k in al]
        left |= {(run, k) for k in al if k not in used}
    t = spark.createDataFrame(ts, "run_id int, transition_idx bigint, next_idx bigint, n_rows bigint, from_label string, to_label string, gt_time double")
    a = spark.createDataFrame(alarms, "run_id int, k_a bigint, alarm_time double, c_hat string, g_max double")
    done, false = cusum.match_alarms(t, a, keys=["run_id"], grace=4)
    assert {(r.run_id, r.transition_idx, r.detection_time) for r in done.collect()} == want
    assert {(r.run_id, r.k_a) for r in false.collect()} == left


def test_hash_rank(spark):
    rows = spark.range(2000).selectExpr("id", "if(id % 3 = 0, null, id % 2) AS g")
    got = selection.hash_rank(rows, ["g"], ["id"], 1).toPandas()
    for _, own in got.groupby("g", dropna=False):
        assert sorted(own._rank) == list(range(1, len(own) + 1))
    assert selection.stratified_sample(rows, 100, label="g", key=["id"]).count() == 100


def test_window_features_are_the_bundles(spark):
    """The stacked features of windows against the SQL aggregates, with gaps and a constant channel."""
    rng = np.random.default_rng(9)
    rows = [(w, i, *(float(v) for v in rng.normal(size=4)), 1.5, float(rng.random())) for w in range(5) for i in range(40 + w // 3)]
    rows = [(*r[:2], None if (r[0], r[1]) in ((1, 7), (1, 8), (2, 0)) else r[2], *r[3:]) for r in rows]
    table = spark.createDataFrame(rows, "k int, row int, ax double, ay double, az double, gx double, gz double, v double")
    got = {r.k: r.asDict() for r in X.window_features(table, 100.0, keys=["k"], speed="v").collect()}
    norm = lambda cs: F.sqrt(sum((F.col(c) * F.col(c) for c in cs[1:]), F.col(cs[0]) * F.col(cs[0])))
    sql = X.centred(table, ["ax", "ay", "az"], ["k"]).withColumn("acc_mag", norm(["ax", "ay", "az"])).withColumn("gyro_mag", norm(["gx", "gz"]))
    signals = ["ax", "ay", "az", "gx", "gz", "acc_mag", "gyro_mag"]
    columns = [c for s in signals for c in (*X.basic(s), *X.quantiles(s), *X.moments(s), *X.crossings(s), *X.jerk_hjorth(s, 100.0))]
    pairs = [("ax", "ay"), ("ax", "az"), ("ay", "az"), ("gx", "gz"), ("ax", "gx"), ("az", "gz"), ("acc_mag", "gyro_mag")]
    want = X.with_steps(sql, signals, ["k"], "row").groupBy("k").agg(F.count(F.lit(1)).alias("n_samples"), *columns, *(X.safe_corr(a, b).alias(f"corr_{a}_{b}") for a, b in pairs), *X.odometry("v", 100.0)).collect()
    assert len(want) == len(got) == 5
    for r in want:
        for name, value in r.asDict().items():
            assert got[r.k][name] == (None if value is None else pytest.approx(value, rel=1e-9, abs=1e-9)), (r.k, name)
    one = X.spectrum(np.array([[r[5] for r in rows if r[0] == 3]]), 100.0)
    assert got[3]["gx_spectral_centroid"] == pytest.approx(one["spectral_centroid"][0]) and got[1]["ax_spectral_energy"] is None


@pytest.mark.parametrize("n", [5, 64, 130, 1000])
def test_filter_blocks_are_the_recursion(n):
    rng = np.random.default_rng(n)
    for order, cutoff in ((2, 5.0), (4, 20.0)):
        b, a = filters.butterworth_design(order, cutoff, 100.0)
        x, memory = rng.normal(size=(n, 3)), rng.normal(size=(order, 3))
        plain, past_x, past_y = [], [np.zeros(3)] * order, [np.zeros(3)] * order
        for t, v in enumerate(x):
            y = b[0] * v + sum(b[k + 1] * past_x[k] - a[k + 1] * past_y[k] for k in range(order)) + (memory[t] if t < order else 0)
            plain.append(y)
            past_x, past_y = [v, *past_x[:-1]], [y, *past_y[:-1]]
        assert filters._recursion(b, a, x, memory) == pytest.approx(np.array(plain))
