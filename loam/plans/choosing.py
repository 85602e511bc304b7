"""Queries of feature selection, filters and model jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam import views as V
from loam.operators import filters as L
from loam.operators import nearest as N
from loam.operators import selection as S
from loam.operators import segments as G
from loam.plans import crossval as M

QUERIES, ORACLES = {}, {}
X = tuple(f"x{i}" for i in range(8))
ALL = tuple(f"x{i}" for i in range(64))
#: Noise in training deviations, as in the reference: 0 to 2 in steps of 0.1.
SIGMAS = [i / 10 for i in range(21)]
EMB = V.with_views("series_emb") + ", w AS (SELECT vec_id, run_id, CASE WHEN label IN ('l0', 'l1', 'l2', 'l3', 'l4') THEN 'low' ELSE 'high' END AS label, " + ", ".join(f"series[{i + 1}] + {('series[1] * 30' if i == 3 else '0')} AS x{i}" for i in range(8)) + " FROM series_emb)"
LONG = EMB + ", l AS (SELECT vec_id, run_id, label, unnest([" + ", ".join(f"'{x}'" for x in X) + "]) AS feature, unnest([" + ", ".join(X) + "]) AS value FROM w)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def whole(spark: SparkSession, d: str) -> DataFrame:
    """All 64 numbers of each embedding as features, all ten labels; x3 also follows x0."""
    s = V.series_emb(spark, d)
    return s.select("vec_id", "run_id", "label", *((F.col("series")[i] + (F.col("series")[0] * 30 if i == 3 else 0.0)).alias(x) for i, x in enumerate(ALL)))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """The first eight numbers of each embedding and two labels, as the SQL has them; x3 also follows x0. Queries named
    whole_... do the same with `whole`, and so do all that have no SQL."""
    s = V.series_emb(spark, d)
    extra = lambda i: F.col("series")[0] * 30 if i == 3 else 0.0
    low = F.col("label").isin("l0", "l1", "l2", "l3", "l4")
    return s.select("vec_id", "run_id", F.when(low, "low").otherwise("high").alias("label"), *((F.col("series")[i] + extra(i)).alias(f"x{i}") for i in range(8)))


def mi_knn(spark: SparkSession, d: str) -> DataFrame:
    return r(N.mi_knn(whole(spark, d), ALL))


QUERIES["mi_knn"] = mi_knn
BINS = ", e AS (SELECT feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM l GROUP BY feature), b AS (SELECT feature, label, len(list_filter(q, lambda z: z < value)) AS bin, count(*) AS c FROM l JOIN e USING (feature) GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY feature, label) AS a, sum(c) OVER (PARTITION BY feature, bin) AS s, sum(c) OVER (PARTITION BY feature) AS n FROM b), mi AS (SELECT feature, round(sum(c / n * ln(c * n / (a * s))), 6) AS mi FROM t GROUP BY feature)"
BINNED = LONG + BINS
#: The same over all 64 numbers: w a row per vector, l a row per number.
EVERY = V.with_views("series_emb") + ", w AS (SELECT vec_id, run_id, label, list_transform(series, lambda x, i: x + CASE WHEN i = 4 THEN series[1] * 30 ELSE 0 END) AS s FROM series_emb), l AS (SELECT vec_id, run_id, label, unnest(range(64)) AS no, 'x' || unnest(range(64)) AS feature, unnest(s) AS value FROM w)"
EVERY_CORR = EVERY + ", r AS (SELECT i.n AS i, j.n AS j, 'x' || i.n AS a, 'x' || j.n AS b, corr(s[i.n + 1], s[j.n + 1]) AS r FROM w, range(64) i(n), range(64) j(n) WHERE i.n < j.n GROUP BY i.n, j.n)"


@query(BINNED + " SELECT * FROM mi")
def mi_binned(spark: SparkSession, d: str) -> DataFrame:
    return r(S.mi_binned(vectors(spark, d), X))


@query(BINNED + " SELECT * FROM mi ORDER BY mi DESC, feature LIMIT 5")
def topk_features(spark: SparkSession, d: str) -> DataFrame:
    return S.top_features(r(S.mi_binned(vectors(spark, d), X)), 5)


PAIRS = [(a, b) for i, a in enumerate(X) for b in X[i + 1 :]]
CORR = EMB + ", r AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM w" for a, b in PAIRS) + ")"


@query(CORR + " SELECT a, b, round(r, 6) AS r FROM r")
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return r(S.correlations(vectors(spark, d), X))


@query(CORR + " SELECT a, b, round(r, 6) AS r FROM r WHERE a NOT IN (SELECT f FROM v) AND b NOT IN (SELECT f FROM v) ORDER BY abs(r) DESC, a, b LIMIT 5".replace("SELECT f FROM v", "SELECT feature FROM (SELECT feature, stddev_samp(value) AS s FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in X) + "]) AS feature, unnest([" + ", ".join(X) + "]) AS value FROM w) GROUP BY feature) ORDER BY s, feature DESC LIMIT 2"))
def top_corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    return r(S.top_pairs(vectors(spark, d), X, n=5, among=6))


@query(CORR + " SELECT unnest([" + ", ".join(f"'{x}'" for x in X) + "]) AS feature, unnest([" + ", ".join(("(SELECT abs(r) > 0.95 AND va <= vb FROM (SELECT (SELECT r FROM r WHERE a = 'x0' AND b = 'x3') AS r, (SELECT var_samp(x0) FROM w) AS va, (SELECT var_samp(x3) FROM w) AS vb))" if x == "x0" else "false") for x in X) + "]) AS dropped")
def corr_prune(spark: SparkSession, d: str) -> DataFrame:
    return S.correlation_prune(vectors(spark, d), X)


@query()
def pca_explained(spark: SparkSession, d: str) -> DataFrame:
    return r(S.explained_variance(whole(spark, d), ALL))


@query(EMB + " SELECT label, CASE WHEN x0 = hi THEN 25 ELSE CAST(floor((x0 - lo) / (hi - lo) * 25) AS BIGINT) + 1 END AS bin, count(*) AS n FROM w, (SELECT min(x0) AS lo, max(x0) AS hi FROM w) GROUP BY ALL")
def class_histogram(spark: SparkSession, d: str) -> DataFrame:
    return S.class_histogram(vectors(spark, d), "x0")


@query()
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.stratified_sample(V.signals_ev(spark, d), 500, key=["event_id"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


OVERLAP = ", p AS (SELECT feature FROM mi ORDER BY mi DESC, feature LIMIT 5), q AS (SELECT feature FROM mi ORDER BY feature LIMIT 5) SELECT coalesce(p.feature, q.feature) AS feature, CASE WHEN q.feature IS NULL THEN 'a' WHEN p.feature IS NULL THEN 'b' ELSE 'both' END AS \"where\" FROM p FULL JOIN q ON p.feature = q.feature"


@query(BINNED + OVERLAP)
def feature_set_overlap(spark: SparkSession, d: str) -> DataFrame:
    mi = r(S.mi_binned(vectors(spark, d), X))
    return S.overlap(S.top_features(mi, 5), mi.orderBy("feature").limit(5))


@query(LONG + ", m AS (SELECT run_id, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS model, feature, round(avg(abs(value)), 9) AS importance FROM l WHERE NOT (run_id = 3 AND feature = 'x1') GROUP BY ALL), s AS (SELECT model, feature, sum(importance) / 5 AS importance FROM m GROUP BY ALL) SELECT model, feature, round(importance, 6) AS importance, rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS rank FROM s) WHERE rank <= 3")
def importance_mean_topk(spark: SparkSession, d: str) -> DataFrame:
    long = S.melt(vectors(spark, d), ["vec_id", "run_id"], X).where("not (run_id = 3 and feature = 'x1')")
    rows = long.groupBy("run_id", F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("model"), "feature").agg(F.round(F.avg(F.abs("value")), 9).alias("importance"))
    return r(S.mean_importance(rows, 5, 3)).withColumn("rank", F.col("rank").cast("bigint"))


@query(EVERY + BINS + " SELECT * FROM mi")
def whole_mi_binned(spark: SparkSession, d: str) -> DataFrame:
    return r(S.mi_binned(whole(spark, d), ALL))


@query(EVERY + BINS + " SELECT * FROM mi ORDER BY mi DESC, feature LIMIT 5")
def whole_topk_features(spark: SparkSession, d: str) -> DataFrame:
    return S.top_features(r(S.mi_binned(whole(spark, d), ALL)), 5)


@query(EVERY_CORR + " SELECT a, b, round(r, 6) AS r FROM r")
def whole_corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return r(S.correlations(whole(spark, d), ALL))


@query(EVERY_CORR + ", v AS (SELECT feature FROM l GROUP BY feature ORDER BY stddev_samp(value) DESC, feature LIMIT 25) SELECT a, b, round(r, 6) AS r FROM r WHERE a IN (FROM v) AND b IN (FROM v) ORDER BY abs(r.r) DESC, a, b LIMIT 15")
def whole_top_corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    return r(S.top_pairs(whole(spark, d), ALL))


@query(
    EVERY_CORR
    + ", v AS (SELECT no, var_samp(value) AS v FROM l GROUP BY no), p AS (SELECT i, j, vi.v AS vi, vj.v AS vj, row_number() OVER (ORDER BY j, i) AS k FROM r JOIN v vi ON vi.no = i JOIN v vj ON vj.no = j WHERE abs(r) > 0.95), "
    "walk AS (SELECT 0::BIGINT AS k, -1::BIGINT AS turn, []::BIGINT[] AS before, []::BIGINT[] AS gone UNION ALL SELECT p.k, j, CASE WHEN turn = j THEN before ELSE gone END, CASE WHEN list_contains(CASE WHEN turn = j THEN before ELSE gone END, j) OR list_contains(gone, i) THEN gone ELSE list_append(gone, CASE WHEN vj < vi THEN j ELSE i END) END FROM walk JOIN p ON p.k = walk.k + 1) "
    "SELECT 'x' || n AS feature, list_contains((SELECT gone FROM walk ORDER BY k DESC LIMIT 1), n) AS dropped FROM range(64) t(n)"
)
def whole_corr_prune(spark: SparkSession, d: str) -> DataFrame:
    return S.correlation_prune(whole(spark, d), ALL)


@query(EVERY + ", e AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY feature) SELECT feature, label, CASE WHEN value = hi THEN 25 ELSE CAST(floor((value - lo) / (hi - lo) * 25) AS BIGINT) + 1 END AS bin, count(*) AS n FROM l JOIN e USING (feature) GROUP BY ALL")
def whole_class_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = S.melt(whole(spark, d), ["label"], ALL).dropna(subset=["value"])
    span = rows.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    place = F.least(F.lit(25), F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 25) + 1)
    placed = rows.join(F.broadcast(span), "feature").withColumn("bin", F.when(F.col("_hi") > F.col("_lo"), place).otherwise(F.lit(1)).cast("bigint"))
    return placed.groupBy("feature", "label", "bin").agg(F.count(F.lit(1)).alias("n"))


@query(EVERY + BINS + OVERLAP)
def whole_feature_set_overlap(spark: SparkSession, d: str) -> DataFrame:
    mi = r(S.mi_binned(whole(spark, d), ALL))
    return S.overlap(S.top_features(mi, 5), mi.orderBy("feature").limit(5))


@query(EVERY + ", m AS (SELECT run_id, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS model, feature, round(avg(abs(value)), 9) AS importance FROM l GROUP BY ALL), s AS (SELECT model, feature, sum(importance) / 5 AS importance FROM m GROUP BY ALL) SELECT model, feature, round(importance, 6) AS importance, rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS rank FROM s) WHERE rank <= 3")
def whole_importance_mean_topk(spark: SparkSession, d: str) -> DataFrame:
    long = S.melt(whole(spark, d), ["vec_id", "run_id"], ALL)
    rows = long.groupBy("run_id", F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("model"), "feature").agg(F.round(F.avg(F.abs("value")), 9).alias("importance"))
    return r(S.mean_importance(rows, 5, 3)).withColumn("rank", F.col("rank").cast("bigint"))


def _segmented(spark: SparkSession, d: str, every: int = 97) -> DataFrame:
    """The suppliers' lines with every 97th missing, so that there are gaps."""
    return G.with_segments(V.signals_li(spark, d).where(f"i % {every} <> 0"), 0.015)


#: What the filters and their queries take of the segments' columns.
_TAKEN = ("run_id", "segment_id", "row", "i", "ax", "ay", "gx")


def _filtered(spark: SparkSession, d: str, *names: str, every: int = 97) -> DataFrame:
    return L.filter_segments(_segmented(spark, d, every).select(*_TAKEN), ("ax", "ay", "gx"), [c for c in L.CONFIGS if c.name in names], 100.0)


def _parted(spark: SparkSession, d: str) -> DataFrame:
    """All the suppliers' lines, with a second's pause after every 397th."""
    return G.with_segments(V.signals_li(spark, d).withColumn("t", F.col("t") + F.floor(F.col("i") / 397)), 0.015)


def _smoothed(spark: SparkSession, d: str, name: str) -> DataFrame:
    return r(L.filter_segments(_parted(spark, d).select(*_TAKEN), ("ax", "ay", "gx"), [c for c in L.CONFIGS if c.name == name], 100.0).select("run_id", "i", "ax", "ay"))


@query()
def butterworth_filter(spark: SparkSession, d: str) -> DataFrame:
    return _smoothed(spark, d, "butter_o4_10hz")


@query()
def long_butterworth(spark: SparkSession, d: str) -> DataFrame:
    """`butterworth_filter` by chunks of segments."""
    b, a = L.butterworth_design(4, 10.0, 100.0)
    return r(L.zero_phase_long(_parted(spark, d).select(*_TAKEN), ("ax", "ay", "gx"), b, a, chunk_rows=V.CHUNK).select("run_id", "i", "ax", "ay"))


@query()
def savgol_filter(spark: SparkSession, d: str) -> DataFrame:
    return _smoothed(spark, d, "savgol_w11_p2")


@query(V.with_views("signals_li") + ", s AS (SELECT *, CAST(floor(i / 97) AS BIGINT) AS seg, count(*) OVER (PARTITION BY run_id, CAST(floor(i / 97) AS BIGINT)) AS n FROM signals_li WHERE i % 97 <> 0), a AS (SELECT run_id, i, n, ax, sum(ax) OVER (PARTITION BY run_id, seg ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS m FROM s) SELECT run_id, i, 'ma_5' AS filter, round(CASE WHEN n < 15 THEN ax ELSE m END, 6) AS ax FROM a")
def filter_segments(spark: SparkSession, d: str) -> DataFrame:
    return r(_filtered(spark, d, "ma_5").select("run_id", "i", "filter", "ax"))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return L.filter_metrics(_parted(spark, d), ("ax", "ay", "gx"), L.CONFIGS, 100.0)


@query()
def filter_metrics(spark: SparkSession, d: str) -> DataFrame:
    return r(_metrics(spark, d))


@query()
def filter_select(spark: SparkSession, d: str) -> DataFrame:
    return r(L.select_filter(_metrics(spark, d), least_correlation=0.3))


@query()
def loro_predict(spark: SparkSession, d: str) -> DataFrame:
    out = M.loro_predict(whole(spark, d), ALL)
    return out.select("vec_id", "run_id", "label", "pred", F.transform("proba", lambda x: F.round(x, 4)).alias("proba"))


WHOLE_LONG = V.with_views("series_emb") + ", w AS (SELECT vec_id, run_id, label, list_transform(series, lambda x, i: x + CASE WHEN i = 4 THEN series[1] * 30 ELSE 0 END) AS s FROM series_emb), l AS (SELECT run_id, label, 'x' || unnest(range(64)) AS feature, unnest(s) AS value FROM w), e AS (SELECT feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM l GROUP BY feature), b AS (SELECT run_id, feature, label, len(list_filter(q, lambda z: z < value)) AS bin, count(*) AS own FROM l JOIN e USING (feature) GROUP BY ALL), f AS (SELECT h.run_id, feature, label, bin, sum(own) AS c FROM b, (SELECT DISTINCT run_id FROM b) h WHERE h.run_id <> b.run_id GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY run_id, feature, label) AS a, sum(c) OVER (PARTITION BY run_id, feature, bin) AS s, sum(c) OVER (PARTITION BY run_id, feature) AS n FROM f)"


@query(WHOLE_LONG + " SELECT run_id, feature, round(sum(c / n * ln(c * n / (a * s))), 6) AS mi FROM t GROUP BY run_id, feature")
def fold_information(spark: SparkSession, d: str) -> DataFrame:
    return r(S.fold_information(whole(spark, d), ALL))


@query()
def ablations(spark: SparkSession, d: str) -> DataFrame:
    """All features, those but the first sixteen, those alone, and the fifteen best of each fold's training rows."""
    return r(M.ablations(whole(spark, d), {"all": ALL, "without_first": ALL[16:], "first_only": ALL[:16]}))


@query()
def random_search(spark: SparkSession, d: str) -> DataFrame:
    return r(M.random_search(whole(spark, d), ALL))


@query()
def noise_sweep(spark: SparkSession, d: str) -> DataFrame:
    return r(M.noise_sweep(whole(spark, d), ALL, SIGMAS, 10, key=["vec_id"]))


@query()
def sensor_dropout(spark: SparkSession, d: str) -> DataFrame:
    return r(M.sensor_dropout(whole(spark, d), {"first": ALL[:32], "second": ALL[32:]}))


@query()
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    return r(M.permutation_importance(whole(spark, d), ALL, repeats=8, key=["vec_id"]))


@query(V.with_views("signals_ev") + ", s AS (SELECT run_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST(run_id AS VARCHAR)) AS o FROM signals_ev GROUP BY run_id), walk AS (SELECT CAST(0 AS BIGINT) AS o, CAST(NULL AS BIGINT) AS run_id, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS fold, [0, 0, 0, 0]::BIGINT[] AS load UNION ALL SELECT s.o, s.run_id, s.n, CAST(list_position(load, list_min(load)) - 1 AS BIGINT), list_transform(load, lambda x, i: x + CASE WHEN i = list_position(load, list_min(load)) THEN s.n ELSE 0 END) FROM walk JOIN s ON s.o = walk.o + 1) SELECT run_id, n, fold FROM walk WHERE o > 0")
def group_kfold_assign(spark: SparkSession, d: str) -> DataFrame:
    return M.group_folds(V.signals_ev(spark, d), "run_id", 4)


@query(V.with_views("signals_ev") + " SELECT label, CAST(round(0.15 * count(*)) AS BIGINT) AS n FROM signals_ev GROUP BY label")
def stratified_holdout(spark: SparkSession, d: str) -> DataFrame:
    return M.holdout(V.signals_ev(spark, d), 0.15, key=["event_id"]).where("validation").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
