"""Features from panes against those of windows built row by row."""

import random

import pytest
from pyspark.sql import functions as F

from loam.functions import features as X
from loam.functions import panes as P
from loam.operators import segments as G

KEYS = ("run_id", "segment_id", "k")


@pytest.mark.parametrize(("size", "step"), [(8, 4), (6, 4), (5, 7), (4, 4), (9, 2)])
def test_panes_are_windows(spark, size, step):
    r, rows = random.Random(size), []
    for run, seg, n in ((1, 0, 50), (1, 1, size - 1), (1, 2, size), (2, 0, 37)):
        for i in range(n):
            x = None if (run, seg) == (2, 0) and 10 < i < 22 else 3.0 if i > 40 else r.gauss(5, 2)
            rows.append((run, seg, i, x, abs(r.gauss(0, 3)), r.choice(["a", "b", None]) if run == 1 else None, "clash"))
    table = spark.createDataFrame(rows, "run_id int, segment_id int, row long, x double, v double, label string, n string").repartition(5)
    got = P.pane_windows(table, size, step, ["x", "v"], values=["x"], label="label").cache()
    old = G.window_rows(table, size, step)

    def same(new, want):
        names = sorted(want.columns)
        a, b = ({tuple(t[c] for c in KEYS): [t[c] for c in names if c not in KEYS] for t in df.collect()} for df in (new, want))
        assert a.keys() == b.keys() and len(a) > 5
        for key in b:
            assert a[key] == [v if v is None or isinstance(v, str) else pytest.approx(v, rel=1e-9, abs=1e-9) for v in b[key]], (key, names)

    same(got.select(*KEYS, *P.basic_of("x"), *P.basic_of("v")), old.groupBy(*KEYS).agg(*X.basic("x"), *X.basic("v")))
    same(got.select(*KEYS, *P.centred_basic_of("x")).where("x_std is not null"), X.centred(old, ["x"], KEYS).groupBy(*KEYS).agg(*X.basic("x")[1:]).where("x_std is not null"))
    varied = got.where("x.m2 > 1e-9")
    same(varied.select(*KEYS, *P.moments_of("x")), old.groupBy(*KEYS).agg(*X.moments("x"), F.var_pop("x").alias("var")).where("var > 1e-9").drop("var"))
    same(got.select(*KEYS, *P.odometry_of("v", 50.0)), old.groupBy(*KEYS).agg(*X.odometry("v", 50.0)))
    same(got.select(*KEYS, "label").dropna(), G.window_labels(old).select(*KEYS, "label"))


def test_no_full_window(spark):
    table = spark.createDataFrame([(1, 0, 0, 1.0)], "run_id int, segment_id int, row long, x double")
    assert P.pane_windows(table, 4, 2, ["x"]).collect() == []
