"""The CUSUM bank over chunks against one pass over each run."""

import numpy as np
import pytest

from loam.operators import cusum as C
from loam.operators import long_cusum as L

KIND = "model string, run_id int, i long, t double, proba array<double>, label string, _chunk string"


def rows(spark, drift, seed=1):
    rng, out = np.random.default_rng(seed), []
    for run, n in ((1, 700), (2, 61), (3, 1)):
        for i in range(n):
            c = (i // 97) % 3
            p = rng.dirichlet(np.eye(3)[c] * drift + 1.0)
            out.append(("m", run, i * 2, float(i), [float(v) for v in p], None if i < 5 or run == 2 else "abc"[c], "clash"))
    return spark.createDataFrame(out, KIND).repartition(5)


@pytest.mark.parametrize(("drift", "chunk", "label"), [(0.0, 300, None), (0.3, 120, "label"), (3.0, 50, "label"), (3.0, 200, None)])
def test_same_alarms(spark, drift, chunk, label):
    table = rows(spark, drift)
    options = {"thresholds": [0.5, 4.0, 60.0], "position": "i", "label": label, "warmup": 3}
    got = sorted((tuple(r) for r in L.cusum_alarms(table, "abc", chunk_rows=chunk, **options).collect()), key=str)
    want = sorted((tuple(r) for r in C.cusum_alarms(table, "abc", **options).collect()), key=str)
    assert [g[:-1] for g in got] == [w[:-1] for w in want] and len(want) > 5
    assert [g[-1] for g in got] == pytest.approx([w[-1] for w in want], abs=1e-9)


def test_a_sum_carried_over_many_chunks(spark):
    """No chunk alarms by itself; a sum grows through four of them."""
    table = spark.createDataFrame([("m", 1, i, float(i), [0.45, 0.55], "a", "") for i in range(120)], KIND)
    options = {"thresholds": [18.0], "label": "label"}
    want = [tuple(r)[:6] for r in C.cusum_alarms(table, "ab", **options).collect()]
    assert [tuple(r)[:6] for r in L.cusum_alarms(table, "ab", chunk_rows=25, **options).collect()] == want and len(want) == 1


def test_empty(spark):
    assert L.cusum_alarms(spark.createDataFrame([], KIND), "abc", [1.0]).collect() == []
