"""Interval labels by pieces and binary search against a look at every interval."""

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loam.operators.labelling import elementary, label_samples


def first(ranges, t):
    return next((r["name"] for r in ranges if None not in (r["t0"], r["t1"]) and r["t0"] <= t <= r["t1"]), None)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 12)), st.one_of(st.none(), st.integers(0, 12))), max_size=8))
def test_every_piece_has_the_first_name(spans):
    ranges = [{"t0": a, "t1": b, "name": f"n{i}"} for i, (a, b) in enumerate(spans)]
    ends, names = elementary(ranges)
    assert ends == sorted(set(ends)) and len(names) == 2 * len(ends)
    for k, e in enumerate(ends):
        assert names[2 * k] == first(ranges, e)
        assert names[2 * k + 1] == first(ranges, e + 0.5 if k + 1 == len(ends) else (e + ends[k + 1]) / 2)


def test_nested_intervals_are_named_once():
    n = 20_000  # every one holds all later ones: a look at each interval for each piece would be 8e8 looks
    ends, names = elementary([{"t0": i, "t1": 2 * n - i, "name": str(i)} for i in reversed(range(n))])
    assert len(ends) == 2 * n and names[: 2 * n : 2] == [str(i) for i in range(n)] and names[-1] is None


def test_labels_of_samples(spark):
    r = random.Random(2)
    intervals = [(run, r.randint(0, 2), k, a, a + r.choice([-1.0, 0.0, 2.0, 9.0]), f"l{r.randint(0, 5)}") for run in (1, 2) for k in range(40) for a in [float(r.randint(0, 60))]]
    intervals += [(None, 0, 0, 0.0, 99.0, "null"), (1, None, 0, None, 5.0, "open")]
    samples = [(run, r.choice([float(r.randint(-2, 75)), r.random() * 70]), "old", "clash", "clash") for run in (1, 2, 3) for _ in range(300)]
    samples += [(None, 1.0, "old", "x", "x"), (1, None, "old", "x", "x"), (1, math.nan, "old", "x", "x")] + samples[:5]
    got = label_samples(
        spark.createDataFrame(samples, "run_id int, t double, label string, name string, label_ord string"),
        spark.createDataFrame(intervals, "run_id int, label_ord int, range_ord int, t0 double, t1 double, label string"),
    ).collect()
    assert len(got) == len(samples)
    for row in got:
        own = [{"t0": a, "t1": b, "name": n} for run, o, k, a, b, n in sorted(intervals, key=lambda x: (x[1] is None, x[1] or 0, x[2], x[3] or 0, x[4])) if run == row.run_id and run is not None]
        assert row.label == (None if row.t is None or math.isnan(row.t) else first(own, row.t)), row
