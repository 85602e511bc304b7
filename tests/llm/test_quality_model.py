import math
import random

import numpy as np
import pytest

from loam.llm.quality_model import N_FEATURES, estimate_prior, fit_quality, held_out_crc, keep_quality, risk, score_quality, slopes


def corpus(n=600):
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeioutnshrdl") for _ in range(r.randint(2, 9)))
    rows, labels = [], []
    for i in range(n):
        good = i % 5 > 0
        words = [word() for _ in range(r.randint(30, 200))]
        text = ". ".join(" ".join(words[k : k + 8]).capitalize() for k in range(0, len(words), 8)) if good else r.choice([" ".join(w + "$$$" for w in words), " ".join(words[:2] * 60), " ".join(words).upper() + "!!"])
        rows.append((i, text, "en", "s"))
        labels.append((i, int(good), "clash"))
    return rows, labels


def test_held_out_accuracy_and_fold(spark):
    rows, labels = corpus()
    odd = [(None, None, None, None), (10**6, "", "en", "s"), (10**6 + 1, "x" * 100_000, "en", "s")]
    docs = spark.createDataFrame([*rows, rows[7], *odd], "doc_id long, text string, lang string, score string")
    table = spark.createDataFrame([*labels, labels[3], (None, 1, "y")], "doc_id long, quality int, x string")
    got = score_quality(docs, table).collect()
    assert len(got) == len(rows) + 4
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (held_out_crc(r.doc_id, 3) == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < len(rows)]
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in held]) > 0.95
    # labels of the held-out fold are never learned from
    flipped = spark.createDataFrame([(i, 1 - q if held_out_crc(i, 3) == 1 else q, x) for i, q, x in labels], "doc_id long, quality int, x string")
    again = {r.doc_id: r.score for r in score_quality(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)
    kept = keep_quality(docs, table)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in score_quality(docs, none).collect()} == {(0.5, 1)}
    assert score_quality(docs.limit(0), none).collect() == []


def test_prior():
    rng = np.random.default_rng(2)
    p = rng.normal(2, 1, 5000)
    u = np.concatenate([rng.normal(2, 1, 7000), rng.normal(-2, 1, 3000)])
    assert abs(estimate_prior(p, u) - 0.7) < 0.04
    assert fit_quality is not None


def plain_risk(w, p, u, prior):
    """The non-negative risk, row by row."""
    def f(x):
        h = [math.tanh(sum(a * b for a, b in zip(x, w[0][:, j])) + w[1][j]) for j in range(len(w[1]))]
        return sum(a * b for a, b in zip(h, w[2])) + w[3][0]

    loss = lambda z: math.log(1 + math.exp(-z))
    mean = lambda xs: sum(xs) / len(xs)
    first = prior * mean([loss(f(x)) for x in p])
    return first, mean([loss(-f(x)) for x in u]) - prior * mean([loss(-f(x)) for x in p])


def test_risk_and_slopes_are_plain_ones():
    rng = np.random.default_rng(4)
    p, u = rng.normal(0.5, 1, (9, 3)), rng.normal(0, 1, (14, 3))
    signs = set()
    for prior in (0.1, 0.5, 0.95):
        for _ in range(6):
            w = [rng.normal(0, 1.5, (3, 2)), rng.normal(0, 1, 2), rng.normal(0, 2, 2), rng.normal(0, 2, 1)]
            first, second = plain_risk(w, p, u, prior)
            assert risk(w, p, u, prior) == pytest.approx((first, second))
            signs.add(second < 0)
            # where the second term is negative the step goes against it alone; else down both
            value = lambda: -plain_risk(w, p, u, prior)[1] if second < 0 else sum(plain_risk(w, p, u, prior))  # noqa: E731, B023
            for a, g in zip(w, slopes(w, p, u, prior)):
                for at in np.ndindex(a.shape):
                    old, side = a[at], []
                    for d in (1e-5, -1e-5):
                        a[at] = old + d
                        side.append(value())
                    a[at] = old
                    assert (side[0] - side[1]) / 2e-5 == pytest.approx(g[at], abs=1e-6)
    assert signs == {True, False}
    assert N_FEATURES == 24


def test_long_texts_and_ties(spark):
    text = "word " * 300_000
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = score_quality(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1
