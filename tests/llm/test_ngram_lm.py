import json
import math
import re
import resource
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loam.llm import ngram_lm
from loam.llm.ngram_lm import discounts, held_out_scores, mix, score_texts, train, unmix

SEP = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*SEP.findall(low), "</s>"]


def corpus():
    rng = np.random.default_rng(3)
    p = 1 / np.arange(1, 120)
    rows = []
    for i in range(400):
        ws = [f"{'W' if k % 3 else 'w'}{k}" for k in rng.choice(119, rng.integers(0, 60), p=p / p.sum())]
        rows.append((i, " ".join(ws) if i % 50 else None))
    return [*rows, rows[5], (None, "w1 w2 ÄÖ"), (9999, "unseen words only")]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


class Brute:
    """Modified Kneser-Ney by dictionaries."""

    def __init__(self, texts, order):
        padded = [["<s>", *t] for t in texts]
        grams = lambda m: Counter(tuple(t[k : k + m]) for t in padded for k in range(len(t) - m + 1))
        self.order, self.a = order, {order: grams(order)}
        for m in range(order - 1, 0, -1):
            a = Counter(g[1:] for g in self.a[m + 1])
            if m > 1:
                a |= Counter({g: n for g, n in grams(m).items() if g[0] == "<s>"})
            self.a[m] = a
        self.d = {m: discounts([sum(1 for x in a.values() if x == k) for k in (1, 2, 3, 4)]) for m, a in self.a.items()}
        self.v = len({w for t in texts for w in t})
        self.after = {m: defaultdict(list) for m in self.a}
        for m, a in self.a.items():
            for g, n in a.items():
                self.after[m][g[:-1]].append(n)

    def p(self, context, w):
        m = len(context) + 1
        below = self.p(context[1:], w) if context else 1 / (self.v + 1)
        counts, d = self.after[m].get(context), self.d[m]
        if not counts:
            return below
        n = self.a[m].get((*context, w), 0)
        left = sum(d[min(k, 3) - 1] for k in counts) / sum(counts)
        return (max(n - d[min(n, 3) - 1], 0) / sum(counts) if n else 0) + left * below

    def score(self, t):
        t = ["<s>", *t]
        return sum(math.log10(self.p(tuple(t[max(0, k - self.order + 1) : k]), t[k])) for k in range(1, len(t)))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_exact_figures_and_scores(spark, order):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(4)
    got = held_out_scores(docs, order=order).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    train_texts = [tokens(t) for i, t in rows if not held(i)]
    c = Counter(x for t in train_texts for x in t)
    n, v = sum(c.values()), len(c)
    brute = Brute(train_texts, order)
    assert sum(brute.p(("w1",), w) for w in [*c, "<unk>"]) == pytest.approx(1)
    assert sum(brute.p(("<s>", "w1")[: order - 1], w) for w in [*c, "<unk>"]) == pytest.approx(1)
    for r in got:
        t = tokens(text[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in c for w in t), n, held(r.doc_id))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r.score == pytest.approx(brute.score(t), rel=1e-5)
        assert r.perplexity == pytest.approx(10 ** (-r.score / len(t)))


def test_many_buckets_few_files(spark, monkeypatch, tmp_path):
    """16,384 buckets are read through few open files."""
    monkeypatch.setattr(ngram_lm, "buckets_for", lambda df, mb=2: 1 << 14)
    rows = corpus()
    folder = train(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), order=3)
    old = resource.getrlimit(resource.RLIMIT_NOFILE)
    try:
        resource.setrlimit(resource.RLIMIT_NOFILE, (400, old[1]))
        model = ngram_lm.Model(folder)
        assert model.figures.n_buckets == 1 << 14
        brute = Brute([tokens(t) for _, t in rows], 3)
        for _, t in rows[:60]:
            words = tokens(t)[:-1]
            h = ngram_lm.WordHash(lower=True).of([w.encode() for w in words])
            assert ngram_lm.token_scores(model, h, np.array([len(words)]))[0][0] == pytest.approx(brute.score(tokens(t)), rel=1e-5)
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, old)


@pytest.mark.parametrize(("bits", "order"), [(20, 2), (20, 3), (20, 4), (33, 2), (33, 3), (1, 5)])
def test_packing(bits, order):
    ids = np.random.default_rng(1).integers(0, 1 << bits, (500, order))
    p = ngram_lm.Packing(bits)
    assert p.pack(ids).shape[1] == -(-order // (64 // bits)) and (p.ids(p.pack(ids), order) == ids).all()
    assert len(np.unique(p.key(p.pack(ids)))) == len(np.unique(ids, axis=0))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert held_out_scores(none).collect() == []
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert score_texts(some, train(none)).collect()[0].score == 0.0


def test_mix_is_a_bijection():
    x = np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64)
    assert (unmix(mix(x)) == x).all()
    assert json.dumps(discounts([0, 0, 0, 0]))
