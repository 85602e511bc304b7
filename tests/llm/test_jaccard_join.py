import random
import re
from collections import Counter

import numpy as np

from loam.llm.common import WordHash
from loam.llm.jaccard_join import Missed, components, near_duplicates, one_of_each, shingles

SEP = re.compile("[^\x20\x09-\x0d]+")


def grams(text):
    w = SEP.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def corpus():
    r = random.Random(12)
    word = lambda: f"w{r.randint(0, 4000)}"
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(260):
        parts = [" ".join(word() for _ in range(r.randint(3, 120)))]
        if i % 3 == 0:
            parts.append(passage)
        rows.append(" ".join(parts))
    base = [word() for _ in range(300)]
    for _ in range(60):  # near copies of one another, some at the edge
        w = list(base)
        for k in r.sample(range(300), r.randint(0, 12)):
            w[k] = word()
        rows.append(" ".join(w))
    for k in range(30):
        w = rows[k].split()
        w[len(w) // 2] = "edit"
        rows.append(" ".join(w))
    rows += [rows[3]] * 40 + [rows[7] + "\n", None, "", "", "a b", "b a", "a  b", " ".join(f"u{i}" for i in range(5000)), " ".join(f"u{i}" for i in range(5001))]
    ids = list(range(10, 10 + len(rows)))
    r.shuffle(ids)
    return [*zip(ids, rows), (None, rows[5]), (ids[4], rows[4])]


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), (True, 1 << 60)), key(i))
    return [(rows[i][0], None if least[find(i)][0] else least[find(i)][1], links[i]) for i in range(len(rows))], [find(i) for i in range(len(rows))]


def test_classes_and_links_are_brute_force(spark):
    rows = corpus()
    want, groups = brute(rows)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, set_key string, copies int").repartition(6)
    for small, most in ((1024, 512), (20, 16)):
        got = [(r.doc_id, r.class_id, r.n_links) for r in near_duplicates(docs, small=small, most=most, recall=0.999).collect()]
        assert Counter(got) == Counter(want)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    stays = Counter(r.doc_id for r in kept.collect())
    assert sum(stays.values()) == len(set(groups)) and set(stays) == {c if n or c is not None else i for i, c, n in want if i == c or n == 0}


def test_components(spark):
    r = random.Random(1)
    edges = [(f"{i:04d}".encode(), f"{i + 1:04d}".encode()) for i in range(120) if i % 40 != 39]
    r.shuffle(edges)
    got = {bytes(x.node): bytes(x.root) for x in components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {f"{i:04d}".encode(): f"{i // 40 * 40:04d}".encode() for i in range(120)}


def test_shingles_of_short_texts():
    hasher = WordHash()
    h = hasher.of("a b c d e f a b x".encode().split())
    s, n = shingles(h, np.array([6, 2, 0, 1]))
    assert n.tolist() == [2, 1, 0, 1] and len(set(s.tolist())) == 4


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).collect() == []
    assert one_of_each(none).collect() == []


def test_one_of_each_keeps_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "a", 1), (2, text, "b", 2), (3, None, "c", 3), (None, text, "d", 4), (4, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text_hash string, _gone int")
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)
    assert one_of_each(docs.limit(0)).collect() == []


def test_expected_recall_is_over_agreeing_coordinates():
    """Against a simulation of pairs that agree in a binomial number of coordinates, which all runs share."""
    rng = np.random.default_rng(0)
    for depth, runs in ((3, 14), (8, 14), (14, 28)):
        missed = Missed(0.8)
        missed.runs(runs, depth)
        m = rng.binomial(64, 0.8, 6000)
        lost = np.ones(len(m), dtype=bool)
        for _ in range(runs):
            alive = np.ones(len(m), dtype=np.int64)
            for _ in range(depth):
                alive = rng.poisson(np.minimum(alive, 10_000) * m / (64 * 0.8))
            lost &= alive == 0
        assert abs(lost.mean() - missed.total()) < 0.006
